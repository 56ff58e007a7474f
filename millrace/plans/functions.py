"""One query per function group."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import binary, collections, dates, text
from millrace.plans.catalogue import query
from millrace.sources import tables

RUN_DATE = dt.date(2025, 6, 1)


@query("fn_string", r"""
SELECT page_id, 'page ' || page_id AS joined, upper(url) AS upper, trim('  ' || url || ' ') AS trimmed,
  left(url, 4) AS first4, ends_with(lower(url), '.pdf') AS is_pdf, replace(url, 'http', 'ftp') AS replaced,
  len(string_split(url, '/')) AS parts, lpad(CAST(page_id % 7 AS VARCHAR), 2, '0') AS padded,
  CASE WHEN length(url) > 20 THEN left(url, 20) || '...' ELSE url END AS shown,
  CASE WHEN regexp_extract(url, '([^/]*)$', 1) = '' THEN 'file.pdf'
    WHEN strpos(regexp_extract(url, '([^/]*)$', 1), '?') > 1 THEN string_split(regexp_extract(url, '([^/]*)$', 1), '?')[1]
    ELSE regexp_extract(url, '([^/]*)$', 1) END AS last_part,
  CASE page_id % 4 WHEN 0 THEN 'docx' WHEN 1 THEN 'ofd' ELSE 'pdf' END AS format
FROM pages""")
def fn_string(spark: SparkSession, d: str) -> DataFrame:
    url, number = F.col("url"), F.col("page_id")
    name = F.concat(F.lit("x"), F.element_at(F.array(*[F.lit(s) for s in (".DocX", ".ofd", ".txt", "")]),
                                             (number % 4 + 1).cast("int")))
    return tables.parquet(spark, d, "pages").select(
        "page_id", F.concat(F.lit("page "), number.cast("string")).alias("joined"), F.upper(url).alias("upper"),
        F.trim(F.concat(F.lit("  "), url, F.lit(" "))).alias("trimmed"), F.left(url, F.lit(4)).alias("first4"),
        F.lower(url).endswith(".pdf").alias("is_pdf"), F.replace(url, F.lit("http"), F.lit("ftp")).alias("replaced"),
        F.size(F.split(url, "/")).cast("bigint").alias("parts"), text.zero_pad(number % 7).alias("padded"),
        text.truncate(url, 20).alias("shown"), text.last_path_segment(url).alias("last_part"),
        text.file_format(name).alias("format"))


@query("fn_math", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INTEGER) AS qty,
  TRY_CAST(l_returnflag AS DOUBLE) AS not_a_number,
  CAST(round(CAST(l_extendedprice AS DECIMAL(12, 2)) * CAST(l_quantity AS INTEGER), 1) AS DOUBLE) AS total,
  least(CAST(l_quantity AS INTEGER), 30) AS clamped FROM lineitem""")
def fn_math(spark: SparkSession, d: str) -> DataFrame:
    qty = F.col("l_quantity").cast("string").try_cast("double").cast("int")
    total = F.round(F.col("l_extendedprice").cast("decimal(12,2)") * qty, 1).cast("double")
    return tables.parquet(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", qty.alias("qty"),
        F.col("l_returnflag").try_cast("double").alias("not_a_number"), total.alias("total"),
        F.least(qty, F.lit(30)).alias("clamped"))


@query("fn_date", """
SELECT o_orderkey, '2025-06-01 00:00:00' AS now_text, strftime(o_orderdate, '%Y-%m-%d') AS from_epoch,
  year(o_orderdate) || '-' || lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') || '-01' AS iso,
  strftime(o_orderdate, '%Y%m%d') AS compact_parts, strftime(o_orderdate, '%Y%m%d') AS no_dashes,
  CASE WHEN o_orderstatus = 'F' THEN '2025' ELSE CAST(year(o_orderdate) AS VARCHAR) END AS year_text,
  CASE WHEN day(o_orderdate) <= 12 THEN CAST(strftime(o_orderdate, '%Y-%d-01') AS DATE) END AS swapped
FROM orders""")
def fn_date(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate")
    parts = F.year(day), F.month(day), F.dayofmonth(day)
    null_int = F.lit(None).cast("int")
    epoch_ms = F.unix_micros(day.cast("timestamp")) / 1000
    iso_text = F.date_format(day, "yyyy-MM-dd")
    now = dt.datetime.combine(RUN_DATE, dt.time())
    return tables.parquet(spark, d, "orders").select(
        "o_orderkey", F.date_format(F.lit(now).cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss").alias("now_text"),
        dates.epoch_ms_to_date(epoch_ms).alias("from_epoch"),
        dates.parts_to_iso(parts[0], parts[1], null_int).alias("iso"),
        dates.parts_to_compact(*parts).alias("compact_parts"), dates.compact(iso_text).alias("no_dashes"),
        dates.year_prefix(F.when(F.col("o_orderstatus") == "F", F.lit("")).otherwise(iso_text), RUN_DATE).alias("year_text"),
        dates.real_date(parts[0], parts[2], F.lit(1)).alias("swapped"))


@query("fn_array", """
SELECT doc_id, string_split(text, ' ')[1] AS first_word,
  list_filter(string_split(text, ' '), lambda x: length(x) > 6)[1] AS first_long,
  list_sum(list_transform(string_split(text, ' '), lambda x: length(x))) AS letters,
  CAST(len(string_split(text, ' ')) AS BIGINT) AS words, array_to_string(string_split(text, ' ')[1:3], ' ') AS first_three,
  CAST(NULL AS VARCHAR) AS beyond FROM documents""")
def fn_array(spark: SparkSession, d: str) -> DataFrame:
    words = F.split("text", " ")
    return tables.parquet(spark, d, "documents").select(
        "doc_id", collections.first_element(words).alias("first_word"),
        collections.find(words, lambda x: F.length(x) > 6).alias("first_long"),
        collections.sum_or_zero(F.transform(words, F.length)).alias("letters"),
        F.size(words).cast("bigint").alias("words"), F.array_join(F.slice(words, 1, 3), " ").alias("first_three"),
        F.get(words, F.size(words)).alias("beyond"))


@query("fn_map", """
SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_name ELSE c_mktsegment END AS localized,
  CASE WHEN c_acctbal >= 0 THEN c_name ELSE c_mktsegment END AS localized_list,
  'en_GB=' || c_mktsegment || CASE WHEN c_acctbal >= 0 THEN ',zh_CN=' || c_name ELSE '' END AS no_nulls,
  'extra=1,name=' || c_name AS merged FROM customer""")
def fn_map(spark: SparkSession, d: str) -> DataFrame:
    zh = F.when(F.col("c_acctbal") >= 0, F.col("c_name"))
    term = F.struct(F.col("c_mktsegment").alias("en_GB"), zh.alias("zh_CN"))
    listed = F.struct(F.array(F.struct(F.lit("en_GB").alias("locale"), F.col("c_mktsegment").alias("value")),
                              F.struct(F.lit("zh_CN").alias("locale"), zh.alias("value"))).alias("text"))
    entries = F.create_map(F.lit("en_GB"), F.col("c_mktsegment"), F.lit("zh_CN"), zh)
    merged = collections.merge_keeping(F.create_map(F.lit("name"), F.col("c_name")),
                                       F.create_map(F.lit("name"), F.lit("other"), F.lit("extra"), F.lit("1")))

    def shown(m):
        pairs = F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
        return F.array_join(pairs, ",")

    return tables.parquet(spark, d, "customer").select(
        "c_custkey", collections.localized(term).alias("localized"),
        collections.localized(listed, shape="list").alias("localized_list"),
        shown(collections.drop_null_entries(entries)).alias("no_nulls"), shown(merged).alias("merged"))


@query("fn_json", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
  '{"id":' || event_id || ',"type":"' || event_type || '"}' AS as_json, event_type <> 'error' AS parses,
  json_extract_string(props, '$.k') AS token, CASE WHEN event_type = 'error' THEN 'not json' ELSE props END AS kept
FROM events""")
def fn_json(spark: SparkSession, d: str) -> DataFrame:
    body = F.when(F.col("event_type") == "error", F.lit("not json")).otherwise(F.col("props"))
    events = tables.parquet(spark, d, "events").withColumn("body", body)
    return events.select(
        "event_id", F.variant_get(F.parse_json("props"), "$.k", "int").alias("k"),
        F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("as_json"),
        F.try_parse_json("body").isNotNull().alias("parses"), F.json_tuple("props", "k").alias("token"),
        F.col("body").alias("kept"))


@query("fn_binary", """
SELECT doc_id, to_base64(encode(text)) AS encoded, md5(text) AS round_trip_md5, md5(text) AS digest, '' AS empty_digest,
  octet_length(encode(text)) AS bytes, CASE WHEN octet_length(encode(text)) < 3 THEN NULL ELSE
    CASE lang WHEN 'en' THEN 'image/jpeg' WHEN 'fr' THEN 'image/png' WHEN 'de' THEN 'application/pdf'
    ELSE 'application/octet-stream' END END AS content_type, CAST(NULL AS VARCHAR) AS bad FROM documents""")
def fn_binary(spark: SparkSession, d: str) -> DataFrame:
    data = F.encode("text", "UTF-8")
    encoded = binary.encode_base64(F.col("text"))
    magic = F.create_map(*[F.lit(x) for x in ("en", "FFD8", "fr", "8950", "de", "2550")])
    head = F.unhex(F.coalesce(F.try_element_at(magic, F.col("lang")), F.lit("0000")))
    decoded = binary.decode_base64(F.replace(encoded, F.lit("\r\n"), F.lit("")))
    return tables.parquet(spark, d, "documents").select(
        "doc_id", F.regexp_replace(encoded, "\\s", "").alias("encoded"), F.md5(decoded).alias("round_trip_md5"),
        binary.digest(data).alias("digest"), binary.digest(F.lit(b"")).alias("empty_digest"),
        F.octet_length(data).cast("bigint").alias("bytes"),
        binary.content_type(F.concat(head, data)).alias("content_type"),
        binary.decode_base64(F.lit("%%%")).cast("string").alias("bad"))


@query("extract_meta", r"""
SELECT item, data_type, length(t) AS data_length, regexp_full_match(t, '[A-Za-z0-9+/=]+') AND length(t) % 4 = 0 AS is_base64,
  length(t) > 500 AS truncated, CASE WHEN length(t) > 500 THEN left(t, 500) || '...(truncated)' ELSE t END AS shown
FROM (SELECT 'd' || doc_id AS item, 'string' AS data_type, text AS t FROM documents
      UNION ALL SELECT 'c' || c_custkey, 'bigint', CAST(c_custkey AS VARCHAR) FROM customer)""")
def extract_meta(spark: SparkSession, d: str) -> DataFrame:
    def probe(df: DataFrame, item, value: str) -> DataFrame:
        shown = F.col(value).cast("string")
        return df.select(item.alias("item"), F.typeof(value).alias("data_type"),
                         F.length(shown).cast("bigint").alias("data_length"), binary.looks_base64(shown).alias("is_base64"),
                         (F.length(shown) > 500).alias("truncated"),
                         text.truncate(shown, 500, "...(truncated)").alias("shown"))

    documents = probe(tables.parquet(spark, d, "documents"), F.concat(F.lit("d"), F.col("doc_id")), "text")
    return documents.unionByName(probe(tables.parquet(spark, d, "customer"), F.concat(F.lit("c"), F.col("c_custkey")), "c_custkey"))
