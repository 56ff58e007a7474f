"""JSON paths, nested extraction, key/value rows, files, XML and manifests."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import files, json_ops, xml_doc
from millrace.plans.catalogue import query
from millrace.sources import tables

CLOCK = dt.datetime(2025, 6, 1, 12, 0, 0)


@query("json_path", """
SELECT event_id, json_extract_string(props, '$.k') AS k,
  CASE WHEN event_type <> 'error' THEN event_type END AS inner_type, CAST(NULL AS VARCHAR) AS missing,
  CAST(NULL AS VARCHAR) AS through_list FROM events""")
def json_path(spark: SparkSession, d: str) -> DataFrame:
    events = tables.parquet(spark, d, "events")
    nested = F.to_json(F.struct(F.struct(F.col("event_type").alias("type"), F.array(F.lit(1)).alias("list")).alias("a")))
    body = F.when(F.col("event_type") == "error", F.lit('{"a": {"type": ')).otherwise(nested)
    return events.withColumn("body", body).select(
        "event_id", json_ops.json_path(F.col("props"), "k").alias("k"),
        json_ops.json_path(F.col("body"), "a.type").alias("inner_type"),
        json_ops.json_path(F.col("body"), "a.nothing.type").alias("missing"),
        json_ops.json_path(F.col("body"), "a.list.type").alias("through_list"))


@query("nested_extract", """
SELECT event_id, 0 AS pos, CAST(event_id AS VARCHAR) AS item_id, event_type AS item_name, '' AS item_type
FROM events WHERE event_type <> 'error'
UNION ALL SELECT event_id, 1, '2', '', 'x' FROM events WHERE event_type IN ('click', 'view')""")
def nested_extract(spark: SparkSession, d: str) -> DataFrame:
    events = tables.parquet(spark, d, "events")
    one = F.format_string('{"id": %s, "name": "%s", "type": null}', "event_id", "event_type")
    many = F.concat(F.lit('{"data": {"records": ['), one, F.lit(', {"id": 2, "type": "x"}, 3]}}'))
    single = F.concat(F.lit('{"data": {"records": '), one, F.lit("}}"))
    body = F.when(F.col("event_type").isin("click", "view"), many).when(
        F.col("event_type") == "error", F.lit('{"data": [1]}')).otherwise(single)
    return json_ops.nested_extract(events.withColumn("body", body), "body", "data.records",
                                   [("id", "item_id"), ("name", "item_name"), ("type", "item_type")], ["event_id"])


@query("json_to_kv", """
SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events WHERE event_type <> 'error'
UNION ALL SELECT event_id, 'a.b[0].c', event_type FROM events WHERE event_type <> 'error'
UNION ALL SELECT event_id, 'a.b[1]', '' FROM events WHERE event_type <> 'error'
UNION ALL SELECT event_id, 'a.b[2][0]', 'true' FROM events WHERE event_type <> 'error'
UNION ALL SELECT event_id, 'a.s', '}{' FROM events WHERE event_type <> 'error'""")
def json_to_kv(spark: SparkSession, d: str) -> DataFrame:
    events = tables.spread(tables.parquet(spark, d, "events"))
    full = F.format_string('{"k": %s, "a": {"b": [{"c": "%s"}, null, [true]], "s": "}{", "e": {}}}',
                           F.get_json_object("props", "$.k"), "event_type")
    body = F.when(F.col("event_type") == "error", F.lit('{"k": ')).otherwise(full)
    return json_ops.json_to_kv(events.withColumn("body", body), "body", ["event_id"])


@query("json_to_kv_deep", """
SELECT event_id, repeat('a.', CAST(event_id % 40 AS INTEGER)) || 'a' AS key, CAST(event_id AS VARCHAR) AS value FROM events
UNION ALL SELECT event_id, repeat('a.', CAST(event_id % 40 AS INTEGER)) || 'z[1]', event_type FROM events""")
def json_to_kv_deep(spark: SparkSession, d: str) -> DataFrame:
    """Documents of 1 to 40 levels, mixed by row: a level is opened only for the rows that have it."""
    depth = F.expr("int(event_id % 40)")
    inner = F.format_string('{"a": %s, "z": [{}, "%s"]}', F.col("event_id").cast("string"), "event_type")
    body = F.concat(F.repeat(F.lit('{"a": '), depth), inner, F.repeat(F.lit("}"), depth))
    return json_ops.json_to_kv(tables.parquet(spark, d, "events").withColumn("body", body), "body", ["event_id"])


def page_files(spark: SparkSession, d: str) -> DataFrame:
    """Pages with their files given in one of four ways, by language of the page."""
    pages = tables.parquet(spark, d, "pages").withColumn("lang", F.regexp_extract("html", 'lang="([a-z]+)"', 1))
    lang = F.col("lang")
    number = F.col("page_id").cast("string")
    listed = F.format_string('[{"path": "/in/%s.ofd"}, {"name": "no place"}, {"content": "aGk=", "name": "hi.txt"}]', number)
    documents = F.format_string(
        '[{"mimeType": "application/pdf", "downloadUrl": "http://x/%s.pdf?v=1"}, {"mimeType": "text/plain", '
        '"downloadUrl": "http://x/a.pdf"}, {"downloadUrl": "http://x/b.PDF", "fileName": "b"}, '
        '{"mimeType": "application/pdf", "downloadUrl": "http://x/c", "fileName": "changehistory.pdf"}]', number)
    return pages.select(
        "page_id", "lang", "url",
        F.when(lang == "en", listed).alias("pdf_files"),
        F.when(lang == "fr", documents).otherwise(F.lit("broken [")).alias("documents"),
        F.when(lang == "de", F.concat(F.lit("/local/"), number, F.lit(".doc"))).alias("pdf_path"),
        F.concat(F.lit("a.pdf, , dir/"), number, F.lit(".docx")).alias("path_list"))


def resolved_files(df: DataFrame) -> DataFrame:
    null = F.lit(None).cast("string")
    found = files.resolve_files(
        files.listed_files(F.col("pdf_files")), files.document_files(F.col("documents")),
        files.single_file(F.col("pdf_path"), null, null), files.comma_list_files(F.col("path_list")))
    return df.withColumn("files", found)


@query("resolve_files", """
SELECT page_id, CASE regexp_extract(html, 'lang="([a-z]+)"', 1)
  WHEN 'en' THEN page_id || '.ofd:ofd|hi.txt:pdf'
  WHEN 'fr' THEN page_id || '.pdf:pdf|b:pdf'
  WHEN 'de' THEN page_id || '.doc:doc'
  ELSE 'a.pdf:pdf|' || page_id || '.docx:docx' END AS files FROM pages""")
def resolve_files(spark: SparkSession, d: str) -> DataFrame:
    shown = F.transform("files", lambda f: F.concat(f["name"], F.lit(":"), f["format"]))
    return resolved_files(page_files(spark, d)).select("page_id", F.array_join(shown, "|").alias("files"))


@query("resolve_identifier", """
SELECT doc_id, CASE WHEN lang = 'en' THEN source WHEN lang = 'fr' THEN 'F' || doc_id
  ELSE md5(doc_id || chr(31) || n_chars) END AS identifier FROM documents""")
def resolve_identifier(spark: SparkSession, d: str) -> DataFrame:
    documents = tables.parquet(spark, d, "documents")
    configured = F.when(F.col("lang") == "en", F.col("source")).otherwise(F.lit(""))
    default = F.when(F.col("lang") == "fr", F.concat(F.lit("F"), F.col("doc_id").cast("string")))
    found = files.identifier([configured, default], [F.col("doc_id"), F.col("n_chars")])
    return documents.select("doc_id", found.alias("identifier"))


XML_FIELDS = xml_doc.XmlField.from_config([
    {"tag": "title", "source": "title"},
    {"tag": "class", "source": "", "default": "{year}-{c2}"},
    {"tag": "owner", "source": "owner", "default": "{c_name} of {c_mktsegment}"},
    {"tag": "none", "source": "absent", "default": ""},
    {"source": "no tag"},
])


def archive_rows(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their customer as archive records with two digital objects each."""
    orders = tables.spread(tables.parquet(spark, d, "orders"))
    customers = tables.parquet(spark, d, "customer")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    key = F.col("o_orderkey").cast("string")
    objects = F.array(*[F.struct(F.concat(F.lit(prefix), key, F.lit(suffix)).alias("name"), F.lit(None).cast("string").alias("url"),
                                 F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("content"),
                                 F.lit(fmt).alias("format"))
                        for prefix, suffix, fmt in (("main", ".pdf", "pdf"), ("note", ".ofd", "ofd"))])
    content = F.array(F.encode("c_name", "UTF-8"), F.lit(None).cast("binary"))
    return joined.select(
        "o_orderkey", "c_name", "c_mktsegment", "o_orderstatus",
        F.concat(F.lit("Order <b>"), key, F.lit("</b> & H<sub>2</sub>O > "), F.col("c_mktsegment")).alias("title"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).otherwise(F.lit("")).alias("owner"),
        F.date_format("o_orderdate", "yyyyMMdd").alias("时间"),
        F.when(F.col("o_orderstatus") == "P", F.lit("P1")).alias("二级目录"),
        F.lit("Spark").alias("软件环境"),
        F.when(F.col("o_orderstatus") != "O", files.with_content(objects, content)
               ).otherwise(F.array().cast("array<struct<name:string,format:string,size:bigint,md5:string>>")
                           ).alias("files"))


_XML = r"""
'<?xml version="1.0" encoding="UTF-8"?>' || nl || '<电子档案元数据>' || nl
  || '    <title>Order ' || o_orderkey || ' &amp; H₂O &gt; ' || c_mktsegment || '</title>' || nl
  || '    <class>' || year(o_orderdate) || '-' || cat || '</class>' || nl
  || '    <owner>' || CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE c_name || ' of ' || c_mktsegment END || '</owner>' || nl
  || '    <none/>' || nl || '    <环境信息>' || nl || '        <软件环境>Spark</软件环境>' || nl || '        <硬件环境/>' || nl || '    </环境信息>'
  || CASE WHEN o_orderstatus = 'O' THEN '' ELSE nl || '    <数字对象>' || nl || '        <数字对象标识>文档1</数字对象标识>' || nl
  || '        <格式信息>pdf</格式信息>' || nl || '        <计算机文件名>main' || o_orderkey || '.pdf</计算机文件名>' || nl
  || '        <计算机文件大小>' || length(c_name) || '</计算机文件大小>' || nl || '        <数字摘要>' || md5(c_name) || '</数字摘要>' || nl
  || '    </数字对象>' || nl || '    <数字对象>' || nl || '        <数字对象标识>文档2</数字对象标识>' || nl
  || '        <格式信息>ofd</格式信息>' || nl || '        <计算机文件名>note' || o_orderkey || '.ofd</计算机文件名>' || nl
  || '        <计算机文件大小>0</计算机文件大小>' || nl || '        <数字摘要/>' || nl || '    </数字对象>' END || nl || '</电子档案元数据>' || nl"""
_XML_ROWS = """(SELECT *, chr(10) AS nl, CASE WHEN o_orderstatus = 'P' THEN 'P1' ELSE 'JX16' END AS cat
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


@query("metadata_xml", f"SELECT o_orderkey, {_XML} AS xml FROM {_XML_ROWS}")
def metadata_xml(spark: SparkSession, d: str) -> DataFrame:
    rows = archive_rows(spark, d)
    return rows.select("o_orderkey", xml_doc.metadata_xml(rows, F.col("files"), CLOCK, XML_FIELDS).alias("xml"))


@query("archive_manifest", f"""
WITH numbered AS (SELECT *, row_number() OVER (PARTITION BY year(o_orderdate), cat ORDER BY o_orderkey) AS n FROM {_XML_ROWS})
SELECT CAST(o_orderkey AS VARCHAR) AS id, year(o_orderdate) || '-' || cat AS entity_class, CAST(n AS VARCHAR) AS case_no,
  CASE WHEN o_orderstatus <> 'O' THEN md5({_XML}) END AS xml_md5,
  CASE WHEN o_orderstatus <> 'O' THEN 'main' || o_orderkey || '.pdf:' || length(c_name) || ':' || md5(c_name) || '|note' || o_orderkey || '.ofd:0:' ELSE '' END AS files,
  o_orderstatus <> 'O' AS ok, CASE WHEN o_orderstatus = 'O' THEN 'no files' END AS error
FROM numbered""")
def archive_manifest(spark: SparkSession, d: str) -> DataFrame:
    from millrace.operators.numbering import case_numbers
    from millrace.workspace import materialise

    rows = archive_rows(spark, d)
    classed = rows.withColumn("entity_class", xml_doc.entity_class(rows, CLOCK.date()))
    numbered = case_numbers(classed, "entity_class", ["o_orderkey"])
    xml = xml_doc.metadata_xml(numbered, F.col("files"), CLOCK, XML_FIELDS)
    manifest = xml_doc.archive_manifest(numbered, F.col("o_orderkey").cast("string"), F.col("files"),
                                        F.col("entity_class"), F.col("case_no"), xml)
    stored = materialise(manifest, "manifest")
    shown = F.transform("files", lambda f: F.concat_ws(":", f["name"], f["size"].cast("string"), f["md5"]))
    return stored.select("id", "entity_class", "case_no", F.md5("metadata_xml").alias("xml_md5"),
                         F.array_join(shown, "|").alias("files"), "ok", "error")


@query("metadata_xml_default", r"""
SELECT o_orderkey, length(c_name) > 0 AS named, 31 + 3 AS lines,
  '    <一级目录>' || year(o_orderdate) || '</一级目录>' AS first_line,
  '    <页数>1</页数>' AS page_line FROM orders JOIN customer ON o_custkey = c_custkey""")
def metadata_xml_default(spark: SparkSession, d: str) -> DataFrame:
    """The built-in field list: one line per field, then the environment block."""
    orders = tables.spread(tables.parquet(spark, d, "orders"))
    joined = orders.join(tables.parquet(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = joined.select("o_orderkey", F.col("c_name").alias("author"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("submissionDate"),
                         F.lit("1").alias("pdf_count"))
    none = F.array().cast("array<struct<name:string,format:string,size:bigint,md5:string>>")
    xml = xml_doc.metadata_xml(rows, none, CLOCK, institution="Example")
    # Step by step, so that the document is rendered and split once, not for each measure.
    split = rows.select("o_orderkey", "author", F.split(xml, "\n").alias("all"))
    named = F.array_contains("all", F.concat(F.lit("    <第一责任者>"), F.col("author"), F.lit("</第一责任者>")))
    inner = split.select("o_orderkey", named.alias("named"), F.filter("all", lambda x: x.startswith("    ")).alias("inner"))
    return inner.select(
        "o_orderkey", "named", (F.size("inner") - 1).alias("lines"), F.get("inner", F.lit(0)).alias("first_line"),
        F.get(F.filter("inner", lambda x: x.contains("页数")), F.lit(0)).alias("page_line"))
