"""Filters, rules and text cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import validate
from millrace.plans.catalogue import query
from millrace.plans.shaping import enrich_orders, order_records
from millrace.sources import tables


@query("filter_in", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def filter_in(spark: SparkSession, d: str) -> DataFrame:
    return tables.parquet(spark, d, "orders").where(
        F.col("o_orderpriority").cast("string").isin("1-URGENT", "2-HIGH")).select("o_orderkey", "o_orderpriority")


@query("filter_status", "SELECT 'u-' || o_orderkey AS uuid FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT'")
def filter_status(spark: SparkSession, d: str) -> DataFrame:
    records = order_records(tables.parquet(spark, d, "orders"), tables.parquet(spark, d, "customer"))
    return records.where(F.col("workflow.step") == "approved").select("uuid")


@query("filter_year", "SELECT o_orderkey, year(o_orderdate) AS y FROM orders WHERE year(o_orderdate) BETWEEN 0 AND 1997")
def filter_year(spark: SparkSession, d: str) -> DataFrame:
    low, high = validate.year_bounds(run_year=1998, any_synced=True, first_load_year=2025)
    orders = tables.parquet(spark, d, "orders").withColumn("day", F.date_format("o_orderdate", "yyyyMMdd"))
    return validate.year_window(orders, "day", low, high).select(
        "o_orderkey", F.year("o_orderdate").cast("bigint").alias("y"))


@query("search_contains", "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ring')")
def search_contains(spark: SparkSession, d: str) -> DataFrame:
    return tables.parquet(spark, d, "part").where(F.col("p_name").contains("ring")).select("p_partkey", "p_name")


@query("drop_empty", "SELECT o_custkey AS a, CASE WHEN o_orderstatus = 'F' THEN o_orderstatus END AS b FROM orders WHERE o_orderstatus <> 'O' AND (o_orderstatus = 'F' OR o_custkey IS NOT NULL)")
def drop_empty(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.parquet(spark, d, "orders").select(
        F.when(F.col("o_orderstatus") != "O", F.col("o_custkey")).alias("a"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderstatus")).alias("b"))
    return validate.drop_empty(rows)


@query("case_branch", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'closed' WHEN o_totalprice > 200000 THEN 'large' ELSE o_orderstatus END AS branch FROM orders")
def case_branch(spark: SparkSession, d: str) -> DataFrame:
    branch = F.when(F.col("o_orderstatus") == "F", "closed").when(F.col("o_totalprice") > 200000, "large"
                                                                  ).otherwise(F.col("o_orderstatus"))
    return tables.parquet(spark, d, "orders").select("o_orderkey", branch.alias("branch"))


@query("enrich_filter", """
SELECT count(*) AS total, count(*) FILTER (WHERE c_custkey IS NULL) AS skipped,
  count(*) FILTER (WHERE c_custkey IS NOT NULL) AS kept
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) c ON o_custkey = c_custkey""")
def enrich_filter(spark: SparkSession, d: str) -> DataFrame:
    enriched = enrich_orders(tables.parquet(spark, d, "orders"),
                             tables.parquet(spark, d, "customer").where("c_acctbal >= 0"),
                             tables.parquet(spark, d, "nation"))
    return enriched.agg(F.count(F.lit(1)).alias("total"), F.count_if("enrich_failed").alias("skipped"),
                        F.count_if(~F.col("enrich_failed")).alias("kept"))


@query("array_filter", r"""
SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: x <> '' AND NOT contains(x, 'the')), chr(10)) AS kept
FROM documents""")
def array_filter(spark: SparkSession, d: str) -> DataFrame:
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda x: (x != "") & ~x.contains("the"))
    return tables.parquet(spark, d, "documents").select("doc_id", F.array_join(kept, "\n").alias("kept"))


@query("validate_required", """
SELECT doc_id, CASE WHEN lang = 'de' THEN 'required:source' ELSE '' END AS errors FROM documents""")
def validate_required(spark: SparkSession, d: str) -> DataFrame:
    documents = tables.parquet(spark, d, "documents").withColumn(
        "source", F.when(F.col("lang") != "de", F.col("source")).otherwise(F.lit("")))
    checked = validate.apply_rules(documents, [validate.required("text"), validate.required("source")])
    return checked.select("doc_id", F.array_join("errors", ",").alias("errors"))


@query("validate_type", """
SELECT event_id, CASE WHEN event_type = 'error' THEN 'numeric:k' ELSE '' END AS errors FROM events""")
def validate_type(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    events = tables.parquet(spark, d, "events").withColumn(
        "k", F.when(F.col("event_type") == "error", F.concat(k, F.lit("x"))).otherwise(k))
    return validate.apply_rules(events, [validate.numeric("k")]).select(
        "event_id", F.array_join("errors", ",").alias("errors"))


@query("validate_format", """
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'email:mail' ELSE '' END AS errors FROM customer""")
def validate_format(spark: SparkSession, d: str) -> DataFrame:
    at = F.when(F.col("c_acctbal") < 0, F.lit(" at ")).otherwise(F.lit("@"))
    customers = tables.parquet(spark, d, "customer").withColumn(
        "mail", F.concat(F.lit("c"), F.col("c_custkey").cast("string"), at, F.lit("shop.example")))
    rule = validate.matches("mail", validate.EMAIL, "email")
    return validate.apply_rules(customers, [rule]).select("c_custkey", F.array_join("errors", ",").alias("errors"))


@query("strip_html", """
SELECT page_id, length(t) AS n, md5(t) AS md5 FROM (
  SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS t FROM pages)""")
def strip_html(spark: SparkSession, d: str) -> DataFrame:
    pages = tables.parquet(spark, d, "pages").select("page_id", text.strip_tags(F.col("html")).alias("t"))
    return pages.select("page_id", F.length("t").cast("bigint").alias("n"), F.md5("t").alias("md5"))


@query("sub_sup", """
SELECT p_partkey, 'H' || translate(CAST(p_size AS VARCHAR), '0123456789', '₀₁₂₃₄₅₆₇₈₉') || 'O '
  || p_name || 'n' || '⁻' || translate(CAST(p_size AS VARCHAR), '0123456789', '⁰¹²³⁴⁵⁶⁷⁸⁹') || '⁺ open' AS label
FROM part""")
def sub_sup(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    raw = F.concat(F.lit("H<sub>"), size, F.lit("</sub>O <b>"), F.col("p_name"), F.lit("</b>n<sup>–"), size,
                   F.lit("+</sup> <sub>open"))
    return tables.parquet(spark, d, "part").select("p_partkey", text.clean_markup(raw).alias("label"))


@query("sanitize_name", r"""
SELECT page_id, regexp_replace(url, '[\\/:*?"<>|]', '_', 'g') AS name FROM pages""")
def sanitize_name(spark: SparkSession, d: str) -> DataFrame:
    return tables.parquet(spark, d, "pages").select("page_id", text.safe_file_name(F.col("url")).alias("name"))


@query("quarantine_split", """
SELECT 'good' AS part, doc_id, '' AS errors FROM documents WHERE n_chars >= 500 AND lang <> 'de'
UNION ALL SELECT 'bad', doc_id, concat_ws(',', CASE WHEN n_chars < 500 THEN 'too short' END,
  CASE WHEN lang = 'de' THEN 'language' END) FROM documents WHERE n_chars < 500 OR lang = 'de'""")
def quarantine_split(spark: SparkSession, d: str) -> DataFrame:
    from millrace.operators.sinks import quarantine
    from millrace.workspace import scratch

    good, bad = quarantine(document_errors(spark, d), scratch(spark, "quarantine"))
    good = good.select(F.lit("good").alias("part"), "doc_id", F.lit("").alias("errors"))
    return good.unionByName(bad.select(F.lit("bad").alias("part"), "doc_id",
                                       F.array_join("errors", ",").alias("errors")))


def document_errors(spark: SparkSession, d: str) -> DataFrame:
    rules = [validate.check("too short", F.col("n_chars") < 500), validate.check("language", F.col("lang") == "de")]
    return validate.apply_rules(tables.parquet(spark, d, "documents"), rules)


@query("error_summary", """
SELECT 'too short' AS reason, count(*) AS rows, min(doc_id) AS first_key, max(doc_id) AS last_key
FROM documents WHERE n_chars < 500
UNION ALL SELECT 'language', count(*), min(doc_id), max(doc_id) FROM documents WHERE lang = 'de'""")
def error_summary(spark: SparkSession, d: str) -> DataFrame:
    return validate.error_summary(validate.split_good_bad(document_errors(spark, d))[1], "doc_id")


@query("classify_rules", """
SELECT p_partkey, CASE WHEN contains(p_type, 'ECO') THEN 'cheap' WHEN contains(p_type, 'PRO') THEN 'offer'
  WHEN contains(p_type, 'M') THEN 'middle' ELSE '' END AS class FROM part""")
def classify_rules(spark: SparkSession, d: str) -> DataFrame:
    rules = [("ECO", "cheap"), ("PRO", "offer"), ("M", "middle")]
    return tables.parquet(spark, d, "part").select("p_partkey", text.classify(F.col("p_type"), rules).alias("class"))
