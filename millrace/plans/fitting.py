"""Operators the requirements text names: value maps, aggregation and split templates, schema fit."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import mapping, parsing, schema_fit, validate
from millrace.plans.catalogue import query
from millrace.sources import tables
from millrace.state import retained


@query("value_map", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS status FROM orders""")
def value_map(spark: SparkSession, d: str) -> DataFrame:
    return tables.parquet(spark, d, "orders").select(
        "o_orderkey", mapping.value_map(F.col("o_orderstatus"), {"F": "closed", "O": "open"}).alias("status"))


@query("aggregate_template", """
SELECT l_returnflag, l_linestatus, count(*) AS lines, CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS quantity,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2)))) AS DOUBLE) AS revenue
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def aggregate_template(spark: SparkSession, d: str) -> DataFrame:
    revenue = F.col("l_extendedprice").cast("decimal(18,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))
    return tables.parquet(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"),
        F.sum(revenue).cast("double").alias("revenue"))


@query("split_rows", """
SELECT doc_id, unnest(range(len(string_split(text, '. ')))) AS pos, unnest(string_split(text, '. ')) AS sentence FROM documents""")
def split_rows(spark: SparkSession, d: str) -> DataFrame:
    return schema_fit.split_rows(tables.parquet(spark, d, "documents"), "text", r"\. ", ["doc_id"], "sentence")


@query("schema_fit", """
SELECT CAST(event_id AS VARCHAR) AS event_id, left(event_type, 5) AS event_type, TRY_CAST(CASE WHEN event_type = 'error' THEN 'x' ELSE '7' END AS BIGINT) AS code,
  CAST(NULL AS VARCHAR) AS added, concat_ws(',', CASE WHEN length(event_type) > 5 THEN 'length:event_type' END,
    CASE WHEN event_type = 'error' THEN 'type:code' END) AS errors FROM events""")
def schema_fit_query(spark: SparkSession, d: str) -> DataFrame:
    target = T.StructType.fromDDL("event_id string, event_type string, code bigint, added string")
    events = tables.parquet(spark, d, "events").withColumn(
        "code", F.when(F.col("event_type") == "error", F.lit("x")).otherwise(F.lit("7")))
    fitted = schema_fit.fit_schema(events, target, {"event_type": 5})
    return fitted.withColumn("errors", F.array_join("errors", ","))


@query("parse_csv_column", """
SELECT o_orderkey, o_custkey AS customer, o_orderstatus AS status, 'a,b' AS note FROM orders""")
def parse_csv_column(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat_ws(",", F.col("o_custkey").cast("string"), "o_orderstatus", F.lit('"a,b"'))
    orders = tables.parquet(spark, d, "orders").withColumn("line", line)
    return parsing.csv_columns(orders, "line", "customer bigint, status string, note string", ["o_orderkey"])


@query("parse_xml_column", """
SELECT c_custkey, c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer""")
def parse_xml_column(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat(F.lit("<r><id>"), F.col("c_custkey"), F.lit("</id><name>"), F.col("c_name"), F.lit("</name><segment>"),
                    F.col("c_mktsegment"), F.lit("</segment></r>"))
    customers = tables.parquet(spark, d, "customer").withColumn("body", body)
    return parsing.xml_columns(customers, "body", "id bigint, name string, segment string", ["c_custkey"])


@query("parse_html_list", """
SELECT page_id, count(*) AS links, md5(string_agg(href, ' ' ORDER BY i)) AS hrefs_md5 FROM (
  SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">', 1)) AS href,
    unnest(range(len(regexp_extract_all(html, '<li><a href="([^"]*)">', 1)))) AS i FROM pages) GROUP BY page_id""")
def parse_html_list(spark: SparkSession, d: str) -> DataFrame:
    links = F.regexp_extract_all("html", F.lit('<li><a href="([^"]*)">'), F.lit(1))
    found = tables.parquet(spark, d, "pages").select("page_id", links.alias("links")).where(F.size("links") > 0)
    return found.select("page_id", F.size("links").cast("bigint").alias("links"),
                        F.md5(F.array_join("links", " ")).alias("hrefs_md5"))


@query("runlog_retention", """
SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00'
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, CAST(event_id AS VARCHAR) DESC) <= 5""")
def runlog_retention(spark: SparkSession, d: str) -> DataFrame:
    """Events stand for runs and users for flows: the last ten days, five runs per flow."""
    runs = tables.parquet(spark, d, "events").select(
        F.col("event_id").cast("string").alias("run_id"), F.col("user_id").alias("flow_id"), F.col("ts").alias("start_time"))
    kept = retained(runs, dt.datetime(2024, 1, 30), 10, 5)
    return kept.select(F.col("run_id").cast("bigint").alias("event_id"), F.col("flow_id").alias("user_id"))


@query("aggregate_spec", """
SELECT l_returnflag, count(*) AS lines, count(*) FILTER (WHERE l_quantity > 25) AS large, count(DISTINCT l_suppkey) AS suppliers,
  max(l_shipdate) AS latest FROM lineitem GROUP BY l_returnflag HAVING count(*) > 10""")
def aggregate_spec(spark: SparkSession, d: str) -> DataFrame:
    """An aggregation template as configuration."""
    template = {"groupBy": ["l_returnflag"], "having": "lines > 10", "measures": [
        {"as": "lines", "fn": "count"}, {"as": "large", "fn": "count", "where": "l_quantity > 25"},
        {"as": "suppliers", "fn": "count_distinct", "of": "l_suppkey"}, {"as": "latest", "fn": "max", "of": "l_shipdate"}]}
    return parsing.aggregate(tables.parquet(spark, d, "lineitem"), template)


@query("csv_lines", """
SELECT o_orderkey, 0 AS pos, o_custkey AS customer, o_orderstatus AS note FROM orders
UNION ALL SELECT o_orderkey, 1, NULL, 'a,b' FROM orders""")
def csv_lines(spark: SparkSession, d: str) -> DataFrame:
    """A CSV text with a header and two records in each row."""
    text = F.concat(F.lit("customer,note\n"), F.col("o_custkey"), F.lit(","), F.col("o_orderstatus"), F.lit('\r\n\nnone,"a,b"\n'))
    orders = tables.parquet(spark, d, "orders").withColumn("body", text)
    return parsing.csv_lines(orders, "body", "customer bigint, note string", ["o_orderkey"], header=True)


@query("html_table_rows", """
SELECT c_custkey, 0 AS table_no, 0 AS row_no, 'name|balance' AS names, c_name || '|' || CAST(c_nationkey AS VARCHAR) AS cells FROM customer
UNION ALL SELECT c_custkey, 0, 1, 'name|balance', 'a & b|' FROM customer""")
def html_table_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a table inside an HTML text."""
    page = F.concat(F.lit('<p>x</p><TABLE class="t"><tr><th>name</th><th>balance</th></tr>\n<tr><td><b>'), F.col("c_name"), F.lit("</b></td><td>"),
                    F.col("c_nationkey"), F.lit("</td></tr><tr><td>a &amp; b</td><td></td></tr></TABLE><table></table>"))
    found = parsing.html_tables(tables.parquet(spark, d, "customer").withColumn("page", page), "page", ["c_custkey"])
    return found.select("c_custkey", "table_no", "row_no", F.array_join("names", "|").alias("names"), F.array_join("cells", "|").alias("cells"))


@query("error_items", """
SELECT reason, page, list(o_orderkey ORDER BY n) AS items FROM (
  SELECT *, (row_number() OVER (PARTITION BY reason ORDER BY o_orderkey) - 1) // 100 AS page, row_number() OVER (PARTITION BY reason ORDER BY o_orderkey) AS n
  FROM (SELECT 'large' AS reason, o_orderkey FROM orders WHERE o_totalprice > 200000
        UNION ALL SELECT 'failed', o_orderkey FROM orders WHERE o_orderstatus = 'F')) GROUP BY reason, page""")
def error_items(spark: SparkSession, d: str) -> DataFrame:
    """The failing keys of each reason, in lists of at most 100."""
    reasons = F.array_compact(F.array(F.when(F.col("o_totalprice") > 200000, F.lit("large")), F.when(F.col("o_orderstatus") == "F", F.lit("failed"))))
    bad = tables.parquet(spark, d, "orders").withColumn(validate.ERRORS, reasons).where(F.size(validate.ERRORS) > 0)
    return validate.error_items(bad, "o_orderkey", 100)
