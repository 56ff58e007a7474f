"""Lookups and other joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import flatten
from millrace.operators.lookup import lookup, lookup_many, primary_or_all
from millrace.plans.catalogue import query
from millrace.plans.shaping import enrich_orders, order_records
from millrace.sources import tables


@query("lookup_left", """
SELECT o_orderkey, coalesce(c_name, '') AS customer, coalesce(n_name, '') AS nation
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) c ON o_custkey = c_custkey
LEFT JOIN nation ON c_nationkey = n_nationkey""")
def lookup_left(spark: SparkSession, d: str) -> DataFrame:
    enriched = enrich_orders(tables.parquet(spark, d, "orders"),
                             tables.parquet(spark, d, "customer").where("c_acctbal >= 0"),
                             tables.parquet(spark, d, "nation"))
    blank = F.lit("")
    return enriched.select("o_orderkey", F.coalesce("customer", blank).alias("customer"),
                           F.coalesce("nation", blank).alias("nation"))


@query("enrich_flag", """
SELECT o_orderkey, c_custkey IS NOT NULL AS has_customer, n_nationkey IS NOT NULL AS has_nation,
  c_custkey IS NULL OR n_nationkey IS NULL AS enrich_failed
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) c ON o_custkey = c_custkey
LEFT JOIN nation ON c_nationkey = n_nationkey""")
def enrich_flag(spark: SparkSession, d: str) -> DataFrame:
    enriched = enrich_orders(tables.parquet(spark, d, "orders"),
                             tables.parquet(spark, d, "customer").where("c_acctbal >= 0"),
                             tables.parquet(spark, d, "nation"))
    return enriched.select("o_orderkey", "has_customer", "has_nation", "enrich_failed")


@query("lookup_first", """
SELECT c_custkey, o_orderkey AS first_order, o_orderdate AS first_date FROM customer LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) o
ON c_custkey = o_custkey AND rn = 1""")
def lookup_first(spark: SparkSession, d: str) -> DataFrame:
    found = lookup(tables.parquet(spark, d, "customer"), tables.parquet(spark, d, "orders"), "c_custkey", "o_custkey",
                   {"o_orderkey": "first_order", "o_orderdate": "first_date"},
                   first_by=[F.asc("o_orderdate"), F.asc("o_orderkey")])
    return found.select("c_custkey", "first_order", "first_date")


@query("lookup_multi", """
WITH links AS (
  SELECT event_id, user_id % 25 AS a, CAST(json_extract_string(props, '$.k') AS BIGINT) AS b, event_id % 25 AS c, event_type
  FROM events),
ids AS (
  SELECT event_id, CASE WHEN event_type = 'click' THEN [a, b] ELSE [a, b, c] END AS ids FROM links),
slots AS (
  SELECT event_id, unnest(ids) AS id, unnest(range(1, len(ids) + 1)) AS pos FROM ids),
firsts AS (SELECT event_id, id, min(pos) AS pos FROM slots GROUP BY event_id, id)
SELECT e.event_id, coalesce(string_agg(n_name, ', ' ORDER BY pos) FILTER (WHERE n_name IS NOT NULL), '') AS nations
FROM events e LEFT JOIN firsts f ON e.event_id = f.event_id
LEFT JOIN nation ON id = n_nationkey AND n_regionkey <> 0
GROUP BY e.event_id""")
def lookup_multi(spark: SparkSession, d: str) -> DataFrame:
    """Three links per event, two of them primary for clicks; some ids are held out of the lookup."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    click = F.col("event_type") == "click"

    def link(value, primary):
        return F.struct(value.cast("bigint").alias("id"), primary.alias("primary"))

    links = F.array(link(F.pmod("user_id", F.lit(25)), click), link(k, click),
                    link(F.pmod("event_id", F.lit(25)), F.lit(False)))
    events = tables.parquet(spark, d, "events").select("event_id", links.alias("links"))
    ids = F.transform(primary_or_all(F.col("links"), "primary"), lambda x: x["id"])
    nations = tables.parquet(spark, d, "nation").where("n_regionkey <> 0")
    return lookup_many(events, nations, "event_id", ids, "n_nationkey", F.col("n_name"), "nations",
                       unique=True).select("event_id", "nations")


@query("record_enrich", """
SELECT 'u-' || o_orderkey AS uuid,
  CASE WHEN c_acctbal >= 5000 THEN 'S' || c_custkey WHEN c_acctbal >= 0 THEN 'T' || c_custkey ELSE CAST(c_custkey AS VARCHAR) END AS "authorPersonId",
  CASE WHEN c_acctbal < 0 OR NOT known THEN 'n' || c_nationkey ELSE names END AS "orgUuid",
  CASE WHEN c_acctbal >= 0 THEN '20200131' WHEN o_orderpriority = '1-URGENT' THEN strftime(o_orderdate, '%Y%m%d')
    ELSE year(o_orderdate) || '0101' END AS "submissionDate",
  c_acctbal < 0 OR NOT known AS enrich_failed
FROM orders JOIN (
  SELECT c.*, (a.n_regionkey <> 1 OR (c_acctbal >= 5000 AND b.n_regionkey <> 1)) AS known, concat_ws(', ',
    CASE WHEN a.n_regionkey <> 1 THEN CASE a.n_nationkey WHEN 24 THEN '中' ELSE '' END || a.n_name END,
    CASE WHEN c_acctbal >= 5000 AND b.n_regionkey <> 1 AND b.n_nationkey <> a.n_nationkey THEN '中' || b.n_name END) AS names
  FROM customer c JOIN nation a ON c_nationkey = a.n_nationkey JOIN nation b ON b.n_nationkey = 24) ON o_custkey = c_custkey""")
def record_enrich(spark: SparkSession, d: str) -> DataFrame:
    """Records joined with their first contributor's person, and that person's organisations."""
    customers = tables.parquet(spark, d, "customer")
    rich = F.col("c_acctbal") >= 5000
    key = F.col("c_custkey").cast("string")

    def association(student_id, organisation, primary):
        return F.struct(student_id.alias("affiliationId"), F.struct(organisation.alias("uuid")).alias("organization"),
                        F.struct(F.lit("2016-09-01").alias("startDate"), F.lit("2020-01-31").alias("endDate")).alias("period"),
                        primary.alias("primaryAssociation"))

    own = F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))
    links = F.array(association(F.when(rich, F.concat(F.lit("S"), key)), own, ~rich),
                    association(F.concat(F.lit("T"), key), F.lit("n24"), F.lit(False)))
    persons = customers.where("c_acctbal >= 0").select(key.alias("uuid"), links.alias("studentOrganizationAssociations"))
    zh = F.when(F.col("n_nationkey") == 24, F.concat(F.lit("中"), F.col("n_name"))).otherwise(F.lit(""))
    organisations = tables.parquet(spark, d, "nation").where("n_regionkey <> 1").select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("uuid"),
        F.struct(F.col("n_name").alias("en_GB"), zh.alias("zh_CN")).alias("name"))
    records = order_records(tables.spread(tables.parquet(spark, d, "orders")), customers)
    flat = flatten.flatten_enriched(flatten.enrich_record(records, persons, organisations))
    return flat.select("uuid", "authorPersonId", "orgUuid", "submissionDate", "enrich_failed")


@query("chain_join", """
SELECT o_orderkey, o_custkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey""")
def chain_join(spark: SparkSession, d: str) -> DataFrame:
    """First call's answer names the key of the second: order body → customer."""
    orders = tables.parquet(spark, d, "orders")
    answers = orders.select("o_orderkey", F.to_json(F.struct(F.col("o_custkey").alias("userId"))).alias("body"))
    step = answers.withColumn("user_id", F.get_json_object("body", "$.userId").try_cast("bigint"))
    authors = tables.parquet(spark, d, "customer")
    return step.join(authors, step["user_id"] == authors["c_custkey"]).select(
        "o_orderkey", F.col("user_id").alias("o_custkey"), "c_name", "c_mktsegment")


@query("detail_inner", """
SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, p_name, p_retailprice FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE p_size > 10""")
def detail_inner(spark: SparkSession, d: str) -> DataFrame:
    """One detail answer per item; items whose detail fails are dropped."""
    details = tables.parquet(spark, d, "part").where("p_size > 10")
    lines = tables.parquet(spark, d, "lineitem")
    return lines.join(details, lines["l_partkey"] == details["p_partkey"]).select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "p_name", "p_retailprice")
