"""Sinks: append, upsert, payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import bucketed, schema_fit, sinks, upsert
from millrace.plans.catalogue import middle, query
from millrace.sources import tables
from millrace.workspace import scratch


@query("append_sink", "SELECT * FROM orders")
def append_sink(spark: SparkSession, d: str) -> DataFrame:
    """Two runs of halves, the second one repeated after a failure."""
    path = scratch(spark, "append")
    orders = tables.parquet(spark, d, "orders")
    half = middle(orders, "o_orderkey")
    sinks.append(orders.where(F.col("o_orderkey") <= half), path, "run1")
    sinks.append(orders.where(F.col("o_orderkey") > half), path, "run2")
    sinks.append(orders.where(F.col("o_orderkey") > half), path, "run2")
    return sinks.read_appended(spark, path)


def customer_halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A stale target without one segment, and a batch of two versions of other customers."""
    customers = tables.parquet(spark, d, "customer")
    target = customers.where("c_mktsegment <> 'BUILDING'").withColumn("c_acctbal", F.lit(0.5))
    second = customers.where("c_mktsegment IN ('BUILDING', 'MACHINERY')")
    first = second.withColumn("c_acctbal", F.lit(-1.0)).withColumn("c_name", F.lit("old"))
    batch = first.withColumn("seq", F.lit(1)).unionByName(second.withColumn("seq", F.lit(2)))
    return target, batch


@query("upsert_merge", """
SELECT c_custkey, c_name, c_nationkey, c_mktsegment,
  CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_acctbal ELSE 0.5 END AS c_acctbal FROM customer""")
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    target, batch = customer_halves(spark, d)
    table = bucketed.BucketedTable(spark, scratch(spark, "upsert"), bucket_rows=1000)
    table.replace(target, "load", ["c_custkey"])
    table.upsert(batch, "batch", ["c_custkey"], ["seq"])
    return table.read()


@query("upsert_partial", """
SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_name ELSE c_name END AS c_name, c_nationkey, c_mktsegment,
  CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 0.5 WHEN c_acctbal < 0 THEN -1.0 ELSE c_acctbal END AS c_acctbal
FROM customer""")
def upsert_partial(spark: SparkSession, d: str) -> DataFrame:
    """The newer version has no balance where it is negative: the older version's balance stays."""
    target, batch = customer_halves(spark, d)
    batch = batch.withColumn("c_acctbal", F.when((F.col("seq") == 1) | (F.col("c_acctbal") >= 0), F.col("c_acctbal")))
    return upsert.merge(target, batch, ["c_custkey"], ["seq"], upsert.KEEP_TARGET_ON_NULL)


@query("upsert_outer", """
SELECT c_custkey, c_name, c_nationkey, c_mktsegment,
  CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_acctbal ELSE 0.5 END AS c_acctbal FROM customer""")
def upsert_outer(spark: SparkSession, d: str) -> DataFrame:
    """The same merge when the batch is too large to broadcast."""
    target, batch = customer_halves(spark, d)
    return upsert.merge(target, batch, ["c_custkey"], ["seq"], broadcast_bytes=0)


@query("upsert_partitions", """
SELECT o_orderkey, CASE WHEN o_orderdate >= TIMESTAMP '2000-01-01' THEN 'N' ELSE o_orderstatus END AS o_orderstatus,
  CAST(year(o_orderdate) AS INTEGER) AS y FROM orders""")
def upsert_partitions(spark: SparkSession, d: str) -> DataFrame:
    """Only the partitions of recent years are read and rewritten."""
    path = scratch(spark, "partitions")
    orders = tables.parquet(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.year("o_orderdate").alias("y"))
    orders.write.partitionBy("y").parquet(path)
    batch = orders.where("y >= 2000").withColumn("o_orderstatus", F.lit("N"))
    upsert.upsert_touched_partitions(spark, path, batch, ["o_orderkey"], "y")
    return spark.read.parquet(path).select("o_orderkey", "o_orderstatus", "y")


@query("conflict_skip", """
SELECT c_custkey, c_name, CASE WHEN c_mktsegment <> 'BUILDING' THEN 0.5 ELSE c_acctbal END AS c_acctbal FROM customer""")
def conflict_skip(spark: SparkSession, d: str) -> DataFrame:
    customers = tables.parquet(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    target = customers.where("c_mktsegment <> 'BUILDING'").withColumn("c_acctbal", F.lit(0.5))
    return upsert.insert_missing(target, customers, ["c_custkey"]).drop("c_mktsegment")


@query("push_payload", """
SELECT c_custkey, '{"id":' || c_custkey || ',"name":"' || c_name || '"'
  || CASE WHEN c_acctbal >= 0 THEN ',"segment":"' || c_mktsegment || '"' ELSE '' END || '}' AS payload FROM customer""")
def push_payload(spark: SparkSession, d: str) -> DataFrame:
    customers = tables.parquet(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("segment"))
    return customers.select(F.col("id").alias("c_custkey"), sinks.push_payload(customers).alias("payload"))


@query("form_encode", """
SELECT c_custkey, 'c_custkey=' || c_custkey || '&c_name=' || replace(replace(c_name || ' & co', ' ', '+'), '&', '%26')
  || '&c_nationkey=' || c_nationkey || CASE WHEN c_acctbal >= 0 THEN '&segment=' || c_mktsegment ELSE '&segment=none' END
  || '&ccode=x%2Fy' AS form FROM (SELECT * REPLACE (replace(c_name, '#', '-') AS c_name) FROM customer)""")
def form_encode(spark: SparkSession, d: str) -> DataFrame:
    customers = tables.parquet(spark, d, "customer").select(
        "c_custkey", F.concat(F.replace("c_name", F.lit("#"), F.lit("-")), F.lit(" & co")).alias("c_name"), "c_nationkey",
        F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("segment"), F.array("c_custkey").alias("nested"), "c_acctbal")
    form = sinks.form_encode(customers, ["c_acctbal"], {"segment": "none", "ccode": "x/y", "c_acctbal": "skipped"})
    return customers.select("c_custkey", form.alias("form"))


@query("infer_ddl", """
SELECT 'p_partkey' AS column_name, 'BIGINT' AS ddl_type WHERE (SELECT count(*) FROM part WHERE TRY_CAST(CAST(p_partkey AS VARCHAR) AS BIGINT) IS NULL) = 0
UNION ALL SELECT 'p_name', 'VARCHAR(2000)' WHERE (SELECT count(*) FROM part WHERE TRY_CAST(p_name AS DOUBLE) IS NULL) > 0
UNION ALL SELECT 'p_brand', 'VARCHAR(2000)' WHERE (SELECT count(*) FROM part WHERE TRY_CAST(p_brand AS DOUBLE) IS NULL) > 0
UNION ALL SELECT 'p_type', 'VARCHAR(2000)' WHERE (SELECT count(*) FROM part WHERE TRY_CAST(p_type AS DOUBLE) IS NULL) > 0
UNION ALL SELECT 'p_size', 'BIGINT' WHERE (SELECT count(*) FROM part WHERE p_size IS NULL) = 0
UNION ALL SELECT 'p_retailprice', 'DOUBLE' WHERE (SELECT count(*) FROM part WHERE p_retailprice <> floor(p_retailprice)) > 0""")
def infer_ddl(spark: SparkSession, d: str) -> DataFrame:
    part = tables.parquet(spark, d, "part")
    return schema_fit.infer_types(part.select(*[F.col(c).cast("string").alias(c) for c in part.columns]))
