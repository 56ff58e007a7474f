"""Plans that must hold at scale: what is pushed down, trimmed early, or not shuffled."""

from pyspark.sql import functions as F

from millrace import sync
from millrace.operators import json_ops, upsert
from millrace.sources import tables

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_incremental_filter_and_columns_reach_the_scan(spark):
    orders = tables.parquet(spark, FOLDER, "orders")
    text = plan(sync.newer_by_id(orders, "o_orderkey", "5").select("o_orderkey"))
    assert "GreaterThan(o_orderkey,5)" in text and "ReadSchema: struct<o_orderkey:bigint>" in text


def test_first_per_key_trims_groups_before_the_shuffle(spark):
    text = plan(upsert.dedupe_last(tables.parquet(spark, FOLDER, "events"), ["user_id"], [F.desc("ts")]))
    assert text.index("Exchange") < text.index("WindowGroupLimit", text.index("Exchange"))


def test_small_merge_does_not_shuffle_the_target(spark):
    target = tables.parquet(spark, FOLDER, "customer")
    batch = target.where("c_custkey < 10")
    text = plan(upsert.merge(target, batch, ["c_custkey"]).where("c_name IS NOT NULL"))
    update = text[:text.index("LeftAnti")]
    assert "BroadcastHashJoin" in update and "SortMergeJoin" not in text


def test_large_merge_shuffles_each_side_once(spark):
    target = tables.parquet(spark, FOLDER, "customer")
    text = plan(upsert.merge(target, target.withColumn("seq", F.lit(1)), ["c_custkey"], ["seq"], broadcast_bytes=0))
    assert text.count("Exchange hashpartitioning") == 2 and "FullOuter" in text


def test_array_is_computed_once_below_an_explode(spark):
    df = tables.parquet(spark, FOLDER, "documents")
    text = plan(json_ops.explode_items(df, ["doc_id"], F.split("text", " "), "word"))
    assert text.count("split(text") == 1


def test_spread_only_when_there_are_fewer_splits_than_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    assert tables.spread(spark.range(0, 10, 1, 1)).rdd.getNumPartitions() == cores
    wide = spark.range(0, 100, 1, cores * 2)
    assert tables.spread(wide) is wide
