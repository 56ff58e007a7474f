"""Rows that must not be lost, repeated or taken for others."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace import sync
from millrace.engine import TableSink, run_flow
from millrace.operators.lookup import lookup, lookup_many
from millrace.operators.bucketed import BucketedTable
from millrace.operators.upsert import upsert_touched_partitions
from millrace.sources.tables import pages_of
from millrace.spec import FlowSpec, Strategy
from millrace.streaming.incremental import file_stream, stream_not_synced
from millrace.workspace import scratch

NOW = dt.datetime(2024, 1, 1)


def test_caps_and_pages_keep_rows_without_a_key(spark, rows):
    df = spark.createDataFrame([(None, 1), (None, 2), (1, 3), (2, 4), (3, 5)], "k int, v int")
    assert rows(sync.capped(df, "k", 2), "v") == [(1,), (2,), (3,), (4,)]
    assert sync.capped(df.where("k is null"), "k", 2).count() == 2
    assert rows(pages_of(df, "k", 2)) == [(1, 3, 0), (2, 4, 0), (3, 5, 1), (None, 1, 0), (None, 2, 0)]


def test_numbers_kept_as_text_are_compared_as_numbers(spark):
    root = scratch(spark, "t")
    flow = FlowSpec(1, "f", Strategy.INCREMENTAL_ID, "id", "NUMERIC", key=("id",))
    def source(names):
        return spark.createDataFrame([(n,) for n in names], "id string")
    first = run_flow(spark, flow, source(["8", "9", "10"]), TableSink(f"{root}/t"), root, now=NOW)
    second = run_flow(spark, flow, source(["9", "10", "11", "100"]), TableSink(f"{root}/t"), root, now=NOW)
    assert (first.bookmark_after, second.bookmark_after, second.read_count) == ("10", "100", 2)


def test_capped_numbers_kept_as_text_all_arrive(spark):
    root = scratch(spark, "c")
    flow = FlowSpec(3, "f", Strategy.INCREMENTAL_ID, "id", "NUMERIC", key=("id",), cap=3)
    def source(*names):
        return spark.createDataFrame([(n,) for n in names], "id string")
    wanted = [str(n) for n in range(1, 13)] + ["none"]
    marks = [run_flow(spark, flow, source(*wanted), TableSink(f"{root}/t"), root, now=NOW).bookmark_after for _ in range(4)]
    assert marks == ["3", "6", "9", "12"]
    run_flow(spark, flow, source(*wanted, "later", "13"), TableSink(f"{root}/t"), root, now=NOW)
    assert {r["id"] for r in BucketedTable(spark, f"{root}/t").read().collect()} == {*wanted, "later", "13"}


def test_bookmark_is_a_moment_in_any_session_zone(spark):
    root = scratch(spark, "z")
    flow = FlowSpec(2, "f", Strategy.INCREMENTAL_TIME, "at", "TIME", key=("id",))
    def source(*hours):
        return spark.createDataFrame([(h,) for h in hours], "id int").withColumn("at", F.timestamp_seconds(F.col("id") * 3600 + 1704067200))
    run_flow(spark, flow, source(1, 2), TableSink(f"{root}/t"), root, now=NOW)
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert run_flow(spark, flow, source(1, 2, 4), TableSink(f"{root}/t"), root, now=NOW).read_count == 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert BucketedTable(spark, f"{root}/t").read().count() == 3


def test_partition_values_stay_text_and_moved_keys_fail(spark, rows):
    path = scratch(spark, "p")
    def batch(*values):
        return spark.createDataFrame(values, "id int, v string, p string")
    upsert_touched_partitions(spark, path, batch((1, "old", "007"), (2, "b", "08")), ["id"], "p")
    upsert_touched_partitions(spark, path, batch((1, "new", "007")), ["id"], "p")
    stored = spark.read.schema("id int, v string, p string").parquet(path)
    assert rows(stored) == [(1, "new", "007"), (2, "b", "08")]
    with pytest.raises(ValueError, match="changes its partition"):
        upsert_touched_partitions(spark, path, batch((1, "x", "08")), ["id"], "p")


def test_streams_keep_every_row_without_an_id(spark, rows):
    root = scratch(spark, "s")
    df = spark.createDataFrame([(None, 1), (None, 2), (5, 3), (5, 4)], "id int, seq int")
    df.write.parquet(f"{root}/in")
    stream_not_synced(spark, file_stream(spark, f"{root}/in", df.schema), f"{root}/out", f"{root}/cp", "id", ["seq"], df.schema)
    assert rows(spark.read.parquet(f"{root}/out"), "id", "seq") == [(5, 3), (None, 1), (None, 2)]


def test_lookups_never_multiply_rows(spark, rows):
    left = spark.createDataFrame([(1, "a", ["a", "b"]), (2, "c", [])], "id int, k string, ks array<string>")
    right = spark.createDataFrame([("a", "y"), ("a", "x"), ("b", "z")], "k string, name string")
    assert rows(lookup(left, right, "k", "k", {"name": "name"}, flag="hit"), "id", "name", "hit") == [(1, "x", True), (2, None, False)]
    assert rows(lookup_many(left, right, "id", F.col("ks"), "k", F.col("name"), "names"), "id", "names") == [(1, "x, z"), (2, "")]


def test_numeric_text_by_time_reads_on(spark):
    root = scratch(spark, "tt")
    flow = FlowSpec(5, "f", Strategy.INCREMENTAL_TIME, "at", "NUMERIC", key=("at",))
    def read(*names):
        return run_flow(spark, flow, spark.createDataFrame([(n,) for n in names], "at string"), TableSink(f"{root}/t"), root, now=NOW).read_count
    assert [read("8", "9"), read("8", "9", "10", "11"), read("11", "100", "2")] == [2, 3, 2]
    assert {r["at"] for r in BucketedTable(spark, f"{root}/t").read().collect()} == {"8", "9", "10", "11", "100"}


@pytest.mark.parametrize("strategy", [Strategy.INCREMENTAL_ID, Strategy.INCREMENTAL_TIME])
def test_long_numbers_kept_as_text(spark, strategy):
    root = scratch(spark, "long")
    flow = FlowSpec(6, "f", strategy, "n", "NUMERIC", key=("n",), cap=2)
    texts = ["1.0000000001", "1.0000000002", "1.0000000003", "-0.5", "-0.25", "12345678901234567890123456789012345678", "+7", "007.50", "1e3", "1" * 45, "x"]
    for _ in range(8):
        run_flow(spark, flow, spark.createDataFrame([(t,) for t in texts], "n string"), TableSink(f"{root}/t"), root, now=NOW)
    assert {r["n"] for r in BucketedTable(spark, f"{root}/t").read().collect()} == set(texts)


def test_number_places_are_in_order(spark):
    texts = ["-12", "-1.5", "-1.4999999999999", "-0.5", "0", "0.0000000000001", ".5", "1.", "1.0000000001", "1.1", "9", "10", "1e3", "12345678901234567890.5"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("p", sync.number_place(F.col("t")))
    assert [r.i for r in df.repartition(3).orderBy("p").collect()] == list(range(len(texts)))
    odd = spark.createDataFrame([(t,) for t in ["", "-", ".", "x", "1.2.3", None, "9" * 39, "0." + "1" * 38]], "t string")
    assert odd.select(sync.number_place(F.col("t")).alias("p")).where("p IS NOT NULL").count() == 0
    same = spark.createDataFrame([("1", "01.00"), ("-0", "0"), ("+2.50", "2.5")], "a string, b string")
    assert same.where(sync.number_place(F.col("a")) == sync.number_place(F.col("b"))).count() == 3
