import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.operators import bucketed, upsert
from millrace.workspace import scratch

SCHEMA = "id int, a string, b string, seq int"


def frames(spark):
    target = spark.createDataFrame([(1, "t1", "u1"), (2, "t2", "u2")], "id int, a string, b string")
    batch = spark.createDataFrame([(2, "x", None, 1), (2, None, "y", 2), (3, "n", None, 1), (None, "z", "z", 1)], SCHEMA)
    return target, batch


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_overwrite_takes_last_row_whole(spark, rows, limit):
    target, batch = frames(spark)
    out = upsert.merge(target, batch, ["id"], ["seq"], broadcast_bytes=limit)
    assert rows(out, "id", "a", "b") == sorted(
        [(1, "t1", "u1"), (2, None, "y"), (3, "n", None), (None, "z", "z")], key=repr)


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_keep_folds_column_by_column(spark, rows, limit):
    target, batch = frames(spark)
    out = upsert.merge(target, batch, ["id"], ["seq"], upsert.KEEP_TARGET_ON_NULL, limit)
    assert rows(out, "id", "a", "b") == sorted(
        [(1, "t1", "u1"), (2, "x", "y"), (3, "n", None), (None, "z", "z")], key=repr)


def test_column_absent_from_batch_keeps_target(spark, rows):
    target, batch = frames(spark)
    out = upsert.merge(target, batch.where("id = 3 OR id = 2").drop("b"), ["id"], ["seq"])
    assert rows(out, "id", "a", "b") == sorted([(1, "t1", "u1"), (2, None, "u2"), (3, "n", None)], key=repr)


def test_extra_column_is_refused(spark):
    target, batch = frames(spark)
    with pytest.raises(ValueError, match="not in the target"):
        upsert.merge(target, batch.withColumn("c", F.lit(1)), ["id"], ["seq"])


entries = st.lists(st.tuples(st.integers(0, 4), st.one_of(st.none(), st.sampled_from("xyz")),
                             st.one_of(st.none(), st.sampled_from("xyz"))), min_size=1, max_size=8)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(entries, st.booleans(), st.booleans())
def test_merge_equals_ordered_row_upserts_and_is_idempotent(spark, changes, keep, small):
    target = [(0, "t", None), (1, None, "t"), (9, "t", "t")]
    expected = {k: [a, b] for k, a, b in target}
    for k, a, b in changes:
        old = expected.get(k, [None, None])
        expected[k] = [old[0] if keep and a is None else a, old[1] if keep and b is None else b]
    batch = spark.createDataFrame([(*c, i) for i, c in enumerate(changes)], SCHEMA)
    mode = upsert.KEEP_TARGET_ON_NULL if keep else upsert.OVERWRITE
    frame = spark.createDataFrame(target, "id int, a string, b string")
    limit = 1 << 20 if small else 0
    once = upsert.merge(frame, batch, ["id"], ["seq"], mode, limit)
    wanted = sorted((k, *v) for k, v in expected.items())
    assert sorted((tuple(r) for r in once.collect()), key=lambda r: r[0]) == wanted
    twice = upsert.merge(once, batch, ["id"], ["seq"], mode, limit)
    assert sorted((tuple(r) for r in twice.collect()), key=lambda r: r[0]) == wanted


def test_snapshot_keeps_old_version_until_commit(spark, rows):
    table = bucketed.BucketedTable(spark, scratch(spark, "t"))
    assert table.read() is None
    target, batch = frames(spark)
    table.replace(target, "r1", ["id"])
    before = table.read()
    table.upsert(batch.where("id IS NOT NULL"), "r2", ["id"], ["seq"])
    assert len(rows(before)) == 2 and len(rows(table.read())) == 3
    table.upsert(batch.where("id IS NOT NULL"), "r2", ["id"], ["seq"])
    assert len(rows(table.read())) == 3


def test_bucketed_upsert_leaves_untouched_buckets(spark, rows):
    table = bucketed.BucketedTable(spark, scratch(spark, "b"), bucket_rows=10)
    table.replace(spark.range(100).selectExpr("cast(id AS string) AS id", "'old' AS v"), "load", ["id"])
    before = set(table.read().inputFiles())
    for run in ("r1", "r2", "r3"):
        change = spark.createDataFrame([("7", run), ("new", run), (None, run)], "id string, v string")
        table.upsert(change, run, ["id"])
    after = table.read()
    assert len(before & set(after.inputFiles())) >= 8
    assert after.count() == 104 and after.where("v = 'old'").count() == 99
    assert rows(after.where("id IS NULL"), "v") == [("r1",), ("r2",), ("r3",)]
    assert rows(after.where("id IN ('7', 'new')"), "id", "v") == [("7", "r3"), ("new", "r3")]


def test_bucketed_table_deals_anew_when_it_grows(spark, rows):
    table = bucketed.BucketedTable(spark, scratch(spark, "g"), bucket_rows=10)
    for run in range(5):
        change = spark.range(run * 20, run * 20 + 30).selectExpr("CAST(id AS int) AS id", f"{run} AS v")
        table.upsert(change.union(spark.createDataFrame([(None, run)], "id int, v int")), f"r{run}", ["id"])
    out = table.read()
    assert sorted((r.id, r.v) for r in out.where("id IS NOT NULL").collect()) == [(i, min(i // 20, 4)) for i in range(110)]
    assert out.where("id IS NULL").count() == 5 and table._state().buckets > 3


def test_bucketed_table_replaced_by_nothing_is_empty(spark):
    table = bucketed.BucketedTable(spark, scratch(spark, "e"))
    table.replace(spark.createDataFrame([], "id int, v string"), "r", ["id"])
    assert table.read().columns == ["id", "v"] and table.read().count() == 0


def test_touched_partitions_only(spark, rows):
    path = scratch(spark, "p")
    spark.range(20).selectExpr("id", "'old' AS v", "id DIV 10 AS part").write.partitionBy("part").parquet(path)
    untouched = {f for f in spark.read.parquet(path).inputFiles() if "part=0" in f}
    batch = spark.createDataFrame([(11, "new", 1), (25, "new", 2)], "id long, v string, part long")
    part = upsert.touched_part(spark, path, batch, "part")
    assert "PartitionFilters: [part#" in part._jdf.queryExecution().toString() and part.count() == 10
    upsert.upsert_touched_partitions(spark, path, batch, ["id"], "part")
    after = spark.read.parquet(path)
    assert after.count() == 21 and after.where("v = 'new'").count() == 2
    assert untouched <= set(after.inputFiles())


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_without_sequence_each_key_still_comes_once(spark, limit):
    target, _ = frames(spark)
    batch = spark.createDataFrame([(2, "p", "p"), (2, "q", "q"), (5, "r", None), (5, "s", None)], "id int, a string, b string")
    first, again = (sorted(tuple(r) for r in upsert.merge(target, batch, broadcast_bytes=limit).select("id", "a").collect())
                    for _ in range(2))
    assert first == again and [r[0] for r in first] == [1, 2, 5]
    inserted = upsert.insert_missing(target, batch, ["id"])
    assert sorted(r.id for r in inserted.collect()) == [1, 2, 5]


def test_conflict_policies(spark):
    target, batch = frames(spark)
    with pytest.raises(ValueError, match="already present"):
        upsert.insert_missing(target, batch.select("id", "a", "b"), ["id"], "error")
    fresh = batch.where("id = 3").select("id", "a", "b")
    assert upsert.insert_missing(target, fresh, ["id"], "error").count() == 3
