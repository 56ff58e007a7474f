"""API streams and outputs, keyed state, and the bucketed set of synced ids."""

import glob
import json
import os
import re
import shutil
import sys
import time
from dataclasses import dataclass

import pytest
from pyspark import cloudpickle
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from millrace.engine import TableSink, run_flow
from millrace.plans.flows import IdempotentServer
from millrace.sources import rest
from millrace.sources.rest import Request, Response, RestSender, packed
from millrace.spec import FlowSpec, Strategy
from millrace.state import StateStore
from millrace.streaming import incremental
from millrace.synced import BUCKET, SyncedBuckets

# The transports below travel to workers, which cannot import this file.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class ListFile:
    """An API over a JSON list in a file, by page or offset."""

    path: str

    def __call__(self, request):
        with open(self.path, encoding="utf-8") as source:
            items = json.load(source)
        page, size = map(int, re.search(r"p=(\d+)&n=(\d+)", request.url).groups())
        return Response(200, json.dumps({"count": len(items), "rows": items[page * size:(page + 1) * size]}))


def put(path, items):
    path.write_text(json.dumps(items), encoding="utf-8")


@pytest.mark.parametrize("paging", ["page", "offset"])
def test_stream_of_items_goes_on_inside_the_last_page(spark, tmp_path, paging):
    source, out = tmp_path / "list.json", str(tmp_path / "out")

    def run():
        stream = rest.read_stream(spark, ListFile(str(source)), "api://x?p={{page}}&n={{size}}", paging=paging, pagesize="4", firstpage="0",
                                  itemspath="rows", totalpath="count", callspertask="2")
        (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp"))
         .trigger(availableNow=True).start().awaitTermination())
        return sorted((r.position, json.loads(r.item)) for r in spark.read.parquet(out).collect())

    for count in (0, 6, 6, 8, 30):
        put(source, [{"n": i, "é": None} for i in range(count)])
        assert run() == [(i, {"n": i, "é": None}) for i in range(count)]
    put(source, [{"n": i} for i in range(10)])
    with pytest.raises(StreamingQueryException):
        run()


def test_stream_needs_paging(spark, tmp_path):
    stream = rest.read_stream(spark, ListFile("x"), "api://x")
    with pytest.raises(Exception, match="paging"):
        stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start().awaitTermination()


# API output

def sent(root):
    return sorted(json.loads(open(p, encoding="utf-8").read())["id"] for p in glob.glob(f"{root}/*.json") if "rows" not in open(p).read())


def test_repeated_write_leaves_one_result_per_row(spark, tmp_path):
    rows = spark.range(40).select(F.col("id").cast("string").alias("id"), F.lit(None).cast("string").alias("none"))
    for _ in range(2):
        rest.write(rows, IdempotentServer(str(tmp_path), "17"), "id", "api://r/${id}", "w1", attempts="1", commiturl="api://done")
    assert sent(tmp_path) == sorted(str(i) for i in range(40))
    rest.write(rows, IdempotentServer(str(tmp_path), "17"), "id", "api://r/${id}", "w2")
    assert len(sent(tmp_path)) == 80


def refuse(request):
    return Response(500, "")


def test_write_that_keeps_failing_fails(spark):
    with pytest.raises(Exception, match="HTTP 500"):
        rest.write(spark.range(3), refuse, "id", "api://r", "w", attempts="2")


def test_abort_is_told_and_calls_are_tried_again(tmp_path):
    calls = []

    def flaky(request: Request) -> Response:
        calls.append((request.url, request.headers["Idempotency-Key"]))
        return Response(200 if len(calls) > 1 else 503, "")

    sender = RestSender({"transport": packed(flaky), "url": "api://r/${a}", "writeid": "w", "aborturl": "api://abort"})
    sender.transport = flaky
    assert sender.send([("k", '{"a": "1"}')]).rows == 1
    assert [c[0] for c in calls] == ["api://r/1", "api://r/1"] and len({c[1] for c in calls}) == 1
    sender.close(sender.abort_url, "w", [None])
    assert calls[-1] == ("api://abort", "w:abort")


def test_stream_is_written_batch_by_batch(spark, tmp_path):
    spark.range(5).selectExpr("string(id) AS id").write.parquet(str(tmp_path / "in"))
    for extra in (0, 5):
        if extra:
            spark.range(5, 9).selectExpr("string(id) AS id").write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id string").parquet(str(tmp_path / "in"))
        rest.write_stream(stream, IdempotentServer(str(tmp_path / "server"), "none"), "id", "api://r/${id}", "s", str(tmp_path / "cp"))
    assert sent(tmp_path / "server") == [str(i) for i in range(9)]


# keyed state

EVENTS = [("a", 2, "x"), ("a", 1, "y"), ("b", 1, "z"), (None, 1, "n"), (None, 1, "n")]


def deliver(spark, root, rows, remember_ms):
    spark.createDataFrame(rows, "id string, at int, what string").write.mode("append").parquet(f"{root}/in")
    stream = incremental.file_stream(spark, f"{root}/in", spark.read.parquet(f"{root}/in").schema)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    incremental.stream_synced_state(spark, stream, f"{root}/out", f"{root}/cp", "id", ["at"], remember_ms)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    return sorted(((r.id, r["at"], r.what) for r in spark.read.parquet(f"{root}/out").collect()), key=repr)


def test_state_keeps_the_first_row_and_all_without_an_id(spark, tmp_path):
    first = [("a", 1, "y"), ("b", 1, "z"), (None, 1, "n"), (None, 1, "n")]
    assert deliver(spark, tmp_path, EVENTS, 10 ** 9) == sorted(first, key=repr)
    again = [("a", 0, "late"), ("c", 9, "new"), (None, 2, "m")]
    assert deliver(spark, tmp_path, again, 10 ** 9) == sorted(first + again[1:], key=repr)


def test_state_is_forgotten_after_its_time(spark, tmp_path):
    deliver(spark, tmp_path, [("a", 1, "x")], 1)
    time.sleep(0.1)
    assert deliver(spark, tmp_path, [("a", 2, "y")], 1) == [("a", 1, "x"), ("a", 2, "y")]


# synced ids

def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id string")


def left(synced, df, key="id"):
    return sorted((r[0] for r in synced.missing(df, key).collect()), key=repr)


def test_synced_set_edges(spark, tmp_path):
    synced = SyncedBuckets(spark, str(tmp_path), buckets=4)
    some = ids(spark, "a", "b", None, "", "b")
    assert left(synced, some) == sorted(["a", "b", None, "", "b"], key=repr) and synced.read().count() == 0
    synced.add(some)
    synced.add(some)
    assert sorted(r.id for r in synced.read().collect()) == ["", "a", "b"]
    assert left(synced, some) == [None]
    assert left(synced, ids(spark, "c", "a", "c")) == ["c", "c"]
    synced.add(ids(spark))
    named = spark.createDataFrame([("a", 1, 2), ("z", 3, 4)], "id string, _maybe int, n int")
    assert [tuple(r) for r in synced.missing(named.select("id", "n"), "id").collect()] == [("z", 4)]
    assert sorted(synced.missing(spark.range(3), "id").columns) == ["id"]


def test_untouched_buckets_are_not_read(spark, tmp_path):
    synced = SyncedBuckets(spark, str(tmp_path), buckets=16)
    synced.add(spark.range(400))
    parts = {r[BUCKET]: r["path"] for r in synced.parts().collect()}
    wanted = spark.createDataFrame([(7,)], "id bigint")
    home = spark.range(1).selectExpr("int(pmod(xxhash64('7'), 16))").first()[0]
    for bucket, path in parts.items():
        if bucket != home:
            shutil.rmtree(path)
    assert left(synced, wanted) == []
    # Ids that no filter knows read nothing at all.
    shutil.rmtree(parts[home])
    new = spark.range(10 ** 6, 10 ** 6 + 200)
    doubtful = synced._flagged(new, "id", synced._head()).where("_maybe").count()
    assert doubtful < 20
    if not doubtful:
        assert len(left(synced, new)) == 200


def test_parts_are_merged_and_old_files_go(spark, tmp_path):
    synced = SyncedBuckets(spark, str(tmp_path), buckets=2, compact_at=2)
    for run in range(6):
        synced.add(spark.range(run * 10, run * 10 + 15))
        most = max(r["count"] for r in synced.parts().groupBy(BUCKET).count().collect())
        assert most <= 2
        assert sorted(int(r.id) for r in synced.read().collect()) == list(range(run * 10 + 15))
    live = {r["path"] for r in synced.parts().collect()}
    kept = set(glob.glob(f"{tmp_path}/data/*/{BUCKET}=*"))
    assert live <= kept and len(kept) <= len(live) + 6
    assert len(os.listdir(tmp_path / "index")) <= 3


def test_set_is_dealt_anew_when_it_grows(spark, tmp_path):
    synced = SyncedBuckets(spark, str(tmp_path), buckets=2, bucket_ids=20)
    for run in range(3):
        synced.add(spark.range(run * 100, run * 100 + 100))
    assert synced._head()["buckets"] > 2
    assert synced.read().count() == 300 and left(synced, spark.range(290, 310)) == list(range(300, 310))


def test_filters_too_large_to_broadcast_still_answer(spark, tmp_path):
    synced = SyncedBuckets(spark, str(tmp_path), buckets=4, most_broadcast=0)
    synced.add(spark.range(50))
    assert left(synced, spark.range(40, 60)) == list(range(50, 60))


def test_flow_with_a_bucketed_set(spark, tmp_path):
    flow = FlowSpec(5, "rows", Strategy.SYNCED_SET, key=("id",))
    synced, state = SyncedBuckets(spark, f"{tmp_path}/synced", buckets=4), f"{tmp_path}/state"
    reads = [run_flow(spark, flow, spark.range(n), TableSink(f"{tmp_path}/t"), state, synced=synced).read_count for n in (5, 8, 8)]
    assert reads == [5, 3, 0]
    import datetime as dt
    StateStore(spark, state).reset(5, dt.datetime(2025, 1, 1))
    assert run_flow(spark, flow, spark.range(8), TableSink(f"{tmp_path}/t"), state, synced=synced).read_count == 8
