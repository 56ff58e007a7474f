import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from millrace import sync
from millrace.engine import TableSink, run_flow
from millrace.operators.sinks import read_appended
from millrace.operators.bucketed import BucketedTable
from millrace.spec import AFTER_WRITE, COLUMN_TYPES, ColumnSpec, FieldMapping, FlowSpec, Registry, Stage, Step
from millrace.spec import Strategy, column_schema
from millrace.state import RunLog, StateStore, retained
from millrace.workspace import scratch

NOW = dt.datetime(2025, 1, 1)


def mark(df, column, kind="STRING", compat=False):
    return df.agg(sync.high_water_mark(column, kind, compat).alias("m")).first().m


def test_high_water_mark_edges(spark):
    numbers = spark.createDataFrame([(1.9,), (None,), (7.8,)], "n double")
    assert mark(numbers, "n", "NUMERIC", compat=True) == "7"
    assert mark(numbers.where("n > 100"), "n", "NUMERIC") is None
    assert mark(numbers.where("n IS NULL"), "n", "NUMERIC") is None
    assert mark(spark.createDataFrame([("9",), ("10",)], "s string"), "s") == "9"


def test_ties_at_bookmark_and_cap(spark, rows):
    df = spark.createDataFrame([(i, day) for i, day in enumerate("aabbbcc")], "id int, day string")
    assert len(rows(sync.newer_by_time(df, "day", "b"))) == 5
    assert len(rows(sync.newer_by_id(df, "id", "4"))) == 2
    assert len(rows(sync.capped(df, "day", 3))) == 5  # cuts inside "b", so all of "b" is read
    assert rows(sync.capped(df.where("id > 99"), "day", 3)) == []


@pytest.mark.parametrize("name", ["a b", "x;--", "1a", "", "missing"])
def test_column_guard(spark, name):
    with pytest.raises(ValueError):
        sync.guarded(spark.range(1), name)


def test_anti_join_keeps_null_ids(spark, rows):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "id string")
    synced = spark.createDataFrame([("a",), (None,)], "id string")
    assert rows(sync.not_synced(df, synced, "id")) == sorted([("b",), (None,)], key=repr)


def test_state_reset_and_corrupt(spark, tmp_path):
    state = StateStore(spark, scratch(spark, "s"))
    first = state.load(1)
    assert first.last_value is None
    state.save(first, "f", "INCREMENTAL_ID", "id", "5", NOW, 3)
    state.save(state.load(1), "f", "INCREMENTAL_ID", "id", "9", NOW, 3)
    state.add_synced(1, spark.range(3), "r")
    state.add_synced(1, spark.range(3), "r")
    assert state.load(1).last_value == "9" and state.synced_ids(1).count() == 3
    state.reset(1, NOW)
    assert state.load(1).last_value is None and state.synced_ids(1).count() == 0
    (tmp_path / "bookmarks").mkdir()
    (tmp_path / "bookmarks" / "x.parquet").write_bytes(b"not parquet")
    broken = StateStore(spark, str(tmp_path))
    with pytest.raises(Exception):
        broken.load(1)
    assert broken.load(1, on_corrupt="full").last_value is None


def ids(spark, low, high):
    return spark.range(low, high).selectExpr("id", "concat('v', id) AS v")


def test_two_runs_by_id(spark):
    root = scratch(spark, "e")
    flow = FlowSpec(1, "f", Strategy.INCREMENTAL_ID, "id", "NUMERIC")
    sink = TableSink(f"{root}/t")
    first = run_flow(spark, flow, ids(spark, 0, 5), sink, f"{root}/s", now=NOW)
    second = run_flow(spark, flow, ids(spark, 0, 8), sink, f"{root}/s", now=NOW)
    assert (first.read_count, second.read_count) == (5, 3)
    assert (second.bookmark_before, second.bookmark_after) == ("4", "7")
    assert BucketedTable(spark, f"{root}/t").read().count() == 8
    idle = run_flow(spark, flow, ids(spark, 0, 8), sink, f"{root}/s", now=NOW)
    assert idle.read_count == 0 and StateStore(spark, f"{root}/s").load(1).last_value == "7"


def test_synced_set_runs_and_full_appends(spark):
    root = scratch(spark, "e")
    sink = TableSink(f"{root}/t")
    once = FlowSpec(2, "once", Strategy.SYNCED_SET)
    for high in (3, 5):
        run_flow(spark, once, ids(spark, 0, high), sink, f"{root}/s", now=NOW)
    assert StateStore(spark, f"{root}/s").synced_ids(2).count() == 5
    full = FlowSpec(3, "full")
    for _ in range(2):
        run_flow(spark, full, ids(spark, 0, 3), TableSink(f"{root}/full"), f"{root}/s", now=NOW)
    assert read_appended(spark, f"{root}/full").count() == 6
    assert RunLog(spark, f"{root}/s").latest(3).first().write_count == 3


def test_partitioned_target(spark):
    root = scratch(spark, "e")
    flow = FlowSpec(8, "f", Strategy.INCREMENTAL_ID, "id", "NUMERIC")
    sink = TableSink(f"{root}/t", partition="part")
    for high in (15, 25):
        run_flow(spark, flow, ids(spark, 0, high).selectExpr("*", "id DIV 10 AS part"), sink, f"{root}/s", now=NOW)
    stored = spark.read.parquet(f"{root}/t")
    assert stored.count() == 25 and stored.select("id").distinct().count() == 25


class BrokenSink:
    def write(self, df, flow, run_id):
        raise RuntimeError("target is down")


def test_failed_sink_leaves_state_and_logs(spark):
    root = scratch(spark, "e")
    flow = FlowSpec(4, "f", Strategy.INCREMENTAL_ID, "id", "NUMERIC")
    with pytest.raises(RuntimeError, match="target is down"):
        run_flow(spark, flow, ids(spark, 0, 5), BrokenSink(), root, now=NOW)
    assert StateStore(spark, root).load(4).last_value is None
    run = RunLog(spark, root).latest(4).first()
    assert run.status == "FAILED" and "target is down" in run.error_message


def test_bookmark_comes_from_source_rows(spark):
    root = scratch(spark, "e")
    flow = FlowSpec.from_json(json.dumps({
        "id": 5, "syncStrategy": "INCREMENTAL_ID", "incrementalColumn": "id", "incrementalColumnType": "NUMERIC",
        "key": ["v"], "pipelineConfig": [{"position": "AFTER_READ", "steps": [{"type": "TEMPLATE", "templateId": 7}]}]}))
    registry = Registry(templates={"7": lambda df: df.where("id < 2").select("v")})
    result = run_flow(spark, flow, ids(spark, 0, 5), TableSink(f"{root}/t"), root, registry, now=NOW)
    assert (result.read_count, result.write_count, result.bookmark_after) == (5, 2, "4")


def test_reader_function_is_called_once_with_the_bookmark(spark):
    root = scratch(spark, "e")
    flow = FlowSpec(6, "f", Strategy.INCREMENTAL_ID, "id", "NUMERIC", cap=2)
    calls = []

    def reader(strategy, last):
        calls.append((strategy.name, last))
        return ids(spark, 0, 5)

    first = run_flow(spark, flow, reader, TableSink(f"{root}/t"), root, now=NOW)
    assert first.read_count == 2 and any("cap" in m for m in first.messages)
    run_flow(spark, flow, reader, TableSink(f"{root}/t"), root, now=NOW)
    assert calls == [("INCREMENTAL_ID", None), ("INCREMENTAL_ID", "1")]
    assert BucketedTable(spark, f"{root}/t").read().count() == 4


def test_cap_applies_to_every_strategy_and_reaches_the_end(spark):
    root = scratch(spark, "e")
    with pytest.raises(ValueError, match="cap"):
        run_flow(spark, FlowSpec(11, "f", cap=2), ids(spark, 0, 5), TableSink(f"{root}/f"), root, now=NOW)
    once = FlowSpec(12, "o", Strategy.SYNCED_SET, cap=2)
    reads = [run_flow(spark, once, ids(spark, 0, 5), TableSink(f"{root}/o"), root, now=NOW).read_count for _ in range(4)]
    assert reads == [2, 2, 1, 0] and BucketedTable(spark, f"{root}/o").read().count() == 5


def test_reader_options():
    assert sync.reader_options(Strategy.FULL, "c", "5") == {}
    assert sync.reader_options(Strategy.INCREMENTAL_ID, "c", None) == {}
    assert sync.reader_options(Strategy.INCREMENTAL_ID, "c", 5) == {
        "strategy": "INCREMENTAL_ID", "watermark_column": "c", "watermark_lastValue": "5"}


def test_older_fields_make_stages_and_params_are_replaced(spark):
    doc = {"id": 1, "preTemplateId": 3, "mappingTemplateId": 4, "postTemplateId": 5, "templateParams": {"p": "flow"}}
    flow = FlowSpec.from_json(json.dumps(doc))
    assert [(s.position, [e.ref for e in s.steps]) for s in flow.stages] == [
        ("AFTER_READ", ["3", "4"]), ("BEFORE_WRITE", ["5"])]
    seen = []
    registry = Registry(
        templates={"3": lambda df, **p: (seen.append(p), df)[1], "5": {"q": "upper(b)"}},
        mappings={"4": FieldMapping((("a", "b"),), (ColumnSpec.parse({"key": "a", "templateId": 9}),))},
        column_functions={"9": F.trim})
    df = spark.createDataFrame([(" x ",)], "a string")
    for step in flow.compile(registry):
        df = step(df)
    assert df.collect()[0].q == "X" and seen == [{"p": "flow"}]
    own = FlowSpec(1, "f", stages=(Stage("AFTER_READ", "", (Step("TEMPLATE", "3", {"z": 1}),)),), params={"p": 1})
    own.compile(registry)[0](df)
    assert seen[-1] == {"z": 1}


def test_after_write_output_is_dropped(spark):
    root = scratch(spark, "e")
    seen = []
    flow = FlowSpec(7, "f", stages=(Stage(AFTER_WRITE, "", (Step("TEMPLATE", "n"),)),))
    registry = Registry(templates={"n": lambda df: (seen.append(df.count()), df.limit(0))[1]})
    run_flow(spark, flow, ids(spark, 0, 3), TableSink(f"{root}/t"), root, registry, now=NOW)
    assert seen == [3] and read_appended(spark, f"{root}/t").count() == 3


def test_strategy_names_and_column_specs():
    assert Strategy.parse("nonsense") is Strategy.FULL and Strategy.parse(None) is Strategy.FULL
    schema = column_schema([ColumnSpec("a", "Label", "number"), ColumnSpec("b")])
    assert schema["a"].metadata == {"label": "Label"} and schema["a"].dataType == COLUMN_TYPES["number"]


def test_retention(spark):
    runs = spark.createDataFrame([(1, f"r{i}", dt.datetime(2025, 1, i)) for i in range(1, 11)],
                                 "flow_id long, run_id string, start_time timestamp")
    kept = retained(runs, dt.datetime(2025, 1, 10), days=5, max_rows=3)
    assert sorted(r.run_id for r in kept.collect()) == ["r10", "r8", "r9"]


def test_full_loads_are_taken_in_by_the_first_upsert(spark, tmp_path):
    sink = TableSink(str(tmp_path / "t"))
    def run(strategy, run_id, *given):
        flow = FlowSpec(1, "f", strategy, "v", "NUMERIC", key=("k",))
        sink.write(spark.createDataFrame(list(given), "k int, v int"), flow, run_id)
        return sorted(map(tuple, sink.read(spark).collect()), key=repr)
    assert run(Strategy.FULL, "b", (1, 1), (2, 1), (None, 5)) == [(1, 1), (2, 1), (None, 5)]
    assert run(Strategy.FULL, "a", (2, 2), (3, 2)) == [(1, 1), (2, 1), (2, 2), (3, 2), (None, 5)]
    merged = [(1, 1), (2, 2), (3, 9), (4, 9), (None, 5)]
    assert run(Strategy.INCREMENTAL_ID, "c", (3, 9), (4, 9)) == merged
    assert not list((tmp_path / "t").glob("run_id=*"))
    # A run that died between its commit and the clearing leaves old loads behind: they are not taken in again.
    spark.createDataFrame([(1, 0)], "k int, v int").write.parquet(str(tmp_path / "t" / "run_id=dead"))
    assert run(Strategy.FULL, "d", (5, 1)) == merged[:-1] + [(5, 1), (None, 5)]
    assert run(Strategy.INCREMENTAL_ID, "e", (5, 2)) == merged[:-1] + [(5, 2), (None, 5)]
    assert not list((tmp_path / "t").glob("run_id=*"))


def test_partitioned_target_and_full_loads_do_not_mix(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x")], "k int, p string")
    sink = TableSink(str(tmp_path / "t"), partition="p")
    upsert, full = (FlowSpec(1, "f", s, key=("k",)) for s in (Strategy.SYNCED_SET, Strategy.FULL))
    sink.write(rows, upsert, "a")
    with pytest.raises(ValueError, match="kept by p"):
        sink.write(rows, full, "b")
    other = TableSink(str(tmp_path / "u"), partition="p")
    other.write(rows, full, "a")
    with pytest.raises(ValueError, match="full loads"):
        other.write(rows, upsert, "b")
