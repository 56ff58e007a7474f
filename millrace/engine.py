"""Run one flow: read, shape, write, remember."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from millrace.operators.sinks import append, read_appended
from millrace.operators.bucketed import BucketedTable
from millrace.operators.upsert import KEEP_TARGET_ON_NULL, dedupe_last, has_key, upsert_touched_partitions
from millrace.spec import AFTER_WRITE, FlowSpec, Registry, Strategy
from millrace.state import RunLog, StateStore
from millrace.sync import next_bookmark, incremental, not_synced
from millrace.synced import SyncedBuckets
from millrace.workspace import folders, materialise, path_exists, remove_path

Reader = Callable[[Strategy, "str | None"], DataFrame]


class Sink(Protocol):
    def write(self, df: DataFrame, flow: FlowSpec, run_id: str) -> DataFrame | None:
        """Write the frame; give the keys of the rows that succeeded, or None when all did."""


@dataclass
class TableSink:
    """Parquet target of all strategies: FULL appends, every other one upserts and keeps values on null.

    One path is one table. A target that has only taken full loads holds them side by side; the first upsert
    takes them in, of each key the row of the newest load, and from then on it is a keyed table, into which a full
    load is merged like any batch. With ``partition``, a column that follows from the key, an upsert rewrites
    only the partitions it touches, and such a target takes no full loads; without it, only the
    key-hash buckets it touches. ``read`` gives the table whichever way it is kept.
    """

    path: str
    nulls: str = KEEP_TARGET_ON_NULL
    partition: str | None = None
    appends_in_one_pass = True

    def _full_loads(self, spark: SparkSession) -> list[str]:
        return folders(spark, f"{self.path}/run_id=*")

    def _keyed(self, spark: SparkSession) -> bool:
        return path_exists(spark, f"{self.path}/commits")

    def write(self, df: DataFrame, flow: FlowSpec, run_id: str) -> None:
        spark = df.sparkSession
        keyed = self._keyed(spark)
        if flow.strategy is Strategy.FULL and not keyed:
            if self.partition and folders(spark, f"{self.path}/{self.partition}=*"):
                raise ValueError(f"{self.path} is kept by {self.partition}; a full load cannot be put beside it")
            append(df, self.path, run_id)
            return
        loads = self._full_loads(spark)
        if self.partition and not keyed:
            if loads:
                raise ValueError(f"{self.path} holds full loads; it cannot be kept by {self.partition}")
            upsert_touched_partitions(spark, self.path, df, flow.key, self.partition, flow.sequence, self.nulls)
            return
        table = BucketedTable(spark, self.path)
        if loads and not keyed:
            table.upsert(self._settled(spark, flow), f"{run_id}-loads", flow.key, nulls=self.nulls)
        for load in loads:  # the rows are in the table, or were before a run died here
            remove_path(spark, load)
        table.upsert(df, run_id, flow.key, flow.sequence, self.nulls, stored=flow.strategy is not Strategy.FULL)

    def _settled(self, spark: SparkSession, flow: FlowSpec) -> DataFrame:
        """Of all full loads, the newest row of each key, and every row without a key."""
        rows = spark.read.option("mergeSchema", "true").parquet(self.path).withColumn("_loaded", F.col("_metadata.file_modification_time"))
        named = has_key(flow.key)
        newest = [F.desc("_loaded"), F.desc("run_id"), *[F.desc(c) for c in flow.sequence]]
        settled = dedupe_last(rows.where(named), flow.key, newest) if flow.key else rows.limit(0)
        return settled.unionByName(rows.where(~named) if flow.key else rows).drop("_loaded", "run_id")

    def read(self, spark: SparkSession) -> DataFrame:
        """The rows of the target."""
        return BucketedTable(spark, self.path).read() if self._keyed(spark) else read_appended(spark, self.path)


@dataclass(frozen=True)
class RunResult:
    run_id: str
    read_count: int
    success_count: int
    write_count: int
    bookmark_before: str | None
    bookmark_after: str | None
    messages: tuple[str, ...]


def _reads_once(sink: Sink, flow: FlowSpec) -> bool:
    """Whether the sink needs a single pass, so that the shaped rows need not be stored first."""
    return flow.strategy is Strategy.FULL and getattr(sink, "appends_in_one_pass", False)


def run_flow(
    spark: SparkSession,
    flow: FlowSpec,
    source: DataFrame | Reader,
    sink: Sink,
    state_root: str,
    registry: Registry | None = None,
    callbacks: Sequence[Callable[[DataFrame], None]] = (),
    now: dt.datetime | None = None,
    run_id: str | None = None,
    synced: SyncedBuckets | None = None,
) -> RunResult:
    """Read by strategy, apply the stages as one plan, write, then save state and log the run.

    A reader function is called once and its rows are stored, so an API is not asked
    twice. Row count and next bookmark come from one narrow aggregate over the source
    rows, before the stages run; the count after the stages is observed during the write.
    A full load that only appends goes straight to its sink; other shaped rows are stored
    first, because an upsert, state and later steps read them again.
    ``synced`` keeps the ids of a synced set in buckets instead of the state folder.
    Any failure fails the run and leaves bookmark and synced ids untouched.
    """
    registry = registry or Registry()
    run_id = run_id or uuid.uuid4().hex
    started = now or dt.datetime.now()
    state, log = StateStore(spark, state_root), RunLog(spark, state_root)
    notes: list[tuple[dt.datetime, str, str]] = []

    def note(level: str, message: str) -> None:
        notes.append((dt.datetime.now(), level, message))

    entry = {"flow_id": flow.flow_id, "run_id": run_id, "flow_name": flow.name,
             "strategy": flow.strategy.name, "start_time": started}

    def finish(status: str, **values) -> None:
        ended = dt.datetime.now()
        spent = int((ended - started).total_seconds() * 1000) if now is None else 0
        log.write(**entry, **values, status=status, end_time=ended, duration_ms=spent, step_logs=notes)

    try:
        before = state.load(flow.flow_id)
        column = flow.incremental_column
        rows = materialise(source(flow.strategy, before.last_value), "read") if callable(source) else source
        if flow.strategy is Strategy.SYNCED_SET:
            bucketed = synced.at(before.epoch) if synced else None
            fresh = (bucketed.missing(rows, flow.key[0]) if bucketed
                     else not_synced(rows, state.synced_ids(flow.flow_id), flow.key[0]))
            rows = materialise(fresh, "fresh")  # the costly anti join runs once, for count and stages
        rows = incremental(rows, flow.strategy, column, before.last_value, flow.cap, flow.key[0], flow.incremental_type)
        tracked = flow.strategy in (Strategy.INCREMENTAL_ID, Strategy.INCREMENTAL_TIME) and column
        mark = next_bookmark(rows, column, flow.incremental_type) if tracked else F.lit(None).cast("string")
        read = rows.agg(F.count(F.lit(1)).alias("rows"), mark.alias("mark")).first()
        for step in flow.compile(registry):
            rows = rows.transform(step)
        shaped = Observation()
        rows = rows.observe(shaped, F.count(F.lit(1)).alias("rows"))
        after_write = flow.compile(registry, (AFTER_WRITE,))
        once = _reads_once(sink, flow) and not after_write and not callbacks
        if once:
            sink.write(rows, flow, run_id)
        else:
            rows = materialise(rows, "batch")
        read_count, write_count = read["rows"], shaped.get["rows"]
        note("INFO", f"read {read_count} rows, {write_count} after the stages")
        if flow.cap and read_count >= flow.cap:
            note("WARN", f"read reached the cap of {flow.cap} rows; more may be waiting")

        succeeded = sink.write(rows, flow, run_id) if write_count and not once else None
        after, failed = None, 0
        if flow.strategy is Strategy.SYNCED_SET and write_count:
            ids = rows.select(flow.key[0]) if succeeded is None else succeeded
            if bucketed:
                bucketed.add(ids)
            else:
                state.add_synced(flow.flow_id, ids, run_id)
        if succeeded is not None:
            done = succeeded.count()
            failed, write_count = write_count - done, done
        if failed:
            note("WARN", f"{failed} rows failed at the target")
        if tracked and failed:
            note("WARN", "the bookmark stays, so that the failed rows are read again")
        elif tracked:
            after = read["mark"]
            if after is None:
                note("WARN", f"no value of {column} was read; the bookmark stays")
            else:
                state.save(before, flow.name, flow.strategy.name, column, after, started, write_count)
        for step in after_write:
            step(rows).write.format("noop").mode("overwrite").save()
        for callback in callbacks:
            callback(rows)
        finish("SUCCESS", read_count=read_count, success_count=shaped.get["rows"],
               write_count=write_count, fail_count=failed, bookmark_before=before.last_value,
               bookmark_after=after)
    except Exception as problem:
        finish("FAILED", read_count=0, success_count=0, write_count=0, fail_count=0,
               error_message=str(problem))
        raise
    return RunResult(run_id, read_count, shaped.get["rows"], write_count, before.last_value, after,
                     tuple(f"{level} {message}" for _, level, message in notes))
