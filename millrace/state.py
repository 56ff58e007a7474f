"""What a flow remembers between runs: bookmark, synced ids, run log.

All three are append-only tables in the shared folder. A row becomes visible when
Spark commits its file, so a run that dies leaves the state as it was; a reset starts a
new epoch instead of deleting files.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.workspace import flat_schema, one_row, read_if_present

BOOKMARKS = flat_schema(
    flow_id="bigint", seq="bigint", epoch="bigint", flow_name="string", strategy="string",
    incremental_column="string", last_value="string", last_exec_time="timestamp",
    last_exec_status="string", total_synced="bigint")
SYNCED = flat_schema(id="string", flow_id="bigint", epoch="bigint", run_id="string")
STEP_LOG = flat_schema(timestamp="timestamp", level="string", message="string")
RUNS = flat_schema(
    flow_id="bigint", run_id="string", flow_name="string", strategy="string", start_time="timestamp",
    end_time="timestamp", duration_ms="bigint", status="string", read_count="bigint",
    success_count="bigint", write_count="bigint", fail_count="bigint", bookmark_before="string",
    bookmark_after="string", error_message="string").add("step_logs", T.ArrayType(STEP_LOG))


@dataclass(frozen=True)
class Bookmark:
    flow_id: int
    seq: int
    epoch: int
    last_value: str | None


class StateStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _rows(self, flow_id: int) -> DataFrame:
        table = read_if_present(self.spark, f"{self.root}/bookmarks", BOOKMARKS)
        return table.where(F.col("flow_id") == flow_id)

    def load(self, flow_id: int, on_corrupt: str = "fail") -> Bookmark:
        """The newest bookmark; ``last_value`` is None on a first run and after a reset.

        State that cannot be read fails the run unless ``on_corrupt="full"`` asks for a
        full run instead.
        """
        try:
            newest = self._rows(flow_id).orderBy(F.desc("seq")).first()
        except (PySparkException, Py4JJavaError):
            if on_corrupt != "full":
                raise
            newest = None
        if newest is None:
            return Bookmark(flow_id, 0, 0, None)
        return Bookmark(flow_id, newest["seq"], newest["epoch"], newest["last_value"])

    def save(self, before: Bookmark, flow_name: str, strategy: str, column: str | None,
             last_value: str | None, at: dt.datetime, total: int, epoch: int | None = None) -> None:
        """Append the next bookmark. Called after the sink has committed."""
        row = (before.flow_id, before.seq + 1, before.epoch if epoch is None else epoch, flow_name,
               strategy, column, last_value, at, "SUCCESS", total)
        one_row(self.spark, BOOKMARKS, row).write.mode("append").parquet(f"{self.root}/bookmarks")

    def reset(self, flow_id: int, at: dt.datetime) -> None:
        """Forget bookmark and synced ids: the next run is a full one."""
        before = self.load(flow_id, on_corrupt="full")
        self.save(before, "", "RESET", None, None, at, 0, epoch=before.epoch + 1)

    def synced_ids(self, flow_id: int) -> DataFrame:
        epoch = self.load(flow_id).epoch
        table = read_if_present(self.spark, f"{self.root}/synced", SYNCED)
        return table.where((F.col("flow_id") == flow_id) & (F.col("epoch") == epoch)).select("id")

    def add_synced(self, flow_id: int, ids: DataFrame, run_id: str) -> None:
        """Add ids (one column). A repeated run replaces its own part."""
        rows = ids.select(F.col(ids.columns[0]).cast("string").alias("id")).where("id IS NOT NULL")
        (rows.distinct().withColumns({"flow_id": F.lit(flow_id).cast("bigint"),
                                      "epoch": F.lit(self.load(flow_id).epoch).cast("bigint"),
                                      "run_id": F.lit(run_id)})
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("flow_id", "epoch", "run_id").parquet(f"{self.root}/synced"))


class RunLog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.path = spark, f"{root.rstrip('/')}/runs"

    def write(self, **values) -> None:
        row = tuple(values.get(name) for name in RUNS.fieldNames())
        one_row(self.spark, RUNS, row).write.mode("append").parquet(self.path)

    def read(self, flow_id: int | None = None) -> DataFrame:
        """Runs, newest first."""
        table = read_if_present(self.spark, self.path, RUNS)
        if flow_id is not None:
            table = table.where(F.col("flow_id") == flow_id)
        return table.orderBy(F.desc("start_time"), F.desc("run_id"))

    def latest(self, flow_id: int) -> DataFrame:
        return self.read(flow_id).limit(1)

    def one(self, run_id: str) -> DataFrame:
        return read_if_present(self.spark, self.path, RUNS).where(F.col("run_id") == run_id)


def retained(runs: DataFrame, now: dt.datetime, days: int, max_rows: int) -> DataFrame:
    """Runs to keep: not older than ``days`` and among the newest ``max_rows`` of their flow."""
    order = W.partitionBy("flow_id").orderBy(F.desc("start_time"), F.desc("run_id"))
    young = runs.where(F.col("start_time") >= F.lit(now - dt.timedelta(days=days)))
    return young.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max_rows).drop("_n")
