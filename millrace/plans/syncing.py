"""Synchronisation strategies end to end, through flows with their own state."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import sync
from millrace.engine import TableSink, run_flow
from millrace.operators import validate
from millrace.operators.sinks import read_appended
from millrace.operators.bucketed import BucketedTable
from millrace.plans.catalogue import middle, query
from millrace.plans.scans import TIME_MARK
from millrace.sources import tables
from millrace.spec import FlowSpec, Strategy
from millrace.state import RunLog, StateStore
from millrace.synced import SyncedBuckets
from millrace.workspace import materialise, scratch

CLOCK = dt.datetime(2025, 6, 1, 12, 0, 0)


@query("sync_full", "SELECT * FROM orders")
def sync_full(spark: SparkSession, d: str) -> DataFrame:
    root = scratch(spark, "sync-full")
    flow = FlowSpec(1, "orders in full", Strategy.FULL, key=("o_orderkey",))
    run_flow(spark, flow, tables.parquet(spark, d, "orders"), TableSink(f"{root}/target"),
             f"{root}/state", now=CLOCK)
    return read_appended(spark, f"{root}/target")


@query("hwm_numeric", """
SELECT CAST(max(o_orderkey) AS VARCHAR) AS mark FROM orders
WHERE o_orderkey > (SELECT (min(o_orderkey) + max(o_orderkey)) // 2 FROM orders)""")
def hwm_numeric(spark: SparkSession, d: str) -> DataFrame:
    orders = tables.parquet(spark, d, "orders")
    newer = sync.newer_by_id(orders, "o_orderkey", middle(orders, "o_orderkey"))
    return newer.agg(sync.high_water_mark("o_orderkey", "NUMERIC", compat=True).alias("mark"))


@query("hwm_time", f"""
SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS mark FROM events
WHERE ts >= TIMESTAMP '{TIME_MARK}'""")
def hwm_time(spark: SparkSession, d: str) -> DataFrame:
    newer = sync.newer_by_time(tables.parquet(spark, d, "events"), "ts", TIME_MARK)
    return newer.agg(F.max("ts").alias("m")).select(
        F.date_format("m", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("mark"))


@query("synced_anti", "SELECT * FROM orders WHERE o_orderstatus <> 'F'")
def synced_anti(spark: SparkSession, d: str) -> DataFrame:
    orders = tables.parquet(spark, d, "orders")
    synced = orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    return sync.not_synced(orders, synced, "o_orderkey")


@query("synced_union", """
SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderstatus = 'F'
UNION SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderpriority = '1-URGENT'""")
def synced_union(spark: SparkSession, d: str) -> DataFrame:
    orders = tables.parquet(spark, d, "orders")
    state = StateStore(spark, scratch(spark, "synced"))
    state.add_synced(7, orders.where("o_orderstatus = 'F'").select("o_orderkey"), "run1")
    state.add_synced(7, orders.where("o_orderpriority = '1-URGENT'").select("o_orderkey"), "run2")
    return state.synced_ids(7).distinct()


@query("synced_buckets", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'run1' WHEN o_orderpriority = '1-URGENT' THEN 'run2' ELSE 'run3' END AS run
FROM orders""")
def synced_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Three runs over growing parts of the orders; each takes what the set of ids does not hold yet."""
    orders = tables.parquet(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    synced, taken = SyncedBuckets(spark, scratch(spark, "synced"), buckets=8, compact_at=1), []
    for run, offered in enumerate(("o_orderstatus = 'F'", "o_orderstatus = 'F' OR o_orderpriority = '1-URGENT'", "true"), 1):
        fresh = materialise(synced.missing(orders.where(offered), "o_orderkey").select("o_orderkey", F.lit(f"run{run}").alias("run")), "taken")
        synced.add(fresh)
        taken.append(fresh)
    return taken[0].unionByName(taken[1]).unionByName(taken[2])


class CheckingSink:
    """A target that accepts only rows of a positive balance and says which it took."""

    def __init__(self, path: str):
        self.path = path

    def write(self, df: DataFrame, flow: FlowSpec, run_id: str) -> DataFrame:
        rules = [validate.check("no balance", F.col("c_acctbal") <= 0)]
        good, _ = validate.split_good_bad(validate.apply_rules(df, rules))
        good.write.mode("overwrite").parquet(self.path)
        return df.sparkSession.read.parquet(self.path).select(flow.key[0])


@query("sync_success_ids", "SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_acctbal > 0")
def sync_success_ids(spark: SparkSession, d: str) -> DataFrame:
    root = scratch(spark, "success")
    flow = FlowSpec(3, "customers once", Strategy.SYNCED_SET, key=("c_custkey",))
    run_flow(spark, flow, tables.parquet(spark, d, "customer"), CheckingSink(f"{root}/target"),
             f"{root}/state", now=CLOCK)
    return StateStore(spark, f"{root}/state").synced_ids(3)


@query("api_bookmark_filter", f"""
SELECT 'newer' AS case_name, event_id FROM events WHERE ts >= TIMESTAMP '{TIME_MARK}'
UNION ALL SELECT 'past the end', event_id FROM events""")
def api_bookmark_filter(spark: SparkSession, d: str) -> DataFrame:
    events = tables.parquet(spark, d, "events")
    newer = validate.api_bookmark_filter(events, "ts", TIME_MARK)
    late = validate.api_bookmark_filter(events, "ts", "2999-01-01 00:00:00", if_empty="keep")
    return newer.select(F.lit("newer").alias("case_name"), "event_id").unionByName(
        late.select(F.lit("past the end").alias("case_name"), "event_id"))


@query("two_run_converge", "SELECT * FROM orders")
def two_run_converge(spark: SparkSession, d: str) -> DataFrame:
    root = scratch(spark, "converge")
    orders = tables.parquet(spark, d, "orders")
    flow = FlowSpec(4, "orders by date", Strategy.INCREMENTAL_TIME, "o_orderdate", "DATETIME",
                    key=("o_orderkey",))
    sink = TableSink(f"{root}/target")
    early = orders.where(F.col("o_orderdate") <= F.lit("1998-01-01").cast("timestamp_ntz"))
    run_flow(spark, flow, early, sink, f"{root}/state", now=CLOCK)
    run_flow(spark, flow, orders, sink, f"{root}/state", now=CLOCK)
    return BucketedTable(spark, f"{root}/target").read()


def _in_two_runs(spark: SparkSession, rows: DataFrame, strategy: Strategy, column: str, first: str) -> DataFrame:
    """What the target holds after a run over the rows of ``first`` and one over all rows."""
    root = scratch(spark, "text-marks")
    flow = FlowSpec(31, "numbers as text", strategy, column, "NUMERIC", key=("id",))
    for run, offered in enumerate((rows.where(first), rows), 1):
        run_flow(spark, flow, offered.withColumn("run", F.lit(run)), TableSink(f"{root}/target"), f"{root}/state", now=CLOCK, run_id=f"run{run}")
    return TableSink(f"{root}/target").read(spark)


@query("incr_time_text", """
SELECT event_id AS id, CAST(event_id AS VARCHAR) AS at, CASE WHEN event_id < m AND NOT event_id = m - 1 THEN 1 ELSE 2 END AS run
FROM events, (SELECT max(event_id) // 2 AS m FROM events)""")
def incr_time_text(spark: SparkSession, d: str) -> DataFrame:
    """Moments kept as text of a number, as many digits as they need: the second run goes on behind the first."""
    events = tables.parquet(spark, d, "events").selectExpr("event_id AS id", "string(event_id) AS at")
    return _in_two_runs(spark, events, Strategy.INCREMENTAL_TIME, "at", f"id < {middle_of(events)}")


@query("incr_decimal_text", """
SELECT event_id AS id, '1.' || lpad(CAST(event_id AS VARCHAR), 20, '0') AS at, CASE WHEN event_id < m THEN 1 ELSE 2 END AS run
FROM events, (SELECT max(event_id) // 2 AS m FROM events)""")
def incr_decimal_text(spark: SparkSession, d: str) -> DataFrame:
    """Numbers as text that differ only in their 20th decimal."""
    events = tables.parquet(spark, d, "events").selectExpr("event_id AS id", "concat('1.', lpad(string(event_id), 20, '0')) AS at")
    return _in_two_runs(spark, events, Strategy.INCREMENTAL_ID, "at", f"id < {middle_of(events)}")


def middle_of(rows: DataFrame) -> int:
    return rows.selectExpr("max(id) div 2").first()[0]


@query("flow_strategy_change", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'full again' WHEN o_orderkey % 2 = 0 THEN 'newer' ELSE 'full' END AS told FROM orders""")
def flow_strategy_change(spark: SparkSession, d: str) -> DataFrame:
    """A target filled by two full loads, then by id, then in full once more, stays one table."""
    root = scratch(spark, "strategies")
    orders = tables.parquet(spark, d, "orders").select("o_orderkey")
    steps = [(Strategy.FULL, "o_orderkey % 5 = 0", "stale"), (Strategy.FULL, "true", "full"),
             (Strategy.INCREMENTAL_ID, "o_orderkey % 2 = 0", "newer"), (Strategy.FULL, "o_orderkey % 3 = 0", "full again")]
    sink = TableSink(f"{root}/target")
    for number, (strategy, rows, told) in enumerate(steps):
        flow = FlowSpec(32, "orders", strategy, "o_orderkey", "NUMERIC", key=("o_orderkey",))
        run_flow(spark, flow, orders.where(rows).withColumn("told", F.lit(told)), sink, f"{root}/state", now=CLOCK, run_id=f"run{number}")
    return sink.read(spark)


@query("runlog_latest", """
SELECT 'orders by status' AS flow_name, 'SUCCESS' AS status, count(*) AS read_count,
  count(*) AS write_count FROM orders WHERE o_orderstatus = 'P'""")
def runlog_latest(spark: SparkSession, d: str) -> DataFrame:
    root = scratch(spark, "runlog")
    orders = tables.parquet(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    flow = FlowSpec(5, "orders by status", Strategy.FULL, key=("o_orderkey",))
    for hour, status in enumerate(("F", "O", "P")):
        run_flow(spark, flow, orders.where(F.col("o_orderstatus") == status),
                 TableSink(f"{root}/target"), f"{root}/state", now=CLOCK + dt.timedelta(hours=hour))
    return RunLog(spark, f"{root}/state").latest(5).select(
        "flow_name", "status", "read_count", "write_count")


@query("run_counts", """
SELECT count(*) AS read_count, count(*) FILTER (WHERE o_orderstatus <> 'F') AS success_count,
  count(*) FILTER (WHERE o_orderstatus <> 'F') AS write_count, CAST(NULL AS VARCHAR) AS bookmark_before,
  CAST(max(o_orderkey) AS VARCHAR) AS bookmark_after FROM orders""")
def run_counts(spark: SparkSession, d: str) -> DataFrame:
    from millrace.spec import AFTER_READ, TEMPLATE, Registry, Stage, Step

    root = scratch(spark, "counts")
    flow = FlowSpec(6, "open orders", Strategy.INCREMENTAL_ID, "o_orderkey", "NUMERIC",
                    (Stage(AFTER_READ, "filter", (Step(TEMPLATE, "open"),)),), key=("o_orderkey",))
    registry = Registry(templates={"open": lambda df: df.where("o_orderstatus <> 'F'")})
    run_flow(spark, flow, tables.parquet(spark, d, "orders"), TableSink(f"{root}/target"),
             f"{root}/state", registry, now=CLOCK)
    return RunLog(spark, f"{root}/state").latest(6).select(
        "read_count", "success_count", "write_count", "bookmark_before", "bookmark_after")
