"""Whole flows: their outputs, specifications, readers, caps and resets."""

from __future__ import annotations

import datetime as dt
import json
import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import sync
from millrace.engine import TableSink, run_flow
from millrace.operators import json_ops, mapping, sinks, template, validate
from millrace.operators.bucketed import BucketedTable
from millrace.operators.xml_doc import CASE_FIELD, XmlField
from millrace.outputs import FILES, ApiSink, ArchiveSink
from millrace.plans.catalogue import middle, query
from millrace.plans.documents import CLOCK, archive_rows
from millrace.sources import tables
from millrace.sources.rest import Request, Response, write
from millrace.spec import FieldMapping, FlowSpec, Registry, Strategy
from millrace.state import SYNCED, RunLog, StateStore
from millrace.workspace import materialise, scratch


def answer(request: Request) -> Response:
    """An API that turns down negative balances at the first attempt."""
    refused = request.headers["attempt"] == "1" and float(json.loads(request.body)["c_acctbal"]) < 0
    return Response(500 if refused else 200, "")


@query("flow_push", """
SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_acctbal < 0 THEN 'run2' ELSE 'run1' END AS run_id FROM customer""")
def flow_push(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose call failed are sent again by the next run, and only those."""
    root = scratch(spark, "flow-push")
    customers = tables.parquet(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    flow = FlowSpec(20, "customers to an API", Strategy.SYNCED_SET, key=("c_custkey",))
    for attempt in ("1", "2"):
        sink = ApiSink(answer, "api://customers/${c_custkey}", headers={"attempt": attempt})
        run_flow(spark, flow, customers, sink, f"{root}/state", now=CLOCK, run_id=f"run{attempt}")
    return spark.read.schema(SYNCED).parquet(f"{root}/state/synced").select("id", "run_id")


@dataclass(frozen=True)
class IdempotentServer:
    """An API that keeps one result per idempotency key, below a shared folder, and breaks down once at ``breaks_at``."""

    root: str
    breaks_at: str

    def __call__(self, request: Request) -> Response:
        folder = self.root.removeprefix("file://")
        os.makedirs(folder, exist_ok=True)
        if request.url.endswith(f"/{self.breaks_at}") and not os.path.exists(f"{folder}/_broken"):
            open(f"{folder}/_broken", "w").close()
            raise ConnectionError("the server went away")
        place = f"{folder}/{request.headers['Idempotency-Key'].replace('/', '_').replace(':', '_')}.json"
        draft = f"{folder}/.{uuid.uuid4().hex}"
        with open(draft, "w", encoding="utf-8") as body:
            body.write(request.body)
        os.replace(draft, place)
        return Response(200, "")


@query("push_writer", """
SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, (SELECT count(*) FROM supplier) AS committed FROM supplier""")
def push_writer(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers to an API that breaks down in the middle of a task: the write is repeated, each row counts once."""
    root = scratch(spark, "push-writer")
    suppliers = tables.parquet(spark, d, "supplier").select("s_suppkey", "s_name")
    broken = suppliers.selectExpr("max(s_suppkey) div 2").first()[0]
    write(suppliers.repartition(4, "s_suppkey"), IdempotentServer(f"{root}/server", str(broken)), "s_suppkey", "api://suppliers/${s_suppkey}", "run1",
          attempts="1", commiturl="api://suppliers/done", headers={"Accept": "application/json"})
    kept = spark.read.schema("s_suppkey string, s_name string, rows bigint").json(f"{root}/server/*.json")
    done = kept.where("rows IS NOT NULL").select("rows").scalar()
    return kept.where("s_suppkey IS NOT NULL").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), done.alias("committed"))


_ARCHIVED = """
SELECT '{run}' AS run_id, CAST(o_orderkey AS VARCHAR) AS id, year(o_orderdate) || '-' || cat AS entity_class,
  CAST(row_number() OVER (PARTITION BY year(o_orderdate), cat ORDER BY o_orderkey) AS VARCHAR) AS case_no,
  {ok} AS ok, {ok} AS in_document, CASE WHEN NOT {ok} THEN 'no files' END AS error
FROM (SELECT *, CASE WHEN o_orderstatus = 'P' THEN 'P1' ELSE 'JX16' END AS cat FROM orders) WHERE {rows}"""


@query("flow_archive", _ARCHIVED.format(run="run1", ok="(o_orderstatus <> 'O')", rows="true") + " UNION ALL "
       + _ARCHIVED.format(run="run2", ok="true", rows="o_orderstatus = 'O'"))
def flow_archive(spark: SparkSession, d: str) -> DataFrame:
    """Records without files fail in the first run; the second archives them, and only them."""
    root = scratch(spark, "flow-archive")
    rows = archive_rows(spark, d)
    late = F.array(F.struct(F.lit("late.pdf"), F.lit("pdf"), F.lit(0), F.lit("")).cast(
        "struct<name:string,format:string,size:bigint,md5:string>")).cast(FILES)
    later = rows.withColumn("files", F.when(F.size("files") == 0, late).otherwise(F.col("files")))
    flow = FlowSpec(21, "orders to the archive", Strategy.SYNCED_SET, key=("o_orderkey",))
    sink = ArchiveSink(f"{root}/archive", fields=[XmlField(CASE_FIELD, (CASE_FIELD,))], run_time=CLOCK)
    for run, source in (("run1", rows), ("run2", later)):
        run_flow(spark, flow, source, sink, f"{root}/state", now=CLOCK, run_id=run)
    tag = F.concat(F.lit(f"<{CASE_FIELD}>"), F.col("case_no"), F.lit(f"</{CASE_FIELD}>"))
    return spark.read.parquet(f"{root}/archive").select(
        "run_id", "id", "entity_class", "case_no", "ok",
        F.coalesce(F.col("metadata_xml").contains(tag), F.lit(False)).alias("in_document"), "error")


PIPELINE = """
{"id": 22, "name": "orders by JSON", "syncStrategy": "INCREMENTAL_ID", "incrementalColumn": "o_orderkey",
 "incrementalColumnType": "NUMERIC", "key": ["o_orderkey"], "templateParams": {"low": 1, "tag": "flow"},
 "pipelineConfig": [
  {"position": "AFTER_READ", "name": "filter", "steps": [{"type": "TEMPLATE", "templateId": 1, "params": {"low": 100000}}]},
  {"position": "BEFORE_WRITE", "name": "shape", "steps": [
    {"type": "MAPPING", "mappingTemplateId": 2}, {"type": "TEMPLATE", "templateId": 3}]},
  {"position": "AFTER_WRITE", "name": "report", "steps": [{"type": "TEMPLATE", "templateId": 4}]}]}"""


@query("flow_pipeline", """
SELECT o_orderkey, o_orderstatus AS status, 'flow' AS tag, CAST(1 AS INTEGER) AS low, count(*) OVER (PARTITION BY o_orderstatus) AS reported
FROM orders WHERE o_totalprice >= 100000""")
def flow_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """A flow as JSON with steps at all three positions; a step's own parameters win over the flow's."""
    root = scratch(spark, "flow-json")

    def report(df: DataFrame, **params) -> DataFrame:
        counts = df.groupBy("status").agg(F.count("*").alias("reported"))
        counts.write.mode("overwrite").parquet(f"{root}/report")
        return df

    registry = Registry(
        templates={"1": lambda df, low: df.where(F.col("o_totalprice") >= low),
                   "3": lambda df, low, tag: df.select("o_orderkey", "status", F.lit(tag).alias("tag"), F.lit(low).alias("low")),
                   "4": report},
        mappings={"2": FieldMapping((("o_orderkey", "o_orderkey"), ("o_orderstatus", "status")))})
    run_flow(spark, FlowSpec.from_json(PIPELINE), tables.parquet(spark, d, "orders"), TableSink(f"{root}/target"),
             f"{root}/state", registry, now=CLOCK)
    return BucketedTable(spark, f"{root}/target").read().join(spark.read.parquet(f"{root}/report"), "status")


@query("flow_reader", """
WITH m AS (SELECT (min(o_orderkey) + max(o_orderkey)) // 2 AS half, max(o_orderkey) AS top FROM orders),
e AS (SELECT count(*) AS n, max(o_orderkey) AS mark FROM orders, m WHERE o_orderkey <= half)
SELECT 'run1' AS run_id, n AS read_count, CAST(NULL AS VARCHAR) AS bookmark_before, CAST(mark AS VARCHAR) AS bookmark_after FROM e
UNION ALL SELECT 'run2', (SELECT count(*) FROM orders) - n, CAST(mark AS VARCHAR), CAST(top AS VARCHAR) FROM e, m""")
def flow_reader(spark: SparkSession, d: str) -> DataFrame:
    """A reader function asks its source by the parameters of the strategy."""
    root = scratch(spark, "flow-reader")
    orders = tables.parquet(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    flow = FlowSpec(23, "orders by reader", Strategy.INCREMENTAL_ID, "o_orderkey", "NUMERIC", key=("o_orderkey",))

    def reading(rows: DataFrame):
        def read(strategy: Strategy, last: str | None) -> DataFrame:
            mark = sync.reader_options(strategy, flow.incremental_column, last).get("watermark_lastValue")
            return rows if mark is None else rows.where(F.col("o_orderkey") > int(mark))
        return read

    for run, rows in (("run1", orders.where(F.col("o_orderkey") <= middle(orders, "o_orderkey"))), ("run2", orders)):
        run_flow(spark, flow, reading(rows), TableSink(f"{root}/target"), f"{root}/state", now=CLOCK, run_id=run)
    return RunLog(spark, f"{root}/state").read(23).select("run_id", "read_count", "bookmark_before", "bookmark_after")


@query("flow_cap", """
SELECT 'run1' AS run_id, least(n, 1000) AS read_count, n >= 1000 AS warned FROM (SELECT count(*) AS n FROM orders)
UNION ALL SELECT 'run2', greatest(0, least(n - 1000, 1000)), n >= 2000 FROM (SELECT count(*) AS n FROM orders)""")
def flow_cap(spark: SparkSession, d: str) -> DataFrame:
    """A capped run warns when more may be waiting; the next one goes on from there."""
    root = scratch(spark, "flow-cap")
    flow = FlowSpec(24, "orders in slices", Strategy.INCREMENTAL_ID, "o_orderkey", "NUMERIC", key=("o_orderkey",), cap=1000)
    for run in ("run1", "run2"):
        run_flow(spark, flow, tables.parquet(spark, d, "orders"), TableSink(f"{root}/target"), f"{root}/state",
                 now=CLOCK, run_id=run)
    warned = F.exists("step_logs", lambda s: (s["level"] == "WARN") & s["message"].contains("cap"))
    return RunLog(spark, f"{root}/state").read(24).select("run_id", "read_count", warned.alias("warned"))


@query("flow_reset", """
SELECT r AS run_id, CASE WHEN r = 'again' THEN 0 ELSE (SELECT count(*) FROM customer) END AS read_count
FROM (VALUES ('first'), ('again'), ('reset')) AS t(r)""")
def flow_reset(spark: SparkSession, d: str) -> DataFrame:
    """A repeated run finds nothing new; after a reset all rows are new."""
    root = scratch(spark, "flow-reset")
    flow = FlowSpec(25, "customers once", Strategy.SYNCED_SET, key=("c_custkey",))
    for i, run in enumerate(("first", "again", "reset")):
        if run == "reset":
            StateStore(spark, f"{root}/state").reset(25, CLOCK + dt.timedelta(minutes=i))
        run_flow(spark, flow, tables.parquet(spark, d, "customer"), TableSink(f"{root}/target"), f"{root}/state",
                 now=CLOCK + dt.timedelta(minutes=i), run_id=run)
    return RunLog(spark, f"{root}/state").read(25).select("run_id", "read_count")


@query("keep_simple", "SELECT c_custkey, c_name FROM customer")
def keep_simple(spark: SparkSession, d: str) -> DataFrame:
    customers = tables.parquet(spark, d, "customer")
    return mapping.keep_simple(customers.select(
        "c_custkey", "c_name", F.array("c_name").alias("names"), F.struct("c_name").alias("inner")))


@query("filter_deleted", "SELECT c_custkey FROM customer WHERE c_acctbal >= 0 OR c_mktsegment = 'BUILDING'")
def filter_deleted(spark: SparkSession, d: str) -> DataFrame:
    """Rows marked as deleted go; a row without a mark stays."""
    marked = tables.parquet(spark, d, "customer").withColumn(
        "deleted", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal") < 0))
    return marked.where(~F.coalesce("deleted", F.lit(False))).select("c_custkey")


@query("column_guard", """
SELECT name, CASE WHEN name = 'o_orderkey' THEN (SELECT count(*) FROM orders WHERE o_orderkey > 100) END AS newer
FROM (VALUES ('o_orderkey'), ('o_orderkey OR 1=1'), ('absent')) AS t(name)""")
def column_guard(spark: SparkSession, d: str) -> DataFrame:
    """An incremental column must be a plain name that the source has."""
    orders = tables.parquet(spark, d, "orders")

    def newer(name: str) -> DataFrame:
        try:
            rows = sync.newer_by_id(orders, name, "100")
        except ValueError:
            return spark.range(0, 1, 1, 1).select(F.lit(name).alias("name"), F.lit(None).cast("bigint").alias("newer"))
        return rows.agg(F.count("*").alias("newer")).select(F.lit(name).alias("name"), "newer")

    return newer("o_orderkey").unionByName(newer("o_orderkey OR 1=1")).unionByName(newer("absent"))


@query("require_field", "SELECT c_custkey, c_name FROM customer WHERE c_name IS NOT NULL")
def require_field(spark: SparkSession, d: str) -> DataFrame:
    """Every row has the field, so none stops the job."""
    return validate.require_or_fail(tables.parquet(spark, d, "customer").select("c_custkey", "c_name"), "c_name")


def size_label(row: dict, params: dict) -> dict:
    if row["o_totalprice"] < params["low"]:
        raise ValueError("too small")
    return {**row, "label": f"order {row['o_orderkey']}"}


@query("error_policy", """
SELECT o_orderkey, CASE WHEN o_totalprice >= 50000 THEN 'order ' || o_orderkey END AS label,
  CASE WHEN o_totalprice < 50000 THEN 'ValueError: too small' END AS error FROM orders""")
def error_policy(spark: SparkSession, d: str) -> DataFrame:
    """A row on which a row function fails passes on as it was, with the reason."""
    schema = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("label", T.StringType())])
    orders = tables.parquet(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("double"))
    out = materialise(template.row_template(orders, size_label, schema, {"low": 50000}, "keep_input"), "labelled")
    return out.select("o_orderkey", "label", F.col(template.ERROR_COLUMN).alias("error"))


@query("file_output", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def file_output(spark: SparkSession, d: str) -> DataFrame:
    """CSV files of at most 1,000 rows, read back."""
    path = scratch(spark, "csv")
    orders = tables.parquet(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    sinks.write_files(orders, path, "csv", 1000, header="true")
    return spark.read.schema(orders.schema).csv(path, header=True)


@query("binary_scan", """
SELECT 'pdf' AS format, CAST(length(n_name) + 1 AS BIGINT) AS size, md5(n_name || chr(10)) AS digest FROM nation""")
def binary_scan(spark: SparkSession, d: str) -> DataFrame:
    """One text file per nation, read as binary files; a suffix that is no document format counts as pdf."""
    path = scratch(spark, "files")
    tables.parquet(spark, d, "nation").select("n_nationkey", "n_name").write.partitionBy("n_nationkey").text(path)
    return tables.binary_files(spark, path, "*.txt").select("format", "size", F.md5("content").alias("digest"))


@query("import_collection", """
WITH i AS (SELECT c_custkey, c_mktsegment, unnest(range(0, 1 + CAST(c_custkey % 2 AS BIGINT))) AS item_no FROM customer)
SELECT c_custkey, CAST(item_no AS INTEGER) AS item_no, CAST(0 AS INTEGER) AS response_no, 'id' AS "key", CAST(c_custkey AS VARCHAR) AS "value" FROM i
UNION ALL SELECT c_custkey, CAST(item_no AS INTEGER), CAST(0 AS INTEGER), 'tags[0]', c_mktsegment FROM i""")
def import_collection(spark: SparkSession, d: str) -> DataFrame:
    """Example responses of a request collection, one or two requests per document."""
    customers = tables.parquet(spark, d, "customer")
    body = F.to_json(F.struct(F.col("c_custkey").alias("id"), F.array("c_mktsegment").alias("tags")))
    item = F.struct(F.array(F.struct(body.alias("body"))).alias("response"))
    items = F.array_repeat(item, (1 + F.col("c_custkey") % 2).cast("int"))
    documents = customers.select("c_custkey", F.to_json(F.struct(items.alias("item"))).alias("document"))
    return json_ops.import_collection(documents, "document", ["c_custkey"])


@query("file_by_bytes", """
SELECT fmt, o_orderkey, o_clerk, true AS within FROM (
  SELECT o_orderkey, 'clerk-' || repeat('é', CAST(o_orderkey % 50 AS INTEGER)) AS o_clerk FROM orders), (SELECT unnest(['csv', 'json']) AS fmt)""")
def file_by_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Orders in files of at most 10,000 bytes, as CSV and JSON; each row says whether its file kept the limit."""
    root = scratch(spark, "by-bytes")
    clerk = F.concat(F.lit("clerk-"), F.repeat(F.lit("é"), F.expr("int(o_orderkey % 50)")))
    orders = tables.parquet(spark, d, "orders").select("o_orderkey", clerk.alias("o_clerk"))
    read = []
    for fmt, options in (("csv", {"header": "true"}), ("json", {})):
        sinks.write_files(orders, f"{root}/{fmt}", fmt, max_bytes_per_file=10_000, order=[F.col("o_orderkey")], **options)
        rows = spark.read.schema(orders.schema).options(**options).format(fmt).load(f"{root}/{fmt}")
        read.append(rows.select(F.lit(fmt).alias("fmt"), "o_orderkey", "o_clerk", (F.col("_metadata.file_size") <= 10_000).alias("within")))
    return read[0].unionByName(read[1])
