"""Recurrent runs as streams over arriving files."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.bucketed import BucketedTable
from millrace.plans.bodies import body_of, write_bodies
from millrace.plans.catalogue import query
from millrace.sources import rest, tables
from millrace.sources.rest import Request, Response
from millrace.streaming import incremental
from millrace.workspace import scratch


def arriving_events(spark: SparkSession, d: str, root: str):
    """The events in two deliveries; gives a function that delivers the next one."""
    events = tables.parquet(spark, d, "events")
    deliveries = iter([events.where("ts < TIMESTAMP_NTZ '2024-01-16 00:00:00'"),
                       events.where("ts >= TIMESTAMP_NTZ '2024-01-10 00:00:00'")])

    def deliver() -> None:
        next(deliveries).write.mode("append").parquet(f"{root}/in")

    return events.schema, deliver


@query("stream_upsert", """
SELECT user_id, event_id, ts, event_type, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Last event per user, kept up to date by two runs; the second delivery repeats rows."""
    root = scratch(spark, "stream")
    schema, deliver = arriving_events(spark, d, root)
    for _ in range(2):
        deliver()
        stream = incremental.file_stream(spark, f"{root}/in", schema)
        incremental.stream_upsert(spark, stream, f"{root}/target", f"{root}/checkpoint", ["user_id"], ["ts", "event_id"],
                                  lambda df: df.drop("props"))
    return BucketedTable(spark, f"{root}/target").read()


@query("stream_synced", "SELECT event_id, user_id, event_type, value, ts FROM events")
def stream_synced(spark: SparkSession, d: str) -> DataFrame:
    """Each event once, although the second delivery repeats some."""
    root = scratch(spark, "stream")
    schema, deliver = arriving_events(spark, d, root)
    for _ in range(2):
        deliver()
        stream = incremental.file_stream(spark, f"{root}/in", schema)
        incremental.stream_not_synced(spark, stream, f"{root}/target", f"{root}/checkpoint", "event_id", ["ts"], schema)
    return spark.read.parquet(f"{root}/target").select("event_id", "user_id", "event_type", "value", "ts")


@dataclass(frozen=True)
class PageFolder:
    """An API over the bodies of pages; a page past the end is an empty list."""

    root: str

    def __call__(self, request: Request) -> Response:
        number = re.search(r"page=(\d+)", request.url).group(1)
        body = body_of(self.root, int(number))
        return Response(200, json.dumps({"items": []}) if body is None else body)


@query("stream_rest", "SELECT page_id, url, CAST(page_id AS BIGINT) AS position FROM pages")
def stream_rest(spark: SparkSession, d: str) -> DataFrame:
    """A list of 20 items a page, read in two runs; in between, its last page fills up and others follow."""
    root = scratch(spark, "stream-rest")
    listed = tables.parquet(spark, d, "pages").select("page_id", "url")
    half = listed.selectExpr("max(page_id) div 2").first()[0]
    for delivery in (listed.where(F.col("page_id") <= half), listed):
        write_bodies(delivery, F.expr("page_id div 20"), F.struct("page_id", "url"), f"{root}/api")
        stream = rest.read_stream(spark, PageFolder(f"{root}/api"), "api://pages?page={{page}}&size={{size}}", paging="page",
                                  pagesize="20", firstpage="0", itemspath="items", callspertask="2")
        query_ = (stream.writeStream.format("parquet").option("path", f"{root}/read").option("checkpointLocation", f"{root}/checkpoint")
                  .trigger(availableNow=True).start())
        query_.awaitTermination()
    fields = F.from_json("item", "page_id bigint, url string")
    return spark.read.parquet(f"{root}/read").select(fields["page_id"].alias("page_id"), fields["url"].alias("url"), "position")


@query("stream_synced_state", "SELECT event_id, user_id, event_type, value, ts FROM events")
def stream_synced_state(spark: SparkSession, d: str) -> DataFrame:
    """Each event once, although the second delivery repeats some; seen ids are keyed state of 30 days."""
    root = scratch(spark, "stream")
    schema, deliver = arriving_events(spark, d, root)
    for _ in range(2):
        deliver()
        stream = incremental.file_stream(spark, f"{root}/in", schema)
        incremental.stream_synced_state(spark, stream, f"{root}/target", f"{root}/checkpoint", "event_id", ["ts"], 30 * 24 * 3600 * 1000)
    return spark.read.parquet(f"{root}/target").select("event_id", "user_id", "event_type", "value", "ts")


@query("stream_drop_duplicates", "SELECT event_id, user_id, event_type, value, ts FROM events")
def stream_drop_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """The same with ids remembered for 30 days of event time."""
    root = scratch(spark, "stream")
    schema, deliver = arriving_events(spark, d, root)
    for _ in range(2):
        deliver()
        # Watermarks are moments: the table's times are read in the session's zone.
        stream = incremental.file_stream(spark, f"{root}/in", schema).withColumn("at", F.col("ts").cast("timestamp"))
        once = incremental.stream_drop_duplicates(stream, "event_id", "at", "30 days")
        (once.writeStream.format("parquet").option("path", f"{root}/target").option("checkpointLocation", f"{root}/checkpoint")
         .trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(f"{root}/target").select("event_id", "user_id", "event_type", "value", "ts")
