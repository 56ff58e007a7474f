"""Outputs of a flow other than tables: calls of an API, and archive records."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import xml_doc
from millrace.operators.numbering import case_numbers
from millrace.operators.sinks import append
from millrace.sources.rest import Transport, push
from millrace.spec import FlowSpec
from millrace.workspace import materialise

FILES = "array<struct<name:string,format:string,size:bigint,md5:string>>"


@dataclass
class ApiSink:
    """One call per row. The answers are stored, so that nothing that reads them calls again.

    Gives the keys of the rows whose call succeeded.
    """

    transport: Transport
    url: str
    method: str = "POST"
    headers: Mapping[str, str] = field(default_factory=dict)
    auth: str = "NONE"
    auth_config: Mapping[str, str] = field(default_factory=dict)

    def write(self, df: DataFrame, flow: FlowSpec, run_id: str) -> DataFrame:
        answers = materialise(push(df, self.transport, flow.key[0], self.url, self.method, self.headers,
                                   self.auth, self.auth_config), "answers")
        return answers.where("ok").select(F.col("key").alias(flow.key[0]))


@dataclass
class ArchiveSink:
    """Archive records: case numbers, metadata documents that hold them, and a manifest row each.

    Numbers run per entity class and start at 1 in every run; they are given before any row is
    skipped. A row whose enrichment failed, without an id or without files is kept in the manifest
    with the reason. Gives the keys of the records that are complete.
    """

    path: str
    files: str = "files"
    fields: Sequence[xml_doc.XmlField] | None = None
    institution: str = ""
    run_time: dt.datetime | None = None
    failed: str = "_enrichmentFailed"

    def write(self, df: DataFrame, flow: FlowSpec, run_id: str) -> DataFrame:
        now = self.run_time or dt.datetime.now()
        key = flow.key[0]
        classed = df.withColumn("_class", xml_doc.entity_class(df, now.date()))
        rows = case_numbers(classed, "_class", list(flow.sequence or flow.key), xml_doc.CASE_FIELD)
        files = F.coalesce(F.col(f"`{self.files}`"), F.array().cast(FILES))
        failed = F.lit(False)
        if self.failed in df.columns:
            failed = F.coalesce(F.lower(F.col(f"`{self.failed}`").cast("string")), F.lit("false")) != "false"
        manifest = xml_doc.archive_manifest(
            rows, F.col(f"`{key}`").cast("string"), files, F.col("_class"), F.col(xml_doc.CASE_FIELD),
            xml_doc.metadata_xml(rows, files, now, self.fields, self.institution), failed)
        append(manifest, self.path, run_id)
        written = df.sparkSession.read.schema(manifest.schema.add("run_id", "string")).parquet(self.path)
        return written.where((F.col("run_id") == run_id) & F.col("ok")).select(F.col("id").alias(key))
