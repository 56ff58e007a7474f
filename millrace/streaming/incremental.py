"""New files only: the checkpoint takes the place of the bookmark."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from millrace.operators.bucketed import BucketedTable
from millrace.operators.sinks import append
from millrace.operators.upsert import (
    OVERWRITE,
    dedupe_last,
    upsert_touched_partitions,
)
from millrace.workspace import read_if_present

Shape = Callable[[DataFrame], DataFrame]


def file_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def run_available(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process what has arrived since the last call, then stop."""
    query = (stream.writeStream.option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).foreachBatch(handle).start())
    query.awaitTermination()


def stream_upsert(spark: SparkSession, stream: DataFrame, target: str, checkpoint: str,
                  key: Sequence[str], seq: Sequence[str], shape: Shape | None = None,
                  nulls: str = OVERWRITE, partition: str | None = None) -> None:
    """Upsert every micro-batch. A batch repeated after a failure gives the same table.

    With ``partition``, a column that follows from the key, only the partitions a batch
    touches are rewritten; without it, only the key-hash buckets it touches.
    """
    table = BucketedTable(spark, target)

    def handle(batch: DataFrame, number: int) -> None:
        rows = shape(batch) if shape else batch
        if partition:
            upsert_touched_partitions(spark, target, rows, key, partition, seq, nulls)
        else:
            table.upsert(rows, f"batch{number}", key, seq, nulls)

    run_available(stream, handle, checkpoint)


def stream_not_synced(spark: SparkSession, stream: DataFrame, target: str, checkpoint: str, key: str,
                      seq: Sequence[str], schema: T.StructType) -> None:
    """Append only the first row of each id that the target has not seen, and every row without an id.

    The batch number names the appended part, and the part of a repeated batch is left
    out of what counts as seen, so repeating a batch writes the same rows again in place.
    """
    stored = T.StructType([*schema.fields, T.StructField("run_id", T.StringType())])

    def handle(batch: DataFrame, number: int) -> None:
        run_id = f"batch{number:012d}"
        named = F.col(key).isNotNull()
        fresh = dedupe_last(batch.where(named), [key], [F.asc(s) for s in seq])
        seen = read_if_present(spark, target, stored).where(F.col("run_id") < run_id).select(key)
        append(fresh.join(seen, key, "left_anti").unionByName(batch.where(~named)), target, run_id)

    run_available(stream, handle, checkpoint)


def stream_drop_duplicates(stream: DataFrame, key: str, event_time: str, delay: str) -> DataFrame:
    """Bounded state: an id is remembered for ``delay`` of event time."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


class FirstOfEach(StatefulProcessor):
    """The first row of each id, by ``seq``; later rows of it go until ``remember_ms`` have passed since.

    Rows come by buckets of ids, whose state is the ids taken by each batch with its time, so that state is asked for
    and written once a bucket, not once an id. ``name`` is the column with the id as text, null for a row without one.
    """

    def __init__(self, name: str, seq: Sequence[str], remember_ms: int):
        self.name, self.seq, self.remember_ms = name, list(seq), remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "batches array<struct<at: bigint, ids: array<string>>>", self.remember_ms)

    def place(self, row: Row) -> list[tuple]:
        return [(row[name] is not None, row[name]) if row[name] is not None else (False,) for name in self.seq]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now, held = timerValues.getCurrentProcessingTimeInMs(), self.seen.get()
        batches = [(at, ids) for at, ids in (held[0] if held else ()) if now < at + self.remember_ms]
        known = {name for _, ids in batches for name in ids}
        first: dict[str, tuple[list, Row]] = {}
        for row in rows:
            name = row[self.name]
            if name is None:
                yield row
            elif name not in known:
                place = self.place(row)
                if name not in first or place < first[name][0]:
                    first[name] = place, row
        if first:
            self.seen.update(([*batches, (now, list(first))],))
        for _, row in first.values():
            yield row

    def close(self) -> None:
        """Nothing is held but the state."""


#: Ids and rows without an id are dealt to as many buckets. A bucket's state is rewritten when it takes an id, so they
#: are many; the number is part of the checkpoint.
_BUCKETS = 1 << 14


def _as_text(df: DataFrame, key: str) -> Column:
    """A key as text, the same for equal keys only."""
    kind, value = df.schema[key].dataType, F.col(f"`{key}`")
    if isinstance(kind, (T.StringType, T.IntegralType)):
        return value.cast("string")
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        value = value + F.lit(0.0)  # there are two zeros
    form = {"timeZone": "UTC", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    return F.when(value.isNotNull(), F.to_json(F.struct(value.alias("id")), form))


#: Keyed state lies in RocksDB. Batches without rows are off: state that expires by the clock would ask for them without end.
_STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


@contextmanager
def _keyed_state(spark: SparkSession):
    before = {name: spark.conf.get(name) for name in _STATE_SETTINGS}
    try:
        for name, value in _STATE_SETTINGS.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def stream_synced_state(spark: SparkSession, stream: DataFrame, target: str, checkpoint: str, key: str,
                        seq: Sequence[str], remember_ms: int) -> None:
    """Append only the first row of each id, and every row without an id; no batch reads the target.

    Seen ids are keyed state, by buckets, kept with the checkpoint and forgotten ``remember_ms`` after they came in:
    state is bounded by the ids of that span, not by the target, and a batch reads and writes that of the buckets its
    ids fall into. No row is late: an id that comes again after the span is taken once more. The file sink writes each micro-batch once.
    """
    bucket, name = ("_" * max(map(len, stream.columns)) + end for end in ("_bucket", "_name"))
    named = stream.withColumn(name, _as_text(stream, key))
    place = F.when(F.col(name).isNull(), F.xxhash64(*stream.columns)).otherwise(F.xxhash64(name))
    dealt = named.withColumn(bucket, F.pmod(place, F.lit(_BUCKETS)))
    with _keyed_state(spark):
        first = dealt.groupBy(bucket).transformWithState(FirstOfEach(name, seq, remember_ms), dealt.schema, "append", "processingTime")
        (first.drop(bucket, name).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start().awaitTermination())
