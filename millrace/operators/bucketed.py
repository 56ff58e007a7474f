"""A parquet table in buckets by key hash, of which an upsert rewrites only those its batch touches."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.upsert import OVERWRITE, has_key, merge, row_hash, settle_batch
from millrace.workspace import flat_schema, materialise, read_if_present, remove_path

BUCKET = "_bucket"
#: Rows without a key never match, so they are only ever added, in a bucket of their own.
LOOSE = -1
_COMMITS = flat_schema(version="bigint", base="bigint", buckets="bigint", bucket="bigint", rows="bigint",
                       path="string", run_id="string", schema="string")


@dataclass(frozen=True)
class _State:
    version: int
    base: int
    buckets: int
    schema: T.StructType
    parts: dict[int, tuple[str, int]]
    loose: tuple[str, ...]

    @property
    def rows(self) -> int:
        return sum(rows for _, rows in self.parts.values())

    @property
    def folders(self) -> set[str]:
        return {f"{path}/{BUCKET}={b}" for b, (path, _) in self.parts.items()} | set(self.loose)


class BucketedTable:
    """A keyed table whose upserts read and write only the buckets that hold keys of the batch.

    Each version writes the touched buckets to a path of its own, then one file of commit rows
    names them; a bucket's newest commit counts. Readers see the old version until then, and a
    run that dies before its commit leaves no trace. One writer at a time. What only versions
    before the previous one used is deleted. The driver holds one entry per bucket. When the
    table outgrows its buckets, the next upsert deals all rows into four times as many, so
    that growing costs each row a bounded number of rewrites; results do not depend on it.
    """

    def __init__(self, spark: SparkSession, root: str, bucket_rows: int = 2_000_000):
        self.spark, self.root, self.bucket_rows = spark, root.rstrip("/"), bucket_rows

    def _state(self, upto: int | None = None) -> _State | None:
        commits = read_if_present(self.spark, f"{self.root}/commits", _COMMITS)
        if upto is not None:
            commits = commits.where(F.col("version") <= upto)
        head = commits.where("bucket IS NULL").agg(F.max(F.struct("version", "base", "buckets", "schema")).alias("h")).first()["h"]
        if head is None:
            return None
        newest = F.max_by(F.struct("path", "rows"), "version").alias("newest")
        alive = commits.where((F.col("version") >= head["base"]) & F.col("bucket").isNotNull())
        found = alive.groupBy("bucket").agg(newest, F.collect_list(F.when(F.col("bucket") == LOOSE, F.col("path"))).alias("all")).collect()
        parts = {r["bucket"]: tuple(r["newest"]) for r in found if r["bucket"] != LOOSE}
        loose = tuple(f"{path}/{BUCKET}={LOOSE}" for r in found for path in r["all"])
        return _State(head["version"], head["base"], head["buckets"],
                      T.StructType.fromJson(json.loads(head["schema"])), parts, loose)

    def _frame(self, state: _State, folders: Sequence[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], state.schema)
        return self.spark.read.schema(state.schema).parquet(*sorted(folders))

    def read(self) -> DataFrame | None:
        """The newest committed version, or None before the first."""
        state = self._state()
        return self._frame(state, list(state.folders)) if state else None

    def replace(self, df: DataFrame, run_id: str, key: Sequence[str]) -> None:
        """Put the rows in place of all there are; keys must be unique."""
        keyed = has_key(key)
        self._commit(df.where(keyed), df.where(~keyed), run_id, key, self._state(), self._wanted(df.count()), df.schema)

    def upsert(self, batch: DataFrame, run_id: str, key: Sequence[str], seq: Sequence[str] = (),
               nulls: str = OVERWRITE, stored: bool = False) -> None:
        """Merge a batch. It is read several times, so it is stored first unless it already is."""
        if not stored:
            batch = materialise(batch, "batch")
        state, size = self._state(), batch.count()
        if state is None:
            fresh, loose = settle_batch(batch, key, seq, nulls)
            self._commit(fresh, loose, run_id, key, None, self._wanted(size), batch.schema)
            return
        keyed = has_key(key)
        rows, loose = batch.where(keyed), batch.where(~keyed)
        if state.rows + size > 2 * state.buckets * self.bucket_rows:
            current = self._frame(state, [f"{path}/{BUCKET}={b}" for b, (path, _) in state.parts.items()])
            loose = self._frame(state, state.loose).unionByName(_typed(loose, state.schema))
            self._commit(merge(current, rows, key, seq, nulls), loose, run_id, key, state,
                         max(4 * state.buckets, self._wanted(state.rows + size)), state.schema)
            return
        touched = [r[0] for r in rows.select(_place(key, state.schema, state.buckets)).distinct().collect()]
        current = self._frame(state, [f"{state.parts[b][0]}/{BUCKET}={b}" for b in touched if b in state.parts])
        self._commit(merge(current, rows, key, seq, nulls), loose, run_id, key, state, None, state.schema)

    def _wanted(self, rows: int) -> int:
        return max(1, -(-rows // self.bucket_rows))

    def _commit(self, rows: DataFrame, loose: DataFrame, run_id: str, key: Sequence[str], state: _State | None,
                buckets: int | None, schema: T.StructType) -> None:
        """Write rows by bucket and name them; ``buckets`` is given where they replace all rows."""
        version = state.version + 1 if state else 1
        base = version if buckets else state.base
        buckets = buckets or state.buckets
        path = f"{self.root}/data/v{version}-{run_id}"
        placed = _typed(rows, schema).withColumn(BUCKET, _place(key, schema, buckets))
        spare = _typed(loose, schema).withColumn(BUCKET, F.lit(LOOSE).cast("bigint"))
        salts = F.lit(self.spark.sparkContext.defaultParallelism)
        salt = F.when(F.col(BUCKET) == LOOSE, F.pmod(row_hash(placed), salts)).otherwise(0)
        (placed.unionByName(spare).repartition(F.col(BUCKET), salt)
         .write.mode("overwrite").partitionBy(BUCKET).parquet(path))
        written = self.spark.read.schema(T.StructType([*schema.fields, T.StructField(BUCKET, T.LongType())])).parquet(path)
        fixed = [F.lit(version).cast("bigint").alias("version"), F.lit(base).cast("bigint").alias("base"),
                 F.lit(buckets).cast("bigint").alias("buckets")]
        tail = [F.lit(path).alias("path"), F.lit(run_id).alias("run_id")]
        parts = written.groupBy(BUCKET).count().select(*fixed, F.col(BUCKET).alias("bucket"), F.col("count").alias("rows"),
                                                       *tail, F.lit(None).cast("string").alias("schema"))
        head = self.spark.range(0, 1, 1, 1).select(
            *fixed, F.lit(None).cast("bigint").alias("bucket"), F.lit(0).cast("bigint").alias("rows"), *tail,
            F.lit(schema.json()).alias("schema"))
        # One file, so that the commit appears as a whole; it has one row per bucket.
        parts.unionByName(head).coalesce(1).write.mode("append").parquet(f"{self.root}/commits")
        self._drop_unused(state)

    def _drop_unused(self, previous: _State | None) -> None:
        older = self._state(previous.version - 1) if previous and previous.version > 1 else None
        if older:
            for folder in older.folders - previous.folders - self._state().folders:
                remove_path(self.spark, folder)


def _typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of the table, typed as there; columns the frame lacks are null."""
    return df.select(*[(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in schema.fields])


def _place(key: Sequence[str], schema: T.StructType, buckets: int) -> Column:
    """The bucket of a key; keys are typed as in the table first, since the hash depends on the type."""
    return F.pmod(F.xxhash64(*[F.col(f"`{k}`").cast(schema[k].dataType) for k in key]), F.lit(buckets)).cast("bigint").alias(BUCKET)
