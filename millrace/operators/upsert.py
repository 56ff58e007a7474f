"""Merge a batch into a target by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.lookup import first_per_key
from millrace.workspace import fits_broadcast, materialise, path_exists

OVERWRITE = "overwrite"
KEEP_TARGET_ON_NULL = "keep"
#: A partition is written by as many tasks as the staged rows fill files of this many rows.
FILE_ROWS = 1_000_000


def dedupe_last(df: DataFrame, key: Sequence[str], seq: Sequence[Column]) -> DataFrame:
    """Last row per key; ``seq`` is given newest first."""
    return first_per_key(df, key, seq)


def fold_last_non_null(df: DataFrame, key: Sequence[str], seq: Sequence[str]) -> DataFrame:
    """One row per key in which every column holds its last non-null value."""
    moment = F.struct(*seq)
    folds = [F.expr(f"max_by(`{c}`, {_struct_sql(seq)}) FILTER (WHERE `{c}` IS NOT NULL)").alias(c)
             for c in df.columns if c not in key and c not in seq]
    tail = [F.max(moment).alias("_moment")]
    grouped = df.groupBy(*key).agg(*folds, *tail)
    return grouped.select(*key, *[c for c in df.columns if c not in key and c not in seq],
                          *[F.col("_moment")[s].alias(s) for s in seq if s not in key])


def _struct_sql(names: Sequence[str]) -> str:
    return "struct(" + ", ".join(f"`{n}`" for n in names) + ")"


def merge(
    target: DataFrame,
    batch: DataFrame,
    key: Sequence[str] = ("id",),
    seq: Sequence[str] = (),
    nulls: str = OVERWRITE,
    broadcast_bytes: int = 32 * 1024 * 1024,
) -> DataFrame:
    """The target after an upsert of ``batch``; the last row per key in ``seq`` order wins.

    Columns the batch lacks keep their target value. With ``nulls="keep"`` a null keeps
    the target value too, and several rows per key fold column by column. Rows with a
    null key cannot match: they are inserted as they are, outside the join. A batch
    that was measured to be small updates the target by broadcast, without shuffling
    the target; otherwise both sides meet in a full outer join.
    """
    unknown = [c for c in batch.columns if c not in target.columns and c not in seq]
    if unknown:
        raise ValueError(f"columns not in the target: {unknown}")
    fresh, loose = settle_batch(batch, key, seq, nulls)
    given = [c for c in target.columns if c in batch.columns]
    fresh = fresh.select(*given)
    if fits_broadcast(batch.select(*given), broadcast_bytes):
        # Used three times and small, so it is settled once.
        merged = _merge_small(target, materialise(fresh, "settled"), key, nulls)
    else:
        merged = _merge_outer(target, fresh, key, nulls)
    return merged.unionByName(loose.select(*given), allowMissingColumns=True)


def has_key(key: Sequence[str]) -> Column:
    """Whether every key column has a value."""
    keyed = F.lit(True)
    for k in key:
        keyed = keyed & F.col(f"`{k}`").isNotNull()
    return keyed


def settle_batch(batch: DataFrame, key: Sequence[str], seq: Sequence[str], nulls: str
                 ) -> tuple[DataFrame, DataFrame]:
    """One row per key, and apart from them the rows without a key.

    Without ``seq`` the winner among several rows of a key is fixed by a hash of the
    row, so that a repeated run settles the same way.
    """
    keyed = has_key(key)
    fresh = batch.where(keyed)
    if not seq:
        fresh = fresh.withColumn("_order", row_hash(batch))
    order = list(seq) or ["_order"]
    if nulls == KEEP_TARGET_ON_NULL:
        fresh = fold_last_non_null(fresh, key, order)
    else:
        fresh = dedupe_last(fresh, key, [F.desc(s) for s in order])
    return fresh.select(*batch.columns), batch.where(~keyed)


def row_hash(df: DataFrame) -> Column:
    """A hash of the whole row, nested values by their JSON text."""
    nested = (T.MapType, T.VariantType, T.StructType, T.ArrayType)
    return F.xxhash64(*[F.to_json(F.struct(F.col(f"`{f.name}`"))) if isinstance(f.dataType, nested)
                        else F.col(f"`{f.name}`") for f in df.schema])


def _renamed(batch: DataFrame) -> DataFrame:
    return batch.select(*[F.col(f"`{c}`").alias(f"_s_{c}") for c in batch.columns],
                        F.lit(True).alias("_hit"))


def _same_key(key: Sequence[str]) -> Column:
    same = F.lit(True)
    for k in key:
        same = same & (F.col(f"`{k}`") == F.col(f"`_s_{k}`"))
    return same


def _settle(target: DataFrame, batch: DataFrame, key: Sequence[str], nulls: str) -> list[Column]:
    out = []
    for c in target.columns:
        old = F.col(f"`{c}`")
        if c not in batch.columns:
            out.append(old)
            continue
        new = F.col(f"`_s_{c}`")
        if c in key:
            out.append(F.coalesce(old, new).alias(c))
        elif nulls == KEEP_TARGET_ON_NULL:
            out.append(F.coalesce(new, old).alias(c))
        else:
            out.append(F.when(F.col("_hit"), new).otherwise(old).alias(c))
    return out


def _merge_outer(target: DataFrame, batch: DataFrame, key: Sequence[str], nulls: str) -> DataFrame:
    joined = target.join(_renamed(batch), _same_key(key), "full_outer")
    return joined.select(*_settle(target, batch, key, nulls))


def _merge_small(target: DataFrame, batch: DataFrame, key: Sequence[str], nulls: str) -> DataFrame:
    updated = target.join(F.broadcast(_renamed(batch)), _same_key(key), "left").select(
        *_settle(target, batch, key, nulls))
    known = target.select(*key).join(F.broadcast(batch.select(*key)), list(key), "left_semi").distinct()
    inserted = batch.join(F.broadcast(known), list(key), "left_anti")
    return updated.unionByName(inserted, allowMissingColumns=True)


def insert_missing(target: DataFrame, batch: DataFrame, key: Sequence[str], on_conflict: str = "skip"
                   ) -> DataFrame:
    """Insert only: a key the target has is skipped, or fails the job. New keys come in once."""
    if on_conflict == "skip":
        fresh, loose = settle_batch(batch.join(target.select(*key), list(key), "left_anti"), key, (), OVERWRITE)
        return target.unionByName(fresh).unionByName(loose)
    if on_conflict == "error":
        clash = batch.join(target.select(*key), list(key), "left_semi").limit(1)
        if not clash.isEmpty():
            raise ValueError(f"key already present: {clash.select(*key).first()}")
        return target.unionByName(batch)
    raise ValueError(f"unknown conflict policy: {on_conflict}")


def partitioned(spark: SparkSession, path: str, batch: DataFrame, partition: str) -> DataFrame:
    """A stored table with its partition column typed as in the batch.

    Folder names are text; without a schema they are read as numbers or dates where they look so.
    """
    fields = [T.StructField(f.name, batch.schema[partition].dataType) if f.name == partition else f
              for f in spark.read.parquet(path).schema]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def touched_part(spark: SparkSession, path: str, batch: DataFrame, partition: str) -> DataFrame:
    """The partitions of a stored table that hold a partition value of the batch."""
    values = [row[0] for row in batch.select(partition).distinct().collect()]
    column = F.col(f"`{partition}`")
    keep = column.isin([v for v in values if v is not None])
    return partitioned(spark, path, batch, partition).where(keep | column.isNull() if None in values else keep)


def moved_keys(spark: SparkSession, path: str, batch: DataFrame, key: Sequence[str], partition: str) -> DataFrame:
    """Keys of the batch that a stored table holds in another partition; only key columns are read."""
    stored = partitioned(spark, path, batch, partition).select(*key, F.col(f"`{partition}`").alias("_there"))
    here = batch.select(*key, F.col(f"`{partition}`").alias("_here"))
    return stored.join(here, list(key)).where(~F.col("_there").eqNullSafe(F.col("_here"))).select(*key)


def upsert_touched_partitions(
    spark: SparkSession,
    path: str,
    batch: DataFrame,
    key: Sequence[str],
    partition: str,
    seq: Sequence[str] = (),
    nulls: str = OVERWRITE,
    trust: bool = False,
) -> None:
    """Upsert a partitioned parquet table, reading and rewriting only partitions the batch touches.

    ``partition`` is a column that follows from the key, such as a range of ids. A key that the
    table holds in another partition fails the upsert, since it would be kept twice; ``trust``
    skips that check, which reads the key columns of the whole table. The touched values, a part of the partition list the
    driver holds for any such table, become a static partition filter. The merged
    partitions are staged first, then swapped in by dynamic partition overwrite; a
    repeated run gives the same table.
    """
    batch = materialise(batch, "batch")  # read for its values, its size, its keys and the merge
    if path_exists(spark, path):
        if not trust and not (moved := moved_keys(spark, path, batch, key, partition).limit(1)).isEmpty():
            raise ValueError(f"a key changes its partition: {moved.first()}")
        merged = merge(touched_part(spark, path, batch, partition), batch, key, seq, nulls)
    else:
        fresh, loose = settle_batch(batch, key, seq, nulls)
        merged = fresh.unionByName(loose)
    staged = materialise(merged, "partitions")
    salts = max(1, staged.count() // FILE_ROWS)
    (staged.repartition(partition, F.pmod(F.xxhash64(*key), F.lit(salts)))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(partition).parquet(path))
