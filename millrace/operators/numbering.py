"""Running numbers and group lists that stay whole when one group holds most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators.upsert import row_hash
from millrace.workspace import materialise, row_bytes

#: Runs of more bytes than this are joined by a shuffle.
BROADCAST_BYTES = 32 * 1024 * 1024


def running_number(df: DataFrame, group: Sequence[str], order: Sequence[str], out: str = "number") -> DataFrame:
    """1, 2, 3 … per group in the order given; rows that tie are put in order by their content.

    Rows are range-partitioned by group and order, written once with their place inside the
    partition, and shifted by the rows the same group has in earlier partitions. No task holds
    more than one range, however large a group is.
    """
    keys = [*group, *order, row_hash(df)]
    place = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys).select(
        "*", F.shiftright(place, 33).alias("_part"),
        place.bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"))
    # The ranges come from a sample, so they are fixed by writing them before they are used twice. On the way it is seen
    # how many groups there are, about, and how long their keys get.
    seen = Observation()
    widest = F.max(row_bytes(df, group) + 32)
    stored = materialise(ranged.observe(seen, F.approx_count_distinct(F.xxhash64(*group)).alias("groups"), widest.alias("bytes")), "numbering")
    runs = stored.groupBy("_part", *group).agg(F.min("_place").alias("_first"),
                                               F.count("*").alias("_rows"))
    earlier = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first") + 1
    runs = runs.select(F.col("_part").alias("_p"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
                       shift.alias("_shift"))
    # A group goes on from one range into the next, so there are at most as many runs as groups and ranges together. Twice
    # the estimate is far outside its error; what may be larger is joined by a shuffle.
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if (2 * seen.get["groups"] + ranges) * (seen.get["bytes"] or 0) <= BROADCAST_BYTES:
        runs = F.broadcast(runs)
    same = stored["_part"] == runs["_p"]
    for i, g in enumerate(group):
        same = same & stored[g].eqNullSafe(runs[f"_g{i}"])
    joined = stored.join(runs, same)
    return joined.select(*df.columns, (F.col("_place") + F.col("_shift")).alias(out))


def group_to_list(
    df: DataFrame,
    group: Column,
    order: Sequence[str],
    item: Column,
    default_group: str,
    page_rows: int,
) -> DataFrame:
    """Ordered list of items per group; blank groups take the default name.

    Lists come in pages of the length the caller asks for, so an array never outgrows a
    row while every item is kept.
    """
    named = df.select(F.coalesce(F.nullif(group, F.lit("")), F.lit(default_group)).alias("group"),
                      *order, item.alias("_item"))
    placed = running_number(named, ["group"], order, "_n").withColumn(
        "page", F.floor((F.col("_n") - 1) / page_rows).cast("bigint"))
    return placed.groupBy("group", "page").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_n", "_item"))),
                    lambda s: s["_item"]).alias("items"))


def case_numbers(df: DataFrame, entity_class: str, order: Sequence[str], out: str = "case_no"
                 ) -> DataFrame:
    """Running case number per entity class as text. Numbers are given before any row is skipped."""
    return running_number(df, [entity_class], order, out).withColumn(out, F.col(out).cast("string"))
