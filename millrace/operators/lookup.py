"""Enrichment joins.

The join strategy is left to the planner: a lookup side below the broadcast threshold
is sent out, a larger one is shuffled, and a hot key on the fact side is split by
adaptive skew handling, which needs the lookup side to be unique per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators.json_ops import explode_items


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in ``order``. Every task trims its groups before the shuffle."""
    place = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def lookup(
    df: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    fields: dict[str, str],
    flag: str | None = None,
    first_by: Sequence[Column] | None = None,
    how: str = "left",
    unique: bool = False,
) -> DataFrame:
    """Left join that adds ``fields`` (``{right column: new name}``) and a found flag.

    Missing keys leave nulls. Of several rows of a key the first counts, by ``first_by`` or
    else by the fields themselves, so rows never multiply. ``unique`` promises one row per
    key and saves the step.
    """
    if first_by is not None or not unique:
        right = first_per_key(right, [right_key], first_by or [F.col(c) for c in fields] or [F.lit(0)])
    side = right.select(F.col(right_key).alias("_k"),
                        *[F.col(c).alias(n) for c, n in fields.items()],
                        *([F.lit(True).alias(flag)] if flag else []))
    out = df.join(side, df[left_key] == side["_k"], how).drop("_k")
    return out.withColumn(flag, F.coalesce(F.col(flag), F.lit(False))) if flag else out


def lookup_many(
    df: DataFrame,
    right: DataFrame,
    row_id: str,
    ids: Column,
    right_key: str,
    name: Column,
    out: str,
    separator: str = ", ",
    unique: bool = False,
) -> DataFrame:
    """Look up every distinct id of an array column; join the names found, in encounter order.

    Of several rows of an id the smallest name counts; ``unique`` promises that there are none.
    ``row_id`` is unique, so the regrouping key is never hot: a group is one row's array.
    """
    slots = explode_items(df, [row_id], F.array_distinct(ids), "_id").withColumnRenamed("pos", "_pos")
    side = right.select(F.col(right_key).alias("_k"), name.alias("_name"))
    if not unique:
        side = side.groupBy("_k").agg(F.min("_name").alias("_name"))
    found = slots.join(side, slots["_id"] == side["_k"], "inner").where(
        F.coalesce(F.col("_name"), F.lit("")) != "")
    ordered = F.sort_array(F.collect_list(F.struct("_pos", "_name")))
    names = found.groupBy(row_id).agg(
        F.array_join(F.transform(ordered, lambda s: s["_name"]), separator).alias(out))
    return df.join(names, row_id, "left").withColumn(out, F.coalesce(F.col(out), F.lit("")))


def primary_or_all(items: Column, flag: str) -> Column:
    """The flagged elements, or all elements when none is flagged."""
    flagged = F.filter(items, lambda x: F.coalesce(x.getField(flag), F.lit(False)))
    return F.when(F.size(flagged) > 0, flagged).otherwise(items)
