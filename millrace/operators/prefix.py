"""Running totals over a whole frame, without a task that sees all of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.workspace import materialise


def prefix_sums(df: DataFrame, value: Column, out: str, order: Sequence[Column] = ()) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all earlier rows, own row excluded.

    Rows come in ``order`` by ranges, or as they lie where no order is given. They are stored once with their place;
    one total per partition is summed in one task, and each partition adds its offset. Rows that tie on
    ``order`` may change places between runs.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    place = F.monotonically_increasing_id()
    stored = materialise(dealt.select("*", value.alias("_value"), F.shiftright(place, 33).alias("_part"), place.alias("_place")), "prefix")
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = stored.groupBy("_part").agg(F.sum("_value").alias("_total")).select(
        F.col("_part").alias("_p"), F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    inside = W.partitionBy("_part").orderBy("_place").rowsBetween(W.unboundedPreceding, -1)
    local = stored.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    # A row per partition.
    joined = local.join(F.broadcast(offsets), F.col("_part") == F.col("_p"))
    return joined.select(*df.columns, (F.col("_inside") + F.col("_offset")).alias(out))
