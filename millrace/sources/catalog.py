"""Inventory of tables and profile of columns."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def inventory(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Name, column count and row count of every table: one union of aggregates."""
    counts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(name).alias("table_name"), F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        "row_count") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def catalog_inventory(spark: SparkSession, database: str | None = None) -> DataFrame:
    names = sorted(t.name for t in spark.catalog.listTables(database))
    return inventory({name: spark.table(name) for name in names})


#: Cells that a task groups by value at a time, about, in an exact profile.
CELLS_PER_TASK = 500_000


def _measures(c: Column, text: Column, unique: Column, nulls: Column, i: int) -> list[Column]:
    return [nulls.alias(f"null{i}"), unique.alias(f"uniq{i}"), F.min(c).cast("string").alias(f"min{i}"),
            F.max(c).cast("string").alias(f"max{i}"), F.max(F.length(text)).alias(f"len{i}")]


def profile(df: DataFrame, distinct: str = "exact") -> DataFrame:
    """One row per column: type, nulls, distinct values, min, max, longest text.

    Exact: the cells of a row go apart, each value of a column is counted once, and one aggregate over the distinct
    values gives all measures. Rows are dealt out first, by their number, so that no task groups more than a
    bounded number of cells, however large the splits of the source are. ``distinct="approx"`` takes one
    aggregate over the rows and no shuffle of them.
    """
    columns, measures, cells = [], [], []
    for i, field in enumerate(df.schema.fields):
        c = F.col(f"`{field.name}`")
        simple = not isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType))
        if distinct == "approx":
            text = c.cast("string") if simple else F.to_json(c)
            measures += _measures(c if simple else text, text, F.approx_count_distinct(text), F.count_if(c.isNull()), i)
        else:
            columns.append((c if simple else F.to_json(c)).alias(f"c{i}"))
            own, c = F.col("_column") == i, F.col(f"c{i}")
            nulls = F.coalesce(F.sum(F.when(own & c.isNull(), F.col("_rows"))), F.lit(0))
            measures += _measures(c, c.cast("string"), F.count(c), nulls, i)
        cells.append(F.struct(
            F.lit(field.name).alias("column_name"), F.lit(field.dataType.simpleString()).alias("type"),
            F.lit(field.nullable).alias("nullable"), F.col(f"null{i}").alias("null_count"),
            F.col(f"uniq{i}").alias("distinct_count"), F.col(f"min{i}").alias("min_value"),
            F.col(f"max{i}").alias("max_value"), F.col(f"len{i}").cast("bigint").alias("max_length")))
    found = df if distinct == "approx" else _values(df.select(*columns))
    return found.agg(*measures).select(F.inline(F.array(*cells)))


def _values(df: DataFrame) -> DataFrame:
    """Each value of each column once, in a column of its own beside nulls, with its column's number and its rows."""
    parts = -(-df.count() * len(df.columns) // CELLS_PER_TASK)
    if parts > df.rdd.getNumPartitions():
        place = "_place"
        df = df.withColumn(place, F.monotonically_increasing_id()).repartition(parts, place).drop(place)
    alone = [F.struct(F.lit(i).alias("_column"), *[(F.col(c) if c == name else F.lit(None).cast(df.schema[c].dataType)).alias(c) for c in df.columns])
             for i, name in enumerate(df.columns)]
    return df.select(F.inline(F.array(*alone))).groupBy("_column", *df.columns).agg(F.count(F.lit(1)).alias("_rows"))
