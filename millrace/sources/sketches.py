"""Column profiles kept as sketches per delivery, and merged without reading old data again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: HyperLogLog with 2^12 registers: distinct counts within 5 percent (three standard errors).
HLL_BITS = 12
#: KLL of this size: quantiles within 2 percent of rank.
KLL_SIZE = 400
QUARTILES = (0.25, 0.5, 0.75)

STATE = T.StructType([
    T.StructField("column_name", T.StringType()), T.StructField("type", T.StringType()), T.StructField("rows", T.LongType()),
    T.StructField("null_count", T.LongType()), T.StructField("min_number", T.DoubleType()), T.StructField("max_number", T.DoubleType()),
    T.StructField("min_text", T.StringType()), T.StructField("max_text", T.StringType()), T.StructField("max_length", T.LongType()),
    T.StructField("distinct_sketch", T.BinaryType()), T.StructField("quantile_sketch", T.BinaryType()), T.StructField("part", T.StringType())])


def sketch(df: DataFrame) -> DataFrame:
    """One row of mergeable state per column, by one aggregate that reads each row once.

    Numbers have a quantile sketch (not-a-number values left out), other columns the smallest and largest text;
    nested columns count as their JSON text.
    """
    measures, cells = [], []
    for i, field in enumerate(df.schema.fields):
        c = F.col(f"`{field.name}`")
        nested = isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType))
        number = isinstance(field.dataType, T.NumericType)
        text = F.to_json(c) if nested else c.cast("string")
        value = c.cast("double")
        finite = F.when(~F.isnan(value), value) if number else F.lit(None).cast("double")
        measures += [F.count_if(c.isNull()).alias(f"null{i}"), F.min(finite).alias(f"min{i}"), F.max(finite).alias(f"max{i}"),
                     F.min(F.lit(None).cast("string") if number else text).alias(f"low{i}"),
                     F.max(F.lit(None).cast("string") if number else text).alias(f"high{i}"), F.max(F.length(text)).alias(f"len{i}"),
                     F.hll_sketch_agg(text, HLL_BITS).alias(f"hll{i}"),
                     *([F.kll_sketch_agg_double(finite, KLL_SIZE).alias(f"kll{i}")] if number else [])]
        cells.append(F.struct(
            F.lit(field.name).alias("column_name"), F.lit(field.dataType.simpleString()).alias("type"), F.col("rows"),
            F.col(f"null{i}").alias("null_count"), F.col(f"min{i}").alias("min_number"), F.col(f"max{i}").alias("max_number"),
            F.col(f"low{i}").alias("min_text"), F.col(f"high{i}").alias("max_text"), F.col(f"len{i}").cast("bigint").alias("max_length"),
            F.col(f"hll{i}").alias("distinct_sketch"), (F.col(f"kll{i}") if number else F.lit(None).cast("binary")).alias("quantile_sketch")))
    return df.agg(F.count(F.lit(1)).alias("rows"), *measures).select(F.inline(F.array(*cells)))


def add(df: DataFrame, path: str, part: str) -> None:
    """Keep the state of one delivery; repeating it replaces its own."""
    (sketch(df).withColumn("part", F.lit(part)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("part").parquet(path))


def profile(spark: SparkSession, path: str, parts: list[str] | None = None) -> DataFrame:
    """One row per column over all deliveries, or those named: state is merged, data is not read."""
    state = spark.read.schema(STATE).parquet(path)
    if parts is not None:
        state = state.where(F.col("part").isin(parts))
    merged = state.groupBy("column_name", "type").agg(
        F.sum("rows").alias("rows"), F.sum("null_count").alias("null_count"), F.min("min_number").alias("min_number"),
        F.max("max_number").alias("max_number"), F.min("min_text").alias("min_text"), F.max("max_text").alias("max_text"),
        F.max("max_length").alias("max_length"), F.hll_union_agg("distinct_sketch").alias("_hll"),
        F.kll_merge_agg_double("quantile_sketch", KLL_SIZE).alias("_kll"))
    some = F.col("_kll").isNotNull() & (F.coalesce(F.kll_sketch_get_n_double("_kll"), F.lit(0)) > 0)
    ranks = F.array(*map(F.lit, QUARTILES))
    return merged.select("column_name", "type", "rows", "null_count", F.hll_sketch_estimate("_hll").alias("distinct_count"), "min_number",
                         "max_number", "min_text", "max_text", "max_length",
                         F.when(some, F.kll_sketch_get_quantile_double("_kll", ranks)).alias("quartiles"))
