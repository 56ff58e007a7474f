"""Vectors of a table as rows that the two vector searches share."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def usable(vectors: DataFrame, id_column: str, vector_column: str, *, zero: bool) -> DataFrame:
    """(vec_id, vector as doubles, dim) of rows with an id and a vector of finite numbers.

    ``zero`` says whether vectors of zeros alone take part; a vector without components never does.
    """
    vector = F.col(vector_column).cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    fine = F.coalesce(finite, F.lit(False)) & (F.size(vector) > 0) & F.col(id_column).isNotNull()
    if not zero:
        fine &= F.exists(vector, lambda x: x != 0)
    return vectors.where(fine).select(F.col(id_column).cast("bigint").alias("vec_id"), vector.alias("vector"),
                                      F.size(vector).alias("dim"))


def questions(rows: DataFrame, every: int, vector: Column) -> DataFrame:
    """Rows whose id is divisible by ``every``, with ``vh``, a hash that tells vectors of one id apart; once each."""
    return (rows.where(F.pmod("vec_id", F.lit(every)) == 0).withColumn("vh", F.xxhash64(vector))
            .dropDuplicates(["vec_id", "vh"]))


def best(found: DataFrame, k: int, order: Column) -> DataFrame:
    """The ``k`` first rows of each query, numbered from 1; ties go to the smaller vec_id."""
    ranked = Window.partitionBy("query_id", "vh").orderBy(order, "vec_id")
    return (found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def matrix(column: pd.Series, dtype) -> np.ndarray:
    """A column of arrays of one length as a matrix."""
    return np.stack(column.to_numpy()).astype(dtype, copy=False)
