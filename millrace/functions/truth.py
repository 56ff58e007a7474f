"""Script-style truth: null, blank, zero, false and empty collections count as missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def truthy(column: Column, data_type: T.DataType) -> Column:
    """A never-null boolean. The text "0" and the text "false" are true, as any non-blank text is."""
    if isinstance(data_type, T.BooleanType):
        present = column
    elif isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        present = column != F.lit("")
    elif isinstance(data_type, T.NumericType):
        present = column != F.lit(0)
    elif isinstance(data_type, (T.ArrayType, T.MapType)):
        present = F.size(column) > 0
    elif isinstance(data_type, T.BinaryType):
        present = F.octet_length(column) > 0
    else:
        present = column.isNotNull()
    return F.coalesce(present, F.lit(False))


def is_set(df: DataFrame, name: str) -> Column:
    return truthy(F.col(name), df.schema[name].dataType)


def elvis(df: DataFrame, name: str, fallback: Column) -> Column:
    """``name ?: fallback``."""
    return F.when(is_set(df, name), F.col(name)).otherwise(fallback)
