"""Ranges of about equal size over a key that may be skewed, as predicates a database can read in parallel."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.prefix import prefix_sums
from millrace.sources.jdbc import JdbcTarget
from millrace.workspace import materialise


def cut_points(counts: DataFrame, key: str, rows: str, parts: int) -> list:
    """At most ``parts - 1`` keys, ascending, that cut the rows into ranges of about the same size.

    ``counts`` has each key once with its number of rows. A range holds fewer rows than the mean and its last key's
    together, so it is at most twice the mean where no single key exceeds the mean; a key is never split. Null
    keys take no part. Running totals are distributed, and only the cuts come to the driver.
    """
    known = counts.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(rows).cast("decimal(38,0)").alias("rows"))
    placed = materialise(prefix_sums(known, F.col("rows"), "before", [F.col("key")]), "cuts")
    total = placed.agg(F.sum("rows")).first()[0]
    if not total:
        return []
    part = F.floor(F.col("before") * parts / F.lit(total))
    return sorted(r["low"] for r in placed.groupBy(part.alias("part")).agg(F.min("key").alias("low")).collect())[1:]


def literal(value) -> str:
    """A value as standard SQL text."""
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float, Decimal)):
        return repr(value) if not isinstance(value, Decimal) else f"{value:f}"
    if isinstance(value, dt.datetime):
        return f"TIMESTAMP '{value:%Y-%m-%d %H:%M:%S.%f}'"
    if isinstance(value, dt.date):
        return f"DATE '{value:%Y-%m-%d}'"
    return "'" + str(value).replace("'", "''") + "'"


def predicates(column: str, cuts: Sequence) -> list[str]:
    """One condition per range; every row, also one without a key, meets exactly one."""
    if not cuts:
        return ["1 = 1"]
    texts = [literal(c) for c in cuts]
    inner = [f"{column} >= {low} AND {column} < {high}" for low, high in zip(texts, texts[1:])]
    return [f"{column} < {texts[0]} OR {column} IS NULL", *inner, f"{column} >= {texts[-1]}"]


def counts_query(table: str, column: str) -> str:
    return f"SELECT {column} AS CUT_KEY, COUNT(*) AS CUT_ROWS FROM {table} GROUP BY {column}"


def order_query(table: str, column: str, cuts: Sequence) -> str:
    """The cuts in the order of the database, whose collation may differ from Spark's; equal ones come once."""
    return f"SELECT DISTINCT {column} AS CUT_KEY FROM {table} WHERE {column} IN ({', '.join(map(literal, cuts))}) ORDER BY {column}"


def read_in_ranges(spark: SparkSession, target: JdbcTarget, table: str, column: str, parts: int, init_sql: str | None = None,
                   fetch_size: int = 10_000) -> DataFrame:
    """A table, read in parallel over ranges of about equal size of any orderable column, text too.

    The database counts its keys, Spark cuts them, and the database puts the cuts in its own order, so
    that the ranges neither overlap nor leave a row out whatever its collation is.
    """
    options = {**target.options(), "fetchsize": str(fetch_size)}
    if init_sql:
        options["sessionInitStatement"] = init_sql

    def ask(text: str) -> DataFrame:
        return spark.read.format("jdbc").options(**options).option("query", text).load()

    cuts = cut_points(ask(counts_query(table, column)), "CUT_KEY", "CUT_ROWS", parts)
    if cuts:
        cuts = [r[0] for r in ask(order_query(table, column, cuts)).collect()]
    properties = {k: v for k, v in options.items() if k != "url"}
    return spark.read.jdbc(options["url"], table, predicates=predicates(column, cuts), properties=properties)
