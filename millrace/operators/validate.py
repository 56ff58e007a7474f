"""Row rules, good/bad split and error reports."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.truth import is_set
from millrace.operators.numbering import group_to_list

ERRORS = "errors"

# Patterns of the format rules.
EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"
PHONE = r"^1[3-9][0-9]{9}$"
ID_NUMBER = r"^[1-9][0-9]{16}[0-9Xx]$"


@dataclass(frozen=True)
class Rule:
    """``failed(df)`` gives a boolean column that is true where the row breaks the rule."""

    name: str
    failed: Callable[[DataFrame], Column]


def required(column: str) -> Rule:
    return Rule(f"required:{column}", lambda df: ~is_set(df, column))


def numeric(column: str) -> Rule:
    return Rule(f"numeric:{column}",
                lambda df: F.col(column).isNotNull() & F.col(column).try_cast("double").isNull())


def matches(column: str, pattern: str, label: str) -> Rule:
    return Rule(f"{label}:{column}",
                lambda df: F.col(column).isNotNull() & ~F.col(column).rlike(pattern))


def check(name: str, failed: Column) -> Rule:
    return Rule(name, lambda df: F.coalesce(failed, F.lit(False)))


def apply_rules(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add ``errors``: the names of the broken rules, in rule order, empty for a good row."""
    found = F.array(*[F.when(rule.failed(df), F.lit(rule.name)) for rule in rules])
    return df.withColumn(ERRORS, F.array_compact(found))


def require_or_fail(df: DataFrame, column: str) -> DataFrame:
    """Stop the job at the first row whose required field is missing."""
    message = F.lit(f"required field missing: {column}")
    return df.withColumn(column, F.when(is_set(df, column), F.col(column)
                                        ).otherwise(F.raise_error(message)))


def split_good_bad(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    good = df.where(F.size(ERRORS) == 0).drop(ERRORS)
    return good, df.where(F.size(ERRORS) > 0)


def error_summary(bad: DataFrame, key: str) -> DataFrame:
    """Rows per reason with the first and last failing key. The rows themselves stay in the bad table."""
    return bad.select(key, F.explode_outer(ERRORS).alias("reason")).groupBy("reason").agg(
        F.count("*").alias("rows"), F.min(key).alias("first_key"), F.max(key).alias("last_key"))


def error_items(bad: DataFrame, key: str, page_rows: int) -> DataFrame:
    """The failing keys of each reason in order, in lists of at most ``page_rows``: ``(reason, page, items)``."""
    items = bad.select(F.col(key).alias("item"), F.explode(ERRORS).alias("reason"))
    return group_to_list(items, F.col("reason"), ["item"], F.col("item"), "", page_rows).withColumnRenamed("group", "reason")


def drop_empty(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop rows in which every (named) column is null."""
    return df.dropna(how="all", subset=list(columns) if columns else None)


def year_window(df: DataFrame, column: str, low: int, high: int) -> DataFrame:
    """Rows whose first four characters are a year in the window."""
    return df.where(F.left(F.col(column), F.lit(4)).try_cast("int").between(low, high))


def year_bounds(run_year: int, any_synced: bool, year_max: int = 0, first_load_year: int = 2025
                ) -> tuple[int, int]:
    """Window bounds: a first load takes all years to ``first_load_year``, later ones last year's."""
    if year_max == 0:
        year_max = run_year - 1 if any_synced else first_load_year
    return (year_max if year_max > first_load_year else 0), year_max


def api_bookmark_filter(df: DataFrame, column: str, last: str | None, if_empty: str = "drop"
                        ) -> DataFrame:
    """``column >= last``. With ``if_empty="keep"`` an empty outcome gives all rows instead."""
    if not last:
        return df
    value = F.lit(last).cast(df.schema[column].dataType)
    newer = df.where(F.col(column) >= value)
    if if_empty == "keep" and newer.isEmpty():
        return df
    return newer
