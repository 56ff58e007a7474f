"""Synchronisation strategies: what to read, what to remember."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.spec import Strategy

#: The type in which numbers with an exponent, kept as text, are compared.
EXACT = "decimal(38,9)"
#: Digits of the fraction by which numbers kept as text are told apart.
_FRACTION = 37
COLUMN_NAME = re.compile(r"[a-zA-Z_][a-zA-Z0-9_]*")


def guarded(df: DataFrame, column: str) -> Column:
    """The column, if its name is plain and the frame has it."""
    if not COLUMN_NAME.fullmatch(column) or column not in df.columns:
        raise ValueError(f"not a usable incremental column: {column!r}")
    return F.col(column)


def numeric_text(df: DataFrame, column: str, kind: str | None) -> bool:
    """Whether the column holds numbers as text, so that "10" must count as more than "9"."""
    return kind == "NUMERIC" and isinstance(df.schema[column].dataType, T.StringType)


def number_place(text: Column) -> Column:
    """Where a number kept as text stands among others: (whole part, fraction), up to 38 and 37 digits.

    Null for text that is no number and for numbers of more digits: they have no place, and nothing
    is decided by cutting their digits off.
    """
    part = lambda n: F.regexp_extract(F.btrim(text), r"^([+-]?)([0-9]*)(?:\.([0-9]*))?$", n)
    # Each part is bound once and used several times: spelled out, the expression would take the text apart anew for each use.
    taken = F.array(F.struct(part(0).alias("all"), part(1).alias("sign"), part(2).alias("whole"),
                             part(3).alias("fraction"), text.alias("text")))
    placed = F.transform(F.transform(taken, _numbers), lambda n: F.when(n["whole"].isNotNull() & n["rest"].isNotNull(), n))
    return F.get(placed, F.lit(0))


def _numbers(t: Column) -> Column:
    """Whole part and fraction of a number whose text was taken apart."""
    plain, fraction = t["all"] != "", F.rtrim(t["fraction"], F.lit("0"))
    sign = F.when(t["sign"] == "-", F.lit(-1)).otherwise(F.lit(1)).cast("decimal(1,0)")
    whole = (F.concat(F.lit("0"), F.ltrim(t["whole"], F.lit("0"))).try_cast("decimal(38,0)") * sign).cast("decimal(38,0)")
    rest = (F.when(F.length(fraction) <= _FRACTION, F.concat(F.lit("0."), fraction, F.lit("0"))).try_cast(f"decimal(38,{_FRACTION})") * sign)
    digits = F.length(t["whole"]) + F.length(t["fraction"]) > 0
    # Numbers with an exponent: whole part towards zero, and what is left.
    other = t["text"].try_cast(EXACT)
    cut = F.when(other < 0, F.ceil(other)).otherwise(F.floor(other)).cast("decimal(38,0)")
    whole = F.when(plain, F.when(digits, whole)).otherwise(cut)
    rest = F.when(plain, rest.cast(f"decimal(38,{_FRACTION})")).otherwise((other - cut).cast(f"decimal(38,{_FRACTION})"))
    return F.struct(whole.alias("whole"), rest.alias("rest"))


def _fixed(place: Row) -> Column:
    """A place found before, as a literal."""
    return F.struct(F.lit(place["whole"]).cast("decimal(38,0)").alias("whole"), F.lit(place["rest"]).cast(f"decimal(38,{_FRACTION})").alias("rest"))


def _newer(df: DataFrame, column: str, last, kind: str | None, ties: bool) -> DataFrame:
    value = guarded(df, column)
    if numeric_text(df, column, kind):
        found = df.sparkSession.range(1).select(number_place(F.lit(str(last))).alias("mark")).first()["mark"]
        if found is None:
            return df
        place, mark = number_place(value), _fixed(found)
        # Text that is no number compares to null; the place stands here once, so it is found once for a row.
        return df.where(F.coalesce(place >= mark if ties else place > mark, value.isNotNull()))
    mark = F.lit(last).cast(df.schema[column].dataType)
    return df.where(value >= mark if ties else value > mark)


def newer_by_id(df: DataFrame, column: str, last, kind: str | None = None) -> DataFrame:
    """``column > last``; numbers kept as text are compared as numbers, to the last digit.

    Text that is no number has no place before or after the bookmark: it is read again and absorbed
    by the upsert.
    """
    return df if last is None else _newer(df, column, last, kind, ties=False)


def newer_by_time(df: DataFrame, column: str, last, kind: str | None = None) -> DataFrame:
    """``column >= last``: rows at the bookmark are read again and absorbed by the upsert.

    Numbers kept as text (epoch times, say) are compared as numbers, as in ``newer_by_id``.
    """
    return df if last is None else _newer(df, column, last, kind, ties=True)


def capped(df: DataFrame, column: str, rows: int, kind: str | None = None) -> DataFrame:
    """The first ``rows`` rows by ``column`` and every row tied with the last of them.

    The cut-off value comes from a top-k over one column, so nothing is sorted as a whole. Numbers kept
    as text are put in order as numbers, like the bookmark. Rows without a value, or with text that is
    no number, are read first, all of them: no cap leaves them out.
    """
    as_number = numeric_text(df, column, kind)
    place = number_place(F.col(column)) if as_number else F.col(column)
    cutoff = df.select(place.alias("place")).where("place is not null").orderBy("place").limit(rows).agg(
        F.max("place").alias("cutoff")).first()["cutoff"]
    if cutoff is None:
        return df.where(place.isNull())
    mark = F.lit(cutoff)
    if as_number:
        mark = _fixed(cutoff)
    return df.where(F.coalesce(place <= mark, F.lit(True)))


def not_synced(df: DataFrame, synced: DataFrame, key: str, synced_key: str = "id") -> DataFrame:
    """Rows whose id is not in the set. A row without an id is kept."""
    ids = synced.select(F.col(synced_key).alias("_synced"))
    return df.join(ids, df[key].cast("string") == ids["_synced"].cast("string"), "left_anti")


def high_water_mark(column: str, kind: str, compat: bool = False) -> Column:
    """Aggregate for the next bookmark, as text. ``compat`` truncates numbers to whole ones."""
    value = F.max(column)
    if kind == "NUMERIC" and compat:
        value = F.max(F.col(column).cast("bigint"))
    return value.cast("string")


def next_bookmark(df: DataFrame, column: str, kind: str | None) -> Column:
    """Aggregate for the bookmark a flow saves: the text of the largest value.

    Times carry their offset, so a run in another session time zone reads on from the same
    moment; numbers kept as text are compared as numbers.
    """
    if numeric_text(df, column, kind):
        return F.max_by(column, number_place(F.col(column)))
    if isinstance(df.schema[column].dataType, T.TimestampType):
        return F.date_format(F.max(column), "yyyy-MM-dd HH:mm:ss.SSSSSSXXX")
    return high_water_mark(column, kind)


def incremental(df: DataFrame, strategy: Strategy, column: str | None, last, cap: int | None = None,
                key: str | None = None, kind: str | None = None) -> DataFrame:
    """The rows a run reads. Without a bookmark all rows.

    A cap cuts in the order of the incremental column, or of the key where there is none. A full
    read takes no cap: nothing would move it on, so every run would read the same rows.
    """
    if cap and strategy is Strategy.FULL:
        raise ValueError("a full read takes no cap: use an incremental strategy or a synced set")
    out = df
    if column and strategy in (Strategy.INCREMENTAL_ID, Strategy.INCREMENTAL_TIME):
        guarded(df, column)
        out = (newer_by_id(df, column, last, kind) if strategy is Strategy.INCREMENTAL_ID
               else newer_by_time(df, column, last, kind))
    order = column or key
    if not (cap and order):
        return out
    return capped(out, order, cap, kind if column else None)


def reader_options(strategy: Strategy, column: str | None, last) -> dict[str, str]:
    """Strategy parameters handed to an API source."""
    if strategy is Strategy.FULL or last is None:
        return {}
    return {"strategy": strategy.name, "watermark_column": column or "", "watermark_lastValue": str(last)}
