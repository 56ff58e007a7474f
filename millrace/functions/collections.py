"""Arrays and maps inside one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_element(array: Column) -> Column:
    return F.get(array, F.lit(0))


def find(array: Column, predicate: Callable[[Column], Column]) -> Column:
    """First element that matches, else null."""
    return first_element(F.filter(array, predicate))


def join_non_blank(array: Column, separator: str) -> Column:
    """Text of the non-blank elements; no elements or a null array gives blank."""
    kept = F.filter(array, lambda x: F.coalesce(x, F.lit("")) != "")
    return F.coalesce(F.array_join(kept, separator), F.lit(""))


def sum_or_zero(array: Column) -> Column:
    return F.aggregate(array, F.lit(0).cast("bigint"),
                       lambda total, x: total + F.coalesce(x.cast("bigint"), F.lit(0)))


def _in_language(language: str) -> Callable[[Column], Column]:
    return lambda entry: entry.getField("locale") == language


def localized(term: Column, languages: tuple[str, ...] = ("zh_CN", "en_GB"),
              shape: str = "object") -> Column:
    """Text in the first language that has any.

    ``shape="object"`` reads ``{en_GB: …}``; ``shape="list"`` reads ``{text: [{locale, value}]}``.
    """
    if shape == "object":
        texts = [term.getField(language) for language in languages]
    else:
        texts = [find(term.getField("text"), _in_language(language)).getField("value")
                 for language in languages]
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts], F.lit(""))


def drop_null_entries(entries: Column) -> Column:
    return F.map_filter(entries, lambda _, value: value.isNotNull())


def merge_keeping(existing: Column, extra: Column) -> Column:
    """Union of two maps in which ``existing`` wins on a shared key."""
    fresh = F.map_filter(extra, lambda key, _: ~F.map_contains_key(existing, key))
    return F.map_concat(existing, fresh)
