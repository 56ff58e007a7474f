"""Field mapping and other projections."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import blank_to_null, render

FieldMap = Sequence[tuple[str, str]]


def map_fields(
    df: DataFrame,
    pairs: FieldMap,
    column_exprs: Mapping[str, Callable[[Column], Column]] | None = None,
    keep_unmapped: bool = True,
) -> DataFrame:
    """Copy each ``(receive, push)`` pair into its push column.

    Copy, not rename: the source column stays unless ``keep_unmapped`` is off. One
    receive may feed several pushes. When several receives feed one push the last
    non-null value wins, and when none has a value a column already called like the
    push shows through. ``column_exprs`` transforms a receive column, only where it
    is not null, before it is copied. A receive the frame lacks gives nothing.
    """
    exprs = column_exprs or {}
    feeds: dict[str, list[Column]] = {}
    for receive, push in pairs:
        sources = feeds.setdefault(push, [])
        if receive in df.columns:
            value = F.col(f"`{receive}`")
            if receive in exprs:
                value = F.when(value.isNotNull(), exprs[receive](value))
            sources.append(value)
    out: list[Column] = []
    for push, sources in feeds.items():
        choices = list(reversed(sources))
        if keep_unmapped and push in df.columns:
            choices.append(F.col(f"`{push}`"))
        value = F.coalesce(*choices) if choices else F.lit(None).cast("string")
        out.append(value.alias(push))
    if keep_unmapped:
        out += [F.col(f"`{c}`") for c in df.columns if c not in feeds]
    return df.select(*out)


def rename_with_defaults(df: DataFrame, rules: Sequence[tuple[str, str, str | None]]) -> DataFrame:
    """Rule list ``(from, to, default)``: project, rename, and fill nulls with the default."""
    out = []
    for source, target, default in rules:
        value = F.col(f"`{source}`") if source in df.columns else F.lit(None).cast("string")
        if default is not None:
            value = F.coalesce(value.cast("string"), F.lit(default))
        out.append(value.alias(target))
    return df.select(*out)


def keep_simple(df: DataFrame) -> DataFrame:
    """Only columns that hold one plain value."""
    nested = (T.StructType, T.ArrayType, T.MapType, T.VariantType)
    return df.select(*[F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, nested)])


def default_render(source: Column | None, template: str, context: Mapping[str, Column],
                   row: Mapping[str, Column]) -> Column:
    """The source when it has text, else the template filled from the context, then the row."""
    values = {**row, **context}
    filled = render(template, values, style="brace")
    if source is None:
        return filled
    return F.coalesce(blank_to_null(source.cast("string")), filled)


def value_map(column: Column, table: Mapping[str, str]) -> Column:
    """Replace coded values through a short table; other values stay."""
    pairs = [F.lit(part) for entry in table.items() for part in entry]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), column.cast("string")),
                      column.cast("string"))
