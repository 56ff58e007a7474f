"""Aggregation templates, and rows out of columns that hold CSV, XML or HTML."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import strip_tags
from millrace.operators.json_ops import explode_items

#: What a measure of an aggregation template may do.
MEASURES: Mapping[str, Callable[[Column], Column]] = {
    "count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count_distinct": F.count_distinct,
    "count_if": F.count_if, "set": lambda c: F.sort_array(F.collect_set(c))}


# Character references in HTML text, the ampersand's own last.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def aggregate(df: DataFrame, template: Mapping) -> DataFrame:
    """``{"groupBy": [names], "measures": [{"as", "fn", "of", "where"?}], "having"?}`` as one grouped aggregate.

    ``of`` and the conditions are SQL expressions over the rows; ``of`` left out counts rows. Group columns keep
    their names; without ``groupBy`` one row comes out. An unknown function or a name given twice is refused before
    anything runs.
    """
    group, measures, names = list(template.get("groupBy", [])), [], []
    for spec in template["measures"]:
        if spec["fn"] not in MEASURES:
            raise ValueError(f"unknown function: {spec['fn']}")
        value = F.expr(spec["of"]) if "of" in spec else F.lit(1)
        if "where" in spec:
            value = F.when(F.expr(spec["where"]), value)
        measures.append(MEASURES[spec["fn"]](value).alias(spec["as"]))
        names.append(spec["as"])
    if len({n.lower() for n in [*group, *names]}) < len(group) + len(names):
        raise ValueError("a name is given twice")
    out = df.groupBy(*group).agg(*measures)
    return out.where(template["having"]) if template.get("having") else out


def csv_columns(df: DataFrame, column: str, schema: T.StructType | str, keep: Sequence[str], **options: str) -> DataFrame:
    """One CSV record per row as columns; text that does not fit a column's type is null there."""
    return df.select(*keep, F.from_csv(F.col(column), schema, options).alias("_row")).select(*keep, "_row.*")


def csv_lines(df: DataFrame, column: str, schema: T.StructType | str, keep: Sequence[str], header: bool = False, **options: str) -> DataFrame:
    """A whole CSV text per row: one output row per filled line, with its position from 0. Line ends inside quotes are not kept."""
    lines = F.filter(F.split(F.col(column), r"\r?\n"), lambda line: F.btrim(line) != "")
    body = F.when(F.size(lines) > 1, F.slice(lines, 2, F.size(lines))) if header else lines
    found = explode_items(df, keep, body, "_line")
    return found.select(*keep, "pos", F.from_csv("_line", schema, options).alias("_row")).select(*keep, "pos", "_row.*")


def xml_columns(df: DataFrame, column: str, schema: T.StructType | str, keep: Sequence[str], **options: str) -> DataFrame:
    """The elements of one XML record per row as columns."""
    return df.select(*keep, F.from_xml(F.col(column), schema, options).alias("_row")).select(*keep, "_row.*")


def html_matches(text: Column, tag: str) -> Column:
    """What stands inside each ``tag`` element, in order; elements of one tag inside each other are not told apart."""
    return F.regexp_extract_all(text, F.lit(rf"(?is)<(?:{tag})(?=[\s>])[^>]*>(.*?)</(?:{tag})\s*>"), F.lit(1))


def html_text(column: Column) -> Column:
    """The text of an HTML fragment: no tags, common character references resolved, outer white space gone."""
    text = strip_tags(column)
    for name, character in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(character))
    return F.btrim(text, F.lit(" \t\r\n"))


def html_tables(df: DataFrame, column: str, keep: Sequence[str], header: bool = True) -> DataFrame:
    """Rows of the tables in an HTML text: ``(table_no, row_no, cells)``, with ``names`` where the first row is the header.

    Numbers count from 0, the header not counted. Cells are text without tags; a row with fewer cells than
    names is as short as it is. A table without rows gives none.
    """
    tables = explode_items(df, keep, html_matches(F.col(column), "table"), "_table").withColumnRenamed("pos", "table_no")
    lines = tables.select(*keep, "table_no", html_matches(F.col("_table"), "tr").alias("_lines"))
    if header:
        first = F.transform(html_matches(F.get("_lines", F.lit(0)), "t[dh]"), html_text)
        lines = lines.select(*keep, "table_no", first.alias("names"), F.when(F.size("_lines") > 1, F.slice("_lines", 2, F.size("_lines"))).alias("_lines"))
    named = [*keep, "table_no", *(["names"] if header else [])]
    rows = explode_items(lines, named, F.col("_lines"), "_line").withColumnRenamed("pos", "row_no")
    return rows.select(*named, "row_no", F.transform(html_matches(F.col("_line"), "t[dh]"), html_text).alias("cells"))
