"""Text columns: defaults, placeholders, cleaning."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that stand for digits and signs in sub- and superscript.
PLAIN_SUB = "0123456789"
UNICODE_SUB = "₀₁₂₃₄₅₆₇₈₉"
PLAIN_SUP = "0123456789-–+"
UNICODE_SUP = "⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁻⁺"

# Characters a file name may not hold, and what any HTML tag looks like.
UNSAFE_NAME = r'[\\/:*?"<>|]'
HTML_TAG = r"<[^>]+>"

_PLACEHOLDER = re.compile(r"\$\{([^}]+)\}|\{([^{}]+)\}")


def blank_to_null(column: Column) -> Column:
    return F.nullif(column, F.lit(""))


def first_non_blank(*columns: Column, default: str | None = "") -> Column:
    """The first column holding text; blank counts as missing."""
    chain = [blank_to_null(c.cast("string")) for c in columns]
    return F.coalesce(*chain, F.lit(default))


def text_or_blank(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def placeholders(template: str) -> set[str]:
    """The names that stand in braces in a template."""
    return {brace for _, brace in _PLACEHOLDER.findall(template) if brace}


def render(template: str, values: Mapping[str, Column], style: str = "dollar") -> Column:
    """Fill ``${name}`` (style "dollar") or ``{name}`` (style "brace") from columns.

    The template is fixed text; values only ever become data. A null value gives
    an empty string and a name that is not in ``values`` stays as written.
    """
    pieces: list[Column] = []
    position = 0
    for match in _PLACEHOLDER.finditer(template):
        dollar, brace = match.groups()
        name = dollar if style == "dollar" else brace
        if name is None or name not in values:
            continue
        if match.start() > position:
            pieces.append(F.lit(template[position:match.start()]))
        pieces.append(text_or_blank(values[name]))
        position = match.end()
    if position < len(template):
        pieces.append(F.lit(template[position:]))
    if not pieces:
        return F.lit("")
    return F.concat(*pieces)


def strip_tags(column: Column) -> Column:
    return F.regexp_replace(column, HTML_TAG, "")


def _translate_tag(column: Column, tag: str, plain: str, script: str) -> Column:
    """Cut the text at complete ``<tag>…</tag>`` runs and translate only those runs."""
    cut = f"(?=<{tag}>[^<]*</{tag}>)|(?<=</{tag}>)"
    whole = f"^<{tag}>[^<]*</{tag}>\\z"
    opening = len(tag) + 2
    markup = 2 * opening + 1

    def piece(segment: Column) -> Column:
        inner = F.substring(segment, F.lit(opening + 1), F.length(segment) - markup)
        return F.when(segment.rlike(whole), F.translate(inner, plain, script)).otherwise(segment)

    return F.array_join(F.transform(F.split(column, cut), piece), "")


def sub_sup_to_unicode(column: Column) -> Column:
    """Turn ``<sub>``/``<sup>`` runs into Unicode characters. Other tags stay."""
    lowered = _translate_tag(column, "sub", PLAIN_SUB, UNICODE_SUB)
    return _translate_tag(lowered, "sup", PLAIN_SUP, UNICODE_SUP)


def clean_markup(column: Column) -> Column:
    return strip_tags(sub_sup_to_unicode(column))


def safe_file_name(column: Column) -> Column:
    return F.regexp_replace(column, UNSAFE_NAME, "_")


def last_path_segment(url: Column, default: str = "file.pdf") -> Column:
    """The part after the last slash, without a query string; blank gives ``default``."""
    tail = F.substring_index(url, "/", -1)
    mark = F.instr(tail, "?")
    bare = F.when(mark > 1, F.substring(tail, F.lit(1), mark - 1)).otherwise(tail)
    return F.coalesce(blank_to_null(bare), F.lit(default))


def file_format(name: Column, known: Sequence[str] = ("pdf", "ofd", "doc", "docx"),
                default: str = "pdf") -> Column:
    """Format by suffix, case-insensitive; unknown or missing names give ``default``."""
    lowered = F.lower(name)
    chosen = F.lit(default)
    for suffix in known:
        chosen = F.when(lowered.endswith(f".{suffix}"), F.lit(suffix)).otherwise(chosen)
    return chosen


def truncate(column: Column, size: int, suffix: str = "...") -> Column:
    """Cut for display only. Operators that carry data never call this."""
    return F.when(F.length(column) > size, F.concat(F.left(column, F.lit(size)), F.lit(suffix))
                  ).otherwise(column)


def zero_pad(column: Column, width: int = 2) -> Column:
    text = column.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def classify(column: Column, rules: Sequence[tuple[str, str]], default: str = "") -> Column:
    """First rule whose needle occurs in the text names the class."""
    chosen = F.lit(default)
    for needle, label in reversed(rules):
        chosen = F.when(column.contains(needle), F.lit(label)).otherwise(chosen)
    return chosen


def xml_escape(column: Column) -> Column:
    escaped = F.replace(column, F.lit("&"), F.lit("&amp;"))
    escaped = F.replace(escaped, F.lit("<"), F.lit("&lt;"))
    return F.replace(escaped, F.lit(">"), F.lit("&gt;"))
