"""Line dedup by overlapping windows of three lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import document_key, renamed, stored


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _filled(lines: Column) -> Column:
    """Line numbers and hashes of the lines that hold more than white space."""
    trimmed = F.transform(lines, lambda line, at: F.struct(at.alias("at"), F.btrim(line, F.lit(" \t\r\x0b\x0c")).alias("line")))
    return F.transform(F.filter(trimmed, lambda x: x["line"] != ""),
                       lambda x: F.struct(x["at"].alias("at"), F.xxhash64(x["line"]).alias("h"),
                                          F.hash(x["line"]).alias("g")))


def repeated_windows(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text",
                     size: int = 3) -> DataFrame:
    """(sid, tag, starts): the windows of a document that also occur earlier.

    A window is ``size`` consecutive filled lines, compared by 96 bits of hash without their outer white
    space. Earlier means a smaller id, or the same document and an earlier line. The first occurrence
    comes from a partial aggregate and is joined back, so a passage that a third of all documents share
    is a hot key of a plain join, which adaptive execution splits.
    """
    keyed = docs.select(*document_key(F.col(id_column), F.col(text_column)),
                        _filled(_lines(F.col(text_column))).alias("filled"))
    starts = F.when(F.size("filled") >= size, F.sequence(F.lit(0), F.size("filled") - size))
    window = F.transform(starts, lambda i: F.struct(
        i.alias("start"),
        F.xxhash64(*[F.get(F.col("filled"), i + k)["h"] for k in range(size)]).alias("h"),
        F.hash(*[F.get(F.col("filled"), i + k)["g"] for k in range(size)]).alias("g")))
    windows = stored(keyed.select("sid", "tag", F.explode(window).alias("w")).select("sid", "tag", "w.*"), "line_windows")
    place = F.struct("sid", "tag", "start")
    first = (windows.groupBy("h", "g").agg(F.min(place).alias("first"), F.max(place).alias("last"))
             .where(F.col("first") != F.col("last")).select("h", "g", "first"))
    later = windows.join(first, ["h", "g"]).where(place != F.col("first"))
    return later.groupBy("sid", "tag").agg(F.sort_array(F.collect_set("start")).alias("starts"))


def drop_repeated_lines(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text",
                        size: int = 3, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """``docs`` with the later occurrences of repeated line windows removed from the text.

    Covered positions merge: every filled line under a repeated window goes, with the blank lines after
    it. Adds n_lines (filled lines) and n_removed (those that went), under the names in ``counts``; a text that loses nothing stays as it
    is. A null or empty text has no lines; a text of fewer than ``size`` filled lines keeps them all;
    a repeated row counts as the same document, so none of its rows loses lines to another; rows without
    an id come after all others; an empty table gives none. Columns of ``docs`` under
    the names in ``counts`` are replaced; all others stay, whatever they are called.
    """
    docs, own = renamed(docs)
    names = {name: new for name, new in own.items() if name not in counts}
    id_column, text_column = own[id_column], own[text_column]
    windows = repeated_windows(docs, id_column=id_column, text_column=text_column, size=size)
    sid, tag = document_key(F.col(id_column), F.col(text_column))
    joined = (docs.select(*names.values(), sid.alias("_sid"), tag.alias("_tag"))
              .join(windows.withColumnsRenamed({"sid": "_wsid", "tag": "_wtag", "starts": "_starts"}),
                    (F.col("_sid") == F.col("_wsid")) & (F.col("_tag") == F.col("_wtag")), "left"))
    split = joined.withColumn("_lines", _lines(F.col(text_column)))
    at = F.transform(F.filter(F.transform("_lines", lambda line, i: F.struct(i.alias("at"), F.btrim(line, F.lit(" \t\r\x0b\x0c")).alias("line"))),
                              lambda x: x["line"] != ""), lambda x: x["at"])
    placed = split.withColumn("_at", at).withColumn("_n", F.size("_at"))
    # Gaps between covered positions, in filled lines: from three after one start to just before the next.
    edges = F.concat(F.array(F.lit(-size)), F.col("_starts"), F.array(F.col("_n")))
    gaps = F.filter(F.transform(F.sequence(F.lit(0), F.size("_starts")), lambda i: F.struct(
        (F.get(F.col("_edges"), i) + size).alias("a"), F.get(F.col("_edges"), i + 1).alias("b"))),
        lambda g: g["b"] > g["a"])
    edged = placed.withColumn("_edges", F.when(F.col("_starts").isNotNull(), edges)).withColumn(
        "_gaps", F.when(F.col("_starts").isNotNull(), gaps))

    def passage(gap: Column) -> Column:
        begin = F.when(gap["a"] == 0, F.lit(0)).otherwise(F.get(F.col("_at"), gap["a"]))
        end = F.coalesce(F.get(F.col("_at"), gap["b"]), F.size("_lines"))
        return F.array_join(F.slice(F.col("_lines"), begin + 1, end - begin), "\n")

    kept = F.array_join(F.transform("_gaps", passage), "\n")
    left = F.aggregate("_gaps", F.lit(0), lambda total, gap: total + gap["b"] - gap["a"])
    text = F.when(F.col("_starts").isNotNull(), kept).otherwise(F.col(text_column))
    return edged.select(*[(text if new == text_column else F.col(new)).alias(name) for name, new in names.items()],
                        F.col("_n").alias(counts[0]),
                        F.when(F.col("_starts").isNotNull(), F.col("_n") - left).otherwise(F.lit(0)).alias(counts[1]))
