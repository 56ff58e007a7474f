"""Digital objects of a record: which files it has, their names, formats and digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.binary import digest
from millrace.functions.text import blank_to_null, file_format, first_non_blank, last_path_segment

FILE = "struct<name:string,url:string,path:string,content:string,format:string>"
NO_FILES = f"array<{FILE}>"
DEFAULT_NAME = "file.pdf"


def _file(name: Column, url: Column, path: Column, content: Column, fmt: Column) -> Column:
    return F.struct(name.cast("string").alias("name"), url.cast("string").alias("url"),
                    path.cast("string").alias("path"), content.cast("string").alias("content"),
                    fmt.cast("string").alias("format"))


def _none() -> Column:
    return F.lit(None).cast("string")


def _name(name: Column, place: Column) -> Column:
    return F.coalesce(blank_to_null(name), last_path_segment(place, DEFAULT_NAME))


def listed_files(text: Column) -> Column:
    """A JSON list of ``{path, url, name, content, format}``; entries with no content or place are dropped."""
    items = F.filter(F.from_json(text, NO_FILES), lambda f: F.coalesce(
        blank_to_null(f["content"]), blank_to_null(f["url"]), blank_to_null(f["path"])).isNotNull())

    def settle(f: Column) -> Column:
        inline = F.coalesce(f["content"], F.lit("")) != ""
        place = F.coalesce(blank_to_null(f["url"]), blank_to_null(f["path"]))
        name = F.when(inline, F.coalesce(f["name"], F.lit(DEFAULT_NAME))).otherwise(_name(f["name"], place))
        return _file(name, f["url"], f["path"], f["content"],
                     F.when(inline, F.coalesce(f["format"], F.lit("pdf"))))

    return with_format(F.transform(items, settle))


def with_format(files: Column) -> Column:
    """Give files that state no format the one their name ends in."""
    return F.transform(files, lambda f: _file(
        f["name"], f["url"], f["path"], f["content"], F.coalesce(f["format"], file_format(f["name"]))))


_DOCUMENTS = "array<struct<mimeType:string,downloadUrl:string,fileName:string>>"


def document_files(text: Column, marker: str = "changehistory") -> Column:
    """PDF documents of a JSON list that can be downloaded and are no change history."""
    items = F.filter(F.from_json(text, _DOCUMENTS), lambda d: is_pdf(d["mimeType"], d["downloadUrl"])
                     & blank_to_null(d["downloadUrl"]).isNotNull()
                     & ~F.coalesce(d["fileName"].contains(marker), F.lit(False)))
    return with_format(F.transform(items, lambda d: _file(
        _name(d["fileName"], d["downloadUrl"]), d["downloadUrl"], _none(), _none(), _none())))


def is_pdf(mime: Column, url: Column) -> Column:
    """By MIME type when there is one, else by the suffix of the URL."""
    by_suffix = F.coalesce(F.lower(url).endswith(".pdf"), F.lit(False))
    return F.when(F.coalesce(mime, F.lit("")) != "", mime == "application/pdf").otherwise(by_suffix)


def single_file(path: Column, url: Column, name: Column) -> Column:
    """A local path, else a URL, as a list of one; neither gives an empty list."""
    local = F.coalesce(path, F.lit("")) != ""
    one = F.filter(F.array(F.struct(F.coalesce(blank_to_null(path), blank_to_null(url)).alias("place"))),
                   lambda p: p["place"].isNotNull())
    return with_format(F.transform(one, lambda p: _file(
        _name(name, p["place"]), F.when(~local, p["place"]), F.when(local, p["place"]), _none(), _none())))


def comma_list_files(paths: Column) -> Column:
    kept = F.filter(F.transform(F.split(paths, ","), lambda p: F.trim(p)), lambda p: p != "")
    return with_format(F.transform(kept, lambda p: _file(
        last_path_segment(p, DEFAULT_NAME), _none(), p, _none(), _none())))


def resolve_files(*candidates: Column) -> Column:
    """The first candidate list that has an element, else an empty list."""
    filled = F.filter(F.array(*candidates), lambda c: F.coalesce(F.size(c), F.lit(0)) > 0)
    return F.coalesce(F.get(filled, F.lit(0)), F.array().cast(NO_FILES))


def with_content(files: Column, content: Column) -> Column:
    """Manifest entries ``{name, format, size, md5}`` for files whose bytes are ``content[i]``."""
    return F.transform(files, lambda f, i: F.struct(
        f["name"].alias("name"), f["format"].alias("format"),
        F.coalesce(F.octet_length(F.get(content, i)), F.lit(0)).cast("bigint").alias("size"),
        digest(F.get(content, i)).alias("md5")))


def identifier(choices: Sequence[Column], row: Sequence[Column]) -> Column:
    """First non-blank choice, else a digest of the row, so that a retry gives the same id."""
    text = F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in row])
    return F.coalesce(F.nullif(first_non_blank(*choices), F.lit("")), F.md5(text))
