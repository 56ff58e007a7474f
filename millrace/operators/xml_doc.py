"""Metadata XML per record, as one text column."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.dates import compact, year_prefix
from millrace.functions.text import classify, clean_markup, first_non_blank, placeholders, text_or_blank, xml_escape
from millrace.operators.mapping import default_render

HEADER = '<?xml version="1.0" encoding="UTF-8"?>'
INDENT = "    "

# Element names of the archive document around the field list.
ROOT_TAG = "电子档案元数据"
ENVIRONMENT_TAG = "环境信息"
ENVIRONMENT_FIELDS = ["软件环境", "硬件环境"]
OBJECT_TAG = "数字对象"
OBJECT_FIELDS = ["数字对象标识", "格式信息", "计算机文件名", "计算机文件大小", "数字摘要"]
OBJECT_LABEL = "文档"
DEFAULT_CATEGORY = "JX16"
CASE_FIELD = "案卷号"

# The built-in fields, in document order: tag, source columns by priority, default.
DEFAULT_FIELDS = [
    ("一级目录", ["一级目录"], "{year}"),
    ("二级目录", ["二级目录"], "{c2}"),
    ("三级目录", ["三级目录"], ""),
    ("全宗号", ["全宗号"], "0289"),
    ("实体分类号", ["实体分类号"], "{year}-{c2}"),
    ("案卷号", ["案卷号"], ""),
    ("文件号", ["文件号"], ""),
    ("密级", ["密级"], "内部"),
    ("正题名", ["正题名"], "{fullTitle}"),
    ("信息分类号", ["信息分类号", "authorPersonId"], ""),
    ("合作者", ["合作者", "supervisor"], ""),
    ("档案馆室代号", [], ""),
    ("主题词", ["主题词", "orgUuid"], ""),
    ("页数", ["页数"], "{pages}"),
    ("时间", ["时间"], "{timeVal}"),
    ("第一责任者", ["第一责任者", "姓名", "author"], ""),
    ("责任者", [], "{institution}"),
    ("单位", ["单位", "归档单位", "学院", "orgUuid"], ""),
    ("归档份数", ["归档份数"], "1"),
    ("保管期限", ["保管期限"], "长期"),
    ("载体", ["载体"], "电子文件"),
    ("文本", ["文本"], "正本"),
    ("获奖项", ["获奖项"], "中国"),
    ("获奖等级", ["获奖等级", "gender"], ""),
    ("获奖时间", ["获奖时间", "enrollDate"], ""),
    ("归档时间", [], "{now}"),
    ("出版项", ["出版项"], "普通全日制"),
    ("存址", ["存址", "培养层次", "degreeZh"], ""),
    ("学籍变更", ["学籍变更"], ""),
    ("输入员", ["输入员"], "论文系统"),
    ("标识", [], "论文系统"),
]

# Degree classes by the text they contain, tried in this order.
DEGREE_EN_RULES = [("EdD", "教育学专业博士论文"), ("MRes", "研究型硕士论文")]
DEGREE_ZH_RULES = [("博士", "博士论文"), ("硕士", "硕士论文"), ("研究生", "硕士论文")]


@dataclass(frozen=True)
class XmlField:
    tag: str
    sources: tuple[str, ...] = ()
    default: str = ""

    @staticmethod
    def from_config(entries: Sequence[Mapping[str, str]]) -> list[XmlField]:
        """Config entries ``{tag, source, default}``; an entry without a tag is left out."""
        return [XmlField(e["tag"], (e["source"],) if e.get("source") else (), e.get("default") or "")
                for e in entries if e.get("tag")]


def default_fields() -> list[XmlField]:
    return [XmlField(tag, tuple(sources), default) for tag, sources, default in DEFAULT_FIELDS]


def column_or_blank(df: DataFrame, name: str) -> Column:
    return text_or_blank(F.col(f"`{name}`")) if name in df.columns else F.lit("")


def degree_class(degree_zh: Column, degree_en: Column) -> Column:
    by_english = classify(degree_en, DEGREE_EN_RULES)
    return F.when(by_english != "", by_english).otherwise(classify(degree_zh, DEGREE_ZH_RULES))


def archive_context(df: DataFrame, run_time: dt.datetime, institution: str = "",
                    file_count: Column | None = None) -> dict[str, Column]:
    """Values that field defaults may name in braces."""
    get = lambda name: column_or_blank(df, name)
    time_value = first_non_blank(get("时间"), compact(get("submissionDate")))
    year = year_prefix(time_value, run_time.date())
    degree = degree_class(first_non_blank(get("培养层次"), get("degreeZh")), get("degreeEn"))
    count = F.lit("0") if file_count is None else file_count.cast("string")
    title = F.concat(F.lit(institution), first_non_blank(get("姓名"), get("author")), F.lit("("),
                     first_non_blank(get("学号"), get("authorPersonId")), F.lit(")"), degree,
                     F.lit("及评审材料 ("), get("title"), F.lit(")"))
    return {
        "year": year,
        "c2": first_non_blank(get("二级目录"), F.lit(DEFAULT_CATEGORY)),
        "pages": first_non_blank(get("页数"), get("pdf_count"), count),
        "学位": degree,
        "timeVal": time_value,
        "lxDate": time_value,
        "now": F.lit(run_time.strftime("%Y%m%d")),
        "now:yyyy-MM-dd HH:mm:ss": F.lit(run_time.strftime("%Y-%m-%d %H:%M:%S")),
        "institution": F.lit(institution),
        "fullTitle": F.when(degree != "", title).otherwise(F.lit("")),
    }


def entity_class(df: DataFrame, run_date: dt.date, category: str = "二级目录", time: str = "时间",
                 fallback_time: str = "submissionDate") -> Column:
    """``year-category`` with the default category and the run year as last resorts."""
    when = first_non_blank(column_or_blank(df, time), compact(column_or_blank(df, fallback_time)))
    kind = first_non_blank(column_or_blank(df, category), F.lit(DEFAULT_CATEGORY))
    return F.concat(year_prefix(when, run_date), F.lit("-"), kind)


def xml_lines(entries: Sequence[tuple[str, Column | str]], depth: int, omit_empty: bool = False) -> Column:
    """Indented lines of ``(tag, text)`` entries; an empty element is ``<tag/>`` or left out.

    Text given as ``str`` is the same in every row: the planner folds its lines into one literal, which goes ahead
    of the next entry's line. The other entries travel as one array, so the cleaning expression
    occurs once in the plan however many fields a document has.
    """
    pad = F.lit("\n" + INDENT * depth)

    def cleaned(text: Column) -> Column:
        return F.when(text.contains("<"), clean_markup(text)).otherwise(text)

    def line(tag: Column, text: Column) -> Column:
        empty = F.lit("") if omit_empty else F.concat(pad, F.lit("<"), tag, F.lit("/>"))
        return F.when(text == "", empty).otherwise(
            F.concat(pad, F.lit("<"), tag, F.lit(">"), xml_escape(text), F.lit("</"), tag, F.lit(">")))

    raw, ahead = [], [F.lit("")]
    for tag, text in entries:
        if isinstance(text, str):
            ahead.append(line(F.lit(tag), cleaned(F.lit(text))))
            continue
        raw.append(F.struct(F.concat(*ahead).alias("ahead"), F.lit(tag).alias("tag"), F.coalesce(text.cast("string"), F.lit("")).alias("text")))
        ahead = [F.lit("")]
    if not raw:
        return F.concat(*ahead)
    clean = F.transform(F.array(*raw), lambda e: F.struct(e["ahead"], e["tag"], cleaned(e["text"]).alias("text")))
    lines = F.transform(clean, lambda e: F.concat(e["ahead"], line(e["tag"], e["text"])))
    return F.concat(F.array_join(lines, ""), *ahead)


def metadata_xml(
    df: DataFrame,
    files: Column,
    run_time: dt.datetime,
    fields: Sequence[XmlField] | None = None,
    institution: str = "",
    omit_empty: bool = False,
    root: str = ROOT_TAG,
) -> Column:
    """The document: fields in order, an environment block, one object block per file.

    ``files`` is an array of ``{name, format, size, md5}``. A field takes the first
    source column that has text, else its default with ``{name}`` filled from the
    context and then the row. All text is cleaned of markup and escaped.
    """
    context = archive_context(df, run_time, institution, F.size(files))
    row = {c: F.col(f"`{c}`") for c in df.columns}
    entries = []
    for field in fields if fields is not None else default_fields():
        present = [F.col(f"`{s}`") for s in field.sources if s in df.columns]
        source = F.nullif(first_non_blank(*present), F.lit("")) if present else None
        fixed = source is None and not placeholders(field.default) & (context.keys() | row.keys())
        entries.append((field.tag, field.default if fixed else default_render(source, field.default, context, row)))
    surroundings = [(tag, column_or_blank(df, tag) if tag in df.columns else "") for tag in ENVIRONMENT_FIELDS]

    def one_file(f: Column, i: Column) -> Column:
        values = [F.concat(F.lit(OBJECT_LABEL), (i + 1).cast("string")),
                  F.coalesce(f["format"], F.lit("pdf")), f["name"], f["size"], f["md5"]]
        return _block(OBJECT_TAG, xml_lines(list(zip(OBJECT_FIELDS, values)), 2, omit_empty))

    return F.concat(F.lit(f"{HEADER}\n<{root}>"), xml_lines(entries, 1, omit_empty),
                    _block(ENVIRONMENT_TAG, xml_lines(surroundings, 2, omit_empty)),
                    F.array_join(F.transform(files, one_file), ""), F.lit(f"\n</{root}>\n"))


def _block(tag: str, inner: Column) -> Column:
    return F.concat(F.lit(f"\n{INDENT}<{tag}>"), inner, F.lit(f"\n{INDENT}</{tag}>"))


def archive_manifest(df: DataFrame, record_id: Column, files: Column, class_no: Column, case_no: Column,
                     xml: Column, failed: Column | None = None) -> DataFrame:
    """One manifest row per record; a record without id or files, or that failed before, has the reason."""
    before = F.lit(False) if failed is None else failed
    error = F.when(before, F.lit("enrichment failed")).when(
        F.coalesce(record_id, F.lit("")) == "", F.lit("no identifier")).when(
        F.size(files) == 0, F.lit("no files"))
    return df.select(record_id.alias("id"), class_no.alias("entity_class"), case_no.alias("case_no"),
                     F.when(error.isNull(), xml).alias("metadata_xml"), files.alias("files"),
                     error.isNull().alias("ok"), error.alias("error"))
