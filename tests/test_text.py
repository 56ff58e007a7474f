import datetime as dt

from pyspark.sql import functions as F

from millrace.functions import binary, dates, text
from millrace.operators import validate


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_sub_sup_cases(spark):
    cases = {
        "CO<sub>2</sub>": "CO₂", "x<sup>-2+</sup>": "x⁻²⁺", "a<sup>–1</sup>": "a⁻¹", "<sub>n1</sub>": "n₁",
        "<sup><sub>1</sub></sup>": "₁", "open <sub>2": "open 2", "<i>x</i> < 3": "x < 3",
        "a<sub>1</sub>b<sub>2</sub>": "a₁b₂", "": "", "<sub></sub>|": "|", "<sub>1\n2</sub>": "₁\n₂",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    found = {r.t: r.v for r in df.select("t", text.clean_markup(F.col("t")).alias("v")).collect()}
    assert found == cases


def test_render_leaves_unknown_names_and_blanks_null(spark):
    values = {"a": F.lit("$1 ${b}"), "n": F.lit(None).cast("string")}
    assert one(spark, text.render("${a}-${n}-${b}-{a}", values)) == "$1 ${b}--${b}-{a}"
    assert one(spark, text.render("{a}{n}!", values, "brace")) == "$1 ${b}!"


def test_names_and_formats(spark):
    assert one(spark, text.last_path_segment(F.lit("http://x/a.pdf?q=1"))) == "a.pdf"
    assert one(spark, text.last_path_segment(F.lit("http://x/"))) == "file.pdf"
    assert one(spark, text.file_format(F.lit("A.OFD"))) == "ofd"
    assert one(spark, text.file_format(F.lit(None).cast("string"))) == "pdf"
    assert one(spark, text.safe_file_name(F.lit('a\\b/c:d*e?f"g<h>i|j'))) == "a_b_c_d_e_f_g_h_i_j"
    assert one(spark, text.truncate(F.lit("abcdef"), 3)) == "abc..."


def test_dates(spark):
    y, none = F.lit(2024), F.lit(None).cast("int")
    assert one(spark, dates.parts_to_iso(y, none, none)) == "2024-01-01"
    assert one(spark, dates.parts_to_compact(y, F.lit(13), F.lit(5))) == "20241305"
    assert one(spark, dates.compact(F.lit("2024-02-03"))) == "20240203"
    assert one(spark, dates.compact(F.lit(None).cast("string"))) == ""
    assert one(spark, dates.year_prefix(F.lit("19"), dt.date(2025, 1, 1))) == "2025"
    assert one(spark, dates.real_date(y, F.lit(13), F.lit(1))) is None
    assert one(spark, dates.epoch_ms_to_date(F.lit("1700000000000"))) == "2023-11-14"


def test_binary(spark):
    heads = {b"\xff\xd8abc": "image/jpeg", b"\x89Pabc": "image/png", b"%PDF-": "application/pdf",
             b"abcde": "application/octet-stream", b"%PDF": None}
    for data, kind in heads.items():
        assert one(spark, binary.content_type(F.lit(data))) == kind
    assert one(spark, binary.decode_base64(F.lit("%%%"))) is None
    assert one(spark, binary.digest(F.lit(b""))) == ""
    assert one(spark, binary.digest(F.lit(b"a"))) == "0cc175b9c0f1b6a831c399e269772661"
    assert one(spark, binary.looks_base64(F.lit("aGk="))) is True
    assert one(spark, binary.looks_base64(F.lit("aGk"))) is False


def test_year_bounds():
    assert validate.year_bounds(2030, any_synced=False) == (0, 2025)
    assert validate.year_bounds(2030, any_synced=True) == (2029, 2029)
    assert validate.year_bounds(2030, any_synced=True, year_max=2020) == (0, 2020)
