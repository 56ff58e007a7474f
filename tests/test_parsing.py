"""Aggregation templates and rows out of CSV, XML and HTML columns."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import parsing, validate


def test_aggregate_template(spark, rows):
    df = spark.createDataFrame([("a", 1, None), ("a", 3, "x"), ("b", 2, "x"), (None, 5, "y")], "g string, v int, t string")
    template = {"groupBy": ["g"], "measures": [{"as": "n", "fn": "count"}, {"as": "s", "fn": "sum", "of": "v * 2"}, {"as": "ts", "fn": "set", "of": "t"},
                                               {"as": "big", "fn": "count", "where": "v > 2"}]}
    assert rows(parsing.aggregate(df, template)) == [("a", 2, 8, ["x"], 1), ("b", 1, 4, ["x"], 0), (None, 1, 10, ["y"], 1)]
    whole = {"measures": [{"as": "n", "fn": "count"}], "having": "n > 1"}
    assert rows(parsing.aggregate(df, whole)) == [(4,)] and rows(parsing.aggregate(df.limit(0), whole)) == []
    for wrong in ({"measures": [{"as": "n", "fn": "exec"}]}, {"groupBy": ["g"], "measures": [{"as": "G", "fn": "count"}]}):
        with pytest.raises(ValueError):
            parsing.aggregate(df, wrong)


def test_csv_and_xml_columns(spark, rows):
    df = spark.createDataFrame([(1, 'h,i\n1,"a,b"\r\n\nx,c', "<r><a>1</a></r>"), (2, "h,i", "<r/>"), (3, "", None), (4, None, "broken <")],
                               "id int, c string, x string")
    assert rows(parsing.csv_lines(df, "c", "h int, i string", ["id"], header=True)) == [(1, 0, 1, "a,b"), (1, 1, None, "c")]
    assert rows(parsing.csv_lines(df.where("id = 2"), "c", "h string, i string", ["id"])) == [(2, 0, "h", "i")]
    assert rows(parsing.xml_columns(df.where("id < 3"), "x", "a int", ["id"])) == [(1, 1), (2, None)]


def test_html_tables(spark, rows):
    html = ('<table><thead><tr><th> n </th><th>v</th></tr></thead><tr class="x"><td>a<br>b</td><td>&lt;1&amp;</td></tr><TR><TD>long\nline</TD></TR></table>'
            '<table><tr><td>only</td></tr></table><tables><tr><td>no</td></tr></tables><table></table>')
    df = spark.createDataFrame([(1, html), (2, "no table"), (3, None), (4, "<table>" + "<tr><td>x</td></tr>" * 3000 + "</table>")], "id int, h string")
    found = parsing.html_tables(df, "h", ["id"])
    assert rows(found.where("id < 4"), "id", "table_no", "row_no", "names", "cells") == [
        (1, 0, 0, ["n", "v"], ["ab", "<1&"]), (1, 0, 1, ["n", "v"], ["long\nline"])]
    assert found.where("id = 4").count() == 2999
    plain = parsing.html_tables(df, "h", ["id"], header=False)
    assert plain.where("id = 1 AND table_no = 1").select("cells").first()[0] == ["only"] and plain.where("id = 4").count() == 3000


def test_error_items_keep_every_key(spark):
    bad = spark.range(25).select("id", F.when(F.col("id") % 2 == 0, F.array(F.lit("even"), F.lit("all"))).otherwise(F.array(F.lit("all"))).alias("errors"))
    pages = {(r.reason, r.page): r["items"] for r in validate.error_items(bad, "id", 10).collect()}
    assert [len(pages["all", p]) for p in range(3)] == [10, 10, 5] and pages["even", 1] == [20, 22, 24]
