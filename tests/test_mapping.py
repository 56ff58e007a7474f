import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.truth import elvis, is_set
from millrace.operators import mapping, template


def test_null_receive_gives_nothing_and_source_column_stays(spark):
    df = spark.createDataFrame([("a", None), (None, "b")], "x string, y string")
    out = mapping.map_fields(df, [("x", "p"), ("y", "p"), ("x", "y")])
    assert out.columns == ["p", "y", "x"]
    # y is a push of x; where x is null the original y shows through.
    assert [tuple(r) for r in out.collect()] == [("a", "a", "a"), ("b", "b", None)]


def test_same_push_twice_last_non_null_wins(spark):
    df = spark.createDataFrame([("a", "b"), ("a", None)], "x string, y string")
    out = mapping.map_fields(df, [("x", "p"), ("y", "p")], keep_unmapped=False)
    assert [r.p for r in out.collect()] == ["b", "a"]


def test_unknown_receive_is_null(spark):
    df = spark.createDataFrame([("a",)], "x string")
    out = mapping.map_fields(df, [("nope", "p")])
    assert out.first().asDict() == {"p": None, "x": "a"}


def test_column_function_only_where_not_null(spark):
    df = spark.createDataFrame([("a",), (None,)], "x string")
    out = mapping.map_fields(df, [("x", "p")], {"x": lambda c: F.coalesce(F.upper(c), F.lit("called"))}, False)
    assert [r.p for r in out.collect()] == ["A", None]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from("abcxyz")), min_size=1, max_size=6))
def test_mapping_matches_row_by_row_rule(spark, pairs):
    data = [(1, None, 3), (None, 5, None), (7, 8, 9), (None, None, None)]
    out = mapping.map_fields(spark.createDataFrame(data, "a int, b int, c int"), pairs)
    expected = []
    for values in data:
        row = dict(zip("abc", values))
        made = {}
        for receive, push in pairs:
            if row[receive] is not None:
                made[push] = row[receive]
        for name, value in row.items():
            if value is not None:
                made.setdefault(name, value)
        expected.append({c: made.get(c) for c in out.columns})
    assert sorted(map(repr, expected)) == sorted(repr(r.asDict()) for r in out.collect())


def test_keep_simple_drops_nested(spark):
    df = spark.sql("SELECT 1 AS a, array(1) AS b, map('k', 1) AS c, named_struct('x', 1) AS d, parse_json('1') AS e")
    assert mapping.keep_simple(df).columns == ["a"]


def test_truthiness(spark):
    df = spark.sql("SELECT * FROM VALUES (NULL, NULL, NULL, NULL), ('', 0, array(), false), "
                   "('0', 1, array(0), true) AS t(s, n, a, b)")
    out = df.select(*[is_set(df, c).alias(c) for c in df.columns]).collect()
    assert [tuple(r) for r in out] == [(False,) * 4, (False,) * 4, (True,) * 4]
    assert [r[0] for r in df.select(elvis(df, "s", F.lit("d"))).collect()] == ["d", "d", "0"]


def test_expression_template_binds_values_as_data(spark):
    df = spark.createDataFrame([("1); DROP TABLE x",)], "v string")
    out = template.expression_template(df, {"o": "concat(v, :p)"}, {"p": "' || 'x"}, keep_input=True)
    assert out.columns == ["v", "o"]
    assert out.first().o == "1); DROP TABLE x' || 'x"


def test_row_template_keeps_types_and_reads_json(spark):
    df = spark.sql("SELECT * FROM VALUES (1, array('a'), map('k', 1.5D)), (NULL, NULL, NULL) AS t(n, a, m)")
    same = template.row_template(df, lambda row, params: None, df.schema)
    assert sorted(map(repr, same.collect())) == sorted(map(repr, df.collect()))
    text = template.row_template(df, lambda row, params: '{"v": "%s"}' % row["n"], T.StructType.fromDDL("v string"))
    assert sorted(r.v for r in text.collect()) == ["1", "None"]


def test_pandas_function_as_column_function(spark):
    import pandas as pd

    @F.pandas_udf("string")
    def shout(values: pd.Series) -> pd.Series:
        return values.str.upper()

    df = spark.createDataFrame([("a",), (None,)], "x string")
    out = mapping.map_fields(df, [("x", "p")], {"x": shout}, keep_unmapped=False)
    assert sorted((r.p or "") for r in out.collect()) == ["", "A"]


def test_row_template_policies(spark):
    df = spark.createDataFrame([(1, "a"), (0, "b")], "n int, s string")
    schema = T.StructType.fromDDL("n int, s string")

    def invert(row, params):
        return {"n": params["top"] // row["n"], "s": row["s"] * 2}

    kept = template.row_template(df, invert, schema, {"top": 10}, "keep_input").orderBy("s").collect()
    assert [(r.n, r.s) for r in kept] == [(10, "aa"), (0, "b")]
    assert kept[0]["_row_error"] is None and "ZeroDivision" in kept[1]["_row_error"]
    quarantined = template.row_template(df, invert, schema, {"top": 10}, "quarantine")
    assert quarantined.where("_row_error IS NOT NULL").select("n", "s").first().asDict() == {"n": None, "s": None}
    with pytest.raises(Exception, match="ZeroDivision"):
        template.row_template(df, invert, schema, {"top": 10}).collect()
