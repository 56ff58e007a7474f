import datetime as dt
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.operators import files, json_ops, xml_doc
from millrace.sources import tables


def items(spark, body):
    df = spark.createDataFrame([(body,)], "body string")
    return [json.loads(i) for i in json_ops.with_response_items(df, "body").first()["_items"]]


@pytest.mark.parametrize("body, expected", [
    ('[{"a": 1}, 2, {"a": 3}]', [{"a": 1}, {"a": 3}]),
    ('{"data": [{"a": 1}], "x": [{"b": 1}]}', [{"a": 1}]),
    ('{"data": [], "z": [1], "m": [{"b": 1}], "a": [{"c": 1}]}', [{"b": 1}]),
    ('{"note": "[{\\"a\\": 1}]", "n": 1}', [{"note": '[{"a": 1}]', "n": 1}]),
    ('{"a": {"b": [1]}}', [{"a": {"b": [1]}}]),
    ("[1, 2]", []), ("[]", []), ("{broken", []), ("7", []), (None, []), ('["{\\"a\\": 1}"]', []),
])
def test_response_precedence(spark, body, expected):
    assert items(spark, body) == expected


def test_chain_result(spark):
    long_text = "x" * 5000
    data = [(1, '{"a": 1}', {}), (2, long_text, {"v": "1"}), (3, None, {"v": "1"}), (4, "", {})]
    df = spark.createDataFrame(data, "id int, body string, vars map<string,string>")
    out = {r.id: json.loads(r.item) for r in json_ops.chain_result_rows(df, "body", "vars", ["id"]).collect()}
    assert out == {1: {"a": 1}, 2: {"raw": long_text}, 3: {"v": "1"}}


def leaves(value, prefix=""):
    if isinstance(value, dict):
        for k, v in value.items():
            yield from leaves(v, f"{prefix}.{k}" if prefix else k)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from leaves(v, f"{prefix}[{i}]")
    elif prefix:
        text = "" if value is None else str(value).lower() if isinstance(value, bool) else str(value)
        yield prefix, text


plain_text = st.text(st.characters(codec="utf-8", exclude_categories=["Cs", "Cc"]), max_size=6)
trees = st.recursive(st.one_of(st.none(), st.booleans(), st.integers(-10**9, 10**9), plain_text),
                     lambda c: st.one_of(st.lists(c, max_size=3), st.dictionaries(st.sampled_from("abc{["), c, max_size=3)),
                     max_leaves=12)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(trees, min_size=1, max_size=4))
def test_json_to_kv_equals_recursive_walk(spark, documents):
    df = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(documents)], "id int, body string")
    found = sorted((r.id, r.key, r.value) for r in json_ops.json_to_kv(df, "body", ["id"]).collect())
    assert found == sorted((i, k, v) for i, t in enumerate(documents) for k, v in leaves(t))


def test_json_to_kv_deep_and_broken(spark):
    deep = "[" * 40 + "1" + "]" * 40
    df = spark.createDataFrame([(1, deep), (2, "{oops"), (3, "5"), (4, "{}"), (5, None)], "id int, body string")
    found = json_ops.json_to_kv(df, "body", ["id"]).collect()
    assert [(r.id, r.key, r.value) for r in found] == [(1, "[0]" * 40, "1")]


def test_collection_import(spark):
    doc = {"item": [{"response": [{"body": '{"a": {"b": 1}}'}, {"body": "plain"}]}, {}]}
    df = spark.createDataFrame([(1, json.dumps(doc))], "id int, doc string")
    out = json_ops.import_collection(df, "doc", ["id"]).collect()
    assert [(r.item_no, r.response_no, r.key, r.value) for r in out] == [(0, 0, "a.b", "1")]


def test_json_path_edges(spark):
    df = spark.createDataFrame([('{"a": {"b": [1]}, "x.y": 1}',)], "t string")
    path = lambda p: df.select(json_ops.json_path(F.col("t"), p)).first()[0]
    assert path("a.b") == "[1]" and path("a.b.c") is None and path("z.y") is None and path("") is None


def test_nested_extract_wraps_single_node(spark):
    df = spark.createDataFrame([(1, '{"d": {"id": 1, "t": null}}'), (2, '{"d": null}'), (3, '{"d": [1]}')], "id int, b string")
    out = json_ops.nested_extract(df, "b", "d", [("id", "i"), ("t", "t")], ["id"])
    assert [tuple(r) for r in out.collect()] == [(1, 0, "1", "")]


def test_file_priorities(spark):
    null = F.lit(None).cast("string")
    listed = files.listed_files(F.lit('[{"url": "http://x/a.ofd?z"}, {"name": "none"}]'))
    documents = files.document_files(F.lit('[{"downloadUrl": "http://x/b.PDF"}]'))
    single = files.single_file(null, F.lit("http://x/c.doc"), F.lit(""))
    names = lambda *c: [f.name for f in spark.range(1).select(
        files.resolve_files(*c).alias("f")).first().f]
    empty = files.listed_files(F.lit("broken"))
    assert names(listed, documents) == ["a.ofd"]
    assert names(empty, documents, single) == ["b.PDF"]
    assert names(empty, single) == ["c.doc"]
    assert names(empty, files.comma_list_files(F.lit(" d/e.pdf , ,f"))) == ["e.pdf", "f"]
    assert names(empty) == []


def test_binary_file_scan(spark, tmp_path):
    (tmp_path / "a.ofd").write_bytes(b"abc")
    (tmp_path / "b.txt").write_bytes(b"z")
    out = tables.binary_files(spark, str(tmp_path)).orderBy("name").collect()
    assert [(r.name, r.format, r.size, bytes(r.content)) for r in out] == [
        ("a.ofd", "ofd", 3, b"abc"), ("b.txt", "pdf", 1, b"z")]


def test_xml_is_well_formed_and_omits_empty(spark):
    from xml.etree import ElementTree

    df = spark.createDataFrame([("A & B <i>x</i> < \"q\"", "2024-05-06", "MRes", None)],
                               "title string, submissionDate string, degreeEn string, author string")
    objects = F.array(F.struct(F.lit("f<1>.pdf").alias("name"), F.lit("pdf").alias("format"),
                               F.lit(3).cast("bigint").alias("size"), F.lit("ab").alias("md5")))
    clock = dt.datetime(2025, 6, 1)
    full = df.select(xml_doc.metadata_xml(df, objects, clock, institution="Inst").alias("x")).first().x
    root = ElementTree.fromstring(full.encode())
    assert [e.tag for e in root][:3] == ["一级目录", "二级目录", "三级目录"] and len(root) == 31 + 2
    assert root.find("正题名").text == 'Inst()研究型硕士论文及评审材料 (A & B x < "q")'
    assert root.find("时间").text == "20240506" and root.find("归档时间").text == "20250601"
    assert root.find("页数").text == "1" and root.find("数字对象/计算机文件名").text == "f.pdf"
    short = df.select(xml_doc.metadata_xml(df, objects, clock, omit_empty=True).alias("x")).first().x
    assert "/>" not in short and "三级目录" not in short


def test_degree_rules(spark):
    df = spark.createDataFrame([("博士研究生", ""), ("研究生", ""), ("", "EdD"), ("", ""), ("硕士", "MRes x")], "zh string, en string")
    out = [r[0] for r in df.select(xml_doc.degree_class(F.col("zh"), F.col("en"))).collect()]
    assert out == ["博士论文", "硕士论文", "教育学专业博士论文", "", "研究型硕士论文"]


def test_identifier_is_repeatable(spark):
    df = spark.createDataFrame([("", None, "x"), ("", "d", "x"), ("c", "d", "x")], "a string, b string, z string")
    chosen = files.identifier([F.col("a"), F.col("b")], [F.col("z")])
    first, again = ([r[0] for r in df.select(chosen).collect()] for _ in range(2))
    assert first == again and first[1:] == ["d", "c"] and len(first[0]) == 32


def test_json_to_kv_plan_is_as_long_for_any_depth(spark):
    def plan(depth):
        df = spark.createDataFrame([(1, '{"a":' * depth + "1" + "}" * depth), (2, '{"b": 2}')], "id int, body string")
        out = json_ops.json_to_kv(df, "body", ["id"])
        assert {(r.id, r.key, r.value) for r in out.collect()} == {(1, ".".join("a" * depth), "1"), (2, "b", "2")}
        return len(out._jdf.queryExecution().executedPlan().toString().splitlines())
    assert plan(1) == plan(25)


def test_json_to_kv_without_rows(spark):
    assert json_ops.json_to_kv(spark.createDataFrame([], "id int, body string"), "body", ["id"]).collect() == []
    scalars = spark.createDataFrame([(1, "5"), (2, "{}"), (3, None)], "id int, body string")
    assert json_ops.json_to_kv(scalars, "body", ["id"]).collect() == []
