"""What must not grow faster than the input: files, tasks, passes and calls."""

import glob
import json

import pytest
from pyspark.sql import functions as F

from millrace import sync
from millrace.operators import json_ops, xml_doc
from millrace.plans import apis, bodies, documents
from millrace.sources import catalog, rest
from millrace.streaming import incremental



def test_pages_share_files_and_each_is_found(spark, tmp_path):
    rows = spark.range(0, 7000).select("id", F.concat(F.lit("é\n\t"), "id").alias("text"))
    page = F.when(F.col("id") >= 0, F.expr("id div 2 + if(id >= 4000, 500, 0)"))
    bodies.write_bodies(rows.unionByName(spark.sql("SELECT -1L AS id, '' AS text")), page, F.struct("id", "text"), str(tmp_path), count=F.lit(7))
    assert len(glob.glob(f"{tmp_path}/*/part-*")) == 4
    for number in (0, 1, 500, 999, 1000, 1999, 2500, 3999):
        first = 2 * number if number < 2000 else 2 * number - 1000
        items = [{"id": n, "text": f"é\n\t{n}"} for n in (first, first + 1)]
        assert json.loads(bodies.body_of(str(tmp_path), number)) == {"count": 7, "items": items}
    assert [bodies.body_of(str(tmp_path), number) for number in (2000, 2499, 4000, 99999)] == [None] * 4


def test_an_api_of_many_pages_has_few_folders(spark):
    root = apis.served(spark, spark.range(0, 3000), "id", 2)
    assert len(glob.glob(f"{root}/*=*")) == 2


def test_a_long_list_is_read_by_a_bounded_number_of_tasks():
    def of(count, **options):
        answer = rest.Response(200, json.dumps({"count": count}))
        return rest.RestReader({"transport": rest.packed(lambda request: answer), "url": "x", "paging": "offset", "pagesize": "1", **options}).partitions()

    assert [(p.first, p.last) for p in of(25)] == [(0, 9), (10, 19), (20, 24)]
    assert len(of(25, callspertask="1")) == 25
    many = of(1_000_001)
    assert len(many) <= rest.MOST_TASKS and many[-1].last == 1_000_000
    assert all(before.last + 1 == after.first for before, after in zip(many, many[1:]))


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_the_document_is_rendered_once(spark, tmp_path):
    spark.sql("SELECT 1L AS o_orderkey, 2L AS o_custkey, TIMESTAMP_NTZ '2020-01-02 00:00:00' AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("SELECT 2L AS c_custkey, 'a' AS c_name").write.parquet(f"{tmp_path}/customer.parquet")
    assert optimized(documents.metadata_xml_default(spark, str(tmp_path))).count("学籍变更") == 1


@pytest.mark.parametrize("omit", [False, True])
def test_fixed_lines_equal_those_of_columns(spark, omit):
    texts = [("a", "x<sub>1</sub><b>y</b>"), ("b", ""), ("c", "1 & 2"), ("d", "<i></i>"), ("e", "z")]
    as_columns = xml_doc.xml_lines([(tag, F.lit(text)) for tag, text in texts], 1, omit)
    fixed = xml_doc.xml_lines(texts, 1, omit)
    mixed = xml_doc.xml_lines([(tag, F.lit(text) if i % 2 else text) for i, (tag, text) in enumerate(texts)], 1, omit)
    row = spark.range(1).select(as_columns.alias("a"), fixed.alias("b"), mixed.alias("c")).first()
    empty = "" if omit else "\n    <b/>"
    last = "" if omit else "\n    <d/>"
    assert row.a == f"\n    <a>x₁y</a>{empty}\n    <c>1 &amp; 2</c>{last}\n    <e>z</e>"
    assert row.b == row.c == row.a


def test_an_exact_profile_deals_its_rows_out(spark, monkeypatch, rows):
    df = spark.sql("SELECT id, IF(id % 7 = 0, NULL, string(id % 5)) AS t, CASE id % 4 WHEN 0 THEN -0.0D WHEN 1 THEN 0.0D END AS f FROM range(0, 1000, 1, 1)")
    assert "Expand" not in catalog.profile(df)._jdf.queryExecution().executedPlan().toString()
    whole = rows(catalog.profile(df))
    monkeypatch.setattr(catalog, "CELLS_PER_TASK", 100)
    dealt = catalog.profile(df)
    assert "RepartitionByExpression" in optimized(dealt)
    assert rows(dealt) == whole
    found = {r.column_name: (r.null_count, r.distinct_count, r.min_value, r.max_value, r.max_length) for r in dealt.collect()}
    assert found["id"] == (0, 1000, "0", "999", 3) and found["t"] == (143, 5, "0", "4", 1)
    assert found["f"][:2] == (500, 1)
    empty = {r.column_name: (r.null_count, r.distinct_count, r.min_value, r.max_length) for r in catalog.profile(df.limit(0)).collect()}
    assert empty == dict.fromkeys(("id", "t", "f"), (0, 0, None, None))


def test_state_is_asked_for_by_bucket(spark, tmp_path):
    import datetime as dt

    now = dt.datetime(2024, 1, 1)
    data = [(now, 1.5, "a"), (now, -0.0, "b"), (now, 0.0, "c"), (now, float("nan"), "d"), (now, float("nan"), "e"), (now, None, "f"), (now, None, "f")]
    spark.createDataFrame(data, "at timestamp, id double, what string").write.parquet(f"{tmp_path}/in")
    stream = incremental.file_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
    incremental.stream_synced_state(spark, stream, f"{tmp_path}/out", f"{tmp_path}/cp", "id", ["what"], 10 ** 9)
    assert sorted(r.what for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b", "d", "f", "f"]


def test_many_ids_of_one_bucket(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "_BUCKETS", 2)
    for step, (low, high) in enumerate(((0, 300), (100, 400))):
        spark.range(low, high).selectExpr("id", f"id + {step} AS at").write.mode("append").parquet(f"{tmp_path}/in")
        stream = incremental.file_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
        incremental.stream_synced_state(spark, stream, f"{tmp_path}/out", f"{tmp_path}/cp", "id", ["at"], 10 ** 9)
    taken = sorted((r.id, r["at"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert taken == [(i, i) for i in range(300)] + [(i, i + 1) for i in range(300, 400)]


def test_levels_share_passes(spark, rows, monkeypatch):
    roots, scratch = [], json_ops.scratch
    monkeypatch.setattr(json_ops, "scratch", lambda *given: roots.append(scratch(*given)) or roots[-1])
    texts = ['{"a": ' * 40 + "[1, {}, [], null, \"{}\"]" + "}" * 40, ' \n[{"b": [[]]}, 2.50]', "{}", "3", "no", None, "[", '{"": {"c": "[]"}}']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, body string")
    deep = ".".join("a" * 40)
    assert rows(json_ops.json_to_kv(df, "body", ["id"])) == sorted(
        [(0, f"{deep}[0]", "1"), (0, f"{deep}[3]", ""), (0, f"{deep}[4]", "{}"), (1, "[1]", "2.5"), (7, "c", "[]")], key=repr)
    assert len(glob.glob(f"{roots[0].removeprefix('file://')}/_level=*")) <= 4


def test_a_number_kept_as_text_is_taken_apart_once(spark):
    df = spark.createDataFrame([(t,) for t in ("9", "10", "+10.0", "1e1", "11", "no", "", None, "9" * 60, " 12 ", "-3")], "at string")
    newer = sync.newer_by_time(df, "at", "10", "NUMERIC")
    assert optimized(newer).count("regexp_extract") <= 4
    assert sorted(r["at"] for r in newer.collect()) == sorted(["10", "+10.0", "1e1", "11", "no", "", "9" * 60, " 12 "])
    assert sync.newer_by_id(df, "at", "no", "NUMERIC").count() == 11
