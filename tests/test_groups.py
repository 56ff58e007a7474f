"""Lookups, numbering, hierarchies, rules and schema operators."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import hierarchy, lookup, numbering, schema_fit, sinks, validate, versions
from millrace.sources import catalog, tables
from millrace.workspace import scratch


def test_lookup_edges(spark, rows):
    left = spark.createDataFrame([(1, "a"), (2, None), (3, "z")], "id int, k string")
    right = spark.createDataFrame([("a", "A", 2), ("a", "B", 1)], "k string, name string, n int")
    out = lookup.lookup(left, right, "k", "k", {"name": "name"}, flag="hit", first_by=[F.asc("n")])
    assert rows(out, "id", "name", "hit") == [(1, "B", True), (2, None, False), (3, None, False)]


def test_lookup_many_order_and_blanks(spark, rows):
    left = spark.createDataFrame([(1, ["c", "a", "c", "x"]), (2, []), (3, None), (4, ["b"])], "id int, ids array<string>")
    right = spark.createDataFrame([("a", "A"), ("b", ""), ("c", "C")], "k string, n string")
    out = lookup.lookup_many(left, right, "id", F.col("ids"), "k", F.col("n"), "names")
    assert rows(out, "id", "names") == [(1, "C, A"), (2, ""), (3, ""), (4, "")]


def test_primary_or_all(spark):
    schema = "a array<struct<id:int,p:boolean>>"
    df = spark.createDataFrame([([(1, False), (2, True)],), ([(1, None), (2, False)],)], schema)
    out = df.select(F.transform(lookup.primary_or_all(F.col("a"), "p"), lambda x: x["id"])).collect()
    assert [r[0] for r in out] == [[2], [1, 2]]


def test_running_number_settles_ties_by_content(spark):
    df = spark.createDataFrame([("g", 1, v) for v in "abcdef"], "g string, t int, v string")
    first, again = ({r.v: r.number for r in numbering.running_number(df.orderBy(o), ["g"], ["t"]).collect()} for o in ("v", F.desc("v")))
    assert first == again and sorted(first.values()) == [1, 2, 3, 4, 5, 6]


def test_running_number_with_one_hot_group(spark):
    df = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 > 0 THEN 'hot' WHEN id % 2 = 0 THEN NULL ELSE concat('g', id) END AS g")
    out = numbering.running_number(df, ["g"], ["id"]).collect()
    seen, bad = {}, 0
    for row in sorted(out, key=lambda r: r.id):
        seen[row.g] = seen.get(row.g, 0) + 1
        bad += row.number != seen[row.g]
    assert bad == 0 and len(out) == 3000 and seen["hot"] == 2000


def test_group_list_pages_keep_every_item(spark):
    df = spark.range(25).selectExpr("id", "CASE WHEN id < 22 THEN 'hot' ELSE '' END AS g")
    out = numbering.group_to_list(df, F.col("g"), ["id"], F.col("id"), "none", page_rows=10)
    pages = {(r.group, r.page): r.items for r in out.collect()}
    assert [len(pages["hot", p]) for p in range(3)] == [10, 10, 2]
    assert sum((pages["hot", p] for p in range(3)), []) == list(range(22)) and pages["none", 0] == [22, 23, 24]


def test_numbers_come_before_skips(spark):
    df = spark.createDataFrame([(1, "c", True), (2, "c", False), (3, "c", True)], "id int, cls string, ok boolean")
    out = numbering.case_numbers(df, "cls", ["id"]).where("ok").orderBy("id").collect()
    assert [r.case_no for r in out] == ["1", "3"]


def test_hierarchy(spark, rows):
    edges = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (4, 2), (9, 8)], "id int, parent_id int")
    root = edges.where("id = 1").select("id")
    tree = hierarchy.descend(edges, root)
    assert rows(tree, "id", "depth", "path") == [(1, 0, [1]), (2, 1, [1, 2]), (3, 1, [1, 3]), (4, 2, [1, 2, 4])]
    cyclic = edges.unionByName(spark.createDataFrame([(1, 4)], "id int, parent_id int"))
    with pytest.raises(Exception, match="cycle"):
        hierarchy.descend(cyclic, root)
    with pytest.raises(ValueError, match="deeper"):
        hierarchy.descend(edges, root, max_depth=1)


def test_descend_follows_every_way_and_nested_roots(spark, rows):
    edges = spark.createDataFrame([(2, 1), (3, 1), (4, 2), (4, 3), (5, 4), (7, 8), (8, 7)], "id int, parent_id int")
    roots = spark.createDataFrame([(1,), (4,)], "id int")
    assert rows(hierarchy.descend(edges, roots), "id", "path") == [
        (1, [1]), (2, [1, 2]), (3, [1, 3]), (4, [1, 2, 4]), (4, [1, 3, 4]), (4, [4]), (5, [1, 2, 4, 5]), (5, [1, 3, 4, 5]), (5, [4, 5])]
    assert rows(hierarchy.descend(edges.limit(0), roots), "id") == [(1,), (4,)]


def test_long_chain_takes_few_joins(spark, monkeypatch):
    rounds = []
    store = hierarchy.materialise
    monkeypatch.setattr(hierarchy, "materialise", lambda df, label: (rounds.append(label), store(df, label))[1])
    edges = spark.range(1, 500).selectExpr("id", "id - 1 AS parent_id")
    tree = hierarchy.descend(edges, spark.range(1))
    assert {(r.id, r.depth) for r in tree.collect()} == {(i, i) for i in range(500)}
    assert len(rounds) <= 10


def test_ordered_tree(spark):
    data = [(1, None, "root", 0), (2, 1, "b", 2), (3, 1, "a", 1), (4, 2, "b2", None), (5, 2, "b1", 7), (6, 3, None, 1), (7, 1, "tie", 2),
            (8, 99, "lost", 0), (9, 10, "round", 0), (10, 9, "and round", 0), (11, None, "other", 0)]
    nodes = spark.createDataFrame(data, "id int, parent_id int, name string, sort int")
    tree = hierarchy.ordered_tree(nodes, F.col("parent_id").isNull()).orderBy("root", "place").collect()
    assert [(r.root, r.place, r.id, r.name, r.depth) for r in tree] == [
        (1, 1, 1, "root", 0), (1, 2, 3, "a", 1), (1, 3, 6, None, 2), (1, 4, 2, "b", 1), (1, 5, 4, "b2", 2), (1, 6, 5, "b1", 2), (1, 7, 7, "tie", 1),
        (11, 1, 11, "other", 0)]
    assert tree[5].path == [1, 2, 5] and tree[5].names == ["root", "b", "b1"]


def test_versions(spark, rows):
    history = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "x")], "id int, version int, content string")
    back = versions.rollback(history, "id", 1, 1)
    assert rows(versions.latest_versions(back, "id")) == [(1, 3, "a"), (2, 1, "x")]
    assert rows(versions.version_as_of(back, "id", 2)) == [(1, 2, "b"), (2, 1, "x")]


def test_rules(spark, rows):
    df = spark.createDataFrame([(1, "", "5"), (2, "x", "y"), (3, "x", None)], "id int, a string, n string")
    checked = validate.apply_rules(df, [validate.required("a"), validate.numeric("n")])
    assert rows(checked, "id", "errors") == [(1, ["required:a"]), (2, ["numeric:n"]), (3, [])]
    good, bad = sinks.quarantine(checked, scratch(spark, "q"))
    assert rows(good, "id") == [(3,)] and rows(bad, "id") == [(1,), (2,)]
    with pytest.raises(Exception, match="required field missing"):
        validate.require_or_fail(df, "a").collect()


def test_bookmark_filter_fallback(spark):
    df = spark.createDataFrame([("2024",), ("2025",)], "d string")
    assert validate.api_bookmark_filter(df, "d", "2030").count() == 0
    assert validate.api_bookmark_filter(df, "d", "2030", "keep").count() == 2
    assert validate.api_bookmark_filter(df, "d", None).count() == 2


def test_infer_and_ddl(spark, rows):
    df = spark.createDataFrame([("1", "1.5", "x", None), (None, "2", "1", None)], "a string, b string, c string, d string")
    assert rows(schema_fit.infer_types(df)) == [
        ("a", "BIGINT"), ("b", "DOUBLE"), ("c", "VARCHAR(2000)"), ("d", "VARCHAR(2000)")]
    schema = T.StructType.fromDDL("n int, x decimal(5,2), t timestamp")
    ddl = schema_fit.create_table_ddl("t", schema, "PostgreSQL")
    assert ddl == 'CREATE TABLE t (id BIGSERIAL PRIMARY KEY, "n" BIGINT, "x" DOUBLE, "t" VARCHAR(2000))'
    assert schema_fit.create_table_ddl("t", T.StructType.fromDDL("ID bigint"), "H2") == 'CREATE TABLE t ("ID" BIGINT)'


def test_fit_schema_policies(spark):
    df = spark.createDataFrame([("x", "abcdef")], "n string, s string")
    target = T.StructType.fromDDL("n int, s string, extra int")
    row = schema_fit.fit_schema(df, target, {"s": 3}).first()
    assert (row.n, row.s, row.extra, row.errors) == (None, "abc", None, ["type:n", "length:s"])
    assert "extra" not in schema_fit.fit_schema(df, target, on_missing="skip").columns
    with pytest.raises(ValueError):
        schema_fit.fit_schema(df, target, on_missing="fail")
    with pytest.raises(Exception, match="too long"):
        schema_fit.fit_schema(df, target, {"s": 3}, on_long="fail").collect()


def test_file_output_is_cut_by_rows(spark, tmp_path):
    for fmt, options in (("csv", {"header": "true"}), ("json", {}), ("xml", {"rowTag": "row"})):
        path = str(tmp_path / fmt)
        sinks.write_files(spark.range(10).coalesce(1), path, fmt, 4, **options)
        assert len(list((tmp_path / fmt).glob("part-*"))) == 3
        assert spark.read.format(fmt).options(**options).load(path).count() == 10


def test_payloads(spark):
    df = spark.sql("SELECT 1 AS id, CAST(NULL AS string) AS a, 'x y&z' AS b, array(1, 2) AS c")
    assert df.select(sinks.push_payload(df)).first()[0] == '{"id":1,"b":"x y&z","c":[1,2]}'
    assert df.select(sinks.push_params(df)).first()[0] == {"id": "1", "b": "x y&z", "c": "[1,2]"}
    assert df.select(sinks.form_encode(df, ["id"], {"a": "p", "q": "1"})).first()[0] == "a=p&b=x+y%26z&q=1"


def test_append_skips_empty_rows_and_repeats_in_place(spark):
    path = scratch(spark, "a")
    df = spark.createDataFrame([(1,), (None,)], "a int")
    for run in ("r1", "r2", "r2"):
        sinks.append(df, path, run)
    assert sinks.read_appended(spark, path).count() == 2


def test_ad_hoc_and_catalog(spark, rows):
    spark.range(3).createOrReplaceTempView("zz_three")
    assert rows(tables.ad_hoc(spark, "WITH t AS (SELECT * FROM zz_three) SELECT max(id) AS m FROM t")) == [(2,)]
    with pytest.raises(ValueError, match="repeated"):
        tables.ad_hoc(spark, "SELECT id, id FROM zz_three")
    assert tables.is_read("with x as (select 1) select * from x") and not tables.is_read("INSERT INTO t VALUES (1)")
    assert tables.table_exists(spark, "ZZ_THREE") and not tables.table_exists(spark, "nope")
    assert ("zz_three", 1, 3) in rows(catalog.catalog_inventory(spark))
    assert tables.default_table(spark) == sorted(t.name for t in spark.catalog.listTables())[0]
    profile = catalog.profile(spark.range(5), "approx").first()
    assert (profile.column_name, profile.null_count, profile.min_value, profile.max_value) == ("id", 0, "0", "4")
