"""Ranges of a skewed key, profiles from sketches, script functions, running totals, files cut by bytes."""

import datetime as dt
import glob
import os
import sys
from decimal import Decimal

import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from millrace.operators import cut_files, sinks
from millrace.operators.prefix import prefix_sums
from millrace.sources import ranges, scripts, sketches
from millrace.workspace import flat_schema

cloudpickle.register_pickle_by_value(sys.modules[__name__])


# running totals

def test_prefix_sums_over_ranges_and_as_rows_lie(spark):
    df = spark.range(1000).selectExpr("id", "id % 7 AS v", "-id AS back").repartition(6)
    ordered = prefix_sums(df, F.col("v"), "before", [F.col("back")])
    assert {r.id: r.before for r in ordered.collect()} == {i: sum(j % 7 for j in range(i + 1, 1000)) for i in range(1000)}
    lying = prefix_sums(df, F.lit(1), "nth").collect()
    assert sorted(r.nth for r in lying) == list(range(1000)) and ordered.columns == ["id", "v", "back", "before"]
    assert prefix_sums(df.limit(0), F.col("v"), "before").count() == 0


# ranges

@pytest.mark.parametrize("sql", ["id * id * id", "concat('k''', id * id)", "CAST(pow(id, 3) AS DECIMAL(30,2))", "date_add(DATE '2000-01-01', int(id * id))",
                                 "timestamp_seconds(id * id * id)"])
def test_ranges_hold_every_row_once_and_evenly(spark, sql):
    df = spark.range(1, 400).selectExpr(f"CASE WHEN id % 50 = 0 THEN NULL ELSE {sql} END AS k", "id", "explode(sequence(1, 1 + int(id % 9))) AS n")
    cuts = ranges.cut_points(df.groupBy("k").agg(F.count("*").alias("rows")), "k", "rows", 6)
    conditions = ranges.predicates("k", cuts)
    assert len(conditions) == 6
    parts = [df.where(c).count() for c in conditions]
    assert sum(parts) == df.count() and max(parts) <= 2 * df.count() / 6
    found = sum((df.where(c).select("id", "n").collect() for c in conditions), [])
    assert sorted(map(tuple, found)) == sorted(map(tuple, df.select("id", "n").collect()))


def test_ranges_of_few_or_no_keys(spark):
    counts = spark.createDataFrame([(1, 1000), (2, 1), (None, 7)], "k int, rows bigint")
    assert ranges.cut_points(counts, "k", "rows", 4) == [2]
    assert ranges.predicates("k", [2]) == ["k < 2 OR k IS NULL", "k >= 2"]
    assert ranges.cut_points(counts.where("k IS NULL"), "k", "rows", 4) == [] and ranges.predicates("k", []) == ["1 = 1"]


def test_range_texts_for_a_database():
    assert [ranges.literal(v) for v in (True, 3, Decimal("1.50"), "o'k", dt.date(2024, 1, 2), dt.datetime(2024, 1, 2, 3, 4, 5, 60))] == [
        "TRUE", "3", "1.50", "'o''k'", "DATE '2024-01-02'", "TIMESTAMP '2024-01-02 03:04:05.000060'"]
    assert ranges.counts_query("s.t", "k") == "SELECT k AS CUT_KEY, COUNT(*) AS CUT_ROWS FROM s.t GROUP BY k"
    assert ranges.order_query("t", "k", ["a", "b"]) == "SELECT DISTINCT k AS CUT_KEY FROM t WHERE k IN ('a', 'b') ORDER BY k"


# sketches

def test_profile_merges_state_and_repeats_in_place(spark, tmp_path):
    df = spark.range(3000).selectExpr("id", "id % 10 AS few", "IF(id % 4 = 0, NULL, concat('t', id % 100)) AS text", "CAST('NaN' AS DOUBLE) AS nan",
                                      "array(id % 3) AS list", "CAST(NULL AS INT) AS nothing")
    for _ in range(2):
        for part in range(3):
            sketches.add(df.where(f"id % 3 = {part}"), str(tmp_path), f"p{part}")
    rows = {r.column_name: r for r in sketches.profile(spark, str(tmp_path)).collect()}
    assert {r["rows"] for r in rows.values()} == {3000}
    assert abs(rows["id"].distinct_count - 3000) <= 150 and rows["few"].distinct_count == 10 and rows["list"].distinct_count == 3
    assert rows["text"].null_count == 750 and (rows["text"].min_text, rows["text"].max_text) == ("t1", "t99")
    assert all(abs(q - want) <= 60 for q, want in zip(rows["id"].quartiles, (750, 1500, 2250)))
    assert (rows["id"].min_number, rows["id"].max_number, rows["id"].max_length) == (0.0, 2999.0, 4)
    assert rows["nan"].quartiles is None and rows["nothing"].null_count == 3000 and rows["nothing"].distinct_count == 0
    one = {r.column_name: r["rows"] for r in sketches.profile(spark, str(tmp_path), ["p1"]).collect()}
    assert one["id"] == 1000


def test_profile_reads_no_data_again(spark, tmp_path):
    spark.range(100).write.parquet(str(tmp_path / "data"))
    sketches.add(spark.read.parquet(str(tmp_path / "data")), str(tmp_path / "state"), "a")
    for file in glob.glob(str(tmp_path / "data" / "*.parquet")):
        os.remove(file)
    assert sketches.profile(spark, str(tmp_path / "state")).first()["rows"] == 100


# scripts

def out_schema(options, given):
    return flat_schema(name="string", **{f"{f.name}_{options['tag']}": "bigint" for f in given.fields if f.name == "v"})


def running(row, options, memory):
    memory["sum"] = memory.get("sum", 0) + row["v"]
    memory["name"] = row["g"]
    yield row["g"], memory["sum"]


def closing(options, memory):
    yield f"end of {memory['name']}", memory["sum"]


def test_script_from_sql_and_frame(spark):
    df = spark.createDataFrame([("a", 2, 20), ("a", 1, 10), ("b", 1, 5), (None, 1, 1)], "g string, at int, v int")
    scripts.register(spark, "sums", scripts.Script(out_schema, running, closing), ["g"], ["at"])
    want = [(None, 1), ("a", 10), ("a", 30), ("b", 5), ("end of None", 1), ("end of a", 30), ("end of b", 5)]
    by_sql = spark.sql("SELECT * FROM sums(TABLE({t}), '{{\"tag\": \"x\"}}')", t=df)
    assert by_sql.columns == ["name", "v_x"] and sorted(map(tuple, by_sql.collect()), key=repr) == sorted(want, key=repr)
    call = scripts.table_function(scripts.Script(out_schema, running))
    by_frame = call(df.asTable().partitionBy("g").orderBy("at"), F.lit('{"tag": "y"}'))
    assert by_frame.columns == ["name", "v_y"] and sorted(map(tuple, by_frame.collect()), key=repr) == sorted(want[:4], key=repr)
    assert spark.sql("SELECT * FROM sums(TABLE({t}), '{{\"tag\": \"x\"}}')", t=df.limit(0)).collect() == []


def test_script_refuses_tables_without_its_columns(spark):
    scripts.register(spark, "sums2", scripts.Script(out_schema, running), ["g"], ["at"])
    with pytest.raises(Exception, match="lacks"):
        spark.sql("SELECT * FROM sums2(TABLE({t}), '{{\"tag\": \"x\"}}')", t=spark.range(2))


# files

@pytest.mark.parametrize("fmt, options", [("json", {}), ("csv", {}), ("csv", {"header": "true", "sep": ";"})])
def test_files_are_cut_by_bytes(spark, tmp_path, fmt, options):
    long = {3: 700, 40: 5000, 41: 5000}
    data = [(i, "é\"" * long.get(i, i % 40), None if i % 5 else 1.5) for i in range(300)] + [(None, None, None)]
    df = spark.createDataFrame(data, "i int, text string, x double").repartition(5)
    sinks.write_files(df, str(tmp_path), fmt, max_bytes_per_file=2000, **options)
    back = spark.read.schema("i int, text string, x double").options(**options).option("escape", "\\").format(fmt).load(str(tmp_path))
    kept = back.select("i", F.length("text").alias("n"), "_metadata.file_path", "_metadata.file_size").collect()
    assert sorted((r.i, r.n or 0) for r in kept if r.i is not None) == [(i, len(t)) for i, t, _ in data if i is not None]
    # JSON keeps a row of nulls; CSV writes it as separators alone.
    assert len(kept) == 301
    files = {}
    for r in kept:
        files.setdefault(r.file_path, []).append(r)
    assert all(len(rows) == 1 or rows[0].file_size <= 2000 for rows in files.values())
    assert all(len(rows) == 1 for rows in files.values() if any(r.i in long for r in rows))
    sizes = sorted(rows[0].file_size for rows in files.values() if len(rows) > 1)
    assert sizes[len(sizes) // 2] > 1500, "most files are nearly full"


def test_other_formats_are_not_cut_by_bytes(spark, tmp_path):
    with pytest.raises(ValueError, match="cannot be cut"):
        sinks.write_files(spark.range(3), str(tmp_path), "xml", max_bytes_per_file=100, rowTag="r")


@pytest.mark.parametrize("fmt, options", [("json", {}), ("csv", {"header": "true", "sep": ";"}), ("csv", {"lineSep": "\x1e"})])
def test_many_small_files_hold_what_the_file_writer_writes(spark, tmp_path, fmt, options):
    data = [(i, text, None if i % 5 else 1.5, dt.datetime(2024, 1, 1 + i % 9, 5)) for i, text in enumerate(
        [None, "", " a ", "é\"b", "x;y,z", "#c", "\\", "two\nlines", "null"] * 30)] + [(None, None, None, None)]
    df = spark.createDataFrame(data, "i int, `te;xt` string, x double, t timestamp").repartition(4)
    cut, whole = tmp_path / "cut", tmp_path / "whole"
    for _ in range(2):  # the second write replaces the first
        sinks.write_files(df, str(cut), fmt, max_bytes_per_file=200, order=[F.col("i")], **options)
    df.coalesce(1).write.format(fmt).options(**options).save(str(whole))
    end = options.get("lineSep", "\n").encode()
    (want,) = whole.glob("part-*")
    head, *lines = want.read_bytes().split(end)[:-1]
    if fmt == "json" or "header" not in options:
        head, lines = None, [head, *lines]
    files = [f for f in cut.rglob(f"*.{fmt}") if f.is_file()]
    parts = [f.read_bytes().split(end)[:-1] for f in files]
    assert len(files) > 50 and all(f.stat().st_size <= 200 or len(p) - (head is not None) == 1 for f, p in zip(files, parts))
    assert head is None or all(p[0] == head for p in parts)
    assert sorted(line for p in parts for line in p[head is not None:]) == sorted(lines)
    assert len([f for f in cut.rglob("*") if f.is_dir()]) <= 8, "a folder for a task, not for a file"


def test_files_cut_by_bytes_of_no_rows_and_of_rows_that_encode_to_nothing(spark, tmp_path):
    for name, df in (("none", spark.range(0)), ("blank", spark.sql("SELECT CAST(NULL AS string) AS id FROM range(3)"))):
        sinks.write_files(df, str(tmp_path / name), "csv", max_bytes_per_file=100)
        assert spark.read.schema("id string").csv(str(tmp_path / name)).count() == 0
    some = spark.sql("SELECT IF(id = 1, NULL, 'x' || id) AS id FROM range(3)")
    sinks.write_files(some, str(tmp_path / "some"), "csv", max_bytes_per_file=100)
    assert sorted(r.id for r in spark.read.schema("id string").csv(str(tmp_path / "some")).collect()) == ["x0", "x2"]


def test_compressed_files_and_values_that_csv_refuses_are_left_to_the_file_writer(spark, tmp_path):
    sinks.write_files(spark.range(100), str(tmp_path / "z"), "json", max_bytes_per_file=100, compression="gzip")
    assert spark.read.json(str(tmp_path / "z")).count() == 100 and [*(tmp_path / "z").rglob("*.json.gz")]
    with pytest.raises(Exception, match="CSV"):
        sinks.write_files(spark.range(3).select(F.array("id").alias("ids")), str(tmp_path / "a"), "csv", max_bytes_per_file=100)


def test_files_of_tasks_that_do_not_count_are_not_read(tmp_path):
    def task(writer, *rows):
        names, lines = zip(*rows)
        return writer.write(iter([pa.record_batch([pa.array(names), pa.array(lines, pa.binary())], ["_file", "_line"])]))

    options = {"root": str(tmp_path / "a"), "suffix": ".csv", "end": "\n", "head": "h"}
    writer = cut_files.CutFilesWriter(options)
    lost = task(writer, ("f0", b"1"), ("f0", b"2"))
    kept = task(writer, ("f0", b"1"), ("f0", b"2"), ("f1", b"3"))
    assert lost != kept and writer.write(iter([])).path is None
    writer.commit([kept, writer.write(iter([])), None])
    found = {f.name: f.read_bytes() for f in (tmp_path / "a").rglob("*.csv")}
    assert found == {"f0.csv": b"h\n1\n2\n", "f1.csv": b"h\n3\n"} and len([*(tmp_path / "a").rglob("*.csv")]) == 2
    failed = cut_files.CutFilesWriter(options | {"root": str(tmp_path / "b")})
    failed.abort([task(failed, ("f0", b"1"))])
    assert not [*(tmp_path / "b").rglob("*")]
