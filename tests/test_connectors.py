import json
import uuid

import pytest
from pyspark.sql import functions as F

from millrace.engine import run_flow
from millrace.operators import json_ops
from millrace.sources import jdbc, rest
from millrace.spec import FlowSpec, Strategy
from millrace.streaming import incremental
from millrace.workspace import scratch


@pytest.fixture
def derby():
    return jdbc.JdbcTarget("Derby", f"memory:{uuid.uuid4().hex}")


def test_jdbc_roundtrip_partitions_and_pushdown(spark, derby, rows):
    jdbc.append(spark.range(100).selectExpr("id AS ID", "concat('n', id) AS NAME"), derby, "T")
    parts = jdbc.read(spark, derby, "T", "ID", 4)
    assert parts.rdd.getNumPartitions() == 4 and parts.count() == 100
    newer = jdbc.read(spark, derby, "T", init_sql="VALUES 1").where(F.col("ID") > 90)
    assert newer.count() == 9
    assert "PushedFilters: [*IsNotNull(ID), *GreaterThan(ID,90)]" in newer._jdf.queryExecution().toString()


def test_jdbc_upsert_last_wins(spark, derby, rows):
    ddl = jdbc.create_table(spark, derby, "U", spark.sql("SELECT 1L AS id, 'x' AS a, 1 AS seq"))
    assert ddl.startswith("CREATE TABLE U")
    jdbc.execute(spark, derby, ["INSERT INTO U VALUES (1, 'old', 0)"])
    batch = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (2, "c", 1)], "id long, a string, seq int")
    for _ in range(2):
        jdbc.upsert(batch, derby, "U", ["id"], ["seq"])
    assert rows(jdbc.read(spark, derby, "U").selectExpr("id", "a")) == [(1, "b"), (2, "c")]


def test_jdbc_upsert_settles_keeps_values_and_drops_its_stage(spark, derby, rows):
    shape = spark.createDataFrame([], "id long, a string, b string")
    assert jdbc.create_table(spark, derby, "V", shape, ["id"]).endswith('UNIQUE ("id"))')
    batch = spark.createDataFrame([(1, "a", None), (1, None, "b"), (2, "c", "d")], shape.schema)
    jdbc.upsert(batch, derby, "V", ["id"])
    jdbc.upsert(spark.createDataFrame([(2, None, "e"), (None, "n", "n")], shape.schema), derby, "V", ["id"])
    assert rows(jdbc.read(spark, derby, "V").select("id", "a", "b")) == [(1, "a", "b"), (2, "c", "e"), (None, "n", "n")]
    assert [t for t in jdbc.list_tables(spark, derby) if t.upper().startswith("V_S")] == []


def test_jdbc_sink_in_a_flow(spark, derby):
    state = scratch(spark, "state")
    assert not jdbc.table_exists(spark, derby, "f")
    flow = FlowSpec(1, "f", Strategy.INCREMENTAL_ID, "id", "NUMERIC")
    for high in (3, 5):
        run_flow(spark, flow, spark.range(high), jdbc.JdbcSink(derby, "F"), state)
    assert jdbc.read(spark, derby, "F").count() == 5
    assert jdbc.table_exists(spark, derby, "f") and "F" in jdbc.list_tables(spark, derby)
    assert jdbc.ad_hoc(spark, derby, 'SELECT max("id") AS m FROM F').first()[0] == 4
    assert jdbc.ad_hoc(spark, derby, 'DELETE FROM F WHERE "id" < 2') == 2
    assert jdbc.default_table(spark, derby) in jdbc.list_tables(spark, derby)


def test_failed_statement_rolls_back(spark, derby):
    jdbc.create_table(spark, derby, "R", spark.range(1))
    with pytest.raises(Exception):
        jdbc.execute(spark, derby, ["INSERT INTO R VALUES (1)", "INSERT INTO NO_SUCH VALUES (1)"])
    assert jdbc.read(spark, derby, "R").count() == 0


@pytest.mark.parametrize("kind, start", [
    ("MySQL", "INSERT INTO t (`id`, `a`) SELECT"), ("PostgreSQL", 'INSERT INTO t ("id", "a") SELECT'),
    ("Oracle", "MERGE INTO t t USING s s"), ("SQLite", "UPDATE t SET")])
def test_merge_statement_forms(kind, start):
    assert jdbc.merge_statements(kind, "t", "s", ["id", "a"], ["id"])[0].startswith(start)


@pytest.mark.parametrize("kind, kept", [
    ("MySQL", "`a` = COALESCE(VALUES(`a`), t.`a`)"), ("PostgreSQL", '"a" = COALESCE(EXCLUDED."a", t."a")'),
    ("Oracle", '"a" = COALESCE(s."a", t."a")'), ("SQLite", '"a" = COALESCE((SELECT s."a" FROM s s WHERE t."id" = s."id"), "a")')])
def test_merge_statements_keep_values_on_null(kind, kept):
    assert kept in jdbc.merge_statements(kind, "t", "s", ["id", "a"], ["id"])[0]
    assert "COALESCE" not in jdbc.merge_statements(kind, "t", "s", ["id", "a"], ["id"], "overwrite")[0]


@pytest.mark.parametrize("kind, url", [
    ("PostgreSQL", "jdbc:postgresql://h:5432/d"), ("Oracle", "jdbc:oracle:thin:@h:1521:d"),
    ("H2", "jdbc:h2:d;MODE=MySQL"), ("Trino", "jdbc:trino://h:8080/d"),
    ("Presto", "jdbc:presto://h:8080/d"),
    ("Other", "jdbc:other://h:9/d"), ("Drill", "jdbc:drill:drillbit=h:31010")])
def test_urls(kind, url):
    port = 9 if kind == "Other" else None
    target = jdbc.JdbcTarget(kind, "d", "h", port, "u", "secret", params="a=1&b=2=3&c")
    assert target.url() == url and "secret" not in repr(target)
    options = target.options()
    assert (options["a"], options["b"], options["user"]) == ("1", "2=3", "u") and "c" not in options


def test_mariadb_url_fits_its_own_driver():
    assert jdbc.JdbcTarget("MariaDB", "d", "h").url().startswith("jdbc:mariadb://h:3306/d")


def serve(folder, answers):
    from urllib.parse import quote
    for request, body in answers.items():
        (folder / quote(request, safe="")).write_text(body if isinstance(body, str) else json.dumps(body))
    return rest.FileTransport(str(folder))


def test_rest_single_and_variables(spark, tmp_path):
    transport = serve(tmp_path, {"GET http://x/a?k=1": {"data": [{"id": 1}, {"id": 2}]}})
    body = rest.read(spark, transport, "http://x/{{p}}?k=${v}", variables={"p": "a", "v": "1"})
    out = json_ops.response_rows(body, "body", "id int", ["page"])
    assert sorted(r.id for r in out.collect()) == [1, 2]


def test_rest_offset_pages_are_read_in_parallel(spark, tmp_path):
    pages = {f"GET http://x?o={o}&s=2": {"count": 5, "items": [{"id": i} for i in range(o, min(o + 2, 5))]} for o in (0, 2, 4)}
    body = rest.read(spark, serve(tmp_path, pages), "http://x?o=${offset}&s=${size}", paging="offset", pagesize="2", callspertask="1")
    assert body.rdd.getNumPartitions() == 3
    out = json_ops.response_rows(body, "body", "id int", ["page"])
    assert sorted(r.id for r in out.collect()) == list(range(5))


def test_rest_page_numbers_stop_at_short_page(spark, tmp_path):
    for last in (1, 2, 6):
        folder = tmp_path / str(last)
        folder.mkdir()
        full = {f"GET http://x?p={p}": {"d": {"r": [{"id": p}, {"id": p}]}} for p in range(1, last)}
        past = {f"GET http://x?p={p}": {"d": {"r": []}} for p in range(last + 1, 20)}
        pages = {**full, f"GET http://x?p={last}": {"d": {"r": [{"id": last}]}}, **past}
        body = rest.read(spark, serve(folder, pages), "http://x?p=${page}", paging="page", pagesize="2",
                         itemspath="d.r", callspertask="2")
        out = json_ops.nested_extract(body, "body", "d.r", [("id", "id")], ["page"])
        assert sorted(int(r.id) for r in out.collect()) == sorted([*range(1, last + 1), *range(1, last)])


def test_rest_failure_fails_the_read(spark, tmp_path):
    with pytest.raises(Exception, match="HTTP 404"):
        rest.read(spark, rest.FileTransport(str(tmp_path)), "http://x/none").collect()


def test_auth():
    sign = lambda kind, **c: rest.authorised(rest.Request("http://x"), kind, c)
    assert sign("BASIC", username="u", password="p").headers["Authorization"] == "Basic dTpw"
    assert sign("bearer", token="t").headers["Authorization"] == "Bearer t"
    assert sign("API_KEY", key="k", value="v").headers == {"k": "v"}
    assert sign("API_KEY", key="k", value="v", location="query").url == "http://x?k=v"
    assert sign("NONE").headers == {}


def test_chain(tmp_path):
    transport = serve(tmp_path, {"POST http://x/login": {"data": {"token": "T", "n": {"a": 1}}},
                                 "GET http://x/rows?t=T": "plain body"})
    steps = [{"name": "login", "url": "http://x/login", "method": "POST", "body": "{}",
              "extract": {"t": "data.token", "n": "data.n", "none": "data.token.x"}},
             {"url": "http://x/rows?t=${t}", "extract": {"raw": "a.b"}}]
    done = rest.run_chain(transport, steps)
    assert done.ok and done.variables == {"t": "T", "n": '{"a": 1}', "raw": "plain body"} and done.last_body == "plain body"
    failed = rest.run_chain(transport, [*steps, {"name": "third", "url": "http://x/no"}, steps[0]])
    assert not failed.ok and failed.error == "third failed: HTTP 404"


def test_push_reports_per_row(spark, tmp_path):
    transport = serve(tmp_path, {"POST http://x/1": "ok"})
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    out = rest.push(df, transport, "id", "http://x/${id}").orderBy("key").collect()
    assert [(r.key, r.ok, r.status, r.error) for r in out] == [("1", True, 200, None), ("2", False, 404, "HTTP 404")]


def test_stream_drop_duplicates_within_watermark(spark, tmp_path):
    data = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:05"), (2, "2024-01-01 00:00:06")]
    frame = spark.createDataFrame(data, "id int, at string").withColumn("at", F.col("at").cast("timestamp"))
    frame.write.parquet(str(tmp_path / "in"))
    stream = incremental.file_stream(spark, str(tmp_path / "in"), frame.schema)
    once = incremental.stream_drop_duplicates(stream, "id", "at", "1 hour")
    query = (once.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c"))
             .trigger(availableNow=True).start(str(tmp_path / "out")))
    query.awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_repeated_stream_batch_writes_the_same(spark, tmp_path):
    schema = spark.range(1).selectExpr("id", "id AS at").schema
    for n in range(2):
        spark.range(5 + n).selectExpr("id", "id AS at").write.mode("append").parquet(str(tmp_path / "in"))
        stream = incremental.file_stream(spark, str(tmp_path / "in"), schema)
        incremental.stream_not_synced(spark, stream, str(tmp_path / "t"), str(tmp_path / f"c{n}"), "id", ["at"], schema)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "t")).collect()) == list(range(6))


class Listing:
    """Rows of a metadata listing, as a database's driver hands them over."""

    def __init__(self, *tables):
        self.tables, self.at = tables, -1

    def getTables(self, catalog, schema, name, kinds):
        self.tables = [t for t in self.tables if t[1] in kinds]
        return self

    def next(self):
        self.at += 1
        return self.at < len(self.tables)

    def getString(self, column):
        return self.tables[self.at][["TABLE_NAME", "TABLE_TYPE", "TABLE_SCHEM", "REMARKS"].index(column)]


def test_views_schemas_and_remarks_are_listed():
    listing = [("ORDERS", "TABLE", "SALES", "all orders"), ("open", "VIEW", None, None), ("T", "TABLE", "APP", "")]
    found = jdbc.reported(Listing(*listing), ["TABLE", "VIEW"])
    assert found[0] == jdbc.TableInfo("ORDERS", "TABLE", "SALES", "all orders") and [t.kind for t in found] == ["TABLE", "VIEW", "TABLE"]
    assert [t.name for t in jdbc.reported(Listing(*listing), ["TABLE"])] == ["ORDERS", "T"]
    there = ["orders", "ORDERS", "sales.orders", "SALES.ORDERS", '"SALES"."ORDERS"', "open", "app.t"]
    assert all(jdbc.is_reported(found, name) for name in there)
    assert not any(jdbc.is_reported(found, name) for name in ["app.orders", "order", "sales", "x.open"])


@pytest.mark.parametrize("kind, types", [
    ("PostgreSQL", ["INTEGER", "BIGINT", "DECIMAL(20,4)", "DOUBLE PRECISION", "BOOLEAN", "DATE", "TIMESTAMP", "TEXT", "BYTEA", "TEXT"]),
    ("MySQL", ["INTEGER", "BIGINT", "DECIMAL(20,4)", "DOUBLE", "TINYINT(1)", "DATE", "DATETIME(6)", "LONGTEXT", "LONGBLOB", "LONGTEXT"]),
    ("Oracle", ["NUMBER(10)", "NUMBER(19)", "DECIMAL(20,4)", "DOUBLE PRECISION", "NUMBER(1)", "DATE", "TIMESTAMP", "CLOB", "BLOB", "CLOB"]),
])
def test_full_column_types(kind, types):
    from pyspark.sql import types as T

    from millrace.operators.schema_fit import create_table_ddl, full_type
    kinds = [T.IntegerType(), T.LongType(), T.DecimalType(20, 4), T.DoubleType(), T.BooleanType(), T.DateType(), T.TimestampType(), T.StringType(),
             T.BinaryType(), T.ArrayType(T.StringType())]
    assert [full_type(t, kind) for t in kinds] == types
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("k", T.StringType()), T.StructField("t", T.TimestampType())])
    ddl = create_table_ddl("t", schema, kind, ["k"], full=True)
    assert "VARCHAR(255)" in ddl and types[6] in ddl and types[1] in ddl


def test_rows_without_a_key_are_inserted_in_the_same_transaction(spark, monkeypatch):
    ran = []
    monkeypatch.setattr(jdbc, "append", lambda df, target, table, **options: ran.append(("stage", df.count())))
    monkeypatch.setattr(jdbc, "execute", lambda spark, target, statements: ran.append([text.split(" ")[0] for text in statements]))
    batch = spark.createDataFrame([(1, "a"), (None, "b"), (None, "b")], "id long, v string")
    jdbc.upsert(batch, jdbc.JdbcTarget("PostgreSQL", "d"), "s.t", ["id"])
    assert ran == [("stage", 1), ("stage", 2), ["INSERT", "INSERT"], ["DROP"], ["DROP"]]
