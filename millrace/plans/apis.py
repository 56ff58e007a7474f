"""Reading APIs: a single call, a chain of calls, and both ways of paging, answered from bodies that Spark wrote."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import json_ops
from millrace.plans.bodies import body_of, write_bodies
from millrace.plans.catalogue import query
from millrace.sources import rest, tables
from millrace.sources.rest import Request, Response, run_chain
from millrace.workspace import scratch

PAGE = 50


@dataclass(frozen=True)
class Answers:
    """An API over the bodies of pages; pages are asked for by ``page`` or by ``offset`` and ``size``."""

    root: str
    token: str | None = None

    def __call__(self, request: Request) -> Response:
        if self.token and request.headers.get("Authorization") != f"Bearer {self.token}":
            return Response(401, "")
        number = re.search(r"page=(\d+)", request.url)
        offset = re.search(r"offset=(\d+)&size=(\d+)", request.url)
        page = int(number.group(1)) if number else int(offset.group(1)) // int(offset.group(2)) if offset else 0
        body = body_of(self.root, page)
        return Response(200, json.dumps({"count": 0, "items": []}) if body is None else body)


def served(spark: SparkSession, rows: DataFrame, key: str, page: int | None = PAGE) -> str:
    """Write the rows as bodies ``{"count": …, "items": […]}`` of ``page`` rows each, or as one; gives the folder."""
    root = scratch(spark, "api")
    total = rows.agg(F.count("*").alias("n")).select("n").scalar()
    number = F.expr(f"{key} div {page}") if page else F.lit(0).cast("bigint")
    write_bodies(rows, number, F.struct(key, *[c for c in rows.columns if c != key]), root, count=total)
    return root


def _items(answers: DataFrame, schema: str) -> DataFrame:
    return json_ops.response_rows(answers, "body", schema, ["page"])


@query("rest_single", "SELECT n_nationkey, n_name, CAST(0 AS INTEGER) AS page FROM nation")
def rest_single(spark: SparkSession, d: str) -> DataFrame:
    """One call with a variable in its address and a token in its header."""
    root = served(spark, tables.parquet(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey", None)
    answers = rest.read(spark, Answers(root, "t0"), "api://{{what}}", variables={"what": "nations"}, auth="BEARER", authconfig={"token": "t0"})
    return _items(answers, "n_nationkey int, n_name string").select("n_nationkey", "n_name", "page")


@dataclass(frozen=True)
class Login:
    """Gives a token for a POST, and answers other calls that bring it."""

    inner: Answers

    def __call__(self, request: Request) -> Response:
        if request.url == "api://login":
            user = json.loads(request.body or "{}").get("user")
            return Response(200, json.dumps({"session": {"token": f"of {user}"}})) if request.method == "POST" and user else Response(403, "")
        return self.inner(request)


@query("rest_chain", "SELECT r_regionkey, r_name, 'of reader' AS token FROM region")
def rest_chain(spark: SparkSession, d: str) -> DataFrame:
    """Log in, then fetch with the token of the first answer; the last answer becomes rows."""
    root = served(spark, tables.parquet(spark, d, "region").select("r_regionkey", "r_name"), "r_regionkey", None)
    steps = [{"name": "login", "url": "api://login", "method": "POST", "body": '{"user": "${who}"}', "extract": {"token": "session.token"}},
             {"name": "fetch", "url": "api://regions", "headers": {"Authorization": "Bearer ${token}"}}]
    result = run_chain(Login(Answers(root, "of reader")), steps, {"who": "reader"})
    if not result.ok:
        raise RuntimeError(result.error)
    answer = spark.range(0, 1, 1, 1).select(F.lit(result.last_body).alias("body"), F.create_map(
        *[F.lit(part) for pair in sorted(result.variables.items()) for part in pair]).alias("variables"))
    rows = json_ops.chain_result_rows(answer, "body", "variables", ["variables"])
    fields = F.from_json("item", "r_regionkey int, r_name string")
    return rows.select(fields["r_regionkey"].alias("r_regionkey"), fields["r_name"].alias("r_name"), F.col("variables")["token"].alias("token"))


_ORDERS = "o_orderkey bigint, o_orderstatus string"


@query("rest_pages", f"SELECT o_orderkey, o_orderstatus, CAST(o_orderkey // {PAGE} AS INTEGER) AS page FROM orders")
def rest_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages by number until a short one, found by probing and read by many tasks."""
    root = served(spark, tables.parquet(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey")
    answers = rest.read(spark, Answers(root), "api://orders?page={{page}}", paging="page", pagesize=str(PAGE), firstpage="0", itemspath="items")
    return _items(answers, _ORDERS).select("o_orderkey", "o_orderstatus", "page")


@query("rest_offsets", f"SELECT o_orderkey, o_orderstatus, CAST(o_orderkey // {PAGE} AS INTEGER) AS page FROM orders")
def rest_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Pages by offset, as many as the total in the first answer says."""
    root = served(spark, tables.parquet(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey")
    answers = rest.read(spark, Answers(root), "api://orders?offset={{offset}}&size={{size}}", paging="offset", pagesize=str(PAGE), totalpath="count")
    return _items(answers, _ORDERS).select("o_orderkey", "o_orderstatus", "page")
