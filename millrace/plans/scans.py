"""Sources: full and incremental scans, catalog jobs, ad-hoc SQL, pages, response bodies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import sync
from millrace.operators import json_ops
from millrace.plans.catalogue import TABLES, middle, query
from millrace.sources import catalog, ranges, scripts, sketches, tables
from millrace.workspace import flat_schema, materialise, scratch

TIME_MARK = "2024-01-15 00:00:00"
DATE_MARK = "1998-01-01 00:00:00"


@query("scan_full", "SELECT * FROM orders")
def scan_full(spark: SparkSession, d: str) -> DataFrame:
    return tables.parquet(spark, d, "orders")


@query("incr_id_scan", """
SELECT * FROM orders
WHERE o_orderkey > (SELECT (min(o_orderkey) + max(o_orderkey)) // 2 FROM orders)""")
def incr_id_scan(spark: SparkSession, d: str) -> DataFrame:
    orders = tables.parquet(spark, d, "orders")
    return sync.newer_by_id(orders, "o_orderkey", middle(orders, "o_orderkey"))


@query("incr_time_scan", f"SELECT * FROM events WHERE ts >= TIMESTAMP '{TIME_MARK}'")
def incr_time_scan(spark: SparkSession, d: str) -> DataFrame:
    return sync.newer_by_time(tables.parquet(spark, d, "events"), "ts", TIME_MARK)


@query("topk_incremental", f"""
SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '{DATE_MARK}' AND o_orderdate <= (
  SELECT max(o_orderdate) FROM (SELECT o_orderdate FROM orders
    WHERE o_orderdate >= TIMESTAMP '{DATE_MARK}' ORDER BY o_orderdate LIMIT 1000))""")
def topk_incremental(spark: SparkSession, d: str) -> DataFrame:
    newer = sync.newer_by_time(tables.parquet(spark, d, "orders"), "o_orderdate", DATE_MARK)
    return sync.capped(newer, "o_orderdate", 1000)


@query("catalog_tables", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, (SELECT count(*) FROM (DESCRIBE {t})) AS column_count, "
    f"(SELECT count(*) FROM {t}) AS row_count"
    for t in TABLES))
def catalog_tables(spark: SparkSession, d: str) -> DataFrame:
    return catalog.inventory({t: tables.parquet(spark, d, t) for t in TABLES})


_PROFILED = [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
             ("c_acctbal", "double"), ("c_mktsegment", "string")]


@query("catalog_columns", " UNION ALL ".join(f"""
SELECT '{c}' AS column_name, '{t}' AS type, true AS nullable, count(*) - count({c}) AS null_count,
  count(DISTINCT {c}) AS distinct_count, CAST(min({c}) AS VARCHAR) AS min_value,
  CAST(max({c}) AS VARCHAR) AS max_value, max(length(CAST({c} AS VARCHAR))) AS max_length
FROM customer""" for c, t in _PROFILED))
def catalog_columns(spark: SparkSession, d: str) -> DataFrame:
    return catalog.profile(tables.parquet(spark, d, "customer"))


@query("preview", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 20")
def preview(spark: SparkSession, d: str) -> DataFrame:
    return tables.preview(tables.parquet(spark, d, "orders"), ["o_orderkey"], 20)


_AD_HOC = """
WITH sales AS (
  SELECT r.r_name AS region, n.n_name AS nation, c.c_mktsegment AS segment,
         sum(CAST(o.o_totalprice AS DECIMAL(18, 2))) AS total, count(*) AS orders
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  GROUP BY ROLLUP (r.r_name, n.n_name, c.c_mktsegment)
)
SELECT region, nation, segment, CAST(total AS DOUBLE) AS total, orders,
       CAST(rank() OVER (PARTITION BY region, nation ORDER BY total DESC) AS BIGINT) AS place
FROM sales"""


@query("adhoc_sql", _AD_HOC)
def adhoc_sql(spark: SparkSession, d: str) -> DataFrame:
    views = {t: tables.parquet(spark, d, t) for t in ("orders", "customer", "nation", "region")}
    return tables.ad_hoc(spark, _AD_HOC, views)


@query("paged_union", """
WITH span AS (SELECT min(page_id) AS low, (max(page_id) - min(page_id)) // 8 + 1 AS width FROM pages)
SELECT page_id, url, md5(html) AS html_md5, CAST((page_id - low) // width AS INTEGER) AS page
FROM pages, span""")
def paged_union(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.pages_of(tables.parquet(spark, d, "pages"), "page_id", 8)
    return rows.select("page_id", "url", F.md5("html").alias("html_md5"), "page")


def response_bodies(events: DataFrame) -> DataFrame:
    """Each event as the response an API might give: one shape per event type, errors broken."""
    one = F.format_string('{"id": %s, "k": %s}', F.col("event_id"), F.get_json_object("props", "$.k"))
    two = F.concat(F.lit("["), one, F.lit(', 7, {"id": -1, "k": 0}]'))
    kind = F.col("event_type")
    body = (F.when(kind == "click", two)
            .when(kind == "view", F.concat(F.lit('{"total": 2, "data": '), two, F.lit("}")))
            .when(kind == "purchase", F.concat(F.lit('{"none": [], "zz": '), two, F.lit(', "aa": [{"id": 5}]}')))
            .when(kind == "signup", one)
            .otherwise(F.concat(F.lit('{"id": '), F.col("event_id").cast("string"))))
    return events.select("event_id", "event_type", body.alias("body"))


@query("response_rows", """
SELECT event_id, 0 AS pos, event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
FROM events WHERE event_type IN ('click', 'view', 'purchase', 'signup')
UNION ALL
SELECT event_id, 1, -1, 0 FROM events WHERE event_type IN ('click', 'view', 'purchase')""")
def response_rows(spark: SparkSession, d: str) -> DataFrame:
    bodies = response_bodies(tables.spread(tables.parquet(spark, d, "events")))
    return json_ops.response_rows(bodies, "body", "id bigint, k bigint", ["event_id"])


@query("response_raw_fallback", """
SELECT conv_id, turn, 0 AS pos,
  CASE WHEN role = 'user' THEN CAST(turn AS VARCHAR) END AS t,
  CASE WHEN role <> 'user' THEN 'reply: ' || text END AS raw
FROM conversations""")
def response_raw_fallback(spark: SparkSession, d: str) -> DataFrame:
    talk = tables.parquet(spark, d, "conversations")
    body = F.when(F.col("role") == "user", F.format_string('{"t": "%s"}', F.col("turn"))
                  ).otherwise(F.concat(F.lit("reply: "), F.col("text")))
    calls = talk.select("conv_id", "turn", body.alias("body"),
                        F.create_map(F.lit("turn"), F.col("turn").cast("string")).alias("vars"))
    items = json_ops.chain_result_rows(calls, "body", "vars", ["conv_id", "turn"])
    return items.select("conv_id", "turn", "pos", json_ops.json_path(F.col("item"), "t").alias("t"),
                        json_ops.json_path(F.col("item"), "raw").alias("raw"))


@query("json_list_column", """
SELECT event_id, 0 AS pos, event_type AS name, CAST(json_extract_string(props, '$.k') AS BIGINT) AS size
FROM events WHERE event_type <> 'error'
UNION ALL SELECT event_id, 1, 'second', NULL FROM events WHERE event_type <> 'error'""")
def json_list_column(spark: SparkSession, d: str) -> DataFrame:
    events = tables.parquet(spark, d, "events")
    full = F.format_string('[{"name": "%s", "size": %s}, {"name": "second", "size": null}]',
                           F.col("event_type"), F.get_json_object("props", "$.k"))
    text = F.when(F.col("event_type") == "error", F.lit("[{broken")).otherwise(full)
    listed = json_ops.json_list(text, "struct<name:string,size:bigint>")
    items = json_ops.explode_items(events, ["event_id"], listed, "item")
    return items.where("item.name IS NOT NULL").select("event_id", "pos", "item.name", "item.size")


@query("range_cuts", """
SELECT 'number' AS kind, l_orderkey, l_linenumber, true AS balanced FROM lineitem
UNION ALL SELECT 'text', l_orderkey, l_linenumber, true FROM lineitem""")
def range_cuts(spark: SparkSession, d: str) -> DataFrame:
    """Rows read by eight ranges of a key whose values are spread unevenly, as a number and as text."""
    items = tables.parquet(spark, d, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey * l_partkey * l_partkey AS skewed", "concat('o''', string(l_partkey * l_partkey)) AS code")
    read = []
    for kind, key in (("number", "skewed"), ("text", "code")):
        counts = items.groupBy(key).agg(F.count("*").alias("n"))
        cut = ranges.predicates(key, ranges.cut_points(counts, key, "n", 8))
        parts = reduce(DataFrame.unionByName, [items.where(condition).withColumn("part", F.lit(i)) for i, condition in enumerate(cut)])
        sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
        even = sizes.agg((F.max("n") * len(cut) <= 2 * F.sum("n")).alias("even")).select("even").scalar()
        read.append(parts.select(F.lit(kind).alias("kind"), "l_orderkey", "l_linenumber", (even & F.lit(len(cut) == 8)).alias("balanced")))
    return read[0].unionByName(read[1])


_SKETCHED = {"o_orderkey": "number", "o_custkey": "number", "o_totalprice": "number", "o_orderstatus": "text", "o_orderpriority": "text"}


def _sketch_sql(column: str, kind: str) -> str:
    low = f"CAST(min({column}) AS DOUBLE)" if kind == "number" else "CAST(NULL AS DOUBLE)"
    high = f"max({column})" if kind == "text" else "CAST(NULL AS VARCHAR)"
    return f"""
SELECT '{column}' AS column_name, count(*) AS rows, count(*) FILTER (WHERE {column} IS NULL) AS null_count, true AS distinct_within,
  true AS quartiles_within, {low} AS min_number, {high} AS max_text FROM orders"""


@query("profile_sketches", " UNION ALL ".join(_sketch_sql(*item) for item in _SKETCHED.items()))
def profile_sketches(spark: SparkSession, d: str) -> DataFrame:
    """State of two deliveries merged; distinct counts within 5 % and quartiles within 2 % of rank of the exact ones."""
    path = scratch(spark, "sketches")
    orders = tables.parquet(spark, d, "orders").select(*_SKETCHED)
    for part, rows in (("early", "o_orderkey % 3 = 0"), ("late", "o_orderkey % 3 <> 0")):
        sketches.add(orders.where(rows), path, part)
    merged = materialise(sketches.profile(spark, path), "profile")
    found = {r["column_name"]: r for r in merged.collect()}  # a row per column
    shares = {c: [F.avg((F.col(c) <= F.lit(q)).cast("double")) - F.lit(rank) for q, rank in zip(r["quartiles"] or (), sketches.QUARTILES)]
              for c, r in found.items()}
    cells = [F.struct(F.lit(c).alias("name"),
                      (F.abs(F.count_distinct(c) - F.lit(r["distinct_count"])) <= 0.05 * r["distinct_count"]).alias("distinct_within"),
                      reduce(Column.__and__, [F.abs(gap) <= 0.02 for gap in shares[c]], F.lit(True)).alias("quartiles_within"))
             for c, r in found.items()]
    held = orders.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
    return merged.join(held, F.col("column_name") == F.col("name")).select(
        "column_name", "rows", "null_count", "distinct_within", "quartiles_within", "min_number", "max_text")


def _session_schema(options, given) -> T.StructType:
    return flat_schema(user_id="bigint", event_id="bigint", **{options["out"]: "bigint"})


def _session_each(row, options, memory):
    if "last" not in memory or (row["ts"] - memory["last"]).total_seconds() > options["gap"]:
        memory["session"] = memory.get("session", 0) + 1
    memory["last"] = row["ts"]
    yield row["user_id"], row["event_id"], memory["session"]


_SESSIONS = """
SELECT '{way}' AS way, user_id, event_id, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM (
  SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch(ts) - epoch(lag(ts) OVER w) > {gap} THEN 1 ELSE 0 END AS fresh
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


@query("udtf_source", _SESSIONS.format(way="sql", gap=86400) + " UNION ALL " + _SESSIONS.format(way="frame", gap=3600))
def udtf_source(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of each user by a script: called from SQL with its own grouping, and on a frame with the caller's."""
    events = tables.parquet(spark, d, "events").select("user_id", "event_id", "ts")
    script = scripts.Script(_session_schema, _session_each)
    scripts.register(spark, "user_sessions", script, ["user_id"], ["ts", "event_id"])
    by_sql = spark.sql("SELECT 'sql' AS way, * FROM user_sessions(TABLE({events}), :options)", {"options": '{"gap": 86400, "out": "session"}'},
                       events=events)
    call = scripts.table_function(script)
    by_frame = call(events.asTable().partitionBy("user_id").orderBy("ts", "event_id"), F.lit('{"gap": 3600, "out": "session"}'))
    # Stored, so that what reads the result does not run the script again.
    return materialise(by_sql.unionByName(by_frame.select(F.lit("frame").alias("way"), "*")), "sessions")
