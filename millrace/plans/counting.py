"""Aggregates, windows, sets, sorts and hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.collections import join_non_blank, sum_or_zero
from millrace.operators import hierarchy, numbering, upsert, versions
from millrace.plans.catalogue import query
from millrace.sources import catalog, tables


@query("string_join", """
SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: x <> ''), '; ') AS joined FROM documents""")
def string_join(spark: SparkSession, d: str) -> DataFrame:
    return tables.parquet(spark, d, "documents").select(
        "doc_id", join_non_blank(F.split("text", "\n"), "; ").alias("joined"))


@query("array_set", """
WITH words AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, unnest(range(1, len(string_split(text, ' ')) + 1)) AS pos FROM documents),
firsts AS (SELECT doc_id, w, min(pos) AS pos FROM words GROUP BY doc_id, w)
SELECT doc_id, md5(string_agg(w, ' ' ORDER BY pos)) AS words_md5, count(*) AS n FROM firsts GROUP BY doc_id""")
def array_set(spark: SparkSession, d: str) -> DataFrame:
    """Distinct words of each text in the order they first occur."""
    words = F.array_distinct(F.split("text", " "))
    return tables.parquet(spark, d, "documents").select(
        "doc_id", F.md5(F.array_join(words, " ")).alias("words_md5"), F.size(words).cast("bigint").alias("n"))


@query("count_if", """
SELECT event_type, count(*) AS total, count(*) FILTER (WHERE value > 50) AS high FROM events GROUP BY event_type""")
def count_if(spark: SparkSession, d: str) -> DataFrame:
    return tables.parquet(spark, d, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("value") > 50).alias("high"))


@query("array_sum", """
SELECT doc_id, CAST(list_sum(list_transform(string_split(text, chr(10)), lambda x: length(x))) AS BIGINT) AS chars FROM documents""")
def array_sum(spark: SparkSession, d: str) -> DataFrame:
    sizes = F.transform(F.split("text", "\n"), lambda x: F.when(x != "", F.length(x)))
    return tables.parquet(spark, d, "documents").select("doc_id", sum_or_zero(sizes).alias("chars"))


@query("group_to_list", """
SELECT coalesce(r_name, 'default') AS "group", CAST(0 AS BIGINT) AS page, string_agg(n_name, ',' ORDER BY n_nationkey) AS items
FROM nation LEFT JOIN (SELECT * FROM region WHERE r_name <> 'ASIA') ON n_regionkey = r_regionkey GROUP BY ALL""")
def group_to_list(spark: SparkSession, d: str) -> DataFrame:
    nation = tables.parquet(spark, d, "nation")
    region = tables.parquet(spark, d, "region").where("r_name <> 'ASIA'")
    named = nation.join(region, nation["n_regionkey"] == region["r_regionkey"], "left")
    lists = numbering.group_to_list(named, F.col("r_name"), ["n_nationkey"], F.col("n_name"), "default",
                                    page_rows=1000)
    return lists.select("group", "page", F.array_join("items", ",").alias("items"))


_KPI = ["orders", "customer", "part", "supplier"]
_ALL = [*_KPI, "lineitem", "nation", "region"]


@query("kpi_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _KPI)
       + " UNION ALL SELECT 'all rows', " + " + ".join(f"(SELECT count(*) FROM {t})" for t in _ALL))
def kpi_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = catalog.inventory({t: tables.parquet(spark, d, t) for t in _ALL})
    lines = F.array(F.when(F.col("table_name").isin(_KPI), F.col("table_name")), F.lit("all rows"))
    return counts.select(F.explode(F.array_compact(lines)).alias("name"), "row_count").groupBy("name").agg(
        F.sum("row_count").alias("n"))


@query("case_number", """
WITH numbered AS (
  SELECT o_orderkey, o_totalprice, year(o_orderdate) || '-' || o_orderstatus AS entity_class,
    row_number() OVER (PARTITION BY year(o_orderdate), o_orderstatus ORDER BY o_orderkey) AS n FROM orders)
SELECT o_orderkey, entity_class, CAST(n AS VARCHAR) AS case_no FROM numbered WHERE o_totalprice >= 50000""")
def case_number(spark: SparkSession, d: str) -> DataFrame:
    """Numbers are given first, so the skipped rows leave gaps."""
    orders = tables.parquet(spark, d, "orders").select(
        "o_orderkey", "o_totalprice",
        F.concat_ws("-", F.year("o_orderdate").cast("string"), "o_orderstatus").alias("entity_class"))
    numbered = numbering.case_numbers(orders, "entity_class", ["o_orderkey"])
    return numbered.where("o_totalprice >= 50000").select("o_orderkey", "entity_class", "case_no")


@query("running_number_ranged", """
SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS number FROM events""")
def running_number_ranged(spark: SparkSession, d: str) -> DataFrame:
    """Numbers within groups that are large."""
    events = tables.parquet(spark, d, "events").select("event_id", "event_type", "ts")
    return numbering.running_number(events, ["event_type"], ["ts", "event_id"]).select(
        "event_id", "event_type", "number")


def order_history(spark: SparkSession, d: str) -> DataFrame:
    """A customer's orders as versions of one document, oldest first."""
    orders = tables.parquet(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
    numbered = numbering.running_number(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "version")
    return numbered.select("o_custkey", "version", F.concat_ws(":", F.col("o_orderkey").cast("string"),
                                                               "o_orderstatus").alias("content"))


_HISTORY = """
WITH history AS (
  SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version,
    o_orderkey || ':' || o_orderstatus AS content FROM orders)"""


@query("latest_version", _HISTORY + """
SELECT o_custkey, version, content FROM history QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY version DESC) = 1""")
def latest_version(spark: SparkSession, d: str) -> DataFrame:
    return versions.latest_versions(order_history(spark, d), "o_custkey")


@query("version_as_of", _HISTORY + """
SELECT o_custkey, version, content FROM history WHERE version <= 3
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY version DESC) = 1""")
def version_as_of(spark: SparkSession, d: str) -> DataFrame:
    return versions.version_as_of(order_history(spark, d), "o_custkey", 3)


@query("version_rollback", _HISTORY + """
SELECT * FROM history UNION ALL
SELECT h.o_custkey, t.top + 1, h.content FROM history h
JOIN (SELECT o_custkey, max(version) AS top FROM history GROUP BY o_custkey) t ON h.o_custkey = t.o_custkey
WHERE h.version = 2 AND h.o_custkey = (SELECT min(o_custkey) FROM orders)""")
def version_rollback(spark: SparkSession, d: str) -> DataFrame:
    history = order_history(spark, d)
    first = history.agg(F.min("o_custkey")).first()[0]
    return versions.rollback(history, "o_custkey", first, 2)


@query("array_ordinal", """
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents)
SELECT doc_id, '文档' || n AS label, md5(line) AS line_md5 FROM lines""")
def array_ordinal(spark: SparkSession, d: str) -> DataFrame:
    lines = tables.parquet(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return lines.select("doc_id", F.concat(F.lit("文档"), (F.col("i") + 1).cast("string")).alias("label"),
                        F.md5("line").alias("line_md5"))


@query("dedupe_last", """
SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def dedupe_last(spark: SparkSession, d: str) -> DataFrame:
    return upsert.dedupe_last(tables.parquet(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")])


@query("sort_two_keys", """
SELECT n_regionkey, n_name FROM nation ORDER BY n_regionkey, n_name""")
def sort_two_keys(spark: SparkSession, d: str) -> DataFrame:
    return tables.parquet(spark, d, "nation").select("n_regionkey", "n_name").orderBy("n_regionkey", "n_name")


@query("union_missing", """
SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier""")
def union_missing(spark: SparkSession, d: str) -> DataFrame:
    customers = tables.parquet(spark, d, "customer").selectExpr(
        "c_custkey AS id", "c_name AS name", "c_acctbal AS balance", "c_mktsegment AS segment")
    suppliers = tables.parquet(spark, d, "supplier").selectExpr(
        "s_acctbal AS balance", "s_suppkey AS id", "s_name AS name")
    return customers.unionByName(suppliers, allowMissingColumns=True)


def category_edges(spark: SparkSession, d: str) -> DataFrame:
    """Region → nation → customer as one parent/child table of text ids."""
    region = tables.parquet(spark, d, "region").selectExpr("concat('r', r_regionkey) AS id", "'0' AS parent_id")
    nation = tables.parquet(spark, d, "nation").selectExpr(
        "concat('n', n_nationkey) AS id", "concat('r', n_regionkey) AS parent_id")
    customer = tables.parquet(spark, d, "customer").selectExpr(
        "concat('c', c_custkey) AS id", "concat('n', c_nationkey) AS parent_id")
    return region.unionByName(nation).unionByName(customer)


@query("hierarchy_descendants", """
SELECT o_orderkey, o_custkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE'""")
def hierarchy_descendants(spark: SparkSession, d: str) -> DataFrame:
    roots = tables.parquet(spark, d, "region").where("r_name = 'EUROPE'").selectExpr("concat('r', r_regionkey) AS id")
    orders = tables.parquet(spark, d, "orders").withColumn("category", F.concat(F.lit("c"), F.col("o_custkey")))
    return hierarchy.in_subtree(orders, "category", category_edges(spark, d), roots).select("o_orderkey", "o_custkey")


@query("hierarchy_paths", """
SELECT 'r' || r_regionkey AS id, 0 AS depth, 'r' || r_regionkey AS path FROM region
UNION ALL SELECT 'n' || n_nationkey, 1, 'r' || n_regionkey || '/n' || n_nationkey FROM nation
UNION ALL SELECT 'c' || c_custkey, 2, 'r' || n_regionkey || '/n' || n_nationkey || '/c' || c_custkey
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def hierarchy_paths(spark: SparkSession, d: str) -> DataFrame:
    edges = category_edges(spark, d)
    tree = hierarchy.descend(edges, edges.where("parent_id = '0'").select("id"))
    return tree.select("id", "depth", F.array_join("path", "/").alias("path"))


_CHAIN = """
WITH RECURSIVE n AS (
  SELECT c_custkey AS id, c_name AS name, c_acctbal AS sort, c_custkey % 260 AS i FROM customer),
e AS (SELECT *, CASE WHEN i = 0 THEN NULL WHEN i % 5 = 4 THEN id - 4 WHEN i % 5 = 0 THEN id - 2 ELSE id - 1 END AS up FROM n),
t AS (
  SELECT id AS root, id, name, 0 AS depth, [{'s': sort, 'id': id}] AS way, CAST(id AS VARCHAR) AS path, name AS trail FROM e WHERE up IS NULL
  UNION ALL SELECT t.root, e.id, e.name, t.depth + 1, list_append(t.way, {'s': e.sort, 'id': e.id}), t.path || '/' || e.id,
                   t.trail || ' > ' || e.name
  FROM t JOIN e ON e.up = t.id)"""


@query("tree_ordered", _CHAIN + """
SELECT root, row_number() OVER (PARTITION BY root ORDER BY way) AS place, id, name, depth, path, trail FROM t""")
def tree_ordered(spark: SparkSession, d: str) -> DataFrame:
    """Customers as trees of up to 208 levels, in which every fourth node of a chain has a second child."""
    i = F.expr("c_custkey % 260")
    up = F.when(i == 0, None).when(i % 5 == 4, F.col("c_custkey") - 4).when(i % 5 == 0, F.col("c_custkey") - 2).otherwise(F.col("c_custkey") - 1)
    nodes = tables.parquet(spark, d, "customer").withColumn("up", up)
    tree = hierarchy.ordered_tree(nodes, F.col("up").isNull(), "c_custkey", "up", "c_name", "c_acctbal")
    return tree.select("root", "place", "id", "name", "depth", F.array_join("path", "/").alias("path"), F.array_join("names", " > ").alias("trail"))
