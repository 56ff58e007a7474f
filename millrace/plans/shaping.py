"""Mapping, templates, defaults, derived columns, flattening, and the flagship flow."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.engine import TableSink, run_flow
from millrace.functions.text import first_non_blank, render
from millrace.operators import flatten, mapping, numbering, template, validate
from millrace.operators.lookup import lookup
from millrace.operators.bucketed import BucketedTable
from millrace.plans.catalogue import middle, query
from millrace.sources import tables
from millrace.spec import AFTER_READ, BEFORE_WRITE, MAPPING, TEMPLATE
from millrace.spec import ColumnSpec, FieldMapping, FlowSpec, Registry, Stage, Step, Strategy
from millrace.workspace import scratch

CLOCK = dt.datetime(2025, 6, 1, 12, 0, 0)


def enrich_orders(df: DataFrame, customers: DataFrame, nations: DataFrame) -> DataFrame:
    """Customer and nation of each order, and whether a lookup failed."""
    with_customer = lookup(df, customers, "o_custkey", "c_custkey",
                           {"c_name": "customer", "c_nationkey": "nation_key"}, flag="has_customer", unique=True)
    with_nation = lookup(with_customer, nations, "nation_key", "n_nationkey", {"n_name": "nation"},
                         flag="has_nation", unique=True)
    return with_nation.withColumn("enrich_failed", ~(F.col("has_customer") & F.col("has_nation")))


def order_rules() -> list[validate.Rule]:
    return [validate.required("o_orderpriority"), validate.numeric("o_totalprice"),
            validate.check("lookup failed", F.col("enrich_failed"))]


@query("flow_run", """
WITH half AS (SELECT (min(o_orderkey) + max(o_orderkey)) // 2 AS k FROM orders),
numbered AS (
  SELECT o.*, c.c_name, n.n_name, c.c_custkey IS NULL AS lost, year(o.o_orderdate) || '-' || o.o_orderstatus AS cls,
    row_number() OVER (PARTITION BY o.o_orderkey > (SELECT k FROM half), year(o.o_orderdate), o.o_orderstatus
                       ORDER BY o.o_orderkey) AS no
  FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey)
SELECT o_orderkey, c_name AS customer, c_name AS owner, n_name AS nation, lower(o_orderstatus) AS status,
  o_totalprice AS total, cls AS entity_class, CAST(no AS VARCHAR) AS case_no
FROM numbered WHERE NOT lost""")
def flow_run(spark: SparkSession, d: str) -> DataFrame:
    """Read by id → lookups → rules → good/bad split → mapping → case number → upsert → bookmark.

    The first run sees the orders there were then, the second starts at its bookmark.
    Case numbers restart with every run.
    """
    root = scratch(spark, "flow")
    orders = tables.parquet(spark, d, "orders")
    customers = tables.parquet(spark, d, "customer").where("c_acctbal >= 0")
    nations = tables.parquet(spark, d, "nation")

    def number(df: DataFrame) -> DataFrame:
        classed = df.withColumn("entity_class", F.concat_ws(
            "-", F.year("o_orderdate").cast("string"), F.col("o_orderstatus")))
        return numbering.case_numbers(classed, "entity_class", ["o_orderkey"])

    def good_rows(df: DataFrame) -> DataFrame:
        return validate.split_good_bad(validate.apply_rules(df, order_rules()))[0]

    registry = Registry(
        templates={
            "enrich": lambda df: enrich_orders(df, customers, nations),
            "number": number,
            "good": good_rows,
            "project": {c: c for c in ("o_orderkey", "customer", "owner", "nation", "status", "total",
                                       "entity_class", "case_no")},
        },
        column_functions={"lower": F.lower},
        mappings={"order": FieldMapping(
            (("customer", "owner"), ("o_orderstatus", "status"), ("o_totalprice", "total")),
            (ColumnSpec("o_orderstatus", template="lower"),))})
    flow = FlowSpec(
        10, "orders to case files", Strategy.INCREMENTAL_ID, "o_orderkey", "NUMERIC",
        (Stage(AFTER_READ, "enrich", (Step(TEMPLATE, "number"), Step(TEMPLATE, "enrich"))),
         Stage(BEFORE_WRITE, "shape", (Step(TEMPLATE, "good"), Step(MAPPING, "order"),
                                       Step(TEMPLATE, "project")))),
        key=("o_orderkey",))
    sink = TableSink(f"{root}/target")
    early = orders.where(F.col("o_orderkey") <= middle(orders, "o_orderkey"))
    run_flow(spark, flow, early, sink, f"{root}/state", registry, now=CLOCK)
    run_flow(spark, flow, orders, sink, f"{root}/state", registry, now=CLOCK)
    return BucketedTable(spark, f"{root}/target").read()


@query("map_fields", """
SELECT c_name AS full_name, coalesce(c_mktsegment, c_name) AS segment, c_custkey, c_name, c_nationkey,
  c_acctbal, c_mktsegment FROM customer""")
def map_fields(spark: SparkSession, d: str) -> DataFrame:
    pairs = [("c_name", "full_name"), ("c_name", "segment"), ("c_mktsegment", "segment")]
    return mapping.map_fields(tables.parquet(spark, d, "customer"), pairs)


@query("map_fanout", """
SELECT c_name AS owner, c_name AS contact, c_custkey AS id,
  CASE WHEN c_acctbal >= 0 THEN c_mktsegment ELSE c_name END AS c_name, c_custkey, c_nationkey,
  c_acctbal, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS c_mktsegment FROM customer""")
def map_fanout(spark: SparkSession, d: str) -> DataFrame:
    """One receive to two pushes; a push that is called like another source column."""
    customers = tables.parquet(spark, d, "customer").withColumn(
        "c_mktsegment", F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")))
    pairs = [("c_name", "owner"), ("c_name", "contact"), ("c_custkey", "id"), ("c_mktsegment", "c_name"),
             ("no_such_column", "c_mktsegment")]
    return mapping.map_fields(customers, pairs)


@query("map_column_expr", """
SELECT upper(c_name) AS name, CASE WHEN c_acctbal >= 0 THEN '<' || c_mktsegment || '>' END AS segment
FROM customer""")
def map_column_expr(spark: SparkSession, d: str) -> DataFrame:
    customers = tables.parquet(spark, d, "customer").withColumn(
        "c_mktsegment", F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")))
    exprs = {"c_name": F.upper, "c_mktsegment": lambda c: F.concat(F.lit("<"), c, F.lit(">"))}
    return mapping.map_fields(customers, [("c_name", "name"), ("c_mktsegment", "segment")], exprs,
                              keep_unmapped=False)


@query("template_expr", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CAST(round(CAST(l_extendedprice AS DECIMAL(12, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2))), 2) AS DOUBLE) AS net,
  CASE WHEN l_quantity > 25 THEN 'bulk' ELSE 'unit' END AS kind FROM lineitem""")
def template_expr(spark: SparkSession, d: str) -> DataFrame:
    return template.expression_template(tables.parquet(spark, d, "lineitem"), {
        "l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber", "l_partkey": "l_partkey",
        "l_suppkey": "l_suppkey",
        "net": "CAST(round(CAST(l_extendedprice AS DECIMAL(12, 2)) * "
               "(1 - CAST(l_discount AS DECIMAL(4, 2))), 2) AS DOUBLE)",
        "kind": "CASE WHEN l_quantity > :bulk THEN 'bulk' ELSE 'unit' END"}, {"bulk": 25})


@query("derived_columns", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity * 2 AS doubled,
  l_returnflag || '/' || l_linestatus AS flags, l_shipdate >= TIMESTAMP '1998-01-01' AS recent FROM lineitem""")
def derived_columns(spark: SparkSession, d: str) -> DataFrame:
    lines = tables.parquet(spark, d, "lineitem").withColumns({
        "doubled": F.col("l_quantity") * 2,
        "flags": F.concat_ws("/", "l_returnflag", "l_linestatus"),
        "recent": F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")})
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "doubled", "flags", "recent")


@query("subst_template", """
SELECT c_custkey, 'Dear ' || c_name || ' (' || CASE WHEN c_acctbal >= 0 THEN c_mktsegment ELSE '' END
  || '), ref ${unknown} v1' AS letter FROM customer""")
def subst_template(spark: SparkSession, d: str) -> DataFrame:
    customers = tables.parquet(spark, d, "customer")
    values = {"name": F.col("c_name"), "segment": F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")),
              "version": F.lit("v1")}
    letter = render("Dear ${name} (${segment}), ref ${unknown} ${version}", values)
    return customers.select("c_custkey", letter.alias("letter"))


@query("field_default_render", """
SELECT p_partkey, CASE WHEN p_size > 25 THEN p_name ELSE p_brand || '-2025-' || p_type END AS title FROM part""")
def field_default_render(spark: SparkSession, d: str) -> DataFrame:
    part = tables.parquet(spark, d, "part").withColumn(
        "title", F.when(F.col("p_size") > 25, F.col("p_name")).otherwise(F.lit("")))
    row = {c: F.col(c) for c in part.columns}
    title = mapping.default_render(F.col("title"), "{p_brand}-{year}-{p_type}", {"year": F.lit("2025")}, row)
    return part.select("p_partkey", title.alias("title"))


@query("field_default", """
SELECT CAST(p_partkey AS VARCHAR) AS record_id, coalesce(CASE WHEN p_size > 25 THEN p_name END, 'unknown') AS user_name,
  '0' AS status_code FROM part""")
def field_default(spark: SparkSession, d: str) -> DataFrame:
    part = tables.parquet(spark, d, "part").withColumn(
        "p_name", F.when(F.col("p_size") > 25, F.col("p_name")))
    return mapping.rename_with_defaults(part, [("p_partkey", "record_id", ""), ("p_name", "user_name", "unknown"),
                                               ("status", "status_code", "0")])


@query("fallback_chain", """
SELECT p_partkey, CASE WHEN p_size > 30 THEN p_name WHEN p_size > 20 THEN p_brand WHEN p_size > 10 THEN p_type
  ELSE '' END AS label FROM part""")
def fallback_chain(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    label = first_non_blank(F.when(size > 30, F.col("p_name")).otherwise(F.lit("")),
                            F.when(size > 20, F.col("p_brand")), F.when(size > 10, F.col("p_type")))
    return tables.parquet(spark, d, "part").select("p_partkey", label.alias("label"))


@query("drop_columns", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def drop_columns(spark: SparkSession, d: str) -> DataFrame:
    return tables.parquet(spark, d, "customer").drop("c_acctbal", "c_mktsegment", "not_there")


def order_records(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Each order with its customer as a nested source record; all values come from its own row."""
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    key, customer = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    null = F.lit(None).cast("string")

    def person(first, last, uuid, external):
        return F.struct(F.struct(first.alias("firstName"), last.alias("lastName")).alias("name"),
                        F.struct(uuid.alias("uuid")).alias("person"),
                        F.struct(external.alias("uuid")).alias("externalPerson"))

    def term(uri, en, zh):
        return F.struct(uri.alias("uri"), F.struct(en.alias("en_GB"), zh.alias("zh_CN")).alias("term"))

    def group(kind, logical, classes, words):
        return F.struct(F.lit(kind).alias("typeDiscriminator"), F.lit(logical).alias("logicalName"),
                        classes.alias("classifications"), words.alias("keywords"))

    typed = "array<struct<uri:string,term:struct<en_GB:string,zh_CN:string>>>"
    listed = "array<struct<locale:string,freeKeywords:array<string>>>"
    urgent = F.col("o_orderpriority") == "1-URGENT"
    segment = F.col("c_mktsegment")
    words = F.array(F.struct(F.lit("zh_CN").alias("locale"), F.array(F.lit("x")).alias("freeKeywords")),
                    F.struct(F.lit("en_GB").alias("locale"),
                             F.array(F.lower(segment), F.col("o_orderpriority")).alias("freeKeywords")))
    document = lambda i, name, size: F.struct(
        F.concat(F.lit(f"f{i}-"), key).alias("fileId"), name.alias("fileName"),
        F.lit("application/pdf").alias("mimeType"), size.cast("bigint").alias("size"), null.alias("url"),
        F.lit("2030-01-01").alias("embargoDate"), F.struct(F.lit("FREE").alias("key")).alias("visibility"))
    return joined.select(
        F.col("o_orderkey").alias("pureId"), F.concat(F.lit("u-"), key).alias("uuid"),
        null.alias("portalUrl"), F.lit("1").alias("version"), F.lit("etl").alias("createdBy"),
        null.alias("createdDate"), null.alias("modifiedBy"), null.alias("modifiedDate"),
        F.struct(F.concat(F.lit("Order "), key).alias("value")).alias("title"),
        term(null, F.lit("English"), F.lit("英语")).alias("language"),
        term(null, F.col("o_orderstatus"), F.lit("")).alias("type"),
        F.struct(F.col("o_orderpriority").alias("en_GB"), null.alias("zh_CN")).alias("abstract"),
        F.struct(F.lit("FREE").alias("key"), F.struct(F.lit("Public").alias("en_GB"), null.alias("zh_CN")
                                                      ).alias("description")).alias("visibility"),
        F.struct(F.when(urgent, F.lit("approved")).otherwise(F.lit("draft")).alias("step"),
                 F.struct(null.alias("en_GB"), null.alias("zh_CN")).alias("description")).alias("workflow"),
        F.struct(F.year("o_orderdate").alias("year"),
                 F.when(urgent, F.month("o_orderdate")).alias("month"),
                 F.when(urgent, F.dayofmonth("o_orderdate")).alias("day")).alias("awardDate"),
        F.array(F.struct(F.lit("Id").alias("typeDiscriminator"), null.alias("idSource"), key.alias("value")),
                F.struct(F.when(urgent, F.lit("PrimaryId")).otherwise(F.lit("Doi")).alias("typeDiscriminator"),
                         F.lit("shop").alias("idSource"), F.concat(F.lit("P"), key).alias("value"))
                ).alias("identifiers"),
        F.array(F.concat(F.lit("a"), key), F.lit(""), F.concat(F.lit("b"), key)).alias("prettyUrlIdentifiers"),
        F.array(person(F.col("c_name"), segment, customer, null), person(null, F.lit("Clerk"), null, F.lit("x1")),
                person(null, null, null, null)).alias("contributors"),
        F.array(person(F.lit("S"), F.col("o_orderstatus"), null, F.concat(F.lit("e"), customer))
                ).alias("supervisors"),
        F.array(F.struct(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("uuid"))
                ).alias("organizations"),
        F.array(F.struct(F.lit("s1").alias("uuid")), F.struct(null.alias("uuid")),
                F.struct(F.lit("s2").alias("uuid"))).alias("supervisorOrganizations"),
        F.struct(null.alias("uuid")).alias("managingOrganization"),
        F.array(F.struct(F.struct(F.lit("aw").alias("uuid")).alias("externalOrganizationRef"))
                ).alias("awardingInstitutions"),
        F.array(group("ClassificationsKeywordGroup", "waiver", F.array(term(null, F.lit("no"), F.lit("no"))),
                      F.lit(None).cast(listed)),
                group("ClassificationsKeywordGroup", "librarySubjects",
                      F.array(term(null, segment, F.lit("")), term(null, F.lit("Trade"), F.lit("贸易"))),
                      F.lit(None).cast(listed)),
                group("FreeKeywordsKeywordGroup", "keywordContainers", F.lit(None).cast(typed), words)
                ).alias("keywordGroups"),
        F.array(document(1, F.lit("changehistory.pdf"), F.lit(1)),
                document(2, F.concat(F.lit("order"), key, F.lit(".pdf")), F.col("o_custkey"))
                ).alias("documents"))


@query("flatten_record", """
SELECT CASE WHEN u THEN 'P' || k ELSE 'u-' || k END AS id, 'u-' || k AS uuid, o_orderkey AS "pureId",
  'Order ' || k AS title, '' AS "portalUrl", '1' AS version, 'a' || k || ', b' || k AS "prettyUrlIdentifiers",
  c_name || ' ' || c_mktsegment AS author, c_name || ' ' || c_mktsegment || '; Clerk' AS "allAuthors",
  CAST(o_custkey AS VARCHAR) AS "authorPersonId", 'S ' || o_orderstatus AS supervisor,
  'e' || o_custkey AS "supervisorPersonId", 's1,s2' AS "supervisorOrgUuids", 'n' || c_nationkey AS "firstOrgUuid",
  '' AS "managingOrgUuid", 'aw' AS "awardingInstitution", o_orderstatus AS "degreeEn", '' AS "degreeZh",
  'English' AS language, '英语' AS "languageZh", o_orderpriority AS abstract_en, '' AS abstract_cn,
  lower(c_mktsegment) || ', ' || o_orderpriority AS keywords, c_mktsegment || ', Trade' AS subjects,
  '贸易' AS "subjectsZh", CASE WHEN u THEN 'approved' ELSE 'draft' END AS status, 'FREE' AS visibility,
  CAST(year(o_orderdate) AS INTEGER) AS "publishYear",
  CASE WHEN u THEN strftime(o_orderdate, '%Y-%m-%d') ELSE year(o_orderdate) || '-01-01' END AS "awardDay",
  CASE WHEN u THEN strftime(o_orderdate, '%Y%m%d') ELSE year(o_orderdate) || '0101' END AS "publicationDate",
  1 AS pdf_count, 'https://files.example/records/u-' || k || '/files/f2-' || k AS pdf_url,
  'order' || k || '.pdf' AS "pdf_fileName", o_custkey AS pdf_size, '2030-01-01' AS "docEmbargoDate",
  'FREE' AS "docVisibility",
  '[{"typeDiscriminator":"Id","value":"' || k || '"},{"typeDiscriminator":"' || CASE WHEN u THEN 'PrimaryId' ELSE 'Doi' END
    || '","idSource":"shop","value":"P' || k || '"}]' AS "allIdentifiers"
FROM (SELECT *, CAST(o_orderkey AS VARCHAR) AS k, o_orderpriority = '1-URGENT' AS u
      FROM orders JOIN customer ON o_custkey = c_custkey)""")
def flatten_record(spark: SparkSession, d: str) -> DataFrame:
    orders = tables.spread(tables.parquet(spark, d, "orders"))
    records = order_records(orders, tables.parquet(spark, d, "customer"))
    flat = flatten.flatten_record(records, "https://files.example")
    return flat.select(
        "id", "uuid", "pureId", "title", "portalUrl", "version", "prettyUrlIdentifiers", "author", "allAuthors",
        "authorPersonId", "supervisor", "supervisorPersonId", "supervisorOrgUuids", "firstOrgUuid",
        "managingOrgUuid", "awardingInstitution", "degreeEn", "degreeZh", "language", "languageZh",
        "abstract_en", "abstract_cn", "keywords", "subjects", "subjectsZh", "status", "visibility",
        "publishYear", "awardDay", "publicationDate", "pdf_count", "pdf_url", "pdf_fileName", "pdf_size",
        "docEmbargoDate", "docVisibility", "allIdentifiers")
