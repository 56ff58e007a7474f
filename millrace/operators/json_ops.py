"""JSON text held in a column: rows, paths, key/value pairs."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.workspace import path_exists, scratch


def json_path(text: Column, path: str) -> Column:
    """Value at ``a.b.c`` as text; null when a step is missing or its parent is no object."""
    if not path:
        return F.lit(None).cast("string")
    steps = "".join(f"['{step}']" for step in path.split("."))
    return F.get_json_object(text, f"${steps}")


def explode_items(df: DataFrame, keys: Sequence[str], items: Column, out: str) -> DataFrame:
    """``keys``, position and element of an array, one row each; no rows for null or empty.

    The outer form keeps the planner from testing the array's size below the generator,
    which would compute a costly array expression twice.
    """
    return df.select(*keys, F.posexplode_outer(items).alias("pos", out)).where("pos IS NOT NULL")


def _objects(items: Column) -> Column:
    """Elements of a variant array that are objects, as JSON text."""
    return F.filter(F.transform(items, lambda v: F.to_json(v)), lambda text: text.startswith("{"))


def _list_objects(node: Column) -> Column:
    """Objects of a variant that is an array; null when it is none."""
    return _objects(F.try_variant_get(node, "$", "array<variant>"))


def with_response_items(df: DataFrame, body: str, out: str = "_items") -> DataFrame:
    """Add the rows of a response body as an array of JSON objects.

    In order: the objects of a bare list; the objects of a list under ``data``; the
    objects of the first list, in document order, among the other values; the whole
    object. Text that is not JSON, and scalars, give an empty array.
    """
    root, members = F.col("_root"), F.col("_members")
    parsed = df.withColumn("_root", F.try_parse_json(F.col(body))).withColumn(
        "_members", F.try_variant_get(root, "$", "map<string,variant>"))
    is_object = members.isNotNull()
    in_order = F.concat(F.array(F.lit("data")), F.json_object_keys(F.when(is_object, F.col(body))))
    lists = F.transform(in_order, lambda key: _list_objects(F.try_element_at(members, key)))
    whole = F.array(F.when(is_object, F.array(F.to_json(root))))
    choices = F.concat(F.array(_list_objects(root)), F.coalesce(lists, F.array().cast("array<array<string>>")), whole)
    filled = F.filter(choices, lambda c: F.coalesce(F.size(c), F.lit(0)) > 0)
    return parsed.withColumn(out, F.coalesce(F.get(filled, F.lit(0)), F.array().cast("array<string>")))


def response_rows(df: DataFrame, body: str, schema: T.StructType | str, keys: Sequence[str]) -> DataFrame:
    """One output row per item, with its position and the fields named in ``schema``."""
    items = explode_items(with_response_items(df, body), keys, F.col("_items"), "_item")
    return items.select(*keys, "pos", F.from_json("_item", schema).alias("_row")
                        ).select(*keys, "pos", "_row.*")


def chain_result_rows(df: DataFrame, body: str, variables: str, keys: Sequence[str]) -> DataFrame:
    """Rows of a call chain's last response as JSON objects in ``item``.

    Parsable text follows ``with_response_items``; other text becomes one ``{raw}`` row,
    uncut; no text gives one row of the chain's variables (a map column), if any.
    """
    text = F.col(body)
    has_text = F.coalesce(text, F.lit("")) != ""
    raw = F.array(F.to_json(F.struct(text.alias("raw"))))
    spare = F.when(F.size(F.col(variables)) > 0, F.array(F.to_json(F.col(variables)))
                   ).otherwise(F.array().cast("array<string>"))
    items = F.when(has_text & F.col("_root").isNotNull(), F.col("_items")).when(has_text, raw).otherwise(spare)
    return explode_items(with_response_items(df, body), keys, items, "item")


def json_list(text: Column, item: str) -> Column:
    """A list stored as JSON text; text that does not parse is null."""
    return F.from_json(text, f"array<{item}>")


def nested_extract(df: DataFrame, body: str, path: str, fields: Sequence[tuple[str, str]],
                   keys: Sequence[str]) -> DataFrame:
    """Walk to ``path``, treat a single node as a list of one, project fields, null → blank."""
    steps = "$" + "".join(f".{step}" for step in path.split(".") if step)
    found = df.withColumn("_node", F.try_variant_get(F.try_parse_json(F.col(body)), steps, "variant"))
    node = F.col("_node")
    items = F.coalesce(F.try_variant_get(node, "$", "array<variant>"), F.array(node))
    objects = explode_items(found, keys, _objects(items), "_item")
    out = [F.coalesce(json_path(F.col("_item"), source), F.lit("")).alias(target)
           for source, target in fields]
    return objects.select(*keys, "pos", *out)


def json_to_kv(df: DataFrame, body: str, keys: Sequence[str]) -> DataFrame:
    """Every leaf as ``(key, value)`` with keys like ``a.b[0].c``; null leaves become blank.

    Text that does not parse, and scalar roots, give no rows; empty containers vanish. A pass opens several levels by
    lateral explodes, four at first and at most sixteen, and writes what it comes to to the shared folder, leaves and
    containers apart; the next pass opens the containers left, until there are none. No document is cut, leaves
    are stored once, a deep document costs the others nothing, a level costs no write of its own, and
    the plan is as long for 100 levels as for 28.
    """
    spark, root = df.sparkSession, scratch(df.sparkSession, "json")
    # By its first character, so that a text is parsed once; one that does not parse is dropped after the first pass.
    texts = df.where(F.col(body).rlike(r"^[ \t\r\n]*[\[{]"))
    level = texts.select(*keys, F.lit("").alias("_key"), F.try_parse_json(F.col(body)).alias("_node"))
    schema = level.schema.add("_open", T.BooleanType())
    for number in count():
        opened = level
        for _ in range(min(_FIRST_LEVELS << number, _MOST_LEVELS)):
            opened = _one_level(opened, keys)
        opened.withColumn("_open", _left_open(F.col("_node"))).write.partitionBy("_open").parquet(f"{root}/_level={number}")
        if not path_exists(spark, f"{root}/_level={number}/_open=true"):
            break
        level = spark.read.schema(schema).parquet(f"{root}/_level={number}").where("_open").drop("_open")
    leaves = spark.read.schema(schema.add("_level", T.IntegerType())).parquet(root).where("NOT _open")
    value = F.coalesce(F.try_variant_get("_node", "$", "string"), F.lit(""))
    return leaves.select(*keys, F.col("_key").alias("key"), value.alias("value"))


#: Levels that the first pass opens, each later one twice as many as the one before, and the most that any does.
_FIRST_LEVELS, _MOST_LEVELS = 4, 16


def _one_level(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Members in place of containers; leaves and empty containers stay as they are."""
    inside = nodes.sparkSession.tvf.variant_explode_outer(F.col("_node").outer()).toDF("_pos", "_name", "_value")
    prefix = F.when(F.col("_key") == "", F.lit("")).otherwise(F.concat("_key", F.lit(".")))
    name = F.coalesce(F.concat(prefix, F.col("_name")), F.concat("_key", F.lit("["), F.col("_pos").cast("string"), F.lit("]")), F.col("_key"))
    node = F.when(F.col("_pos").isNull(), F.col("_node")).otherwise(F.col("_value"))
    return nodes.lateralJoin(inside).select(*keys, name.alias("_key"), node.alias("_node"))


def _left_open(node: Column) -> Column:
    """Whether a node has to be opened still; null for an empty container and for a text that did not parse."""
    start = F.array(F.left(F.to_json(node), F.lit(2)))  # bound, so that the text is made once
    return F.get(F.transform(start, lambda s: F.when(~s.isin("{}", "[]"), F.left(s, F.lit(1)).isin("{", "["))), F.lit(0))


_COLLECTION = "struct<item:array<struct<response:array<struct<body:string>>>>>"


def import_collection(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """Key/value rows of every example response body in a request-collection document."""
    parsed = df.select(*keys, F.from_json(F.col(text), _COLLECTION).alias("_doc"))
    items = explode_items(parsed, keys, F.col("_doc.item"), "_item").withColumnRenamed("pos", "item_no")
    bodies = explode_items(items, [*keys, "item_no"], F.col("_item.response"), "_r")
    bodies = bodies.withColumnRenamed("pos", "response_no").select(*keys, "item_no", "response_no", F.col("_r.body").alias("_body"))
    return json_to_kv(bodies, "_body", [*keys, "item_no", "response_no"])
