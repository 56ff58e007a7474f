"""Parent/child edge tables: closure, paths and ordered trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.numbering import running_number
from millrace.workspace import materialise


def _doubled(links: DataFrame, roots: DataFrame) -> DataFrame:
    """``(id, path)`` for every way from a root down to a node; ``path`` is the steps from the root.

    ``links`` has (id, up, step), ``roots`` (id, step). Every row holds a way up from its node; a round joins it to the
    ways of the node where it ends, so ways double in length: as many joins as the depth has binary digits,
    each over a stored frame. A way that meets a node again is a cycle: it fails the job if a root leads to it.
    """
    ended = roots.select("id", F.lit(None).cast(links.schema["up"].dataType).alias("up"), F.array("step").alias("path"))
    ways = materialise(ended.unionByName(links.where("up IS NOT NULL").select("id", "up", F.array("step").alias("path"))), "ways")
    circles = None
    while True:
        open_ = ways.where("up IS NOT NULL")
        if open_.isEmpty():
            break
        above = ways.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("path").alias("head"))
        longer = open_.join(above, "up").select("id", F.col("next").alias("up"), F.concat("head", "path").alias("path"))
        again = F.size(F.array_distinct(F.transform("path", lambda step: step["id"]))) < F.size("path")
        joined = materialise(longer.withColumn("again", again), "ways")
        met = joined.where("again").select("id")
        circles = met if circles is None else circles.unionByName(met)
        ways = ways.where("up IS NULL").unionByName(joined.where("NOT again").drop("again"))
    found = ways.select("id", "path")
    reached = circles.join(found.select("id"), "id", "left_semi").first() if circles is not None else None
    if reached is not None:
        raise ValueError(f"cycle at {reached['id']}")
    return found


def descend(edges: DataFrame, roots: DataFrame, node: str = "id", parent: str = "parent_id",
            max_depth: int | None = None) -> DataFrame:
    """Every node at or below ``roots`` as ``(id, depth, path)``; ``path`` is the ids from the root.

    Found by path doubling, so a chain of 1,000 levels takes ten joins. A cycle below a root fails the job; a
    caller may set a depth, and a deeper tree then fails.
    """
    step = F.struct(F.col(node).alias("id")).alias("step")
    links = edges.select(F.col(node).alias("id"), F.col(parent).alias("up"), step)
    found = _doubled(links, roots.select(F.col(node).alias("id"), step))
    tree = found.select("id", (F.size("path") - 1).alias("depth"), F.transform("path", lambda s: s["id"]).alias("path"))
    if max_depth is not None and not tree.where(F.col("depth") > max_depth).isEmpty():
        raise ValueError(f"hierarchy is deeper than {max_depth} levels")
    return tree


def ordered_tree(nodes: DataFrame, roots: Column, node: str = "id", parent: str = "parent_id", name: str = "name",
                 order: str = "sort") -> DataFrame:
    """The tree as it is listed: ``(root, place, id, name, depth, path, names)``.

    ``roots`` says of a row whether it is a root. Children come in the order of ``order`` (nulls first), then id; a node
    is listed before its children. The sort key of a node is the list of (order, id) on its way down, so one
    range sort puts every tree in order; ``place`` counts from 1 in each root's tree, over ranges, however
    large that tree is. Nodes that no root leads to are left out.
    """
    step = F.struct(F.col(order).alias("sort"), F.col(node).alias("id"), F.col(name).alias("name")).alias("step")
    steps = nodes.select(F.col(node).alias("id"), F.col(parent).alias("up"), step, F.coalesce(roots, F.lit(False)).alias("is_root"))
    found = _doubled(steps.select("id", "up", "step"), steps.where("is_root").select("id", "step"))
    keyed = found.select(F.get("path", F.lit(0))["id"].alias("root"), "id",
                         F.transform("path", lambda s: F.struct(s["sort"].alias("sort"), s["id"].alias("id"))).alias("sort_path"),
                         F.transform("path", lambda s: s["name"]).alias("names"))
    placed = running_number(keyed, ["root"], ["sort_path"], "place")
    return placed.select("root", "place", "id", F.element_at("names", -1).alias("name"), (F.size("names") - 1).alias("depth"),
                         F.transform("sort_path", lambda s: s["id"]).alias("path"), "names")


def in_subtree(rows: DataFrame, category: str, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows whose category is one of the roots or lies below them."""
    closure = descend(edges, roots).select(F.col("id").alias(category))
    return rows.join(closure, category, "left_semi")
