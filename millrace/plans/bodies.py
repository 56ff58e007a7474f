"""Bodies of API pages as files that many tasks can look into: many pages a file, in order, found by bisection."""

from __future__ import annotations

import glob
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pages that share a file, so that folders and files stay few however long a list is.
SHELF = 1000


def write_bodies(rows: DataFrame, page: Column, item: Column, root: str, **beside: Column) -> None:
    """Write one body ``{…, "items": […]}`` per page, its items in order; rows without a page are on none.

    A line is the page's number, a tab and the body; a file holds its pages by number.
    """
    placed = rows.select(page.alias("_page"), item.alias("_item")).where("_page IS NOT NULL")
    dealt = placed.withColumn("shelf", F.floor(F.col("_page") / SHELF)).repartition("shelf")
    bodies = dealt.groupBy("shelf", "_page").agg(F.sort_array(F.collect_list("_item")).alias("items"))
    body = F.to_json(F.struct(*[value.alias(name) for name, value in beside.items()], "items"))
    lines = bodies.sortWithinPartitions("shelf", "_page").select("shelf", F.concat_ws("\t", "_page", body).alias("value"))
    lines.write.mode("overwrite").partitionBy("shelf").text(root)


def body_of(root: str, page: int) -> str | None:
    """The body of a page, or None past the end."""
    parts = glob.glob(f"{root.removeprefix('file://')}/shelf={page // SHELF}/part-*")
    if not parts:
        return None
    with open(parts[0], "rb") as lines:
        low, high = 0, os.path.getsize(parts[0])
        while low < high:
            middle = (low + high) // 2
            lines.seek(max(middle - 1, 0))
            if middle:
                lines.readline()  # to the first line that starts at the middle or behind it
            number, _, body = lines.readline().partition(b"\t")
            if not number or int(number) > page:
                high = middle
            elif int(number) == page:
                return body.decode().rstrip("\n")
            else:
                low = lines.tell()
    return None
