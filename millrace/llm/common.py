"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.workspace import materialise as stored

__all__ = ["WORD", "apart", "bounded_blocks", "document_key", "kept_in_worker", "prefix_sums", "renamed", "runs", "stored", "word_count"]

#: A word: a run of anything but space and the control characters tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: The key that rows without an id sort under, after all others.
NO_ID = 2 ** 63 - 1


def word_count(text: Column) -> Column:
    """Number of words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def document_key(id_column: Column, text: Column) -> list[Column]:
    """(sid, tag): orders documents by id, rows without an id last, and tells texts under one id apart.

    Equal rows have equal keys, so a repeated row counts as one document.
    """
    return [F.coalesce(id_column.cast("bigint"), F.lit(NO_ID)).alias("sid"),
            F.hash(F.coalesce(text, F.lit(""))).alias("tag")]


def renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns in0, in1, …, and the new name of each: an operator's own names begin otherwise, so none can clash."""
    names = {name: f"in{i}" for i, name in enumerate(docs.columns)}
    return docs.select(*[F.col("`" + name.replace("`", "``") + "`").alias(new) for name, new in names.items()]), names


def apart(name: str, columns: Iterable[str]) -> str:
    """``name``, with underscores behind it until no column is called so in any case."""
    taken = {column.lower() for column in columns}
    while name.lower() in taken:
        name += "_"
    return name


def prefix_sums(df: DataFrame, order: list[Column], sums: dict[str, Column], label: str) -> DataFrame:
    """Add, for each name in ``sums``, the sum over all earlier rows in ``order`` (own row excluded).

    The rows are range-partitioned and stored; only one total per partition is summed in one place.
    Rows that tie on all of ``order`` must be interchangeable.
    """
    valued = df.select("*", *[value.alias(f"_v_{name}") for name, value in sums.items()])
    ranged = stored(valued.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), label)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_part").agg(*[F.sum(f"_v_{name}").alias(f"_t_{name}") for name in sums])
    offsets = totals.select("_part", *[F.coalesce(F.sum(f"_t_{name}").over(before), F.lit(0)).alias(f"_o_{name}")
                                       for name in sums])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.select("*", *[F.coalesce(F.sum(f"_v_{name}").over(inside), F.lit(0)).alias(f"_i_{name}")
                                 for name in sums])
    # One row per partition, so the size of this broadcast is bounded by the partition count.
    joined = local.join(F.broadcast(offsets), "_part")
    return joined.select(*df.columns, *[(F.col(f"_i_{name}") + F.col(f"_o_{name}")).alias(name) for name in sums])


def kept_in_worker(name: str, make: Callable[[], object]) -> object:
    """What ``make`` gives, made once per Python worker process and shared by its later tasks."""
    store = sys.modules.setdefault("_millrace_llm_worker", types.ModuleType("_millrace_llm_worker"))
    if not hasattr(store, name):
        setattr(store, name, make())
    return getattr(store, name)


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of consecutive equal keys, from batches sorted by ``keys``: (key, rows without the keys)."""
    current, rows = None, []
    for batch in batches:
        columns = [batch.column(name).to_pylist() for name in keys]
        others = [batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names) if name not in keys]
        for key, row in zip(zip(*columns), zip(*others)):
            if key != current:
                if rows:
                    yield current, rows
                current, rows = key, []
            rows.append(row)
    if rows:
        yield current, rows


def bounded_blocks(rows: int, size: int) -> int:
    """How many blocks of about ``size`` rows hold ``rows`` rows."""
    return max(1, -(-rows // size))
