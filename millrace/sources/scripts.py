"""Source scripts as table functions, to be called from SQL and from frames."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn


@dataclass(frozen=True)
class Script:
    """A script over the rows of a table, one group at a time and row by row.

    ``schema`` gives the output columns from the options and the input's schema. ``each`` takes (row, options,
    memory), where memory is a dict of the group's own, and gives output tuples; ``last`` takes (options, memory)
    when the group ends. Rows are never gathered, so a group may be of any length.
    """

    schema: Callable[[Mapping, T.StructType], T.StructType]
    each: Callable[[Row, Mapping, dict], Iterable[tuple]]
    last: Callable[[Mapping, dict], Iterable[tuple]] = lambda options, memory: ()


def table_function(script: Script, group: Sequence[str] = (), order: Sequence[str] = ()):
    """The script as a Python table function ``f(TABLE(rows), '{"option": …}')``.

    With ``group`` the function itself asks for its input by group and in ``order``; without it the caller
    may say PARTITION BY and ORDER BY, or leave the rows to any task.
    """
    class ScriptFunction:
        @staticmethod
        def analyze(rows: AnalyzeArgument, options: AnalyzeArgument) -> AnalyzeResult:
            if not rows.isTable:
                raise ValueError("the first argument is a table")
            if not options.isConstantExpression:
                raise ValueError("options are a constant JSON text")
            missing = [name for name in (*group, *order) if name not in rows.dataType.fieldNames()]
            if missing:
                raise ValueError(f"the table lacks {missing}")
            out = script.schema(json.loads(options.value or "{}"), rows.dataType)
            return AnalyzeResult(schema=out, partitionBy=[PartitioningColumn(name) for name in group],
                                 orderBy=[OrderingColumn(name) for name in order])

        def __init__(self):
            self.options, self.memory = None, {}

        def eval(self, rows: Row, options: str):
            if self.options is None:
                self.options = json.loads(options or "{}")
            yield from script.each(rows, self.options, self.memory)

        def terminate(self):
            if self.options is not None:
                yield from script.last(self.options, self.memory)

    return udtf(ScriptFunction)


def register(spark: SparkSession, name: str, script: Script, group: Sequence[str] = (), order: Sequence[str] = ()):
    """Make the script known to SQL under ``name``; gives the function for use with ``df.asTable()``."""
    function = table_function(script, group, order)
    spark.udtf.register(name, function)
    return function
