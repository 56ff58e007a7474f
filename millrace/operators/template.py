"""User transformations: expression templates, frame functions, row functions."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

ERROR_COLUMN = "_row_error"


def expression_template(df: DataFrame, exprs: Mapping[str, str], params: Mapping[str, Any] | None = None,
                        keep_input: bool = False) -> DataFrame:
    """``{output column: SQL expression}`` with named parameters written ``:name``.

    Parameters are bound as literals, row values are columns; neither is ever parsed
    as code. With ``keep_input`` the input columns not produced by an expression stay.
    """
    bound = dict(params or {})
    kept = [f"`{c}`" for c in df.columns if c not in exprs] if keep_input else []
    made = [f"{text} AS `{name}`" for name, text in exprs.items()]
    return df.sparkSession.sql(f"SELECT {', '.join(kept + made)} FROM {{frame}}", args=bound, frame=df)


def frame_template(df: DataFrame, fn: Callable[..., DataFrame], params: Mapping[str, Any] | None = None
                   ) -> DataFrame:
    return fn(df, **dict(params or {}))


def row_template(
    df: DataFrame,
    fn: Callable[[dict, dict], dict | None],
    schema: T.StructType,
    params: Mapping[str, Any] | None = None,
    on_error: str = "fail",
) -> DataFrame:
    """Row function ``fn(row, params) -> row`` in Arrow batches, for what columns cannot express.

    The function gives a dict, or JSON text of one; nothing means the input row.

    ``on_error="keep_input"`` passes the input row on, ``"quarantine"`` gives a row of
    nulls; both put the message in ``_row_error`` so that failures are counted.
    """
    bound = dict(params or {})
    names = schema.fieldNames()
    packed = cloudpickle.dumps(fn)
    reports = on_error != "fail"

    out = T.StructType(list(schema.fields))
    if reports:
        out = out.add(ERROR_COLUMN, T.StringType())
    arrow_schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = cloudpickle.loads(packed)
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                error = None
                try:
                    made = call(dict(row), bound)
                    made = (json.loads(made) if isinstance(made, str) else made) or row
                except Exception as problem:
                    if on_error == "fail":
                        raise
                    error = f"{type(problem).__name__}: {problem}"
                    made = row if on_error == "keep_input" else {}
                rows.append({**{n: made.get(n) for n in names}, **({ERROR_COLUMN: error} if reports else {})})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow_schema)

    return df.mapInArrow(run, schema=out)


def json_row_result(df: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """A template that returned JSON text: parse it into the row; unusable text leaves nulls."""
    parsed = F.from_json(F.col(column), schema)
    return df.select(*[c for c in df.columns if c != column], parsed.alias("_parsed")
                     ).select("*", "_parsed.*").drop("_parsed")
