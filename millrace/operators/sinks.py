"""Writing frames: append, quarantine, payloads, files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import cut_files
from millrace.operators.prefix import prefix_sums
from millrace.operators.validate import ERRORS, drop_empty
from millrace.workspace import local_path, materialise, remove_path


def append(df: DataFrame, path: str, run_id: str) -> None:
    """Append one run's rows; empty rows are skipped.

    Rows land in the run's own partition, so repeating a run that failed replaces its
    rows, while a new run of the same flow appends again.
    """
    rows = drop_empty(df).withColumn("run_id", F.lit(run_id))
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run_id").parquet(path))


def read_appended(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("run_id")


def quarantine(df: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Write good and bad rows side by side in one pass; gives both parts as read back."""
    flagged = df.withColumn("ok", F.size(ERRORS) == 0)
    flagged.write.mode("overwrite").partitionBy("ok").parquet(path)
    stored = df.sparkSession.read.schema(flagged.schema).parquet(path)
    return stored.where("ok").drop("ok", ERRORS), stored.where("NOT ok").drop("ok")


def push_params(df: DataFrame) -> Column:
    """Parameters of one call: nulls dropped, lists and objects as JSON text, the rest as text."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    values = [F.to_json(F.struct(F.col(f"`{f.name}`").alias("v"))) if isinstance(f.dataType, T.VariantType)
              else F.to_json(F.col(f"`{f.name}`")) if isinstance(f.dataType, nested)
              else F.col(f"`{f.name}`").cast("string") for f in df.schema]
    pairs = [part for f, v in zip(df.schema, values) for part in (F.lit(f.name), v)]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def push_payload(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """Request body of one row as JSON; null fields are left out."""
    names = columns or df.columns
    return F.to_json(F.struct(*[F.col(f"`{c}`").alias(c) for c in names]))


def form_encode(df: DataFrame, skip: Sequence[str] = (), params: Mapping[str, str] | None = None) -> Column:
    """``k=v&k=v``, URL-encoded, of plain columns; params fill names the row has no value for."""
    nested = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
    simple = [f.name for f in df.schema if not isinstance(f.dataType, nested) and f.name not in skip]
    extra = {k: v for k, v in (params or {}).items() if k not in skip and v is not None}
    parts = []
    for name in simple:
        value = F.col(f"`{name}`").cast("string")
        if name in extra:
            value = F.coalesce(value, F.lit(extra.pop(name)))
        parts.append(_pair(name, value))
    parts += [_pair(k, F.lit(v)) for k, v in extra.items()]
    return F.array_join(F.array_compact(F.array(*parts)), "&")


def _pair(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.url_encode(F.lit(name)), F.lit("="), F.url_encode(value)))


def write_files(df: DataFrame, path: str, fmt: str, max_rows_per_file: int | None = None, max_bytes_per_file: int | None = None,
                order: Sequence[Column] = (), **options: str) -> None:
    """CSV, JSON or XML files, cut by row count, or (CSV and JSON) by bytes.

    Files cut by bytes may be many and small, and Hadoop's client starts processes (``chmod``) for each file that it
    makes on a local or mounted file system: there the tasks write the encoded rows themselves.
    """
    if max_bytes_per_file:
        columns, df = df.columns, _cut_by_bytes(df, fmt, max_bytes_per_file, order, options)
        root = local_path(df.sparkSession, path)
        if root and _tasks_write(df, fmt, options):
            row = _encoded(columns, fmt, options)
            head = _header(df.sparkSession, columns, options) if fmt == "csv" else None
            remove_path(df.sparkSession, path)
            # The CSV writer leaves out a row that encodes to nothing.
            lines = df.select("_file", row.cast("binary").alias("_line")).where("_line IS NOT NULL")
            cut_files.write(lines, root, f".{fmt}", _option(options, "lineSep", "\n"), head)
            return
        df = df.repartition("_file")
    writer = df.write.mode("overwrite").format(fmt).options(**options)
    if max_bytes_per_file:
        writer = writer.partitionBy("_file")
    elif max_rows_per_file:
        writer = writer.option("maxRecordsPerFile", max_rows_per_file)
    writer.save(path)


def _tasks_write(df: DataFrame, fmt: str, options: Mapping[str, str]) -> bool:
    """Whether ``to_csv`` and ``to_json`` give what the file writer writes: plain UTF-8, and no value that CSV refuses."""
    refused = (T.ArrayType, T.MapType, T.StructType, T.VariantType, T.BinaryType, T.NullType)
    other = {"compression", "codec", "encoding", "charset"} & {name.lower() for name in options}
    return not other and not (fmt == "csv" and any(isinstance(f.dataType, refused) for f in df.schema))


def _option(options: Mapping[str, str], name: str, default: str) -> str:
    """An option's text; as in Spark, the case of its name does not matter."""
    return str({k.lower(): v for k, v in options.items()}.get(name.lower(), default))


def _header(spark: SparkSession, columns: Sequence[str], options: Mapping[str, str]) -> str | None:
    if _option(options, "header", "false").lower() != "true":
        return None
    names = F.struct(*[F.lit(c).alias(c) for c in columns])
    return spark.range(0, 1, 1, 1).select(F.to_csv(names, dict(options))).first()[0]


def _encoded(columns: Sequence[str], fmt: str, options: Mapping[str, str]) -> Column:
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    if fmt == "json":
        return F.to_json(row, dict(options))
    if fmt == "csv":
        text = F.to_csv(row, dict(options))
        nothing = _option(options, "nullValue", "") == ""
        # A null alone in its row is nothing at all, and Spark takes the text of a row for never null.
        return F.when(F.col(f"`{columns[0]}`").isNotNull(), text) if nothing and len(columns) == 1 else text
    raise ValueError(f"{fmt} files cannot be cut by bytes")


def encoded_bytes(df: DataFrame, fmt: str, options: Mapping[str, str]) -> Column:
    """Bytes of a row as the file writer encodes it, with its line end."""
    text = _encoded(df.columns, fmt, options)
    return (F.octet_length(text) + F.octet_length(F.lit(_option(options, "lineSep", "\n")))).cast("bigint")


def _cut_by_bytes(df: DataFrame, fmt: str, limit: int, order: Sequence[Column], options: Mapping[str, str]) -> DataFrame:
    """Add the name of each row's file, so that no file holds more than ``limit`` bytes unless one row does.

    A running total of encoded sizes, taken over ranges, is cut at the limit less the largest row that shares a file;
    a row of more than half the limit has a file of its own.
    """
    if _option(options, "header", "false").lower() == "true":
        limit -= len(",".join(df.columns).encode()) + 1 + 2 * len(df.columns)
    small = F.col("_size") <= max(limit, 0) // 2
    sized = df.withColumn("_size", encoded_bytes(df, fmt, options))
    placed = prefix_sums(sized, F.when(small, F.col("_size")).otherwise(F.lit(0)), "_before", order)
    placed = materialise(placed.withColumn("_row", F.monotonically_increasing_id()), "files")
    most = placed.where(small).agg(F.max("_size")).first()[0] or 0
    shared = F.concat(F.lit("f"), F.floor(F.col("_before") / F.lit(limit - most + 1)))
    return (placed.withColumn("_file", F.when(small, shared).otherwise(F.concat(F.lit("row"), "_row")))
            .select(*df.columns, "_file"))
