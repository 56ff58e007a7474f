"""Where a job keeps data it must be able to read again from any executor."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_FLAT_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "timestamp": T.TimestampType()}


def flat_schema(**columns: str) -> T.StructType:
    """A schema of plain columns; unlike DDL text it needs no running session."""
    return T.StructType([T.StructField(name, _FLAT_TYPES[kind]) for name, kind in columns.items()])


def shared_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a local folder only in local mode without one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        root = tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.millrace.localRoot", root)
        return root
    raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, removed by the file system when the session ends."""
    root = spark.conf.get("spark.millrace.localRoot", None) or shared_root(spark)
    path = f"{root}/millrace/{label}-{uuid.uuid4().hex}"
    files, place = _file_system(spark, path)
    files.deleteOnExit(place)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends at the files."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether anything lies at ``path``, on whatever file system it names."""
    files, place = _file_system(spark, path)
    return files.exists(place)


def folders(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that match a glob pattern, on whatever file system it names."""
    files, place = _file_system(spark, pattern)
    return sorted(status.getPath().toString() for status in files.globStatus(place) or ())


def local_path(spark: SparkSession, path: str) -> str | None:
    """``path`` as a plain path of a local or mounted file system, None on any other."""
    files, place = _file_system(spark, path)
    whole = files.makeQualified(place).toUri()
    return whole.getPath() if whole.getScheme() == "file" else None


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete what this library wrote at ``path``."""
    files, place = _file_system(spark, path)
    files.delete(place, True)


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def read_if_present(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read a parquet table, or give an empty frame when nothing was written there yet."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def one_row(spark: SparkSession, schema: T.StructType, values: Sequence) -> DataFrame:
    """A frame of one row built from literals: no rows travel through Python workers."""
    columns = [_literal(value, field.dataType).alias(field.name)
               for value, field in zip(values, schema.fields)]
    return spark.range(0, 1, 1, 1).select(*columns)


def _literal(value, data_type: T.DataType) -> Column:
    if value is None:
        return F.lit(None).cast(data_type)
    if isinstance(data_type, T.ArrayType):
        if not value:
            return F.array().cast(data_type)
        return F.array(*[_literal(v, data_type.elementType) for v in value])
    if isinstance(data_type, T.StructType):
        return F.struct(*[_literal(v, f.dataType).alias(f.name) for v, f in zip(value, data_type.fields)])
    return F.lit(value).cast(data_type)


_FIXED_BYTES = 16


def row_bytes(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """Upper estimate of the in-memory size of a row of ``df``, or of some of its columns."""
    names = df.columns if columns is None else columns
    per_row = F.lit(_FIXED_BYTES * len(names)).cast("bigint")
    fixed = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    for field in (df.schema[name] for name in names):
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            per_row += F.coalesce(F.octet_length(column), F.lit(0))
        elif not isinstance(field.dataType, fixed):
            as_text = F.to_json(F.struct(column.alias("v")))
            per_row += F.coalesce(4 * F.octet_length(as_text), F.lit(0))
    return per_row


def measured_bytes(df: DataFrame) -> int:
    """Upper estimate of the in-memory size of ``df``, found by one aggregate over its rows."""
    return df.agg(F.coalesce(F.sum(row_bytes(df)), F.lit(0)).alias("bytes")).first()["bytes"]


def fits_broadcast(df: DataFrame, max_bytes: int = 32 * 1024 * 1024) -> bool:
    """True when ``df`` was measured and is small enough to send to every executor.

    The row count alone rules out large frames; on stored tables it comes from the file
    footers, so only a frame that may fit has its columns read.
    """
    if df.count() * _FIXED_BYTES * len(df.columns) > max_bytes:
        return False
    return measured_bytes(df) <= max_bytes
