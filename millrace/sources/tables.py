"""Tables by path or by catalog name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

READ_WORDS = ("SELECT", "WITH", "SHOW", "DESC", "DESCRIBE", "EXPLAIN", "VALUES", "FROM")


def parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for costly per-row work on a scan.

    A scan with fewer splits than the cluster has cores (one row group, one gzip file)
    gets one round-robin shuffle; a scan with more is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def default_table(spark: SparkSession) -> str:
    """First table of the catalog by name, for a source that names none."""
    names = sorted(t.name for t in spark.catalog.listTables())
    if not names:
        raise ValueError("the catalog holds no table")
    return names[0]


def table_exists(spark: SparkSession, name: str) -> bool:
    """Whether the table exists, whatever the case of its name."""
    return spark.catalog.tableExists(name) or any(
        t.name.lower() == name.lower() for t in spark.catalog.listTables())


def preview(df: DataFrame, order: list[Column] | list[str], rows: int = 20) -> DataFrame:
    return df.orderBy(*order).limit(rows)


def ad_hoc(spark: SparkSession, text: str, views: dict[str, DataFrame] | None = None,
           args: dict | None = None) -> DataFrame:
    """Run SQL text over the catalog and ``views``. Repeated column labels are refused."""
    for name, frame in (views or {}).items():
        frame.createOrReplaceTempView(name)
    out = spark.sql(text, args=args)
    repeated = {c for c in out.columns if out.columns.count(c) > 1}
    if repeated:
        raise ValueError(f"repeated column labels: {sorted(repeated)}")
    return out


def is_read(text: str) -> bool:
    return text.strip().split(None, 1)[0].upper().rstrip("(") in READ_WORDS


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files as ``(path, name, format, size, content)``. Spark lists no rows for empty files."""
    from millrace.functions.text import file_format

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    name = F.substring_index("path", "/", -1)
    return files.select("path", name.alias("name"), file_format(name).alias("format"),
                        F.col("length").alias("size"), "content")


def pages_of(df: DataFrame, key: str, pages: int) -> DataFrame:
    """Each row with its page, one of ``pages`` key ranges, in one scan; rows without a key are on page 0."""
    low, high = df.agg(F.min(key).alias("low"), F.max(key).alias("high")).first()
    if low is None:
        return df.withColumn("page", F.lit(0))
    width = (high - low) // pages + 1
    return df.withColumn("page", F.coalesce(F.floor((F.col(key) - low) / width), F.lit(0)).cast("int"))
