"""Types found in data, table definitions, and fitting rows to a target schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.json_ops import explode_items

TEXT_TYPE = "VARCHAR(2000)"
KEY_TEXT_TYPE = "VARCHAR(255)"
#: Databases that quote names with backticks.
MYSQL_FAMILY = ("mysql", "mariadb", "tidb", "oceanbase")

# How each database declares the generated id column; the first entry whose
# name occurs in the database type applies, else the SQL standard form.
ID_COLUMN = [
    (("mysql", "mariadb", "tidb", "oceanbase"), "id BIGINT AUTO_INCREMENT PRIMARY KEY"),
    (("postgre", "greenplum"), "id BIGSERIAL PRIMARY KEY"),
    (("sql server", "sqlserver"), "id BIGINT IDENTITY(1,1) PRIMARY KEY"),
    (("oracle",), "id NUMBER(19) GENERATED BY DEFAULT AS IDENTITY PRIMARY KEY"),
    (("db2",), "id BIGINT GENERATED ALWAYS AS IDENTITY PRIMARY KEY"),
    (("sqlite",), "id INTEGER PRIMARY KEY AUTOINCREMENT"),
    (("h2",), "id BIGINT AUTO_INCREMENT PRIMARY KEY"),
    (("derby",), "id BIGINT GENERATED ALWAYS AS IDENTITY PRIMARY KEY"),
    (("hsqldb",), "id BIGINT IDENTITY PRIMARY KEY"),
    (("clickhouse",), "id UUID DEFAULT generateUUIDv4()"),
]
ID_COLUMN_STANDARD = "id BIGINT GENERATED BY DEFAULT AS IDENTITY PRIMARY KEY"


def infer_types(df: DataFrame) -> DataFrame:
    """``(column_name, ddl_type)`` from all rows: BIGINT, else DOUBLE, else text.

    A column without any value stays text. One aggregate over all columns, then one
    short row per column.
    """
    counts, cells = [], []
    for i, name in enumerate(df.columns):
        text = F.col(f"`{name}`").cast("string")
        counts += [
            F.count(text).alias(f"n{i}"),
            F.count_if(text.isNotNull() & text.try_cast("bigint").isNull()).alias(f"b{i}"),
            F.count_if(text.isNotNull() & text.try_cast("double").isNull()).alias(f"d{i}"),
        ]
        kind = (F.when(F.col(f"n{i}") == 0, TEXT_TYPE).when(F.col(f"b{i}") == 0, "BIGINT")
                .when(F.col(f"d{i}") == 0, "DOUBLE").otherwise(TEXT_TYPE))
        cells.append(F.struct(F.lit(name).alias("column_name"), kind.alias("ddl_type")))
    return df.agg(*counts).select(F.inline(F.array(*cells)))


def compat_type(data_type: T.DataType) -> str:
    """Three-way rule on a typed column: whole number, other number, everything else."""
    if isinstance(data_type, T.IntegralType):
        return "BIGINT"
    return "DOUBLE" if isinstance(data_type, T.NumericType) else TEXT_TYPE


#: Where a database has no type of the standard name: first entry whose name occurs in the database type.
_OTHER_TYPES = [
    (("mysql", "mariadb", "tidb", "oceanbase"), {"DOUBLE PRECISION": "DOUBLE", "TIMESTAMP": "DATETIME(6)", "BOOLEAN": "TINYINT(1)", "CLOB": "LONGTEXT", "BLOB": "LONGBLOB"}),
    (("postgre", "greenplum"), {"CLOB": "TEXT", "BLOB": "BYTEA"}),
    (("sql server", "sqlserver"), {"DOUBLE PRECISION": "FLOAT(53)", "TIMESTAMP": "DATETIME2(6)", "BOOLEAN": "BIT", "CLOB": "NVARCHAR(MAX)", "BLOB": "VARBINARY(MAX)"}),
    (("oracle",), {"BIGINT": "NUMBER(19)", "INTEGER": "NUMBER(10)", "SMALLINT": "NUMBER(5)", "BOOLEAN": "NUMBER(1)"}),
    (("derby",), {"DOUBLE PRECISION": "DOUBLE"}),
    (("clickhouse",), {"DOUBLE PRECISION": "Float64", "TIMESTAMP": "DateTime64(6)", "CLOB": "String", "BLOB": "String", "BOOLEAN": "Bool"}),
    (("sqlite",), {"CLOB": "TEXT"}),
]


def full_type(data_type: T.DataType, db_type: str | None = None) -> str:
    """The column type that keeps every value of a Spark type: numbers with all digits, moments as moments, text uncut.

    Nested values are kept as their JSON text.
    """
    if isinstance(data_type, T.DecimalType):
        return f"DECIMAL({data_type.precision},{data_type.scale})"
    names = [((T.ByteType, T.ShortType), "SMALLINT"), ((T.IntegerType,), "INTEGER"), ((T.LongType,), "BIGINT"), ((T.FloatType, T.DoubleType), "DOUBLE PRECISION"),
             ((T.BooleanType,), "BOOLEAN"), ((T.DateType,), "DATE"), ((T.TimestampType, T.TimestampNTZType), "TIMESTAMP"), ((T.BinaryType,), "BLOB")]
    name = next((name for kinds, name in names if isinstance(data_type, kinds)), "CLOB")
    lowered = (db_type or "").lower()
    other = next((types for kinds, types in _OTHER_TYPES if any(kind in lowered for kind in kinds)), {})
    return other.get(name, name)


def id_column(db_type: str | None) -> str:
    lowered = (db_type or "").lower()
    for names, ddl in ID_COLUMN:
        if any(name in lowered for name in names):
            return ddl
    return ID_COLUMN_STANDARD


def create_table_ddl(table: str, schema: T.StructType, db_type: str | None = None, key: Sequence[str] = (), full: bool = False) -> str:
    """CREATE TABLE text; the generated id is added unless the rows bring one.

    ``full`` gives every column the type that keeps its values; otherwise the three-way rule holds. The columns of
    ``key`` are declared unique together, as an upsert at the database needs it; text among them is
    short enough to be indexed.
    """
    quote = "`" if (db_type or "").lower() in MYSQL_FAMILY else '"'
    kinds = {f.name: full_type(f.dataType, db_type) if full else compat_type(f.dataType) for f in schema.fields}
    texts = {f.name for f in schema.fields if isinstance(f.dataType, T.StringType) or not full and kinds[f.name] == TEXT_TYPE}
    parts = [f"{quote}{name}{quote} {KEY_TEXT_TYPE if name in key and name in texts else kind}" for name, kind in kinds.items()]
    if not any(f.name.lower() == "id" for f in schema.fields):
        parts.insert(0, id_column(db_type))
    if key:
        parts.append(f"UNIQUE ({', '.join(quote + k + quote for k in key)})")
    return f"CREATE TABLE {table} ({', '.join(parts)})"


def fit_schema(
    df: DataFrame,
    target: T.StructType,
    max_length: dict[str, int] | None = None,
    on_missing: str = "null",
    on_long: str = "cut",
    errors: str = "errors",
) -> DataFrame:
    """Project onto the target schema: convert types, cut or report long text, log what failed.

    ``errors`` lists ``type:col`` where a value did not convert and ``length:col`` where
    text was too long.
    """
    limits = max_length or {}
    out, notes = [], []
    for field in target.fields:
        if field.name not in df.columns:
            if on_missing == "fail":
                raise ValueError(f"column missing in the source: {field.name}")
            if on_missing == "null":
                out.append(F.lit(None).cast(field.dataType).alias(field.name))
            continue
        raw = F.col(f"`{field.name}`")
        value = raw.try_cast(field.dataType)
        notes.append(F.when(raw.isNotNull() & value.isNull(), F.lit(f"type:{field.name}")))
        limit = limits.get(field.name)
        if limit is not None:
            long = F.length(value) > limit
            notes.append(F.when(long, F.lit(f"length:{field.name}")))
            if on_long == "cut":
                value = F.when(long, F.left(value, F.lit(limit))).otherwise(value)
            elif on_long == "fail":
                value = F.when(long, F.raise_error(F.lit(f"value too long: {field.name}"))
                               ).otherwise(value)
        out.append(value.alias(field.name))
    found = F.array_compact(F.array(*notes)) if notes else F.array().cast("array<string>")
    return df.select(*out, found.alias(errors))


def split_rows(df: DataFrame, column: str, separator: str, keep: Sequence[str], out: str) -> DataFrame:
    """One row per part of a delimited text; ``separator`` is a regular expression."""
    return explode_items(df, keep, F.split(F.col(column), separator), out)
