"""Databases through Spark's JDBC source and sink."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.schema_fit import MYSQL_FAMILY, compat_type, create_table_ddl
from millrace.operators.upsert import KEEP_TARGET_ON_NULL, settle_batch
from millrace.sources.tables import is_read
from millrace.spec import FlowSpec, Strategy

# Database type (lower case) → URL form, default port, driver class.
# For trino and presto, db names the catalog, or catalog/schema.
DIALECTS = {
    "mysql": ("jdbc:mysql://{host}:{port}/{db}", 3306, "com.mysql.cj.jdbc.Driver"),
    "mariadb": ("jdbc:mariadb://{host}:{port}/{db}", 3306, "org.mariadb.jdbc.Driver"),
    "tidb": ("jdbc:mysql://{host}:{port}/{db}", 3306, "com.mysql.cj.jdbc.Driver"),
    "oceanbase": ("jdbc:mysql://{host}:{port}/{db}", 3306, "com.mysql.cj.jdbc.Driver"),
    "postgresql": ("jdbc:postgresql://{host}:{port}/{db}", 5432, "org.postgresql.Driver"),
    "greenplum": ("jdbc:postgresql://{host}:{port}/{db}", 5432, "org.postgresql.Driver"),
    "oracle": ("jdbc:oracle:thin:@{host}:{port}:{db}", 1521, "oracle.jdbc.OracleDriver"),
    "sql server": ("jdbc:sqlserver://{host}:{port};databaseName={db}", 1433,
                   "com.microsoft.sqlserver.jdbc.SQLServerDriver"),
    "sqlite": ("jdbc:sqlite:{db}", None, "org.sqlite.JDBC"),
    "h2": ("jdbc:h2:{db};MODE=MySQL", None, "org.h2.Driver"),
    "clickhouse": ("jdbc:clickhouse://{host}:{port}/{db}", 8123,
                   "com.clickhouse.jdbc.ClickHouseDriver"),
    "db2": ("jdbc:db2://{host}:{port}/{db}", 50000, "com.ibm.db2.jcc.DB2Driver"),
    "trino": ("jdbc:trino://{host}:{port}/{db}", 8080, "io.trino.jdbc.TrinoDriver"),
    "presto": ("jdbc:presto://{host}:{port}/{db}", 8080, "com.facebook.presto.jdbc.PrestoDriver"),
    "derby": ("jdbc:derby:{db};create=true", None, "org.apache.derby.iapi.jdbc.AutoloadedDriver"),
    "hsqldb": ("jdbc:hsqldb:hsql://{host}:{port}/{db}", 9001, "org.hsqldb.jdbc.JDBCDriver"),
    "tdengine": ("jdbc:TAOS://{host}:{port}/{db}", 6030, "com.taosdata.jdbc.TSDBDriver"),
    "duckdb": ("jdbc:duckdb:{db}", None, "org.duckdb.DuckDBDriver"),
    "firebird": ("jdbc:firebirdsql://{host}:{port}/{db}", 3050, "org.firebirdsql.jdbc.FBDriver"),
    "drill": ("jdbc:drill:drillbit={host}:{port}", 31010, "org.apache.drill.jdbc.Driver"),
    "neo4j": ("jdbc:neo4j:bolt://{host}:{port}", 7687, "org.neo4j.jdbc.Driver"),
    "sap_hana": ("jdbc:sap://{host}:{port}/?databaseName={db}", 39015, "com.sap.db.jdbc.Driver"),
    "snowflake": ("jdbc:snowflake://{host}.snowflakecomputing.com/?db={db}&schema=PUBLIC", None,
                  "net.snowflake.client.jdbc.SnowflakeDriver"),
}
MYSQL_PARAMS = ("useUnicode=true&characterEncoding={charset}&useSSL=false&serverTimezone={zone}"
                "&allowPublicKeyRetrieval=true")
POSTGRES_FAMILY = ("postgresql", "greenplum")
MERGE_FAMILY = ("h2", "derby", "oracle", "sql server", "db2", "hsqldb", "snowflake")


@dataclass(frozen=True)
class JdbcTarget:
    """Where a database is. The password comes from the caller, never from a spec file."""

    db_type: str
    db: str
    host: str = "localhost"
    port: int | None = None
    user: str | None = None
    password: str | None = field(default=None, repr=False)
    charset: str = "UTF-8"
    time_zone: str = "UTC"
    params: str = ""

    def url(self) -> str:
        kind = self.db_type.lower()
        if kind not in DIALECTS:
            return f"jdbc:{kind}://{self.host}:{self.port}/{self.db}"
        form, port, _ = DIALECTS[kind]
        text = form.format(host=self.host, port=self.port or port, db=self.db)
        if kind in MYSQL_FAMILY:
            text += "?" + MYSQL_PARAMS.format(charset=self.charset, zone=self.time_zone)
        return text

    def options(self) -> dict[str, str]:
        """Options for ``format("jdbc")``; ``params`` is ``k=v&k=v`` handed to the driver."""
        out = {"url": self.url()}
        known = DIALECTS.get(self.db_type.lower())
        if known:
            out["driver"] = known[2]
        if self.user:
            out["user"] = self.user
        if self.password:
            out["password"] = self.password
        out.update(dict(pair.split("=", 1) for pair in self.params.split("&") if "=" in pair))
        return out


def read(
    spark: SparkSession,
    target: JdbcTarget,
    table: str,
    partition_column: str | None = None,
    partitions: int = 1,
    init_sql: str | None = None,
    fetch_size: int = 10_000,
) -> DataFrame:
    """A table, read in parallel over ranges of ``partition_column``.

    The range bounds are one min/max query at the database; filters and columns are
    pushed down by Spark. Without a partition column one task reads the table, so a
    large table needs one.
    """
    options = {**target.options(), "fetchsize": str(fetch_size)}
    if init_sql:
        options["sessionInitStatement"] = init_sql
    whole = spark.read.format("jdbc").options(**options).option("dbtable", table)
    if not partition_column or partitions < 2:
        return whole.load()
    ends = f"SELECT MIN({partition_column}) AS LOW, MAX({partition_column}) AS HIGH FROM {table}"
    low, high = spark.read.format("jdbc").options(**options).option("query", ends).load().first()
    if low is None:
        return whole.load()
    return (whole.option("partitionColumn", partition_column).option("lowerBound", str(low))
            .option("upperBound", str(high)).option("numPartitions", str(partitions)).load())


def append(df: DataFrame, target: JdbcTarget, table: str, batch_size: int = 5_000,
           writers: int = 16, mode: str = "append") -> None:
    """Batched inserts; at most ``writers`` connections at a time.

    Each task commits once. A task lost after its commit inserts its rows again when it is
    retried, so a table that must not hold duplicates is written by ``upsert``.
    """
    (df.write.format("jdbc").options(**target.options()).option("dbtable", table)
     .option("batchsize", str(batch_size)).option("numPartitions", str(writers)).mode(mode).save())


@contextmanager
def connection_to(spark: SparkSession, target: JdbcTarget) -> Iterator:
    """A driver-side connection for statements and metadata; rows never pass through it."""
    options = target.options()
    jvm = spark.sparkContext._jvm
    props = jvm.java.util.Properties()
    for name, value in options.items():
        if name not in ("url", "driver"):
            props.setProperty(name, value)
    if "driver" in options:
        jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(options["driver"])
    connection = jvm.java.sql.DriverManager.getConnection(options["url"], props)
    try:
        yield connection
    finally:
        connection.close()


@dataclass(frozen=True)
class TableInfo:
    """A table or view as the database reports it."""

    name: str
    kind: str = "TABLE"
    schema: str | None = None
    remarks: str | None = None


def reported(metadata, kinds, catalog: str | None = None, schema: str | None = None, name: str = "%") -> list[TableInfo]:
    """What a connection's metadata lists."""
    found, out = metadata.getTables(catalog, schema, name, kinds), []
    while found.next():
        out.append(TableInfo(*(found.getString(c) for c in ("TABLE_NAME", "TABLE_TYPE", "TABLE_SCHEM", "REMARKS"))))
    return out


def _kinds(spark: SparkSession, *names: str):
    kinds = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.java.lang.String, len(names))
    for i, name in enumerate(names):
        kinds[i] = name
    return kinds


def describe_tables(spark: SparkSession, target: JdbcTarget, views: bool = True, schema: str | None = None) -> list[TableInfo]:
    """Tables, and views if asked for, with schema, type and remarks, in the order of the database."""
    with connection_to(spark, target) as connection:
        return reported(connection.getMetaData(), _kinds(spark, "TABLE", *(["VIEW"] if views else [])), schema=schema)


def list_tables(spark: SparkSession, target: JdbcTarget) -> list[str]:
    """Names of the tables the database reports, in its order."""
    return [t.name for t in describe_tables(spark, target, views=False)]


def is_reported(found: Sequence[TableInfo], table: str) -> bool:
    """Whether ``table``, alone or as ``schema.table``, quoted or not, is among them as written, in upper or in lower case."""
    parts = [part.strip('"`[]') for part in table.split(".")]
    for case in (str, str.upper, str.lower):
        *above, name = (case(part) for part in parts)
        if any(t.name == name and (not above or case(t.schema or "") == above[-1]) for t in found):
            return True
    return False


def table_exists(spark: SparkSession, target: JdbcTarget, table: str) -> bool:
    """Whether a table or view of this name exists, with its schema where the name has one."""
    return is_reported(describe_tables(spark, target), table)


def default_table(spark: SparkSession, target: JdbcTarget) -> str:
    names = list_tables(spark, target)
    if not names:
        raise ValueError("the database holds no table")
    return names[0]


def ad_hoc(spark: SparkSession, target: JdbcTarget, text: str) -> DataFrame | int:
    """SQL text for the database: rows of a query, or the affected rows of a statement."""
    if is_read(text):
        return spark.read.format("jdbc").options(**target.options()).option("query", text).load()
    return execute(spark, target, [text])


def execute(spark: SparkSession, target: JdbcTarget, statements: Sequence[str]) -> int:
    """Run statements in one transaction on one connection; gives the affected rows."""
    with connection_to(spark, target) as connection:
        connection.setAutoCommit(False)
        try:
            statement = connection.createStatement()
            affected = sum(max(statement.executeUpdate(text), 0) for text in statements)
            connection.commit()
            return affected
        except Exception:
            connection.rollback()
            raise


def merge_statements(db_type: str, table: str, stage: str, columns: Sequence[str], key: Sequence[str],
                     nulls: str = KEEP_TARGET_ON_NULL) -> list[str]:
    """SQL that folds a staging table into the target, in the form the database knows.

    With ``nulls="keep"`` a null leaves the target's value.
    """
    def value(new: str, old: str) -> str:
        return f"COALESCE({new}, {old})" if nulls == KEEP_TARGET_ON_NULL else new

    quoted = [f'"{c}"' for c in columns]
    names = ", ".join(quoted)
    rest = [f'"{c}"' for c in columns if c not in key]
    same = " AND ".join(f't."{k}" = s."{k}"' for k in key)
    kind = db_type.lower()
    if kind in MYSQL_FAMILY:
        back = [c.replace('"', "`") for c in quoted]
        sets = ", ".join(f"`{c}` = {value(f'VALUES(`{c}`)', f'{table}.`{c}`')}" for c in columns if c not in key)
        return [f"INSERT INTO {table} ({', '.join(back)}) SELECT {', '.join(back)} FROM {stage} "
                f"ON DUPLICATE KEY UPDATE {sets or back[0] + ' = ' + back[0]}"]
    if kind in POSTGRES_FAMILY:
        sets = ", ".join(f"{c} = {value(f'EXCLUDED.{c}', f'{table}.{c}')}" for c in rest)
        target_key = ", ".join(f'"{k}"' for k in key)
        return [f"INSERT INTO {table} ({names}) SELECT {names} FROM {stage} "
                f"ON CONFLICT ({target_key}) DO " + (f"UPDATE SET {sets}" if rest else "NOTHING")]
    if kind in MERGE_FAMILY:
        sets = ", ".join(f"{c} = {value(f's.{c}', f't.{c}')}" for c in rest)
        values = ", ".join(f"s.{c}" for c in quoted)
        update = f"WHEN MATCHED THEN UPDATE SET {sets} " if rest else ""
        return [f"MERGE INTO {table} t USING {stage} s ON {same} {update}"
                f"WHEN NOT MATCHED THEN INSERT ({names}) VALUES ({values})"]
    here = " AND ".join(f'{table}."{k}" = s."{k}"' for k in key)
    sets = ", ".join(f"{c} = {value(f'(SELECT s.{c} FROM {stage} s WHERE {here})', c)}" for c in rest)
    exists = f"EXISTS (SELECT 1 FROM {stage} s WHERE {here})"
    missing = f"NOT EXISTS (SELECT 1 FROM {table} t WHERE {same})"
    update = [f"UPDATE {table} SET {sets} WHERE {exists}"] if rest else []
    return [*update,
            f"INSERT INTO {table} ({names}) SELECT {names} FROM {stage} s WHERE {missing}"]


def upsert(df: DataFrame, target: JdbcTarget, table: str, key: Sequence[str], seq: Sequence[str] = (),
           nulls: str = KEEP_TARGET_ON_NULL) -> int:
    """Write a staging table in parallel, then fold it in with one statement at the database.

    The batch is settled to one row per key first. The staging table has a name of its own and
    goes in the end. Rows without a key cannot match; they are inserted in the same transaction, so a
    run that failed before its commit has inserted none of them.
    """
    spark = df.sparkSession
    fresh, loose = settle_batch(df, key, seq, nulls)
    stage, spare = (f"{table}_s{uuid.uuid4().hex[:12]}" for _ in range(2))
    statements = merge_statements(target.db_type, table, stage, df.columns, key, nulls)
    try:
        append(fresh, target, stage, mode="overwrite")
        if not loose.isEmpty():
            append(loose, target, spare, mode="overwrite")
            statements.append(insert_all(target.db_type, table, spare, df.columns))
        return execute(spark, target, statements)
    finally:
        for name in (stage, spare):
            _drop(spark, target, name)


def insert_all(db_type: str, table: str, stage: str, columns: Sequence[str]) -> str:
    quote = "`" if db_type.lower() in MYSQL_FAMILY else '"'
    names = ", ".join(f"{quote}{c}{quote}" for c in columns)
    return f"INSERT INTO {table} ({names}) SELECT {names} FROM {stage}"


def _drop(spark: SparkSession, target: JdbcTarget, table: str) -> None:
    """Drop a staging table that may not have been made, whatever its name looks like in the metadata."""
    with contextlib.suppress(Py4JJavaError):
        execute(spark, target, [f"DROP TABLE {table}"])


def create_table(spark: SparkSession, target: JdbcTarget, table: str, df: DataFrame, key: Sequence[str] = (), compat: bool = False) -> str:
    """Create the table with full column types, or by the three-way rule (``compat``)."""
    ddl = create_table_ddl(table, df.schema, target.db_type, key, full=not compat)
    execute(spark, target, [ddl])
    return ddl


def column_types(df: DataFrame) -> str:
    """Value of ``createTableColumnTypes`` for text columns under the three-way type rule."""
    return ", ".join(f"{f.name} {compat_type(f.dataType)}" for f in df.schema.fields
                     if compat_type(f.dataType).startswith("VARCHAR"))


@dataclass
class JdbcSink:
    """Database target of a flow: FULL appends, other strategies upsert. A missing table is created."""

    target: JdbcTarget
    table: str
    compat_types: bool = False
    appends_in_one_pass = True

    def write(self, df: DataFrame, flow: FlowSpec, run_id: str) -> None:
        if not table_exists(df.sparkSession, self.target, self.table):
            key = () if flow.strategy is Strategy.FULL else flow.key
            create_table(df.sparkSession, self.target, self.table, df, key, self.compat_types)
        if flow.strategy is Strategy.FULL:
            append(df, self.target, self.table)
        else:
            upsert(df, self.target, self.table, flow.key, flow.sequence)
