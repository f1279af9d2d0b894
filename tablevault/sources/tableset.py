"""A set of databases and tables to snapshot, and its metadata frames.

A *table set* names tables by ``(db, table)`` and knows how to read each one (a Parquet path, a
catalog table, a JDBC table or a ready DataFrame). Metadata (databases, tables, columns) is one
row per database / table / column, so it is built on the driver; table *rows* are only ever read
by Spark scans.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Schemas every MySQL server has, left out when databases are listed.
SYSTEM_DATABASES = ["information_schema", "performance_schema", "sys", "mysql"]

# The server's Extra texts of computed columns.
COMPUTED = ("VIRTUAL GENERATED", "STORED GENERATED")

BASE_TABLE = "BASE TABLE"
VIEW = "VIEW"

# The driver's test tables grouped into databases (ours, see FIXTURES.md section 5).
TESTDATA_LAYOUT = {
    "sales": ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"],
    "web": ["events", "pages", "conversations"],
    "corpus": ["documents", "labels", "benchmark", "embeddings"],
}

# Unique row keys of the test tables, used to give dumps a deterministic order.
TESTDATA_KEYS = {
    "region": ["r_regionkey"],
    "nation": ["n_nationkey"],
    "customer": ["c_custkey"],
    "supplier": ["s_suppkey"],
    "part": ["p_partkey"],
    "orders": ["o_orderkey"],
    # lineitem has no unique key: its order is the whole row, so ties are identical rows
    "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                 "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                 "l_shipdate"],
    "events": ["event_id"],
    "pages": ["page_id"],
    "conversations": ["conv_id", "turn"],
    "documents": ["doc_id"],
    "labels": ["doc_id"],
    "benchmark": ["item_id"],
    "embeddings": ["vec_id"],
}

TABLES_SCHEMA = "db string, table string, kind string"
COLUMNS_SCHEMA = "db string, table string, pos int, name string, type string, extra string"


@dataclass
class TableSet:
    """Databases -> tables -> how to read them. Views carry their SQL text and no rows."""

    spark: SparkSession
    readers: dict[tuple[str, str], Callable[[], DataFrame]] = field(default_factory=dict)
    views: dict[tuple[str, str], str] = field(default_factory=dict)
    extras: dict[tuple[str, str, str], str] = field(default_factory=dict)
    keys: dict[tuple[str, str], list[str]] = field(default_factory=dict)
    create_sql: dict[tuple[str, str], str] = field(default_factory=dict)

    def add_table(self, db: str, table: str, reader: Callable[[], DataFrame] | DataFrame,
                  key: list[str] | None = None) -> "TableSet":
        self.readers[(db, table)] = reader if callable(reader) else (lambda d=reader: d)
        if key:
            self.keys[(db, table)] = list(key)
        return self

    def add_view(self, db: str, view: str, sql: str) -> "TableSet":
        self.views[(db, view)] = sql
        return self

    def mark_column(self, db: str, table: str, column: str, extra: str) -> "TableSet":
        """Set the server's ``Extra`` text for a column (e.g. ``STORED GENERATED``)."""
        self.extras[(db, table, column)] = extra
        return self

    def set_create_sql(self, db: str, table: str, sql: str) -> "TableSet":
        """The server's own ``CREATE TABLE`` text, written to dumps as it is (without the final ``;``)."""
        self.create_sql[(db, table)] = sql.strip().rstrip(";")
        return self

    def computed(self, db: str, table: str) -> set[str]:
        """Columns whose values the server computes; a dump leaves them out of its INSERTs."""
        return {c for (d, t, c), extra in self.extras.items()
                if (d, t) == (db, table) and extra.upper() in COMPUTED}

    def read(self, db: str, table: str) -> DataFrame:
        return self.readers[(db, table)]()

    def key(self, db: str, table: str) -> list[str] | None:
        return self.keys.get((db, table))


def parquet_tableset(spark: SparkSession, root: str, layout: dict[str, list[str]] | None = None,
                     keys: dict[str, list[str]] | None = None) -> TableSet:
    """A table set over ``<root>/<table>.parquet`` files, grouped into databases by ``layout``."""
    layout = layout or TESTDATA_LAYOUT
    keys = TESTDATA_KEYS if keys is None else keys
    ts = TableSet(spark)
    for db, names in layout.items():
        for name in names:
            path = f"{root.rstrip('/')}/{name}.parquet"
            ts.add_table(db, name, lambda p=path: spark.read.parquet(p), keys.get(name))
    return ts


def catalog_tableset(spark: SparkSession, databases: list[str] | None = None) -> TableSet:
    """A table set over the session catalog (Hive metastore, Unity, Glue ...)."""
    ts = TableSet(spark)
    dbs = databases or [d.name for d in spark.catalog.listDatabases()]
    for db in dbs:
        for t in spark.catalog.listTables(db):
            if t.tableType == "VIEW":
                ts.add_view(db, t.name, spark.sql(f"SHOW CREATE TABLE `{db}`.`{t.name}`").first()[0])
            elif not t.isTemporary:
                ts.add_table(db, t.name, lambda d=db, n=t.name: spark.table(f"`{d}`.`{n}`"))
    return ts


def jdbc_table_reader(spark: SparkSession, url: str, db: str, table: str, properties: dict,
                      partition_column: str | None = None, lower: int | None = None,
                      upper: int | None = None, num_partitions: int | None = None):
    """S4 over JDBC: a partitioned read (``partitionColumn`` ranges run as parallel queries)."""

    def read() -> DataFrame:
        opts = dict(properties)
        opts.update({"url": url, "dbtable": f"`{db}`.`{table}`"})
        if partition_column:
            opts.update({"partitionColumn": partition_column, "lowerBound": str(lower),
                         "upperBound": str(upper), "numPartitions": str(num_partitions)})
        return spark.read.format("jdbc").options(**opts).load()

    return read


def tableset_from_catalog(spark: SparkSession, schemata: DataFrame, tables_df: DataFrame, columns_df: DataFrame,
                          reader: Callable[[str, str], DataFrame]) -> TableSet:
    """A table set from a server's catalog frames.

    ``schemata``: (db); ``tables_df``: (db, table, kind, create_sql); ``columns_df``: (db, table, name, extra).
    System schemas are left out and any kind but a base table or a view is an error. ``reader(db, table)`` gives
    a table's rows and is called only when the table is read.
    """
    ts = TableSet(spark)
    wanted = {r["db"] for r in schemata.select("db").collect()} - set(SYSTEM_DATABASES)
    for r in check_kinds(tables_df).select("db", "table", "kind", "create_sql").collect():
        if r["db"] not in wanted:
            continue
        if r["kind"] == VIEW:
            ts.add_view(r["db"], r["table"], r["create_sql"] or "")
        else:
            ts.add_table(r["db"], r["table"], lambda d=r["db"], t=r["table"]: reader(d, t))
            if r["create_sql"]:
                ts.set_create_sql(r["db"], r["table"], r["create_sql"])
    for r in columns_df.select("db", "table", "name", "extra").collect():
        if r["extra"]:
            ts.mark_column(r["db"], r["table"], r["name"], r["extra"])
    return ts


def databases(ts: TableSet, drop_system: bool = True) -> DataFrame:
    """Database names (one row each), system schemas dropped."""
    names = sorted({db for db, _ in ts.readers} | {db for db, _ in ts.views})
    df = ts.spark.createDataFrame([(n,) for n in names], "db string")
    if drop_system:
        df = df.where(~F.col("db").isin(SYSTEM_DATABASES))
    return df


def tables(ts: TableSet) -> DataFrame:
    """``(db, table, kind)``; kind is BASE TABLE or VIEW."""
    rows = [(db, t, BASE_TABLE) for db, t in ts.readers] + [(db, v, VIEW) for db, v in ts.views]
    return ts.spark.createDataFrame(rows, TABLES_SCHEMA)


def check_kinds(tables_df: DataFrame) -> DataFrame:
    """S2 check: any kind other than BASE TABLE or VIEW fails the job."""
    return tables_df.withColumn(
        "kind",
        F.when(F.col("kind").isin(BASE_TABLE, VIEW), F.col("kind")).otherwise(
            F.raise_error(F.concat(F.lit("unknown table type: "), F.col("kind")))
        ),
    )


def columns(ts: TableSet) -> DataFrame:
    """S3: ``(db, table, pos, name, type, extra)`` from each table's schema (no rows are read)."""
    rows = []
    for (db, table), reader in ts.readers.items():
        for pos, f in enumerate(reader().schema.fields, start=1):
            rows.append((db, table, pos, f.name, f.dataType.simpleString(),
                         ts.extras.get((db, table, f.name), "")))
    return ts.spark.createDataFrame(rows, COLUMNS_SCHEMA)


def scan(ts: TableSet, db: str, table: str, cols: list[str] | None = None) -> DataFrame:
    """``SELECT col list FROM t`` - Catalyst prunes the unread columns at the scan."""
    df = ts.read(db, table)
    return df.select(*[F.col(f"`{c}`") for c in cols]) if cols else df


def big_table(spark: SparkSession, n_rows: int, payload_bytes: int = 4096) -> DataFrame:
    """The size-test table (``id``, ``payload`` of ``x`` bytes, ``created_at``), no cross join."""
    return spark.range(n_rows).select(
        F.col("id").cast(T.DecimalType(20, 0)).alias("id"),
        F.encode(F.repeat(F.lit("x"), payload_bytes), "UTF-8").alias("payload"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("created_at"),
    )
