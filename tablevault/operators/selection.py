"""Choosing databases, tables and columns (F1-F3) and describing a fleet of servers.

All of these work on metadata frames (one row per database, table, column or server); the joins
are anti / semi joins against small rule frames, broadcast only behind a size check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablevault.functions.literals import quote_ident
from tablevault.operators.common import broadcast_if_small, broadcast_known

RULES_SCHEMA = "rule_db string, rule_table string"


def select_databases(spark: SparkSession, available: DataFrame | None, include: list[str] | None = None,
                     exclude: list[str] | None = None) -> DataFrame:
    """an explicit include list replaces the listing (so system schemas can be named); the
    exclude list is applied afterwards; unknown excluded names are ignored; order is kept.

    Returns ``(db, ord)``; ``ord`` is the position in the include list or in the listing.
    """
    if include:
        base = spark.createDataFrame([(d, i) for i, d in enumerate(include)], "db string, ord int")
    else:
        # the listing is one row per database, so one ordering window over it is small
        w = F.row_number().over(Window.orderBy("db")) - 1
        base = available.select("db").withColumn("ord", w.cast("int"))
    if exclude:
        ex = spark.createDataFrame([(d,) for d in exclude], "db string")
        base = base.join(broadcast_known(ex, len(exclude)), "db", "left_anti")
    return base


def ignore_rules_frame(spark: SparkSession, rules: list[str]) -> DataFrame:
    """F2 rules as ``(rule_db, rule_table)``: ``db.table`` splits at the first dot; a bare name
    has a null database and matches in every database."""
    rows = []
    for r in rules:
        if "." in r:
            db, table = r.split(".", 1)
            rows.append((db, table))
        else:
            rows.append((None, r))
    return spark.createDataFrame(rows, RULES_SCHEMA)


def ignore_rules_column(rules) -> tuple:
    """F2 (column form): split rule text ``db.table`` at the first dot."""
    r = F.col(rules) if isinstance(rules, str) else rules
    parts = F.split(r, r"\.", 2)
    has_db = F.size(parts) == 2
    return (F.when(has_db, F.element_at(parts, 1)).alias("rule_db"),
            F.when(has_db, F.element_at(parts, 2)).otherwise(r).alias("rule_table"))


def ignore_tables(tables: DataFrame, rules: DataFrame, db: str = "db", table: str = "table") -> DataFrame:
    """drop tables (and views) matched by a rule; case-sensitive.

    Two anti joins, both equi-joins: bare rules on the table name alone, qualified rules on
    (db, table). No theta join is needed.
    """
    bare = rules.where(F.col("rule_db").isNull()).select(F.col("rule_table").alias(table))
    qualified = rules.where(F.col("rule_db").isNotNull()).select(
        F.col("rule_db").alias(db), F.col("rule_table").alias(table))
    out = tables.join(broadcast_if_small(bare), table, "left_anti")
    return out.join(broadcast_if_small(qualified), [db, table], "left_anti")


def is_ignored(db: str, table: str, rules: list[str]) -> bool:
    """F2 for one table on the driver (planning which tables to read)."""
    for r in rules:
        if "." in r:
            rdb, rt = r.split(".", 1)
            if rdb == db and rt == table:
                return True
        elif r == table:
            return True
    return False


# Extra texts that mark a computed column (only these are dropped; see README).
COMPUTED_EXTRAS = ["VIRTUAL GENERATED", "STORED GENERATED"]


def computed(extra) -> F.Column:
    e = F.upper(F.coalesce(F.col(extra) if isinstance(extra, str) else extra, F.lit("")))
    return e.contains("VIRTUAL GENERATED") | e.contains("STORED GENERATED")


def kept_columns(columns: DataFrame) -> DataFrame:
    """F3 (metadata): the non-computed columns, in server order."""
    return columns.where(~computed("extra")).orderBy("db", "table", "pos")


def project_columns(df: DataFrame, columns_meta: list[tuple[int, str, str]]) -> DataFrame:
    """``df`` with only its non-computed columns, in ``pos`` order.

    ``columns_meta`` is ``(pos, name, extra)`` for this one table (a handful of rows).
    """
    keep = [name for pos, name, extra in sorted(columns_meta)
            if not any(x in (extra or "").upper() for x in COMPUTED_EXTRAS)]
    return df.select(*[F.col(quote_ident(c)) for c in keep])


def database_set(df: DataFrame, group: str, db: str = "db") -> DataFrame:
    """Per group, the sorted database names as JSON and their count.

    ``collect_set`` holds distinct names only, bounded by the number of databases per group.
    """
    return df.groupBy(group).agg(F.array_sort(F.collect_set(db)).alias("_dbs")).select(
        group, F.to_json("_dbs").alias("databases"), F.size("_dbs").cast("int").alias("database_count"))


def server_variant(servers: DataFrame, engines: DataFrame | None = None,
                   plugins: DataFrame | None = None, server: str = "server") -> DataFrame:
    """Mariadb / percona / mysql per server from version and comment, then two probes.

    ``servers``: (server, version, comment); ``engines``: (server, engine); ``plugins``:
    (server, plugin_name). The probes are distinct-then-left joins, so a server with many engines
    or plugins still yields one row.
    """
    s = servers
    v = F.lower(F.coalesce(F.col("version"), F.lit("")))
    c = F.lower(F.coalesce(F.col("comment"), F.lit("")))
    if engines is not None:
        aria = engines.where(F.col("engine") == "Aria").select(server).distinct().withColumn("_aria", F.lit(True))
        s = s.join(aria, server, "left")
    else:
        s = s.withColumn("_aria", F.lit(None).cast("boolean"))
    if plugins is not None:
        perc = (plugins.where(F.lower(F.col("plugin_name")).like("%percona%")).select(server).distinct()
                .withColumn("_perc", F.lit(True)))
        s = s.join(perc, server, "left")
    else:
        s = s.withColumn("_perc", F.lit(None).cast("boolean"))
    variant = (F.when(v.contains("mariadb") | c.contains("mariadb"), F.lit("mariadb"))
               .when(c.contains("percona"), F.lit("percona"))
               .when(c.contains("mysql"), F.lit("mysql"))
               .when(F.coalesce(F.col("_aria"), F.lit(False)), F.lit("mariadb"))
               .when(F.coalesce(F.col("_perc"), F.lit(False)), F.lit("percona"))
               .otherwise(F.lit("mysql")))
    return s.withColumn("variant", variant).drop("_aria", "_perc")
