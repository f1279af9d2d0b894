"""Checked plans of restore: types and computed columns from the script's DDL, scripts read in blocks, manifests.

Each has its DuckDB oracle beside it, as in :mod:`tablevault.plans.checks`, which registers them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tablevault.functions.literals import EXACT
from tablevault.operators.audit import dump_report
from tablevault.operators.restore import read_scripts, run_restore
from tablevault.operators.statements import insert_single
from tablevault.plans.registry import fresh, plan, read
from tablevault.plans.script import DumpOptions, dump
from tablevault.sinks.manifest import manifest_report, verify_manifest
from tablevault.sinks.versions import current_version, read_published
from tablevault.sinks.writers import write_dump
from tablevault.sources.tableset import TableSet, parquet_tableset


#: A table with a column of every type, as its server would show it.
ALL_TYPES = """CREATE TABLE `all types` (
  `id` bigint NOT NULL COMMENT 'it''s the key, (unique)',
  `tu` tinyint unsigned DEFAULT '0',
  `su` smallint unsigned DEFAULT NULL,
  `mu` mediumint(8) unsigned zerofill DEFAULT NULL,
  `iu` int unsigned DEFAULT NULL,
  `bu` bigint(20) unsigned DEFAULT NULL,
  `ts` tinyint DEFAULT NULL,
  `b` tinyint(1) DEFAULT NULL,
  `d` decimal(12,2) unsigned DEFAULT '0.00',
  `wide` decimal(65,10) DEFAULT NULL,
  `f` double(10,4) DEFAULT NULL,
  `day` date DEFAULT NULL,
  `dt` datetime(6) DEFAULT NULL,
  `at` timestamp(6) NULL DEFAULT CURRENT_TIMESTAMP(6) ON UPDATE CURRENT_TIMESTAMP(6),
  `tm` time DEFAULT NULL,
  `js` json DEFAULT NULL,
  `e` enum('a,)b','F','O','P') CHARACTER SET latin1 COLLATE latin1_bin NOT NULL DEFAULT 'F',
  `bin` varbinary(40) DEFAULT NULL,
  `y` year DEFAULT NULL,
  `total` decimal(20,2) GENERATED ALWAYS AS ((`d` * `tu`)) STORED,
  `label` varchar(80) GENERATED ALWAYS AS (concat(`e`,_utf8mb4'-',`y`,_utf8mb4'''')) VIRTUAL,
  PRIMARY KEY (`id`),
  KEY `by_day` (`day` DESC,`e`(1)),
  CONSTRAINT `positive` CHECK ((`d` >= 0))
) ENGINE=InnoDB DEFAULT CHARSET=utf8mb4"""


@plan("restore_run_typed", """
SELECT o_orderkey AS id, CAST(o_orderkey % 256 AS SMALLINT) AS tu, CAST(65535 - o_orderkey % 65536 AS INTEGER) AS su,
  CAST(16777215 - o_orderkey % 7 AS INTEGER) AS mu, 4294967295 - o_orderkey AS iu,
  CAST(18446744073709551615 - o_orderkey AS VARCHAR) AS bu, CAST(o_orderkey % 256 - 128 AS TINYINT) AS ts,
  o_orderkey % 2 = 0 AS b, CAST(CAST(o_orderkey AS DECIMAL(12,2)) / 4 AS DECIMAL(12,2))::VARCHAR AS d,
  '1234567890123456789012345678901234567890.' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS wide,
  (o_orderkey % 1024) / 64 AS f, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS dt,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS "at", '-' || (o_orderkey % 839) || ':59:59' AS tm,
  '{"k": ' || o_custkey || '}' AS js, o_orderstatus AS e, upper(hex(o_orderpriority)) AS bin,
  CAST(1901 + o_orderkey % 255 AS INTEGER) AS y,
  CAST(CAST(CAST(o_orderkey AS DECIMAL(12,2)) / 4 AS DECIMAL(12,2)) * (o_orderkey % 256) AS DECIMAL(20,2))::VARCHAR AS total,
  o_orderstatus || '-' || (1901 + o_orderkey % 255) || chr(39) AS label
FROM orders""")
def restore_run_typed(spark, sf_dir):
    """Orders as a table of every type, dumped under the server's own DDL and restored from the files alone."""
    k = F.col("o_orderkey")
    quarter = (k.cast("decimal(12,2)") / 4).cast("decimal(12,2)")
    df = read(spark, sf_dir, "orders").select(
        k.alias("id"), (k % 256).cast("smallint").alias("tu"), (65535 - k % 65536).cast("int").alias("su"),
        (16777215 - k % 7).cast("int").alias("mu"), (4294967295 - k).alias("iu"),
        (F.lit("18446744073709551615").cast("decimal(20,0)") - k).cast("decimal(20,0)").alias("bu"),
        (k % 256 - 128).cast("tinyint").alias("ts"), (k % 2 == 0).alias("b"), quarter.alias("d"),
        F.concat(F.lit("1234567890123456789012345678901234567890."), F.lpad(k.cast("string"), 10, "0")).alias("wide"),
        (k % 1024 / 64).alias("f"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderdate").alias("dt"),
        F.col("o_orderdate").cast("timestamp").alias("at"), F.concat(F.lit("-"), k % 839, F.lit(":59:59")).alias("tm"),
        F.concat(F.lit('{"k": '), F.col("o_custkey"), F.lit("}")).alias("js"), F.col("o_orderstatus").alias("e"),
        F.encode("o_orderpriority", "UTF-8").alias("bin"), (1901 + k % 255).cast("int").alias("y"),
        F.lit(None).cast("decimal(20,2)").alias("total"), F.lit(None).cast("string").alias("label"))
    ts = TableSet(spark).add_table("every", "all types", df, ["id"]).set_create_sql("every", "all types", ALL_TYPES)
    for c, extra in (("total", "STORED GENERATED"), ("label", "VIRTUAL GENERATED")):
        ts.mark_column("every", "all types", c, extra)
    base = fresh(spark, "typed")
    write_dump(dump(ts, ["every"], DumpOptions(mode=EXACT)), f"{base}/dump")
    run_restore(spark, f"{base}/dump", f"{base}/out")
    back = spark.read.parquet(f"{base}/out/every/all types")
    day = "yyyy-MM-dd HH:mm:ss"
    return back.select("id", "tu", "su", "mu", "iu", F.col("bu").cast("string").alias("bu"), "ts", "b",
                       F.col("d").cast("string").alias("d"), "wide", "f", F.date_format("day", "yyyy-MM-dd").alias("day"),
                       F.date_format("dt", day).alias("dt"), F.date_format("at", day).alias("at"), "tm", "js", "e",
                       F.hex("bin").alias("bin"), "y", F.col("total").cast("string").alias("total"), "label")


@plan("dump_report_mixed_case", """
WITH t AS (
  SELECT 'Orders' AS "table", strlen('INSERT INTO `Orders` (`k`, `s`) VALUES (' || o_orderkey || ',' || chr(39) || o_orderstatus || chr(39) || ');') AS n FROM orders
  UNION ALL SELECT 'orders', strlen('INSERT INTO `orders` (`k`, `s`) VALUES (' || o_orderkey || ',' || chr(39) || o_orderpriority || chr(39) || ');') FROM orders
  UNION ALL SELECT 'Été', strlen('INSERT INTO `Été` (`k`) VALUES (' || n_nationkey || ');') FROM nation)
SELECT 'd' AS db, "table", count(*) AS n_statements, CAST(sum(n + 1) AS BIGINT) AS n_bytes, CAST(max(n) AS INTEGER) AS max_statement_bytes
FROM t GROUP BY "table" """)
def dump_report_mixed_case(spark, sf_dir):
    """Tables whose names differ in case alone are reported under their own names."""
    orders = read(spark, sf_dir, "orders")
    ts = TableSet(spark)
    ts.add_table("d", "Orders", orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s")), ["k"])
    ts.add_table("d", "orders", orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("s")), ["k"])
    ts.add_table("d", "\u00c9t\u00e9", read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")), ["k"])
    return dump_report(dump(ts, ["d"], DumpOptions(skip_extended_insert=True)))


def _duck_blocks() -> str:
    text = "'INSERT INTO `documents` (`doc_id`, `text`) VALUES (' || doc_id || ',' || chr(39) || {} || chr(39) || ');'"
    body = "text"
    for raw, esc in (("chr(92)", "chr(92) || chr(92)"), ("chr(39)", "chr(92) || chr(39)"), ("chr(34)", "chr(92) || chr(34)"),
                     ("chr(10)", "chr(92) || 'n'"), ("chr(13)", "chr(92) || 'r'")):
        body = f"replace({body}, {raw}, {esc})"
    comment = "'/* ' || lang || ' ; it' || chr(39) || 's' || chr(10) || '\"open */' || chr(10) || "
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i,
    {comment}{text.format(body)} AS stmt,
    sum(CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM documents)
SELECT CAST(i + coalesce(before, 0) AS BIGINT) AS pos, stmt FROM d
UNION ALL
SELECT CAST(i + coalesce(before, 0) + 1 AS BIGINT),
  'CREATE PROCEDURE p' || doc_id || '()' || chr(10) || 'BEGIN' || chr(10) || 'SELECT ' || chr(39) || 'a;' || chr(10) || ';b' || chr(39) || ';' || chr(10) || 'END'
FROM d WHERE doc_id % 10 = 0"""


@plan("read_script_blocks", _duck_blocks())
def read_script_blocks(spark, sf_dir):
    """Documents as one script file with comments and strings over several lines and stored programs between, read back in
    blocks of 50 kB: every statement at its position."""
    docs = read(spark, sf_dir, "documents")
    insert = insert_single(docs.select("doc_id", "text"), "documents", keep=["doc_id"])
    text = F.concat(F.lit("/* "), F.col("lang"), F.lit(" ; it's\n\"open */\n"), F.col("stmt"))
    program = F.concat(F.lit("\nDELIMITER //\nCREATE PROCEDURE p"), F.col("doc_id").cast("string"),
                       F.lit("()\nBEGIN\nSELECT 'a;\n;b';\nEND//\nDELIMITER ;"))
    # the texts are made before the sort: the one task that writes the file does nothing else
    rows = insert.join(docs.select("doc_id", "lang"), "doc_id").select(
        "doc_id", F.concat(text, F.when(F.col("doc_id") % 10 == 0, program).otherwise(F.lit(""))).alias("value"))
    path = fresh(spark, "blocks")
    rows.orderBy("doc_id").select("value").coalesce(1).write.text(path)
    return read_scripts(spark, path, block_bytes=50_000).select("pos", "stmt")


def _duck_single(db: str, table: str, columns: list[tuple[str, str]]) -> str:
    """One row per INSERT of a table: db, table, text."""
    names = ", ".join(f"`{c}`" for c, _ in columns)
    values = " || ',' || ".join(e for _, e in columns)
    return (f"SELECT '{db}' AS db, '{table}' AS \"table\", 'INSERT INTO `{table}` ({names}) VALUES (' || {values} || ');' AS stmt"
            f" FROM {table}")


@plan("manifest_report_sales", "WITH s AS (" + " UNION ALL ".join([
    _duck_single("sales", "orders", [("o_orderkey", "o_orderkey"), ("o_custkey", "o_custkey"), ("o_orderstatus", "chr(39) || o_orderstatus || chr(39)")]),
    _duck_single("sales", "nation", [("n_nationkey", "n_nationkey"), ("n_name", "chr(39) || n_name || chr(39)")]),
    _duck_single("web", "events", [("event_id", "event_id"), ("event_type", "chr(39) || event_type || chr(39)")])]) + """)
SELECT db, "table", count(*) AS n_statements, count(*) AS n_rows, CAST(sum(strlen(stmt) + 1) AS BIGINT) AS n_bytes,
  CAST(0 AS BIGINT) AS n_unsound FROM s GROUP BY db, "table" """)
def manifest_report_sales(spark, sf_dir):
    """A dump of two databases with its manifest: what it says of each table, and that the files agree."""
    ts = parquet_tableset(spark, sf_dir, layout={"sales": ["orders", "nation"], "web": ["events"]})
    few = TableSet(spark)
    for db, table, names in (("sales", "orders", ["o_orderkey", "o_custkey", "o_orderstatus"]), ("sales", "nation", ["n_nationkey", "n_name"]),
                             ("web", "events", ["event_id", "event_type"])):
        few.add_table(db, table, ts.read(db, table).select(*names), names[:1])
    path = fresh(spark, "manifest")
    write_dump(dump(few, ["sales", "web"], DumpOptions(mode=EXACT, skip_extended_insert=True)), path, num_partitions=12, manifest=True)
    unsound = verify_manifest(spark, path).count()
    return manifest_report(spark, path).select("db", "table", "n_statements", "n_rows", "n_bytes", F.lit(unsound).cast("long").alias("n_unsound"))


@plan("restore_versions", """
SELECT 'before' AS version, o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT 'current', o_orderkey, o_orderstatus FROM orders""")
def restore_versions(spark, sf_dir):
    """Two restores of a table into one place: a reader of the first version keeps it while the second is published."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    base = fresh(spark, "versions")
    found = []
    for name, rows in (("before", orders.where("o_orderkey % 2 = 0")), ("current", orders)):
        ts = TableSet(spark).add_table("d", "orders", rows, ["o_orderkey"])
        write_dump(dump(ts, ["d"], DumpOptions(mode=EXACT)), f"{base}/{name}")
        run_restore(spark, f"{base}/{name}", f"{base}/out", versioned=True)
        found.append(current_version(spark, f"{base}/out/d"))
    before = spark.read.parquet(f"{found[0]}/orders").select(F.lit("before").alias("version"), "o_orderkey", "o_orderstatus")
    current = read_published(spark, f"{base}/out/d", "orders")
    return before.unionByName(current.select(F.lit("current").alias("version"), "o_orderkey", "o_orderstatus"))
