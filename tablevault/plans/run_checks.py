"""Checked plans of whole runs and of a script's other parts: stored programs, order, archives, targets, reports.

Each has its DuckDB oracle beside it, as in :mod:`tablevault.plans.checks`, which registers them.
"""

from __future__ import annotations

import base64
import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from tablevault.functions.literals import EXACT
from tablevault.functions.names import parse_target
from tablevault.operators.audit import run_report
from tablevault.operators.restore import load_inserts, read_archives, read_scripts
from tablevault.operators.retention import classify_names, prune_by_count
from tablevault.operators.statements import insert_single, with_positions
from tablevault.plans.backup import run_backup
from tablevault.plans.registry import fresh, plan, read
from tablevault.plans.script import PROGRAM_SETTINGS_AFTER, PROGRAM_SETTINGS_BEFORE, DumpOptions, Programs, dump
from tablevault.sinks.encrypted import key_provider, read_encrypted_scripts, write_encrypted_dump
from tablevault.sinks.writers import delete_backups, write_dump
from tablevault.sources.listing import list_backups
from tablevault.sources.tableset import TableSet, big_table, tables, tableset_from_catalog


def _text(text: str) -> str:
    """A DuckDB expression for a text."""
    return " || chr(10) || ".join("'" + line.replace("'", "''") + "'" for line in text.split("\n"))


def _duck_programs() -> str:
    before, after = _text("\n" + PROGRAM_SETTINGS_BEFORE + "\nDELIMITER ;;\n"), _text("\nDELIMITER ;\n" + PROGRAM_SETTINGS_AFTER)
    trigger = (f"{before} || '/*!50003 CREATE*/ /*!50017 DEFINER=`' || CASE WHEN p_partkey % 2 = 0 THEN 'root`@`localhost' ELSE 'app`@`%' END"
               " || '`*/ /*!50003 TRIGGER `tr' || p_partkey || '` ' || CASE WHEN p_partkey % 3 = 0 THEN 'BEFORE' ELSE 'AFTER' END"
               f" || ' INSERT ON `part` FOR EACH ROW SET @x = ' || chr(39) || p_type || chr(39) || ' */;;' || {after}")
    routine = (f"{before} || 'CREATE FUNCTION `f' || s_suppkey || '`() RETURNS int' || chr(10) || 'RETURN ' || s_nationkey || ' ;;' || {after}")
    drop = "chr(10) || '/*!50003 DROP FUNCTION IF EXISTS `f' || s_suppkey || '` */;' || chr(10) || "
    core = (_text("SET @saved_cs_client     = @@character_set_client;\n/*!50503 SET character_set_client = utf8mb4 */;\n/*!50001 CREATE VIEW `v")
            + " || n_nationkey || '` AS SELECT ' || chr(10) || ' 1 AS `a`,' || chr(10) || ' 1 AS `b``c`*/;' || chr(10) || "
            + "'SET character_set_client = @saved_cs_client;'")
    stub = (_text("\n--\n-- Temporary view structure for view `v") + " || n_nationkey || '`' || " + _text("\n--\n\nDROP TABLE IF EXISTS `v")
            + " || n_nationkey || '`;' || chr(10) || '/*!50001 DROP VIEW IF EXISTS `v' || n_nationkey || '`*/;' || chr(10) || " + core)
    view = ("'/*!50001 DROP VIEW IF EXISTS `v' || n_nationkey || '`*/;' || " + _text(
        "\n/*!50001 SET @saved_cs_client          = @@character_set_client */;\n/*!50001 SET @saved_cs_results         = @@character_set_results */;\n"
        "/*!50001 SET @saved_col_connection     = @@collation_connection */;\n/*!50001 SET character_set_client      = ")
        + " || cs || ' */;' || chr(10) || '/*!50001 SET character_set_results     = ' || cs || ' */;' || chr(10)"
        " || '/*!50001 SET collation_connection      = utf8mb4_0900_ai_ci */;' || chr(10)"
        " || '/*!50001 CREATE ALGORITHM=UNDEFINED */' || chr(10) || '/*!50013 DEFINER=`a VIEW`@`h` SQL SECURITY DEFINER */' || chr(10)"
        " || '/*!50001 VIEW `v' || n_nationkey || '` AS select ' || chr(39) || n_name || chr(39) || ' AS `a`,1 AS `b``c` */;' || " + _text(
            "\n/*!50001 SET character_set_client      = @saved_cs_client */;\n/*!50001 SET character_set_results     = @saved_cs_results */;\n"
            "/*!50001 SET collation_connection      = @saved_col_connection */;"))
    final = (_text("\n--\n-- Current Database: `d`\n--\n\nUSE `d`;\n\n--\n-- Final view structure for view `v") + " || n_nationkey || '`' || "
             + _text("\n--\n\n") + " || " + view)
    parts = []
    for compact in ("false", "true"):
        small = compact == "true"
        parts += [f"SELECT {compact} AS compact, 1 AS section, {trigger} AS value FROM part",
                  f"SELECT {compact}, 3, {routine if small else drop + routine} FROM supplier",
                  f"SELECT {compact}, 2, {'chr(10) || ' + core if small else stub} FROM n",
                  f"SELECT {compact}, 4, {'chr(10) || ' + _text('USE `d`;') + ' || chr(10) || ' + view if small else final} FROM n"]
    return ("WITH n AS (SELECT *, CASE WHEN n_nationkey % 2 = 0 THEN 'latin1' ELSE 'utf8mb4' END AS cs FROM nation) "
            + " UNION ALL ".join(parts))


@plan("script_programs", _duck_programs())
def script_programs(spark, sf_dir):
    """A trigger for every part, a function for every supplier and a view for every nation, in full and in compact form."""
    part, supplier, nation = (read(spark, sf_dir, t) for t in ("part", "supplier", "nation"))
    ts = TableSet(spark).add_table("d", "part", part, ["p_partkey"])
    for r in nation.select("n_nationkey").collect():
        ts.add_view("d", f"v{r[0]}", "")
    k, n = F.col("p_partkey").cast("string"), F.col("n_nationkey").cast("string")
    programs = Programs(
        triggers=part.select(
            F.lit("d").alias("db"), F.lit("part").alias("table"), F.concat(F.lit("tr"), k).alias("name"), F.lit("INSERT").alias("event"),
            F.when(F.col("p_partkey") % 3 == 0, "before").alias("timing"),
            F.concat(F.lit("SET @x = '"), "p_type", F.lit("'")).alias("statement"),
            F.when(F.col("p_partkey") % 2 == 0, "root@localhost").otherwise("app").alias("definer")),
        views=nation.select(
            F.lit("d").alias("db"), F.concat(F.lit("v"), n).alias("view"), F.array(F.lit("a"), F.lit("b`c")).alias("columns"),
            F.concat(F.lit("CREATE ALGORITHM=UNDEFINED DEFINER=`a VIEW`@`h` SQL SECURITY DEFINER VIEW `v"), n, F.lit("` AS select '"), "n_name",
                     F.lit("' AS `a`,1 AS `b``c`")).alias("create_sql"),
            F.when(F.col("n_nationkey") % 2 == 0, "latin1").alias("charset"), F.lit(None).cast("string").alias("collation")),
        routines=supplier.select(
            F.lit("d").alias("db"), F.lit("function").alias("kind"), F.concat(F.lit("f"), F.col("s_suppkey").cast("string")).alias("name"),
            F.concat(F.lit("CREATE FUNCTION `f"), F.col("s_suppkey").cast("string"), F.lit("`() RETURNS int\nRETURN "),
                     F.col("s_nationkey").cast("string")).alias("create_sql")))
    found = []
    for compact in (False, True):
        script = dump(ts, ["d"], DumpOptions(compact=compact, skip_extended_insert=True), programs=programs)
        rows = script.where("(section = 1 AND part = 3) OR section IN (2, 4) OR (section = 3 AND part = 1)")
        found.append(rows.select(F.lit(compact).alias("compact"), "section", "value"))
    return found[0].unionByName(found[1])


@plan("script_positions", """
WITH s AS (
  SELECT 1 AS t, o_orderkey AS k, 'INSERT INTO `orders` (`o_orderkey`, `o_orderpriority`) VALUES (' || o_orderkey || ',' || chr(39) || o_orderpriority || chr(39) || ');' AS stmt FROM orders
  UNION ALL SELECT 0, n_nationkey, 'INSERT INTO `Nation` (`n_nationkey`, `n_name`) VALUES (' || n_nationkey || ',' || chr(39) || n_name || chr(39) || ');' FROM nation
  UNION ALL SELECT 2, s_suppkey, 'INSERT INTO `supplier` (`s_suppkey`) VALUES (' || s_suppkey || ');' FROM supplier)
SELECT row_number() OVER (ORDER BY t, k) - 1 AS pos, stmt FROM s""")
def script_positions(spark, sf_dir):
    """The INSERT statements of a dump's files in the order of files and statements: by table without regard to case, by key."""
    ts = TableSet(spark)
    ts.add_table("d", "supplier", read(spark, sf_dir, "supplier").select("s_suppkey"), ["s_suppkey"])
    ts.add_table("d", "orders", read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderkey"])
    ts.add_table("d", "Nation", read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), ["n_nationkey"])
    path = fresh(spark, "positions")
    write_dump(dump(ts, ["d"], DumpOptions(mode=EXACT, skip_extended_insert=True)), path, num_partitions=9)
    stmts = read_scripts(spark, path).where(F.startswith("stmt", F.lit("INSERT INTO")))
    return with_positions(stmts, ["file", "pos"], keep=["stmt"]).select(F.col("_pos").alias("pos"), "stmt")


def _archive(path: str):
    """Writes one tar.gz of a group's statements, a member a market segment, and returns its name."""

    def write(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        import io
        import tarfile

        from pyarrow import fs

        from tablevault.sources.listing import normalize_url

        filesystem, base = fs.FileSystem.from_uri(normalize_url(path))
        name = f"db_backup_2024-01-{int(key[0]) + 1:02}T00:00:00Z.tgz"
        held = io.BytesIO()
        with tarfile.open(fileobj=held, mode="w:gz") as tar:
            folder = tarfile.TarInfo("dump")
            folder.type = tarfile.DIRTYPE
            tar.addfile(folder)
            for segment, part in sorted(rows.groupby("c_mktsegment")):
                data = "\n".join(part.sort_values("c_custkey")["stmt"]).encode()
                member = tarfile.TarInfo(f"dump/{segment}.sql")
                member.size = len(data)
                tar.addfile(member, io.BytesIO(data))
        filesystem.create_dir(base, recursive=True)
        with filesystem.open_output_stream(f"{base}/{name}") as out:
            out.write(held.getvalue())
        return pd.DataFrame([(name,)], columns=["name"])

    return write


@plan("list_archives", """
SELECT 'db_backup_2024-01-' || lpad(CAST(c_nationkey + 1 AS VARCHAR), 2, '0') || 'T00:00:00Z.tgz' AS filename,
  'dump/' || c_mktsegment || '.sql' AS member,
  row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) - 1 AS pos,
  'INSERT INTO `customer` (`c_custkey`, `c_name`) VALUES (' || c_custkey || ',' || chr(39) || c_name || chr(39) || ');' AS stmt
FROM customer""")
def list_archives(spark, sf_dir):
    """An archive of statements for every nation, listed as backups and read member by member."""
    path = fresh(spark, "archives")
    customers = read(spark, sf_dir, "customer")
    text = insert_single(customers, "customer", ["c_custkey", "c_name"], mode=EXACT, keep=["c_nationkey", "c_mktsegment", "c_custkey"])
    made = text.groupBy("c_nationkey").applyInPandas(_archive(path), "name string").count()
    listing = list_backups(spark, [path]).where("length > 0")
    if listing.count() != made:
        raise ValueError(f"{made} archives were written, the listing has another number")
    name = F.element_at(F.split("archive", "/"), -1)
    return read_archives(spark, path).join(listing.select(F.col("filename")), name == F.col("filename")).select("filename", "member", "pos", "stmt")


@plan("run_report_events", """
WITH r AS (SELECT event_id, CAST(user_id % 3 AS BIGINT) AS n, user_id FROM events)
SELECT CAST(event_id AS VARCHAR) AS run_id, CAST(60 + user_id % 100 AS DOUBLE) AS total_seconds, CAST(45.5 AS DOUBLE) AS dump_seconds, event_id * 10 AS bytes,
  CAST(n AS INTEGER) AS n_uploads, CAST(CASE n WHEN 0 THEN 0.0 WHEN 1 THEN 1.25 ELSE 3.75 END AS DOUBLE) AS upload_seconds FROM r""")
def run_report_events(spark, sf_dir):
    """A run for every event: total, dump and upload seconds, bytes, uploads."""
    ts = F.col("ts").cast("timestamp")
    plus = lambda s: ts + F.make_dt_interval(secs=s)
    upload = lambda i: F.struct(F.lit(f"t{i}").alias("target"), F.lit("x").alias("filename"), ts.alias("start"),
                                plus(F.lit(1.25 * (i + 1)).cast("decimal(18,6)")).alias("end"))
    runs = read(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("run_id"), ts.alias("start"), plus((60 + F.col("user_id") % 100).cast("decimal(18,6)")).alias("end"),
        plus(F.lit(2).cast("decimal(18,6)")).alias("dump_start"), plus(F.lit(47.5).cast("decimal(18,6)")).alias("dump_end"),
        (F.col("event_id") * 10).alias("bytes"),
        F.slice(F.array(upload(0), upload(1)), F.lit(1), (F.col("user_id") % 3).cast("int")).alias("uploads"))
    return run_report(runs)


@plan("targets", r"""
WITH t AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN '/backups/' || page_id || '/x' WHEN 2 THEN 'S3A://bucket-' || page_id || '/a/b'
    ELSE 'file:///mnt/' || page_id END AS url FROM pages)
SELECT page_id, url, lower(regexp_extract(full_, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, regexp_extract(full_, '^[A-Za-z][A-Za-z0-9+.-]*://([^/]*)', 1) AS host,
  regexp_extract(full_, '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*(/.*)?$', 1) AS path
FROM (SELECT *, CASE WHEN starts_with(url, '/') THEN 'file://' || url ELSE url END AS full_ FROM t)""")
def targets(spark, sf_dir):
    """Scheme, host and path of target URLs made from the pages."""
    p = F.col("page_id")
    url = (F.when(p % 4 == 0, F.col("url")).when(p % 4 == 1, F.concat(F.lit("/backups/"), p, F.lit("/x")))
           .when(p % 4 == 2, F.concat(F.lit("S3A://bucket-"), p, F.lit("/a/b"))).otherwise(F.concat(F.lit("file:///mnt/"), p)))
    return read(spark, sf_dir, "pages").select("page_id", url.alias("url")).withColumn("t", parse_target("url")).select("page_id", "url", "t.*")


@plan("delete_and_list", """
WITH names AS (SELECT DISTINCT event_type AS target, strftime(ts, '%Y-%m-%dT%H:%M:00Z') AS t FROM events),
ranked AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY t DESC) AS r FROM names)
SELECT target, 'db_backup_' || t || '.tgz' AS filename FROM ranked WHERE r <= 20
UNION ALL SELECT DISTINCT event_type, 'notes.txt' FROM events""")
def delete_and_list(spark, sf_dir):
    """A backup file for every minute with an event, in a folder for each type; all but the 20 newest deleted, the rest listed."""
    path = fresh(spark, "deleted")
    events = read(spark, sf_dir, "events")
    folder = F.concat(F.lit(path + "/"), "event_type")
    name = F.concat(F.lit("db_backup_"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:00'Z'"), F.lit(".tgz"))
    files = events.select(folder.alias("folder"), name.alias("name")).distinct().unionByName(
        events.select(folder.alias("folder"), F.lit("notes.txt").alias("name")).distinct())

    def touch(batches):
        from pyarrow import fs

        from tablevault.sources.listing import normalize_url

        for batch in batches:
            for where, file in zip(batch["folder"], batch["name"], strict=True):
                filesystem, base = fs.FileSystem.from_uri(normalize_url(where))
                filesystem.create_dir(base, recursive=True)
                with filesystem.open_output_stream(f"{base}/{file}") as out:
                    out.write(b"x")
            yield batch

    files.mapInPandas(touch, files.schema).count()
    roots = events.select(folder.alias("target")).distinct()
    gone = delete_backups(prune_by_count(classify_names(list_backups(spark, roots)), 20), dry_run=False)
    if gone.where("NOT deleted").limit(1).count():
        raise OSError("a backup could not be deleted")
    return list_backups(spark, roots).select(F.element_at(F.split("target", "/"), -1).alias("target"), "filename")


@plan("run_backup_targets", """
WITH s AS (SELECT 'INSERT INTO `supplier` (`s_suppkey`, `s_name`) VALUES (' || s_suppkey || ',' || chr(39) || 'masked' || chr(39) || ');' AS stmt
  FROM supplier WHERE s_nationkey < 20)
SELECT target, stmt FROM s, (VALUES ('a'), ('b')) t(target)""")
def run_backup_targets(spark, sf_dir):
    """A whole run with a hook that filters and masks a table, pushed to two targets."""
    supplier = read(spark, sf_dir, "supplier")
    ts = TableSet(spark).add_table("d", "supplier", supplier, ["s_suppkey"])
    path = fresh(spark, "run")

    def hook(db, table, df):
        return df.where("s_nationkey < 20").select("s_suppkey", F.lit("masked").alias("s_name"))

    run = run_backup(ts, ["d"], [f"{path}/a", f"{path}/b"], DumpOptions(skip_extended_insert=True), table_hook=hook, now=dt.datetime(2024, 1, 1))
    name = run.first()["name"]
    found = [read_scripts(spark, f"{path}/{t}/{name}").where(F.startswith("stmt", F.lit("INSERT INTO"))).select(F.lit(t).alias("target"), "stmt")
             for t in "ab"]
    return found[0].unionByName(found[1])


@plan("catalog_tables", """
SELECT p_brand AS db, 't' || p_partkey AS "table", CASE WHEN p_size % 5 = 0 THEN 'VIEW' ELSE 'BASE TABLE' END AS kind
FROM part WHERE p_brand <> (SELECT min(p_brand) FROM part)""")
def catalog_tables(spark, sf_dir):
    """Tables and views of a server's catalog, made from the parts; one brand is not among its schemas."""
    part = read(spark, sf_dir, "part")
    first = part.agg(F.min("p_brand")).first()[0]
    rows = part.select(F.col("p_brand").alias("db"), F.concat(F.lit("t"), F.col("p_partkey")).alias("table"),
                       F.when(F.col("p_size") % 5 == 0, "VIEW").otherwise("BASE TABLE").alias("kind"), F.lit(None).cast("string").alias("create_sql"))
    schemata = rows.select("db").distinct().where(F.col("db") != first).unionByName(spark.createDataFrame([("mysql",)], "db string"))
    none = spark.createDataFrame([], "db string, table string, name string, extra string")
    return tables(tableset_from_catalog(spark, schemata, rows, none, lambda db, table: spark.range(0)))


@plan("big_table_rows", """
SELECT CAST(i AS DECIMAL(20,0))::VARCHAR AS id, repeat('x', 4096) AS payload, '2024-01-01 00:00:00' AS created_at
FROM (SELECT unnest(range(CAST((SELECT count(*) FROM orders) AS BIGINT))) AS i)""")
def big_table_rows(spark, sf_dir):
    """The size-test table with a row for every order."""
    rows = big_table(spark, read(spark, sf_dir, "orders").count())
    return rows.select(F.col("id").cast("string").alias("id"), F.decode("payload", "UTF-8").alias("payload"),
                       F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


@plan("encrypted_dump", "SELECT o_orderkey, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS day FROM orders")
def encrypted_dump(spark, sf_dir):
    """Orders written as encrypted part files and loaded from them."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    provider = key_provider(base64.b64encode(bytes(range(32))).decode())
    path = fresh(spark, "encrypted")
    script = dump(TableSet(spark).add_table("d", "orders", orders, ["o_orderkey"]), ["d"], DumpOptions(mode=EXACT, max_allowed_packet=65536))
    write_encrypted_dump(script, path, provider, num_partitions=8)
    back = load_inserts(read_encrypted_scripts(spark, path, provider), "orders", orders.schema)
    return back.select("o_orderkey", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("day"))
