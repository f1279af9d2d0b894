"""Checked plans over the driver tables: each Spark plan has a DuckDB oracle beside it.

Every plan reads whole tables from ``sf_dir`` (or frames Spark derives from them). The DuckDB
text restates the same result independently; ``__spark_entry__`` wires both into the driver.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablevault.operators.common import broadcast_if_small, broadcast_known
from tablevault.functions.literals import EXACT, row_tuple
from tablevault.operators.audit import (check_begin, dump_report, first_run, missed_runs,
                                        verify_snapshot)
from tablevault.operators.restore import (load_inserts, load_scripts, mapping_frame, read_scripts,
                                          remap_databases, run_restore)
from tablevault.plans.script import DumpOptions, Programs, dump
from tablevault.plans.registry import ORACLES, PLANS, plan, read  # noqa: F401
from tablevault.session import ensure_checkpoint_dir
from tablevault.sinks.writers import decrypt_column, encrypt_column, write_dump
from tablevault.streaming.continuous import dump_stream, file_stream
from tablevault.functions.names import (backup_name, extension, safe_name, selection_mode,
                                       target_identity)
from tablevault.operators.selection import (database_set, ignore_rules_frame, ignore_tables,
                                            kept_columns, project_columns, select_databases,
                                            server_variant)
from tablevault.plans.script import union_all
from tablevault.sources.tableset import (TESTDATA_KEYS, TESTDATA_LAYOUT, TableSet, columns, databases, parquet_tableset,
                                        scan)
from tablevault.operators.retention import (classify_names, prune, prune_by_age,
                                            prune_by_count, prune_report)
from tablevault.operators.statements import insert_extended, insert_single
from tablevault.plans.duck_sql import (TABLE_COLUMNS, _sq, duck_insert, duck_packed_whole, duck_prefix,
                                       duck_table_pre, duck_tuple)

# --- L1-L13, D1, D2 ---------------------------------------------------------------------------

@plan("row_tuples_customer", f"""
SELECT c_custkey, {duck_tuple(TABLE_COLUMNS['customer'])} AS tuple FROM customer
""")
def row_tuples_customer(spark, sf_dir):
    df = read(spark, sf_dir, "customer")
    return df.select("c_custkey", row_tuple(df).alias("tuple"))


@plan("insert_single_orders", f"""
SELECT o_orderkey, {duck_insert('orders', TABLE_COLUMNS['orders'])} AS stmt FROM orders
""")
def insert_single_orders(spark, sf_dir):
    return insert_single(read(spark, sf_dir, "orders"), "orders", keep=["o_orderkey"])


@plan("insert_single_documents", f"""
SELECT doc_id, {duck_insert('documents', TABLE_COLUMNS['documents'])} AS stmt FROM documents
""")
def insert_single_documents(spark, sf_dir):
    return insert_single(read(spark, sf_dir, "documents"), "documents", keep=["doc_id"])


# --- D3 ---------------------------------------------------------------------------------------

EXT_MAX_PACKET = 16384


def _duck_extended(table: str, key: list[str], max_packet: int) -> str:
    return f"""
SELECT CAST(0 AS BIGINT) AS chunk, CAST(seq AS BIGINT) AS seq, stmt, CAST(n AS BIGINT) AS n_rows,
       CAST(strlen(stmt) AS BIGINT) AS n_bytes
FROM ({duck_packed_whole(table, key, max_packet)})
"""


# lineitem has no unique key, so the dump order is the whole row: ties are identical rows
LINEITEM_ORDER = [c for c, _ in TABLE_COLUMNS["lineitem"]]


@plan("insert_extended_lineitem",
      _duck_extended("lineitem", LINEITEM_ORDER, EXT_MAX_PACKET))
def insert_extended_lineitem(spark, sf_dir):
    return insert_extended(read(spark, sf_dir, "lineitem"), "lineitem", key=LINEITEM_ORDER,
                           max_packet=EXT_MAX_PACKET)


# --- F4, N1-N4, P1-P7: retention over a listing derived from events ----------------------------
#
# One backup name per event: target = event_type, time = ts. Odd user ids use the safe ':' -> '-'
# form; 'error' targets use a custom pattern, which retention must ignore. Names made at second
# precision collide, so the listing is deduplicated on (target, filename).

CUSTOM_PATTERN = "backup-{{ .year }}{{ .month }}{{ .day }}-{{ .hour }}{{ .minute }}{{ .second }}.{{ .compression }}"
PRUNE_NOW = "2024-01-31 00:00:00"
AGE_HOURS = 24 * 14
KEEP_COUNT = 25
# (target, retention) per event type
POLICIES = [("view", "36h"), ("click", "2w"), ("purchase", "50c"), ("signup", "1m"), ("error", "10c")]


def events_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read(spark, sf_dir, "events")
    safe = (F.col("user_id") % 2) == 1
    default = backup_name("ts", "tgz", safe=safe)
    custom = backup_name("ts", "tgz", pattern=CUSTOM_PATTERN)
    name = F.when(F.col("event_type") == "error", custom).otherwise(default)
    return ev.select(F.col("event_type").alias("target"), name.alias("filename")).dropDuplicates()


_DUCK_LISTING = """
listing AS (
  SELECT DISTINCT event_type AS target,
    CASE WHEN event_type = 'error'
         THEN 'backup-' || strftime(ts, '%Y%m%d-%H%M%S') || '.tgz'
         WHEN user_id % 2 = 1 THEN 'db_backup_' || strftime(ts, '%Y-%m-%dT%H-%M-%SZ') || '.tgz'
         ELSE 'db_backup_' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '.tgz' END AS filename
  FROM events
), classified AS (
  SELECT target, filename,
    CASE WHEN regexp_matches(filename, '^db_backup_\\d{4}-\\d{2}-\\d{2}T\\d{2}[:-]\\d{2}[:-]\\d{2}(Z|[\\-\\+]\\d{2}[:-]\\d{2})\\.\\w+$')
         THEN try_strptime(regexp_replace(substr(filename, 11, 19), '[:-]', '', 'g'), '%Y%m%dT%H%M%S') END AS filetime,
    CASE WHEN NOT regexp_matches(filename, '^db_backup_\\d{4}-\\d{2}-\\d{2}T\\d{2}[:-]\\d{2}[:-]\\d{2}(Z|[\\-\\+]\\d{2}[:-]\\d{2})\\.\\w+$')
         THEN 'ignored' ELSE 'matched' END AS status
  FROM listing
)"""


def _classified(spark, sf_dir):
    return classify_names(events_listing(spark, sf_dir))


@plan("classify_backups", f"WITH {_DUCK_LISTING} SELECT target, filename, filetime, status FROM classified")
def classify_backups(spark, sf_dir):
    return _classified(spark, sf_dir).select("target", "filename", "filetime", "status")


@plan("prune_age", f"""WITH {_DUCK_LISTING}
SELECT target, filename, filetime FROM classified
WHERE status = 'matched' AND filetime <= TIMESTAMP '{PRUNE_NOW}' - INTERVAL {AGE_HOURS} HOUR""")
def prune_age(spark, sf_dir):
    return prune_by_age(_classified(spark, sf_dir), AGE_HOURS, PRUNE_NOW).select(
        "target", "filename", "filetime")


@plan("prune_count", f"""WITH {_DUCK_LISTING}, ranked AS (
  SELECT target, filename, filetime,
         row_number() OVER (PARTITION BY target ORDER BY filetime DESC, filename DESC) AS rn
  FROM classified WHERE status = 'matched')
SELECT target, filename, filetime FROM ranked WHERE rn > {KEEP_COUNT}""")
def prune_count(spark, sf_dir):
    return prune_by_count(_classified(spark, sf_dir), KEEP_COUNT).select(
        "target", "filename", "filetime")


# Fixed values, stated for the expected side on its own: hours in a retention unit.
EXPECTED_HOURS = {"h": 1, "d": 24, "w": 168, "m": 720, "y": 8760}


def _duck_policies() -> str:
    rows = ", ".join(f"('{t}', '{r}')" for t, r in POLICIES)
    hours = " ".join(f"WHEN retention LIKE '%{u}' THEN {h}" for u, h in EXPECTED_HOURS.items())
    return f"""policies AS (
  SELECT target, retention,
    CASE WHEN regexp_matches(retention, '^\\d+[hdwmy]$')
         THEN CAST(regexp_extract(retention, '^(\\d+)', 1) AS BIGINT) * (CASE {hours} END) END AS hours,
    CASE WHEN regexp_matches(retention, '^\\d+c$')
         THEN CAST(regexp_extract(retention, '^(\\d+)', 1) AS BIGINT) END AS cnt
  FROM (VALUES {rows}) p(target, retention)
), judged AS (
  SELECT c.target, c.filename, c.filetime, p.hours, p.cnt,
         row_number() OVER (PARTITION BY c.target ORDER BY c.filetime DESC, c.filename DESC) AS rn
  FROM classified c JOIN policies p USING (target) WHERE c.status = 'matched'
), candidates AS (
  SELECT target, filename, filetime, 'age' AS rule FROM judged
  WHERE hours > 0 AND filetime <= TIMESTAMP '{PRUNE_NOW}' - hours * INTERVAL 1 HOUR
  UNION ALL
  SELECT target, filename, filetime, 'count' AS rule FROM judged
  WHERE coalesce(hours, 0) <= 0 AND cnt > 0 AND rn > cnt
)"""


def _policies_df(spark):
    return spark.createDataFrame(POLICIES, "target string, retention string")


@plan("prune_policies", f"WITH {_DUCK_LISTING}, {_duck_policies()} SELECT * FROM candidates")
def prune_policies(spark, sf_dir):
    return prune(events_listing(spark, sf_dir), _policies_df(spark), PRUNE_NOW).select(
        "target", "filename", "filetime", "rule")


@plan("prune_report", f"""WITH {_DUCK_LISTING}, {_duck_policies()},
per_status AS (
  SELECT target, count(*) AS n_files, count(*) FILTER (WHERE status = 'matched') AS n_matched,
         count(*) FILTER (WHERE status = 'ignored') AS n_ignored,
         count(*) FILTER (WHERE status = 'invalid_date') AS n_invalid_date
  FROM classified GROUP BY target
), pruned AS (SELECT target, count(*) AS n_pruned FROM candidates GROUP BY target)
SELECT s.target, s.n_files, s.n_matched, s.n_ignored, s.n_invalid_date,
       coalesce(p.n_pruned, 0) AS n_pruned, s.n_matched - coalesce(p.n_pruned, 0) AS n_kept
FROM per_status s LEFT JOIN pruned p USING (target)""")
def prune_report_events(spark, sf_dir):
    listing = events_listing(spark, sf_dir)
    cands = prune(listing, _policies_df(spark), PRUNE_NOW)
    return prune_report(listing, cands)


# --- S1-S4, F1-F3: the table set of the driver data -----------------------------------------------

def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(db, table, n_rows) for every table of the test table set (Parquet counts)."""
    ts = parquet_tableset(spark, sf_dir)
    rows = [ts.read(db, t).select(F.lit(db).alias("db"), F.lit(t).alias("table"))
            for (db, t) in ts.readers]
    return union_all(rows).groupBy("db", "table").agg(F.count(F.lit(1)).alias("n_rows"))


def _duck_inventory() -> str:
    parts = [f"SELECT '{db}' AS db, '{t}' AS \"table\", count(*) AS n_rows FROM {t}"
             for db, names in TESTDATA_LAYOUT.items() for t in names]
    return "inventory AS (" + " UNION ALL ".join(parts) + ")"


EXCLUDE_DBS = ["corpus", "nosuchdb"]
IGNORE_RULES = ["labels", "web.pages", "sales.events", "orders"]


@plan("select_databases", f"WITH {_duck_inventory()} SELECT db, \"table\", n_rows FROM inventory "
      f"WHERE db NOT IN ('corpus')")
def select_databases_q(spark, sf_dir):
    inv = inventory(spark, sf_dir)
    dbs = select_databases(spark, databases(parquet_tableset(spark, sf_dir)), exclude=EXCLUDE_DBS)
    return inv.join(broadcast_if_small(dbs.select("db")), "db", "left_semi").select("db", "table", "n_rows")


@plan("ignore_tables", f"WITH {_duck_inventory()} SELECT db, \"table\", n_rows FROM inventory "
      f"WHERE \"table\" NOT IN ('labels', 'orders') AND NOT (db = 'web' AND \"table\" = 'pages')")
def ignore_tables_q(spark, sf_dir):
    return ignore_tables(inventory(spark, sf_dir), ignore_rules_frame(spark, IGNORE_RULES))


LINEITEM_EXTRAS = {"l_tax": "STORED GENERATED", "l_discount": "VIRTUAL GENERATED",
                   "l_shipdate": "DEFAULT_GENERATED", "l_linenumber": "auto_increment"}


@plan("project_columns", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, "
      "l_extendedprice, l_returnflag, l_linestatus, l_shipdate FROM lineitem")
def project_columns_q(spark, sf_dir):
    ts = parquet_tableset(spark, sf_dir)
    for col, extra in LINEITEM_EXTRAS.items():
        ts.mark_column("sales", "lineitem", col, extra)
    meta = [(r["pos"], r["name"], r["extra"]) for r in
            kept_columns(columns(ts).where(F.col("table") == "lineitem")).collect()]
    return project_columns(scan(ts, "sales", "lineitem"), meta)


# --- N1-N3, N5, N6, F5, N9 -------------------------------------------------------------------------

@plan("backup_names", """
SELECT event_id,
  'db_backup_' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '.tgz' AS name_default,
  'db_backup_' || strftime(ts, '%Y-%m-%dT%H-%M-%SZ') || '.tbz2' AS name_safe,
  event_type || '/' || strftime(ts, '%Y/%m/%d/%H%M%S') || '.tar' AS name_custom,
  'x-<no value>-' || strftime(ts, '%Y') AS name_unknown_key,
  replace('db_backup_' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '.tgz', ':', '-') AS name_smb
FROM events""")
def backup_names(spark, sf_dir):
    ev = read(spark, sf_dir, "events")
    return ev.select(
        "event_id",
        backup_name("ts", extension(F.lit("gzip"))).alias("name_default"),
        backup_name("ts", extension(F.lit("bzip2")), safe=True).alias("name_safe"),
        F.concat(F.col("event_type"), F.lit("/"),
                 backup_name("ts", "tar", pattern="{{ .year }}/{{ .month }}/{{ .day }}/{{ .hour }}"
                             "{{ .minute }}{{ .second }}.{{ .compression }}")).alias("name_custom"),
        backup_name("ts", "tgz", pattern="x-{{ .Sequence }}-{{ .year }}").alias("name_unknown_key"),
        safe_name(backup_name("ts", "tgz")).alias("name_smb"),
    )


@plan("target_identity", """
WITH per_user AS (
  SELECT user_id, list_sort(list(DISTINCT event_type)) AS dbs FROM events GROUP BY user_id
)
SELECT user_id, to_json(dbs)::VARCHAR AS databases, CAST(len(dbs) AS INTEGER) AS database_count,
  CASE WHEN len(dbs) < 5 THEN 'include' ELSE 'all' END AS mode,
  CASE WHEN len(dbs) < 5 THEN 'mysql:include:server-' || user_id || ':' || array_to_string(dbs, ':')
       ELSE 'mysql:all:server-' || user_id END AS identity
FROM per_user""")
def target_identity_q(spark, sf_dir):
    ev = read(spark, sf_dir, "events")
    sets = database_set(ev, "user_id", db="event_type")
    dbs = F.from_json("databases", "array<string>")
    include = F.when(F.col("database_count") < 5, dbs).otherwise(F.array().cast("array<string>"))
    exclude = F.array().cast("array<string>")
    mode = selection_mode(include, exclude)
    native = F.concat(F.lit("server-"), F.col("user_id").cast("string"))
    return sets.select("user_id", "databases", "database_count", mode.alias("mode"),
                       target_identity(mode, native, include).alias("identity"))


# A fleet inventory derived from the corpus: every document is a server whose version and comment
# come from its language and source; the labels give it the Aria engine (quality) or a Percona
# plugin (toxic).
@plan("server_variant", """
WITH servers AS (
  SELECT doc_id AS server,
    CASE WHEN lang = 'de' THEN '10.11.6-MariaDB' ELSE '8.0.' || length(source) END AS version,
    CASE WHEN lang = 'fr' THEN 'Percona Server (GPL)' WHEN lang = 'es' THEN 'MySQL Community Server'
         ELSE 'source ' || source END AS comment
  FROM documents
), engines AS (SELECT doc_id AS server FROM labels WHERE quality = 1),
plugins AS (SELECT doc_id AS server FROM labels WHERE toxic = 1)
SELECT s.server, s.version, s.comment,
  CASE WHEN lower(s.version) LIKE '%mariadb%' OR lower(s.comment) LIKE '%mariadb%' THEN 'mariadb'
       WHEN lower(s.comment) LIKE '%percona%' THEN 'percona'
       WHEN lower(s.comment) LIKE '%mysql%' THEN 'mysql'
       WHEN s.server IN (SELECT server FROM engines) THEN 'mariadb'
       WHEN s.server IN (SELECT server FROM plugins) THEN 'percona'
       ELSE 'mysql' END AS variant
FROM servers s""")
def server_variant_q(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    labels = read(spark, sf_dir, "labels")
    servers = docs.select(
        F.col("doc_id").alias("server"),
        F.when(F.col("lang") == "de", F.lit("10.11.6-MariaDB"))
        .otherwise(F.concat(F.lit("8.0."), F.length("source").cast("string"))).alias("version"),
        F.when(F.col("lang") == "fr", F.lit("Percona Server (GPL)"))
        .when(F.col("lang") == "es", F.lit("MySQL Community Server"))
        .otherwise(F.concat(F.lit("source "), F.col("source"))).alias("comment"))
    engines = labels.where(F.col("quality") == 1).select(F.col("doc_id").alias("server"),
                                                         F.lit("Aria").alias("engine"))
    plugins = labels.where(F.col("toxic") == 1).select(F.col("doc_id").alias("server"),
                                                       F.lit("percona_audit").alias("plugin_name"))
    return server_variant(servers, engines, plugins)


# --- R1-R4, N7, W1, S6: restore ---------------------------------------------------------------------

REMAP = "web:web_restored,corpus:corpus_copy"
WEB_TABLES = ["events", "pages", "conversations"]


def _create_use(db: str) -> list[str]:
    return [f"CREATE DATABASE /*!32312 IF NOT EXISTS*/ `{db}` /*!40100 DEFAULT CHARACTER SET utf8mb4 "
            f"COLLATE utf8mb4_0900_ai_ci */ /*!80016 DEFAULT ENCRYPTION='N' */;", f"USE `{db}`;"]


def _duck_remap() -> str:
    consts = " UNION ALL ".join(f"SELECT '{x.replace(chr(39), chr(39) * 2)}' AS stmt"
                                for x in _create_use("web_restored"))
    inserts = " UNION ALL ".join(f"SELECT {duck_insert(t, TABLE_COLUMNS[t])} AS stmt FROM {t}"
                                 for t in WEB_TABLES)
    return f"{consts} UNION ALL {inserts}"


@plan("restore_remap", _duck_remap())
def restore_remap(spark, sf_dir):
    head = spark.createDataFrame([(x,) for x in _create_use("web")], "stmt string")
    body = union_all([insert_single(read(spark, sf_dir, t), t) for t in WEB_TABLES])
    return remap_databases(head.unionByName(body), mapping_frame(spark, REMAP)).select("stmt")


def _roundtrip(spark, sf_dir, table, key, max_packet):
    df = read(spark, sf_dir, table)
    stmts = insert_extended(df, table, key=key, max_packet=max_packet, mode=EXACT)
    return load_inserts(stmts, table, df.schema)


@plan("roundtrip_documents", "SELECT * FROM documents")
def roundtrip_documents(spark, sf_dir):
    return _roundtrip(spark, sf_dir, "documents", ["doc_id"], 65536)


@plan("roundtrip_orders", "SELECT * FROM orders")
def roundtrip_orders(spark, sf_dir):
    """Dump ``orders`` to gzip files in the shared folder, read the files back, load the rows."""
    ts = parquet_tableset(spark, sf_dir, layout={"sales": ["orders"]})
    out = f"{ensure_checkpoint_dir(spark).rstrip('/')}/roundtrip-{uuid.uuid4().hex}"
    opts = DumpOptions(max_allowed_packet=65536, mode=EXACT)
    write_dump(dump(ts, ["sales"], opts), out, compression="gzip")
    stmts = read_scripts(spark, out).where(F.col("stmt").startswith("INSERT INTO"))
    return load_inserts(stmts, "orders", read(spark, sf_dir, "orders").schema)


# Text that looks like the grammar of a script, by document; every sixth text is null, and a binary column holds
# bytes that are no UTF-8.
HOSTILE = [" VALUES (1,'x');", "'\"\\\r\n\0\x1a it''s", "\nDELIMITER ;;\n", "INSERT INTO `documents` (`doc_id`) VALUES (7);", None,
           "`), (`/* -- # "]


def _duck_text(text: str) -> str:
    return " || ".join(f"chr({ord(c)})" for c in text)


@plan("roundtrip_hostile", f"""
SELECT doc_id, CASE doc_id % 6 {' '.join(f"WHEN {i} THEN {'NULL' if t is None else f'text || {_duck_text(t)}'}" for i, t in enumerate(HOSTILE))}
  END AS text, upper(hex(doc_id::VARCHAR)) || 'FF00275C0A' AS bytes, form
FROM documents, (VALUES ('full'), ('compact')) f(form)""")
def roundtrip_hostile(spark, sf_dir):
    """Documents with hostile text, dumped full and compact with a trigger that inserts into the table, written
    as files, read back and loaded."""
    docs = read(spark, sf_dir, "documents")
    texts = F.array(*[F.lit(t) for t in HOSTILE])
    hostile = docs.select("doc_id", F.concat("text", texts[F.pmod("doc_id", F.lit(6)).cast("int")]).alias("text"),
                          F.concat(F.col("doc_id").cast("string").cast("binary"), F.unhex(F.lit("FF00275C0A"))).alias("bytes"))
    triggers = spark.createDataFrame(
        [("corpus", "documents", "t", "INSERT", "AFTER", "BEGIN\nINSERT INTO `documents` (`doc_id`) VALUES (-1);\nEND", "root@%")],
        "db string, table string, name string, event string, timing string, statement string, definer string")
    out = []
    for form in ("full", "compact"):
        ts = TableSet(spark).add_table("corpus", "documents", hostile, ["doc_id"])
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/hostile-{uuid.uuid4().hex}"
        opts = DumpOptions(compact=form == "compact", max_allowed_packet=65536, mode=EXACT)
        write_dump(dump(ts, ["corpus"], opts, programs=Programs(triggers=triggers)), path)
        back = load_scripts(read_scripts(spark, path), {"documents": hostile.schema})["documents"]
        out.append(back.select("doc_id", "text", F.hex("bytes").alias("bytes"), F.lit(form).alias("form")))
    return union_all(out)


@plan("restore_run_sales", """
SELECT 'orders' AS "table", o_orderkey AS k, o_orderstatus || '|' || o_orderpriority || '|' || CAST(o_orderdate AS VARCHAR) AS v
FROM orders
UNION ALL SELECT 'nation', n_nationkey, n_name FROM nation""")
def restore_run_sales(spark, sf_dir):
    """Dump two databases, then restore one of them under another name from the files alone."""
    ts = parquet_tableset(spark, sf_dir, layout={"sales": ["orders", "nation"], "web": ["events"]})
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/restore-{uuid.uuid4().hex}"
    write_dump(dump(ts, ["sales", "web"], DumpOptions(mode=EXACT)), f"{base}/dump")
    run_restore(spark, f"{base}/dump", f"{base}/out", include=["sales"], mapping={"sales": "sales_copy"})
    orders, nation = (spark.read.parquet(f"{base}/out/sales_copy/{t}") for t in ("orders", "nation"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    return (orders.select(F.lit("orders").alias("table"), F.col("o_orderkey").alias("k"),
                          F.concat_ws("|", "o_orderstatus", "o_orderpriority", day).alias("v"))
            .unionByName(nation.select(F.lit("nation").alias("table"), F.col("n_nationkey").cast("long").alias("k"),
                                       F.col("n_name").alias("v"))))


@plan("row_tuples_typed", """
SELECT o_orderkey, '(' || CASE WHEN o_orderkey % 7 = 0 THEN 'NULL' WHEN o_orderkey % 2 = 0 THEN '1' ELSE '0' END
  || ',' || CASE WHEN o_orderkey % 7 = 1 THEN 'NULL' ELSE chr(39) || CAST(CAST(o_orderkey AS DECIMAL(20,2)) AS VARCHAR) || chr(39) END
  || ',' || CASE WHEN o_orderkey % 7 = 2 THEN 'NULL' ELSE chr(39) || strftime(o_orderdate, '%Y-%m-%d') || chr(39) END
  || ',' || CASE WHEN o_orderkey % 7 = 3 THEN 'NULL' ELSE 'X' || chr(39) || upper(hex(o_orderpriority)) || chr(39) END
  || ',' || CASE WHEN o_orderkey % 7 = 4 THEN 'NULL' ELSE chr(39) || '[' || o_custkey || ',' || o_orderkey || ']' || chr(39) END
  || ',' || CASE WHEN o_orderkey % 7 = 5 THEN 'NULL' ELSE chr(39) || 'a' || chr(92) || chr(39) || chr(92) || chr(34) || chr(92) || chr(92)
            || chr(92) || 'n' || chr(92) || 'r' || chr(92) || '0' || chr(92) || 'Z' || chr(92) || 'b' || chr(39) END
  || ',' || printf('%.6f', (o_orderkey % 4096 + 0.5) / 64) || ')' AS tuple
FROM orders""")
def row_tuples_typed(spark, sf_dir):
    """Literals of every other type: bool, decimal, date, binary, JSON, all escapes, halves of the sixth decimal; nulls in turn."""
    k = F.col("o_orderkey")
    unless = lambda i, c: F.when(k % 7 != i, c)
    df = read(spark, sf_dir, "orders").select(
        "o_orderkey", unless(0, k % 2 == 0).alias("b"), unless(1, k.cast("decimal(20,2)")).alias("d"),
        unless(2, F.col("o_orderdate").cast("date")).alias("day"), unless(3, F.encode("o_orderpriority", "UTF-8")).alias("bin"),
        unless(4, F.array("o_custkey", "o_orderkey")).alias("j"),
        unless(5, F.lit("a'\"\\\n\r\0\x1a\b")).alias("s"), ((k % 4096 + 0.5) / 64).cast("double").alias("f"))
    return df.select("o_orderkey", row_tuple(df, ["b", "d", "day", "bin", "j", "s", "f"]).alias("tuple"))


# --- A1-A4 -----------------------------------------------------------------------------------------

SALES = TESTDATA_LAYOUT["sales"]


def _duck_dump_report() -> str:
    parts = []
    for t in SALES:
        ins = duck_insert(t, TABLE_COLUMNS[t])
        parts.append(f"SELECT 'sales' AS db, '{t}' AS \"table\", count(*) AS n_statements, "
                     f"CAST(sum(strlen({ins}) + 1) AS BIGINT) AS n_bytes, max(strlen({ins})) AS max_statement_bytes FROM {t}")
    return " UNION ALL ".join(parts)


@plan("dump_report_sales", _duck_dump_report())
def dump_report_sales(spark, sf_dir):
    ts = parquet_tableset(spark, sf_dir)
    script = dump(ts, ["sales"], DumpOptions(skip_extended_insert=True))
    return dump_report(script)


@plan("verify_snapshot", f"""
WITH a AS (SELECT {duck_insert('orders', TABLE_COLUMNS['orders'])} AS value FROM orders),
b AS (SELECT {duck_insert('orders', TABLE_COLUMNS['orders'])} AS value FROM orders
      WHERE o_orderstatus <> 'P')
SELECT 'a' AS side, value FROM (SELECT value FROM a EXCEPT ALL SELECT value FROM b)
UNION ALL
SELECT 'b' AS side, value FROM (SELECT value FROM b EXCEPT ALL SELECT value FROM a)""")
def verify_snapshot_q(spark, sf_dir):
    """Yesterday's dump of orders against today's, where the 'P' orders are gone and the
    volatile lines (banner, completion time) differ."""
    orders = read(spark, sf_dir, "orders")
    a = insert_single(orders, "orders").select(F.col("stmt").alias("value"))
    b = insert_single(orders.where(F.col("o_orderstatus") != "P"), "orders").select(F.col("stmt").alias("value"))
    va = spark.createDataFrame([("-- tablevault SQL dump 0.1.0",), ("-- Dump completed on 2024-01-01 00:00:00",),
                                ("",)], "value string")
    vb = spark.createDataFrame([("-- tablevault SQL dump 0.1.0",), ("-- Dump completed on 2024-01-02 00:00:00",)],
                               "value string")
    return verify_snapshot(a.unionByName(va), b.unionByName(vb))


SCHEDULE_BEGIN = "2024-01-01 00:00:00"
SCHEDULE_END = "2024-01-31 00:00:00"
SCHEDULE_MINUTES = {"view": 60, "click": 60, "purchase": 45, "signup": 90, "error": 120}


def _schedules(spark):
    return spark.createDataFrame(
        [(t, f) for t, f in SCHEDULE_MINUTES.items()], "target string, frequency int").select(
        "target", F.lit(SCHEDULE_BEGIN).cast("timestamp_ntz").alias("begin"),
        F.lit(SCHEDULE_END).cast("timestamp_ntz").alias("end"), "frequency")


def _duck_missed() -> str:
    rows = ", ".join(f"('{t}', {f})" for t, f in SCHEDULE_MINUTES.items())
    return f"""
WITH s AS (SELECT * FROM (VALUES {rows}) v(target, frequency)),
ticks AS (
  SELECT s.target, s.frequency, t.tick_no FROM s,
  LATERAL (SELECT generate_series AS tick_no FROM generate_series(0,
     CAST(ceil(date_diff('minute', TIMESTAMP '{SCHEDULE_BEGIN}', TIMESTAMP '{SCHEDULE_END}') / s.frequency) AS BIGINT) - 1)) t
), hit AS (
  SELECT DISTINCT e.event_type AS target,
    CAST(floor(epoch_us(e.ts - TIMESTAMP '{SCHEDULE_BEGIN}') / (s.frequency * 60000000.0)) AS BIGINT) AS tick_no
  FROM events e JOIN s ON s.target = e.event_type
  WHERE e.ts >= TIMESTAMP '{SCHEDULE_BEGIN}' AND e.ts < TIMESTAMP '{SCHEDULE_END}'
)
SELECT target, CAST(tick_no AS BIGINT) AS tick_no,
  TIMESTAMP '{SCHEDULE_BEGIN}' + tick_no * frequency * INTERVAL 1 MINUTE AS tick
FROM ticks t WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.target = t.target AND h.tick_no = t.tick_no)"""


@plan("missed_runs", _duck_missed())
def missed_runs_q(spark, sf_dir):
    runs = read(spark, sf_dir, "events").select(F.col("event_type").alias("target"), "ts")
    return missed_runs(_schedules(spark), runs)


BEGIN_OPTIONS = {"view": "+15", "click": "1023", "purchase": "2359", "signup": "0959", "error": "2401"}


def _duck_first_run() -> str:
    rows = ", ".join(f"('{t}', '{b}')" for t, b in BEGIN_OPTIONS.items())
    return f"""
WITH o AS (SELECT * FROM (VALUES {rows}) v(event_type, begin_opt)),
j AS (
  SELECT e.event_id, e.ts, o.begin_opt,
    date_trunc('day', e.ts) + to_minutes(CAST(substr(o.begin_opt, 1, 2) AS BIGINT) * 60
      + CAST(substr(o.begin_opt, 3, 2) AS BIGINT)) + (e.ts - date_trunc('minute', e.ts)) AS today
  FROM events e JOIN o USING (event_type)
)
SELECT event_id, begin_opt,
  CASE WHEN begin_opt LIKE '+%' THEN ts + to_minutes(CAST(substr(begin_opt, 2) AS BIGINT))
       WHEN today > ts THEN today ELSE today + INTERVAL 1 DAY END AS first_run
FROM j"""


@plan("first_run", _duck_first_run())
def first_run_q(spark, sf_dir):
    opts = spark.createDataFrame(list(BEGIN_OPTIONS.items()), "event_type string, begin_opt string")
    ev = read(spark, sf_dir, "events").join(broadcast_known(opts, len(BEGIN_OPTIONS)), "event_type")
    return ev.select("event_id", check_begin("begin_opt").alias("begin_opt"),
                     first_run("begin_opt", "ts").alias("first_run"))


# --- W4 -------------------------------------------------------------------------------------------

# A fixed test key (32 bytes, base64); real keys come from the caller.
TEST_KEY = base64.b64encode(bytes(range(32))).decode()


@plan("encrypt_roundtrip", f"SELECT doc_id, {duck_insert('documents', TABLE_COLUMNS['documents'])} AS stmt FROM documents")
def encrypt_roundtrip(spark, sf_dir):
    enc = insert_single(read(spark, sf_dir, "documents"), "documents", keep=["doc_id"]).select(
        "doc_id", encrypt_column("stmt", TEST_KEY).alias("cipher"))
    return enc.select("doc_id", decrypt_column("cipher", TEST_KEY).alias("stmt"))


# --- D4-D12: whole scripts (rows-only check) -------------------------------------------------------

# Fixed values, stated for the expected side on its own: the settings at the top and end of a full script.
EXPECTED_HEADER = """/*!40101 SET @OLD_CHARACTER_SET_CLIENT=@@CHARACTER_SET_CLIENT */;
/*!40101 SET @OLD_CHARACTER_SET_RESULTS=@@CHARACTER_SET_RESULTS */;
/*!40101 SET @OLD_COLLATION_CONNECTION=@@COLLATION_CONNECTION */;
/*!50503 SET NAMES utf8mb4 */;
/*!40103 SET @OLD_TIME_ZONE=@@TIME_ZONE */;
/*!40103 SET TIME_ZONE='+00:00' */;
/*!40014 SET @OLD_UNIQUE_CHECKS=@@UNIQUE_CHECKS, UNIQUE_CHECKS=0 */;
/*!40014 SET @OLD_FOREIGN_KEY_CHECKS=@@FOREIGN_KEY_CHECKS, FOREIGN_KEY_CHECKS=0 */;
/*!40101 SET @OLD_SQL_MODE=@@SQL_MODE, SQL_MODE='NO_AUTO_VALUE_ON_ZERO' */;
/*!40111 SET @OLD_SQL_NOTES=@@SQL_NOTES, SQL_NOTES=0 */;"""
EXPECTED_FOOTER = """/*!40103 SET TIME_ZONE=@OLD_TIME_ZONE */;

/*!40101 SET SQL_MODE=@OLD_SQL_MODE */;
/*!40014 SET FOREIGN_KEY_CHECKS=@OLD_FOREIGN_KEY_CHECKS */;
/*!40014 SET UNIQUE_CHECKS=@OLD_UNIQUE_CHECKS */;
/*!40101 SET CHARACTER_SET_CLIENT=@OLD_CHARACTER_SET_CLIENT */;
/*!40101 SET CHARACTER_SET_RESULTS=@OLD_CHARACTER_SET_RESULTS */;
/*!40101 SET COLLATION_CONNECTION=@OLD_COLLATION_CONNECTION */;
/*!40111 SET SQL_NOTES=@OLD_SQL_NOTES */;"""

SCRIPT_PACKET = 1048576
SCRIPT_DONE = "2024-01-01 00:00:00"


EXPECTED_PRIMARY = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"],
                    "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"], "lineitem": []}


def _duck_script_sales() -> str:
    """The whole full-mode script of ``sales``: header, per table DDL / packed rows / unlock, footer.
    """
    head = ("-- tablevault SQL dump 0.1.0\n--\n-- Host: spark    Database: sales\n"
            "-- ------------------------------------------------------\n-- Server version\ttablevault 0.1.0\n\n"
            + EXPECTED_HEADER
            + "\n\n--\n-- Current Database: `sales`\n--\n\nCREATE DATABASE /*!32312 IF NOT EXISTS*/ `sales` "
            "/*!40100 DEFAULT CHARACTER SET utf8mb4 COLLATE utf8mb4_0900_ai_ci */ "
            "/*!80016 DEFAULT ENCRYPTION='N' */;\n\nUSE `sales`;")
    foot = EXPECTED_FOOTER + f"\n\n-- Dump completed on {SCRIPT_DONE}"
    out = ["SELECT 'sales' AS db, 0 AS section, '' AS table_key, 0 AS part, CAST(0 AS BIGINT) AS chunk, "
           f"CAST(0 AS BIGINT) AS seq, {_sq(head)} AS value",
           "SELECT 'sales', 3, '', 0, 0, 0, " + _sq(chr(10) + "--" + chr(10) + "-- Dumping routines for database 'sales'"
                                                    + chr(10) + "--"),
           f"SELECT 'sales', 5, '', 0, 0, 0, {_sq(foot)}"]
    for t in SALES:
        out.append(f"SELECT 'sales', 1, '{t}', 0, 0, 0, {duck_table_pre(t, EXPECTED_PRIMARY[t])}")
        out.append(f"SELECT 'sales', 1, '{t}', 1, 0, seq, stmt FROM ({duck_packed_whole(t, TESTDATA_KEYS[t], SCRIPT_PACKET)})")
        out.append(f"SELECT 'sales', 1, '{t}', 2, 0, 0, "
                   f"{_sq(f'/*!40000 ALTER TABLE `{t}` ENABLE KEYS */;' + chr(10) + 'UNLOCK TABLES;')}")
    return "\nUNION ALL\n".join(out)


@plan("script_sales", _duck_script_sales())
def script_sales(spark, sf_dir):
    ts = parquet_tableset(spark, sf_dir)
    opts = DumpOptions(max_allowed_packet=SCRIPT_PACKET, completed_at=SCRIPT_DONE)
    return dump(ts, ["sales"], opts).drop("n_rows")


# --- A5: streaming dump ------------------------------------------------------------------------------

@plan("stream_dump_events", f"SELECT {duck_insert('events', TABLE_COLUMNS['events'])} AS stmt FROM events")
def stream_dump_events(spark, sf_dir):
    """Run the continuous dump once over the events file, then read what the batches wrote."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    schema = read(spark, sf_dir, "events").schema
    src = file_stream(spark, sf_dir, schema, file_glob="events.parquet")
    q = dump_stream(src, "events", f"{base}/out", f"{base}/state", once=True)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return spark.read.text(f"{base}/out").select(F.col("value").alias("stmt"))


# the plans of restore and of whole runs register themselves with this module's PLANS and ORACLES
from tablevault.plans import restore_checks, run_checks  # noqa: E402, F401
