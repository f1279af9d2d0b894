"""The manifest of a dump: which part file holds which statements of which table.

It is written beside the parts (``<dump>/_manifest``, Parquet, last of all, so that it also says that the dump is whole).
A restore of one table opens that table's files alone; reports read it instead of the dump; ``verify_manifest`` holds it
against the files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablevault.plans.script import DATA, FOOTER, HEADER, POST, PRE, ROUTINES, TABLES, TRIGGERS, VIEW_STUBS, VIEWS

FOLDER = "_manifest"
#: ``file`` is relative to the dump; ``hash`` is the sum of the statements' 64-bit hashes modulo 2**64, in any order.
MANIFEST = ("db string, table string, kind string, file string, first_seq long, last_seq long, n_statements long,"
            " n_rows long, n_bytes long, hash decimal(20,0)")

# Fixed names of the parts of a script, by section and part of a table's section.
KINDS = {(HEADER, 0): "header", (TABLES, PRE): "table", (TABLES, DATA): "data", (TABLES, POST): "table_end",
         (TABLES, TRIGGERS): "trigger", (VIEW_STUBS, 0): "view_stub", (ROUTINES, 0): "routine", (ROUTINES, 1): "routine",
         (VIEWS, 0): "view", (FOOTER, 0): "footer"}


def _hash_sum(text: str) -> Column:
    """Order-free fingerprint of texts: their hashes summed modulo 2**64 (as an unsigned number)."""
    total = F.sum(F.xxhash64(text).cast("decimal(38,0)"))
    modulus = F.lit(str(2**64)).cast("decimal(38,0)")
    return F.pmod(total, modulus).cast("decimal(20,0)")


def _part_number(path: str) -> Column:
    return F.regexp_extract(path, r"/part-(\d+)-[^/]*$", 1).cast("int")


def part_files(spark: SparkSession, path: str) -> DataFrame:
    """(db, _pid, file, length) of a dump's part files, from a listing alone."""
    root = path.rstrip("/")
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*")
             .load(root).select("path", "length"))
    db = F.url_decode(F.regexp_extract("path", r"/db=([^/]+)/[^/]+$", 1))
    return files.select(db.alias("db"), _part_number("path").alias("_pid"),
                        F.regexp_extract("path", r"/(db=[^/]+/[^/]+)$", 1).alias("file"), "length")


def manifest_rows(ordered: DataFrame, files: DataFrame) -> DataFrame:
    """``MANIFEST`` rows of an assembled script with ``_pid``, the number of the part file that each row went to."""
    from tablevault.operators.audit import table_of_key

    kind = F.coalesce(*[F.when((F.col("section") == s) & (F.col("part") == p), F.lit(k)) for (s, p), k in KINDS.items()])
    named = ordered.select("db", "_pid", kind.alias("kind"), "table_key", "seq", "n_rows", "value")
    rows = named.groupBy("db", "_pid", "kind", "table_key").agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("n_statements"),
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), F.sum(F.octet_length("value") + F.lit(1).cast("long")).alias("n_bytes"),
        _hash_sum("value").alias("hash"))
    name = F.when(F.col("kind") == "routine", F.regexp_replace("table_key", "^[01]:", "")).otherwise(table_of_key("table_key"))
    return rows.join(files.select("db", "_pid", "file"), ["db", "_pid"]).select(
        "db", name.alias("table"), "kind", "file", "first_seq", "last_seq", "n_statements", "n_rows", "n_bytes", "hash")


def write_manifest(ordered: DataFrame, path: str) -> None:
    """Write the manifest of the dump that ``ordered`` (with ``_pid``) was written to."""
    spark = ordered.sparkSession
    rows = manifest_rows(ordered, part_files(spark, path))
    rows.repartitionByRange("db", "table", "kind", "first_seq").write.mode("errorifexists").parquet(f"{path.rstrip('/')}/{FOLDER}")


def has_manifest(spark: SparkSession, path: str) -> bool:
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{FOLDER}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{path.rstrip('/')}/{FOLDER}")


def files_of(spark: SparkSession, path: str, tables: list[tuple[str, str]] | None = None,
             dbs: list[str] | None = None) -> DataFrame:
    """(file) of the part files that hold data or DDL of the wanted tables (db, table) or databases."""
    rows = read_manifest(spark, path).where(F.col("kind").isin("table", "data"))
    if dbs is not None:
        rows = rows.where(F.col("db").isin(dbs))
    if tables is not None:
        wanted = spark.createDataFrame(tables, "db string, table string")
        rows = rows.join(wanted, ["db", "table"], "left_semi")
    return rows.select("file").distinct()


def manifest_report(spark: SparkSession, path: str) -> DataFrame:
    """A1 of a written dump: per database and table, files, statements, rows and bytes of its data."""
    rows = read_manifest(spark, path).where(F.col("kind") == "data")
    return rows.groupBy("db", "table").agg(
        F.countDistinct("file").alias("n_files"), F.sum("n_statements").alias("n_statements"), F.sum("n_rows").alias("n_rows"),
        F.sum("n_bytes").alias("n_bytes"))


def verify_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(db, table, file) where the files' INSERT statements are not what the manifest says; empty for a sound dump."""
    from tablevault.operators.restore import read_scripts, tag_statements

    root = path.rstrip("/")
    stmts = read_scripts(spark, root).withColumn("db", F.url_decode(F.regexp_extract("file", r"/db=([^/]+)/", 1)))
    found = tag_statements(stmts).where(F.col("kind") == "data").withColumn("file", F.regexp_extract("file", r"(db=[^/]+/[^/]+)$", 1))
    found = found.groupBy("db", F.col("tbl").alias("table"), "file").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("stmt") + F.lit(1).cast("long")).alias("bytes"), _hash_sum("stmt").alias("h"))
    said = read_manifest(spark, root).where(F.col("kind") == "data")
    both = said.join(found, ["db", "table", "file"], "full_outer")
    same = (F.col("n") == F.col("n_statements")) & (F.col("bytes") == F.col("n_bytes")) & (F.col("h") == F.col("hash"))
    return both.where(~F.coalesce(same, F.lit(False))).select("db", "table", "file")
