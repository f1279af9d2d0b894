"""Sinks: write dumps (W1-W3), encrypt them (W4), delete old backups (W5), restore tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablevault.plans.script import assemble
from tablevault.sinks.manifest import write_manifest

# Compression names the writer accepts and the Hadoop codec each one selects.
CODECS = {"gzip": "gzip", "bzip2": "bzip2", "none": "none"}

UPLOAD_SCHEMA = "target string, path string, start timestamp, end timestamp, files long, bytes long"


def codec(name: str) -> str:
    """Compression by name; an unknown name is an error, as in the reference."""
    if name not in CODECS:
        raise ValueError(f"unknown compression format: {name}")
    return CODECS[name]


def write_dump(script: DataFrame, path: str, compression: str = "gzip", num_partitions: int | None = None,
               mode: str = "errorifexists", manifest: bool = False) -> None:
    """W1 + W2: one ``db=<name>`` directory per database; sorted part names give the script.

    The rows are range-partitioned and sorted on the script order first; the writer then only
    splits each sorted partition by ``db`` (it needs no sort of its own, so the order stays). With ``manifest`` the sorted
    rows are checkpointed, and an index of the part files is written last (:mod:`manifest`).
    """
    ordered = assemble(script, num_partitions)
    if manifest:
        ordered = _numbered(ordered)
    _write_parts(ordered, path, compression, mode)
    if manifest:
        write_manifest(ordered, path)


def _numbered(ordered: DataFrame) -> DataFrame:
    """An assembled script whose partitions are fixed, with the number of each row's partition and part file."""
    from tablevault.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(ordered.sparkSession)
    return ordered.withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True)


def _write_parts(ordered: DataFrame, path: str, compression: str, mode: str = "errorifexists") -> None:
    (ordered.select("db", "value").write.mode(mode).option("compression", codec(compression))
     .partitionBy("db").text(path))


def push(script: DataFrame, targets: list[str], compression: str = "gzip",
         num_partitions: int | None = None) -> DataFrame:
    """Write the same dump to each target in turn; the first failure stops the run.

    The sorted script is checkpointed once (``spark.checkpoint.dir``), so every target gets the
    same bytes without recomputing the dump; each gets its manifest. Returns one upload result per target.
    """
    import datetime as dt

    spark = script.sparkSession
    ordered = _numbered(assemble(script, num_partitions))
    results = []
    for target in targets:
        start = dt.datetime.now(dt.timezone.utc)
        _write_parts(ordered, target, compression)
        write_manifest(ordered, target)
        end = dt.datetime.now(dt.timezone.utc)
        files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
                 .option("pathGlobFilter", "part-*").load(target)
                 .agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes")).first())
        results.append((target, target, start, end, int(files["files"] or 0), int(files["bytes"] or 0)))
    return spark.createDataFrame(results, UPLOAD_SCHEMA)


# --- W4: AES-256-CBC per statement ------------------------------------------------------------------

def encrypt_column(c, key) -> Column:
    """AES-256-CBC with PKCS#7 padding and a random IV prepended, as base64 text.

    ``key`` is 32 raw bytes (given as a Column or a base64 string). One value per statement row,
    so nothing is buffered beyond a row. Encrypt *after* compressing if both are wanted.
    """
    k = _key(key)
    x = F.col(c) if isinstance(c, str) else c
    return F.base64(F.aes_encrypt(x.cast("binary"), k, F.lit("CBC"), F.lit("PKCS")))


def decrypt_column(c, key) -> Column:
    """W4 inverse: base64 text -> plaintext string (fails the job on a wrong key)."""
    k = _key(key)
    x = F.col(c) if isinstance(c, str) else c
    return F.aes_decrypt(F.unbase64(x), k, F.lit("CBC"), F.lit("PKCS")).cast("string")


def check_key(key_b64: str) -> None:
    """A key is 32 bytes; 16 or 24 would silently give a weaker cipher."""
    import base64

    if len(base64.b64decode(key_b64, validate=True)) != 32:
        raise ValueError("AES-256 needs a 32-byte key")


def _key(key) -> Column:
    """The key as a column, its length checked: a string before the job starts, a column in the rows."""
    if isinstance(key, str):
        check_key(key)
        return F.unbase64(F.lit(key))
    return F.when(F.octet_length(key) == 32, key).otherwise(F.raise_error(F.lit("AES-256 needs a 32-byte key")).cast("binary"))


# --- W5: delete prune candidates ---------------------------------------------------------------------

DELETE_SCHEMA = "target string, filename string, deleted boolean, error string"


def delete_backups(candidates: DataFrame, dry_run: bool = True) -> DataFrame:
    """Remove candidate files, in parallel tasks, through the pyarrow filesystem layer.

    ``candidates``: (target, filename). Default is a dry run, which only reports. Each task
    deletes its own share of the files; the driver never loops over them. The deletion runs here, once, and
    its result is checkpointed: reading the returned frame again deletes nothing. A file that is gone
    already (a task that ran again, a second call) counts as deleted.
    """
    from tablevault.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(candidates.sparkSession)

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        from tablevault.sources.listing import normalize_url

        cache: dict[str, tuple] = {}
        for pdf in batches:
            deleted, errors = [], []
            for target, name in zip(pdf["target"], pdf["filename"]):
                if dry_run:
                    deleted.append(False)
                    errors.append(None)
                    continue
                try:
                    if target not in cache:
                        cache[target] = fs.FileSystem.from_uri(normalize_url(target))
                    filesystem, root = cache[target]
                    full = root.rstrip("/") + "/" + name
                    kind = filesystem.get_file_info(full).type
                    if kind == fs.FileType.Directory:
                        filesystem.delete_dir(full)
                    elif kind != fs.FileType.NotFound:
                        filesystem.delete_file(full)
                    deleted.append(True)
                    errors.append(None)
                except Exception as exc:  # reported per file, the job goes on
                    deleted.append(False)
                    errors.append(str(exc))
            yield pd.DataFrame({"target": pdf["target"], "filename": pdf["filename"],
                                "deleted": deleted, "error": errors})

    return candidates.select("target", "filename").mapInPandas(remove, DELETE_SCHEMA).checkpoint(eager=True)


# --- W6 / R5: restore tables atomically ----------------------------------------------------------------

def remove_folder(spark, path: str) -> None:
    """Delete an intermediate folder of ours."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def restore_tables(tables: dict[str, DataFrame], dest: str, fmt: str = "parquet", parallel: int = 4) -> list[str]:
    """W6 + R5: write every table to a staging folder (``parallel`` jobs at a time), publish them only if all writes
    worked.

    Publishing moves each old table aside and the new one into ``dest/<table>`` through Hadoop's FileSystem.
    Old tables are removed only when all new ones stand; if a move fails, the old ones are moved back.
    A failed write leaves the destination untouched.
    """
    spark = next(iter(tables.values())).sparkSession
    stage = f"{dest.rstrip('/')}/_staging_{uuid.uuid4().hex}"
    with ThreadPoolExecutor(max_workers=max(1, min(parallel, len(tables)))) as pool:
        writes = [pool.submit(df.write.mode("errorifexists").format(fmt).save, f"{stage}/{name}") for name, df in tables.items()]
        for write in writes:
            write.result()
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    stage_path = jvm.org.apache.hadoop.fs.Path(stage)
    fs = stage_path.getFileSystem(conf)
    path = jvm.org.apache.hadoop.fs.Path
    old = path(f"{dest.rstrip('/')}/_replaced_{uuid.uuid4().hex}")
    fs.mkdirs(old)
    aside, published = [], []
    try:
        for name in tables:
            target = path(f"{dest.rstrip('/')}/{name}")
            if fs.exists(target):
                if not fs.rename(target, path(f"{old}/{name}")):
                    raise OSError(f"could not move {name} aside")
                aside.append(name)
            if not fs.rename(path(f"{stage}/{name}"), target):
                raise OSError(f"could not publish {name}")
            published.append(name)
    except BaseException:
        for name in published:
            fs.delete(path(f"{dest.rstrip('/')}/{name}"), True)
        for name in aside:
            fs.rename(path(f"{old}/{name}"), path(f"{dest.rstrip('/')}/{name}"))
        raise
    finally:
        fs.delete(stage_path, True)
    fs.delete(old, True)
    return published
