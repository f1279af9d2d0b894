"""R5 by versions: the tables of a restore appear together, at one moment, for every reader.

Each publication writes its tables to a folder of its own and then adds one empty file, whose name holds a running number
and that folder. Readers take the file of the highest number, so they see the old tables or the new ones, never some of
each, and what they have begun to read stays until ``keep`` later publications. A publication that fails has no such file.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

VERSIONS, COMMITS = "_versions", "_commits"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration())


def _commits(spark: SparkSession, dest: str) -> list[tuple[int, str]]:
    """(number, version) of the publications, oldest first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{dest}/{COMMITS}")
    fs = _fs(spark, dest)
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted((int(n.split(".")[0]), n.split(".")[1]) for n in names if n.count(".") == 1)


def publish_version(tables: dict[str, DataFrame], dest: str, fmt: str = "parquet", parallel: int = 4, keep: int = 2) -> str:
    """Write all tables as a new version of ``dest`` and make it the current one; returns its folder.

    Of two publications at once both are whole, and the one that readers then see is the same for all. Versions but the
    ``keep`` newest are removed.
    """
    if keep < 1:
        raise ValueError("the current version is always kept")
    dest = dest.rstrip("/")
    spark = next(iter(tables.values())).sparkSession
    path, fs = spark._jvm.org.apache.hadoop.fs.Path, _fs(spark, dest)
    version = uuid.uuid4().hex
    folder = f"{dest}/{VERSIONS}/{version}"
    try:
        with ThreadPoolExecutor(max_workers=max(1, min(parallel, len(tables)))) as pool:
            writes = [pool.submit(df.write.mode("errorifexists").format(fmt).save, f"{folder}/{name}") for name, df in tables.items()]
            for write in writes:
                write.result()
        number = max([n for n, _ in _commits(spark, dest)], default=0) + 1
        fs.mkdirs(path(f"{dest}/{COMMITS}"))
        if not fs.createNewFile(path(f"{dest}/{COMMITS}/{number:020}.{version}")):
            raise OSError(f"could not publish {version}")
    except BaseException:
        fs.delete(path(folder), True)
        raise
    for number, old in _commits(spark, dest)[:-keep]:
        fs.delete(path(f"{dest}/{COMMITS}/{number:020}.{old}"), False)
        fs.delete(path(f"{dest}/{VERSIONS}/{old}"), True)
    return folder


def current_version(spark: SparkSession, dest: str) -> str:
    """The folder of the current version; resolve it once to read several tables of one version."""
    commits = _commits(spark, dest.rstrip("/"))
    if not commits:
        raise FileNotFoundError(f"nothing was published in {dest}")
    return f"{dest.rstrip('/')}/{VERSIONS}/{commits[-1][1]}"


def read_published(spark: SparkSession, dest: str, table: str, fmt: str = "parquet") -> DataFrame:
    """A table of the current version."""
    return spark.read.format(fmt).load(f"{current_version(spark, dest)}/{table}")
