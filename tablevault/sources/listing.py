"""List the backup files of many targets as one DataFrame.

Default names contain ``:`` (``db_backup_2024-01-01T00:00:00Z.tgz``), which Hadoop paths cannot
hold, so the default lister runs the pyarrow filesystem layer inside Spark tasks: targets are
spread over tasks (one target per task), each task lists its directory and returns only names,
sizes and times. File contents are never read. ``method="hadoop"`` uses the ``binaryFile`` source
instead (Hadoop-only schemes such as ``abfss:``; names must not contain ``:``).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablevault.functions.names import base_name

LISTING_SCHEMA = "target string, filename string, length long, modified timestamp"


def normalize_url(url: str) -> str:
    """N8 (driver side): a bare absolute path means ``file://``."""
    return "file://" + url if url.startswith("/") else url


def _list_arrow(batches: Iterator[pd.DataFrame], include_dirs: bool = False) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    kinds = (fs.FileType.File, fs.FileType.Directory) if include_dirs else (fs.FileType.File,)
    for pdf in batches:
        for target in pdf["target"]:
            filesystem, root = fs.FileSystem.from_uri(normalize_url(target))
            infos = filesystem.get_file_info(fs.FileSelector(root, recursive=False))
            files = [i for i in infos if i.type in kinds]
            yield pd.DataFrame({
                "target": [target] * len(files),
                "filename": [i.base_name for i in files],
                "length": [int(i.size or 0) for i in files],
                "modified": pd.to_datetime([i.mtime for i in files], utc=True),
            })


def list_backups(spark: SparkSession, targets: list[str] | DataFrame, method: str = "arrow",
                 include_dirs: bool = False) -> DataFrame:
    """``(target, filename, length, modified)`` for every file directly inside each target.

    ``include_dirs=True`` also lists folders (a backup written by ``run_backup`` is a folder of
    part files); their length is 0.
    """
    if method == "hadoop":
        names = targets if isinstance(targets, list) else [r.target for r in targets.collect()]
        return _list_hadoop(spark, names)
    tdf = (spark.createDataFrame([(t,) for t in targets], "target string")
           if isinstance(targets, list) else targets.select("target"))
    n = max(1, tdf.count())
    return tdf.repartition(n, "target").mapInPandas(lambda it: _list_arrow(it, include_dirs), LISTING_SCHEMA)


def _list_hadoop(spark: SparkSession, targets: list[str]) -> DataFrame:
    frames = []
    for t in targets:
        df = (spark.read.format("binaryFile").option("recursiveFileLookup", "false")
              .load(normalize_url(t).rstrip("/") + "/*")
              .select(F.lit(t).alias("target"), base_name("path").alias("filename"),
                      F.col("length").cast("long").alias("length"),
                      F.col("modificationTime").alias("modified")))
        frames.append(df)
    if not frames:
        return spark.createDataFrame([], LISTING_SCHEMA)
    return reduce(DataFrame.unionByName, frames)
