"""Helpers that the training-data operators share."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablevault.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder, in a session set up for whole texts."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of whole texts in one Arrow batch; Spark's default of 10,000 is meant for short rows.
BATCH_ROWS = "1000"


def small_batches(spark: SparkSession) -> None:
    """Bound the memory that whole texts take on their way to Python, unless the session says otherwise."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, BATCH_ROWS)


def text_of(column: str) -> Column:
    """The column as text, null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def row_key(id_col: str, text_col: str) -> Column:
    """16 bytes that name a row by its id and its whole text.

    Rows that agree in both share a key; the operators give such rows the same result. Null ids
    are a value of their own, so a column of nulls spreads over the texts.
    """
    parts = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.lit("\u0001"), text_of(text_col))
    return F.unhex(F.md5(parts.cast("binary")))


def once(function):
    """A Python column function that Spark evaluates once per row, wherever its result is used.

    Filters on its result would otherwise be pushed below the projection, with a second evaluation.
    """
    return function.asNondeterministic()


def packed(docs: DataFrame) -> DataFrame:
    """``docs`` as one struct column ``row``, so that columns of any name can stand beside it.

    ``select("row.*")`` gives back the columns as they were.
    """
    return docs.select(F.struct("*").alias("row"))


def cut(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared checkpoint folder: lineage ends there, lost executors cost nothing.

    Parquet instead of ``checkpoint()``: compressed, and later reads fetch only the columns they use.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    forget(spark)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, keys: list[str], out: str, part: str) -> DataFrame:
    """Gapless ranks from 0 within ``keys``, without a task that holds all rows of a hot key.

    ``part`` splits every key into pieces of bounded size (here: the id of the task that read the
    row). Rows are numbered inside (key, piece); the pieces' counts, one row each, are summed up
    over the pieces and added. ``df`` must be stable (a cut or a scan).
    """
    inner = Window.partitionBy(*keys, part).orderBy("rid")
    counts = df.groupBy(*keys, part).agg(F.count("*").alias("_n"))
    outer = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = outer.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    ranked = df.withColumn("_in", F.row_number().over(inner) - 1)
    on = [*keys, part]
    return ranked.join(starts, on).withColumn(out, F.col("_start") + F.col("_in")).drop("_start", "_in")


def forget(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now, not when the driver next collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def groups(batches: Iterator, keys: list[str]) -> Iterator:
    """The row groups of a partition sorted by ``keys``, each as one frame, across Arrow batches."""
    import pandas as pd

    held: list = []
    last = None
    for batch in batches:
        ids = list(zip(*[batch[k] for k in keys], strict=True))
        start = 0
        for i in range(len(ids) + 1):
            if i == len(ids) or ids[i] != last:
                if i > start:
                    held.append(batch.iloc[start:i])
                if i < len(ids):
                    if held:
                        yield pd.concat(held)
                    held, last, start = [], ids[i], i
    if held:
        yield pd.concat(held)
