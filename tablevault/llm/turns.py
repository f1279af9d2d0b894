"""Rows of conversations in order, over many tasks: what the conversation operators share.

A conversation may hold a third of all rows, so none is collected. Rows are range-partitioned and sorted by
conversation and position; a partition then holds whole conversations, and at its two ends runs of conversations
that may go on in its neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a text that the range exchange compares; its samples go to the driver.
PREFIX = 32


def id_key(column: Column) -> Column:
    """A text that names an id; null is a name of its own."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("-"))


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` (with k, turn, role, text) with the columns that put equal turns in order."""
    return rows.withColumns({"_head": F.substring("text", 1, PREFIX), "_hash": F.xxhash64("text")})


def in_order(rows: DataFrame, last: str = "text") -> DataFrame:
    """Ranked rows sorted by k, turn (null first), role and text.

    Equal turns are ordered by role, the text's first ``PREFIX`` characters, a hash of the whole text, and ``last`` (the
    text itself or a digest of it). Rows that agree in all of it are identical, so that a hot group of them may
    spread over partitions.
    """
    order = [F.col("k"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("_head"), F.col("_hash")]
    tie = F.col("_tie")
    return (rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order, tie)
            .sortWithinPartitions(*order, F.col(last), tie).drop("_tie", "_head", "_hash"))
