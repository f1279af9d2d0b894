"""D3 for many tables at once (D12): packed INSERTs of thousands of tables in a number of jobs that does not grow with
them.

Tables whose order keys have the same types share one sort: their rows, already tuples of text, are range-partitioned on
(table, key). A partition then holds whole small tables and runs of large ones, and each run is a function of the bytes
carried into it, as in :mod:`statements`; the functions are composed by table, ``FAN`` partitions at a time. The text is
what :func:`statements.insert_extended` writes for each table by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablevault.functions.literals import COMPAT, quote_ident, row_tuple
from tablevault.operators.common import broadcast_known
from tablevault.operators.statements import (DEFAULT_MAX_PACKET, FAN, FUNCTION, NOTHING_OPEN, Fold, _comparable, _composer,
                                             _evaluate, insert_prefix)
from tablevault.session import ensure_checkpoint_dir, small_arrow_batches


@dataclass
class TableRows:
    """One table to pack: its rows, its name, and its unique order key (the whole row by default)."""

    tid: int
    df: DataFrame
    table: str
    key: list[str] | None = None

    def prefix(self) -> str:
        return insert_prefix(self.table, self.df.columns)

    def signature(self) -> tuple:
        """The types of the columns that order the rows; tables of one signature are sorted together."""
        fields = {f.name: f.dataType for f in self.df.schema.fields}
        return tuple(fields[k].simpleString() for k in self.key) if self.key else ()


def union_tree(frames: list[DataFrame]) -> DataFrame:
    """The union of frames of one schema, in pairs: thousands of them are analysed once each a level."""
    while len(frames) > 1:
        frames = [frames[i].unionAll(frames[i + 1]) if i + 1 < len(frames) else frames[i] for i in range(0, len(frames), 2)]
    return frames[0]


def _sorted_tuples(tables: list[TableRows], mode: str, num_partitions: int | None) -> DataFrame:
    """(tid, tuple, size, _pid, _idx) of tables of one signature, sorted by table and key, checkpointed."""
    frames = []
    for t in tables:
        key = [F.col(quote_ident(k)) for k in t.key] if t.key else [F.xxhash64(*_comparable(t.df))]
        text = row_tuple(t.df, t.df.columns, mode)
        # the number as text until after the union: a text is no part of the code that Spark compiles, so that tables of
        # one schema share it
        frames.append(t.df.select(F.lit(str(t.tid)).alias("tid"), *[k.alias(f"k{i}") for i, k in enumerate(key)], text.alias("tuple")))
    rows = union_tree(frames).withColumn("tid", F.col("tid").cast("int"))
    keys = [F.col("tid"), *[F.col(c) for c in rows.columns if c.startswith("k")]]
    # rows that agree in a hash of the whole row are put in order by their text
    order = keys if tables[0].key else [*keys, F.col("tuple")]
    return (rows.withColumn("_tie", F.monotonically_increasing_id())
            .repartitionByRange(*([num_partitions] if num_partitions else []), *keys, F.col("_tie"))
            .sortWithinPartitions(*order, F.col("_tie"))
            .select("tid", "tuple", F.octet_length("tuple").cast("long").alias("size"), F.spark_partition_id().alias("_pid"),
                    F.monotonically_increasing_id().alias("_mid"))
            .withColumn("_idx", F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)).drop("_mid")
            .checkpoint(eager=True))


#: A run's function with its table and the index of its first row in the partition.
RUN = f"tid int, at long, {FUNCTION}"
RUN_NAMES = ["tid", "at", "id", "g", "out", "n", "last", "total", "open"]


def _runs(limits: dict[int, int]):
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tid, at, run, index, pid = None, 0, None, 0, None

        def done() -> pd.DataFrame:
            return pd.DataFrame([(tid, at, pid, *run.done())], columns=RUN_NAMES)

        for batch in batches:
            if not len(batch):
                continue
            pid = int(batch["_pid"].iloc[0])
            sizes, ids = batch["size"].to_numpy(dtype=np.int64), batch["tid"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if int(ids[a]) != tid:
                    if run:
                        yield done()
                    tid, at = int(ids[a]), index + a
                    run = Fold(limits[tid])
                run.add(sizes[a:b])
            index += len(ids)
        if run:
            yield done()

    return fold


def _compose(limits: dict[int, int]):
    def compose(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = _composer(limits[int(key[0])])((key[1],), rows)
        out.insert(0, "at", 0)
        out.insert(0, "tid", int(key[0]))
        return out

    return compose


WALK = "tid int, id long, carry long, base long"


def _walk(limits: dict[int, int]):
    def walk(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        carry, base, found = int(rows["carry"].iloc[0]), int(rows["base"].iloc[0]), []
        for f in rows.itertuples(index=False):
            found.append((int(key[0]), int(f.id), carry, base))
            _, carry, started = _evaluate(f, carry, limits[int(key[0])])
            base += started
        return pd.DataFrame(found, columns=["tid", "id", "carry", "base"])

    return walk


BOUNDS = "tid int, _pid int, first long, last long, starts long, base long"


def _starts(limits: dict[int, int]):
    def bounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for f in batch.itertuples(index=False):
                i, _, n = _evaluate(f, int(f.carry), limits[int(f.tid)])
                at = (1 << 60,) * 2 if i < 0 else (int(f.at) + i, int(f.at) + int(f.last[i]))
                found.append((int(f.tid), int(f.id), *at, n if i >= 0 else 0, int(f.base)))
            yield pd.DataFrame(found, columns=["tid", "_pid", "first", "last", "starts", "base"])

    return bounds


def run_bounds(rows: DataFrame, limits: dict[int, int], fan: int = FAN) -> DataFrame:
    """``BOUNDS`` of each table's run in each partition."""
    levels = [rows.select("tid", "size", "_pid").mapInPandas(_runs(limits), RUN).checkpoint()]
    last = levels[0].agg(F.max("id")).first()[0] or 0
    parent = F.floor(F.col("id") / fan).cast("long").alias("parent")
    while last >= fan:
        levels.append(levels[-1].drop("last").groupBy("tid", parent).applyInPandas(_compose(limits), RUN).checkpoint())
        last //= fan
    zero = F.lit(0).cast("long")
    # where the last start is matters to the partitions alone
    walk = levels[-1].drop("last").withColumns({"parent": zero, "carry": F.lit(NOTHING_OPEN), "base": zero})
    walk = walk.groupBy("tid", "parent").applyInPandas(_walk(limits), WALK)
    for level in reversed(levels[:-1]):
        above = walk.withColumnRenamed("id", "parent")
        walk = (level.drop("last").withColumn("parent", F.floor(F.col("id") / fan).cast("long")).join(above, ["tid", "parent"])
                .groupBy("tid", "parent").applyInPandas(_walk(limits), WALK))
    return levels[0].join(walk, ["tid", "id"]).mapInPandas(_starts(limits), BOUNDS)


PACKED = "tid int, seq long, stmt string, n_rows long, n_bytes long"


def _packer(prefixes: dict[int, str], limits: dict[int, int]):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Whole statements of each run's rows between its first and its last start; streaming."""
        held: list[str] = []
        used, seq, tid = 0, 0, None

        def statement() -> tuple:
            text = prefixes[tid] + ",".join(held) + ";"
            return tid, seq, text, len(held), len(text.encode())

        for batch in batches:
            if not len(batch):
                continue
            tuples, ids, sizes = batch["tuple"].tolist(), batch["tid"].to_numpy(), batch["size"].to_numpy(dtype=np.int64)
            cuts, out = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)], []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if int(ids[a]) != tid:
                    if held:
                        out.append(statement())
                    held, used, tid, seq = [], 0, int(ids[a]), int(batch["base"].iloc[a])
                g, at = np.cumsum(sizes[a:b] + 1), 0
                while at < b - a:
                    before = int(g[at - 1]) if at else 0
                    end = int(np.searchsorted(g, limits[tid] - used + before, side="right"))
                    end = max(end, at + 1) if not held else end
                    held += tuples[a + at:a + end]
                    used += int(g[end - 1]) - before if end > at else 0
                    if end < b - a:
                        out.append(statement())
                        held, used, seq = [], 0, seq + 1
                    at = end
            if out:
                yield pd.DataFrame(out, columns=["tid", "seq", "stmt", "n_rows", "n_bytes"])
        if held:
            yield pd.DataFrame([statement()], columns=["tid", "seq", "stmt", "n_rows", "n_bytes"])

    return pack


def insert_many(tables: list[TableRows], max_packet: int = DEFAULT_MAX_PACKET, mode: str = COMPAT,
                num_partitions: int | None = None, fan: int = FAN) -> DataFrame:
    """D3 over many tables: ``PACKED`` rows, ``seq`` numbering the statements of each table from 0.

    One sort and a fixed number of jobs for each set of key types among the tables.
    """
    if max_packet < 2:
        raise ValueError("max_packet must be at least 2 bytes")
    spark = tables[0].df.sparkSession
    ensure_checkpoint_dir(spark)
    small_arrow_batches(spark)
    prefixes = {t.tid: t.prefix() for t in tables}
    limits = {tid: max_packet - len(p.encode("utf-8")) + 1 for tid, p in prefixes.items()}
    heads = spark.createDataFrame(list(prefixes.items()), "tid int, prefix string")
    by_signature: dict[tuple, list[TableRows]] = {}
    for t in tables:
        by_signature.setdefault(t.signature(), []).append(t)
    found = []
    for group in by_signature.values():
        rows = _sorted_tuples(group, mode, num_partitions)
        bounds = run_bounds(rows, limits, fan).checkpoint()
        placed = rows.join(broadcast_known(bounds, bounds.count()), ["tid", "_pid"])
        inner = placed.filter((F.col("_idx") >= F.col("first")) & (F.col("_idx") < F.col("last")))
        found.append(inner.select("tid", "tuple", "size", "base").mapInPandas(_packer(prefixes, limits), PACKED))
        # ends of runs: what the open statement still takes, and what the last statement already holds
        seq = F.when(F.col("_idx") < F.col("first"), F.col("base") - 1).otherwise(F.col("base") + F.col("starts") - 1)
        ends = placed.filter((F.col("_idx") < F.col("first")) | (F.col("_idx") >= F.col("last")))
        parts = F.array_sort(F.collect_list(F.struct("_pid", "_idx", "tuple")))
        ends = ends.groupBy("tid", seq.alias("seq")).agg(parts.alias("p")).join(broadcast_known(heads, len(prefixes)), "tid")
        stmt = F.concat("prefix", F.array_join(F.transform("p", lambda x: x["tuple"]), ","), F.lit(";"))
        ends = ends.select("tid", "seq", stmt.alias("stmt"), F.size("p").cast("long").alias("n_rows"))
        found.append(ends.withColumn("n_bytes", F.octet_length("stmt").cast("long")))
    return union_tree(found)

