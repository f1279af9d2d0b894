"""INSERT statement generation: D1 prefix, D2 one row per statement, D3 packed statements.

D2 is a pure projection (no shuffle). D3 packs the rows, in key order, as one greedy pass over the whole
table would, whatever the number of partitions:

1. rows are range-partitioned and sorted on the caller's key (distributed sort, no single task);
2. where a statement starts depends on the bytes that the open statement holds when a partition begins. A
   partition is therefore a function: bytes carried in -> first start, number of starts, bytes carried out.
   With running sums of the tuple sizes it is a table over the first packet of the partition;
3. these functions are composed in groups of ``FAN`` partitions, group by group up to one, and the carried
   bytes walk back down, so no task and not the driver sees all partitions;
4. statements that lie within a partition are joined there, streaming; the rows at partition ends, less
   than a packet each, meet in a grouping by statement number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablevault.functions.literals import COMPAT, quote_ident, row_tuple
from tablevault.operators.common import broadcast_known
from tablevault.session import ensure_checkpoint_dir, small_arrow_batches

DEFAULT_MAX_PACKET = 4194304
#: Partitions (or groups of them) composed in one task.
FAN = 32


def insert_prefix(table: str, columns: list[str]) -> str:
    """``INSERT INTO `t` (`a`, `b`) VALUES `` (the column list is always written)."""
    cols = ", ".join(quote_ident(c) for c in columns)
    return f"INSERT INTO {quote_ident(table)} ({cols}) VALUES "


def insert_single(df: DataFrame, table: str, columns: list[str] | None = None, mode: str = COMPAT,
                  keep: list[str] | None = None) -> DataFrame:
    """One ``INSERT ... VALUES (...);`` per row, as column ``stmt`` (plus ``keep`` columns)."""
    cols = columns or df.columns
    stmt = F.concat(F.lit(insert_prefix(table, cols)), row_tuple(df, cols, mode), F.lit(";"))
    return df.select(*[F.col(quote_ident(k)) for k in (keep or [])], stmt.alias("stmt"))


def sorted_rows(df: DataFrame, key: list[str] | None, num_partitions: int | None = None,
                keep: list[str] | None = None) -> DataFrame:
    """Rows in ``key`` order over range partitions, with ``_pid`` and ``_idx`` (index in the partition).

    ``key`` must be unique or the whole row: then rows with equal keys are identical, and a tie-break on input
    order lets a hot group of identical rows spread over many partitions without changing any text. Without
    a key the rows are ordered by a fixed-width hash of the row: the range exchange samples its keys to the
    driver, and whole rows of long text would not be small.

    The exchange samples its bounds with a seed tied to the plan, so two plans over the same input may cut at
    different keys. Without a given number Spark merges small neighbouring partitions by their bytes.
    The sorted rows are checkpointed once (to ``spark.checkpoint.dir``); a lost
    executor re-reads the checkpoint instead of sampling again.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    columns = [F.col(quote_ident(c)) for c in (keep or df.columns)]
    bounds = [F.col(quote_ident(k)) for k in key] if key else [F.xxhash64(*_comparable(df))]
    order = bounds if key else [*bounds, *_comparable(df)]
    return (df.withColumn("_tie", F.monotonically_increasing_id())
            .repartitionByRange(*([num_partitions] if num_partitions else []), *bounds, F.col("_tie"))
            .sortWithinPartitions(*order, F.col("_tie"))
            .select(*columns, F.spark_partition_id().alias("_pid"), F.monotonically_increasing_id().alias("_mid"))
            # that id holds the partition in its upper 31 bits and the record number in the lower 33
            .withColumn("_idx", F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)).drop("_mid")
            .checkpoint(eager=True))


def _comparable(df: DataFrame) -> list[Column]:
    """The columns, maps as text (a map can be neither hashed nor ordered)."""
    from pyspark.sql import types as T

    return [F.to_json(F.col(quote_ident(f.name))) if isinstance(f.dataType, T.MapType) else F.col(quote_ident(f.name))
            for f in df.schema.fields]


def with_positions(df: DataFrame, key: list[str], num_partitions: int | None = None,
                   keep: list[str] | None = None) -> DataFrame:
    """Add ``_pos`` (0-based, long): the row's rank in ``key`` order.

    A row's position is the number of rows in earlier partitions plus its index in its own; the counts are one
    row per partition, brought to the driver and back as offsets.
    """
    spark = df.sparkSession
    ordered = sorted_rows(df, key, num_partitions, keep)
    per_part = sorted((r[0], r[1]) for r in ordered.groupBy("_pid").agg(F.count(F.lit(1))).collect())
    offsets, total = [], 0
    for pid, n in per_part:
        offsets.append((pid, total))
        total += n
    off_df = spark.createDataFrame(offsets or [(0, 0)], "_pid int, _off long")
    return (ordered.join(broadcast_known(off_df, len(offsets)), "_pid")
            .withColumn("_pos", F.col("_off") + F.col("_idx")).drop("_pid", "_idx", "_off"))


# --- D3 -------------------------------------------------------------------------------------------
#
# With g(i) the running sum of (tuple bytes + 1) after tuple i of a partition, a statement into which c bytes
# came from earlier partitions takes tuples while c + g(i) <= limit; the first tuple beyond starts the next.
# A partition's function is the table (g, out, n, last) over the tuples that can be its first start: bytes
# carried out, statements started, index of the last start. ``open`` says that it may hold no start at all.

FUNCTION = "id long, g array<long>, out array<long>, n array<long>, last array<long>, total long, open boolean"
NOTHING_OPEN = 1 << 60  # more than any limit: the first tuple starts a statement
#: Tuple sizes that a task holds before it makes a function of them.
FOLD_ROWS = 1 << 16


def _partition_function(sizes: np.ndarray, limit: int) -> tuple:
    """The function of one partition from its tuple sizes."""
    g = np.cumsum(sizes + 1)
    n = len(g)
    firsts = min(n, int(np.searchsorted(g, limit, side="right")) + 1)
    before = g - (sizes + 1)
    following = np.maximum(np.searchsorted(g, before + limit, side="right"), np.arange(n) + 1)
    last, count = np.arange(firsts), np.ones(firsts, dtype=np.int64)
    while True:  # all first starts step on together, a statement at a time
        step = following[last] if firsts else last
        on = step < n
        if not on.any():
            break
        last = np.where(on, step, last)
        count += on
    total = int(g[-1]) if n else 0
    out = total - before[last] if firsts else last
    return g[:firsts], out, count, last, total, firsts == n and (not n or int(g[-1]) <= limit)


def _followed(f: tuple, then: tuple, limit: int, at: int = 0) -> tuple:
    """The function of rows with function ``f`` and rows with function ``then`` after them, the first of which has index ``at``.

    A tuple after the first one beyond the limit is never the first start, so the tables stay within a packet.
    """
    g, out, n, last, total, is_open = f
    g2, out2, n2, last2, total2, open2 = then
    entry = np.searchsorted(g2, limit - out, side="right")
    starts = entry < len(g2)
    entry = entry[starts]
    out, n, last = np.minimum(out + total2, NOTHING_OPEN), n.copy(), last.copy()
    out[starts], last[starts] = out2[entry], last2[entry] + at
    n[starts] += n2[entry]
    if is_open:  # carried bytes may reach the rows after untouched but for what came before
        firsts = int(np.searchsorted(g2, limit - total, side="right")) + 1
        g, out = np.concatenate([g, g2[:firsts] + total]), np.concatenate([out, out2[:firsts]])
        n, last = np.concatenate([n, n2[:firsts]]), np.concatenate([last, last2[:firsts] + at])
        is_open = bool(open2) and total + total2 <= limit
    return g, out, n, last, total + total2, is_open


class Fold:
    """The function of rows that come in batches; holds ``FOLD_ROWS`` sizes and a packet's table, however many rows come."""

    def __init__(self, limit: int):
        self.limit, self.at, self.held, self.rows = limit, 0, [], 0
        self.function = _partition_function(np.empty(0, dtype=np.int64), limit)

    def add(self, sizes: np.ndarray) -> None:
        for start in range(0, len(sizes), FOLD_ROWS):
            part = sizes[start:start + FOLD_ROWS]
            self.held.append(part)
            self.rows += len(part)
            if self.rows >= FOLD_ROWS:
                self.done()

    def done(self) -> tuple:
        if self.held:
            then = _partition_function(np.concatenate(self.held), self.limit)
            self.function = _followed(self.function, then, self.limit, self.at)
            self.at += self.rows
            self.held, self.rows = [], 0
        return self.function


def _evaluate(f, carry: int, limit: int) -> tuple[int, int, int]:
    """(entry or -1 for no start, bytes carried out, statements started)."""
    i = int(np.searchsorted(np.asarray(f.g), limit - carry, side="right"))
    if i < len(f.g):
        return i, int(f.out[i]), int(f.n[i])
    return -1, min(carry + int(f.total), NOTHING_OPEN), 0


def _composer(limit: int):
    def compose(parent: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        whole = Fold(limit).function
        for f in rows.sort_values("id").itertuples(index=False):
            g, out, n = (np.asarray(x, dtype=np.int64) for x in (f.g, f.out, f.n))
            whole = _followed(whole, (g, out, n, np.zeros_like(g), int(f.total), bool(f.open)), limit)
        g, out, n, _, total, is_open = whole
        return pd.DataFrame([(int(parent[0]), g, out, n, [], total, is_open)],
                            columns=["id", "g", "out", "n", "last", "total", "open"])

    return compose


WALK = "id long, carry long, base long"
BOUNDS = "_pid int, first long, last long, starts long, base long"


def _walker(limit: int):
    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        """Carried bytes and statements before each member of a group."""
        rows = rows.sort_values("id")
        carry, base, found = int(rows["carry"].iloc[0]), int(rows["base"].iloc[0]), []
        for f in rows.itertuples(index=False):
            found.append((int(f.id), carry, base))
            _, carry, started = _evaluate(f, carry, limit)
            base += started
        return pd.DataFrame(found, columns=["id", "carry", "base"])

    return walk


def _starts(limit: int):
    def bounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for f in batch.itertuples(index=False):
                i, _, n = _evaluate(f, int(f.carry), limit)
                none = 1 << 60
                found.append((int(f.id), none, none, 0, int(f.base)) if i < 0 else
                             (int(f.id), i, int(f.last[i]), n, int(f.base)))
            yield pd.DataFrame(found, columns=["_pid", "first", "last", "starts", "base"])

    return bounds


def statement_bounds(sizes: DataFrame, limit: int, fan: int = FAN) -> DataFrame:
    """``BOUNDS`` per partition of ``sizes`` (_pid, size; one partition each, in row order)."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, pid = Fold(limit), None
        for batch in batches:
            if len(batch):
                pid = int(batch["_pid"].iloc[0])
                run.add(batch["size"].to_numpy(dtype=np.int64))
        if pid is not None:
            yield pd.DataFrame([(pid, *run.done())],
                               columns=["id", "g", "out", "n", "last", "total", "open"])

    levels = [sizes.mapInPandas(fold, FUNCTION).checkpoint()]
    many = levels[0].count()
    parent = (F.col("id") / fan).cast("long").alias("parent")
    while many > fan:
        levels.append(levels[-1].drop("last").groupBy(parent).applyInPandas(_composer(limit), FUNCTION).checkpoint())
        many = levels[-1].count()
    zero = F.lit(0).cast("long")
    # where the last start is matters to the partitions alone
    walk = levels[-1].drop("last").withColumns({"parent": zero, "carry": F.lit(NOTHING_OPEN), "base": zero})
    walk = walk.groupBy("parent").applyInPandas(_walker(limit), WALK)
    for level in reversed(levels[:-1]):
        above = walk.withColumnRenamed("id", "parent")
        walk = (level.drop("last").withColumn("parent", (F.col("id") / fan).cast("long")).join(above, "parent")
                .groupBy("parent").applyInPandas(_walker(limit), WALK))
    return levels[0].join(walk, "id").mapInPandas(_starts(limit), BOUNDS)


PACKED_SCHEMA = "chunk long, seq long, stmt string, n_rows long, n_bytes long"


def _packer(prefix: str, limit: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Whole statements of a partition's rows between its first and its last start; streaming."""
        held: list[str] = []
        used, seq = 0, None

        def statement() -> tuple:
            text = prefix + ",".join(held) + ";"
            return 0, seq, text, len(held), len(text.encode())

        for batch in batches:
            if not len(batch):
                continue
            tuples, g = batch["tuple"].tolist(), np.cumsum(batch["size"].to_numpy(dtype=np.int64) + 1)
            if seq is None:
                seq = int(batch["base"].iloc[0])
            out, at = [], 0
            while at < len(tuples):
                before = int(g[at - 1]) if at else 0
                end = int(np.searchsorted(g, limit - used + before, side="right"))
                end = max(end, at + 1) if not held else end
                held += tuples[at:end]
                used += int(g[end - 1]) - before if end > at else 0
                if end < len(tuples):
                    out.append(statement())
                    held, used, seq = [], 0, seq + 1
                at = end
            if out:
                yield pd.DataFrame(out, columns=["chunk", "seq", "stmt", "n_rows", "n_bytes"])
        if held:
            yield pd.DataFrame([statement()], columns=["chunk", "seq", "stmt", "n_rows", "n_bytes"])

    return pack


def insert_extended(df: DataFrame, table: str, key: list[str] | None = None,
                    max_packet: int = DEFAULT_MAX_PACKET, columns: list[str] | None = None, mode: str = COMPAT,
                    num_partitions: int | None = None, fan: int = FAN) -> DataFrame:
    """D3: extended INSERTs, consecutive tuples packed up to ``max_packet`` bytes.

    Before adding a tuple to an open statement, the statement is closed if both would pass
    ``max_packet - 1`` bytes (the joining comma and the closing ``;`` are not counted). A single tuple larger
    than the limit gets a statement of its own. Returns ``(chunk, seq, stmt, n_rows, n_bytes)``: ``seq`` numbers
    the statements of the table, ``chunk`` is 0, ``n_bytes`` counts the statement with its ``;``.
    """
    if max_packet < 2:
        raise ValueError("max_packet must be at least 2 bytes")
    small_arrow_batches(df.sparkSession)
    cols = columns or df.columns
    prefix = insert_prefix(table, cols)
    limit = max_packet - len(prefix.encode("utf-8")) + 1
    needed = list(dict.fromkeys([*(key or []), *cols]))
    rows = sorted_rows(df.select(*[F.col(quote_ident(c)) for c in needed]), key, num_partitions, keep=list(cols))
    text = rows.select("_pid", "_idx", row_tuple(rows, cols, mode).alias("tuple"))
    text = text.withColumn("size", F.octet_length("tuple").cast("long"))
    bounds = statement_bounds(text.select("_pid", "size"), limit, fan).checkpoint()
    placed = text.join(broadcast_known(bounds, bounds.count()), "_pid")
    inner = placed.filter((F.col("_idx") >= F.col("first")) & (F.col("_idx") < F.col("last")))
    whole = inner.select("tuple", "size", "base").mapInPandas(_packer(prefix, limit), PACKED_SCHEMA)
    # partition ends: what the open statement still takes, and what the last statement already holds
    seq = F.when(F.col("_idx") < F.col("first"), F.col("base") - 1).otherwise(F.col("base") + F.col("starts") - 1)
    ends = placed.filter((F.col("_idx") < F.col("first")) | (F.col("_idx") >= F.col("last")))
    parts = F.array_sort(F.collect_list(F.struct("_pid", "_idx", "tuple")))
    ends = ends.groupBy(seq.alias("seq")).agg(parts.alias("p"))
    stmt = F.concat(F.lit(prefix), F.array_join(F.transform("p", lambda x: x["tuple"]), ","), F.lit(";"))
    ends = ends.select(F.lit(0).cast("long").alias("chunk"), "seq", stmt.alias("stmt"),
                       F.size("p").cast("long").alias("n_rows"))
    ends = ends.withColumn("n_bytes", F.octet_length("stmt").cast("long"))
    return whole.unionByName(ends)
