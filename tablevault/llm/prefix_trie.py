"""The trie of all conversations' prefixes, screened by a count-min sketch.

Every conversation contributes its prefixes (its first d turns, for each d). A prefix has a digest that grows turn by
turn: a polynomial modulo 2**127 - 1 in the MD5 values of its turns, so that a conversation that lies in several
partitions needs only the digest and number of the turns before each of them.

A count-min sketch of all digests (``DEPTH`` rows of counters that stop at two) is built in the tasks, merged and sent to
all of them; its size is bounded by ``MAX_BITS`` whatever the input. An estimate of one proves that a prefix belongs
to one conversation alone: its node is written where the prefix stands, and so are all nodes of a conversation's
own tail. Only prefixes with a higher estimate are shuffled and grouped, exactly; some of them turn out single. A fuller
sketch means more shuffling, never another result.

Sums over subtrees run over the grouped nodes by pointer doubling: after k rounds each node holds the sum over its
descendants less than 2**k below and a pointer 2**k up, so a trie of depth d takes log2(d) rounds of two joins. Tails hang
on their grouped parent as one leaf.

Prefixes are told apart by 127 bits and their length: two different ones share a name with a chance of about their
length in 2**127.

Defined results: null turns come first, equal turns are in the order of ``turns.in_order``; a null role or text is
empty; rows without a conversation id belong to no conversation; rows equal in all columns are turns of their own;
a conversation without turns is a member of the root alone; without any conversation there is no node, not even a
root; other columns do not matter, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablevault.llm.common import cut
from tablevault.llm.turns import in_order, ranked
from tablevault.operators.common import broadcast_known

MODULUS = (1 << 127) - 1
#: The place at which the digest polynomial is taken, an arbitrary number below the modulus.
BASE = 0x5DEECE66D1CE4E5B9BF58476D1CE4E5B % MODULUS

#: Rows of the sketch, counters a row as a power of two: enough for four times the prefixes, within these bounds.
DEPTH, MIN_BITS, MAX_BITS = 4, 12, 22
#: Odd multipliers, two for each row.
MULTIPLIERS = np.array([[0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], [0x165667B19E3779F9, 0xFF51AFD7ED558CCD],
                        [0xC4CEB9FE1A85EC53, 0xBF58476D1CE4E5B9], [0x94D049BB133111EB, 0xD6E8FEB86659FD93]], dtype=np.uint64)
#: Counters that travel together.
CHUNK = 1 << 16

ROOT = bytes(20)


# --- numbers and digests along conversations ------------------------------------------------------------

RUNS = "c long, pid int, idx long, digest binary, size long, name binary, last boolean, n long, total binary"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (c, digest, size) in order with their number and prefix name in the partition's run of c.

    A row without a digest begins a conversation and counts for none. The partition ends with a record (n, total) of
    its first and of its last conversation, which may go on elsewhere.
    """
    pid = TaskContext.get().partitionId()
    types = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.bool_(), pa.int64(), pa.binary()]
    names = [f.strip().split(" ")[0] for f in RUNS.split(",")]
    c, n, value, held, edges = None, 0, 0, None, []

    def frame(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*rows, strict=True), types, strict=True)],
                                          names=names)

    def edge() -> list:
        return [c, pid, None, None, None, None, None, n, value.to_bytes(16, "big")]

    for batch in batches:
        out = []
        for conv, digest, size in zip(*[x.to_pylist() for x in batch.columns], strict=True):
            if conv != c:
                if c is not None and not edges:
                    edges.append(edge())
                c, n, value = conv, 0, 0
                if held is not None:
                    held[6] = True
            if held is not None:
                out.append(held)
            if digest is not None:
                value = (value * BASE + int.from_bytes(digest, "big") + 1) % MODULUS
                n += 1
            held = [conv, pid, n, digest, size, value.to_bytes(16, "big"), False, None, None]
        if out:
            yield frame(out)
    if held is not None:
        held[6] = True
        if not edges or edges[0][0] != c:
            edges.append(edge())
        yield frame([held, *edges])


OFFSETS = "c long, pid int, before long, carry binary, more boolean"


def _offsets(runs: DataFrame) -> tuple[DataFrame, int]:
    """What lies before and after the partitions' runs, for conversations in several partitions.

    The driver sees two records a partition, as many as tasks have run.
    """
    found, records = [], runs.filter("n is not null").select("c", "pid", "n", "total").collect()
    by_conversation: dict[int, list] = {}
    for r in sorted(records, key=lambda r: r["pid"]):
        by_conversation.setdefault(r["c"], []).append(r)
    for c, pieces in by_conversation.items():
        before = carry = 0
        for i, r in enumerate(pieces):
            if len(pieces) > 1:
                found.append((c, r["pid"], before, bytearray(carry.to_bytes(16, "big")), i + 1 < len(pieces)))
            before += r["n"]
            carry = (carry * pow(BASE, r["n"], MODULUS) + int.from_bytes(r["total"], "big")) % MODULUS
    return runs.sparkSession.createDataFrame(found, OFFSETS), len(found)


def _placed(runs: DataFrame) -> DataFrame:
    """The rows of ``runs`` with before, carry and more of their conversation."""
    offsets, many = _offsets(runs)
    rows = runs.filter("n is null").drop("n", "total")
    return rows.join(broadcast_known(offsets, many), ["c", "pid"], "left")


def turns_of(conversations: DataFrame) -> DataFrame:
    """(c, pos, digest, size) of every turn: its place in its conversation from 0, its MD5, its text's bytes."""
    empty = F.lit("")
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("k"), F.col("turn").alias("turn"),
        F.coalesce(F.col("role").cast("string"), empty).alias("role"),
        F.coalesce(F.col("text").cast("string"), empty).alias("text")).filter("k is not null")
    named = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    rows = ranked(rows).select("k", "turn", "role", "_head", "_hash", F.unhex(F.md5(named.cast("binary"))).alias("digest"),
                               F.octet_length("text").cast("long").alias("size"))
    found = cut(in_order(rows, "digest").select("k", "digest", "size").mapInArrow(_runs, RUNS))
    pos = F.col("idx") - 1 + F.coalesce(F.col("before"), F.lit(0))
    return _placed(found).select("c", pos.alias("pos"), "digest", "size")


#: Prefix rows: conversation, depth, node, its parent's node, bytes of the last text, whether the conversation ends.
PREFIXES = "c long, depth long, node binary, parent binary, size long, is_end boolean"


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names of whole prefixes from those in the partition's run."""
    for batch in batches:
        names, parents, depths, ends = [], [], [], []
        for idx, digest, name, last, before, carry, more in zip(*[x.to_pylist() for x in batch.columns[1:8]], strict=True):
            value = int.from_bytes(name, "big")
            depth = idx + (before or 0)
            if carry is not None:
                value = (int.from_bytes(carry, "big") * pow(BASE, idx, MODULUS) + value) % MODULUS
            names.append(value.to_bytes(16, "big") + min(depth, 0xFFFFFFFF).to_bytes(4, "big"))
            if digest is None:
                parents.append(None)
            else:  # one turn less: value = parent * BASE + turn
                parent = (value - int.from_bytes(digest, "big") - 1) * INVERSE % MODULUS
                parents.append(parent.to_bytes(16, "big") + min(depth - 1, 0xFFFFFFFF).to_bytes(4, "big"))
            depths.append(depth)
            ends.append(bool(last) and not more)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(depths, pa.int64()), pa.array(names, pa.binary()), pa.array(parents, pa.binary()),
             batch.column(8), pa.array(ends, pa.bool_())], names=["c", "depth", "node", "parent", "size", "is_end"])


INVERSE = pow(BASE, -1, MODULUS)


def prefixes(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """``PREFIXES`` of conversations ``ids`` (c) whose turns are (c, pos, digest, size), the empty prefix included.

    A conversation's rows are ordered by ``pos``, which is no two times the same.
    """
    marks = ids.select("c", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("binary").alias("digest"),
                       F.lit(0).cast("long").alias("size"))
    rows = turns.unionByName(marks).repartitionByRange("c", "pos").sortWithinPartitions("c", "pos")
    found = cut(rows.select("c", "digest", "size").mapInArrow(_runs, RUNS))
    rows = _placed(found).select("c", "idx", "digest", "name", "last", "before", "carry", "more", "size")
    return rows.mapInArrow(_prefixes, PREFIXES)


# --- count-min screening ------------------------------------------------------------------------------------

def _cells(nodes: pa.Array, bits: int) -> np.ndarray:
    """The counter of each node in each row of the sketch (multiply-shift hashing of the name's halves)."""
    data = np.frombuffer(b"".join(nodes.to_pylist()), dtype=np.uint8).reshape(-1, len(ROOT))
    halves = [np.ascontiguousarray(data[:, at:at + 8]).view(np.uint64)[:, 0] for at in (0, 8)]
    mixed = [(halves[0] * a + (halves[1] ^ (halves[0] >> np.uint64(29))) * b) for a, b in MULTIPLIERS]
    return np.stack([((m ^ (m >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits) for m in mixed]).astype(np.int64)


def _sketch_bits(n: int) -> int:
    return min(MAX_BITS, max(MIN_BITS, math.ceil(math.log2(4 * n + 1))))


def sketch(rows: DataFrame, bits: int) -> bytes:
    """The merged sketch: ``DEPTH`` rows of 2**bits counters of a byte, which stop at two."""
    width = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if counters is None:
                counters = np.zeros(DEPTH * width, dtype=np.uint8)
            for row, cells in enumerate(_cells(batch.column(0), bits)):
                at, n = np.unique(cells, return_counts=True)
                at += row * width
                counters[at] = np.minimum(counters[at] + np.minimum(n, 2), 2)
        if counters is not None:
            for i in range(0, len(counters), CHUNK):
                part = counters[i:i + CHUNK]
                if part.any():
                    yield pa.RecordBatch.from_pydict({"chunk": pa.array([i // CHUNK], pa.int32()),
                                                      "counts": [zlib.compress(part.tobytes(), 1)]})

    def merge(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(min(CHUNK, DEPTH * width), dtype=np.uint8)
        for part in parts["counts"]:
            total = np.minimum(total + np.frombuffer(zlib.decompress(part), dtype=np.uint8), 2)
        return pd.DataFrame({"chunk": [key[0]], "counts": [zlib.compress(total.tobytes(), 1)]})

    parts = rows.filter("depth > 0").select("node").mapInArrow(count, "chunk int, counts binary")
    whole = np.zeros(DEPTH * width, dtype=np.uint8)
    for r in parts.groupBy("chunk").applyInPandas(merge, "chunk int, counts binary").collect():
        part = np.frombuffer(zlib.decompress(bytes(r["counts"])), dtype=np.uint8)
        whole[r["chunk"] * CHUNK:r["chunk"] * CHUNK + len(part)] = part
    return whole.tobytes()


def screened(rows: DataFrame, bits: int | None = None) -> DataFrame:
    """``rows`` with ``shared`` and ``parent_shared``: false where the sketch proves one conversation alone."""
    bits = bits or _sketch_bits(rows.count())
    sent = rows.sparkSession.sparkContext.broadcast(zlib.compress(sketch(rows, bits), 1))

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.frombuffer(zlib.decompress(sent.value), dtype=np.uint8).reshape(DEPTH, -1)

        def shared(nodes: pa.Array, depth: np.ndarray) -> np.ndarray:
            cells = _cells(nodes.fill_null(ROOT), bits)
            least = np.min([counters[row, cells[row]] for row in range(DEPTH)], axis=0)
            return (least > 1) | (depth <= 0)

        for batch in batches:
            if batch.num_rows:
                depth = batch.column("depth").to_numpy()
                flags = [pa.array(shared(batch.column(name), depth - less)) for name, less in (("node", 0), ("parent", 1))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *flags], names=[*batch.schema.names, "shared", "parent_shared"])

    return rows.mapInArrow(estimate, f"{PREFIXES}, shared boolean, parent_shared boolean")


# --- the trie ----------------------------------------------------------------------------------------------

NO_ENDS = hashlib.sha256(b"").hexdigest()


def _ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each node's conversation ids from rows sorted by node and c.

    The digest is sequential by nature: a node's ids stream through one task.
    """
    node, digest = None, None
    for batch in batches:
        out = []
        for name, ids in batch.groupby("node", sort=False)["c"]:
            text = ",".join(map(str, ids))
            if name != node:
                if node is not None:
                    out.append((node, digest.hexdigest()))
                node, digest = name, hashlib.sha256(text.encode())
            else:
                digest.update(b"," + text.encode())
        if out:
            yield pd.DataFrame(out, columns=["node", "ends_sha256"])
    if node is not None:
        yield pd.DataFrame([(node, digest.hexdigest())], columns=["node", "ends_sha256"])


def _subtree_sums(nodes: DataFrame, sums: list[str]) -> DataFrame:
    """(node, sums) with each of ``sums`` taken over the node and all below it; ``up`` is its parent among the nodes."""
    at = cut(nodes.select("node", "up", *sums))
    while at.filter("up is not null").limit(1).count():
        below = at.filter("up is not null").groupBy(F.col("up").alias("node")).agg(*[F.sum(s).alias(f"{s}_below") for s in sums])
        # the root's own pointer is null, and it may be a third of all nodes' parent: no join for those
        over = at.filter("up is not null").select(F.col("node").alias("up"), F.col("up").alias("over"))
        inner = at.join(over, "up", "left").select("node", "over", *sums)
        at = cut(inner.join(below, "node", "left").select(
            "node", F.col("over").alias("up"), *[(F.col(s) + F.coalesce(F.col(f"{s}_below"), F.lit(0))).alias(s) for s in sums]))
    return at.drop("up")


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie(rows: DataFrame, bits: int | None = None) -> DataFrame:
    """One row per node of the trie of ``rows`` (``PREFIXES``), with ``COLUMNS``.

    ``bits`` sets the sketch's width; by default it follows the number of prefixes.
    """
    rows = cut(screened(cut(rows), bits))
    many = rows.filter("shared")
    # exact grouping of what may be shared
    nodes = cut(many.groupBy("node", "depth").agg(
        F.count("*").alias("n_convs"), F.min("c").alias("conv_id"), F.sum(F.col("is_end").cast("long")).alias("n_ends"),
        F.min("parent").alias("parent"), F.max("size").alias("size"), F.max("parent_shared").alias("parent_shared")))
    tails = rows.filter("not shared")
    # every node whose parent is among the grouped ones counts there as a child; a tail's first node is a leaf's start
    starts = tails.filter("parent_shared")
    children = nodes.filter("parent_shared and depth > 0").select("parent", F.lit(0).cast("long").alias("tail"))
    children = children.unionByName(starts.select("parent", F.lit(1).cast("long").alias("tail")))
    children = children.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"), F.sum("tail").alias("n_tails"))
    ended = many.filter("is_end").select("node", "c").repartition("node").sortWithinPartitions("node", "c")
    ends = ended.mapInPandas(_ends, "node binary, ends_sha256 string")
    nodes = cut(nodes.join(children, "node", "left").join(ends, "node", "left"))

    own_leaf = (F.col("n_ends") == F.col("n_convs")).cast("long")
    up = F.when(F.col("parent_shared") & (F.col("depth") > 0), F.col("parent"))
    sums = _subtree_sums(nodes.select("node", up.alias("up"), (own_leaf + F.coalesce("n_tails", F.lit(0))).alias("n_leaves"),
                                      ((F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens")),
                         ["n_leaves", "saved_tokens"])
    # the parent's smallest member: the conversation itself under a proven single node, the root's by one look
    root = nodes.filter("depth = 0").select("conv_id").first()
    above = nodes.filter("depth > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("above"))

    def with_parent(df: DataFrame) -> DataFrame:
        near = df.filter("parent_shared and depth > 1").join(above, "parent")
        top = F.lit(root["conv_id"] if root else None).cast("long")
        rest = df.filter("not (parent_shared and depth > 1)").withColumn(
            "above", F.when(F.col("depth") == 1, top).when(F.col("depth") > 1, F.col("conv_id")))
        return near.unionByName(rest.select(*near.columns))

    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    alone = tails.select(
        F.col("c").alias("conv_id"), "depth", "parent", "parent_shared", one.alias("n_convs"),
        F.when(F.col("is_end"), zero).otherwise(one).alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"),
        F.when(F.col("is_end"), F.sha2(F.col("c").cast("string").cast("binary"), 256)).otherwise(F.lit(NO_ENDS)).alias("ends_sha256"))
    grouped = nodes.join(sums, "node").select(
        "conv_id", "depth", "parent", "parent_shared", "n_convs", F.coalesce("n_children", zero).alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))
    found = with_parent(grouped).unionByName(with_parent(alone))
    return found.withColumnRenamed("above", "parent_conv_id").select(*COLUMNS)


# --- the contract's rebuilt conversations -------------------------------------------------------------------

GROUP, HEADS = 5, 9


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``PREFIXES`` of every conversation c after its first h turns were replaced by those of c - c % 5.

    h is crc32 of c's decimal digits, modulo 9. A place in a conversation keeps its number, so no row needs to know
    another: own turns stay from place h on, and the first conversation's turns below h are copied to the others.
    """
    turns = cut(turns_of(conversations))
    ids = cut(conversations.select(F.col("conv_id").cast("long").alias("c")).filter("c is not null").distinct())

    def head(c):
        return F.crc32(c.cast("string").cast("binary")) % HEADS

    own = turns.filter(F.col("pos") >= head(F.col("c")))
    first = turns.filter((F.col("pos") < HEADS - 1) & (F.col("c") % GROUP == 0))
    near = F.sequence(F.col("c") - (GROUP - 1), F.col("c") + (GROUP - 1))
    copies = first.withColumn("to", F.explode(near)).filter(
        (F.col("to") - F.col("to") % GROUP == F.col("c")) & (F.col("pos") < head(F.col("to"))))
    copies = copies.select(F.col("to").alias("c"), "pos", "digest", "size").join(ids, "c", "left_semi")
    return prefixes(own.unionByName(copies), ids)


def plain(conversations: DataFrame) -> DataFrame:
    """``PREFIXES`` of conversations as they are."""
    ids = conversations.select(F.col("conv_id").cast("long").alias("c")).filter("c is not null").distinct()
    return prefixes(turns_of(conversations), ids)
