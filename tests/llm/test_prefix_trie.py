"""The prefix trie against a brute-force trie, with sketches from empty to overfull and over many partitions."""

import hashlib
import random
import zlib

import pytest

from tablevault.llm import prefix_trie


def ordered(rows):
    """conv_id -> [(role, text)], null turns first, equal turns as the operator orders texts that are short ASCII."""
    out = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            out.setdefault(conv, []).append(((turn is not None, turn or 0, role or ""), role or "", text or ""))
    return {c: [(r, t) for _, r, t in sorted(turns, key=lambda x: x[0])] for c, turns in out.items()}


def rebuilt(conversations):
    out = {}
    for c, own in conversations.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = conversations.get(base, [])[:h] + own[h:]
    return out


def brute(conversations):
    members, ends = {}, {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        kids = children.get(p, [])
        own = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        leaves[p] = sum(leaves[k] for k in kids) if kids else 1
        saved[p] = own + sum(saved[k] for k in kids)
    rows = []
    for p, m in members.items():
        ids = ",".join(map(str, sorted(ends.get(p, []))))
        rows.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves[p],
                     saved[p], hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(rows, key=str)


def got(df):
    assert df.columns == list(prefix_trie.COLUMNS)
    return sorted((tuple(r) for r in df.collect()), key=str)


SCHEMA = "conv_id long, turn long, role string, text string, c string, node string, digest string, size string"


def drawn(seed):
    rng = random.Random(seed)
    rows = [(None, 0, "user", "no conversation")]
    for conv in [*range(-7, 60), 1000]:
        n = 200 if conv in (5, 7) else rng.randint(1, 12)
        for i in range(n):
            role = rng.choice(["user", "assistant", None])
            # equal turns have unequal roles, else their order is the operator's own
            text = rng.choice(["ja", "é", "", None]) if conv not in (5, 7) else f"{i % 3}"
            rows.append((conv, i if rng.random() < 0.95 or i else None, role, text))
    return rows


@pytest.mark.parametrize(("partitions", "bits"), [(1, None), (6, 1), (40, 3), (9, 12)])
def test_trie(spark, partitions, bits):
    rows = drawn(partitions)
    df = spark.createDataFrame([(*r, *["clash"] * 4) for r in rows], SCHEMA)
    saved = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert got(prefix_trie.trie(prefix_trie.rebuilt(df), bits)) == brute(rebuilt(ordered(rows)))
        if bits == 3:
            assert got(prefix_trie.trie(prefix_trie.plain(df), bits)) == brute(ordered(rows))
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)


def test_screening_never_hides_a_shared_prefix(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = prefix_trie.screened(prefix_trie.rebuilt(df)).cache()
    counts = rows.groupBy("node").count()
    assert rows.filter("not shared").join(counts.filter("count > 1"), "node").count() == 0
    single = rows.join(counts.filter("count = 1"), "node").count()
    assert rows.filter("not shared").count() >= 0.95 * single  # tails are proven single and stay where they are


def test_whole_table_and_empty_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert got(prefix_trie.trie(prefix_trie.rebuilt(df))) == brute(rebuilt(ordered(rows)))
    assert prefix_trie.trie(prefix_trie.rebuilt(df.limit(0))).count() == 0


def test_turnless_conversations_and_long_texts(spark):
    # a conversation of one turn whose own turns all fall below h, and whose group's first one does not exist
    alone = next(c for c in range(1, 1000) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    rows = [(alone, 0, "user", "gone"), (5005, 0, "user", "x" * 300_000), (5006, 0, "user", "x" * 300_000 + "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert got(prefix_trie.trie(prefix_trie.rebuilt(df))) == brute(rebuilt(ordered(rows)))
