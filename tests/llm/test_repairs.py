"""Conversation repair against an all-splits CYK chart, a search over edits, and SQL-free recounts of the faults."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from tablevault.llm import repairs

WANTED = re.compile(r"(s?(ua)+)?\Z")


def searched(kinds):
    """Least (cost, audit) by Dijkstra over (turns done, initials put out so far by the automaton)."""
    heap, done = [((0, ""), 0, "0")], set()
    while heap:
        (cost, audit), i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(kinds) and state in "03":
            return cost, audit
        nexts = {c: {"0": {"s": "1", "u": "2"}, "1": {"u": "2"}, "2": {"a": "3"}, "3": {"u": "2"}}[state].get(c) for c in "sua"}
        for c in "ua":
            if nexts[c]:
                heapq.heappush(heap, ((cost + 5, audit + "I"), i, nexts[c]))
        if i < len(kinds):
            initial, fault = kinds[i]
            heapq.heappush(heap, ((cost + 2, audit + "D"), i + 1, state))
            if fault not in ("b", "d"):
                more = 5 if fault == "t" else 0
                if nexts.get(initial):
                    heapq.heappush(heap, ((cost + more, audit + "K"), i + 1, nexts[initial]))
                for c in "ua":
                    if nexts[c]:
                        heapq.heappush(heap, ((cost + more + 1, audit + "R"), i + 1, nexts[c]))
    raise AssertionError


def all_splits(kinds):
    """CYK with plain nonterminals and every split: E deleted, U, A, S one turn, P = (ua)+, W = sP."""
    n = len(kinds)
    rules = [("E", "E", "E"), ("U", "U", "E"), ("U", "E", "U"), ("A", "A", "E"), ("A", "E", "A"), ("S", "S", "E"),
             ("S", "E", "S"), ("P", "U", "A"), ("P", "P", "P"), ("P", "P", "E"), ("P", "E", "P"), ("W", "S", "P")]
    cell = {}

    def put(i, j, name, value):
        if (i, j, name) not in cell or value < cell[i, j, name]:
            cell[i, j, name] = value
            return True
        return False

    def combine(i, j, splits):
        again = True
        while again:
            again = False
            for k in splits:
                for to, a, b in rules:
                    if (i, k, a) in cell and (k, j, b) in cell:
                        (x, y), (z, w) = cell[i, k, a], cell[k, j, b]
                        again |= put(i, j, to, (x + z, y + w))

    for i in range(n + 1):
        put(i, i, "U", (5, "I"))
        put(i, i, "A", (5, "I"))
        combine(i, i, [i])
        put(i, i, "E", (0, ""))
    for i, (initial, fault) in enumerate(kinds):
        put(i, i + 1, "E", (2, "D"))
        if fault not in ("b", "d"):
            more = 5 if fault == "t" else 0
            if initial in "sua":
                put(i, i + 1, initial.upper(), (more, "K"))
            for c in "UA":
                put(i, i + 1, c, (more + 1, "R"))
    for length in range(1, n + 1):
        for i in range(n - length + 1):
            combine(i, i + length, range(i, i + length + 1))
    return min(cell[0, n, name] for name in "EPW" if (0, n, name) in cell)


def test_charts_agree():
    rng = random.Random(3)
    for n in [*range(7)] * 60 + [20, 33, 64]:
        kinds = [(rng.choice("suaax"), rng.choice(["", "", "", "b", "d", "t"])) for _ in range(n)]
        want = searched(kinds)
        assert repairs.best(repairs.chart(kinds))[1][:2] == want
        if n < 7:
            assert all_splits(kinds) == want
        # any split of a span gives the same cells
        for at in {0, n // 3, n}:
            assert repairs.join(repairs.chart(kinds[:at]), repairs.chart(kinds[at:])) == repairs.chart(kinds)


def brute(rows):
    """The contract's columns per conversation id, row by row."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            if kind == 0:
                continue
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            turns += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        kinds, seen = [], set()
        for _, role, text in turns:
            body = text.strip(" \t\n\v\f\r")
            kinds.append((role[:1], "b" if not body else "d" if (role, text) in seen else "" if body[-1] in ".!?" else "t"))
            seen.add((role, text))
        numbers = {t[0] for t in turns} - {None}
        cost, audit = searched(kinds)
        lines, at, state = [], 0, "0"
        for letter in audit:
            role, text = turns[at][1:] if letter != "I" else ("", "")
            at += letter != "I"
            if letter == "D":
                continue
            if letter in "RI":
                role = "assistant" if state == "2" else "user"
            state = {"s": "1", "u": "2", "a": "3"}[role[0]]
            lines.append((role, text))
        assert WANTED.match("".join(r[0] for r, _ in lines))
        joined = "\n".join(f"{r}:{t}" for r, t in lines)
        out[conv] = (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0,
                     *[sum(k[1] == f for k in kinds) for f in "bdt"],
                     sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:])),
                     cost, audit, hashlib.sha256(joined.encode()).hexdigest())
    return out


NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def results(rows):
    got = rows.collect()
    out = {r["conv_id"]: tuple(r[n] for n in NAMES) for r in got}
    assert len(out) == len(got)
    return out


def drawn(seed, many, longest):
    rng = random.Random(seed)
    texts = ["Yes.", "no", "What?", "", "  \n", "é!", "ok.\n", "\xa0", "a. b"]
    rows = []
    for conv in [None, -3, *range(many)]:
        n = longest if conv == 1 else rng.randint(1, 9)
        for i in range(n):
            turn = rng.choice([None, i, i, i, i * 2, -i])
            rows.append((conv, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]),
                         rng.choice([*texts, None, f"This is {i}.", f"cut {i}"])))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, k string, pid string, gone string, cells string"


@pytest.mark.parametrize(("partitions", "fan"), [(1, 32), (7, 2), (40, 3)])
def test_repair(spark, monkeypatch, partitions, fan):
    monkeypatch.setattr(repairs, "FAN", fan)
    rows = drawn(partitions, 40, 150)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        df = spark.createDataFrame([(*r, *["clash"] * 4) for r in rows], SCHEMA)
        got = results(repairs.repaired(repairs.damaged(df)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    want = brute(rows)
    assert got.keys() == want.keys()
    for conv in want:
        assert got[conv] == want[conv], conv


def test_empty_table_and_dropped_conversations(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert repairs.repaired(repairs.damaged(df)).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    assert results(repairs.repaired(repairs.damaged(df))) == {gone: (0, 0, 0, 0, 0, 0, "", repairs.NOTHING)}


def test_long_texts_and_whole_table(spark):
    rows = [(1, 0, "user", "x " * 400_000 + "."), (1, 1, "assistant", "." * 300_000 + " " * 300_000), (2, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert results(repairs.repaired(repairs.damaged(df))) == brute(rows)
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert results(repairs.repaired(repairs.damaged(table))) == brute(rows)
