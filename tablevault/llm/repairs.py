"""Conversation repair by weighted CYK parsing over spans of turns.

The wanted role initials are ``(s?(ua)+)?``. Its automaton has the states start, after s, after u and after a; the repair
grammar, in Chomsky normal form, has a nonterminal for each pair of states that a span of turns can lead through:

    N[p, r] -> N[p, q] N[q, r]             a span is two shorter spans
    N[p, q] -> turn                        kept (0), given another role (1), or deleted (2; the state stays)
    N[p, q] -> nothing                     turns inserted (5 each)

Insertions are closed first: the cells of the empty span are the cheapest runs of insertions between two states,
and every turn's cells take them in before and after it, so that no longer span needs an empty part. A cell
holds the least (cost, audit) with which its nonterminal spans the turns. Two audits of one cost never begin one with
the other (more insertions cost more), so that the least audit of a span is made of least audits of its parts.

The chart is filled bottom-up by span length: 1, 2, 4, 8 and so on. Because the nonterminals are pairs of states, every
split of a span yields the same cells, and the chart needs only one of them; a conversation of n turns takes n
combinations instead of n cubed. The same law carries it over partitions: a conversation that lies in several
has a chart in each, and their topmost cells combine in order, a bounded number at a time.

Defined results: a null conversation id is a conversation of its own; null roles and texts are one space, null turns
come first and count for no gap; equal turns are ordered as ``turns.in_order`` says; roles are known by their
first letter as it stands (an empty role has none), so "System" can only be renamed or deleted and a kept role keeps its name;
rows equal in all columns are turns of their own (later ones are duplicates); an empty table has no conversations;
other columns do not matter, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablevault.llm.common import cut
from tablevault.llm.turns import id_key, in_order, ranked

KEEP, RENAME, DELETE, INSERT, UNFINISHED = 0, 1, 2, 5, 5
STATES = "0123"  # start, after s, after u, after a
STEPS = {("0", "s"): "1", ("0", "u"): "2", ("1", "u"): "2", ("3", "u"): "2", ("2", "a"): "3"}
ENDS = ("0", "3")
ROLES = {"u": "user", "a": "assistant"}

BLANK, DUPLICATE, TRUNCATED = "b", "d", "t"
#: ASCII white space as the contract names it; anything else is content.
_CONTENT = re.compile(r"[^\x20\x09-\x0D]")
_LAST = re.compile(r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\Z")

#: A cell: cost, audit, and the states between the partitions that it spans.
Cell = tuple[int, str, str]
Cells = dict[str, Cell]


def _cheaper(cells: Cells, pair: str, cost: int, audit: str) -> None:
    held = cells.get(pair)
    if held is None or (cost, audit) < held[:2]:
        cells[pair] = (cost, audit, "")


def join(left: Cells, right: Cells, between: bool = False) -> Cells:
    """The cells of two spans in a row; ``between`` notes the state where they meet."""
    found: Cells = {}
    for a, (cost_a, audit_a, path_a) in left.items():
        q = a[1]
        for r in STATES:
            b = right.get(q + r)
            if b is None:
                continue
            pair = a[0] + r
            held = found.get(pair)
            cost = cost_a + b[0]
            if held is None or cost <= held[0]:
                audit = audit_a + b[1]
                if held is None or cost < held[0] or audit < held[1]:
                    found[pair] = (cost, audit, path_a + q + b[2] if between else "")
    return found


def _closure() -> Cells:
    """Insertions alone: the empty span."""
    cells: Cells = {p + p: (0, "", "") for p in STATES}
    for (p, role), q in STEPS.items():
        if role in ROLES:
            _cheaper(cells, p + q, INSERT, "I")
    while True:
        wider = join(cells, cells)
        if wider == cells:
            return cells
        cells = wider


EMPTY = _closure()


@functools.cache
def turn_cells(initial: str, fault: str) -> Cells:
    """The cells of one turn, insertions around it included."""
    cells: Cells = {}
    for p in STATES:
        _cheaper(cells, p + p, DELETE, "D")
        if fault in (BLANK, DUPLICATE):
            continue
        more = UNFINISHED if fault == TRUNCATED else 0
        if (p, initial) in STEPS:
            _cheaper(cells, p + STEPS[p, initial], KEEP + more, "K")
        for role in ROLES:
            if (p, role) in STEPS:
                _cheaper(cells, p + STEPS[p, role], RENAME + more, "R")
    return join(join(EMPTY, cells), EMPTY)


def chart(kinds: list[tuple[str, str]]) -> Cells:
    """The topmost cells over the turns' (initial, fault), bottom-up by span length."""
    spans = [turn_cells(*k) for k in kinds] or [EMPTY]
    while len(spans) > 1:
        pairs = zip(spans[::2], spans[1::2], strict=False)
        spans = [join(a, b) for a, b in pairs] + (spans[-1:] if len(spans) % 2 else [])
    return spans[0]


@functools.lru_cache(maxsize=1 << 16)
def short_chart(kinds: tuple[tuple[str, str], ...]) -> Cells:
    """Charts of short conversations repeat; a worker remembers some of them."""
    return chart(list(kinds))


def best(cells: Cells) -> tuple[str, Cell]:
    """The pair from the start to an end with the least (cost, audit)."""
    pair = min(("0" + e for e in ENDS if "0" + e in cells), key=lambda x: cells[x][:2])
    return pair, cells[pair]


# --- faults and summaries -----------------------------------------------------------------------------

def fault(role: str, text: str, seen: bool) -> str:
    """The first fault of a turn: blank, duplicate, truncated or none."""
    if not _CONTENT.search(text):
        return BLANK
    if seen:
        return DUPLICATE
    return "" if _LAST.search(text)[1] in ".!?" else TRUNCATED


class Summary:
    """Counts over a run of turns in order; ``add`` takes one more, ``join`` the run that follows."""

    FIELDS = "n long, blank long, duplicate long, truncated long, illegal long, turns long, low string, high string, first string, last string"

    def __init__(self, *values):
        (self.n, self.blank, self.duplicate, self.truncated, self.illegal, self.turns, self.low, self.high,
         self.first, self.last) = values or (0, 0, 0, 0, 0, 0, None, None, None, None)

    def values(self) -> tuple:
        return (self.n, self.blank, self.duplicate, self.truncated, self.illegal, self.turns, self.low, self.high,
                self.first, self.last)

    @staticmethod
    def of(turn: int | None, initial: str, kind: str) -> Summary:
        return Summary(1, kind == BLANK, kind == DUPLICATE, kind == TRUNCATED, 0, int(turn is not None), turn, turn,
                       initial, initial)

    def join(self, after: Summary) -> Summary:
        if not self.n or not after.n:
            return after if after.n else self
        same = self.high is not None and self.high == after.low  # turns are in order, nulls first
        lows, highs = [x for x in (self.low, after.low) if x is not None], [x for x in (self.high, after.high) if x is not None]
        return Summary(self.n + after.n, self.blank + after.blank, self.duplicate + after.duplicate,
                       self.truncated + after.truncated,
                       self.illegal + after.illegal + (self.last + after.first not in ("su", "ua", "au")),
                       self.turns + after.turns - same, min(lows, default=None), max(highs, default=None),
                       self.first, after.last)

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


class Writer:
    """The digest of a repaired conversation, turn by turn."""

    def __init__(self):
        self.state, self.any, self.digest = "0", False, hashlib.sha256()

    def _put(self, role: str, text: str) -> None:
        self.digest.update(("\n" if self.any else "").encode() + role.encode() + b":" + text.encode())
        self.any = True

    def _step(self, role: str) -> None:
        self.state = STEPS[self.state, role]

    def _wanted(self) -> str:
        return "a" if self.state == "2" else "u"

    def edit(self, letters: Iterator[str], role: str | None = None, text: str | None = None) -> None:
        """Insertions up to the turn's own letter, then the turn; without a turn, the insertions that are left."""
        for letter in letters:
            if letter == "D":
                return
            if letter == "K":
                self._put(role, text)
                self._step(role[:1])
                return
            wanted = self._wanted()
            self._put(ROLES[wanted], "" if letter == "I" else text)
            self._step(wanted)
            if letter == "R":
                return


RESULT = ("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string,"
          " repaired_sha256 string")
NOTHING = hashlib.sha256(b"").hexdigest()


def _summed(kinds: list[tuple], turns: list) -> Summary:
    total = Summary()
    for (initial, kind), turn in zip(kinds, turns, strict=True):
        total = total.join(Summary.of(turn, initial, kind))
    return total


def repair(turns: list, roles: list[str], texts: list[str]) -> tuple:
    """The fields of ``RESULT`` for one conversation in order."""
    seen, kinds = set(), []
    for role, text in zip(roles, texts, strict=True):
        kinds.append((role[:1], fault(role, text, (role, text) in seen)))
        seen.add((role, text))
    total = _summed(kinds, turns)
    _, (cost, audit, _) = best(short_chart(tuple(kinds)) if len(kinds) <= 16 else chart(kinds))
    writer, letters = Writer(), iter(audit)
    for role, text in zip(roles, texts, strict=True):
        writer.edit(letters, role, text)
    writer.edit(letters)
    return (total.gaps(), int(total.blank), int(total.duplicate), int(total.truncated), int(total.illegal), cost, audit,
            writer.digest.hexdigest())


# --- over partitions ------------------------------------------------------------------------------------

EDGE = "pid int, idx long, turn long, role string, text string, gone boolean, digest binary, fault string"
#: Partitions' charts that combine in one task.
FAN = 32


def _digest(role: str, text: str) -> bytes:
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def _whole_and_edges(schema: T.StructType):
    """Results of the conversations inside a partition, rows of the two at its ends."""
    n_result = len(RESULT.split(","))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        types = None
        held, k, first, idx, seen = [], None, True, 0, set()

        def frame(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)],
                                              names=schema.names)

        def edge(row: tuple) -> tuple:
            nonlocal idx
            name, conv, turn, role, text, gone = row
            digest = None if gone else _digest(role, text)
            kind = None if gone else fault(role, text, digest in seen)
            out = (name, conv, *[None] * n_result, pid, idx, turn, role, text, gone, digest, kind)
            seen.add(digest)
            idx += 1
            return out

        def result(rows: list[tuple]) -> tuple:
            left = [r for r in rows if not r[5]]
            found = repair([r[2] for r in left], [r[3] for r in left], [r[4] for r in left])
            return (rows[0][0], rows[0][1], *found, *[None] * 8)

        for batch in batches:
            if types is None:
                from pyspark.sql.pandas.types import to_arrow_type

                types = [batch.schema.field(1).type if f.name == "conv_id" else to_arrow_type(f.dataType) for f in schema]
            out = []
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[0] != k:
                    if held:
                        out.append(result(held))
                    first = k is None
                    k, held = row[0], []
                    idx, seen = 0, set()
                if first:
                    out.append(edge(row))
                else:
                    held.append(row)
            if out:
                yield frame(out)
        if held:
            seen, idx = set(), 0
            for at in range(0, len(held), 1000):
                yield frame([edge(r) for r in held[at:at + 1000]])

    return run


CELLS = "cells array<struct<pair:string,cost:long,audit:string,path:string>>"
SPAN = f"k string, pid long, {Summary.FIELDS}, {CELLS}"
SPAN_NAMES = [f.strip().split(" ")[0] for f in f"k string, pid long, {Summary.FIELDS}, cells x".split(",")]


def _packed(cells: Cells) -> list[dict]:
    return [{"pair": p, "cost": c, "audit": a, "path": s} for p, (c, a, s) in cells.items()]


def _unpacked(cells) -> Cells:
    return {c["pair"]: (int(c["cost"]), c["audit"], c["path"]) for c in cells}


def _span_row(key: tuple, total: Summary, cells: list[dict]) -> pd.DataFrame:
    values = list(total.values())
    values[6:8] = [None if x is None else str(x) for x in values[6:8]]  # as text: pandas has no null integer
    return pd.DataFrame([(key[0], int(key[1]), *values, cells)], columns=SPAN_NAMES)


def _span(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The chart of one conversation's turns in one partition (from initials and faults alone)."""
    rows = rows[rows["idx"] >= 0].sort_values("idx")
    kinds = list(zip(rows["initial"], rows["fault"], strict=True))
    total = _summed(kinds, [None if t is None else int(t) for t in rows["turn"]])
    cells = _packed(chart(kinds))
    return _span_row(key, total, cells)


def _joined(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Up to ``FAN`` spans in order as one."""
    total, cells = Summary(), None
    for r in rows.sort_values("pid").itertuples(index=False):
        total = total.join(Summary(*r[2:8], *[None if x is None else int(x) for x in r[8:10]], *r[10:12]))
        cells = _unpacked(r.cells) if cells is None else join(cells, _unpacked(r.cells), between=True)
    return _span_row(key, total, _packed(cells))


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each conversation from rows sorted by k, pid, idx; a partition's audit precedes its rows.

    The digest is sequential by nature: a conversation's text streams through one task, a batch at a time.
    """
    k, writer, letters = None, None, iter("")
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            if row.idx < 0:
                if row.k != k:
                    if writer is not None:
                        writer.edit(letters)
                        out.append((k, writer.digest.hexdigest()))
                    k, writer, letters = row.k, Writer(), iter("")
                writer.edit(letters)
                letters = iter(row.text)
            else:
                writer.edit(letters, row.role, row.text)
        if out:
            yield pd.DataFrame(out, columns=["k", "repaired_sha256"])
    if writer is not None:
        writer.edit(letters)
        yield pd.DataFrame([(k, writer.digest.hexdigest())], columns=["k", "repaired_sha256"])


def _across(edges: DataFrame) -> DataFrame:
    """Results (k and ``RESULT``) of conversations that may lie in several partitions."""
    # a partition's first row of its kind is a duplicate if an earlier partition has one: at most a row a partition
    firsts = edges.filter(~F.col("gone") & ~F.col("fault").isin(BLANK, DUPLICATE)).select("k", "pid", "idx", "digest")
    late = (firsts.withColumn("low", F.min("pid").over(Window.partitionBy("k", "digest"))).filter("pid > low")
            .select("pid", "k", "idx", F.lit(DUPLICATE).alias("late")))
    turns = cut(edges.join(late, ["pid", "k", "idx"], "left")
                .select("k", "pid", "idx", "turn", "role", "text", "gone", F.coalesce("late", "fault").alias("fault")))
    few = turns.filter("not gone").select("k", "pid", "idx", F.col("turn").cast("string").alias("turn"),
                                          F.substring("role", 1, 1).alias("initial"), "fault")
    # a partition without a turn has an empty span
    few = few.unionByName(turns.groupBy("k", "pid").agg(F.lit(-1).cast("long").alias("idx")), allowMissingColumns=True)
    spans = cut(few.groupBy("k", "pid").applyInPandas(_span, SPAN))
    top, many = spans, int(spans.agg(F.max("pid")).first()[0] or 0) + 1
    while many > 1:
        top = cut(top.groupBy("k", F.floor(F.col("pid") / FAN).alias("pid")).applyInPandas(_joined, SPAN))
        many = -(-many // FAN)
    # the path of the best cell names the states at the ends of each partition's span
    ends = F.filter("cells", lambda c: c["pair"].isin(*["0" + e for e in ENDS]))
    least = F.array_min(F.transform(ends, lambda c: F.struct(c["cost"], c["audit"], c["path"], c["pair"])))
    top = top.select("k", *SPAN_NAMES[2:-1], least.alias("b"))
    states = F.concat(F.lit("0"), F.col("b.path"), F.substring("b.pair", 2, 1)).alias("states")
    number = F.row_number().over(Window.partitionBy("k").orderBy("pid"))
    placed = spans.select("k", "pid", "cells", number.alias("at")).join(top.select("k", states), "k")
    pair = F.substring(F.col("states"), F.col("at"), F.lit(2))
    chosen = F.filter("cells", lambda c: c["pair"] == pair)[0]["audit"]
    heads = placed.select("k", F.col("pid").cast("int").alias("pid"), F.lit(-1).cast("long").alias("idx"),
                          F.lit(None).cast("string").alias("role"), chosen.alias("text"))
    stream = heads.unionByName(turns.filter("not gone").select("k", "pid", "idx", "role", "text"))
    stream = stream.repartition("k").sortWithinPartitions("k", "pid", "idx")
    digests = stream.mapInPandas(_digests, "k string, repaired_sha256 string")
    gaps = F.coalesce(F.col("high").cast("long") - F.col("low").cast("long") + 1 - F.col("turns"), F.lit(0))
    return top.join(digests, "k").select(
        "k", gaps.cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal",
        F.col("b.cost").alias("cost"), F.col("b.audit").alias("audit"), "repaired_sha256")


def repaired(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text, gone): its id and the fields of ``RESULT``.

    Rows marked ``gone`` are no turns; they only stand for their conversation.
    """
    rows = rows.select(id_key(F.col("conv_id")).alias("k"), "conv_id", F.col("turn").cast("long").alias("turn"), "role",
                       "text", "gone")
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = T.StructType.fromDDL(f"k string, conv_id {kind}, {RESULT}, {EDGE}")
    found = cut(in_order(ranked(rows)).mapInArrow(_whole_and_edges(schema), schema))
    names = [f.strip().split(" ")[0] for f in RESULT.split(",")]
    inner = found.filter("idx is null").select("conv_id", *names)
    edges = found.filter("idx is not null")
    ids = edges.groupBy("k").agg(F.first("conv_id").alias("conv_id"))
    outer = _across(edges.drop("conv_id", *names)).join(ids, "k").select("conv_id", *names)
    return inner.unionByName(outer)


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage by crc32 of ``conv_id:turn``: dropped rows are marked ``gone``, repeated ones stand twice."""
    space = F.lit(" ")
    conv, turn = (F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn"))
    kind = (F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")) % 20).alias("kind")
    role, text = (F.coalesce(F.col(c).cast("string"), space).alias(c) for c in ("role", "text"))
    rows = conversations.select("conv_id", "turn", role, text, kind)
    rows = rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    left = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    gone = F.col("kind") == 0
    return rows.select("conv_id", "turn", F.when(gone, "").when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                       F.when(gone, "").otherwise(left).alias("text"), gone.alias("gone"))
