"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

A first pass counts in how many documents each three-word gram of the test items occurs. An item's
seeds are the rarer half, by rank, of its grams that occur at all, however many documents hold them. A
second pass finds the items' grams in every whole text and aligns the item locally with the words around
them, the places with seeds first, so copies with replaced, added or dropped words score nearly as exact
ones. Places that hold only other grams are aligned too: no count cuts off an item. A place is left out only
where the words it shares with the item, in any order, are too few for the score.

The items travel to the tasks in blocks of bounded size, one after the other; documents are never
shuffled. Work in a task is one document's words and one item's alignment at a time.

Defined results: null texts hold no words and match nothing; items without words match nothing, items of
one or two words are their own only gram; equal items each get a row; rows equal in id and text get the
same rows; among equal scores the first place counts; n_seeds is the number of seed places in the text, 0 where only
more frequent grams of the item stand; other columns do not matter.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from tablevault.llm.common import once

WORD = re.compile(r"[^\W_]+")
GRAM = 3
#: Share of the best possible alignment score from which a passage counts as a copy.
LEAST_SCORE = 0.6
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_BYTES = 16 << 20

HITS = "array<struct<item_id: long, score: double, start_word: int, end_word: int, n_seeds: int>>"


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def grams_of(words: list[str]) -> list[tuple[str, ...]]:
    n = min(GRAM, len(words))
    return list(zip(*[words[i:] for i in range(n)], strict=False)) if n else []


def align(words: np.ndarray, item: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of two word-id sequences, and the end of its place in ``words``.

    A row per item word; the gap along the row is a running maximum, so a row is a few array operations.
    """
    steps = np.arange(len(words)) * -GAP
    last = np.zeros(len(words), dtype=np.int64)
    best, end = 0, 0
    for w in item:
        diagonal = np.concatenate(([0], last[:-1])) + np.where(words == w, MATCH, MISMATCH)
        row = np.maximum(np.maximum(diagonal, last + GAP), 0)
        last = np.maximum.accumulate(row + steps) - steps
        top = int(last.max(initial=0))
        if top > best:
            best, end = top, int(last.argmax()) + 1
    return best, end


class Items:
    """A block of test items: grams, seeds and word ids."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.words = {i: words_of(text) for i, text in rows}
        self.ids = {w: n for n, w in enumerate(sorted({w for ws in self.words.values() for w in ws}))}
        self.coded = {i: np.array([self.ids[w] for w in ws]) for i, ws in self.words.items()}
        self.counts = {i: Counter(ws) for i, ws in self.words.items()}
        owners = defaultdict(set)
        for i, ws in self.words.items():
            for g in grams_of(ws):
                owners[g].add(i)
        self.owners = dict(owners)
        self.grams = frozenset(owners)
        self.seeds: dict[int, set[tuple]] = {}
        self.short: set[int] = {len(g) for g in self.grams}

    def choose_seeds(self, documents: dict[tuple, int]) -> None:
        """Each item's rarer half of the grams that occur, by the number of documents that hold them."""
        for i, ws in self.words.items():
            held = {g: documents[g] for g in grams_of(ws) if documents.get(g)}
            middle = sorted(held.values())[(len(held) - 1) // 2] if held else 0
            self.seeds[i] = {g for g, n in held.items() if n <= middle}

    def shared(self, i: int, words: Counter) -> int:
        """How many words of the item stand among ``words``; no alignment matches more."""
        return sum(min(n, words[w]) for w, n in self.counts[i].items())

    def found(self, words: list[str], among) -> set[tuple]:
        out = set()
        for n in self.short:
            out |= among & set(zip(*[words[i:] for i in range(n)], strict=False)) if n < GRAM else among.intersection(
                zip(words, words[1:], words[2:], strict=False))
        return out

    def hits(self, words: list[str], least: float) -> list[tuple]:
        held = self.found(words, self.grams)
        if not held:
            return []
        every = Counter(words)
        near = {i for g in held for i in self.owners[g]}
        near = {i for i in near if self.shared(i, every) / len(self.coded[i]) >= least}
        if not near:
            return []
        places = defaultdict(list)
        for n in {len(g) for g in held}:
            for at, g in enumerate(zip(*[words[i:] for i in range(n)], strict=False)):
                if g in held:
                    for i in self.owners[g] & near:
                        places[i].append((at, g in self.seeds[i]))
        coded = np.array([self.ids.get(w, -1) for w in words])
        out = []
        for i in sorted(places):
            item, at = self.coded[i], sorted(places[i])
            # an alignment above the bound spans less than the item's length times 1 + MATCH / -GAP
            reach = len(item) * (1 + MATCH // -GAP)
            parts = []
            start = 0
            while start < len(at):
                stop = start
                while stop + 1 < len(at) and at[stop + 1][0] - at[stop][0] <= 2 * reach:
                    stop += 1
                parts.append((not any(seed for _, seed in at[start:stop + 1]),
                              max(0, at[start][0] - reach), min(len(words), at[stop][0] + reach)))
                start = stop + 1
            best = (0, 0)
            for _, low, high in sorted(parts):
                bound = MATCH * self.shared(i, Counter(words[low:high]))
                if bound < best[0] or bound / (MATCH * len(item)) < least:
                    continue
                score, end = align(coded[low:high], item)
                best = max(best, (score, -(low + end)))
            score = best[0] / (MATCH * len(item))
            if score >= least:
                end = -best[1]
                low = max(0, end - reach)
                back, length = align(coded[low:end][::-1], item[::-1])
                out.append((i, float(score), end - length, end, sum(seed for _, seed in at)))
        return out


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ``block_bytes``; the driver holds one block at a time."""
    total = benchmark.agg(F.sum(F.octet_length(text_col) + 16)).first()[0] or 0
    blocks = -(-total // block_bytes)
    block = F.pmod(F.xxhash64(id_col, text_col), F.lit(max(1, blocks)))
    for b in range(blocks):
        rows = benchmark.filter(block == b).select(id_col, text_col).collect()
        yield sorted({(r[0], r[1] or "") for r in rows if r[0] is not None})


def prepared(docs: DataFrame, text_col: str, rows: list[tuple[int, str]]) -> Items:
    """The block's items with seeds chosen by counts over all documents."""
    items = Items(rows)
    if not items.grams:
        return items
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = shared.value
        every, seen = block.grams, Counter()
        for batch in batches:
            for text in batch["_text"]:
                seen.update(block.found(words_of(text), every))
        yield pd.DataFrame([("\x01".join(g), n) for g, n in seen.items()], columns=["gram", "n"]).astype(
            {"gram": "object", "n": "int64"})

    # at most the block's grams come back from a task, and from all of them together
    counted = (docs.select(F.col(text_col).alias("_text")).mapInPandas(count, "gram string, n long")
               .groupBy("gram").agg(F.sum("n").alias("n")).collect())
    items.choose_seeds({tuple(r["gram"].split("\x01")): r["n"] for r in counted})
    return items


def finder(docs: DataFrame, items: Items, least: float):
    """A function of a text column that returns the items it holds."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    @pandas_udf(HITS)
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        block = shared.value
        names = ("item_id", "score", "start_word", "end_word", "n_seeds")
        for texts in batches:
            yield pd.Series([[dict(zip(names, h, strict=True)) for h in block.hits(words_of(t), least)]
                             for t in texts], dtype=object)

    return once(hits)


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text_col: str = "text", least: float = LEAST_SCORE,
         block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document and item that it holds: score, place in words, seeds found."""
    out = None
    for rows in item_blocks(benchmark, item_col, item_text_col, block_bytes):
        items = prepared(docs, text_col, rows)
        hits = finder(docs, items, least)(F.col(text_col).cast("string"))
        part = docs.select(F.col(id_col).alias("doc_id"), hits.alias("h")).filter(F.size("h") > 0)
        part = part.select("doc_id", F.explode("h").alias("h")).select("doc_id", "h.*")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = docs.limit(0).select(F.col(id_col).alias("doc_id"), F.explode(F.array().cast(HITS)).alias("h")).select(
            "doc_id", "h.*")
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text", least: float = LEAST_SCORE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that hold no item, columns unchanged."""
    kept = docs
    for rows in item_blocks(benchmark, item_col, item_text_col, block_bytes):
        items = prepared(docs, text_col, rows)
        kept = kept.filter(F.size(finder(docs, items, least)(F.col(text_col).cast("string"))) == 0)
    return kept
