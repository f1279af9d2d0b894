"""Removal of long repeated byte strings by bucket-pointer refinement.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts anywhere else. As in suffix
sorting by bucket pointers, positions start in buckets of equal q-grams (q = 25) and buckets are refined by
the bucket at a later offset: the pair of buckets at i and i + 25 is the bucket of 50 bytes, the pair at i and
i + 50 that of 100, and the same step used once more gives 200. Buckets are named by 64-bit mixes of the
pair, so that a name depends on the bytes alone and needs no global sort.

Not every position leaves its document. The 200-byte window at p is represented by the q-gram in it with the
smallest name (the leftmost of equals), which depends on the window's bytes alone: equal windows have equal
representatives at equal offsets. Neighbouring windows share theirs, about one q-gram in 88 is one, and its
windows lo..hi are named together by (bucket of window lo, bucket of window hi, hi - lo), 128 bits that fix
every byte from lo to hi + 200. Then, in Spark:

1. q-gram buckets with one member are dropped: no window of theirs is repeated;
2. of the rest, runs of windows whose common name occurs twice or more are repeated as a whole;
3. a bucket with several different runs is refined: one run of each name sends its bytes. Buckets of up to
   ``TOGETHER`` runs are compared window by window in one task. In larger ones a run's windows are halved by
   their offset to the representative, and each half goes to the bucket of the bytes that all windows of
   that half share; equal halves are repeated as a whole, and different halves are refined in the same way,
   until a half is one window. Rows grow by two a step, not by windows;
4. each document drops what its repeated windows cover.

Counts are added up before shuffles; no task holds the members of a bucket, which may be a third of all rows.

Defined results: a null text is empty; texts shorter than ``LENGTH`` keep all bytes; repeated rows are
copies of each other, so long ones lose everything; other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablevault.llm.common import cut, once, row_key, text_of

LENGTH = 200
GRAM = 25
TOGETHER = 500

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_S29, _S31, _S32 = np.uint64(29), np.uint64(31), np.uint64(32)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The name of a bucket pair."""
    x = a * _A + (b ^ (b >> _S29)) * _B
    x ^= x >> _S31
    x *= _C
    x ^= x >> _S29
    return x


def gram_buckets(data: np.ndarray) -> np.ndarray:
    """The bucket of the 25 bytes at each position."""
    n = len(data) - GRAM + 1
    words = np.empty(len(data) - 7, dtype=np.uint64)
    for k in range(8):
        part = data[k:k + (len(data) - k) // 8 * 8].view("<u8")
        words[k::8] = part[:len(words[k::8])]
    first = _pair(words[:n], words[8:8 + n])
    return _pair(first, _pair(words[16:16 + n], data[24:24 + n].astype(np.uint64)))


def window_buckets(grams: np.ndarray) -> np.ndarray:
    """The bucket of the 200 bytes at each position, by three rounds of pairs."""
    buckets, step = grams, GRAM
    while step < LENGTH:
        buckets = _pair(buckets[:-step], buckets[step:])
        step *= 2
    return buckets


def representatives(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of representatives, and the first and last window of each."""
    width = LENGTH - GRAM + 1
    n = len(grams) - width + 1
    keyed = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    # sliding minimum: from the left in blocks of the width, from the right, and the smaller of both
    blocks = -(-len(keyed) // width)
    padded = np.full(blocks * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:len(keyed)] = keyed
    shaped = padded.reshape(blocks, width)
    left = np.minimum.accumulate(shaped, axis=1).ravel()
    right = np.minimum.accumulate(shaped[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(right[:n], left[width - 1:width - 1 + n])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.concatenate((first[1:] - 1, [n - 1]))
    return at[first], first, last


def runs_of(text: bytes) -> tuple[np.ndarray, ...] | None:
    """Per representative: its q-gram bucket, the names of its first and last window, lo, and hi - lo."""
    if len(text) < LENGTH:
        return None
    grams = gram_buckets(np.frombuffer(text, dtype=np.uint8))
    windows = window_buckets(grams)
    at, lo, hi = representatives(grams)
    return grams[at].view(np.int64), windows[lo].view(np.int64), windows[hi].view(np.int64), lo, hi - lo


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        parts = [(k, r) for k, t in zip(batch["key"], batch["data"], strict=True) if (r := runs_of(bytes(t))) is not None]
        if parts:
            columns = [np.concatenate(c) for c in zip(*[r for _, r in parts], strict=True)]
            keys = np.repeat(np.array([k for k, _ in parts], dtype=object), [len(r[0]) for _, r in parts])
            yield pd.DataFrame({"key": keys, **dict(zip(("gram", "first", "last", "lo", "more"), columns, strict=True))})


def _spans(key, lo: int, hits: np.ndarray) -> list[tuple]:
    """Stretches of windows, as (key, start, end) of the bytes that they cover."""
    if not len(hits):
        return []
    breaks = np.flatnonzero(np.diff(hits) > 1)
    starts, ends = hits[np.concatenate(([0], breaks + 1))], hits[np.concatenate((breaks, [len(hits) - 1]))]
    return [(key, lo + int(a), lo + int(b) + LENGTH) for a, b in zip(starts, ends, strict=True)]


def _refine_together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a partition sorted by bucket; compares a bucket's runs window by window."""
    gram, held = None, []

    def done() -> list[tuple]:
        seen: Counter = Counter()
        for _, _, _, run in held:
            seen.update(run[i:i + LENGTH] for i in range(len(run) - LENGTH + 1))
        out = []
        for key, lo, n, run in held:
            if n == 1:
                hits = [i for i in range(len(run) - LENGTH + 1) if seen[run[i:i + LENGTH]] > 1]
                out += _spans(key, lo, np.array(hits, dtype=np.int64))
        return out

    names = ["key", "start", "end"]
    for batch in batches:
        out = []
        for g, key, lo, n, run in zip(batch["bucket"], batch["key"], batch["lo"], batch["n"], batch["run"], strict=True):
            if g != gram:
                out += done()
                gram, held = g, []
            held.append((key, lo, n, bytes(run)))
        if out:
            yield pd.DataFrame(out, columns=names)
    if out := done():
        yield pd.DataFrame(out, columns=names)


OPEN = "bucket long, key binary, lo int, n long, at int, low int, high int, run binary"


def _opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs as they leave their documents, with the place of their representative."""
    for batch in batches:
        at = [int(representatives(gram_buckets(np.frombuffer(bytes(r), dtype=np.uint8)))[0][0]) for r in batch["run"]]
        yield batch.assign(at=at, low=0, high=LENGTH - GRAM + 1)[[f.split()[0] for f in OPEN.split(", ")]]


def _halves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The two halves of each run's windows, by offset to the representative, each in its own bucket."""
    for batch in batches:
        out = []
        for bucket, key, lo, n, at, low, high, run in batch.itertuples(index=False):
            run, middle = bytes(run), (low + high) // 2
            for a, b in ((low, middle), (middle, high)):
                least, most = max(a, at - (len(run) - LENGTH)), min(b - 1, at)
                if least > most:
                    continue
                start = at - most
                shared = run[at - a:at - b + 1 + LENGTH]
                name = xxhash.xxh3_64_intdigest(shared, seed=(bucket ^ a << 8 ^ b) & 0xFFFFFFFFFFFFFFFF) - 2**63
                out.append((name, key, lo + start, n, at - start, a, b, run[start:at - least + LENGTH]))
        yield pd.DataFrame(out, columns=batch.columns)


def _refined(opened: DataFrame, together: int) -> list[DataFrame]:
    """Spans (key, start, end) of the repeated windows of runs that are alone of their name in their bucket."""
    spans = []
    while True:
        sizes = cut(opened.groupBy("bucket").agg(F.count("*").alias("runs")).filter("runs > 1"))
        mixed = cut(opened.join(sizes, "bucket"))
        small = mixed.filter(F.col("runs") <= together).select("bucket", "key", "lo", "n", "run")
        spans.append(small.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(
            _refine_together, "key binary, start int, end int"))
        large = mixed.filter((F.col("runs") > together) & (F.col("high") - F.col("low") > 1)).drop("runs")
        if large.isEmpty():
            return spans
        halves = cut(large.mapInPandas(_halves, OPEN))
        same = cut(halves.groupBy("bucket", "run").agg(
            F.sum("n").alias("n"), F.min(F.struct("key", "lo", "at", "low", "high")).alias("one")))
        twice = same.filter("n > 1").select("bucket", "run")
        spans.append(halves.filter("n = 1").join(twice, ["bucket", "run"], "left_semi").select(
            "key", F.col("lo").alias("start"), (F.col("lo") + F.octet_length("run")).alias("end")))
        opened = same.select("bucket", "one.key", "one.lo", "n", "one.at", "one.low", "one.high", "run")


def repeated_spans(docs: DataFrame, id_col: str, text_col: str, together: int = TOGETHER) -> DataFrame:
    """(key, start, end) of stretches of bytes covered by repeated windows, per key; they may overlap."""
    texts = docs.select(row_key(id_col, text_col).alias("key"), F.encode(text_of(text_col), "UTF-8").alias("data"))
    runs = texts.filter(F.octet_length("data") >= LENGTH).mapInPandas(
        _runs, "key binary, gram long, first long, last long, lo int, more int")
    runs = cut(runs)
    # sums are cut before joins: with plain exchanges on both sides Spark splits a hot bucket
    shared = cut(runs.groupBy("gram").agg(F.count("*").alias("members")).filter("members > 1").select("gram"))
    runs = cut(runs.join(shared, "gram", "left_semi"))
    names = cut(runs.groupBy("gram", "first", "last", "more").agg(
        F.count("*").alias("n"), F.min(F.struct("key", "lo")).alias("one")))
    end = F.col("lo") + F.col("more") + LENGTH
    whole = (runs.join(names.filter("n > 1").select("gram", "first", "last", "more"), ["gram", "first", "last", "more"],
                       "left_semi").select("key", F.col("lo").alias("start"), end.alias("end")))
    mixed = cut(names.groupBy("gram").agg(F.count("*").alias("different")).filter("different > 1"))
    asked = names.join(mixed, "gram").select("gram", "n", "one.key", "one.lo", "more")
    lists = cut(asked.groupBy("key").agg(F.collect_set(F.struct("gram", "n", "lo", "more")).alias("asked")))
    one = (texts.join(lists, "key").select("key", "data", F.explode("asked").alias("a"))
           .select(F.col("a.gram").alias("bucket"), "key", "a.lo", "a.n",
                   F.substring("data", F.col("a.lo") + 1, F.col("a.more") + LENGTH).alias("run")))
    one = one.dropDuplicates(["bucket", "key", "lo"])  # equal rows share a key and send the same runs
    for part in _refined(cut(one.mapInPandas(_opened, OPEN)), together):
        whole = whole.unionByName(part)
    return whole


def _rest(data: bytes, spans) -> tuple[bytes, int]:
    """The bytes outside the spans, and the number of maximal removed runs."""
    kept, at, runs, end = [], 0, 0, -1
    for start, stop in spans:
        if start > end:
            runs += 1
            kept.append(data[at:start])
        end = max(end, stop)
        at = end
    kept.append(data[at:])
    return b"".join(kept), runs


FIELDS = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   together: int = TOGETHER) -> DataFrame:
    """Structs ``row`` (the columns of ``docs``) and ``rest`` (``FIELDS``; its ``kept`` are the remaining bytes)."""
    spans = repeated_spans(docs, id_col, text_col, together)
    # overlaps merge here: equal rows and shared windows give the same span more than once
    lists = cut(spans.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans")))

    @F.pandas_udf(FIELDS)
    def rest(data: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for d, s in zip(data, spans, strict=True):
            d = bytes(d)
            kept, runs = _rest(d, [(x["start"], x["end"]) for x in s] if s is not None else [])
            out.append((len(d), len(d) - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept))
        return pd.DataFrame(out, columns=[f.split()[0] for f in FIELDS.split(", ")])

    df = docs.select(F.struct("*").alias("row"), row_key(id_col, text_col).alias("key")).join(lists, "key", "left")
    data = F.encode(text_of(f"row.`{text_col}`"), "UTF-8")
    return df.select("row", once(rest)(data, "spans").alias("rest"))
