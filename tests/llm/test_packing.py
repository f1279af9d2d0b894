"""Sum-of-squares packing: ids against the library, coverage, padding, and the level rule against brute force."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablevault.llm import packing, word_bpe

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

ODD = ["", " \n\t ", "İstanbul's", "H̱x é", "<|endoftext|> x", "don'T WE'LL it'S ' s !'s", "a\x00b\x85c​d",
       "́ͅ", "a" * 3000, "ſ ſ's K 'K", "١٢ ½ Ⅻ 中文 ok", "\U0001F600‍ x️ _a_b_"]


def library(texts):
    tokenizer = tokenizers.Tokenizer.from_file(TOKENIZER)
    return [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_word_ids_are_the_library_s(monkeypatch):
    rng = random.Random(1)
    pool = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ODD + ["".join(rng.choice(pool) if rng.random() < 0.3 else rng.choice("ab 'sS\n.!é1") for _ in range(30))
                   for _ in range(400)]
    with open(TOKENIZER, "rb") as f:
        coder = word_bpe.WordEncoder(f.read())
    want = library(texts)
    assert [x.tolist() for x in coder.encode(texts)] == want
    monkeypatch.setattr(word_bpe, "MEMORY", 5)  # the memory starts anew all the time
    monkeypatch.setattr(word_bpe, "STRETCH", 8)
    assert [x.tolist() for x in coder.encode(texts, batch_chars=16)] == want
    text = "one two\nthree " * 5
    assert "".join(word_bpe.stretches(text, 8)) == text and len(list(word_bpe.stretches(text, 8))) > 3


def sums(counts, window, size):
    """The sum of squares after each possible placement, by brute force."""
    found = {}
    for h in [0, *[x for x in range(1, window - size + 1) if counts[x]]]:
        after = counts.copy()
        if h:
            after[h] -= 1
        if h + size < window:
            after[h + size] += 1
        found[h] = int((after[1:] ** 2).sum())
    return found


def test_level_has_the_least_sum_of_squares():
    rng = random.Random(5)
    packer = packing.Packer(window=32, open_windows=10**9)
    for n in range(3000):
        size = rng.choice([3, 5, 7, 8, 13, 31, rng.randint(1, 31)])
        before = packer.counts.copy()
        options = sums(before, 32, size)
        best = min(options.values())
        assert packer.level(size) == max(h for h, s in options.items() if s == best)
        list(packer.add(n, np.arange(size, dtype=np.uint32)))
        assert packer.n_open == packer.counts.sum() == sum(map(len, packer.levels))


def check(rows, texts, window, end=1):
    """Every id of every document in exactly one piece; sequences gapless and full but for powers of two."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for doc, ids in zip(texts, library(texts.values()), strict=True):
        ids, at = [*ids, end], 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            piece = ids[at:at + r["length"]]
            assert (r["start"], r["doc_tokens"], len(piece)) == (at, len(ids), r["length"]) and piece
            assert r["ids_crc32"] == zlib.crc32(np.array(piece, dtype="<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert 0 < at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


@pytest.mark.parametrize(("window", "open_windows", "tasks"), [(2048, 2048, 3), (64, 8, 2), (16, 1, 1), (1, 4, 2)])
def test_pack(spark, window, open_windows, tasks):
    rng = random.Random(window)
    texts = {i: " ".join(rng.choice(["one", "two", "three", "unheardofwords", "4"]) for _ in range(rng.randint(0, 300)))
             for i in range(120)} | {1000 + i: t for i, t in enumerate(ODD)}
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, `offset` string").repartition(tasks)
    out = packing.pack(df, TOKENIZER, window=window, open_windows=open_windows)
    assert out.columns == ["doc_id", *packing.COLUMNS]
    assert check(out.collect(), texts, window) == 0


def test_defined_results(spark):
    rows = [(None, None), (None, "one"), (7, "one"), (7, "one"), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = packing.pack(df, TOKENIZER, with_ids=True).collect()
    ids = library(["one"])[0]
    whole = sorted(((r["doc_id"] is None, r["doc_id"]), r["ids"]) for r in got if r["length"] == r["doc_tokens"])
    assert sum(r["length"] for r in got) == 3 * (len(ids) + 1) + 2
    assert all(r["doc_tokens"] in (1, len(ids) + 1) for r in got) and whole
    assert packing.pack(df.limit(0), TOKENIZER).count() == 0


def test_whole_tables(small_docs, edge_docs, no_docs):
    out = packing.pack(small_docs, TOKENIZER)
    texts = {r["doc_id"]: r["text"] or "" for r in small_docs.collect()}
    assert check(out.collect(), texts, 2048) == 0
    got = packing.pack(edge_docs, TOKENIZER).agg(F.sum("length")).first()[0]
    assert got == sum(len(x) + 1 for x in library([r["text"] or "" for r in edge_docs.collect()]))
    assert packing.pack(no_docs, TOKENIZER).count() == 0
