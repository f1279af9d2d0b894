"""Fertility rules, SentencePiece, decontamination, licenses, line chunks."""
import random
import re
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from tablevault.llm import decontamination, fertility, licenses, line_chunks, sentencepieces

MODEL = sentencepieces.MODEL


# --- quality rules ---

def base_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    inside = {j for i, w in enumerate(windows) if seen[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)),
            len(inside))


def test_fertility_base_measures_match_brute_force(small_docs, edge_docs):
    for docs in (small_docs, edge_docs):
        texts = {(r[0], r[1]) for r in docs.select("doc_id", "text").collect()}
        rows = fertility.judge(docs).collect()
        assert len(rows) == docs.count()
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        want = Counter((i, *(m := base_measures(t)), m[0] < 50 or 100 * m[4] > 50 * m[0]) for i, t in docs.select(
            "doc_id", "text").collect())
        assert Counter((r.doc_id, *(r[n] for n in names), r.base_failed) for r in rows) == want
        assert all(not (r.base_failed and r.kept) for r in rows) and texts


def test_fertility_keeps_labelled_good_and_rejects_symbols(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = fertility.judge(docs).join(labels, "doc_id").filter("not base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert all(good) and sum(bad) < 0.5 * len(bad)


def test_fertility_filter_keeps_columns(edge_docs, no_docs, small_docs):
    kept = fertility.keep_good(edge_docs)
    assert kept.columns == edge_docs.columns and all(r._m == "clash" for r in kept.collect())
    assert fertility.judge(no_docs).count() == fertility.keep_good(no_docs).count() == 0
    want = {r.doc_id for r in fertility.judge(small_docs).filter("kept").collect()}
    assert {r.doc_id for r in fertility.keep_good(small_docs).collect()} == want


def test_fallback_share_equals_sentencepieces_own():
    import sentencepiece

    v = fertility.Vocabularies(f"{fertility.FOLDER}/{fertility.RANKS}", fertility.PATTERN,
                               f"{fertility.FOLDER}/{fertility.FALLBACK}")
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for text in ("plain words", "日本語 🙂 текст\n", "𝔘𝔫𝔦 ß ê"):
        n = sum(sp.is_byte(i) for i in sp.encode(text))
        assert fertility.measure(text, v)[6] == pytest.approx(n / len(text.encode()))


# --- SentencePiece ---

TEXTS = ["", " ", "  two  spaces ", "\n", "x\n\ny", "<s> hi </s> <0x0A> <unk>", "😀 zß𝔘", "▁▁ a▁b", "a" * 3000, "\t\tif x:\n    y",
         "日本語テキスト", "é́ \u200b\u00a0x", "aaa   bbb    ccc", "http://www.x.com/?q=1&r=%20"]


def test_pieces_equal_sentencepiece_and_round_trip(spark, small_docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = TEXTS + [r.text for r in small_docs.limit(60).collect()] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    coded = sentencepieces.encode(df, parity_every=1)
    decoded = {r.doc_id: r for r in sentencepieces.decode(coded, "pieces.ids", "back").collect()}
    for i, t in enumerate(texts):
        r = decoded[i]
        assert r.pieces.ids == sp.encode(t or "") and r.pieces.n_tokens == len(r.pieces.ids)
        assert r.back == (t or "").replace("▁", " ") == sp.decode(r.pieces.ids)
        assert r.pieces.round_trip and r.pieces.parity
        assert r.pieces.n_byte_tokens == sum(sp.is_byte(x) for x in r.pieces.ids)


def _message(pieces, kind):
    import struct

    def field(number, data):
        return bytes([number << 3 | 2, *_varint(len(data))]) + data

    def _varint(n):
        out = []
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return [*out, n]

    body = b"".join(field(1, field(1, p.encode()) + bytes([2 << 3 | 5]) + struct.pack("<f", s) + bytes([3 << 3, t]))
                    for p, s, t in pieces)
    return body + field(2, bytes([3 << 3, kind])) + field(3, field(1, b"identity") + bytes([4 << 3, 1]))


def test_unigram_model_is_rebuilt():
    import sentencepiece

    pieces = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), ("▁", -2, 1), ("a", -3, 1), ("b", -3.5, 1), ("ab", -4, 1),
              ("▁ab", -5, 1), ("ba", -4.5, 1), ("▁a", -4.2, 1), ("aba", -6, 1)]
    data = _message(pieces, 1)
    model = sentencepieces.read_model(data)
    assert [p for p, _, _ in model.pieces] == [p for p, _, _ in pieces] and model.squeeze
    sp = sentencepiece.SentencePieceProcessor(model_proto=data)
    encoder = sentencepieces.Encoder(data)
    r = random.Random(1)
    texts = ["".join(r.choice("aab  ") for _ in range(r.randint(0, 30))) for _ in range(200)]
    for text, ids in zip(texts, encoder.encode([encoder.normal(t) for t in texts]), strict=True):
        assert ids.tolist() == sp.encode(text), text


def test_encoding_edges(edge_docs, no_docs):
    rows = sentencepieces.encode(edge_docs).collect()
    assert len(rows) == 10 and all(r.pieces.round_trip for r in rows)
    assert sentencepieces.encode(no_docs).count() == 0


def test_a_wrong_segmentation_never_goes_out(small_docs):
    with open(MODEL, "rb") as f:
        encoder = sentencepieces.Encoder(f.read())
    texts = [f"the {i} words of this text" for i in range(60)]
    of_letter = {p: i for i, (p, _, _) in enumerate(encoder.model.pieces)}
    # letter by letter: a round trip holds, the ids are not the model's
    encoder.encode = lambda normal: [np.array([of_letter[c] for c in t], dtype=np.int32) for t in normal]
    rows = sentencepieces.encoded(texts, encoder, sentencepieces.PARITY_EVERY)
    for text, (ids, n, _, whole, same) in zip(texts, rows, strict=True):
        assert ids.tolist() == encoder.reference.encode(text) and n == len(ids) and whole and same is False
    assert sentencepieces.encode(small_docs.limit(50)).filter("pieces.parity").count() == 50


# --- decontamination ---

ITEM = "the quick brown fox jumps over the lazy dog while seven small kings watch from the old stone wall tonight".split()


def test_alignment_finds_exact_and_edited_copies(spark):
    r = random.Random(3)
    filler = ["w%d" % r.randint(0, 500) for _ in range(400)]
    edited = list(ITEM)
    edited[4], edited[11] = "leaps", "tiny"
    edited.insert(8, "very")
    del edited[15]
    far = [w if i % 2 else "zz%d" % i for i, w in enumerate(ITEM)]
    docs = [(1, " ".join(filler[:100] + ITEM + filler[100:200])), (2, " ".join(filler[:50] + edited + filler[50:])),
            (3, " ".join(filler)), (4, " ".join(far + filler)), (5, None), (6, ""), (7, "The QUICK, brown."),
            (None, " ".join(ITEM))]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(10, " ".join(ITEM)), (11, None), (12, ""), (13, "quick"), (10, " ".join(ITEM))],
                                  "item_id long, text string")
    rows = {(r.doc_id, r.item_id): r for r in decontamination.find(docs, items).collect()}
    assert {k for k in rows if k[1] == 10} == {(1, 10), (2, 10), (None, 10)}
    assert rows[1, 10].score == 1.0 and (rows[1, 10].start_word, rows[1, 10].end_word) == (100, 100 + len(ITEM))
    assert 0.6 <= rows[2, 10].score < 1
    assert {k[0] for k in rows if k[1] == 13} == {1, 2, 4, 7, None}
    kept = decontamination.keep_clean(docs, items.filter("item_id = 10"))
    assert {r.doc_id for r in kept.collect()} == {3, 4, 5, 6, 7} and kept.columns == docs.columns
    # the same in many blocks
    many = decontamination.find(docs, items, block_bytes=20).collect()
    assert {(r.doc_id, r.item_id, r.score) for r in many} == {(*k, r.score) for k, r in rows.items()}


@pytest.mark.parametrize("copies", [17, 50, 1000])
@pytest.mark.parametrize("every", [4, 5, 6])
def test_an_edited_copy_in_many_documents_is_found_in_all(spark, copies, every):
    r = random.Random(copies + every)
    filler = lambda n: ["w%d" % r.randint(0, 5000) for _ in range(n)]
    item = ["i%d" % i for i in range(40)]
    edited = [f"zz{i}" if i % every == every - 1 else w for i, w in enumerate(item)]
    # a rarer piece of the item elsewhere must not hide the copies
    rows = [(i, " ".join(filler(30) + edited + filler(30))) for i in range(copies)]
    rows += [(copies, " ".join(filler(30) + item[:6] + filler(500) + edited))]
    rows += [(copies + 1 + i, " ".join(filler(60))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    found = decontamination.find(docs, items).collect()
    assert {x.doc_id for x in found} == set(range(copies + 1)) and all(x.score >= 0.6 for x in found)
    assert decontamination.keep_clean(docs, items).count() == 20


def test_alignment_equals_cell_by_cell():
    r = random.Random(9)
    for _ in range(60):
        a = [r.randint(0, 4) for _ in range(r.randint(0, 25))]
        b = [r.randint(0, 4) for _ in range(r.randint(1, 12))]
        h = [[0] * (len(a) + 1) for _ in range(len(b) + 1)]
        for i in range(1, len(b) + 1):
            for j in range(1, len(a) + 1):
                step = 2 if b[i - 1] == a[j - 1] else -1
                h[i][j] = max(0, h[i - 1][j - 1] + step, h[i - 1][j] - 1, h[i][j - 1] - 1)
        assert decontamination.align(np.array(a, dtype=int), np.array(b))[0] == max(map(max, h))


def test_decontamination_edges(spark, edge_docs, no_docs, small_docs):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    assert decontamination.keep_clean(edge_docs, items).count() == 10
    assert decontamination.find(no_docs, items).count() == 0
    assert decontamination.find(small_docs, items.limit(0)).count() == 0
    flat = lambda t: " ".join(decontamination.words_of(t))
    want = {(d.doc_id, i.item_id) for d in small_docs.collect() for i in items.collect()
            if f" {flat(i.text)} " in f" {flat(d.text)} "}
    found = {(r.doc_id, r.item_id) for r in decontamination.find(small_docs, items).collect()}
    assert want <= found


# --- licenses ---

def license_words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute_licenses(text):
    words = license_words(text)
    places = [(i, label) for phrase, label in licenses.PHRASES for i in range(len(words))
              if words[i:i + len(phrase.split())] == phrase.split()]
    base = {label for _, label in places}
    labels = set()
    lines = [license_words(x) for x in (text or "").split("\n")]
    sets = [(label, set(licenses.template_tokens(t))) for label, t in licenses.TEMPLATES]
    vocabulary = set().union(*[t for _, t in sets])
    lines = [x for x in lines if vocabulary & set(x)]
    for i in range(len(lines)):
        for k in range(1, licenses.LINES + 1):
            block = set(w for x in lines[i:i + k] for w in x)
            labels |= {label for label, t in sets if len(t & block) >= licenses.THRESHOLD * len(t) - 1e-9}
    starts = [i for i, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | labels)))


def test_licenses_match_brute_force(spark, edge_docs, no_docs):
    own = ["CC by cc BY, all RIGHTS reserved. general\npublic license", "Permission is hereby granted, free of charge,\nto any"
           " person obtaining a copy of this software and associated\ndocumentation files (the Software), to deal in the Software"
           " without restriction", "Licensed under the Apache License", "mit unter der Lizenz", "cc-by", "İcc by", None]
    docs = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string").unionByName(
        spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")).unionByName(
        edge_docs.select("doc_id", "text"))
    want = Counter((r.doc_id, *brute_licenses(r.text)) for r in docs.collect())
    got = licenses.scan(docs).collect()
    assert Counter(tuple(r)[:-1] for r in got) == want
    assert all(0 <= r.score <= 1 and (r.score > 0) == bool(r.labels) for r in got)
    assert licenses.scan(no_docs).count() == 0 and licenses.scan(edge_docs).count() == 10
    assert licenses.scan(docs, templates=()).filter("labels <> base_labels").count() == 0


# --- line chunks ---

def test_line_chunks_drop_a_shared_passage_but_for_its_first_place(spark):
    r = random.Random(11)
    line = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(8))
    passage = [line() for _ in range(40)]
    rows = []
    for i in range(30):
        own = [line() for _ in range(r.randint(3, 25))]
        at = r.randint(0, len(own))
        rows.append((i, "\n".join(own[:at] + (passage if i % 3 == 0 else []) + own[at:])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {x.doc_id: x for x in line_chunks.remove_repeated(docs, stats=True).collect()}
    texts = dict(rows)
    for i in range(30):
        before, after = texts[i].split("\n"), out[i].text.split("\n")
        if i % 3 or i == 0:
            assert out[i].text == texts[i] and out[i].n_removed == 0
        else:
            assert out[i].n_removed >= 25 and len(before) - len(after) == out[i].n_removed
            assert not (Counter(before) - Counter(after)) - Counter(passage)  # own lines stay
    places = line_chunks.repeated(docs, "doc_id", "text").collect()
    assert all(p.end - p.start >= 1 for p in places)


def test_line_chunk_boundaries_shift_with_the_text(spark):
    lines = [f"line {i} of the passage" for i in range(200)]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(["x", "y", "z", *lines]))], "doc_id long, text string")
    found = line_chunks.chunks(docs, "doc_id", "text").collect()
    one = {(c.start, c.end) for c in found if c.id == 1 and c.start > 10}
    two = {(c.start - 3, c.end - 3) for c in found if c.id == 2 and c.start > 13}
    assert one == two and one


def test_line_chunk_edges(spark, edge_docs, no_docs):
    out = line_chunks.remove_repeated(edge_docs)
    assert out.columns == edge_docs.columns
    same = lambda df: Counter(tuple(r) for r in df.collect())
    assert same(out) == same(edge_docs)  # no multi-line chunk with content is repeated
    assert line_chunks.remove_repeated(no_docs, stats=True).count() == 0
    body = "\n".join(f"a line of some length number {i}" for i in range(50))
    rows = [(1, body), (1, body), (2, body), (None, body), (3, body + "\n" + body)]
    got = {(r.doc_id, r.n_removed > 0) for r in line_chunks.remove_repeated(
        spark.createDataFrame(rows, "doc_id long, text string"), stats=True).collect()}
    assert got == {(None, False), (1, True), (2, True), (3, True)}


def test_line_chunk_result_is_the_lines_outside_the_places(small_docs):
    docs = small_docs.select("doc_id", "text")
    gone = line_chunks.repeated(docs, "doc_id", "text")
    key = line_chunks.row_key("doc_id", "text")
    by_key = {}
    for r in gone.collect():
        by_key.setdefault(bytes(r.key), set()).update(range(r.start, r.end + 1))
    rest = {r.doc_id: r.text for r in line_chunks.remove_repeated(docs).collect()}
    for r in docs.withColumn("key", key).collect():
        drop = by_key.get(bytes(r.key), set())
        assert rest[r.doc_id] == "\n".join(x for i, x in enumerate(r.text.split("\n")) if i not in drop)
    assert docs.filter(F.col("text").contains("\n")).count()


def brute_lines(rows):
    """Per id the lines left: those outside later places of two lines with content, blank ones between."""
    first, gone = {}, {i: set() for i, _ in rows}
    for i, text in sorted(rows):
        lines = text.split("\n")
        at = [k for k, x in enumerate(lines) if x.strip(" ")]
        for a, b in zip(at, at[1:]):
            doc, end = first.setdefault("\n".join(lines[a:b + 1]), (i, b))
            if (doc, end) != (i, b):
                gone[i].update(range(max(a, end + 1) if doc == i else a, b + 1))
    return {i: [x for k, x in enumerate(t.split("\n")) if k not in gone[i]] for i, t in rows}


def test_line_chunks_find_every_passage_of_two_lines_and_more(spark, small_docs):
    r = random.Random(21)
    line = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(8))
    rows, own_lines = [], {}
    for n in range(2, 11):
        for k in range(12):
            passage = [line() for _ in range(n)]
            if k % 3 == 0:
                passage.insert(1, "")
            for copy in range(2):
                before, after = ([line() for _ in range(r.randint(1, 9))] for _ in range(2))
                i = len(rows)
                own_lines[i] = before + (passage if copy == 0 else []) + after
                rows.append((i, "\n".join(before + passage + after)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id: x.text.split("\n") for x in line_chunks.remove_repeated(docs).collect()} == own_lines
    # random lines of a small alphabet: overlaps, repeats inside a text, blank lines
    rows = [(i, "\n".join(r.choice(["a", "b", "c", "d", "e", "", " ", f"own {i} {k}"]) for k in range(r.randint(1, 12))))
            for i in range(80)] + [(80, "x\nx\nx\nx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: "\n".join(x) for i, x in brute_lines(rows).items()}
    assert want[80] == "x\nx"
    out = line_chunks.remove_repeated(docs, stats=True).collect()
    assert {x.doc_id: x.text for x in out} == want
    assert all((x.n_removed > 0) == (x.n_chunks > 0) and x.n_chunks <= x.n_removed <= x.n_lines for x in out)
    rows = [tuple(x) for x in small_docs.filter("text is not null and doc_id is not null").select("doc_id", "text").collect()]
    assert {x.doc_id: x.text for x in line_chunks.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {
        i: "\n".join(x) for i, x in brute_lines(rows).items()}


def test_long_runs_of_white_space():
    folder = fertility.FOLDER
    v = fertility.Vocabularies(f"{folder}/{fertility.RANKS}", fertility.PATTERN, f"{folder}/{fertility.FALLBACK}")
    for blanks in (" ", "\n ", "　", "\t\r\n"):
        run = (blanks * (1 << 17))[:1 << 17]
        for text in (run, f"a{run}", f"{run}b", f"one{run}two {run}three\n", f"x{run}​{run}."):
            assert fertility.token_ids(text, v.encoding).tolist() == v.encoding.encode_ordinary(text)
    words = "word " * 60
    assert fertility.measure(words + " " * 2_000_000 + words, v)[0] == 120


def test_lines_that_end_in_carriage_returns(spark):
    from tablevault.llm import line_chunks

    rows = [(1, "one line\r\n\r\n\r\nanother"), (2, "other words\r\n\r\n\r\nat the end"), (3, "\r\n \t\r\nlast\r\n\r\n"),
            (4, "same line\r\nnext line\r\nmine"), (5, "yours\r\nsame line\r\n\r\nnext line\r\n"), (6, "so\r\nsame line\r\nnext line\r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_chunks.remove_repeated(docs).collect()}
    # blank lines are no content; the repeated pair goes at its second place, not where a blank line parts it
    assert got == dict(rows) | {6: "so\r"}


def test_quotes_hold_values_after_an_equals_sign_only():
    from tablevault.llm import html_trees

    def tags(html):
        return [m[0] for m in html_trees.MARKUP.finditer(html)]

    assert tags("<p title=don't>Text one, it's here</p>") == ["<p title=don't>", "</p>"]
    assert tags("<p 'a\" b>x \"y\" > z</p>") == ["<p 'a\" b>", "</p>"]
    assert tags("<a title = 'x > y' href=\"a>b\">t</a>") == ["<a title = 'x > y' href=\"a>b\">", "</a>"]
    assert tags("<p class=\"open>text</p><b>it's</b>") == ["<p class=\"open>", "</p>", "<b>", "</b>"]
    assert tags("<img alt=''/><br/><!-- ' -->'<i>") == ["<img alt=''/>", "<br/>", "<!-- ' -->", "<i>"]
