"""HTML trees, shards, near-duplicates, URL trees, suffix buckets, the pipeline."""
import hashlib
import html
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tablevault.llm import boosting, html_trees, probminhash, sharding, suffix_buckets, urls

SF = "/root/testdata/sf0.001"


# --- HTML ---

@pytest.fixture(scope="module")
def trees(spark):
    return html_trees.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), drawn=500)


def article_by_pattern(source):
    found = re.search(r"<article>(.*?)(</article>|$)", source, re.S)
    blocks = re.split(r"</?(?:p|h1|div|li|ul)\b[^>]*>", found[1] if found else "")
    texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in blocks]
    return "\n".join(t for t in texts if t)


def test_pages_give_their_article(spark, trees):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    assert [article_by_pattern(p.html) for p in pages] == html_trees.texts_of([p.html for p in pages], trees)


def test_held_out_layouts(trees):
    whole = 0
    for seed in range(50_000, 50_100):
        source, labels = html_trees._drawn_page(seed)
        page = html_trees.parsed(source)
        got = page.text(page.decode(boosting.scores(trees, page.features())))
        whole += got == page.text(np.array(labels) == 1)
    assert whole >= 95


def test_decoding_is_the_best_consistent_labelling():
    r = random.Random(4)
    for _ in range(40):
        page = html_trees.parsed("")
        n = r.randint(2, 8)
        page.tag, page.parent = ["div"] * n, [-1, *[r.randrange(i) for i in range(1, n)]]
        scores = np.array([r.uniform(-2, 2) for _ in range(n)])

        def total(states):
            return sum(s if x == 1 else -s for s, x in zip(scores[1:], states[1:], strict=True))

        def legal(states):
            return states[0] == 0 and all(
                (a := states[page.parent[e]]) == states[e] or (a, states[e]) in ((0, 1), (1, 2)) for e in range(1, n))

        best = max(total(s) for s in np.ndindex(*[3] * n) if legal(s))
        chosen = page.decode(scores)
        assert total([int(x) for x in chosen]) == pytest.approx(best)


def test_html_edges(spark, trees):
    sources = [None, "", "plain", "<p>no end", "<article><p>a&amp;b &lt; c&#10;d<br>e</p></article", "<" * 5000, "</div></p>",
               "<article>" + "<div>" * 3000 + "<p>deep text of some length, with a comma.</p>", '<div class="x\'>y</div>',
               "<article><p>" + "long text, again. " * 20_000 + "</p></article>", "<!-- open", "<script>var x = '<p>no</p>'"]
    df = spark.createDataFrame(list(enumerate(sources)), "page_id long, html string")
    got = {r.page_id: r.text for r in html_trees.extract(df, trees=trees).collect()}
    assert len(got) == len(sources) and all(isinstance(t, str) for t in got.values())
    assert got[0] == got[1] == got[10] == got[11] == "" and got[4] == "a&b < c d e"
    assert got[9] == " ".join(("long text, again. " * 20_000).split())
    assert html_trees.extract(df.limit(0)).count() == 0


# --- shards ---

def check_shards(rows, docs, shards=16):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (d.doc_id, len((d.text or "").encode()) + 1, zlib.crc32((d.text or "").encode())) for d in docs)
    count = Counter(r.shard for r in rows)
    sizes = [count[s] for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and set(count) <= set(range(shards))
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(count[s]))
    assert {r.law for r in rows} <= {"rows"} and {r.grown_shard for r in rows} <= {None}


def test_shards_are_even_and_keep_equal_texts_together(spark, edge_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sharding.shard(docs).collect()
    check_shards(rows, docs.collect())
    groups = {}
    for r in rows:
        groups.setdefault((r.size, r.text_crc32), set()).add(r.shard)
    assert sum(len(g) > 1 for g in groups.values()) <= 2
    check_shards(sharding.shard(edge_docs).collect(), edge_docs.collect())
    assert sharding.shard(no_docs).count() == 0


def test_shards_with_a_group_larger_than_a_shard(spark):
    texts = ["hot"] * 400 + [f"pair {i // 2}" for i in range(300)] + [f"single {i}" for i in range(300)]
    random.Random(2).shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = sharding.shard(docs).collect()
    check_shards(rows, docs.collect())
    where = {r.doc_id: r.shard for r in rows}
    pairs = {}
    for i, t in enumerate(texts):
        if t.startswith("pair"):
            pairs.setdefault(t, set()).add(where[i])
    assert sum(len(s) > 1 for s in pairs.values()) <= 0.4 * len(pairs)
    check_shards(sharding.shard(docs.filter("text = 'hot'")).collect(), docs.filter("text = 'hot'").collect())


# --- near-duplicates ---

def brute_classes(rows):
    powers = probminhash.Powers()
    texts = sorted({t or "" for _, t in rows})
    sets = [probminhash.shingles(t, powers) for t in texts]
    up = list(range(len(texts)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i][0]) and len(sets[j][0]) and probminhash.similarity(sets[i], sets[j]) >= probminhash.SIMILAR:
                up[top(i)] = top(j)
    return {t: texts[top(i)] for i, t in enumerate(texts)}


def partition(pairs):
    out = {}
    for member, name in pairs:
        out.setdefault(name, []).append(member)
    return sorted(sorted(map(str, m)) for m in out.values())


def test_near_duplicate_classes_equal_brute_force(spark, small_docs, edge_docs):
    r = random.Random(8)
    base = [f"w{r.randint(0, 2000)}" for _ in range(300)]
    edited = []
    for i in range(40):  # copies with a few edits: neighbours of neighbours are further apart than the threshold
        base = list(base)
        base[r.randrange(300)] = f"e{i}"
        edited.append((1000 + i, " ".join(base)))
    docs = (small_docs.select("doc_id", "text").unionByName(spark.createDataFrame(edited, "doc_id long, text string"))
            .unionByName(edge_docs.filter("length(text) < 1000 or text is null").select("doc_id", "text")))
    rows = [tuple(x) for x in docs.collect()]
    names = brute_classes(rows)
    got = probminhash.classify(docs).collect()
    assert len(got) == len(rows)
    by_text = {bytes(x.tid): x.class_id for x in got}
    digest = lambda t: hashlib.md5((t or "").encode()).digest()
    heads = {}
    for i, t in rows:
        heads.setdefault(names[t or ""], []).append((i is None, i or 0))
    for _, t in rows:
        first = min(heads[names[t or ""]])
        assert by_text[digest(t)] == (None if first[0] else first[1])
    kept = probminhash.keep_first(docs).collect()
    assert len(kept) == len(heads)
    assert probminhash.keep_first(edge_docs).columns == edge_docs.columns


def test_shingles_are_those_of_a_plain_count():
    powers = probminhash.Powers()
    for text in ("one two three four five six one two three four five", "Ünï côdé, words; AND (more) words of it 🙂 here",
                 "a b", "", "...", "x " * 500):
        words = re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower())
        n = min(5, len(words))
        want = Counter(tuple(words[i:i + n]) for i in range(len(words) - n + 1)) if words else Counter()
        ids, counts = probminhash.shingles(text, powers)
        assert sorted(counts.tolist()) == sorted(want.values())
    different = {int(probminhash.shingles(f"w{i}", powers)[0][0]) for i in range(5000)}
    assert len(different) == 5000 and 0 not in different


def test_near_duplicates_of_nothing(no_docs):
    assert probminhash.classify(no_docs).count() == probminhash.keep_first(no_docs).count() == 0


def test_probability_jaccard_and_its_estimate():
    r = random.Random(6)
    sets = []
    for _ in range(60):
        ids = np.array(sorted(r.sample(range(80), 50)), dtype=np.uint64)
        sets.append((ids, np.array([r.randint(1, 4) for _ in ids])))

    def by_definition(a, b):
        p = dict(zip(a[0].tolist(), (a[1] / a[1].sum()).tolist(), strict=True))
        q = dict(zip(b[0].tolist(), (b[1] / b[1].sum()).tolist(), strict=True))
        return sum(1 / sum(max(p.get(y, 0) / p[x], q.get(y, 0) / q[x]) for y in {*p, *q}) for x in {*p} & {*q})

    signed = probminhash.signatures(sets)
    errors = []
    for i in range(0, 60, 2):
        a, b = sets[i], sets[i + 1]
        exact = by_definition(a, b)
        assert probminhash.similarity(a, b) >= exact - 1e-9
        plain = len({*a[0].tolist()} & {*b[0].tolist()}) / len({*a[0].tolist()} | {*b[0].tolist()})
        assert probminhash.similarity(a, b) == pytest.approx(max(plain, exact)) or plain >= probminhash.SIMILAR
        errors.append((signed[i] == signed[i + 1]).mean() - exact)
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.09


# --- urls ---

def test_url_parts_and_rules(spark):
    cases = [("http://A.Example.NET/en/1?x#y", "a.example.net", "/en/1", "example.net/en/"),
             ("https://example.net", "example.net", "", None), ("http://x.net/", "x.net", "/", "net/"),
             ("http://notexample.com/de/1", "notexample.com", "/de/1", None), ("ftp://b.org/fr/?q", "b.org", "/fr/", "org/fr/"),
             ("http://example.com/de/", "example.com", "/de/", "example.com/de/"), (None, "", "", None), ("no scheme", "", "", None),
             ("http://", "", "", None), ("a://b://c/d", "b:", "//c/d", None), ("http://h.net?x://y", "h.net", "", None),
             ("http://net/x", "net", "/x", "net/"), ("http://x.com/" + "a" * 50_000, "x.com", "/" + "a" * 50_000, None)]
    df = spark.createDataFrame([(i, c[0], "clash") for i, c in enumerate(cases)], "page_id long, url string, host string")
    got = {r.page_id: r for r in urls.judge(df).collect()}
    for i, (_, host, path, rule) in enumerate(cases):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == (dict(urls.RULES)[rule] if rule else got[i].verdict) and got[i].verdict in ("allow", "block")
    assert urls.judge(df.limit(0)).count() == 0
    assert {r.verdict for r in urls.judge(df, rules=()).collect()} == {"allow"}


def test_url_trees_hold_on_urls_they_were_not_fitted_on(spark):
    rows = urls.judge(spark.read.parquet("/root/testdata/sf0.1/pages.parquet"), sample=300).filter("rule is not null").collect()
    right = sum((r.score > 0) == (r.verdict == "block") for r in rows)
    assert len(rows) > 900 and right >= 0.95 * len(rows)


# --- suffix buckets ---

def brute_repeats(texts, length=200):
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("together", [500, 1])
def test_repeats_equal_brute_force(spark, small_docs, edge_docs, together):
    r = random.Random(13)
    letters = lambda n: "".join(r.choice("abcdé ") for _ in range(n))
    shared = [letters(n) for n in (150, 199, 200, 201, 260, 700)]
    own = [(100 + i, letters(r.randint(0, 300)) + r.choice(shared) + letters(r.randint(0, 100)) + r.choice(shared)[:r.randint(180, 700)])
           for i in range(60)]
    own += [(200, "ab" * 400), (201, "a" * 199), (202, "a" * 201), (203, letters(500)), (204, None)]
    docs = (spark.createDataFrame(own, "doc_id long, text string").unionByName(small_docs.select("doc_id", "text"))
            .unionByName(edge_docs.filter("length(text) < 60000 or text is null").select("doc_id", "text")))
    rows = [tuple(x) for x in docs.collect()]
    want = Counter((i, *x) for (i, _), x in zip(rows, brute_repeats([(t or "").encode() for _, t in rows]), strict=True))
    got = suffix_buckets.remove_repeats(docs, together=together).select(
        "row.doc_id", "rest.n_bytes", "rest.n_removed", "rest.n_spans", "rest.kept_sha256").collect()
    assert Counter(map(tuple, got)) == want


def test_repeat_edges(edge_docs, no_docs):
    rows = suffix_buckets.remove_repeats(edge_docs).select("row.*", "rest.*").collect()
    long = [r for r in rows if r.doc_id in (3, 4)]
    assert len(rows) == 10 and all(r.n_removed == r.n_bytes > 100_000 and r.n_spans == 1 for r in long)
    assert all(r.key == "clash" for r in rows)
    assert suffix_buckets.remove_repeats(no_docs).count() == 0


# --- pipeline ---

def test_pipeline_stages_follow_on(spark, small_docs, edge_docs, no_docs):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF).cache()
        sizes.append(out.count())
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        docs = out
    assert sizes == sorted(sizes, reverse=True) and sizes[4] == sizes[5] > 20
    run = corpus_pipeline.run(spark, SF)
    assert Counter((r.doc_id, tuple(r.ids)) for r in run.collect()) == Counter((r.doc_id, tuple(r.ids)) for r in docs.collect())


def test_pipeline_stages_take_odd_tables(spark, edge_docs, no_docs):
    import corpus_pipeline
    from pyspark.sql import functions as F

    for docs in (edge_docs, no_docs):
        docs = docs.withColumns({"source": F.lit(None).cast("string"), "n_chars": F.lit(None).cast("long")})
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, SF).count() <= docs.count()


def test_blocks_settle_what_leaders_leave_open(spark, monkeypatch):
    monkeypatch.setattr(probminhash, "BLOCK", 3)
    r = random.Random(21)
    base = [f"w{r.randint(0, 500)}" for _ in range(200)]
    rows = []
    for i in range(50):
        words = list(base)
        for k in r.sample(range(200), r.randint(0, 9)):
            words[k] = f"x{i}y{k}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    names = brute_classes(rows)
    got = {x.doc_id: x.class_id for x in probminhash.classify(docs).collect()}
    assert partition(got.items()) == partition((i, names[t]) for i, t in rows)
