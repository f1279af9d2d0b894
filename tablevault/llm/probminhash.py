"""Near-duplicates by ProbMinHash signatures, banding and verification.

A document is its shingles of five words, each with its count as weight. For every shingle a Poisson
process with the weight as rate sends arrivals to random signature components; a component keeps the
shingle that arrives first. A process ends when its time passes the latest first arrival of the document
(early termination), so most shingles need one or two draws. Two documents agree in a component with their
probability Jaccard similarity.

Components are banded; texts that share a band are candidates. Candidates are links if the probability
Jaccard of their shingles, or the Jaccard of the sets, is 0.8 or more, counted exactly. Exact copies
collapse first, by a digest of the whole text. In a bucket every text is compared with the bucket's leader
(smallest digest), not with all others; classes are the connected components of the links. In buckets
that still hold several classes, every text outside the largest class is compared with all texts of other
classes whose signatures agree enough, in blocks of ``BLOCK`` texts against ``BLOCK``: only links leave a
task, never pairs, and no task holds a whole bucket. Copies are never expanded into all pairs.

Words are runs of ASCII letters, digits and bytes above 127 of the lower-cased text.

Defined results: a null text is empty; texts without words are linked to equal texts only; a text of
fewer than five words is one shingle; equal rows are copies; class ids are the smallest id of the class
(null only if all are null); an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from tablevault.llm.common import cut, groups, once, row_key, text_of

SHINGLE = 5
SIMILAR = 0.8
BANDS, BAND = 24, 5
COMPONENTS = BANDS * BAND
BLOCK = 256
#: Share of equal components below which two texts are not compared; four deviations under 0.8.
LEAST_AGREEMENT = 0.65

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_WORD_BYTE = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Powers:
    """Powers of the base and of its inverse modulo 2**64, as far as a text has needed them."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            inverse = np.uint64(pow(int(_BASE), -1, 2**64))
            one = np.ones(1, dtype=np.uint64)
            self.up = np.cumprod(np.concatenate((one, np.full(size - 1, _BASE))))
            self.down = np.cumprod(np.concatenate((one, np.full(size - 1, inverse))))


def shingles(text: str, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a text and their counts."""
    data = np.frombuffer(text.lower().encode(), dtype=np.uint8)
    inside = np.concatenate(([False], _WORD_BYTE[data], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    powers.reach(len(data) + 1)
    # a word's hash is the difference of two prefix sums, moved to the text's start
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers.up[:len(data)])))
    h = _mix((sums[ends] - sums[starts]) * powers.down[starts])
    n = min(SHINGLE, len(h))
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = _mix(out * _STEP + h[k:len(h) - n + 1 + k])
    return np.unique(out, return_counts=True)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """ProbMinHash signatures of many documents at once; a row of zeros for a document without shingles."""
    m = COMPONENTS
    sizes = np.array([len(s) for s, _ in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    if not len(owner):
        return np.zeros((len(sets), m), dtype=np.uint64)
    ids = np.concatenate([s for s, _ in sets])
    weight = np.concatenate([w for _, w in sets]).astype(float)
    first = np.full((len(sets), m), np.inf)
    winner = np.zeros((len(sets), m), dtype=np.uint64)
    time, active, draw = np.zeros(len(ids)), np.arange(len(ids)), 0
    while len(active):
        draw += 1
        offset = np.uint64(draw * int(_STEP) % 2**64)
        who, bits = owner[active], _mix(ids[active] + offset)
        uniform = ((bits >> np.uint64(11)).astype(float) + 0.5) * 2.0 ** -53
        time[active] -= np.log(uniform) / weight[active]
        slot = who * m + (_mix(bits ^ _M1) % np.uint64(m)).astype(np.int64)
        at = time[active]
        np.minimum.at(first.ravel(), slot, at)
        won = at == first.ravel()[slot]
        winner.ravel()[slot[won]] = ids[active[won]]
        active = active[at < first.max(axis=1)[who]]
    return winner


FIELDS = "bands array<long>, parts binary"


def _described(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Band hashes (none without shingles), and a byte of each component."""
    powers = Powers()
    for batch in texts:
        rows = []
        for i in range(0, len(batch), 128):
            sets = [shingles(t, powers) for t in batch.iloc[i:i + 128]]
            winner = signatures(sets)
            bands = np.zeros((len(sets), BANDS), dtype=np.uint64)
            for k in range(BAND):
                bands = _mix(bands * _STEP + winner[:, k::BAND])
            parts = (winner >> np.uint64(56)).astype(np.uint8)
            rows += [(b.view(np.int64) if len(s) else np.empty(0, np.int64), p.tobytes()) for b, p, (s, _) in zip(
                bands, parts, sets, strict=True)]
        yield pd.DataFrame(rows, columns=["bands", "parts"])


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The larger of set Jaccard and probability Jaccard, exactly."""
    both, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    plain = len(both) / (len(a[0]) + len(b[0]) - len(both))
    if plain >= SIMILAR or (a[1].max() == 1 and b[1].max() == 1):
        return plain
    p, q = a[1] / a[1].sum(), b[1] / b[1].sum()
    # J = sum over shared x of 1 / sum over y of max(p_y / p_x, q_y / q_x)
    #   = sum over x of 1 / (sum of p_y where p_y / q_y >= p_x / q_x, over p_x, plus sum of the other q_y over q_x)
    ratio = p[ia] / q[ib]
    order = np.argsort(ratio, kind="stable")
    r, ps, qs = ratio[order], p[ia][order], q[ib][order]
    only_a, only_b = 1.0 - ps.sum(), 1.0 - qs.sum()
    from_p = np.concatenate((np.cumsum(ps[::-1])[::-1], [0.0]))
    from_q = np.concatenate(([0.0], np.cumsum(qs)))
    k = np.searchsorted(r, r, side="left")
    total = (from_p[k] + only_a) / ps + (from_q[k] + only_b) / qs
    return max(plain, float((1.0 / total).sum()))


def _matrix(parts) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(p) for p in parts), dtype=np.uint8).reshape(-1, COMPONENTS)


def _agree(one: pd.Series, other: pd.Series) -> pd.Series:
    return pd.Series((_matrix(one) == _matrix(other)).mean(axis=1) >= LEAST_AGREEMENT)


def _linked(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    powers = Powers()
    for one, other in batches:
        out, last, right = [], None, None
        for a, b in zip(one, other, strict=True):
            if b != last:  # a leader's rows stand together
                last, right = b, shingles(b, powers)
            out.append(similarity(shingles(a, powers), right) >= SIMILAR)
        yield pd.Series(out, dtype=bool)


def _block_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links between the asking texts of a block and the texts of other classes in another block."""
    powers = Powers()
    for group in groups(batches, ["band", "hash", "row", "column"]):
        asks, all_ = group[group["asks"]], group[~group["asks"]]
        up: dict = {}

        def top(c):
            while up.get(c, c) != c:
                c = up[c]
            return c

        out, sets = [], {}

        def set_of(tid, text):
            if tid not in sets:
                sets[tid] = shingles(text, powers)
            return sets[tid]

        if len(asks) and len(all_):
            theirs, their_bands = _matrix(all_["parts"]), np.stack(all_["bands"].to_numpy())
            others = list(zip(all_["tid"].map(bytes), all_["class"].map(bytes), all_["text"], strict=True))
            for tid, own, text, parts, bands, band in zip(
                    asks["tid"].map(bytes), asks["class"].map(bytes), asks["text"], asks["parts"], asks["bands"],
                    asks["band"], strict=True):
                agreement = (theirs == np.frombuffer(bytes(parts), dtype=np.uint8)).mean(axis=1)
                near = agreement >= LEAST_AGREEMENT
                # a pair is compared in the first band that it shares
                near &= ~(their_bands[:, :band] == np.asarray(bands)[:band]).any(axis=1)
                for j in sorted(np.flatnonzero(near), key=lambda j: -agreement[j]):
                    tid2, own2, text2 = others[j]
                    if top(own) != top(own2) and similarity(set_of(tid, text), set_of(tid2, text2)) >= SIMILAR:
                        up[top(own)] = top(own2)
                        out.append((tid, tid2))
        if out:
            yield pd.DataFrame(out, columns=["a", "b"])


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(tid, class): the smallest tid that links reach. Labels travel over links and then jump to their label's
    label, until nothing changes."""
    ends = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut(nodes.select("tid", F.col("tid").alias("class")))
    while True:
        seen = (ends.join(labels.select(F.col("tid").alias("b"), "class"), "b")
                .groupBy("a").agg(F.min("class").alias("_near")))
        near = labels.join(seen.withColumnRenamed("a", "tid"), "tid", "left").select(
            "tid", F.col("class").alias("_old"), F.least("class", "_near").alias("class"))
        near = cut(near)
        jump = near.select(F.col("tid").alias("class"), F.col("class").alias("_up"))
        new = cut(near.join(jump, "class").select("tid", "_old", F.least("class", "_up").alias("class")))
        if new.filter(F.col("class") != F.col("_old")).isEmpty():
            return new.select("tid", "class")
        labels = new.select("tid", "class")


def link_texts(distinct: DataFrame, texts_of) -> tuple[DataFrame, DataFrame]:
    """Classes (tid, class) and verified links (a, b) of distinct texts that share a bucket with another."""
    rows = distinct.select("tid", F.posexplode("bands").alias("band", "hash"))
    # sums are cut before joins: with plain exchanges on both sides Spark splits a hot bucket
    shared = cut(rows.groupBy("band", "hash").agg(F.min("tid").alias("lead"), F.max("tid").alias("_last"))
                 .filter(F.col("lead") != F.col("_last")).drop("_last"))
    members = cut(rows.join(shared, ["band", "hash"]))
    nodes = cut(members.select("tid").distinct())
    texts = cut(texts_of(nodes).join(distinct.select("tid", "bands", "parts").hint("merge"), "tid"))
    # every text with its buckets' leaders
    agree, linked = pandas_udf(_agree, "boolean"), pandas_udf(_linked, "boolean")
    pairs = members.filter(F.col("tid") != F.col("lead")).select(F.col("tid").alias("a"), F.col("lead").alias("b")).distinct()
    left, right = (texts.select(*[F.col(c).alias(f"{c}_{n}") for c in ("tid", "parts", "text")]) for n in "ab")
    left, right = left.withColumnRenamed("tid_a", "a"), right.withColumnRenamed("tid_b", "b")
    pairs = cut(pairs.join(left.select("a", "parts_a"), "a").join(right.select("b", "parts_b"), "b")
                .filter(agree("parts_a", "parts_b")).select("a", "b"))
    links = cut(pairs.join(left.select("a", "text_a"), "a").join(right.select("b", "text_b"), "b")
                .filter(linked("text_a", "text_b")).select("a", "b"))
    classes = components(nodes, links)
    # what leaders did not settle: texts outside a bucket's largest class with all others of the bucket
    classed = cut(members.drop("lead").join(classes, "tid"))
    sizes = classed.groupBy("band", "hash", "class").agg(F.count("*").alias("_n"))
    split = cut(sizes.groupBy("band", "hash").agg(F.max(F.struct("_n", "class")).alias("_top"), F.sum("_n").alias("_all"))
                .filter(F.col("_top._n") < F.col("_all"))
                .select("band", "hash", F.col("_top.class").alias("main"),
                        F.ceil((F.col("_all") - F.col("_top._n")) / BLOCK).cast("int").alias("rows"),
                        F.ceil(F.col("_all") / BLOCK).cast("int").alias("columns")))
    open_ = (classed.join(split, ["band", "hash"]).withColumn("asks", F.col("class") != F.col("main"))
             .withColumn("_h", F.xxhash64("tid")))
    mine_row, mine_column = F.pmod("_h", F.col("rows")).cast("int"), F.pmod("_h", F.col("columns")).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    asking = open_.filter("asks").select("band", "hash", "tid", "class", "asks", mine_row.alias("row"),
                                         F.explode(every("columns")).alias("column"))
    asked = open_.select("band", "hash", "tid", "class", F.lit(False).alias("asks"), F.explode(every("rows")).alias("row"),
                         mine_column.alias("column"))
    keys = ["band", "hash", "row", "column"]
    blocks = asking.unionByName(asked).join(texts, "tid").select(*keys, "asks", "tid", "class", "text", "parts", "bands")
    more = (blocks.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(_block_links, "a binary, b binary"))
    links = cut(links.unionByName(more).distinct())
    return components(nodes, links), links


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: key, id, text digest, class id, number of links of its text, whether it is its class's first.

    The first of a class is the row with the smallest (id, digest); null ids come last.
    """
    describe = once(pandas_udf(_described, FIELDS))
    tid = F.unhex(F.md5(text_of(text_col).cast("binary")))
    rows = cut(docs.select(row_key(id_col, text_col).alias("key"), F.col(id_col).alias("doc_id"), tid.alias("tid")))
    described = docs.select(tid.alias("tid"), describe(text_of(text_col)).alias("d"))
    distinct = cut(described.groupBy("tid").agg(F.first("d").alias("d")).select("tid", "d.bands", "d.parts"))

    def texts_of(nodes: DataFrame) -> DataFrame:
        # one plan at every size: texts always meet the nodes in a merge join
        found = docs.select(tid.alias("tid"), text_of(text_col).alias("text")).join(nodes.hint("merge"), "tid")
        return found.dropDuplicates(["tid"])

    classes, links = link_texts(distinct, texts_of)
    ends = links.select(F.col("a").alias("tid")).unionByName(links.select(F.col("b").alias("tid")))
    counts = ends.groupBy("tid").agg(F.count("*").alias("links"))
    named = cut(classes.join(counts, "tid", "left"))
    small = rows.select("key", "doc_id", "tid").join(named, "tid", "left")
    small = cut(small.withColumn("class", F.coalesce("class", "tid")))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("tid"))
    heads = cut(small.groupBy("class").agg(F.min(order).alias("_first"), F.count("*").alias("class_size")))
    out = small.join(heads, "class")
    return out.select("key", "doc_id", "tid", F.col("_first.doc_id").alias("class_id"), "class_size",
                      F.coalesce("links", F.lit(0)).cast("long").alias("links"),
                      order.eqNullSafe(F.col("_first")).alias("is_first"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, columns unchanged; of equal rows one."""
    firsts = classify(docs, id_col, text_col).filter("is_first").select("key").distinct()
    keyed = docs.select(F.struct("*").alias("row"), row_key(id_col, text_col).alias("key")).dropDuplicates(["key"])
    return keyed.join(firsts, "key", "left_semi").select("row.*")
