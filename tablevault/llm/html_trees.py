"""Main text of web pages: boosted trees over DOM nodes, decoded along the hierarchy.

Every page is parsed into a tree of elements. A node's features are its subtree's text, links and tag
density, its depth, its siblings, its tag, and the tokens of its class, id and role, together with those of its
ancestors. Boosted trees score how likely a node belongs to the article.

Scores of single nodes may contradict each other, so a page is decoded as a whole: on every path from the
root a node is outside, then article, then possibly excluded (an advert or a form in the article), never back.
Of all labellings that keep this order the one with the best sum of scores wins, by one pass up and one pass
down the tree.

The trees are fitted on a bounded sample: nodes of the ``SAMPLE`` pages with the smallest hash that mark
their article with an article or main element, and of ``DRAWN`` pages drawn from layouts written in
``_drawn_page``, where the label of each block is known. All pages are then extracted, whole.

Defined results: null or empty html gives the empty string, as does a page without an article; open elements
end where the page ends, a tag cut off there is no text, stray end tags are ignored; equal pages get equal texts; white space is what
Unicode calls so; a br is white space; other columns do not matter.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from tablevault.llm import boosting
from tablevault.llm.common import cut, once

SAMPLE, DRAWN = 200, 900
TREES, DEPTH = 25, 5

MARKUP = re.compile(
    # a quote holds a value only after "="; any other is a character of the tag, which ends at its own ">"
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*')?+)*+)>|<[!?/][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
    r"|<[!?/]?[a-zA-Z][^>]*\Z",
    re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg xmp noembed noframes".split())
#: Elements that start and end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2"
    " h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td"
    " tfoot th thead tr ul".split())
#: An open element that ends where another of these starts.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
        "th": {"td", "th"}, "option": {"option"}}
ENDS_P = BLOCKS - {"body", "html", "head", "option", "td", "th", "tr", "tbody", "thead", "tfoot"}
HOLDS = frozenset("ul ol table dl select article section div body blockquote form nav aside".split())

#: Groups of tags and of attribute tokens; each is a feature of the node and of its ancestors.
TAGS = ("article main", "section", "div", "p", "h1 h2 h3 h4 h5 h6", "ul ol dl menu", "li dt dd", "table tr td th tbody",
        "a", "nav", "header", "footer", "aside", "form input button select textarea label fieldset",
        "figure figcaption", "blockquote pre", "dialog details")
TOKENS = ("content article post entry story body main text page", "nav menu breadcrumb breadcrumbs tabs pagination pager",
          "header banner top masthead logo branding", "footer bottom copyright colophon legal",
          "sidebar side aside rail widget widgets column", "ad ads advert adverts advertisement sponsor sponsored promo",
          "comment comments reply replies discussion disqus respond feedback",
          "cookie cookies consent notice alert gdpr popup modal overlay warning message",
          "share social follow sharing", "related recommended recommendations popular more trending teaser",
          "form search newsletter subscribe login signup subscription")
#: Which groups speak against an article, and which for it.
AGAINST = [9, 10, 11, 12, 13, *range(len(TAGS) + 1, len(TAGS) + len(TOKENS))]
FOR = [0, len(TAGS)]
TAG_OF = {t: i for i, g in enumerate(TAGS) for t in g.split()}
TOKEN_OF = {t: i for i, g in enumerate(TOKENS) for t in g.split()}


class Page:
    """The elements of a page in page order, and its runs of text."""

    def __init__(self, source: str):
        self.tag, self.parent, self.marks = ["#root"], [-1], [()]
        self.runs: list[tuple[int, str]] = []  # (element, raw text); text "" ends a block
        stack = [0]
        at, end = 0, len(source)

        def text(to: int) -> None:
            if to > at:
                self.runs.append((stack[-1], source[at:to]))

        found = MARKUP.search(source)
        while found:
            text(found.start())
            at = found.end()
            name = (found[2] or found[5] or "").lower()
            if name and not (found[1] or found[4]):
                self._start(stack, name, found[3] or found[6] or "")
                if name in RAW and not (found[3] or found[6] or "").rstrip().endswith("/"):
                    close = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(source, at)
                    at = close.end() if close else end
                    stack.pop()
            elif name:
                self._end(stack, name)
            found = MARKUP.search(source, at)
        text(end)

    def _start(self, stack: list[int], name: str, attributes: str) -> None:
        if name in ENDS_P:
            self._close_p(stack)
        if name in ENDS:
            for i in range(len(stack) - 1, 0, -1):
                if self.tag[stack[i]] in ENDS[name]:
                    del stack[i:]
                    break
                if self.tag[stack[i]] in HOLDS:
                    break
        if name in BLOCKS:
            self.runs.append((stack[-1], ""))
        if name == "br":
            self.runs.append((stack[-1], " "))
        marks = []
        for kind, *values in ATTRIBUTE.findall(attributes) if attributes else ():
            marks += re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", "".join(values)).lower())
        self.tag.append(name)
        self.parent.append(stack[-1])
        self.marks.append(tuple(marks))
        if name not in VOID:
            stack.append(len(self.tag) - 1)

    def _close_p(self, stack: list[int]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if self.tag[stack[i]] == "p":
                del stack[i:]
                return
            if self.tag[stack[i]] in BLOCKS:
                return

    def _end(self, stack: list[int], name: str) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if self.tag[stack[i]] == name:
                del stack[i:]
                break
        if name in BLOCKS:
            self.runs.append((stack[-1], ""))

    def features(self) -> np.ndarray:
        """A row for each element."""
        n = len(self.tag)
        parent = np.array(self.parent)
        own, links, stops, paragraphs = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
        before = np.full(n, -1.0)
        done = 0
        for e, t in self.runs:
            size = len(t)
            own[e] += size
            stops[e] += t.count(". ") + t.count(", ") + t.count(".\n")
            done += size
        total = max(1.0, float(done))
        depth, in_link = np.zeros(n), [False] * n
        group, above = [], []
        children, nearest = np.zeros(n), np.zeros(n)
        for e in range(n):
            p = self.parent[e]
            mine = np.zeros(len(TAGS) + len(TOKENS))
            if self.tag[e] in TAG_OF:
                mine[TAG_OF[self.tag[e]]] = 1
            for m in self.marks[e]:
                if m in TOKEN_OF:
                    mine[len(TAGS) + TOKEN_OF[m]] = 1
            group.append(mine)
            # the nearest mark of the path decides more than any other
            nearest[e] = -1 if mine[AGAINST].any() else 1 if mine[FOR].any() else nearest[p] if p >= 0 else 0
            if p >= 0:
                depth[e] = depth[p] + 1
                in_link[e] = in_link[p] or self.tag[e] == "a"
                above.append(np.maximum(above[p], group[p]))
                children[p] += 1
            else:
                above.append(np.zeros_like(mine))
            paragraphs[e] = self.tag[e] == "p"
        links[:] = np.where(in_link, own, 0)
        index, seen = np.zeros(n), np.zeros(n)
        alike: dict[tuple, int] = {}
        for e in range(1, n):
            p = self.parent[e]
            index[e] = seen[p]
            seen[p] += 1
            alike[p, self.tag[e]] = alike.get((p, self.tag[e]), 0) + 1
        sums = np.stack([own, links, stops, paragraphs, np.ones(n)])
        for e in range(n - 1, 0, -1):
            sums[:, parent[e]] += sums[:, e]
        text, link, stop, par, nodes = sums
        first = 0.0
        for e, t in self.runs:
            while e >= 0 and before[e] < 0:
                before[e] = first
                e = self.parent[e]
            first += len(t)
        before[before < 0] = total
        of_parent = np.where(parent >= 0, children[parent], 1)
        same = np.array([0] + [alike[self.parent[e], self.tag[e]] for e in range(1, n)]) / np.maximum(1, of_parent)
        up = text[np.maximum(parent, 0)]
        plain = np.stack([depth, np.log1p(text), text / total, link / np.maximum(1, text), nodes / np.maximum(1, text / 50),
                          np.log1p(own), index, index / np.maximum(1, of_parent), of_parent, same, children,
                          stop / np.maximum(1, text) * 100, par, nearest, nearest[np.maximum(parent, 0)], before / total, text / np.maximum(1, up)], axis=1)
        return np.concatenate([plain, np.array(group), np.array(above)], axis=1)

    def decode(self, scores: np.ndarray) -> np.ndarray:
        """Which elements are article: the best labelling outside, article, excluded along every path."""
        n = len(self.tag)
        # sums of the subtree if this element is outside, article or excluded
        out, art, cut_off = -scores, scores.copy(), -scores
        for e in range(n - 1, 0, -1):
            p = self.parent[e]
            out[p] += max(out[e], art[e])
            art[p] += max(art[e], cut_off[e])
            cut_off[p] += cut_off[e]
        state = [0] * n
        for e in range(1, n):
            above = state[self.parent[e]]
            if above == 0:
                state[e] = 1 if art[e] > out[e] else 0
            elif above == 1:
                state[e] = 2 if cut_off[e] > art[e] else 1
            else:
                state[e] = 2
        return np.array(state) == 1

    def text(self, article: np.ndarray) -> str:
        """The article's blocks, one to a line."""
        blocks, parts = [], []
        for e, t in [*self.runs, (0, "")]:
            if t:
                if article[e]:
                    parts.append(html.unescape(t))
            elif parts:
                if block := " ".join("".join(parts).split()):
                    blocks.append(block)
                parts = []
        return "\n".join(blocks)


def parsed(source) -> Page:
    return Page(source if isinstance(source, str) else "")


def _semantic(page: Page) -> np.ndarray | None:
    """Labels of a page that marks its article; None if it does not."""
    wanted, unwanted = {"article", "main"}, {"nav", "aside", "footer", "header", "form"}
    label, marked = [0], False
    for e in range(1, len(page.tag)):
        p = page.parent[e]
        inside = label[p] == 1 or page.tag[e] in wanted
        bad = page.tag[e] in unwanted or any(TOKEN_OF.get(m, 0) > 0 for m in page.marks[e])
        marked |= page.tag[e] in wanted
        label.append(-1 if bad or label[p] == -1 else int(inside))
    return np.maximum(label, 0) if marked else None


def _drawn_page(seed: int) -> tuple[str, list[int]]:
    """A page drawn from common layouts, and the label of each of its elements in page order."""
    r = random.Random(seed)
    out, labels = [], []

    def words(low: int, high: int) -> str:
        return " ".join("".join(r.choice("aeioubdklmnrst") for _ in range(r.randint(2, 9))) + r.choice(["", "", "", ",", "."])
                        for _ in range(r.randint(low, high)))

    def element(tag: str, label: int, inside, marks: str = "") -> None:
        labels.append(label)
        attribute = f' {r.choice(["class", "class", "id"])}="{marks}"' if marks else ""
        out.append(f"<{tag}{attribute}>")
        inside() if callable(inside) else out.append(inside)
        out.append(f"</{tag}>")

    def one_of(group: int) -> str:
        return r.choice(TOKENS[group].split()) + r.choice(["", "", "-box", " wrap", "-1"])

    def links(label: int = 0) -> None:
        element("ul", label, lambda: [element("li", label, lambda: element("a", label, words(1, 3)))
                                      for _ in range(r.randint(2, 9))])

    def block(group: int, tag: str | None = None) -> None:
        """Something that is not article."""
        named = {1: "nav", 2: "header", 3: "footer", 4: "aside"}.get(group)
        kind = tag or (named if named and r.random() < 0.6 else r.choice(["div", "div", "section", "aside"]))
        marks = one_of(group) if kind in ("div", "section", "p") or r.random() < 0.4 else ""

        def inside() -> None:
            if group in (1, 9) or group in (4, 8) and r.random() < 0.6:
                links()
            elif group == 10:
                element("form", 0, lambda: (element("label", 0, words(1, 3)), element("button", 0, words(1, 2))))
            elif group == 6:
                for _ in range(r.randint(1, 6)):
                    element("div", 0, lambda: element("p", 0, words(4, 50)), one_of(6))
            elif r.random() < 0.5:
                out.append(words(3, 40))
            else:
                for _ in range(r.randint(1, 3)):
                    element(r.choice(["p", "div", "span", "h2"]), 0, words(3, 40))

        element(kind, 0, inside, marks)

    def article() -> None:
        if r.random() < 0.8:
            element("h1", 1, words(2, 12))
        for _ in range(r.randint(1, 12)):
            kind = r.random()
            if kind < 0.6:
                element("p", 1, lambda: (out.append(words(1, 120)), r.random() < 0.3 and element(
                    r.choice(["b", "i", "em", "a", "span"]), 1, words(1, 4)), out.append(words(0, 30))))
            elif kind < 0.68:
                element(r.choice(["h2", "h3"]), 1, words(1, 8))
            elif kind < 0.75:
                links(1) if r.random() < 0.2 else element("ul", 1, lambda: [element("li", 1, words(3, 30)) for _ in range(3)])
            elif kind < 0.8:
                element(r.choice(["blockquote", "pre", "div"]), 1, words(5, 60))
            else:
                block(r.choice([5, 7, 8, 9, 10, 6, 4, 4]))

    def wrapped() -> None:
        kind = r.random()
        if kind < 0.4:
            element("article", 1, article, r.choice(["", "", one_of(0)]))
        elif kind < 0.6:
            element("main", 1, article, r.choice(["", one_of(0)]))
        elif kind < 0.7:
            element("main", 0, lambda: (element("article", 1, article), block(6)))
        else:
            element(r.choice(["div", "section", "div"]), 1, article, one_of(0))

    def body() -> None:
        for g in r.sample([1, 2, 5, 7], r.randint(1, 4)):
            block(g)
        middle = [lambda: wrapped(), *(lambda g=g: block(g) for g in r.sample([4, 5, 9, 8, 10], r.randint(0, 3)))]
        if r.random() < 0.4:
            r.shuffle(middle)
        if r.random() < 0.4:
            element("div", 0, lambda: [m() for m in middle], r.choice(["", "container", "wrapper", "page"]))
        else:
            for m in middle:
                m()
        for g in r.sample([6, 3, 9, 3], r.randint(1, 3)):
            block(g)

    element("html", 0, lambda: element("body", 0, body))
    return "".join(out), [0, *labels]


def training_rows(pages: DataFrame, html_col: str, sample: int, drawn: int) -> DataFrame:
    """(features, label): nodes of sampled marked pages and of drawn pages, a bounded number of pages."""
    chosen = (pages.filter(F.lower(F.col(html_col)).rlike("<(article|main)[\\s>]"))
              .select(F.col(html_col).alias("html")).orderBy(F.xxhash64("html"), "html").limit(sample))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for source in batch["html"]:
                page = parsed(source)
                labels = _semantic(page)
                if labels is not None:
                    out += zip(page.features().tolist(), labels.tolist(), strict=True)
            yield pd.DataFrame(out, columns=["features", "label"])

    def drawn_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for seed in batch["id"]:
                source, labels = _drawn_page(int(seed))
                out += zip(parsed(source).features().tolist(), labels, strict=True)
            yield pd.DataFrame(out, columns=["features", "label"])

    schema = "features array<double>, label int"
    made = pages.sparkSession.range(0, drawn, 1, 4).mapInPandas(drawn_rows, schema)
    return chosen.mapInPandas(rows, schema).unionByName(made)


def fit(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE, drawn: int = DRAWN) -> boosting.Trees:
    return boosting.fit(cut(training_rows(pages, html_col, sample, drawn)), TREES, DEPTH)


def texts_of(sources: list, trees: boosting.Trees) -> list[str]:
    """The main text of each page."""
    pages = [parsed(s) for s in sources]
    if not pages:
        return []
    scores = boosting.scores(trees, np.concatenate([p.features() for p in pages]))
    ends = np.cumsum([len(p.tag) for p in pages])
    return [p.text(p.decode(s)) for p, s in zip(pages, np.split(scores, ends[:-1]), strict=True)]


def extract(pages: DataFrame, html_col: str = "html", out: str = "text", trees: boosting.Trees | None = None) -> DataFrame:
    """``pages`` with the column ``out``: the main text of each page."""
    trees = fit(pages, html_col) if trees is None else trees

    @pandas_udf("string")
    def main_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            found = []
            for i in range(0, len(batch), 50):
                found += texts_of(batch.iloc[i:i + 50].tolist(), trees)
            yield pd.Series(found, dtype=object)

    return pages.withColumn(out, once(main_text)(F.col(html_col).cast("string")))
