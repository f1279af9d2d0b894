"""Token ids of a ``tokenizers`` BPE over words, at the price of a dictionary look-up per distinct word of a batch.

The tokenizer of ``word_bpe_49k.json`` normalises a text (NFC, lower case), cuts it into words, digits and runs of marks
and gives each to its model. ``WordEncoder`` lower-cases and cuts with the same pattern, numbers the distinct words of a
batch in Arrow, and lets the library's model encode those it has not met yet. That equals the library's ids of the
whole text where

* the file has the normaliser and the cuts that are named here,
* the text is in normal form NFC already (else marks could join letters across a cut),
* it holds none of the tokenizer's special strings, and
* every character is of the same class (letter, number, white space, other) for Python as for the library and has
  the same lower case wherever it stands. Characters are compared the first time they are met (fractions, Roman
  numerals and the capital sigma are among those that differ).

Any other text is encoded by the library as a whole. Texts are taken in stretches that end at white space, so the
memory for a very long one is bounded; white space never stands in a token.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Characters of a stretch (it goes on to the next blank or line end).
STRETCH = 1 << 20
#: Characters encoded together.
BATCH = 1 << 22
#: Words whose ids are remembered in a worker (about 200 bytes each); beyond them the memory starts anew.
MEMORY = 1_000_000

# The tokenizer file's normaliser, and its word pattern in the library's form and in that of Python's
# ``re`` (letters first: the parts begin with different characters, but for the clitics and other marks); its character classes in both forms; the one capital whose lower case depends on what stands around it.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORDS = r"[^\W\d_]+|\d|'(?:s|t|re|ve|m|ll|d)|(?:[^\w\s]|_)+"
CLASSES = ((r"\p{L}", r"[^\W\d_]"), (r"\p{N}", r"\d"), (r"\s", r"\s"))
SIGMA = "\u03a3"


class WordEncoder:
    """Ids of texts by one tokenizer file (given as its bytes)."""

    def __init__(self, data: bytes):
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(data.decode("utf-8"))
        self.model = self.tokenizer.model
        shape = json.loads(data)
        cuts = (shape.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.named = ((shape.get("normalizer") or {}).get("normalizers") == NORMALIZER
                      and cuts[0].get("pattern") == {"Regex": PATTERN} and [c.get("type") for c in cuts] == ["Split", "ByteLevel"])
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cut = re.compile(WORDS).findall
        self.classes = [(pre_tokenizers.Split(Regex(theirs), "removed", invert=True), re.compile(ours))
                        for theirs, ours in CLASSES]
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes: dict[int, str] = {}
        for c in map(chr, [*range(0x800), *range(0x800, 0xD800, 0x40), 0xE000, 0xF000, *range(0x10000, 0x110000, 0x1000)]):
            ((shown, _),) = level.pre_tokenize_str(c)
            self.bytes.update(zip(c.encode(), shown, strict=True))
        self.known: set[str] = set()
        self.odd: set[str] = {SIGMA}
        self._forget()

    def _forget(self) -> None:
        """Nothing is known: numbers of words, and by number where their ids begin and how many they are."""
        self.number: dict[str, int] = {}
        self.flat = np.zeros(0, dtype=np.uint32)
        self.begin = np.zeros(0, dtype=np.int64)
        self.count = np.zeros(0, dtype=np.int64)

    def _of_class(self, splitter, chars: list[str]) -> set[str]:
        """The characters of a class by the library; a control character that is in none parts them."""
        return set("".join(p for p, _ in splitter.pre_tokenize_str("\x00".join(chars))))

    def _meet(self, chars: set[str]) -> None:
        """Compare characters not met before."""
        new = sorted(chars - self.known)
        if not new:
            return
        shape = {c: self.tokenizer.normalizer.normalize_str(c) for c in new}
        shapes = sorted({s for s in shape.values() if len(s) == 1} | set(new))
        white = self._of_class(self.classes[-1][0], shapes)
        self.odd.update(c for c in new if len(shape[c]) != 1 or (c not in white and shape[c] != c.lower()))
        for splitter, pattern in self.classes:
            theirs = self._of_class(splitter, shapes)
            self.odd.update(c for c in new if (c in theirs) != bool(pattern.match(c)) or (shape[c] in theirs) != (c in theirs))
        self.known.update(new)

    def _plain(self, text: str, odd: set[str]) -> bool:
        return (self.named and unicodedata.is_normalized("NFC", text) and not any(s in text for s in self.special)
                and (not odd or odd.isdisjoint(text)))

    def _learn(self, words: list[str]) -> None:
        """The model's ids of new words, which are written as it sees bytes."""
        shown = [w if w.isascii() and w.isalnum() else "".join(map(self.bytes.__getitem__, w.encode())) for w in words]
        ids = [[t.id for t in tokens] for tokens in map(self.model.tokenize, shown)]
        count = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        self.begin = np.concatenate([self.begin, np.cumsum(count) - count + len(self.flat)])
        self.count = np.concatenate([self.count, count])
        self.flat = np.concatenate([self.flat, np.fromiter(itertools.chain.from_iterable(ids), dtype=np.uint32)])
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words)), strict=True))

    def _plain_ids(self, texts: list[str]) -> list[np.ndarray]:
        words: list[str] = []
        ends = [0]
        for text in texts:
            words += self.cut(text.lower())
            ends.append(len(words))
        coded = pa.array(words, pa.string()).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        new = [w for w in distinct if w not in self.number]
        if len(self.number) + len(new) > MEMORY:
            self._forget()
            new = distinct
        if new:
            self._learn(new)
        numbers = np.fromiter(map(self.number.__getitem__, distinct), dtype=np.int64, count=len(distinct))
        at = numbers[coded.indices.to_numpy()]
        count = self.count[at]
        before = np.cumsum(count) - count
        ids = self.flat[np.repeat(self.begin[at] - before, count) + np.arange(int(count.sum()))]
        cuts = np.concatenate([before, [len(ids)]])[ends]
        return [ids[a:b] for a, b in itertools.pairwise(cuts)]

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as the library gives them."""
        met = set().union(*texts) if texts else set()
        self._meet(met)
        odd = self.odd & met
        plain = [self._plain(t, odd) for t in texts]
        own = iter(self._plain_ids(list(itertools.compress(texts, plain))) if any(plain) else ())
        return [next(own) if p else np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, dtype=np.uint32)
                for t, p in zip(texts, plain, strict=True)]

    def encode(self, texts: list[str], batch_chars: int = BATCH) -> Iterator[np.ndarray]:
        """Ids of each text in turn, a bounded number of characters at a time."""
        held: list[str] = []
        size, first = 0, 0
        owner: list[int] = []
        parts: dict[int, list[np.ndarray]] = {}

        def ready(done: int) -> Iterator[np.ndarray]:
            nonlocal first
            for i, ids in zip(owner, self.batch(held), strict=True):
                parts.setdefault(i, []).append(ids)
            while first < done:
                yield np.concatenate(parts.pop(first, None) or [np.zeros(0, dtype=np.uint32)])
                first += 1

        for i, text in enumerate(texts):
            for piece in stretches(text):
                held.append(piece)
                owner.append(i)
                size += len(piece)
                if size >= batch_chars:
                    yield from ready(i)  # this text may go on
                    held, owner, size = [], [], 0
        yield from ready(len(texts))


def stretches(text: str, size: int = STRETCH) -> Iterator[str]:
    """A text in pieces of ``size`` characters and more, each but the first beginning with white space."""
    at = 0
    while len(text) - at > size:
        ends = [e for e in (text.find(" ", at + size), text.find("\n", at + size)) if e >= 0]
        if not ends:
            break
        yield text[at:min(ends)]
        at = min(ends)
    if at < len(text):
        yield text[at:]


@functools.lru_cache(maxsize=2)
def encoder(data: bytes) -> WordEncoder:
    """One encoder a worker process, kept from task to task."""
    return WordEncoder(data)
