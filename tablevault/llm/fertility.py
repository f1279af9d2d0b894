"""Quality rules by tokeniser fertility.

Every whole text is encoded with a public byte-level vocabulary. Per document: characters of words
per token, the entropy of its tokens, and the share of its bytes that a second public vocabulary
writes as byte-fallback tokens.
The corpus sets rejection bands per language (per script where the language is unknown), from the
quartiles over all documents that pass the base rules.

Defined results: a null text has no words and fails the base rules; a null or unknown language
uses its script's band; a band with no documents rejects nothing; equal rows get equal results;
other columns, whatever their names, do not matter.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from tablevault.llm.common import cut, once, packed

FOLDER = "/opt/tokenizers"
#: Files of public vocabularies in the folder, and the pattern that splits text before the merges of the first.
RANKS, FALLBACK = "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = np.array([ord(c) for c in "#*$%&|<>"], dtype=np.uint32)

#: Languages with a band of their own; all others share their script's.
LANGUAGES = ("en", "de", "fr", "es", "it", "pt", "nl", "pl", "sv", "cs", "ru", "uk", "el", "ar", "he", "hi", "th",
             "zh", "ja", "ko", "vi", "tr")

#: First code points of runs of scripts; what stands below a run's end and above its start is that script's.
SCRIPT_RUNS = ((0x41, "LATIN"), (0x5B, "NONE"), (0x61, "LATIN"), (0x7B, "NONE"), (0xC0, "LATIN"), (0x370, "GREEK"),
               (0x400, "CYRILLIC"), (0x530, "OTHER"), (0x590, "HEBREW"), (0x600, "ARABIC"), (0x700, "OTHER"),
               (0x900, "INDIC"), (0xE00, "THAI"), (0xE80, "OTHER"), (0x1E00, "LATIN"), (0x1F00, "GREEK"),
               (0x2000, "NONE"), (0x3040, "KANA"), (0x3100, "CJK"), (0xAC00, "HANGUL"), (0xD800, "OTHER"))
SCRIPT_STARTS = np.array([x for x, _ in SCRIPT_RUNS], dtype=np.uint32)
SCRIPT_NAMES = [x for _, x in SCRIPT_RUNS]

METRICS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long,"
           " byte_share double, token_entropy double, script string")

#: How far below its group's median characters per token a document may lie: so many quartile
#: distances, but this share of the median at least, however alike the documents are.
SPREAD, LEAST_REACH, FULL_WORDS = 4.5, 0.08, 150.0
#: Other ends: multiples of the medians of characters per token and entropy, and the byte share.
MOST_CHARS, LEAST_ENTROPY, MOST_BYTES = 3.0, 0.3, 0.5
MIN_WORDS = 50


class Vocabularies:
    """A byte-level vocabulary that counts tokens, and one with byte fallback.

    A character falls back to bytes exactly when the second has no piece of that one character, so
    its share needs no second encoding.
    """

    def __init__(self, ranks: str, pattern: str, fallback: str):
        import sentencepiece
        import tiktoken

        with open(ranks, "rb") as f:
            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("fertility", pat_str=pattern, mergeable_ranks=known, special_tokens={})
        sp = sentencepiece.SentencePieceProcessor(model_file=fallback)
        self.falls_back = np.ones(0x110000, dtype=bool)
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if len(piece) == 1 and not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
                self.falls_back[ord(piece)] = False
        self.falls_back[ord(" ")] = False  # written as the metaspace


def _repeat_words(words: list[str]) -> int:
    """Words that stand in a window of three words found twice or more."""
    if len(words) < 4:
        return 0
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    a = np.array([ids[w] for w in words], dtype=np.int64)
    if len(ids) < 2_000_000:
        windows = ((a[:-2] << 21) + a[1:-1] << 21) + a[2:]
    else:
        windows = np.unique(np.stack([a[:-2], a[1:-1], a[2:]]), axis=1, return_inverse=True)[1].ravel()
    _, where, times = np.unique(windows, return_inverse=True, return_counts=True)
    again = times[where] > 1
    inside = np.zeros(len(words), dtype=bool)
    inside[:-2] |= again
    inside[1:-1] |= again
    inside[2:] |= again
    return int(inside.sum())


def _dup_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(lines) - len(set(lines))


def _script(letters: np.ndarray) -> str:
    """The script of most letters: ``letters`` are the code points of the words."""
    found = np.bincount(np.searchsorted(SCRIPT_STARTS, letters, side="right"), minlength=len(SCRIPT_STARTS) + 1)
    seen: dict[str, int] = {}
    for name, n in zip(("NONE", *SCRIPT_NAMES), found.tolist(), strict=True):
        if name != "NONE" and n:
            seen[name] = seen.get(name, 0) + n
    return min(seen, key=lambda k: (-seen[k], k)) if seen else "NONE"


#: White space of the vocabulary's pattern, in runs too long for its look-ahead (which keeps a stack of the run).
LONG_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % (1 << 16))


def token_ids(text: str, encoding) -> np.ndarray:
    """The tokens of a text, however long its runs of white space.

    The pattern takes a run of white space as one part, but for its last character where something follows; so a
    long run is encoded by itself, and the text around it as it stands.
    """
    parts, at = [], 0
    for run in LONG_BLANKS.finditer(text):
        end = run.end() - (run.end() < len(text))
        parts += [encoding.encode_to_numpy(text[at:run.start()], disallowed_special=()),
                  np.array(encoding._encode_single_piece(text[run.start():end]), dtype=np.uint32)]
        at = end
    parts.append(encoding.encode_to_numpy(text[at:], disallowed_special=()))
    return np.concatenate(parts) if len(parts) > 1 else parts[0]


def measure(text: str | None, v: Vocabularies) -> tuple:
    text = (text or "").encode("utf-8", "replace").decode()
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    n_symbols = int(np.isin(codes, SYMBOLS).sum())
    words = WORD.findall(text)
    if not words:
        return (0, 0, n_symbols, 0, 0, 0, 0.0, 0.0, "NONE")
    letters = codes[(codes != 32) & ((codes < 9) | (codes > 13))]
    tokens = token_ids(text, v.encoding)
    each = np.bincount(tokens)
    share = each[each > 0] / len(tokens)
    width = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
    fallback = float(width[v.falls_back[codes]].sum() / width.sum())
    return (len(words), len(letters), n_symbols, _dup_lines(text), _repeat_words(words), len(tokens), fallback,
            float(-(share * np.log2(share)).sum()), _script(letters))


def measures(folder: str = FOLDER):
    """A function of a text column that returns the fields of ``METRICS``."""
    names = [f.split()[0] for f in METRICS.split(", ")]

    @pandas_udf(METRICS)
    def fields(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        vocabularies = Vocabularies(f"{folder}/{RANKS}", PATTERN, f"{folder}/{FALLBACK}")
        for texts in batches:
            yield pd.DataFrame([measure(t, vocabularies) for t in texts], columns=names)

    return once(fields)


def group_of(lang: Column, script: Column) -> Column:
    known = F.lower(lang.cast("string"))
    return F.when(known.isin(*LANGUAGES), known).otherwise(F.concat(F.lit("script:"), script))


def with_measures(docs: DataFrame, text: str, lang: str, folder: str) -> DataFrame:
    """The rows with a struct column ``_m`` of measures, ``_group`` and ``_base``."""
    df = docs.withColumn("_m", measures(folder)(F.col(text).cast("string")))
    df = df.withColumn("_group", group_of(F.col(lang), F.col("_m.script")))
    base = (F.col("_m.n_words") < MIN_WORDS) | (100 * F.col("_m.n_repeat_words") > 50 * F.col("_m.n_words"))
    return df.withColumn("_base", base)


def chars_per_token() -> Column:
    return F.col("_m.word_chars") / F.greatest(F.col("_m.n_tokens"), F.lit(1))


def bands(measured: DataFrame) -> list[dict]:
    """One row for each language of the list and each script, so the driver gets a bounded number."""
    quartiles = lambda c: F.percentile_approx(c, F.array(*map(F.lit, (0.25, 0.5, 0.75))), 10_000)
    rows = (measured.filter(~F.col("_base")).groupBy("_group")
            .agg(quartiles(chars_per_token()).alias("chars"), quartiles(F.col("_m.token_entropy")).alias("entropy"))
            .collect())
    out = []
    for r in rows:
        (low, mid, high), entropy = r["chars"], r["entropy"]
        out.append({"group": r["_group"], "middle": mid, "reach": max(SPREAD * (high - low), LEAST_REACH * mid),
                    "chars_high": MOST_CHARS * mid, "entropy_low": LEAST_ENTROPY * entropy[1]})
    return sorted(out, key=lambda x: x["group"])


def verdict(rules: list[dict]) -> Column:
    """True where a document is outside its group's band.

    The mean of few words strays further: below ``FULL_WORDS`` the band widens with the root of the length.
    """
    wider = F.sqrt(F.greatest(F.lit(1.0), FULL_WORDS / F.greatest(F.col("_m.n_words"), F.lit(1))))
    outside = F.lit(False)
    for r in rules:
        bad = ((chars_per_token() < r["middle"] - r["reach"] * wider) | (chars_per_token() > r["chars_high"])
               | (F.col("_m.token_entropy") < r["entropy_low"]) | (F.col("_m.byte_share") > MOST_BYTES))
        outside = F.when(F.col("_group") == r["group"], bad).otherwise(outside)
    return outside


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          folder: str = FOLDER) -> DataFrame:
    """Per row: its id, the measures, ``base_failed`` and ``kept``."""
    few = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    measured = cut(with_measures(few, "_text", "_lang", folder).drop("_text"))
    outside = verdict(bands(measured))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return measured.select(
        "doc_id", *[F.col(f"_m.{n}").alias(n) for n in names], F.col("_base").alias("base_failed"),
        (~F.col("_base") & ~outside).alias("kept"), F.col("_group").alias("band"),
        chars_per_token().alias("chars_per_token"),
        F.col("_m.byte_share").alias("byte_share"), F.col("_m.token_entropy").alias("token_entropy"))


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", folder: str = FOLDER) -> DataFrame:
    """The rows that pass, columns unchanged.

    The texts are measured twice, once for the bands and once for the verdicts: cheaper than
    writing or shuffling every text in between.
    """
    rules = bands(with_measures(docs.select(F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang")),
                                "_text", "_lang", folder).drop("_text"))
    judged = with_measures(packed(docs), f"row.`{text_col}`", f"row.`{lang_col}`", folder)
    return judged.filter(~F.col("_base") & ~verdict(rules)).select("row.*")
