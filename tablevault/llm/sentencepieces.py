"""SentencePiece encoding and decoding with the tokenizers library as backend.

A model file is a protobuf message. ``read_model`` takes from it what encoding needs: the pieces with
scores and types, the algorithm, and the normaliser's settings. ``backend`` rebuilds that as a
``tokenizers.Tokenizer``: the compiled character map, the metaspace mark, unigram scores or the merges
that the scores imply, byte fallback. Batches are encoded by the library's threads inside a task.

Parity: every text is encoded by sentencepiece as well; where the ids differ, sentencepiece's are returned and the row
says so. The ids returned are decoded again and must give the normalised text; the row says whether they do.

Defined results: a null or empty text has no ids and decodes to the empty string; strings that look
like control pieces are ordinary text; a metaspace mark (U+2581) in a text decodes to a space, as in SentencePiece itself; lone surrogates cannot occur in Spark strings; equal rows get
equal results; other columns do not matter.
"""

from __future__ import annotations

import functools
import itertools
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf, pandas_udf

from tablevault.llm.common import once

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "\u2581"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2

FIELDS = "ids array<int>, n_tokens int, n_byte_tokens int, round_trip boolean, parity boolean"

#: One text in so many is encoded by sentencepiece too.
PARITY_EVERY = 1


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if b < 0x80:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a message's fields in order; a value is an int, or bytes as they stand."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        wire = key & 7
        if wire == 0:
            value, at = _varint(data, at)
        elif wire == 2:
            size, at = _varint(data, at)
            value, at = data[at:at + size], at + size
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            value, at = data[at:at + size], at + size
        else:
            raise ValueError(f"wire type {wire} at byte {at} is no part of a SentencePiece model")
        yield key >> 3, value


def read_model(data: bytes) -> Model:
    """The parts of a serialised model: pieces (field 1), trainer (2) and normaliser (3) settings."""
    model = Model()
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
            model.pieces.append((piece.get(1, b"").decode(), score, piece.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
            model.kind, model.byte_fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
        elif number == 3:
            rules = dict(_fields(value))
            model.charsmap = rules.get(2, b"")
            model.dummy_prefix, model.squeeze, model.escape = (bool(rules.get(k, 1)) for k in (3, 4, 5))
    if not model.pieces:
        raise ValueError("the file holds no pieces")
    return model


def implied_merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """The pairs that BPE may join, best first: every cut of a piece into two other pieces.

    SentencePiece joins the pair whose joined piece scores best, the leftmost first among equals. A merge
    list orders pairs, so pairs with the same result stand together.
    """
    score = {p: s for p, s, t in pieces if t in (NORMAL, USER_DEFINED)}
    found = []
    for rank, (piece, _) in enumerate(sorted(score.items(), key=lambda x: -x[1])):
        for i in range(1, len(piece)):
            left, right = piece[:i], piece[i:]
            if left in score and right in score:
                found.append((rank, left, right))
    found.sort(key=lambda x: (x[0], -score[x[1]], -score[x[2]]))
    return [(left, right) for _, left, right in found]


def backend(model: Model):
    """A ``tokenizers.Tokenizer`` that encodes as the model does."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    unknown = next(i for i, p in enumerate(model.pieces) if p[2] == UNKNOWN)
    if model.kind == BPE:
        tokenizer = Tokenizer(models.BPE(
            {p: i for i, (p, _, _) in enumerate(model.pieces)}, implied_merges(model.pieces),
            unk_token=model.pieces[unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback,
            cache_capacity=0))  # it would remember whole texts
    elif model.kind == UNIGRAM:
        tokenizer = Tokenizer(models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=unknown,
                                             byte_fallback=model.byte_fallback))
    else:
        raise ValueError(f"algorithm {model.kind}: only unigram and BPE models can be rebuilt")
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if model.escape:
        steps.append(normalizers.Replace(" ", SPACE))
    tokenizer.normalizer = normalizers.Sequence(steps)
    tokenizer.decoder = decoders.Sequence(
        [decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse(),
         *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])])
    return tokenizer


class Encoder:
    """Encodes and decodes batches with one model."""

    def __init__(self, data: bytes):
        import sentencepiece

        self.model = read_model(data)
        self.tokenizer = backend(self.model)
        self.normalizer, self.tokenizer.normalizer = self.tokenizer.normalizer, None
        self.plain = not (self.model.charsmap or self.model.squeeze)
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.bytes = [bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(SPACE, " ").encode()
                      for p, _, t in self.model.pieces]
        self.is_byte = np.array([t == BYTE for _, _, t in self.model.pieces])

    def normal(self, text: str) -> str:
        if not self.plain:
            return self.normalizer.normalize_str(text) if text else text
        text = " " + text if self.model.dummy_prefix and text else text
        return text.replace(" ", SPACE) if self.model.escape else text

    def encode(self, normal: list[str]) -> list[np.ndarray]:
        """Ids of normalised texts; the library's threads share a batch."""
        return [np.array(e.ids, dtype=np.int32)
                for e in self.tokenizer.encode_batch_fast(normal, add_special_tokens=False)]

    def decode(self, ids) -> str:
        text = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


def encoded(texts: list[str], encoder: Encoder, parity_every: int) -> list[tuple]:
    """The fields of ``FIELDS`` for each text.

    Where sentencepiece gives other ids, they are its own, and the round trip is theirs.
    """
    out = []
    normal = [encoder.normal(t) for t in texts]
    checked = [parity_every == 1 or zlib.crc32(t.encode()) % parity_every == 0 for t in texts]
    theirs = iter(encoder.reference.encode(list(itertools.compress(texts, checked)), num_threads=1))
    for text, norm, ids, check in zip(texts, normal, encoder.encode(normal), checked, strict=True):
        want = norm.replace(SPACE, " ") if encoder.model.escape else norm
        want = want[1:] if encoder.model.dummy_prefix and want.startswith(" ") else want
        other = next(theirs) if check else None
        if other is None:
            whole, same = encoder.decode(ids.tolist()) == want, None
            if not whole:
                other = encoder.reference.encode(text, num_threads=1)
        if other is not None:
            as_array = np.array(other, dtype=np.int32)
            same = np.array_equal(ids, as_array)
            ids, whole = as_array, encoder.decode(other) == want
        out.append((ids, len(ids), int(encoder.is_byte[ids].sum()), whole, same))
    return out


def _model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read()
    if len(data) > 64 << 20:
        raise ValueError(f"{path}: {len(data)} bytes are too many to send with every task")
    return data


@functools.lru_cache(maxsize=2)
def _encoder(data: bytes) -> Encoder:
    """One encoder a worker process, kept from task to task."""
    return Encoder(data)


def _columns(rows: list[tuple]) -> pa.StructArray:
    """``FIELDS`` as Arrow columns, the ids as one run of numbers with the texts' ends."""
    ids, n, n_bytes, whole, same = zip(*rows, strict=True) if rows else ((),) * 5
    ends = np.cumsum([0, *n], dtype=np.int32)
    values = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32)
    arrays = [pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int32())), pa.array(n, pa.int32()),
              pa.array(n_bytes, pa.int32()), pa.array(whole, pa.bool_()), pa.array(same, pa.bool_())]
    return pa.StructArray.from_arrays(arrays, names=[f.split()[0] for f in FIELDS.split(", ")])


def encode(docs: DataFrame, text_col: str = "text", out: str = "pieces", model: str = MODEL,
           parity_every: int = PARITY_EVERY, batch: int = 64) -> DataFrame:
    """``docs`` with a struct column ``out`` of ``FIELDS``.

    The driver reads the model file and sends it with the tasks, so executors need no copy of it.
    """
    data = _model_bytes(model)

    @arrow_udf(FIELDS)
    def pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(data)
        for texts in batches:
            texts = ["" if t is None else t for t in texts.to_pylist()]
            parts = []
            for i in range(0, len(texts), batch):  # few texts in flight, however large the Arrow batch
                parts.append(_columns(encoded(texts[i:i + batch], encoder, parity_every)))
            yield pa.concat_arrays(parts) if parts else _columns([])

    return docs.withColumn(out, once(pieces)(F.col(text_col).cast("string")))


def decode(df: DataFrame, ids_col: str, out: str = "text", model: str = MODEL) -> DataFrame:
    """``df`` with the text that the ids stand for (null ids: empty)."""
    data = _model_bytes(model)

    @pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(data)
        for ids in batches:
            yield pd.Series([encoder.decode(x.tolist()) if x is not None else "" for x in ids], dtype=object)

    return df.withColumn(out, texts(F.col(ids_col)))
