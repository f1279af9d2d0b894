"""Sum-of-squares online packing of token sequences into windows of fixed size.

Each task reads its documents in turn, encodes them and packs them online. A document of more than one window
gives full windows first; what is left (or the whole document) goes to the fill level that makes the sum of the
squared counts of partially filled windows least: with ``N[h]`` open windows filled to ``h``, an item of ``s`` tokens
placed at level ``h`` changes the sum by ``2 (N[h + s] - N[h] + 1)``, by ``1 - 2 N[h]`` where it fills the window, and by
``2 N[s] + 1`` as a new window. The counts stand in a level array; ties go to the fullest level.

A window leaves the task when it is full. At the end of a task (and whenever more than ``open_windows`` are open, so
that memory is bounded) the emptiest windows are cut up to fill the fullest. What then remains, less than one window
a task, goes into sequences whose lengths are powers of two. So no sequence is padded at all. Documents are neither
shuffled nor sorted: the packing is a projection of the scan, and a lost task packs its own documents again.

Defined results: a null or empty text is the end mark alone; each row is a document of its own, also where ids or
texts repeat or are null; an empty table has no pieces; which documents share a sequence depends on how the input is
split into tasks, what a document's ids are does not; other columns do not matter, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablevault.llm.word_bpe import encoder

WINDOW = 2048
END = 1
#: Partially filled windows that a task holds at most (16 MiB of ids and their pieces).
OPEN_WINDOWS = 2048
#: Rows of one batch that a task hands on.
ROWS = 8192


class Piece:
    """A run of one document's ids."""

    __slots__ = ("doc", "start", "ids", "total")

    def __init__(self, doc, start: int, ids: np.ndarray, total: int):
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return (Piece(self.doc, self.start, self.ids[:at], self.total),
                Piece(self.doc, self.start + at, self.ids[at:], self.total))


class Packer:
    """Windows of one task; ``add`` and ``finish`` yield sequences (lists of pieces)."""

    def __init__(self, window: int = WINDOW, open_windows: int = OPEN_WINDOWS):
        self.window, self.open_windows = window, open_windows
        self.counts = np.zeros(window + 1, dtype=np.int64)
        self.levels: list[list[list[Piece]]] = [[] for _ in range(window)]
        self.n_open = 0

    def level(self, size: int) -> int:
        """The fill level at which an item of ``size`` tokens makes the sum of squares least (0: a new window)."""
        n, full = self.counts, self.window - size
        cost = 2 * (n[size:self.window + 1] - n[:full + 1] + 1)  # by level 0..full
        cost[0] = 2 * n[size] + 1
        if full:
            cost[full] = 1 - 2 * n[full]
            cost[1:][n[1:full + 1] == 0] = np.iinfo(np.int64).max
        return full - int(np.argmin(cost[::-1]))

    def add(self, doc, ids: np.ndarray) -> Iterator[list[Piece]]:
        total, at = len(ids), 0
        while total - at >= self.window:
            yield [Piece(doc, at, ids[at:at + self.window], total)]
            at += self.window
        size = total - at
        if not size:
            return
        h = self.level(size)
        pieces: list[Piece] = []
        if h:
            pieces = self.levels[h].pop()
            self.counts[h] -= 1
            self.n_open -= 1
        # a copy: a slice would keep the whole document's ids
        pieces.append(Piece(doc, at, ids[at:].copy() if at else ids, total))
        if h + size == self.window:
            yield pieces
            return
        self.levels[h + size].append(pieces)
        self.counts[h + size] += 1
        self.n_open += 1
        if self.n_open > self.open_windows:
            yield from self.merge()

    def merge(self) -> Iterator[list[Piece]]:
        """Fill the fullest open windows from the emptiest; one may stay open."""
        order = [w for level in reversed(self.levels) for w in level]
        self.levels = [[] for _ in range(self.window)]
        self.counts[:] = 0
        self.n_open = 0
        low, high = 0, len(order) - 1
        while low <= high:
            pieces = order[low]
            room = self.window - sum(len(p.ids) for p in pieces)
            while room and high > low:
                giver = order[high]
                piece = giver.pop()
                if len(piece.ids) > room:
                    piece, rest = piece.cut(room)
                    giver.append(rest)
                pieces.append(piece)
                room -= len(piece.ids)
                if not giver:
                    high -= 1
            low += 1
            if room:
                self.levels[self.window - room].append(pieces)
                self.counts[self.window - room] += 1
                self.n_open += 1
            else:
                yield pieces

    def finish(self) -> Iterator[list[Piece]]:
        yield from self.merge()
        for level in self.levels:
            for pieces in level:
                yield from powers_of_two(pieces)


def powers_of_two(pieces: list[Piece]) -> Iterator[list[Piece]]:
    """The pieces as sequences whose lengths are the powers of two in their sum, the largest first."""
    left = sum(len(p.ids) for p in pieces)
    rest = pieces[::-1]
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        sequence = []
        while room:
            piece = rest.pop()
            if len(piece.ids) > room:
                piece, after = piece.cut(room)
                rest.append(after)
            sequence.append(piece)
            room -= len(piece.ids)
        yield sequence


COLUMNS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
         open_windows: int = OPEN_WINDOWS, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row per piece: the id column, ``COLUMNS`` (all long) and, if asked for, the piece's ``ids``.

    ``tokenizer`` is the path of a ``tokenizers`` file; the driver reads it and sends it with the tasks. ``sequence_id``
    holds the task in its upper bits and the sequence's number there in the lower 33.
    """
    from tablevault.llm.sentencepieces import _model_bytes

    data = _model_bytes(tokenizer)
    fields = [T.StructField(id_col, docs.schema[id_col].dataType),
              *[T.StructField(c, T.LongType()) for c in COLUMNS],
              *([T.StructField("ids", T.ArrayType(T.LongType()))] if with_ids else [])]
    schema = T.StructType(fields)

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[list[Piece]]:
        coder, packer, mark = encoder(data), Packer(window, open_windows), np.array([end], dtype=np.uint32)
        for batch in batches:
            names = batch.column(0)
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            for i, ids in enumerate(coder.encode(texts)):
                yield from packer.add(names[i], np.concatenate([ids, mark]))
        yield from packer.finish()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []
        kept: list[np.ndarray] = []
        id_type = None

        def frame() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            arrays = [pa.array([x.as_py() for x in columns[0]], type=id_type),
                      *[pa.array(c, type=pa.int64()) for c in columns[1:]]]
            if with_ids:
                ends = np.cumsum([0, *[len(k) for k in kept]], dtype=np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(kept).astype(np.int64))))
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        def watched() -> Iterator[pa.RecordBatch]:
            nonlocal id_type
            for batch in batches:
                id_type = batch.schema.field(0).type
                yield batch

        for number, sequence in enumerate(sequences(watched())):
            offset = 0
            for p in sequence:
                rows.append((p.doc, p.start, len(p.ids), zlib.crc32(p.ids.astype("<u4").tobytes()), p.total,
                             first + number, offset))
                offset += len(p.ids)
                if with_ids:
                    kept.append(p.ids)
            if len(rows) >= ROWS:
                yield frame()
                rows, kept = [], []
        if rows:
            yield frame()

    # the two columns by position, so that no other column's name can clash
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")).mapInArrow(pieces, schema)
