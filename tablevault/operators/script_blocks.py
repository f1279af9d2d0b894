"""S6 over large plain scripts: one file read by many tasks.

A file is cut into blocks at line beginnings. What a line begins within (nothing, one of three quotes, a comment) and
which delimiter is in force depend on all lines before, so a block is a function from that entry state to its exit
state and its number of statements. Nearly all blocks begin outside quotes with the usual delimiter: that value is
computed for every block, and if all blocks end in it too, nothing else is needed. Otherwise the exits of the files'
blocks are computed for every kind of entry, composed along each file (one small row a block), and the blocks with
another entry are counted again from their own.

Statements that lie within a block leave their task whole; the two ends of a block, which belong to statements that go
on in its neighbours, meet in a grouping by statement number. Positions count statements as one pass over the file would.
A task takes many small blocks, one after another, so that the number of tasks follows the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablevault.session import ensure_checkpoint_dir

BLOCK_BYTES = 64 << 20
#: Blocks of about so many bytes are one task.
TASK_BYTES = 16 << 20
READ_AHEAD = 1 << 16

#: What a line can begin within, and text that leads there.
CONTEXTS = {"": b"", "'": b"'", '"': b'"', "`": b"`", "/*": b"/* "}
USUAL = ("", ";")
#: A delimiter that no script holds: one pass with it tells which one a block leaves in force, if any.
UNCHANGED = b"\x00\x01"


def line_start(handle, at: int, size: int) -> int:
    """The first line beginning at or after ``at``."""
    if at <= 0:
        return 0
    at -= 1
    while at < size:
        handle.seek(at)
        part = handle.read(min(READ_AHEAD, size - at))
        found = part.find(b"\n")
        if found >= 0:
            return at + found + 1
        at += len(part)
    return size


def block_bytes_of(handle, block: int, size: int, block_bytes: int) -> bytes:
    """The lines that begin in a block's range."""
    start = line_start(handle, block * block_bytes, size)
    if start >= min((block + 1) * block_bytes, size):
        return b""  # a line of an earlier block reaches over this one
    end = line_start(handle, (block + 1) * block_bytes, size)
    handle.seek(start)
    return handle.read(end - start)


def scan(data: bytes, context: str, delimiter: bytes) -> tuple[list[bytes], bytes, str, bytes]:
    """(pieces up to each delimiter, what is left, exit context, exit delimiter) of a block."""
    from tablevault.operators.restore import Splitter

    lead = CONTEXTS[context]
    splitter = Splitter(delimiter)
    pieces = list(splitter.cuts(lead + data, final=True))
    rest = splitter.rest()
    if pieces:
        pieces[0] = pieces[0][len(lead):]
    else:
        rest = rest[len(lead):]
    return pieces, rest, splitter.open.decode(), splitter.delimiter


EXIT = "context_out string, delimiter_out string"
STATE = "root string, path string, size long, block long, context string, delimiter string"
SUMMARY = f"{STATE}, {EXIT}, n_cuts long, inner long, head_blank boolean, rest_blank boolean, head long, rest long"
SUMMARY_NAMES = [f.split(" ")[0] for f in SUMMARY.split(", ")]
#: Rows of a frame handed on at once.
BATCH_ROWS = 1000


def _open(root: str, path: str):
    from pyarrow import fs

    from tablevault.sources.listing import normalize_url

    return fs.FileSystem.from_uri(normalize_url(root))[0].open_input_file(path)


def _block_data(batches: Iterator[pd.DataFrame], block_bytes: int) -> Iterator[tuple]:
    """Each row with the bytes of its block; rows in succession share an open file and a block's bytes."""
    file, block, handle, data = None, None, None, b""
    try:
        for batch in batches:
            for r in batch.itertuples(index=False):
                if (r.root, r.path) != file:
                    if handle is not None:
                        handle.close()
                    handle, file, block = _open(r.root, r.path), (r.root, r.path), None
                if r.block != block:
                    data, block = block_bytes_of(handle, r.block, r.size, block_bytes), r.block
                yield r, data
    finally:
        if handle is not None:
            handle.close()


def _summaries(blocks: DataFrame, block_bytes: int) -> DataFrame:
    """``SUMMARY`` of blocks with their entry states; ``blocks`` are dealt to tasks already."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []
        for r, data in _block_data(batches, block_bytes):
            delimiter = UNCHANGED if r.delimiter is None else r.delimiter.encode()
            pieces, rest, context, after = scan(data, r.context, delimiter)
            held.append((*r, context, None if after == UNCHANGED else after.decode(), len(pieces),
                         sum(1 for p in pieces[1:] if p.strip()), not (pieces and pieces[0].strip()), not rest.strip(),
                         len(pieces[0]) if pieces else len(data), len(rest) if pieces else 0))
            if len(held) >= BATCH_ROWS:
                yield pd.DataFrame(held, columns=SUMMARY_NAMES)
                held = []
        if held:
            yield pd.DataFrame(held, columns=SUMMARY_NAMES)

    return blocks.mapInPandas(run, SUMMARY).checkpoint()


def _spread(rows: DataFrame, block_bytes: int) -> DataFrame:
    """Blocks dealt in turn to tasks of about ``TASK_BYTES``, one block at least; few blocks to all cores."""
    many = rows.count()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(1, min(many, max(-(-many * block_bytes // TASK_BYTES), 2 * cores))))


def _entries(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The true entry state of each block of a file, from the exits for every kind of entry."""
    exits = {(int(r.block), r.context): (r.context_out, r.delimiter_out) for r in rows.itertuples(index=False)}
    first = rows.iloc[0]
    context, delimiter = USUAL
    found = []
    for block in sorted({b for b, _ in exits}):
        found.append((first["root"], first["path"], int(first["size"]), block, context, delimiter))
        context, left = exits[block, context]
        delimiter = left if left is not None else delimiter
    return pd.DataFrame(found, columns=SUMMARY_NAMES[:6])


PLACE = f"{STATE}, ordinal long, pos long, inner_pos long, rest_pos long, n_cuts long, head long, rest long"
PLACE_NAMES = [f.split(" ")[0] for f in PLACE.split(", ")]


def _places(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Delimiters and statements before each block of a file."""
    ordinal = pos = 0
    blank, found = True, []
    for r in rows.sort_values("block").itertuples(index=False):
        ended = int(r.n_cuts > 0 and not (blank and r.head_blank))
        found.append((r.root, r.path, int(r.size), int(r.block), r.context, r.delimiter, ordinal, pos, pos + ended,
                      pos + ended + int(r.inner), int(r.n_cuts), int(r.head), int(r.rest)))
        pos += ended + int(r.inner)
        ordinal += int(r.n_cuts)
        blank = bool(r.rest_blank) and (blank or r.n_cuts > 0)
    return pd.DataFrame(found, columns=PLACE_NAMES)


PIECES = "file string, ordinal long, pos long, part long, piece binary"


def _inner(places: DataFrame, block_bytes: int, batch_bytes: int) -> DataFrame:
    """(file, pos, stmt) of the statements that lie within a block."""
    from tablevault.operators.restore import SPLIT_SCHEMA

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tablevault.operators.restore import _as_text

        held, size = [], 0
        for r, data in _block_data(batches, block_bytes):
            pos = r.inner_pos
            for piece in scan(data, r.context, r.delimiter.encode())[0][1:]:
                if piece := piece.strip():
                    held.append((r.path, pos, _as_text(piece)))
                    pos += 1
                    size += len(piece)
                    if size >= batch_bytes:
                        yield pd.DataFrame(held, columns=["file", "pos", "stmt"])
                        held, size = [], 0
        if held:
            yield pd.DataFrame(held, columns=["file", "pos", "stmt"])

    return places.mapInPandas(run, SPLIT_SCHEMA)


def _ends(places: DataFrame, block_bytes: int, batch_bytes: int) -> DataFrame:
    """``PIECES`` at the ends of blocks, cut out by their lengths: the first ends what earlier blocks began, the last goes
    on in later ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for r, data in _block_data(batches, block_bytes):
            held.append((r.path, r.ordinal, r.pos, r.block, data[:r.head]))
            if r.rest:
                held.append((r.path, r.ordinal + r.n_cuts, r.rest_pos, r.block, data[len(data) - r.rest:]))
            size += r.head + r.rest
            if size >= batch_bytes:
                yield pd.DataFrame(held, columns=["file", "ordinal", "pos", "part", "piece"])
                held, size = [], 0
        if held:
            yield pd.DataFrame(held, columns=["file", "ordinal", "pos", "part", "piece"])

    return places.mapInPandas(run, PIECES)


def _meet(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One statement from its pieces in several blocks."""
    from tablevault.operators.restore import _as_text

    rows = rows.sort_values("part")
    text = b"".join(rows["piece"]).strip()
    found = [(key[0], int(rows["pos"].min()), _as_text(text))] if text else []
    return pd.DataFrame(found, columns=["file", "pos", "stmt"])


def read_blocks(files: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, pos, stmt) of uncompressed scripts ``files`` (root, path, size), read by blocks of ``block_bytes``.

    A task holds one block, and lines that reach over its end; a statement that spans blocks meets in one row.
    """
    from tablevault.operators.restore import BATCH_BYTES, SPLIT_SCHEMA

    ensure_checkpoint_dir(files.sparkSession)
    last = F.floor((F.col("size") - 1) / block_bytes)
    blocks = files.where("size > 0").select("root", "path", F.col("size").cast("long").alias("size"),
                                            F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    blocks = _spread(blocks, block_bytes)
    usual = blocks.select("*", F.lit(USUAL[0]).alias("context"), F.lit(USUAL[1]).alias("delimiter"))
    found = _summaries(usual, block_bytes)
    odd = found.where((F.col("context_out") != USUAL[0]) | (F.col("delimiter_out") != USUAL[1])).select("root", "path").distinct()
    if odd.limit(1).count():
        kinds = F.explode(F.array(*[F.lit(c) for c in CONTEXTS])).alias("context")
        few = _spread(found.join(odd, ["root", "path"], "left_semi").select("root", "path", "size", "block"), block_bytes)
        every = few.select("*", kinds, F.lit(None).cast("string").alias("delimiter"))
        entries = (_summaries(every, block_bytes).drop("n_cuts", "inner", "head_blank", "rest_blank", "head", "rest")
                   .groupBy("root", "path").applyInPandas(_entries, STATE).checkpoint())
        others = entries.where((F.col("context") != USUAL[0]) | (F.col("delimiter") != USUAL[1]))
        again = _summaries(_spread(others, block_bytes), block_bytes)
        found = found.join(others.select("root", "path", "block"), ["root", "path", "block"], "left_anti").unionByName(again)
    places = _spread(found.groupBy("root", "path").applyInPandas(_places, PLACE).checkpoint(), block_bytes)
    met = _ends(places, block_bytes, BATCH_BYTES).groupBy("file", "ordinal").applyInPandas(_meet, SPLIT_SCHEMA)
    return _inner(places, block_bytes, BATCH_BYTES).unionByName(met)
