"""W4 in the files: dumps that are compressed and then encrypted, and their reader.

A part file holds chunks of whole script rows, a line each: base64 of AES-256-CBC (random IV in front, PKCS#7) over a
small head and the compressed text. Chunks are made where the sorted rows are, so nothing beyond one is buffered. The key
comes from a provider that is called in the tasks; it stands neither in a plan nor in the files. A chunk that was
encrypted with another key, or changed, fails the job.
"""

from __future__ import annotations

import base64
import bz2
import gzip
import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablevault.plans.script import assemble
from tablevault.sinks.writers import codec

#: Text of one chunk before compression; a longer script row is a chunk of its own.
CHUNK_BYTES = 1 << 20

#: Returns the 32 bytes of a key; called in tasks, once a batch.
KeyProvider = Callable[[], bytes]

# Head of a chunk: a mark that tells a right key, the codec, the chunk's number in its partition.
_HEAD, _HEAD_SIZE = ">4sBq", 13
_MARK = b"tvc1"
_PACK = {"gzip": (1, lambda b: gzip.compress(b, mtime=0), gzip.decompress), "bzip2": (2, bz2.compress, bz2.decompress),
         "none": (3, bytes, bytes)}


def key_provider(text: str | None = None, path: str | None = None) -> KeyProvider:
    """A provider of the key given as base64 text, or kept in a file that the tasks can read; exactly one of them.

    Text is decoded here, so that a bad key fails before the job; a file is opened in the tasks and may hold 32 raw bytes or
    their base64.
    """
    if (text is None) == (path is None):
        raise ValueError("give the key as text or as a file, one of them")
    if text is not None:
        key = base64.b64decode(text, validate=True)
        if len(key) != 32:
            raise ValueError("AES-256 needs a 32-byte key")
        return lambda: key

    def read() -> bytes:
        from pyarrow import fs

        from tablevault.sources.listing import normalize_url

        filesystem, name = fs.FileSystem.from_uri(normalize_url(path))
        with filesystem.open_input_stream(name, compression=None) as handle:
            data = handle.read(1 << 10)
        key = data if len(data) == 32 else base64.b64decode(data.strip(), validate=True)
        if len(key) != 32:
            raise ValueError("AES-256 needs a 32-byte key")
        return key

    return read


def _key_column(provider: KeyProvider, row: str) -> Column:
    """The key beside each row; the plan shows a function, not its value."""

    @F.pandas_udf("binary")
    def key(rows: pd.Series) -> pd.Series:
        return pd.Series([provider()] * len(rows), dtype=object)

    return key.asNondeterministic()(F.col(row))


def _chunks(compression: str, chunk_bytes: int):
    number, pack, _ = _PACK[compression]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        db, held, size, chunk = None, [], 0, 0

        def done() -> pd.DataFrame:
            nonlocal chunk
            data = struct.pack(_HEAD, _MARK, number, chunk) + pack("\n".join(held).encode())
            chunk += 1
            return pd.DataFrame([(db, chunk, data)], columns=["db", "chunk", "data"])

        for batch in batches:
            for name, value in zip(batch["db"], batch["value"], strict=True):
                n = len(value.encode())
                if held and (name != db or size + n > chunk_bytes):
                    yield done()
                    held, size = [], 0
                db = name
                held.append(value)
                size += n + 1
        if held:
            yield done()

    return run


def write_encrypted_dump(script: DataFrame, path: str, provider: KeyProvider, compression: str = "gzip",
                         num_partitions: int | None = None, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Write a dump as encrypted part files, ``path/db=<name>/part-*``; sorted names and lines give the script."""
    codec(compression)
    rows = assemble(script, num_partitions).select("db", "value")
    chunks = rows.mapInPandas(_chunks(compression, chunk_bytes), "db string, chunk long, data binary")
    line = F.base64(F.aes_encrypt("data", _key_column(provider, "chunk"), F.lit("CBC"), F.lit("PKCS")))
    # Spark's base64 breaks lines of 76 characters
    (chunks.select("db", F.regexp_replace(line, r"\s", "").alias("value")).write.mode("errorifexists")
     .option("compression", "none").partitionBy("db").text(path))


def _opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from tablevault.operators.restore import statements_of

    unpack = {number: back for number, _, back in _PACK.values()}
    for batch in batches:
        for db, file, data in zip(batch["db"], batch["file"], batch["data"], strict=True):
            mark, number, chunk = struct.unpack_from(_HEAD, data)
            if mark != _MARK:
                raise ValueError(f"{file}: a chunk cannot be read with this key")
            text = unpack[number](data[_HEAD_SIZE:])
            rows = [(db, file, (chunk << 32) + i, s) for i, s in enumerate(statements_of([text]))]
            yield pd.DataFrame(rows, columns=["db", "file", "pos", "stmt"])


def read_encrypted_scripts(spark: SparkSession, path: str, provider: KeyProvider) -> DataFrame:
    """(db, file, pos, stmt) of an encrypted dump; ``pos`` orders the statements of a file, with gaps between chunks.

    Any number of tasks share a file, as its lines are read by themselves.
    """
    lines = spark.read.text(path.rstrip("/")).select(
        F.col("db").cast("string").alias("db"), F.col("_metadata.file_path").alias("file"), F.col("value"),
        F.monotonically_increasing_id().alias("row"))
    data = F.aes_decrypt(F.unbase64("value"), _key_column(provider, "row"), F.lit("CBC"), F.lit("PKCS"))
    return lines.select("db", "file", data.alias("data")).mapInPandas(_opened, "db string, file string, pos long, stmt string")
