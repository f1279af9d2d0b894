"""Restore: split scripts into statements, rename databases, load INSERT text back into rows.

R4 is the core of restore on Spark. Statements are found, cut into tuples and values with Java
regular expressions (possessive quantifiers: linear, no deep backtracking), exploded, unescaped
and cast to the target schema - all JVM expressions, no Python per row. R1 (whole-script split by the
script grammar) is inherently sequential inside one file, so it runs once per file in ``mapInPandas``;
the dump writer never lets a statement cross a file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablevault.functions.literals import unescape_sql
from tablevault.operators.common import broadcast_if_small
from tablevault.operators.ddl import parse_create_table, with_computed
from tablevault.operators.script_blocks import BLOCK_BYTES, read_blocks

# Java regular expressions for the dump grammar (section 7.5 of the survey).
QUOTED = r"'(?:[^'\\]++|\\.|'')*+'"
NAME = r"`(?:[^`]++|``)++`"
STATEMENT_RE = r"(?s)INSERT INTO (?:[^';]++|" + QUOTED + r")*+;"
TUPLE_RE = r"(?s)\((?:[^'()]++|" + QUOTED + r")*+\)"
VALUE_RE = r"(?s)_binary\s*+" + QUOTED + r"|[Xx]'[0-9A-Fa-f]*+'|" + QUOTED + r"|[^,']++"
TABLE_RE = r"^INSERT INTO (" + NAME + r")"
# everything before the first tuple, anchored: data cannot be mistaken for it
HEAD_RE = r"^INSERT INTO " + NAME + r" ?\(((?:" + NAME + r",? ?)++)\) VALUES ?"

SPLIT_SCHEMA = "file string, pos long, stmt string"


# --- R1 / S6: statements of whole scripts -------------------------------------------------------
#
# The grammar of a script: statements end at the delimiter (";" until a DELIMITER line names another), but not
# inside quotes or comments. A quoted string or name ends at its quote; a doubled quote stays inside, and so
# does a quote after a backslash (not in names). Comments run to the line's end after "-- " or "#", or from
# "/*" to "*/"; those that begin with "/*!" hold code and are scanned as such.

_TOKEN = re.compile(
    rb"'(?:[^'\\]++|\\.|'')*+'|\"(?:[^\"\\]++|\\.|\"\")*+\"|`(?:[^`]++|``)*+`|/\*(?!!).*?\*/|(?:--(?=\s)|#)[^\n]*|/\*!|\*/", re.S)
_OPENERS = re.compile(rb"['\"`#]|--(?=\s)|/\*")
_PLAIN = re.compile(rb"(?:[^'\"`#/;\n-]++|'(?:[^'\\]++|\\.)*+'|`[^`]*+`)*+", re.S)
_DELIMITER_LINE = re.compile(rb"[ \t]*DELIMITER[ \t]+(\S+)[ \t]*\r?\n?", re.I)
_BINARY = re.compile(rb"_binary\s*'((?:[^'\\]|\\.|'')*)'", re.S)
_ESCAPED = re.compile(rb"\\(.)|''", re.S)
# MySQL escapes, letter and byte.
_BYTES = {b"0": b"\x00", b"b": b"\b", b"n": b"\n", b"r": b"\r", b"t": b"\t", b"Z": b"\x1a"}


def _as_text(statement: bytes) -> str:
    """A statement as text. Raw bytes in ``_binary`` literals become hex literals of the same value."""
    try:
        return statement.decode("utf-8")
    except UnicodeDecodeError:
        pass

    def hexed(m: re.Match) -> bytes:
        raw = _ESCAPED.sub(lambda e: b"'" if e[1] is None else _BYTES.get(e[1], e[1]), m[1])
        return b"X'" + raw.hex().upper().encode() + b"'"

    return _BINARY.sub(hexed, statement).decode("utf-8")


class Splitter:
    """Finds statements in a stream of byte blocks; holds the open statement and nothing before it."""

    def __init__(self, delimiter: bytes = b";"):
        self.data, self.scanned, self.delimiter = bytearray(), 0, delimiter
        self.open = b""  # what the text ends within: a quote's or comment's beginning

    def feed(self, block: bytes, final: bool = False) -> Iterator[bytes]:
        """Statements without the white space around them; blank ones are passed over."""
        for piece in self.cuts(block, final):
            if statement := piece.strip():
                yield statement
        if final and (statement := self.rest().strip()):
            yield statement

    def rest(self) -> bytes:
        """The open statement."""
        left = bytes(self.data)
        self.data, self.scanned = bytearray(), 0
        return left

    def cuts(self, block: bytes, final: bool = False) -> Iterator[bytes]:
        """The text up to each delimiter, which stays only if it is a semicolon."""
        self.data += block
        while self.scanned < len(self.data):
            data, at = self.data, self.scanned
            if at == 0 or data[at - 1] == 10:  # only a line's beginning can change the delimiter
                word = bytes(data[at:at + 256]).lstrip(b" \t")[:10].upper()
                if len(word) < 10 and not final:
                    return
                if word.startswith((b"DELIMITER ", b"DELIMITER\t")):
                    end = data.find(b"\n", at)
                    if end < 0 and not final:
                        return
                    line = _DELIMITER_LINE.match(data, at)
                    if line:
                        size, delimiter = line.end() - line.start(), bytes(line[1])
                        del line  # it refers to the buffer
                        yield self._cut(at, 0)
                        del self.data[:size]
                        self.delimiter = delimiter
                        continue
            if self.delimiter == b";":  # values and names in one step
                run = _PLAIN.match(data, at).end()
                if run > at:
                    self.scanned = run
                    continue
            end = data.find(b"\n", at)
            # a delimiter or the start of a comment may be cut by the end of the block
            stop = end + 1 if end >= 0 else len(data) if final else len(data) - 16
            if stop <= at:
                return
            opener = _OPENERS.search(data, at)
            first = min(stop, opener.start()) if opener else stop
            ends = data.find(self.delimiter, at, first)
            if ends >= 0:
                yield self._cut(ends + len(self.delimiter), 0 if self.delimiter == b";" else len(self.delimiter))
            elif opener and opener.start() < stop:
                token = _TOKEN.match(data, opener.start())
                if token is None and not final or token and token.end() == len(data) and not final:
                    return  # the quote or comment may go on in the next block
                if token is None:
                    self.open = bytes(opener[0])
                self.scanned = token.end() if token else len(data)
                del opener, token
            else:
                self.scanned = stop

    def _cut(self, at: int, drop: int) -> bytes:
        piece = bytes(self.data[:at - drop])
        del self.data[:at]
        self.scanned = 0
        return piece


def statements_of(blocks) -> Iterator[str]:
    """R1 over an iterator of byte blocks."""
    splitter = Splitter()
    for block in blocks:
        for statement in splitter.feed(block):
            yield _as_text(statement)
    for statement in splitter.feed(b"", final=True):
        yield _as_text(statement)


def split_script_text(text: str) -> list[str]:
    """R1 on one script held as a string."""
    return list(statements_of([text.encode("utf-8")]))


#: Names that are streamed, as their bytes cannot be read from the middle.
COMPRESSED_RE = r"\.(gz|tgz|bz2|tbz2)$"
READ_BYTES = 1 << 20
BATCH_BYTES = 1 << 20


def _blocks(handle) -> Iterator[bytes]:
    while block := handle.read(READ_BYTES):
        yield block


def _open_bytes(filesystem, path: str):
    """A (possibly gzip / bzip2 compressed) file as a byte stream."""
    import bz2
    import gzip

    # pyarrow would guess the codec from .gz / .bz2 only; open raw and pick it here
    raw = filesystem.open_input_stream(path, compression=None)
    if path.endswith((".gz", ".tgz")):
        return gzip.GzipFile(fileobj=raw)
    if path.endswith((".bz2", ".tbz2")):
        return bz2.BZ2File(raw)
    return raw


def _batched(rows, columns):
    """Frames of about ``BATCH_BYTES`` of statement text (the last column), one statement at least."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[-1])
        if size >= BATCH_BYTES:
            yield pd.DataFrame(held, columns=columns)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns)


def _list_files(spark, path: str, suffixes: tuple[str, ...] | None = None) -> DataFrame:
    """Every file under ``path`` (recursive, without hidden ones), listed in one task through pyarrow filesystems."""
    from tablevault.sources.listing import normalize_url

    def lister(batches):
        from pyarrow import fs

        for pdf in batches:
            for root in pdf["root"]:
                filesystem, base = fs.FileSystem.from_uri(normalize_url(root))
                infos = filesystem.get_file_info(fs.FileSelector(base, recursive=True))
                found = sorted((i.path, i.size) for i in infos if i.type == fs.FileType.File
                               and not any(part.startswith(("_", ".")) for part in i.path[len(base):].split("/"))
                               and (suffixes is None or i.path.endswith(suffixes)))
                yield pd.DataFrame([(root, *f) for f in found], columns=["root", "path", "size"])

    roots = spark.createDataFrame([(path,)], "root string")
    return roots.mapInPandas(lister, "root string, path string, size long")


def glob_regex(glob: str) -> str:
    """A file glob (``*``, ``?``) as an anchored Java regular expression."""
    out = []
    for ch in glob:
        out.append(".*" if ch == "*" else "." if ch == "?" else re.escape(ch))
    return "^" + "".join(out) + "$"


def read_scripts(spark, path: str, path_glob: str | None = None, opened=None, block_bytes: int = BLOCK_BYTES,
                 only: DataFrame | None = None) -> DataFrame:
    """``(file, pos, stmt)`` for every script file under ``path``.

    Files are opened through pyarrow filesystems inside the tasks, so names with ``:`` work. Plain files larger than
    ``block_bytes`` are read by many tasks (:mod:`script_blocks`); any other file is streamed by one, gzip and bzip2 by
    extension, holding one statement at a time. Files and folders whose names start with ``_`` or ``.`` (commit markers,
    manifests) are skipped. ``only`` (file: ``db=<name>/<part>``, as in a manifest) keeps the others closed. ``opened`` is an accumulator
    that counts the files opened by the streaming tasks.
    """
    files = _list_files(spark, path)
    if only is not None:
        name = F.regexp_extract("path", r"(db=[^/]+/[^/]+)$", 1)
        files = files.join(broadcast_if_small(only.select(F.col("file").alias("_file"))), name == F.col("_file"), "left_semi")
    if path_glob:
        files = files.where(F.element_at(F.split("path", "/"), -1).rlike(glob_regex(path_glob)))
    large = ~F.lower("path").rlike(COMPRESSED_RE) & (F.col("size") > block_bytes)
    streamed = _streamed(files.where(~large), opened)
    return streamed.unionByName(read_blocks(files.where(large), block_bytes)) if files.where(large).limit(1).count() else streamed


def _streamed(files: DataFrame, opened=None) -> DataFrame:
    """Statements of files, a task a file."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        from tablevault.sources.listing import normalize_url

        for pdf in batches:
            for root, p in zip(pdf["root"], pdf["path"]):
                filesystem, _ = fs.FileSystem.from_uri(normalize_url(root))
                if opened is not None:
                    opened.add(1)
                with _open_bytes(filesystem, p) as handle:
                    rows = ((p, i, st) for i, st in enumerate(statements_of(_blocks(handle))))
                    yield from _batched(rows, ["file", "pos", "stmt"])

    # dealt in turn, so that no task gets two files while another has none
    return files.repartition(max(1, files.count())).mapInPandas(split, SPLIT_SCHEMA)


ARCHIVE_SCHEMA = "archive string, member string, pos long, stmt string"


def read_archives(spark, path: str) -> DataFrame:
    """Statements of every file member of every tar archive under ``path``.

    Archives (tar, tgz, tbz2) are streamed member by member inside one task per archive: a tar
    is not splittable, but the task holds one statement at a time, never the archive or a member.
    Directory members are skipped and member paths are never written anywhere.
    """
    files = _list_files(spark, path, suffixes=(".tar", ".tgz", ".tbz2", ".gz", ".bz2"))
    n = max(1, files.count())

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tarfile

        from pyarrow import fs

        from tablevault.sources.listing import normalize_url

        for pdf in batches:
            for root, p in zip(pdf["root"], pdf["path"]):
                filesystem, _ = fs.FileSystem.from_uri(normalize_url(root))
                with filesystem.open_input_stream(p, compression=None) as raw, \
                        tarfile.open(fileobj=raw, mode="r|*") as tar:
                    for m in tar:
                        if not m.isfile():
                            continue
                        blocks = _blocks(tar.extractfile(m))
                        rows = ((p, m.name, i, st) for i, st in enumerate(statements_of(blocks)))
                        yield from _batched(rows, ["archive", "member", "pos", "stmt"])

    return files.repartition(n).mapInPandas(members, ARCHIVE_SCHEMA)


def statements_in_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """INSERT statements of text lines; a compact line may hold several (no Python involved)."""
    others = [F.col(c) for c in lines.columns if c != value]
    return lines.select(*others, F.explode(F.regexp_extract_all(F.col(value), F.lit(STATEMENT_RE), 0)).alias("stmt"))


# --- R2, N7: database names -----------------------------------------------------------------------

def parse_mapping(spec) -> Column:
    """``a:b,c:d`` -> map; only the first ``:`` splits, an entry without ``:`` fails the job."""
    s = F.col(spec) if isinstance(spec, str) else spec
    entries = F.split(s, ",")
    bad = F.exists(entries, lambda e: ~e.contains(":"))
    return F.when(bad, F.raise_error(F.concat(F.lit("invalid mapping: "), s)).cast("map<string,string>")) \
        .otherwise(F.str_to_map(s, F.lit(","), F.lit(":")))


def mapping_frame(spark, spec: str) -> DataFrame:
    """The mapping as a ``(from_db, to_db)`` frame, checked like :func:`parse_mapping`."""
    for entry in spec.split(","):
        if ":" not in entry:
            raise ValueError(f"invalid mapping entry {entry!r}: expected from:to")
    rows = [tuple(e.split(":", 1)) for e in spec.split(",")]
    return spark.createDataFrame(rows, "from_db string, to_db string")


#: A statement that names the current database: comment lines, then USE or CREATE DATABASE with versioned
#: comments around the name. Groups: all between the comment lines and the name, the name, all after it.
DATABASE_RE = (r"(?is)^(?:\s*--[^\n]*\n|\s*\n)*\s*((?:USE|CREATE\s+DATABASE(?:\s*/\*.*?\*/)?)\s*`)"
               r"((?:[^`]|``)+)(`(?:\s*/\*.*?\*/)*\s*;?\s*)$")


def remap_databases(stmts: DataFrame, mapping: DataFrame, stmt: str = "stmt") -> DataFrame:
    """R2: rename the database in ``CREATE DATABASE `x``` and ``USE `x`;`` by a mapping frame.

    The name lookup is exact; names without a mapping are kept. INSERT statements, nearly all of a dump's
    bytes, are passed by a test of their first letters.
    """
    text = F.col(stmt)
    candidate = ~F.startswith(text, F.lit("INSERT INTO")) & text.rlike(DATABASE_RE)
    name = F.when(candidate, F.replace(F.regexp_extract(text, DATABASE_RE, 2), F.lit("``"), F.lit("`")))
    m = broadcast_if_small(mapping.select(F.col("from_db").alias("_from"), F.col("to_db").alias("_to")))
    joined = stmts.withColumn("_name", name).join(m, F.col("_name") == F.col("_from"), "left")
    # the replacement is built by concatenation, so '$' or '\' in a new name is taken literally
    renamed = F.concat(F.regexp_extract(text, DATABASE_RE, 1), F.replace(F.col("_to"), F.lit("`"), F.lit("``")),
                       F.regexp_extract(text, DATABASE_RE, 3))
    new = F.when(F.col("_to").isNotNull(), renamed).otherwise(text)
    return joined.withColumn(stmt, new).drop("_name", "_from", "_to")


def filter_databases(stmts: DataFrame, include: DataFrame, db: str = "db") -> DataFrame:
    """Keep statements of the databases in ``include`` (semi join)."""
    return stmts.join(broadcast_if_small(include.select(F.col("db").alias(db))), db, "left_semi")


# --- R4: INSERT text -> typed rows ----------------------------------------------------------------

def _typed(text: Column, raw: Column, dtype: T.DataType) -> Column:
    r = F.trim(raw)
    if isinstance(dtype, T.BinaryType):
        hexed = F.regexp_extract(r, r"^[Xx]'([0-9A-Fa-f]*)'$", 1)
        binary_lit = F.regexp_extract(r, r"^_binary\s*'(.*)'$", 1)
        return (F.when(r == "NULL", F.lit(None).cast("binary"))
                .when(F.upper(F.substring(r, 1, 2)) == "X'", F.unhex(hexed))
                .when(F.upper(F.substring(r, 1, 2)) == "0X", F.unhex(F.substr(r, F.lit(3))))
                .otherwise(F.encode(unescape_sql(binary_lit), "UTF-8")))
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return text
    if isinstance(dtype, T.BooleanType):
        return text.cast("int").cast("boolean")
    # dates and times are the casts' own text forms ('YYYY-MM-DD[ HH:MM:SS[.ffffff]]');
    # TIMESTAMP text is read in the session zone, which the script header pins to UTC
    if isinstance(dtype, T.DateType):
        return text.cast("date")
    if isinstance(dtype, T.TimestampNTZType):
        return text.cast("timestamp_ntz")
    if isinstance(dtype, T.TimestampType):
        return text.cast("timestamp")
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.from_json(text, dtype)
    return text.cast(dtype)


def load_inserts(stmts: DataFrame, table: str, schema: T.StructType, stmt: str = "stmt",
                 keep: list[str] | None = None) -> DataFrame:
    """Rows of ``table`` from INSERT statements, typed by ``schema``.

    Values are matched to columns by the statement's own column list, so a dump with another
    column order still loads. Columns missing from the statement come back null. Each column's
    index in the list is found once per statement, before the tuples are exploded.
    """
    from tablevault.functions.literals import quote_ident

    keep = keep or []
    mine = stmts.where(F.regexp_extract(F.col(stmt), TABLE_RE, 1) == F.lit(quote_ident(table)))
    head = F.regexp_extract(F.col(stmt), HEAD_RE, 0)
    cols = F.transform(F.regexp_extract_all(F.regexp_extract(F.col(stmt), HEAD_RE, 1), F.lit(NAME), 0),
                       lambda c: F.replace(c.substr(F.lit(2), F.length(c) - 2), F.lit("``"), F.lit("`")))
    known = F.array(*[F.lit(f.name) for f in schema.fields]).cast("array<string>")
    cols = F.when(F.arrays_overlap(cols, known), cols).otherwise(F.raise_error(
        F.concat(F.lit("no known column in: "), F.substring(F.col(stmt), 1, 200))).cast("array<string>"))
    body = F.col(stmt).substr(F.length(head) + 1, F.length(stmt))
    idx_names = [f"_i{i}" for i in range(len(schema.fields))]
    # column list, per-column indexes and VALUES body first: the explode below then carries only
    # a few ints next to each tuple, never the whole (up to max_packet bytes) statement
    parts = mine.select(*keep, cols.alias("_cols"), body.alias("_body"))
    parts = parts.select(*keep, "_body", *[
        F.array_position(F.col("_cols"), F.lit(f.name)).cast("int").alias(n)
        for f, n in zip(schema.fields, idx_names)])
    tuples = parts.select(*keep, *idx_names,
                          F.explode(F.regexp_extract_all(F.col("_body"), F.lit(TUPLE_RE), 0)).alias("_tuple"))
    inner = F.col("_tuple").substr(F.lit(2), F.length("_tuple") - 2)
    vals = tuples.select(*keep, *idx_names, F.regexp_extract_all(inner, F.lit(VALUE_RE), 0).alias("_vals"))
    out = []
    for f, n in zip(schema.fields, idx_names):
        raw = F.trim(F.when(F.col(n) > 0, F.element_at(F.col("_vals"), F.col(n))))
        text = (F.when(raw == "NULL", F.lit(None).cast("string"))
                .when(raw.startswith("'"), unescape_sql(raw.substr(F.lit(2), F.length(raw) - 2)))
                .otherwise(raw))
        out.append(_typed(text, raw, f.dataType).alias(f.name))
    return vals.select(*keep, *out)


def load_scripts(stmts: DataFrame, tables: dict[str, T.StructType], stmt: str = "stmt",
                 keep: list[str] | None = None) -> dict[str, DataFrame]:
    """R4 over whole statements (:func:`read_scripts`): one typed DataFrame per table named in ``tables``.

    The body of a stored program is one statement that begins with CREATE, so INSERTs in it are not data.
    """
    data = stmts.where(F.startswith(F.col(stmt), F.lit("INSERT INTO")))
    return {t: load_inserts(data, t, s, stmt, keep) for t, s in tables.items()}


def load_script_lines(lines: DataFrame, tables: dict[str, T.StructType], value: str = "value",
                      keep: list[str] | None = None) -> dict[str, DataFrame]:
    """R4 over the data lines of dump files without stored programs: one typed DataFrame per table.

    A line is known by its beginning, so a program's lines would be taken for data; scripts that may hold
    programs are read with :func:`read_scripts` and :func:`load_scripts`. A compact line may hold several
    statements.
    """
    data = statements_in_lines(lines.where(F.startswith(F.col(value), F.lit("INSERT INTO"))), value)
    return {t: load_inserts(data, t, s, keep=keep) for t, s in tables.items()}


# --- a whole restore ------------------------------------------------------------------------------

def spark_type(mysql: str) -> str:
    """The Spark type of a MySQL column type; text for what has no closer one (JSON, TIME, ENUM, SET ...)."""
    return parse_create_table(f"CREATE TABLE t (c {mysql})").columns[0].spark_type()


def schema_of_ddl(body: str) -> T.StructType:
    """The stored columns of a CREATE TABLE statement (``body`` starts after its opening parenthesis)."""
    return parse_create_table("CREATE TABLE t (" + body).stored()


DATA, TABLE, PROGRAM = "data", "table", "program"
STAGED = "db string, kind string, tbl string, file string, pos long, stmt string"

#: What a statement creates, after comments and session settings in front of it. Groups: the kind, the name.
CREATES_RE = (r"(?is)^(?:\s++|--[^\n]*+\n|/\*(?!!).*?\*/|(?:/\*!\d*+\s*+)?(?:SET|DROP)\b(?:[^;'`]++|'[^']*+'|`[^`]*+`)*+;)*+"
              r"(?:/\*!\d*+\s*+)?CREATE\b(?:[^`(]|`[^`]*+`@`[^`]*+`){0,400}?"
              r"\b(TABLE|VIEW|TRIGGER|FUNCTION|PROCEDURE|EVENT)\b[^`(]*+(`(?:[^`]|``)++`)")


def tag_statements(stmts: DataFrame) -> DataFrame:
    """``STAGED`` rows of the statements that carry data, tables or programs; session settings and locks fall away.

    ``stmts``: (db, file, pos, stmt). A statement is known by its beginning, so text inside data or programs is never
    taken for one.
    """
    text = F.col("stmt")
    insert = F.startswith(text, F.lit("INSERT INTO"))
    made = F.upper(F.regexp_extract(text, CREATES_RE, 1))
    kind = F.when(insert, DATA).when(made == "TABLE", TABLE).when(made != "", PROGRAM)
    quoted = F.when(insert, F.regexp_extract(text, TABLE_RE, 1)).otherwise(F.regexp_extract(text, CREATES_RE, 2))
    name = F.replace(quoted.substr(F.lit(2), F.length(quoted) - 2), F.lit("``"), F.lit("`"))
    tagged = stmts.select("db", kind.alias("kind"), name.alias("tbl"), "file", "pos", "stmt")
    return tagged.where(F.col("kind").isNotNull() & (F.col("tbl") != ""))


class Restored(dict):
    """Published tables by database; ``left_out`` names what a table folder cannot hold (db, kind, name)."""

    left_out: list[tuple[str, str, str]]


def stage_statements(stmts: DataFrame) -> tuple[DataFrame, str]:
    """Tagged statements, written once in the shared checkpoint folder by database, kind and table, and its path.

    This is the one pass over a dump's files: reads of a single table prune to its folder. A dump is contiguous by
    table, so a task writes to few folders.
    """
    import uuid

    from tablevault.session import ensure_checkpoint_dir

    spark = stmts.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/staged-{uuid.uuid4().hex}"
    tag_statements(stmts).write.partitionBy("db", "kind", "tbl").parquet(path)
    return spark.read.schema(STAGED).parquet(path), path


def run_restore(spark, path: str, dest: str, include: list[str] | None = None, mapping: dict[str, str] | None = None,
                opened=None, tables: list[tuple[str, str]] | None = None, versioned: bool = False) -> Restored:
    """Restore a dump from its files alone: read, choose (R3) and rename (R2) databases, load (R4), publish.

    The files under ``path/db=<name>/`` are a database's script; they are read once, however many tables they hold.
    Column types come from the script's own CREATE TABLE statements, and computed columns, which INSERTs leave out, are
    evaluated again. Tables land in ``dest/<database>/<table>``; a database's tables are published together or not at
    all. Returns the published tables of each database; views, triggers and routines are named in ``left_out``.
    ``tables`` (db, table) restores these alone; where the dump has a manifest, only files that hold wanted data are
    opened (programs in others are not seen then). With ``versioned`` each database's tables become a new version of
    its folder, at one moment for every reader (:mod:`versions`). ``opened`` is an accumulator that counts the files opened.
    """
    from tablevault.sinks.manifest import files_of, has_manifest
    from tablevault.sinks.versions import publish_version
    from tablevault.sinks.writers import remove_folder, restore_tables

    chosen = tables is not None or include is not None
    only = files_of(spark, path, tables, include) if chosen and has_manifest(spark, path) else None
    stmts = read_scripts(spark, path, opened=opened, only=only).withColumn(
        "db", F.url_decode(F.regexp_extract("file", r"/db=([^/]+)/", 1)))
    if include is not None:
        stmts = filter_databases(stmts, spark.createDataFrame([(d,) for d in include], "db string"))
    staged, scratch = stage_statements(stmts)
    published = Restored()
    try:
        found = [(r["db"], table) for r in staged.where(F.col("kind") == TABLE).select("db", "stmt").collect()
                 if (table := parse_create_table(r["stmt"])) is not None
                 and (tables is None or (r["db"], table.name) in tables)]
        for db in sorted({d for d, _ in found}):
            mine = staged.where((F.col("kind") == DATA) & (F.col("db") == db))
            frames = {t.name: with_computed(load_inserts(mine.where(F.col("tbl") == t.name), t.name, t.stored()), t)
                      for d, t in sorted(found, key=lambda x: x[1].name) if d == db}
            target = (mapping or {}).get(db, db)
            place = f"{dest.rstrip('/')}/{target}"
            if versioned:
                publish_version(frames, place)
                published[target] = list(frames)
            else:
                published[target] = restore_tables(frames, place)
        programs = staged.where(F.col("kind") == PROGRAM).select("db", "tbl", "stmt")
        named = programs.select("db", F.upper(F.regexp_extract("stmt", CREATES_RE, 1)).alias("kind"), "tbl").distinct()
        published.left_out = sorted(tuple(r) for r in named.collect())
    finally:
        remove_folder(spark, scratch)
    return published
