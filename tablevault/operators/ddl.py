"""CREATE TABLE texts read back: column types, computed columns and keys.

A dump's own DDL says what its INSERT values mean. The text is cut into tokens (names, strings, numbers, words, marks;
comments fall away, code in version comments stays), and every column is read from them: its type with length and
sign, whether it may be null, and the expression of a computed column, which a dump's INSERTs leave out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(
    r"(?P<name>`(?:[^`]|``)*`)|(?P<text>'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\")"
    r"|(?P<skip>\s+|--\s[^\n]*|\#[^\n]*|/\*(?!!)(?:.*?)\*/|/\*!\d*|\*/)"
    r"|(?P<number>\d+(?:\.\d+)?)|(?P<word>[^\W\d]\w*)|(?P<mark>.)", re.S)

# Words that begin a key or constraint in a column list.
KEY_WORDS = {"PRIMARY", "UNIQUE", "KEY", "INDEX", "FULLTEXT", "SPATIAL", "CONSTRAINT", "FOREIGN", "CHECK"}

# MySQL column types and the Spark types they load into; unsigned integers take the next wider type.
SPARK_TYPES = {
    "tinyint": "tinyint", "smallint": "smallint", "mediumint": "int", "int": "int", "integer": "int", "bigint": "bigint",
    "bool": "boolean", "boolean": "boolean", "year": "int", "float": "float", "double": "double", "real": "double",
    "date": "date", "datetime": "timestamp_ntz", "timestamp": "timestamp", "time": "string",
    "char": "string", "varchar": "string", "tinytext": "string", "text": "string", "mediumtext": "string",
    "longtext": "string", "enum": "string", "set": "string", "json": "string",
    "binary": "binary", "varbinary": "binary", "tinyblob": "binary", "blob": "binary", "mediumblob": "binary",
    "longblob": "binary", "bit": "binary", "geometry": "binary", "point": "binary", "serial": "decimal(20,0)",
}
UNSIGNED = {"tinyint": "smallint", "smallint": "int", "mediumint": "int", "int": "bigint", "integer": "bigint",
            "bigint": "decimal(20,0)"}
#: Digits of Spark's widest decimal; a wider MySQL decimal is read as text, so that no digit is lost.
MAX_DIGITS = 38


@dataclass
class ColumnDef:
    name: str
    type: str  # MySQL's word, lower case
    args: list[str] = field(default_factory=list)
    unsigned: bool = False
    nullable: bool = True
    computed: str | None = None  # the expression of a computed column

    def spark_type(self) -> str:
        """The Spark type that holds the column's values; text for a type that is not known here."""
        if self.type == "tinyint" and self.args == ["1"] and not self.unsigned:
            return "boolean"
        if self.type in ("decimal", "numeric", "dec", "fixed"):
            digits, scale = int((self.args or ["10"])[0]), int((self.args + ["0", "0"])[1])
            return f"decimal({digits},{scale})" if digits <= MAX_DIGITS else "string"
        if self.unsigned and self.type in UNSIGNED:
            return UNSIGNED[self.type]
        return SPARK_TYPES.get(self.type, "string")


@dataclass
class TableDef:
    name: str
    columns: list[ColumnDef]
    primary_key: list[str] = field(default_factory=list)

    def stored(self) -> T.StructType:
        """The columns that INSERTs carry."""
        return T.StructType([T.StructField(c.name, T.DataType.fromDDL(c.spark_type())) for c in self.columns
                             if c.computed is None])

    def names(self) -> list[str]:
        return [c.name for c in self.columns]


def tokens(text: str) -> Iterator[tuple[str, str]]:
    """(kind, text) of a statement's tokens; names and strings keep their quotes."""
    for m in _TOKEN.finditer(text):
        if m.lastgroup != "skip":
            yield m.lastgroup, m[0]


def _name(token: str) -> str:
    return token[1:-1].replace("``", "`") if token.startswith("`") else token


class _Reader:
    def __init__(self, text: str):
        self.items, self.at = list(tokens(text)), 0

    def peek(self, n: int = 0) -> str:
        return self.items[self.at + n][1] if self.at + n < len(self.items) else ""

    def word(self, *words: str) -> bool:
        """Take the words if they come next, whatever their case."""
        if [self.peek(i).upper() for i in range(len(words))] == list(words):
            self.at += len(words)
            return True
        return False

    def take(self) -> tuple[str, str]:
        self.at += 1
        return self.items[self.at - 1] if self.at <= len(self.items) else ("end", "")

    def group(self) -> list[tuple[str, str]]:
        """The tokens between the parenthesis that comes next and its partner."""
        found, depth = [], 0
        while self.at < len(self.items):
            kind, text = self.take()
            depth += {"(": 1, ")": -1}.get(text, 0) if kind == "mark" else 0
            found.append((kind, text))
            if depth == 0:
                break
        return found[1:-1]

    def skip_item(self) -> list[tuple[str, str]]:
        """The rest of a list item, up to its comma or the end of the list."""
        found = []
        while self.at < len(self.items) and self.peek() not in (",", ")"):
            found += self.group() if self.peek() == "(" else [self.take()]
        return found


def parse_create_table(text: str) -> TableDef | None:
    """The table that a statement creates, or null if it creates none (views, programs, CREATE ... LIKE and SELECT)."""
    r = _Reader(text)
    while r.at < len(r.items) and not (r.peek().upper() == "CREATE" and r.items[r.at][0] == "word"):
        if r.word("INSERT", "INTO"):
            return None
        r.at += 1
    if not (r.word("CREATE", "TABLE") or r.word("CREATE", "TEMPORARY", "TABLE")):
        return None
    r.word("IF", "NOT", "EXISTS")
    name = _name(r.take()[1])
    if r.peek() == ".":
        r.take()
        name = _name(r.take()[1])
    if r.peek() != "(" or r.peek(1).upper() == "LIKE":
        return None
    r.take()
    table = TableDef(name, [])
    while r.at < len(r.items) and r.peek() != ")":
        kind, first = r.items[r.at]
        if kind == "word" and first.upper() in KEY_WORDS:
            if r.word("CONSTRAINT") and r.peek().upper() not in KEY_WORDS:
                r.take()
            primary = r.word("PRIMARY", "KEY")
            while r.at < len(r.items) and r.peek() not in ("(", ",", ")"):
                r.take()
            if primary:
                table.primary_key = [_name(t) for k, t in r.group() if k in ("name", "word") and t.upper() not in ("ASC", "DESC")]
            r.skip_item()
        else:
            column = _column(r)
            table.columns.append(column)
            if column.type == "" or r.peek() not in (",", ")"):
                raise ValueError(f"column {column.name!r} of table {name!r} cannot be read")
        if r.peek() == ",":
            r.take()
    return table


def _column(r: _Reader) -> ColumnDef:
    column = ColumnDef(_name(r.take()[1]), r.take()[1].lower())
    if column.type in ("double", "character", "national", "long"):
        follows = r.peek().lower()
        if follows in ("precision", "varying", "varchar", "char", "varbinary", "character"):
            r.take()
            column.type = {"precision": "double", "varbinary": "mediumblob"}.get(follows, "varchar")
        elif column.type != "double":
            column.type = "text" if column.type == "long" else "varchar"
    if r.peek() == "(":
        column.args = [t for _, t in r.group() if t != ","]
    while r.at < len(r.items) and r.peek() not in (",", ")"):
        if r.word("UNSIGNED") or r.word("ZEROFILL"):
            column.unsigned = True
        elif r.word("NOT", "NULL"):
            column.nullable = False
        elif r.word("COMMENT") or r.word("DEFAULT") or r.word("COLLATE"):
            _value(r)
        elif r.word("GENERATED", "ALWAYS", "AS") or r.word("AS"):
            column.computed = _expression(r.group())
        elif r.word("CHARACTER", "SET") or r.word("CHARSET") or r.word("ON", "UPDATE"):
            _value(r)
        elif r.peek() == "(":
            r.group()
        else:
            r.take()
    return column


def _value(r: _Reader) -> None:
    """One value: a literal, a word with or without arguments, or an expression in parentheses."""
    if r.peek() == "(":
        r.group()
        return
    r.take()
    if r.peek() == "(":
        r.group()


def _expression(items: list[tuple[str, str]]) -> str:
    """A computed column's expression as Spark SQL: charset marks before strings fall away, all else stays."""
    out = []
    for i, (kind, text) in enumerate(items):
        if kind == "word" and text.startswith("_") and i + 1 < len(items) and items[i + 1][0] == "text":
            continue
        if kind == "text" and text.startswith('"'):
            text = "'" + text[1:-1].replace('""', '"').replace("'", "\\'") + "'"
        elif kind == "text":
            text = "'" + text[1:-1].replace("''", "\\'") + "'"
        close = bool(out) and (text in "(),." or out[-1] in ("(", ".")) and kind == "mark"
        out.append(text if close or not out or out[-1] in ("(", ".") else " " + text)
        out[-1] = out[-1] if not close else text
    return "".join(out)


def with_computed(rows: DataFrame, table: TableDef) -> DataFrame:
    """``rows`` of the stored columns with the computed ones evaluated again, in the table's column order.

    A computed column may use earlier ones. An expression that Spark does not know fails here, by the column's name,
    before anything is written.
    """
    from pyspark.errors import AnalysisException, ParseException

    for c in table.columns:
        if c.computed is None:
            continue
        try:
            value: Column = F.expr(c.computed).cast(c.spark_type())
            rows = rows.withColumn(c.name, value)
            rows.schema  # analysed now
        except (AnalysisException, ParseException) as bad:
            raise ValueError(f"computed column {c.name!r} of table {table.name!r} cannot be evaluated: {c.computed}") from bad
    return rows.select(*[F.col("`" + n.replace("`", "``") + "`") for n in table.names()])
