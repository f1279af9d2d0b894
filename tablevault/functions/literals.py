"""Typed column -> MySQL-dialect SQL literal text, built only from JVM expressions.

Every function here takes and returns a ``Column`` so Catalyst keeps the whole row -> text
conversion inside whole-stage codegen. Two modes:

* ``"compat"`` writes what the reference tool writes: doubles with six fixed decimals, timestamps
  to the whole second, empty binary as NULL.
* ``"exact"`` keeps every value: shortest round-trip doubles, microsecond timestamps, empty binary
  as ``X''``. Restore round trips use this mode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMPAT = "compat"
EXACT = "exact"
MODES = (COMPAT, EXACT)

NULL_TEXT = "NULL"

# The MySQL string-literal escapes the dump writes, as (character, escape text).
# Tab, % and _ are left as they are. The backslash pair is applied first, so that applying the
# rest one after another equals a single left-to-right pass.
SQL_ESCAPES = [
    ("\\", "\\\\"),
    ("\x00", "\\0"),
    ("'", "\\'"),
    ('"', '\\"'),
    ("\b", "\\b"),
    ("\n", "\\n"),
    ("\r", "\\r"),
    ("\x1a", "\\Z"),
]

# Escapes read back by the loader (MySQL string-literal table), escape letter -> char.
SQL_UNESCAPES = [
    ("0", "\x00"),
    ("'", "'"),
    ('"', '"'),
    ("b", "\b"),
    ("n", "\n"),
    ("r", "\r"),
    ("t", "\t"),
    ("Z", "\x1a"),
]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _check_mode(mode: str) -> None:
    if mode not in MODES:
        raise ValueError(f"unknown literal mode {mode!r}; expected one of {MODES}")


def escape_sql(c) -> Column:
    """L2: escape a string for a single- or double-quoted MySQL literal."""
    out = _col(c)
    for raw, esc in SQL_ESCAPES:
        out = F.replace(out, F.lit(raw), F.lit(esc))
    return out


# an escape (backslash + any char), a doubled quote, a run without either, or a lone quote or backslash
_UNESCAPE_TOKEN_RE = r"(?s)\\.|''|[^\\']++|'|\\"


def unescape_sql(c) -> Column:
    """L3: inverse of :func:`escape_sql` (also reads ``\\t``), in one regex pass.

    The value is cut into tokens (``\\X`` escapes and runs without a backslash) left to right,
    so an escaped backslash can never start another escape. Known escapes become their character,
    ``\\\\`` a single backslash; an unknown escape is kept as written. Values without a backslash
    skip all of it.
    """
    x = _col(c)
    pairs = [("\\" + letter, raw) for letter, raw in SQL_UNESCAPES] + [("\\\\", "\\"), ("''", "'")]
    table = F.create_map(*[F.lit(v) for pair in pairs for v in pair])
    tokens = F.regexp_extract_all(x, F.lit(_UNESCAPE_TOKEN_RE), 0)
    out = F.array_join(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(table, t), t)), "")
    return F.when(x.contains("\\") | x.contains("''"), out).otherwise(x)


def quote_ident(name: str) -> str:
    """L12 (driver side): backtick-quote an identifier, doubling inner backticks."""
    return "`" + name.replace("`", "``") + "`"


def quote_ident_col(c) -> Column:
    """L12 (column form)."""
    return F.concat(F.lit("`"), F.replace(_col(c), F.lit("`"), F.lit("``")), F.lit("`"))


def lit_text(c) -> Column:
    """Quoted, escaped text (VARCHAR, TEXT, JSON, TIME)."""
    return F.concat(F.lit("'"), escape_sql(c), F.lit("'"))


def lit_int(c) -> Column:
    """L4: integer digits, no quotes."""
    return _col(c).cast("string")


def lit_float(c, mode: str = COMPAT) -> Column:
    """``%f`` (six fixed decimals) in compat mode, shortest round-trip text in exact mode."""
    _check_mode(mode)
    x = _col(c).cast("double")
    return _six_decimals(x) if mode == COMPAT else x.cast("string")


def _six_decimals(x: Column) -> Column:
    """``%f`` of the exact binary value, halves to even (Java's own ``%f`` rounds the shortest decimal text instead).

    Most doubles in tables are the nearest ones to a decimal of six places at most: then that decimal divided out
    again gives the same double, and below 2**32, where half a unit in the last place is less than half a millionth, its
    digits are the exact rounding too. The others take :func:`_exact_six_decimals`.
    """
    millionths = F.rint(x * F.lit(1e6))
    short = (F.abs(x) < F.lit(float(2**32))) & (millionths / F.lit(1e6) == x)
    digits = F.abs(millionths).cast("long")
    minus = (x < 0) | (x == 0) & x.cast("string").startswith("-")
    text = F.concat(F.when(minus, F.lit("-")).otherwise(F.lit("")),
                    F.call_function("div", digits, F.lit(1000000).cast("long")).cast("string"), F.lit("."),
                    F.lpad((digits % 1000000).cast("string"), 6, "0"))
    return F.when(short, text).otherwise(_exact_six_decimals(x))


def _bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def _exact_six_decimals(x: Column) -> Column:
    """``%f`` of the exact binary value of any double.

    The fraction times 10**6 is computed with its rounding error (the fraction is split into 26-bit halves, so all
    partial products are exact). Beyond 2**53 a double has no fraction and Java's text is taken; not-a-numbers and
    infinities as well.
    """
    def split(size: Column, whole: Column) -> Column:
        return _bind(size - whole, lambda part: _bind(part * F.lit(134217729.0), lambda wide: _bind(
            wide - (wide - part), lambda high: _bind(part * F.lit(1e6), lambda product: _bind(
                F.floor(product), lambda down: _bind(down + _round_up(part, high, product, down),
                                                     lambda digits: text(whole, digits)))))))

    def text(whole: Column, digits: Column) -> Column:
        carried = whole + F.when(digits == 1000000, 1).otherwise(0)
        return F.concat(F.when(x.cast("string").startswith("-"), F.lit("-")).otherwise(F.lit("")),
                        carried.cast("string"), F.lit("."), F.lpad((digits % 1000000).cast("string"), 6, "0"))

    near = _bind(F.abs(x), lambda size: _bind(F.floor(size), lambda whole: split(size, whole)))
    return F.when(F.abs(x) < F.lit(float(2**53)), near).otherwise(F.format_string("%f", x))


def _round_up(part: Column, high: Column, product: Column, down: Column) -> Column:
    """1 where the exact product lies above the half, or on it after an odd digit; else 0."""
    error = (high * F.lit(1e6) - product) + (part - high) * F.lit(1e6)
    over = product - down - F.lit(0.5)
    up = (over > 0) | (over == 0) & ((error > 0) | (error == 0) & (down % 2 == 1))
    return F.when(up, 1).otherwise(0)


def lit_bool(c) -> Column:
    """1 / 0."""
    return _col(c).cast("int").cast("string")


def lit_decimal(c) -> Column:
    """Decimals are written quoted, as the reference reads them as text."""
    return F.concat(F.lit("'"), _col(c).cast("string"), F.lit("'"))


def lit_date(c) -> Column:
    """``'YYYY-MM-DD'``."""
    return F.concat(F.lit("'"), F.date_format(_col(c), "yyyy-MM-dd"), F.lit("'"))


def lit_ts(c, mode: str = COMPAT) -> Column:
    """``'YYYY-MM-DD HH:MM:SS'`` (fraction dropped) or with ``.ffffff`` in exact mode."""
    _check_mode(mode)
    fmt = "yyyy-MM-dd HH:mm:ss" if mode == COMPAT else "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return F.concat(F.lit("'"), F.date_format(_col(c), fmt), F.lit("'"))


def lit_binary(c, mode: str = COMPAT) -> Column:
    """``X'<hex>'``; the output stays valid UTF-8. Compat mode writes empty as NULL."""
    _check_mode(mode)
    x = _col(c)
    out = F.concat(F.lit("X'"), F.hex(x), F.lit("'"))
    if mode == COMPAT:
        out = F.when(F.octet_length(x) == 0, F.lit(None).cast("string")).otherwise(out)
    return out


def lit_sql(c, dtype: T.DataType, mode: str = COMPAT) -> Column:
    """L1 + type dispatch: the SQL literal text of one value, ``NULL`` for null."""
    _check_mode(mode)
    x = _col(c)
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        out = lit_int(x)
    elif isinstance(dtype, T.DecimalType):
        out = lit_decimal(x)
    elif isinstance(dtype, (T.FloatType, T.DoubleType)):
        out = lit_float(x, mode)
    elif isinstance(dtype, T.BooleanType):
        out = lit_bool(x)
    elif isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        out = lit_text(x)
    elif isinstance(dtype, T.DateType):
        out = lit_date(x)
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        out = lit_ts(x, mode)
    elif isinstance(dtype, T.BinaryType):
        out = lit_binary(x, mode)
    elif isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        out = lit_text(F.to_json(x))
    elif isinstance(dtype, T.NullType):
        return F.lit(NULL_TEXT)
    else:
        raise TypeError(f"no SQL literal for type {dtype.simpleString()}")
    # test the input, not the text: format_string('%f', null) gives the word 'null'
    return F.when(x.isNull(), F.lit(NULL_TEXT)).otherwise(F.coalesce(out, F.lit(NULL_TEXT)))


def row_tuple(df: DataFrame, columns: list[str] | None = None, mode: str = COMPAT) -> Column:
    """``(v1,v2,...)`` for the given columns of ``df`` (all columns by default)."""
    cols = columns or df.columns
    fields = {f.name: f.dataType for f in df.schema.fields}
    parts = [lit_sql(F.col(quote_ident(c)), fields[c], mode) for c in cols]
    return F.concat(F.lit("("), F.concat_ws(",", *parts), F.lit(")"))
