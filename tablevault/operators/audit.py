"""Audit jobs: run reports (A1), snapshot comparison (A2), missed runs (A3), next run time (A4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablevault.operators.common import broadcast_if_small, broadcast_known

# Script lines that change from run to run and are left out of a comparison
# (dump banner, completion time) - blank lines are dropped as well.
VOLATILE_LINE_RE = r"(?i)^\s*(-- (tablevault SQL dump|Go SQL Dump|MySQL dump) .*|-- Dump completed on .*)?\s*$"

# The grammar of the begin option.
MINUTES_RE = r"^\+([0-9]+)$"
CLOCK_RE = r"^([0-9][0-9])([0-9][0-9])$"

# Fixed value: the message for a begin option that is none of these; the option follows in quotes.
BAD_BEGIN = "invalid format for begin delay '"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- A1 -------------------------------------------------------------------------------------------

def dump_report(script: DataFrame) -> DataFrame:
    """A1 for a dump: per database and table, statements written and their bytes.

    Works on script rows ``(db, section, table_key, part, ..., value)``; only data rows count.
    Bytes include the newline each row gets in the file.
    """
    from tablevault.plans.script import DATA, TABLES

    data = script.where((F.col("section") == TABLES) & (F.col("part") == DATA))
    size = F.octet_length("value").cast("long")
    return data.groupBy("db", table_of_key("table_key").alias("table")).agg(
        F.count(F.lit(1)).alias("n_statements"),
        F.sum(size + 1).alias("n_bytes"),
        F.max(size).alias("max_statement_bytes"),
    )


def table_of_key(name: str) -> Column:
    """The table's name from its place in a script (a name that is not in lower case stands behind its lower form)."""
    lower, own = F.substring_index(name, "\u0001", 1), F.expr(f"substr({name}, instr({name}, '\\u0001') + 1)")
    return F.when(F.col(name).contains("\u0001") & (F.lower(own) == lower), own).otherwise(F.col(name))


def run_report(runs: DataFrame) -> DataFrame:
    """A1 for a run log: per run, total / dump / upload seconds, bytes and upload count.

    ``runs``: (run_id, start, end, dump_start, dump_end, bytes, uploads array<struct<target,
    filename, start, end>>). Upload seconds come from exploding the uploads (one row each).
    """
    secs = lambda a, b: F.timestamp_diff("MICROSECOND", F.col(a), F.col(b)) / F.lit(1e6)
    base = runs.select("run_id", secs("start", "end").alias("total_seconds"),
                       secs("dump_start", "dump_end").alias("dump_seconds"), "bytes",
                       F.size("uploads").alias("n_uploads"))
    ups = (runs.select("run_id", F.explode("uploads").alias("u"))
           .select("run_id", (F.timestamp_diff("MICROSECOND", F.col("u.start"), F.col("u.end")) / F.lit(1e6))
                   .alias("s"))
           .groupBy("run_id").agg(F.sum("s").alias("upload_seconds")))
    return base.join(ups, "run_id", "left").fillna(0.0, subset=["upload_seconds"])


# --- A2 -------------------------------------------------------------------------------------------

def stable_lines(script_lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines of a script without the volatile ones (banner, completion time, blank), whatever their case.

    A value may hold several lines (headers, DDL); each is judged on its own.
    """
    others = [c for c in script_lines.columns if c != value]
    lines = script_lines.select(*others, F.explode(F.split(F.col(value), "\r?\n")).alias(value))
    return lines.where(~F.col(value).rlike(VOLATILE_LINE_RE))


#: Ranges of hashes that are compared first; a difference of few lines makes as many of them differ.
RANGES = 1 << 16


def _signed_lines(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """(_line, _n, _range) of both scripts' stable lines: 1 on the side of ``a``, -1 on that of ``b``."""
    return _ranged(stable_lines(a.select(value), value).select(F.col(value).alias("_line"), F.lit(1).alias("_n"))
                   .unionByName(stable_lines(b.select(value), value).select(F.col(value).alias("_line"), F.lit(-1).alias("_n"))))


def _ranged(lines: DataFrame) -> DataFrame:
    return lines.withColumn("_range", F.pmod(F.xxhash64("_line"), F.lit(RANGES)).cast("int"))


def _unequal_ranges(signed: DataFrame) -> DataFrame:
    """(_range) where the two sides' lines are not the same multiset.

    A range's fingerprint is its number of lines and the sums of the halves of two 64-bit hashes of them, each side
    against the other. Only these numbers are shuffled, summed before by each task; unequal multisets agree in them with
    a chance of about 2**-100.
    """
    sums = [F.sum("_n").alias("_lines")]
    for i, h in enumerate((F.xxhash64(F.lit(1), "_line"), F.xxhash64(F.lit(2), "_line"))):
        low, high = h.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")), F.shiftright(h, 32)
        sums += [F.sum(F.col("_n") * part).alias(f"_{name}{i}") for name, part in (("low", low), ("high", high))]
    odd = signed.groupBy("_range").agg(*sums)
    unequal = F.lit(False)
    for c in odd.columns[1:]:
        unequal = unequal | (F.col(c) != 0)
    return odd.where(unequal).select("_range")


def unequal_ranges(a: DataFrame, b: DataFrame, value: str = "value") -> DataFrame:
    """(_range) of the hash ranges in which two scripts differ, volatile lines ignored; at most ``RANGES`` rows."""
    return _unequal_ranges(_signed_lines(a, b, value))


def verify_snapshot(a: DataFrame, b: DataFrame, value: str = "value") -> DataFrame:
    """A2: multiset difference of two scripts, both ways, volatile lines ignored.

    Lines fall into ranges of their hash, and the ranges' fingerprints are compared first. Only the lines of ranges that
    differ meet as text, so that equal scripts shuffle no text at all, and others little more than what differs.
    Returns ``(side, value)``: side 'a' rows occur more often in ``a`` than in ``b``, and so on.
    Empty result = same snapshot.
    """
    both = _signed_lines(a, b, value)
    # at most RANGES numbers
    few = both.join(broadcast_known(_unequal_ranges(both), RANGES), "_range", "left_semi")
    odd = few.groupBy("_line").agg(F.sum("_n").alias("_n")).where("_n <> 0")
    side = F.when(F.col("_n") > 0, F.lit("a")).otherwise(F.lit("b"))
    return odd.select(side.alias("side"), F.explode(F.array_repeat("_line", F.abs("_n").cast("int"))).alias(value))


def verify_ordered(a: DataFrame, b: DataFrame, key: list[str], value: str = "value") -> DataFrame:
    """A2 (ordered form): lines that differ at the same position ``key`` (full outer join)."""
    x = a.select(*key, F.col(value).alias("a_value"))
    y = b.select(*key, F.col(value).alias("b_value"))
    return x.join(y, key, "full_outer").where(~F.col("a_value").eqNullSafe(F.col("b_value")))


# --- A3 -------------------------------------------------------------------------------------------

def missed_runs(schedules: DataFrame, runs: DataFrame, target: str = "target", ts: str = "ts") -> DataFrame:
    """A3: scheduled ticks with no run in ``[tick, tick + frequency)``.

    ``schedules``: (target, begin, end, frequency minutes); ``runs``: (target, ts). Each run is
    mapped to its tick number ``floor((ts - begin) / frequency)``, so the interval join becomes an
    equi anti join on (target, tick number); ticks are ``sequence`` over [begin, end).
    """
    sch = broadcast_if_small(schedules.select(target, "begin", "end", "frequency"))
    step = F.col("frequency").cast("long") * F.lit(60 * 1000000)
    n_ticks = F.ceil(F.timestamp_diff("MICROSECOND", F.col("begin"), F.col("end")) / step).cast("long")
    ticks = sch.where(n_ticks > 0).select(target, "begin", "frequency",
                       F.explode(F.sequence(F.lit(0).cast("long"), n_ticks - 1)).alias("tick_no"))
    hit = (runs.select(target, ts).join(sch, target)
           .where((F.col(ts) >= F.col("begin")) & (F.col(ts) < F.col("end")))
           .select(target, F.floor(F.timestamp_diff("MICROSECOND", F.col("begin"), F.col(ts)) / step)
                   .cast("long").alias("tick_no"))
           .distinct())
    missing = ticks.join(hit, [target, "tick_no"], "left_anti")
    return missing.select(
        target, "tick_no",
        (F.col("begin") + F.make_dt_interval(mins=F.col("tick_no") * F.col("frequency"))).alias("tick"))


# --- A4 -------------------------------------------------------------------------------------------

def first_run(begin, from_ts) -> Column:
    """A4: first run time for a ``begin`` option at ``from_ts`` (null for an invalid option).

    ``+MM``: MM minutes from now. ``HHMM``: the next such UTC clock time strictly after now, else
    the same time tomorrow; seconds and fraction of ``from_ts`` are kept, hour 24 rolls over.
    """
    b, f = _col(begin), _col(from_ts)
    mins = F.regexp_extract(b, MINUTES_RE, 1).try_cast("long")
    hh = F.regexp_extract(b, CLOCK_RE, 1).try_cast("int")
    mm = F.regexp_extract(b, CLOCK_RE, 2).try_cast("int")
    into_minute = f - F.date_trunc("minute", f)
    today = F.date_trunc("day", f) + F.make_dt_interval(hours=hh, mins=mm) + into_minute
    clock = F.when(today > f, today).otherwise(today + F.expr("INTERVAL 1 DAY"))
    return (F.when(b.rlike(MINUTES_RE), f + F.make_dt_interval(mins=mins))
            .when(b.rlike(CLOCK_RE), clock))


def check_begin(begin) -> Column:
    """A4 validation: an invalid option fails the job."""
    b = _col(begin)
    ok = b.rlike(MINUTES_RE) | b.rlike(CLOCK_RE)
    return F.when(ok, b).otherwise(F.raise_error(
        F.concat(F.lit(BAD_BEGIN), b, F.lit("'"))))
