"""One backup run end to end: dump -> push to each target -> run record.

A run names itself from its start time with the file name pattern (N1), writes the dump once
per target (each target gets ``<target>/<name>/db=<db>/part-*``) and returns a one-row ``runs``
frame in the shape :func:`tablevault.operators.audit.run_report` reads. Hooks (R6) are plain
DataFrame functions: ``table_hook(db, table, df) -> df`` runs on every table before it is dumped.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablevault.functions.names import EXTENSIONS
from tablevault.plans.script import DumpOptions, Programs, dump
from tablevault.sinks.writers import push
from tablevault.sources.tableset import TableSet

RUNS_SCHEMA = ("run_id string, start timestamp, end timestamp, dump_start timestamp, dump_end timestamp, "
               "bytes long, uploads array<struct<target:string,filename:string,start:timestamp,end:timestamp>>")


def run_name(now: dt.datetime, compression: str, pattern: str | None = None, safe: bool = True) -> str:
    """N1 on the driver for one run (the same keys as :func:`tablevault.functions.names.backup_name`)."""
    from tablevault.functions.names import DEFAULT_PATTERN, MISSING_KEY, _KEY_RE

    stamp = now.strftime("%Y-%m-%dT%H:%M:%SZ")
    if safe:
        stamp = stamp.replace(":", "-")
    values = {"now": stamp, "year": now.strftime("%Y"), "month": now.strftime("%m"),
              "day": now.strftime("%d"), "hour": now.strftime("%H"), "minute": now.strftime("%M"),
              "second": now.strftime("%S"), "compression": EXTENSIONS[compression]}
    return _KEY_RE.sub(lambda m: values.get(m.group(1), MISSING_KEY), pattern or DEFAULT_PATTERN)


def apply_table_hook(ts: TableSet, hook: Callable[[str, str, DataFrame], DataFrame]) -> TableSet:
    """A table set whose tables pass through ``hook`` when read."""
    out = TableSet(ts.spark, dict(ts.readers), dict(ts.views), dict(ts.extras), dict(ts.keys),
                   dict(ts.create_sql))
    for (db, table), reader in ts.readers.items():
        out.readers[(db, table)] = (lambda d=db, t=table, r=reader: hook(d, t, r()))
    return out


def run_backup(ts: TableSet, dbs: list[str], targets: list[str], opts: DumpOptions | None = None,
               compression: str = "gzip", pattern: str | None = None, ignore_rules: list[str] | None = None,
               programs: Programs | None = None,
               table_hook: Callable[[str, str, DataFrame], DataFrame] | None = None,
               now: dt.datetime | None = None) -> DataFrame:
    """Dump ``dbs`` once and write it to every target; returns the run record (one row)."""
    if not targets:
        raise ValueError("no targets")
    start = dt.datetime.now(dt.timezone.utc)
    now = now or start
    name = run_name(now, compression, pattern)
    source = apply_table_hook(ts, table_hook) if table_hook else ts
    dump_start = dt.datetime.now(dt.timezone.utc)
    script = dump(source, dbs, opts, ignore_rules=ignore_rules, programs=programs)
    uploads = push(script, [f"{t.rstrip('/')}/{name}" for t in targets], compression=compression).collect()
    dump_end = min(u.start for u in uploads)
    end = dt.datetime.now(dt.timezone.utc)
    rows = [(uuid.uuid4().hex, start, end, dump_start, dump_end, int(uploads[0].bytes),
             [(t, name, u.start, u.end) for t, u in zip(targets, uploads)])]
    return ts.spark.createDataFrame(rows, RUNS_SCHEMA).withColumn("name", F.lit(name))
