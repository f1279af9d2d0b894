"""Benchmark: dump, load back and prune at one scale factor; prints one JSON line.

loading that dump back, and pruning the backup names made from ``events``. Each query runs to
completion through a sink (the ``noop`` writer, or real gzip files in a fresh scratch folder), so
nothing is skipped by column pruning.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    scratch = tempfile.mkdtemp(prefix="run-", dir=os.environ.get("BENCH_SCRATCH", "/tmp"))

    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("tablevault-bench")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", str(cpus * 2))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", "16g")
             .config("spark.checkpoint.dir", f"{scratch}/checkpoints")
             .config("spark.eventLog.enabled", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")

    from tablevault.operators.restore import load_script_lines
    from tablevault.operators.retention import prune
    from tablevault.operators.statements import insert_extended, insert_single
    from tablevault.plans.checks import POLICIES, PRUNE_NOW, events_listing
    from tablevault.plans.script import DumpOptions, dump
    from tablevault.sinks.writers import write_dump
    from tablevault.sources.tableset import TESTDATA_KEYS, parquet_tableset

    def read(t):
        return spark.read.parquet(f"{sf_dir}/{t}.parquet")

    def noop(df):
        df.write.format("noop").mode("overwrite").save()

    def text_mb(df, col):
        return df.agg(F.sum(F.octet_length(col) + 1)).first()[0] / 1e6

    times: dict[str, float] = {}
    mb: dict[str, float] = {}

    def timed(name, fn):
        t0 = time.perf_counter()
        out = fn()
        times[name] = round(time.perf_counter() - t0, 3)
        return out

    # warm-up: JVM, Python workers (the D3 fold runs in Arrow workers), Parquet footers (not timed)
    noop(insert_single(read("region"), "region"))
    noop(insert_extended(read("region"), "region", key=TESTDATA_KEYS["region"]))

    li_key = TESTDATA_KEYS["lineitem"]
    for table, key in [("lineitem", li_key), ("documents", ["doc_id"])]:
        df = read(table)
        d2 = insert_single(df, table)
        timed(f"d2_{table}", lambda: noop(d2))
        d3 = timed(f"d3_{table}_plan", lambda: insert_extended(df, table, key=key))
        timed(f"d3_{table}", lambda: noop(d3))
        times[f"d3_{table}"] = round(times[f"d3_{table}"] + times.pop(f"d3_{table}_plan"), 3)
        mb[f"d3_{table}"] = round(text_mb(d3, "stmt"), 2)

    ts = parquet_tableset(spark, sf_dir, layout={"sales": ["lineitem"], "corpus": ["documents"]})
    out = f"{scratch}/dump"

    def gzip_dump():
        script = dump(ts, ["sales", "corpus"], DumpOptions(completed_at="2024-01-01 00:00:00"))
        write_dump(script, out, compression="gzip")

    timed("d3_gzip_dump", gzip_dump)

    def load_back():
        lines = spark.read.text(out)
        frames = load_script_lines(lines, {"lineitem": read("lineitem").schema,
                                           "documents": read("documents").schema})
        for f in frames.values():
            noop(f)

    timed("restore_load", load_back)

    listing = events_listing(spark, sf_dir)
    policies = spark.createDataFrame(POLICIES, "target string, retention string")
    timed("prune_events", lambda: noop(prune(listing, policies, PRUNE_NOW)))

    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir).replace("sf", ""), "cpus": cpus,
                      "spark": spark.version, "text_mb": mb, "warm": True}))
    spark.stop()


if __name__ == "__main__":
    main()
