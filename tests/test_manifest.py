"""The manifest of a dump: what it says, what it saves, and what it finds."""

import glob
import gzip

import pytest
from pyspark.sql import functions as F

from tablevault.operators.restore import run_restore
from tablevault.plans.script import DumpOptions, dump
from tablevault.sinks.manifest import files_of, has_manifest, manifest_report, read_manifest, verify_manifest
from tablevault.sinks.writers import push, write_dump
from tablevault.sources.tableset import TableSet


def tables(spark, many=8, rows=400):
    ts = TableSet(spark)
    for i in range(many):
        ts.add_table("d" if i % 2 else "e e", f"T{i}", spark.range(rows).select("id", F.lit("x" * 50).alias("s")), ["id"])
    return ts


@pytest.fixture(scope="module")
def dumped(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("manifest") / "dump")
    write_dump(dump(tables(spark), ["d", "e e"], DumpOptions(max_allowed_packet=2000)), path, num_partitions=12, manifest=True)
    return path


def test_one_table_opens_its_files_only(spark, dumped, tmp_out):
    assert has_manifest(spark, dumped)
    opened = spark.sparkContext.accumulator(0)
    done = run_restore(spark, dumped, tmp_out, tables=[("d", "T3")], opened=opened)
    assert done == {"d": ["T3"]} and spark.read.parquet(f"{tmp_out}/d/T3").count() == 400
    mine = {r.file for r in files_of(spark, dumped, [("d", "T3")]).collect()}
    every = glob.glob(f"{dumped}/db=*/part-*")
    assert opened.value == len(mine) and 0 < len(mine) < len(every) / 2
    opened = spark.sparkContext.accumulator(0)
    assert run_restore(spark, dumped, f"{tmp_out}/all", include=["e e"], opened=opened) == {"e e": ["T0", "T2", "T4", "T6"]}
    assert opened.value < len(every)


def test_report_and_ranges(spark, dumped):
    got = {(r.db, r.table): (r.n_rows, r.n_statements) for r in manifest_report(spark, dumped).collect()}
    assert got.keys() == {("d" if i % 2 else "e e", f"T{i}") for i in range(8)} and {n for n, _ in got.values()} == {400}
    rows = read_manifest(spark, dumped).where("kind = 'data'").orderBy("db", "table", "first_seq").collect()
    for (db, table), (_, statements) in got.items():
        ranges = [(r.first_seq, r.last_seq) for r in rows if (r.db, r.table) == (db, table)]
        assert [s for a, b in ranges for s in range(a, b + 1)] == list(range(statements))
    kinds = {r.kind for r in read_manifest(spark, dumped).select("kind").distinct().collect()}
    assert {"header", "table", "data", "table_end", "routine", "footer"} == kinds


def test_verify_finds_what_was_changed(spark, tmp_out):
    path = f"{tmp_out}/dump"
    write_dump(dump(tables(spark, 3, 50), ["d", "e e"], DumpOptions(skip_extended_insert=True)), path, manifest=True, compression="none")
    assert verify_manifest(spark, path).count() == 0
    part = next(p for p in sorted(glob.glob(f"{path}/db=d/part-*")) if "VALUES (7," in open(p).read())
    text = open(part).read()
    open(part, "w").write(text.replace("VALUES (7,", "VALUES (8,"))
    assert [(r.db, r.table) for r in verify_manifest(spark, path).collect()] == [("d", "T1")]


def test_push_writes_a_manifest_to_each_target(spark, tmp_out):
    targets = [f"{tmp_out}/a", f"{tmp_out}/b"]
    push(dump(tables(spark, 2, 10), ["d", "e e"], DumpOptions()), targets)
    for t in targets:
        assert verify_manifest(spark, t).count() == 0 and manifest_report(spark, t).count() == 2
        assert any("INSERT INTO" in gzip.open(p, "rt").read() for p in glob.glob(f"{t}/db=d/part-*"))
