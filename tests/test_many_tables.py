"""Packing many tables at once against packing each by itself."""

import random

import pytest
from pyspark.sql import functions as F

from tablevault.operators.many_tables import TableRows, insert_many
from tablevault.operators.statements import insert_extended
from tablevault.plans.script import DumpOptions, dump
from tablevault.sources.tableset import TableSet


def drawn(spark, seed):
    """Tables from empty to many partitions long, with several kinds of keys and none."""
    rng = random.Random(seed)
    tables = []
    for tid, n in enumerate([0, 1, 3, 700, 2, 0, 90, 1, 250, 5]):
        rows = [(i, f"k{rng.randint(0, 9)}", "x" * rng.choice([0, 3, 40, 300]) + "'") for i in rng.sample(range(2000), n)]
        df = spark.createDataFrame(rows, "id long, k string, s string").repartition(3)
        key = [["id"], ["k", "id"], None][tid % 3]
        if tid == 8:
            df = spark.createDataFrame([(1, "same", "row")] * 250, "id long, k string, s string").repartition(4)
        tables.append(TableRows(tid, df, f"t`{tid}", key))
    return tables


@pytest.mark.parametrize(("partitions", "fan", "packet"), [(1, 32, 500), (5, 2, 120), (17, 3, 900), (40, 4, 4000)])
def test_same_text_as_each_table_alone(spark, partitions, fan, packet):
    tables = drawn(spark, partitions)
    got = {}
    for r in insert_many(tables, packet, num_partitions=partitions, fan=fan).collect():
        got.setdefault(r.tid, []).append((r.seq, r.stmt, r.n_rows, r.n_bytes))
    for t in tables:
        want = sorted((r.seq, r.stmt, r.n_rows, r.n_bytes) for r in insert_extended(t.df, t.table, t.key, packet).collect())
        assert sorted(got.get(t.tid, [])) == want, t.table


def test_the_number_of_jobs_does_not_grow_with_the_tables(spark):
    jobs = {}
    for many in (20, 200):
        ts = TableSet(spark)
        base = spark.range(0, 3, numPartitions=1).cache()
        for i in range(many):
            ts.add_table("d", f"t{i:04}", base.select((F.col("id") + i).alias("id"), F.lit("x").alias("s")), ["id"])
        spark.sparkContext.setJobGroup(f"many{many}", "")
        script = dump(ts, ["d"], DumpOptions(num_partitions=8))
        assert script.where("section = 1 and part = 1").agg(F.sum("n_rows"), F.count("*")).first() == (3 * many, many)
        jobs[many] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"many{many}"))
        spark.sparkContext.setJobGroup("", "")
    assert jobs[200] <= jobs[20] + 2 and jobs[200] < 60


def test_streamed_batches_are_packed(spark, tmp_out):
    from tablevault.operators.restore import load_script_lines
    from tablevault.streaming.continuous import dump_stream, file_stream

    rows = spark.range(500).select("id", F.concat(F.lit("s"), F.col("id").cast("string")).alias("s"))
    rows.repartition(4).write.parquet(f"{tmp_out}/in")
    stream = file_stream(spark, f"{tmp_out}/in", rows.schema, max_files_per_trigger=2)
    dump_stream(stream, "t", f"{tmp_out}/out", f"{tmp_out}/ckpt", once=True, extended=True, key=["id"], max_packet=400,
                mode="exact").awaitTermination()
    lines = spark.read.text(f"{tmp_out}/out")
    assert lines.select("batch").distinct().count() == 2
    assert 10 < lines.count() < 40 and lines.agg(F.max(F.octet_length("value"))).first()[0] <= 401
    back = load_script_lines(lines, {"t": rows.schema})["t"]
    assert back.exceptAll(rows).count() == 0 and rows.exceptAll(back).count() == 0
