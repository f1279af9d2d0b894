"""Rows and statements go to and from Python in batches bounded by bytes, however many rows there are."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablevault.operators import many_tables, restore, statements


@pytest.mark.parametrize("many", [True, False])
def test_packing_takes_rows_in_small_batches(spark, monkeypatch, many):
    module = many_tables if many else statements
    real = module._packer

    def probed(*args):
        pack = real(*args)

        def run(batches):
            def watched():
                for batch in batches:
                    assert int(batch["size"].sum()) < 8 << 20
                    yield batch

            return pack(watched())

        return run

    monkeypatch.setattr(module, "_packer", probed)
    df = spark.range(3000).select("id", F.repeat(F.lit("x"), 10_000).alias("s"))
    if many:
        packed = many_tables.insert_many([many_tables.TableRows(0, df, "t", ["id"])], 65536, num_partitions=1)
    else:
        packed = statements.insert_extended(df, "t", ["id"], 65536, num_partitions=1)
    assert packed.agg(F.sum("n_rows")).first()[0] == 3000


def test_statements_are_handed_on_in_small_frames():
    rows = [("f", i, "x" * 500_000) for i in range(20)]
    frames = list(restore._batched(rows, ["file", "pos", "stmt"]))
    assert sum(len(f) for f in frames) == 20
    assert max(int(f["stmt"].str.len().sum()) for f in frames) <= 2 << 20


def test_functions_of_runs_come_in_small_batches(spark, monkeypatch):
    """The functions of all partitions of a large table are never held by one task."""
    real = many_tables._starts

    def probed(*args):
        starts = real(*args)

        def run(batches):
            def watched():
                for batch in batches:
                    assert 32 * int(batch["g"].map(len).sum()) < 8 << 20
                    yield batch

            return starts(watched())

        return run

    monkeypatch.setattr(many_tables, "_starts", probed)
    table = many_tables.TableRows(0, spark.range(800_000), "t", ["id"])
    packed = many_tables.insert_many([table], 1 << 20, num_partitions=8)
    assert packed.agg(F.sum("n_rows")).first()[0] == 800_000


@pytest.mark.parametrize("limit", [1, 40, 300, 5000, 10**9])
def test_a_run_folded_in_pieces_has_the_function_of_the_whole(monkeypatch, limit):
    sizes = np.random.default_rng(limit).integers(3, 90, 700)
    whole = statements._partition_function(sizes, limit)
    for piece in (1, 7, 699, 700):
        monkeypatch.setattr(statements, "FOLD_ROWS", piece)
        run = statements.Fold(limit)
        for start in range(0, len(sizes), 50):
            run.add(sizes[start:start + 50])
        for got, expected in zip(run.done(), whole, strict=True):
            assert np.array_equal(got, expected)


def test_a_run_is_folded_without_holding_its_rows():
    """Sizes of millions of rows of a partition become a function a packet long, batch by batch."""
    batches = (pd.DataFrame({"tid": 0, "_pid": 3, "size": np.full(10_000, 100)}) for _ in range(300))
    tracemalloc.start()
    try:
        found, = many_tables._runs({0: 1 << 20})(batches)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found["total"][0] == 3_000_000 * 101 and found["id"][0] == 3
    assert peak < 24 << 20


def test_a_composed_function_stays_within_a_packet():
    """Partitions smaller than a packet: what their group can do first ends with the first tuple beyond the limit."""
    limit, rng = 1000, np.random.default_rng(4)
    parts = [rng.integers(3, 90, rng.integers(0, 12)) for _ in range(200)]
    members = pd.DataFrame([(i, *statements._partition_function(p, limit)) for i, p in enumerate(parts)],
                           columns=["id", "g", "out", "n", "last", "total", "open"])
    found = statements._composer(limit)((0,), members).iloc[0]
    whole = statements._partition_function(np.concatenate(parts), limit)
    for got, expected in zip((found["g"], found["out"], found["n"], found["total"], found["open"]),
                             (*whole[:3], *whole[4:]), strict=True):
        assert np.array_equal(got, expected)
