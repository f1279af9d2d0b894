"""Publication by versions: whole or not at all, also when a step fails, and readers in between."""

import os

import pytest
from pyspark.sql import functions as F

from tablevault.sinks import versions
from tablevault.sinks.versions import current_version, publish_version, read_published


def frames(spark, n, tables="ab"):
    return {t: spark.range(n).select((F.col("id") * 0 + n).alias("n")) for t in tables}


def seen(spark, dest):
    folder = current_version(spark, dest)
    return {t: {r.n for r in spark.read.parquet(f"{folder}/{t}").collect()} for t in sorted(os.listdir(folder)) if not t.startswith(".")}


def test_readers_see_one_version(spark, tmp_out):
    dest = f"{tmp_out}/d"
    with pytest.raises(FileNotFoundError):
        current_version(spark, dest)
    first = publish_version(frames(spark, 1), dest)
    held = spark.read.parquet(f"{first}/a")
    publish_version(frames(spark, 2, "bc"), dest)
    assert seen(spark, dest) == {"b": {2}, "c": {2}} and held.count() == 1
    assert read_published(spark, dest, "c").count() == 2
    publish_version(frames(spark, 3), dest)
    assert seen(spark, dest) == {"a": {3}, "b": {3}}
    assert not os.path.exists(first) and len(os.listdir(f"{dest}/_versions")) == 2


def test_a_failure_at_any_step_leaves_the_old_version(spark, tmp_out, monkeypatch):
    dest = f"{tmp_out}/d"
    publish_version(frames(spark, 1), dest)
    broken = frames(spark, 2) | {"b": spark.range(1).select(F.raise_error(F.lit("no")).alias("n"))}
    with pytest.raises(Exception):
        publish_version(broken, dest)  # a write fails
    assert seen(spark, dest) == {"a": {1}, "b": {1}} and len(os.listdir(f"{dest}/_versions")) == 1

    def fails(*_):
        raise OSError("listing")

    with monkeypatch.context() as m:
        m.setattr(versions, "_commits", fails)  # before the commit
        with pytest.raises(OSError):
            publish_version(frames(spark, 2), dest)
    assert seen(spark, dest) == {"a": {1}, "b": {1}} and len(os.listdir(f"{dest}/_versions")) == 1
    with pytest.raises(ValueError):
        publish_version(frames(spark, 2), dest, keep=0)


def test_two_publications_of_one_number_are_both_whole(spark, tmp_out):
    dest = f"{tmp_out}/d"
    publish_version(frames(spark, 1), dest)
    second = publish_version(frames(spark, 2), dest, keep=9)
    # another publisher that saw the same last number
    other = publish_version(frames(spark, 3), dest, keep=9)
    commits = sorted(n for n in os.listdir(f"{dest}/_commits") if not n.endswith(".crc"))
    os.rename(f"{dest}/_commits/{commits[-1]}", f"{dest}/_commits/{commits[-2].split('.')[0]}.{commits[-1].split('.')[1]}")
    winner = current_version(spark, dest)
    assert winner in (second, other) and winner == max(second, other)
    assert len(seen(spark, dest)["a"] | seen(spark, dest)["b"]) == 1
