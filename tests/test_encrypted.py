"""Encrypted dumps: round trips, wrong keys, random vectors, and where the key does not stand."""

import base64
import glob

import pytest
from pyspark.sql import functions as F

from tablevault.operators.restore import load_inserts, split_script_text
from tablevault.plans.script import DumpOptions, dump
from tablevault.sinks.encrypted import key_provider, read_encrypted_scripts, write_encrypted_dump
from tablevault.sources.tableset import TableSet

KEY = base64.b64encode(bytes(range(32))).decode()


def script(spark, rows=300):
    df = spark.range(rows).select("id", F.concat(F.lit("it's; \n"), F.repeat(F.lit("é"), 40)).alias("s"))
    ts = TableSet(spark).add_table("d", "t", df, ["id"]).add_table("1", "u", df.limit(1), ["id"])
    return df, dump(ts, ["d", "1"], DumpOptions(mode="exact", max_allowed_packet=2000, completed_at="2024-01-01 00:00:00"))


@pytest.mark.parametrize("compression", ["gzip", "bzip2", "none"])
def test_round_trip(spark, tmp_out, compression):
    df, text = script(spark)
    write_encrypted_dump(text, f"{tmp_out}/dump", key_provider(KEY), compression, num_partitions=3, chunk_bytes=5000)
    stmts = read_encrypted_scripts(spark, f"{tmp_out}/dump", key_provider(KEY)).cache()
    back = load_inserts(stmts.where("db = 'd'"), "t", df.schema)
    assert back.exceptAll(df).count() == 0 and df.exceptAll(back).count() == 0
    rows = text.where("db = '1'").orderBy("section", "table_key", "part", "chunk", "seq").collect()
    want = split_script_text("\n".join(r.value for r in rows))
    assert [r.stmt for r in stmts.where("db = '1'").orderBy("file", "pos").collect()] == want


def test_keys_and_vectors(spark, tmp_out):
    _, text = script(spark, 20)
    with open(f"{tmp_out}/key", "w") as f:
        f.write(KEY + "\n")
    for name, provider in (("a", key_provider(KEY)), ("b", key_provider(path=f"{tmp_out}/key"))):
        write_encrypted_dump(text, f"{tmp_out}/{name}", provider, num_partitions=1)
    a, b = (open(p).read() for n in "ab" for p in glob.glob(f"{tmp_out}/{n}/db=d/part-*"))
    assert a != b and len(a) == len(b) and "INSERT" not in a
    with pytest.raises(Exception):
        read_encrypted_scripts(spark, f"{tmp_out}/a", key_provider(base64.b64encode(b"x" * 32).decode())).collect()
    frame = read_encrypted_scripts(spark, f"{tmp_out}/b", key_provider(path=f"{tmp_out}/key"))
    plan = frame._jdf.queryExecution().toString()
    assert KEY not in plan and bytes(range(32)).hex() not in plan.lower() and frame.count() > 5
    for bad in ({}, {"text": KEY, "path": "x"}, {"text": base64.b64encode(b"short").decode()}):
        with pytest.raises(ValueError):
            key_provider(**bad)
