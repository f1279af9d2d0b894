"""Dump metadata, views, keys, deletion, publishing, snapshot comparison."""
import os

import pytest

from tablevault.operators.audit import missed_runs, verify_snapshot
from tablevault.operators.restore import run_restore, schema_of_ddl
from tablevault.plans.script import DumpOptions, Programs, dump
from tablevault.sinks.writers import delete_backups, encrypt_column, restore_tables, write_dump
from tablevault.sources.tableset import TableSet, tableset_from_catalog


def values(script):
    return [r.value for r in script.orderBy("db", "section", "table_key", "part", "chunk", "seq").collect()]


def test_computed_columns_and_server_ddl(spark):
    df = spark.createDataFrame([(1, 2, 3)], "id int, a int, twice int")
    schemata = spark.createDataFrame([("d",), ("mysql",)], "db string")
    tables = spark.createDataFrame([("d", "t", "BASE TABLE", "CREATE TABLE `t` (\n  `own` text\n);"), ("d", "v", "VIEW", "CREATE VIEW v AS SELECT 1"),
                                    ("mysql", "user", "BASE TABLE", None)], "db string, table string, kind string, create_sql string")
    columns = spark.createDataFrame([("d", "t", "twice", "STORED GENERATED"), ("d", "t", "a", "DEFAULT_GENERATED")],
                                    "db string, table string, name string, extra string")
    ts = tableset_from_catalog(spark, schemata, tables, columns, lambda d, t: df)
    text = "\n".join(values(dump(ts, ["d"])))
    assert "(`id`, `a`) VALUES (1,2);" in text and "`own` text" in text and list(ts.readers) == [("d", "t")]
    bad = tables.selectExpr("db", "table", "'SEQUENCE' kind", "create_sql")
    with pytest.raises(Exception, match="unknown table type"):
        tableset_from_catalog(spark, schemata, bad, columns, lambda d, t: df)


def test_names_that_differ_in_case_stay_apart(spark):
    df = spark.createDataFrame([(1,)], "id int")
    ts = TableSet(spark).add_table("d", "T1", df, ["id"]).add_table("d", "t1", df, ["id"])
    locks = [line for v in values(dump(ts, ["d"])) for line in v.split("\n") if "LOCK TABLES" in line or line.startswith("INSERT")]
    assert [x.split("`")[1] if "`" in x else x for x in locks] in (
        ["t1", "t1", "UNLOCK TABLES;", "T1", "T1", "UNLOCK TABLES;"], ["T1", "T1", "UNLOCK TABLES;", "t1", "t1", "UNLOCK TABLES;"])


@pytest.mark.parametrize("sql, parts", [
    ("CREATE ALGORITHM=UNDEFINED DEFINER=`my VIEW`@`%` SQL SECURITY DEFINER VIEW `v` AS select 1",
     ["/*!50001 CREATE ALGORITHM=UNDEFINED */", "/*!50013 DEFINER=`my VIEW`@`%` SQL SECURITY DEFINER */", "/*!50001 VIEW `v` AS select 1 */;"]),
    ("CREATE VIEW `v` AS select 1", ["/*!50001 CREATE */", "/*!50001 VIEW `v` AS select 1 */;"])])
def test_view_clauses(spark, sql, parts):
    views = spark.createDataFrame([("d", "v", ["a`b"], sql, "utf8mb4", "utf8mb4_bin")],
                                  "db string, view string, columns array<string>, create_sql string, charset string, collation string")
    ts = TableSet(spark).add_view("d", "v", sql)
    text = "\n".join(values(dump(ts, ["d"], programs=Programs(views=views))))
    assert "\n".join(parts) in text and " 1 AS `a``b`" in text


def test_keys_of_another_length_are_refused(spark):
    import base64

    df = spark.createDataFrame([("x",)], "s string")
    with pytest.raises(ValueError, match="32-byte"):
        encrypt_column("s", base64.b64encode(bytes(16)).decode())
    cipher = df.select(encrypt_column("s", base64.b64encode(bytes(32)).decode()).alias("c"))
    a, b = cipher.collect()[0].c, cipher.collect()[0].c
    assert a != b and len(base64.b64decode(a)) == 32


def test_deletion_runs_once_and_can_be_repeated(spark, tmp_out):
    open(f"{tmp_out}/a.tgz", "w").write("x")
    names = spark.createDataFrame([(tmp_out, "a.tgz")], "target string, filename string")
    done = delete_backups(names, dry_run=False)
    assert not os.path.exists(f"{tmp_out}/a.tgz")
    open(f"{tmp_out}/a.tgz", "w").write("x")
    assert done.collect()[0].deleted and os.path.exists(f"{tmp_out}/a.tgz")
    assert delete_backups(names, dry_run=False).collect()[0].error is None
    assert delete_backups(names, dry_run=False).collect()[0].deleted


def test_a_failing_restore_leaves_the_old_tables(spark, tmp_out):
    from pyspark.sql import functions as F

    one, two = (spark.createDataFrame([(i,)], "id int") for i in (1, 2))
    restore_tables({"a": one, "b": one}, f"{tmp_out}/d")
    broken = two.select(F.raise_error(F.lit("no")).alias("id"))
    with pytest.raises(Exception):
        restore_tables({"a": two, "b": broken}, f"{tmp_out}/d")
    assert [spark.read.parquet(f"{tmp_out}/d/{t}").first()[0] for t in "ab"] == [1, 1]
    restore_tables({"a": two, "b": two}, f"{tmp_out}/d")
    assert [spark.read.parquet(f"{tmp_out}/d/{t}").first()[0] for t in "ab"] == [2, 2]


def test_restore_run_reads_types_from_the_script(spark, tmp_out):
    df = spark.createDataFrame([(1, "a", None, 1.5), (2, None, bytearray(b"\xff\x00"), None)], "id int, `s x` string, b binary, f double")
    ts = TableSet(spark).add_table("d", "t", df, ["id"])
    write_dump(dump(ts, ["d"], DumpOptions(mode="exact")), f"{tmp_out}/dump")
    assert run_restore(spark, f"{tmp_out}/dump", f"{tmp_out}/out", mapping={"d": "e"}) == {"e": ["t"]}
    back = spark.read.parquet(f"{tmp_out}/out/e/t")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    body = "\n  `a` int unsigned NOT NULL,\n  `b` decimal(8,2) DEFAULT '1,2',\n  `c``d` tinyint(1),\n  `e` enum('x','y'),\n  PRIMARY KEY (`a`)\n)"
    assert schema_of_ddl(body).simpleString() == "struct<a:bigint,b:decimal(8,2),c`d:boolean,e:string>"


def test_dumps_that_differ_in_time_only_are_equal(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "id int, s string")
    ts = TableSet(spark).add_table("d", "t", df, ["id"])
    a, b = (dump(ts, ["d"], DumpOptions(completed_at=t)) for t in ("2024-01-01 00:00:00", "2024-01-02 00:00:00"))
    assert verify_snapshot(a, b).count() == 0
    other = dump(TableSet(spark).add_table("d", "t", df.limit(1), ["id"]), ["d"], DumpOptions(completed_at="x"))
    assert verify_snapshot(a, other).count() == 2


def test_an_empty_schedule_window_has_no_ticks(spark):
    schedules = spark.sql("SELECT 'a' target, timestamp_ntz'2024-01-01 00:00:00' begin, timestamp_ntz'2024-01-01 00:00:00' end, 60 frequency")
    runs = spark.sql("SELECT 'a' target, timestamp_ntz'2024-01-01 00:00:00' ts")
    assert missed_runs(schedules, runs).count() == 0
