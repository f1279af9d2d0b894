import datetime as dt
import glob
import gzip
import os

import pytest
from pyspark.sql import functions as F

from tablevault.operators.audit import (check_begin, dump_report, first_run, missed_runs, run_report,
                                        verify_ordered, verify_snapshot)
from tablevault.operators.restore import load_script_lines, read_scripts, split_script_text
from tablevault.plans.script import DumpOptions, Programs, dump
from tablevault.sinks.writers import (codec, decrypt_column, delete_backups, encrypt_column, push,
                                      restore_tables, write_dump)
from tablevault.sources.listing import list_backups
from tablevault.sources.tableset import TableSet, big_table

BEGIN_CASES = [("+1", 1), ("+999999", 999999), ("1023", 23), ("2359", 13 * 60 + 59), ("0959", 23 * 60 + 59),
               ("2401", 14 * 60 + 1), ("today", None), ("1", None), ("+1h", None), ("12345", None)]


def test_first_run_cases(spark):
    df = spark.createDataFrame([(b,) for b, _ in BEGIN_CASES], "b string").withColumn(
        "f", F.lit("2018-10-10 10:00:00").cast("timestamp_ntz"))
    got = [r.m for r in df.select(F.timestamp_diff("MINUTE", F.col("f"), first_run("b", "f")).alias("m")).collect()]
    assert got == [m for _, m in BEGIN_CASES]
    with pytest.raises(Exception, match="invalid format for begin delay '"):
        df.select(check_begin("b")).collect()


def test_missed_runs(spark):
    sch = spark.createDataFrame([("t", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 5), 60)],
                                "target string, begin timestamp_ntz, end timestamp_ntz, frequency int")
    runs = spark.createDataFrame([("t", dt.datetime(2024, 1, 1, 0, 10)), ("t", dt.datetime(2024, 1, 1, 2, 59)),
                                  ("t", dt.datetime(2024, 1, 1, 6))], "target string, ts timestamp_ntz")
    got = sorted(r.tick_no for r in missed_runs(sch, runs).collect())
    assert got == [1, 3, 4]


def test_verify_snapshot(spark):
    a = spark.createDataFrame([("-- tablevault SQL dump 0.1.0",), ("x",), ("x",), ("y",), ("",)], "value string")
    b = spark.createDataFrame([("-- Dump completed on 2024",), ("x",), ("z",)], "value string")
    got = sorted((r.side, r.value) for r in verify_snapshot(a, b).collect())
    assert got == [("a", "x"), ("a", "y"), ("b", "z")]
    oa = spark.createDataFrame([(1, "x"), (2, "y")], "pos int, value string")
    ob = spark.createDataFrame([(1, "x"), (2, "q"), (3, "r")], "pos int, value string")
    assert sorted(r.pos for r in verify_ordered(oa, ob, ["pos"]).collect()) == [2, 3]


def test_run_report(spark):
    t0 = dt.datetime(2024, 1, 1)
    runs = spark.createDataFrame(
        [("r1", t0, t0 + dt.timedelta(seconds=10), t0, t0 + dt.timedelta(seconds=4), 100,
          [("file:///a", "x.tgz", t0, t0 + dt.timedelta(seconds=2)),
           ("s3://b", "x.tgz", t0, t0 + dt.timedelta(seconds=3))])],
        "run_id string, start timestamp_ntz, end timestamp_ntz, dump_start timestamp_ntz, "
        "dump_end timestamp_ntz, bytes long, uploads array<struct<target:string,filename:string,"
        "start:timestamp_ntz,end:timestamp_ntz>>")
    r = run_report(runs).first()
    assert (r.total_seconds, r.dump_seconds, r.n_uploads, r.upload_seconds) == (10.0, 4.0, 2, 5.0)


def test_encrypt_roundtrip(spark):
    import base64

    key = base64.b64encode(b"k" * 32).decode()
    df = spark.createDataFrame([("x" * 100,)], "s string")
    r = df.select(encrypt_column("s", key).alias("c")).select(
        F.octet_length(F.unbase64("c")).alias("n"), decrypt_column("c", key).alias("p")).first()
    assert r.n == 128 and r.p == "x" * 100


def test_codec_names():
    assert codec("gzip") == "gzip" and codec("none") == "none"
    with pytest.raises(ValueError):
        codec("zstd")


def make_tester(spark):
    """The reference's tester database: t1 (widest types), empty t1_log, a view, a trigger,
    a function and a procedure."""
    t1 = spark.createDataFrame(
        [(1, "John", '{"a":"b"}', dt.date(2012, 11, 1), "00:15:00", dt.datetime(2012, 11, 1, 0, 15), dt.datetime(2012, 11, 1, 0, 15)),
         (2, "Jill", '{"c":true}', dt.date(2012, 11, 2), "00:16:00", dt.datetime(2012, 11, 2, 0, 16), dt.datetime(2012, 11, 2, 0, 16)),
         (3, "Sam", '{"d":24}', dt.date(2012, 11, 3), "00:17:00", dt.datetime(2012, 11, 3, 0, 17), dt.datetime(2012, 11, 3, 0, 17)),
         (4, "Sarah", '{"a":"b"}', dt.date(2012, 11, 4), "00:18:00", dt.datetime(2012, 11, 4, 0, 18), dt.datetime(2012, 11, 4, 0, 18))],
        "id int, name string, j string, d date, t string, dt timestamp_ntz, ts timestamp")
    log = spark.createDataFrame([], "id int, name string, inserted_at timestamp")
    ts = TableSet(spark).add_table("tester", "t1", t1, key=["id"]).add_table("tester", "t1_log", log)
    ts.add_view("tester", "view1", "SELECT id, name FROM t1")
    progs = Programs(
        triggers=spark.createDataFrame(
            [("tester", "t1", "trg_t1_insert", "INSERT", "AFTER",
              "BEGIN\n  INSERT INTO t1_log (id, name) VALUES (NEW.id, NEW.name);\nEND", "root@%")],
            "db string, table string, name string, event string, timing string, statement string, definer string"),
        views=spark.createDataFrame(
            [("tester", "view1", ["id", "name"],
              "CREATE ALGORITHM=UNDEFINED DEFINER=`root`@`%` SQL SECURITY DEFINER VIEW `view1` AS select "
              "`t1`.`id` AS `id`,`t1`.`name` AS `name` from `t1`", "utf8mb4", "utf8mb4_0900_ai_ci")],
            "db string, view string, columns array<string>, create_sql string, charset string, collation string"),
        routines=spark.createDataFrame(
            [("tester", "FUNCTION", "name_length",
              "CREATE DEFINER=`root`@`%` FUNCTION `name_length`(n VARCHAR(20)) RETURNS int\n    DETERMINISTIC\n"
              "RETURN CHAR_LENGTH(n)"),
             ("tester", "PROCEDURE", "add_person",
              "CREATE DEFINER=`root`@`%` PROCEDURE `add_person`(IN p_id INT)\nBEGIN\n  INSERT INTO t1 (id) VALUES (p_id);\nEND")],
            "db string, kind string, name string, create_sql string"))
    return ts, progs


def _script_text(path, db):
    parts = sorted(glob.glob(f"{path}/db={db}/part-*"))
    return "".join((gzip.open(p, "rt") if p.endswith(".gz") else open(p)).read() for p in parts)


@pytest.mark.parametrize("compact", [False, True])
def test_tester_script_order_and_restore(spark, tmp_out, compact):
    ts, progs = make_tester(spark)
    opts = DumpOptions(compact=compact, completed_at="2024-01-01 00:00:00", mode="exact")
    script = dump(ts, ["tester"], opts, programs=progs)
    out = f"{tmp_out}/dump"
    write_dump(script, out, compression="gzip", num_partitions=4)
    text = _script_text(out, "tester")
    order = ["CREATE DATABASE", "USE `tester`;", "CREATE TABLE `t1`", "INSERT INTO `t1`", "TRIGGER `trg_t1_insert`",
             "CREATE TABLE `t1_log`", "CREATE VIEW `view1` AS SELECT", "FUNCTION `name_length`",
             "PROCEDURE `add_person`", "VIEW `view1` AS select"]
    pos = [text.find(x) for x in order]
    assert all(p >= 0 for p in pos) and pos == sorted(pos), list(zip(order, pos))
    assert ("-- Dump completed on" in text) != compact
    assert ("DROP FUNCTION IF EXISTS" in text) != compact
    stmts = split_script_text(text)
    assert any(s.startswith("/*!50003 CREATE*/ /*!50017 DEFINER=`root`@`%`*/ /*!50003 TRIGGER") for s in stmts)
    lines = spark.read.text(out)
    t1 = ts.read("tester", "t1")
    back = load_script_lines(lines, {"t1": t1.schema})["t1"]
    assert back.exceptAll(t1).count() == 0 and t1.exceptAll(back).count() == 0
    rs = read_scripts(spark, out)
    assert rs.count() == len(stmts)


def test_ignored_table_has_no_trigger(spark):
    ts, progs = make_tester(spark)
    script = dump(ts, ["tester"], DumpOptions(), ignore_rules=["t1"], programs=progs)
    vals = [r.value for r in script.collect()]
    assert not any("trg_t1_insert" in v for v in vals)
    assert not any("CREATE TABLE `t1` (" in v for v in vals)


def test_big_table_dump_report(spark):
    ts = TableSet(spark).add_table("db01", "big1", big_table(spark, 300, 4096), key=["id"])
    script = dump(ts, ["db01"], DumpOptions(max_allowed_packet=100000))
    r = dump_report(script).first()
    assert r.n_statements >= 12 and r.max_statement_bytes <= 100001


def test_push_list_prune_delete(spark, tmp_out):
    df = spark.createDataFrame([(1, "a")], "id int, s string")
    script = dump(TableSet(spark).add_table("d", "t", df, key=["id"]), ["d"], DumpOptions(skip_extended_insert=True))
    res = push(script, [f"{tmp_out}/t1", f"{tmp_out}/t2"], compression="none").collect()
    assert res[0].files >= 1 and (res[0].files, res[0].bytes) == (res[1].files, res[1].bytes)
    assert open(glob.glob(f"{tmp_out}/t1/db=d/part-*")[0]).read() != "" or res[0].files > 1
    os.makedirs(f"{tmp_out}/bk")
    names = ["db_backup_2021-01-01T00:00:00Z.tgz", "db_backup_2021-01-02T00:00:00Z.tgz", "notes.txt"]
    for n in names:
        open(f"{tmp_out}/bk/{n}", "w").close()
    listing = list_backups(spark, [f"{tmp_out}/bk"])
    assert sorted(r.filename for r in listing.collect()) == sorted(names)
    from tablevault.operators.retention import classify_names, prune_by_count

    cands = prune_by_count(classify_names(listing), 1)
    dry = delete_backups(cands).collect()
    assert [r.deleted for r in dry] == [False] and len(os.listdir(f"{tmp_out}/bk")) == 3
    real = delete_backups(cands, dry_run=False).collect()
    assert [r.deleted for r in real] == [True]
    assert sorted(os.listdir(f"{tmp_out}/bk")) == ["db_backup_2021-01-02T00:00:00Z.tgz", "notes.txt"]


def test_restore_tables_publishes(spark, tmp_out):
    a = spark.createDataFrame([(1,)], "x int")
    got = restore_tables({"a": a, "b": a}, f"{tmp_out}/dest")
    assert got == ["a", "b"]
    assert spark.read.parquet(f"{tmp_out}/dest/a").count() == 1
    assert not [p for p in os.listdir(f"{tmp_out}/dest") if p.startswith("_staging")]


def test_run_backup_report_and_prune(spark, tmp_out):
    from tablevault.operators.retention import classify_names, prune_by_count
    from tablevault.plans.backup import run_backup, run_name

    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, s string")
    ts = TableSet(spark).add_table("d", "t", df, key=["id"])
    hook = lambda db, t, frame: frame.where(F.col("id") > 1)
    targets = [f"{tmp_out}/a", f"{tmp_out}/b"]
    runs = []
    for day in (1, 2, 3):
        now = dt.datetime(2024, 1, day, 0, 0, 0)
        runs.append(run_backup(ts, ["d"], targets, DumpOptions(skip_extended_insert=True), table_hook=hook, now=now))
    assert run_name(dt.datetime(2024, 1, 1), "gzip") == "db_backup_2024-01-01T00-00-00Z.tgz"
    rep = run_report(runs[0]).first()
    assert rep.n_uploads == 2 and rep.total_seconds > 0
    text = _script_text(f"{tmp_out}/a/db_backup_2024-01-03T00-00-00Z.tgz", "d")
    assert "(2,'b')" in text and "(1,'a')" not in text
    listing = list_backups(spark, targets, include_dirs=True)
    assert listing.count() == 6
    cands = prune_by_count(classify_names(listing), 2)
    res = delete_backups(cands, dry_run=False).collect()
    assert len(res) == 2 and all(r.deleted for r in res)
    assert sorted(os.listdir(f"{tmp_out}/a")) == ["db_backup_2024-01-02T00-00-00Z.tgz", "db_backup_2024-01-03T00-00-00Z.tgz"]


def test_unkeyed_dump_spreads_by_text_hash_and_is_stable(spark, tmp_out):
    """Rows at equal script positions (no key) spread over files by a text hash; every statement
    is written once, the bytes are the same run after run, and no range key carries the text."""
    rows = [(i % 7, f"v{i}" * (i % 5 + 1)) for i in range(3000)]
    ts = TableSet(spark).add_table("db01", "t", spark.createDataFrame(rows, "a int, s string"))
    opts = DumpOptions(skip_extended_insert=True, completed_at="2024-01-01 00:00:00")
    texts = []
    for run in ("one", "two"):
        out = os.path.join(tmp_out, run)
        write_dump(dump(ts, ["db01"], opts), out, compression="none", num_partitions=8)
        files = sorted(glob.glob(os.path.join(out, "db=db01", "part-*")))
        assert len(files) > 1
        texts.append("".join(open(f).read() for f in files))
    assert texts[0] == texts[1]
    inserts = [line for line in texts[0].split("\n") if line.startswith("INSERT INTO `t`")]
    expected = sorted(f"INSERT INTO `t` (`a`, `s`) VALUES ({a},'{s}');" for a, s in rows)
    assert sorted(inserts) == expected
    from tablevault.plans.script import assemble

    plan = assemble(dump(ts, ["db01"], opts), 8)._jdf.queryExecution().executedPlan().toString()
    range_key = plan[plan.index("rangepartitioning("):].split(", 8)")[0]
    assert "_vh" in range_key and "value" not in range_key


def test_equal_scripts_shuffle_no_text_and_differences_stay_in_their_ranges(spark):
    from tablevault.operators.audit import unequal_ranges, verify_snapshot

    lines = spark.range(20_000).selectExpr("concat('line ', id % 15000) value")
    assert unequal_ranges(lines, lines.orderBy("value")).count() == 0
    assert verify_snapshot(lines, lines.repartition(7)).count() == 0
    other = lines.where("value <> 'line 14000'").union(spark.sql("SELECT 'line 3' value UNION ALL SELECT 'new'"))
    assert 2 <= unequal_ranges(lines, other).count() <= 3
    got = sorted(tuple(r) for r in verify_snapshot(lines, other).collect())
    assert got == [("a", "line 14000"), ("b", "line 3"), ("b", "new")]
    # lines that would cancel out in a sum without their number, and pairs that swap sides
    a, b = (spark.createDataFrame([(x,) for x in t], "value string") for t in (["x", "x", "y"], ["x", "y", "y"]))
    assert sorted(tuple(r) for r in verify_snapshot(a, b).collect()) == [("a", "x"), ("b", "y")]
    plan = verify_snapshot(lines, lines)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan
