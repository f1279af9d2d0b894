"""The CREATE TABLE reader, and restores that depend on it."""

import pytest
from pyspark.sql import functions as F

from tablevault.operators.ddl import TableDef, parse_create_table, with_computed
from tablevault.operators.restore import read_scripts, run_restore, spark_type, tag_statements
from tablevault.plans.script import DumpOptions, Programs, dump
from tablevault.sinks.writers import write_dump
from tablevault.sources.tableset import TableSet


@pytest.mark.parametrize(("mysql", "want"), [
    ("tinyint", "tinyint"), ("tinyint unsigned", "smallint"), ("tinyint(1)", "boolean"), ("tinyint(1) unsigned", "smallint"),
    ("TINYINT(3) UNSIGNED", "smallint"), ("smallint unsigned", "int"), ("mediumint(8) unsigned zerofill", "int"),
    ("int zerofill", "bigint"), ("integer", "int"), ("bigint unsigned", "decimal(20,0)"), ("serial", "decimal(20,0)"),
    ("decimal", "decimal(10,0)"), ("decimal(8)", "decimal(8,0)"), ("numeric(8,2) unsigned", "decimal(8,2)"),
    ("decimal(65,30)", "string"), ("double precision", "double"), ("double(10,2) unsigned", "double"), ("float", "float"),
    ("bool", "boolean"), ("year(4)", "int"), ("datetime(6)", "timestamp_ntz"), ("timestamp(3) NULL", "timestamp"),
    ("time(6)", "string"), ("national varchar(10)", "string"), ("character varying(3)", "string"), ("long", "string"),
    ("long varbinary", "binary"), ("bit(3)", "binary"), ("enum('a,b','c''d','(')", "string"), ("geometry", "binary")])
def test_types(mysql, want):
    assert spark_type(mysql) == want
    table = parse_create_table(f"CREATE TABLE `t` (\n  `x` {mysql} DEFAULT NULL COMMENT 'a, b) unsigned',\n  `y` int\n)")
    assert [(c.name, c.spark_type()) for c in table.columns] == [("x", want), ("y", "int")]


def test_keys_comments_and_names(spark):
    table = parse_create_table(
        "-- CREATE TABLE `no` (x int)\n/*!40101 SET @a = 'CREATE TABLE `no` (x int)' */;\nCREATE TABLE IF NOT EXISTS `d`.`a``b` (\n"
        "  `primary` int NOT NULL /* a comment, here */, -- and here, too\n  `key` varchar(9) DEFAULT (concat('(',')')),\n"
        "  `c` int GENERATED ALWAYS AS (`primary` + 1) VIRTUAL /*!80023 INVISIBLE */,\n"
        "  PRIMARY KEY (`primary`,`key`(3) DESC) USING BTREE, UNIQUE KEY `u` (`key`), FULLTEXT KEY `f` (`key`),\n"
        "  CONSTRAINT `x` FOREIGN KEY (`primary`) REFERENCES `o` (`id`) ON DELETE CASCADE, CHECK ((`primary` > 0))\n"
        ") ENGINE=InnoDB COMMENT='x'")
    assert (table.name, table.names(), table.primary_key) == ("a`b", ["primary", "key", "c"], ["primary", "key"])
    assert table.stored().names == ["primary", "key"] and table.columns[2].computed == "`primary` + 1"
    assert not table.columns[0].nullable and table.columns[1].nullable
    for other in ("CREATE VIEW `v` AS SELECT 1", "CREATE TABLE `a` LIKE `b`", "INSERT INTO `t` VALUES ('CREATE TABLE `a` (x int)')"):
        assert parse_create_table(other) is None
    with pytest.raises(ValueError, match="cannot be read"):
        parse_create_table("CREATE TABLE `t` (`x`)")


def test_computed_columns_use_others_and_fail_by_name(spark):
    table = parse_create_table("CREATE TABLE t (b varchar(9) AS (concat(a,_utf8mb4'''',\"x\")), a int, c int AS (a * 2), d int AS (c + 1))")
    rows = spark.createDataFrame([(1,), (None,)], "a int")
    assert with_computed(rows, table).collect() == [("1'x", 1, 2, 3), (None, None, None, None)]
    assert isinstance(table, TableDef)
    with pytest.raises(ValueError, match="'c' of table 't'"):
        with_computed(rows, parse_create_table("CREATE TABLE t (a int, c int AS (no_such_function(a)))"))


def test_a_restore_opens_each_file_once(spark, tmp_out):
    ts = TableSet(spark)
    for i in range(50):
        ts.add_table("many", f"t{i:02}", spark.range(i, i + 3).select(F.col("id"), F.lit(f"INSERT INTO `t{i}`").alias("s")), ["id"])
    write_dump(dump(ts, ["many"], DumpOptions(mode="exact", skip_extended_insert=True)), f"{tmp_out}/dump", num_partitions=4)
    opened = spark.sparkContext.accumulator(0)
    done = run_restore(spark, f"{tmp_out}/dump", f"{tmp_out}/out", opened=opened)
    files = len({r[0] for r in read_scripts(spark, f"{tmp_out}/dump").select("file").distinct().collect()})
    assert opened.value == files and len(done["many"]) == 50 and done.left_out == []
    for i in (0, 7, 49):
        assert sorted(r.id for r in spark.read.parquet(f"{tmp_out}/out/many/t{i:02}").collect()) == [i, i + 1, i + 2]


def test_programs_are_named_and_not_taken_for_data(spark, tmp_out):
    ts = TableSet(spark).add_table("d", "t", spark.createDataFrame([(1, "x")], "id int, s string"), ["id"]).add_view("d", "v", "")
    programs = Programs(
        triggers=spark.createDataFrame([("d", "t", "tr", "INSERT", "AFTER", "INSERT INTO `t` (`id`) VALUES (9)", "u@h")],
                                       "db string, table string, name string, event string, timing string, statement string, definer string"),
        views=spark.createDataFrame([("d", "v", ["id"], "CREATE ALGORITHM=UNDEFINED DEFINER=`u`@`h` SQL SECURITY DEFINER VIEW `v` AS select 1 AS `id`", "utf8mb4", "utf8mb4_bin")],
                                    "db string, view string, columns array<string>, create_sql string, charset string, collation string"),
        routines=spark.createDataFrame([("d", "PROCEDURE", "p", "CREATE DEFINER=`u`@`h` PROCEDURE `p`(IN a INT)\nBEGIN\nINSERT INTO `t` (`id`) VALUES (a);\nEND"),
                                        ("d", "FUNCTION", "f", "CREATE FUNCTION `f`(s TEXT) RETURNS int\nRETURN 1")],
                                       "db string, kind string, name string, create_sql string"))
    write_dump(dump(ts, ["d"], DumpOptions(mode="exact"), programs=programs), f"{tmp_out}/dump")
    done = run_restore(spark, f"{tmp_out}/dump", f"{tmp_out}/out")
    assert done == {"d": ["t"]}
    assert done.left_out == [("d", "FUNCTION", "f"), ("d", "PROCEDURE", "p"), ("d", "TRIGGER", "tr"), ("d", "VIEW", "v")]
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_out}/out/d/t").collect()] == [(1, "x")]
    long = spark.createDataFrame([("d", "f", 0, "CREATE USER " + "x" * 100_000), ("d", "f", 1, "\n" * 50_000 + "CREATE TABLE `t` (`a` int);")],
                                 "db string, file string, pos long, stmt string")
    assert [(r.kind, r.tbl) for r in tag_statements(long).collect()] == [("table", "t")]
