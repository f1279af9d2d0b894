import datetime as dt
import gzip
import os

from pyspark.sql import functions as F

from tablevault.operators.restore import (filter_databases, load_inserts, mapping_frame, read_scripts,
                                          remap_databases, split_script_text, statements_in_lines)
from tablevault.operators.statements import insert_extended, insert_single


def test_split_basic_and_tail():
    text = "-- c\nCREATE TABLE t (\n a int\n);\r\n\r\nINSERT INTO t VALUES (1);\nINSERT INTO t VALUES (2)"
    assert split_script_text(text) == ["-- c\nCREATE TABLE t (\n a int\n);", "INSERT INTO t VALUES (1);",
                                       "INSERT INTO t VALUES (2)"]


def test_split_delimiter_block():
    text = ("/*!50003 SET x = 1 */ ;\nDELIMITER ;;\nCREATE TRIGGER t AFTER INSERT ON a FOR EACH ROW\n"
            "BEGIN INSERT INTO b VALUES (1); END */;;\nDELIMITER ;\nSELECT 1;\n")
    got = split_script_text(text)
    assert got[0] == "/*!50003 SET x = 1 */ ;"
    assert got[1].startswith("CREATE TRIGGER") and got[1].endswith("END */")
    assert got[2] == "SELECT 1;"


def test_remap_full_and_compact(spark):
    stmts = [
        ("--\n-- Current Database: `foo`\n--\n\nCREATE DATABASE /*!32312 IF NOT EXISTS*/ `foo` /*!40100 DEFAULT "
         "CHARACTER SET utf8mb4 COLLATE utf8mb4_0900_ai_ci */ /*!80016 DEFAULT ENCRYPTION='N' */;",),
        ("use `foo`;",),
        ("USE `other`;",),
        ("INSERT INTO `foo` (`a`) VALUES (1);",),
    ]
    df = spark.createDataFrame(stmts, "stmt string")
    got = [r.stmt for r in remap_databases(df, mapping_frame(spark, "foo:bar,buz:qux")).collect()]
    assert got[0].startswith("CREATE DATABASE /*!32312 IF NOT EXISTS*/ `bar` /*!40100")
    assert got[1] == "use `bar`;"
    assert got[2] == "USE `other`;"
    assert got[3] == "INSERT INTO `foo` (`a`) VALUES (1);"


def test_filter_databases(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y")], "db string, stmt string")
    inc = spark.createDataFrame([("b",)], "db string")
    assert [r.stmt for r in filter_databases(df, inc).collect()] == ["y"]


def test_compact_line_with_two_statements(spark):
    line = ("INSERT INTO `t` (`a`, `s`) VALUES (1,'x;y'),(2,'it''s');"
            "INSERT INTO `t` (`a`, `s`) VALUES (3,'(\\');INSERT');")
    df = spark.createDataFrame([(line,)], "value string")
    st = statements_in_lines(df)
    assert st.count() == 2
    schema = spark.createDataFrame([], "a int, s string").schema
    rows = sorted(tuple(r) for r in load_inserts(st, "t", schema).collect())
    assert rows[0] == (1, "x;y") and rows[2] == (3, "(');INSERT")


def test_roundtrip_hard_values(spark):
    rows = [(1, "plain", bytearray(b"\x00\x01'"), dt.datetime(2020, 1, 1, 1, 2, 3, 456789), 1.0e-9, True),
            (2, "quote ' dq \" bs \\ nl \n cr \r tab \t nul \x00 z \x1a (x), ;", bytearray(b""), None, None, False),
            (3, None, None, dt.datetime(1999, 12, 31), -0.0, None),
            (4, "", bytearray(b"abc"), dt.datetime(2024, 2, 29, 23, 59, 59), 123456789.123456789, True)]
    df = spark.createDataFrame(rows, "id int, s string, b binary, ts timestamp_ntz, d double, f boolean")
    st = insert_extended(df, "hard", key=["id"], max_packet=120, mode="exact")
    back = load_inserts(st, "hard", df.schema)
    assert df.exceptAll(back).count() == 0 and back.exceptAll(df).count() == 0


def test_column_order_from_statement(spark):
    st = spark.createDataFrame([("INSERT INTO `t` (`b`, `a`) VALUES ('x',1),('y',NULL);",)], "stmt string")
    schema = spark.createDataFrame([], "a int, b string, c string").schema
    got = sorted((tuple(r) for r in load_inserts(st, "t", schema).collect()), key=lambda t: t[1])
    assert got == [(1, "x", None), (None, "y", None)]


def test_read_scripts_files(spark, tmp_out):
    os.makedirs(f"{tmp_out}/db=a")
    with gzip.open(f"{tmp_out}/db=a/part-0.sql.gz", "wt") as f:
        f.write("USE `a`;\nINSERT INTO `t` (`x`) VALUES (1),(2);\n")
    with open(f"{tmp_out}/db=a/part-1.sql", "w") as f:
        f.write("INSERT INTO `t` (`x`) VALUES (3);")
    got = sorted(r.stmt for r in read_scripts(spark, tmp_out).collect())
    assert got == ["INSERT INTO `t` (`x`) VALUES (1),(2);", "INSERT INTO `t` (`x`) VALUES (3);", "USE `a`;"]


def test_single_insert_roundtrip(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    st = insert_single(df, "conversations", mode="exact")
    back = load_inserts(st, "conversations", df.schema)
    assert back.exceptAll(df).count() == 0 and df.exceptAll(back).count() == 0


def test_read_archives_streams_members(spark, tmp_out):
    import io
    import tarfile

    from tablevault.operators.restore import read_archives

    os.makedirs(f"{tmp_out}/bk")
    name = f"{tmp_out}/bk/db_backup_2024-01-01T00:00:00Z.tgz"
    with tarfile.open(name, "w:gz") as tar:
        d = tarfile.TarInfo("dir")
        d.type = tarfile.DIRTYPE
        tar.addfile(d)
        for member, text in [("a_2024.sql", "USE `a`;\nINSERT INTO `t` (`x`) VALUES (1);\n"),
                             ("b_2024.sql", "DELIMITER ;;\nCREATE TRIGGER x BEGIN SELECT 1; END ;;\nDELIMITER ;\n")]:
            data = text.encode()
            info = tarfile.TarInfo(member)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    got = sorted((r.member, r.pos, r.stmt) for r in read_archives(spark, f"{tmp_out}/bk").collect())
    assert got == [("a_2024.sql", 0, "USE `a`;"), ("a_2024.sql", 1, "INSERT INTO `t` (`x`) VALUES (1);"),
                   ("b_2024.sql", 0, "CREATE TRIGGER x BEGIN SELECT 1; END")]


def test_read_scripts_glob(spark, tmp_out):
    os.makedirs(f"{tmp_out}/s")
    open(f"{tmp_out}/s/x.sql", "w").write("SELECT 1;\n")
    open(f"{tmp_out}/s/y.txt", "w").write("SELECT 2;\n")
    assert [r.stmt for r in read_scripts(spark, f"{tmp_out}/s", path_glob="*.sql").collect()] == ["SELECT 1;"]


def test_split_knows_quotes_comments_and_delimiters():
    from tablevault.operators.restore import statements_of

    text = ("-- it's; a comment\n# don't; either\n/* nor; this */ INSERT INTO `a;b` (`x`) VALUES ('1;\n-- 2','it''s',\"q;\\\"\");"
            "INSERT INTO `t` (`x`) VALUES ('\\\\');\nDELIMITER $$\nCREATE TRIGGER x BEGIN\n  INSERT INTO `t` (`x`) VALUES (1);\nEND$$\n"
            "delimiter ;\n/*!40101 SET @a='b;' */;\nSELECT 1")
    want = ["-- it's; a comment\n# don't; either\n/* nor; this */ INSERT INTO `a;b` (`x`) VALUES ('1;\n-- 2','it''s',\"q;\\\"\");",
            "INSERT INTO `t` (`x`) VALUES ('\\\\');", "CREATE TRIGGER x BEGIN\n  INSERT INTO `t` (`x`) VALUES (1);\nEND",
            "/*!40101 SET @a='b;' */;", "SELECT 1"]
    assert split_script_text(text) == want
    for size in (1, 2, 3, 7, 50):  # wherever blocks end
        data = text.encode()
        assert list(statements_of(data[i:i + size] for i in range(0, len(data), size))) == want


def test_data_is_never_taken_for_grammar(spark):
    hostile = ["the VALUES of x", "a VALUES (1,2) b", "x` VALUES (1,'y');", "DELIMITER ;;\n", "\nDELIMITER ;;\n", "INSERT INTO `t` (`id`) VALUES (7);",
               "');-- ", "/* no */ # no\n-- no", "\\'\\\\", "`(`, `)`", "a\0b\x1a\r\n", "", None, "NULL", "_binary 'x'", "X'41'"]
    df = spark.createDataFrame([(i, t, bytes([0, 255, 39, 92, 10, i]), t) for i, t in enumerate(hostile)],
                               "id int, `a, b` string, bin binary, `odd `` ) name` string")
    for packet in (80, 100000):
        st = insert_extended(df, "t", key=["id"], max_packet=packet, mode="exact")
        back = load_inserts(st, "t", df.schema)
        assert back.exceptAll(df).count() == 0 and df.exceptAll(back).count() == 0


def test_scripts_with_programs_and_raw_bytes(spark, tmp_out):
    import pytest

    from tablevault.operators.restore import load_scripts

    raw = b"\x00\xff\xfe'\\\n\x1a"
    quoted = raw.replace(b"\\", b"\\\\").replace(b"\0", b"\\0").replace(b"'", b"\\'").replace(b"\n", b"\\n").replace(b"\x1a", b"\\Z")
    os.makedirs(f"{tmp_out}/d")
    with gzip.open(f"{tmp_out}/d/x.sql.gz", "wb") as f:
        f.write(b"INSERT INTO `t` (`id`, `b`) VALUES (1,_binary '" + quoted + b"');INSERT INTO `t` (`id`, `b`) VALUES (2,NULL);"
                b"INSERT INTO `t` (`id`, `b`) VALUES (3,_binary 'plain');\nDELIMITER ;;\nCREATE TRIGGER g AFTER INSERT ON t FOR EACH ROW\n"
                b"INSERT INTO `t` (`id`, `b`) VALUES (99,'from trigger');;\nDELIMITER ;\n")
    schema = spark.createDataFrame([], "id int, b binary").schema
    got = {r.id: r.b and bytes(r.b) for r in load_scripts(read_scripts(spark, f"{tmp_out}/d"), {"t": schema})["t"].collect()}
    assert got == {1: raw, 2: None, 3: b"plain"}
    other = spark.createDataFrame([], "nope int").schema
    with pytest.raises(Exception, match="no known column"):
        load_scripts(read_scripts(spark, f"{tmp_out}/d"), {"t": other})["t"].collect()
