import datetime as dt
import decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablevault.functions.literals import (EXACT, escape_sql, lit_sql, quote_ident, row_tuple,
                                           unescape_sql)


def one(spark, col, data, schema):
    return spark.createDataFrame(data, schema).select(col.alias("x")).collect()


def test_escape_all_eight_and_untouched(spark):
    raw = "a\x00b'c\"d\be\nf\rg\x1ah\\i\tj%k_l"
    got = spark.createDataFrame([(raw,)], "s string").select(escape_sql("s").alias("x")).first().x
    assert got == "a\\0b\\'c\\\"d\\be\\nf\\rg\\Zh\\\\i\tj%k_l"


def test_escape_backslash_then_quote_is_one_pass(spark):
    got = spark.createDataFrame([("\\'",)], "s string").select(escape_sql("s").alias("x")).first().x
    assert got == "\\\\\\'"


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab'\"\\\n\r\t\b\x00\x1a%_nZ0")), max_size=30))
def test_unescape_inverts_escape(spark, s):
    got = spark.createDataFrame([(s,)], "s string").select(unescape_sql(escape_sql("s")).alias("x")).first().x
    assert got == s


def test_null_of_every_type(spark):
    schema = T.StructType([
        T.StructField("i", T.IntegerType()), T.StructField("l", T.LongType()),
        T.StructField("d", T.DoubleType()), T.StructField("s", T.StringType()),
        T.StructField("b", T.BooleanType()), T.StructField("dt", T.DateType()),
        T.StructField("ts", T.TimestampType()), T.StructField("ntz", T.TimestampNTZType()),
        T.StructField("bin", T.BinaryType()), T.StructField("dec", T.DecimalType(10, 2)),
        T.StructField("arr", T.ArrayType(T.FloatType())),
    ])
    df = spark.createDataFrame([tuple([None] * len(schema.fields))], schema)
    got = df.select(row_tuple(df).alias("t")).first().t
    assert got == "(" + ",".join(["NULL"] * len(schema.fields)) + ")"


def test_values_compat(spark):
    schema = ("i int, d double, s string, b boolean, dt date, ts timestamp_ntz, bin binary, "
              "dec decimal(10,2), e string, arr array<int>")
    row = (7, 1.5, "O'Neil", True, dt.date(2012, 11, 1), dt.datetime(2012, 11, 1, 0, 15, 0, 999999),
           bytearray(b"\x01\xff"), decimal.Decimal("12.34"), "", [1, 2])
    df = spark.createDataFrame([row], schema)
    got = df.select(row_tuple(df).alias("t")).first().t
    assert got == ("(7,1.500000,'O\\'Neil',1,'2012-11-01','2012-11-01 00:15:00',X'01FF','12.34','',"
                   "'[1,2]')")


def test_values_exact(spark):
    df = spark.createDataFrame([(1e-9, dt.datetime(2012, 11, 1, 0, 15, 0, 5), bytearray(b""))],
                               "d double, ts timestamp_ntz, bin binary")
    got = df.select(row_tuple(df, mode=EXACT).alias("t")).first().t
    assert got == "(1.0E-9,'2012-11-01 00:15:00.000005',X'')"


def test_empty_binary_is_null_in_compat(spark):
    df = spark.createDataFrame([(bytearray(b""),)], "bin binary")
    assert df.select(row_tuple(df).alias("t")).first().t == "(NULL)"


def test_float_six_decimals(spark):
    df = spark.createDataFrame([(1e-9,), (123456789.125,), (-0.5,)], "d double")
    got = [r.x for r in df.select(lit_sql("d", T.DoubleType()).alias("x")).collect()]
    assert got == ["0.000000", "123456789.125000", "-0.500000"]


def test_quote_ident_doubles_backticks():
    assert quote_ident("we`ird") == "`we``ird`"


def test_unsupported_type_raises(spark):
    import pytest

    with pytest.raises(TypeError):
        lit_sql(F.lit(1), T.DayTimeIntervalType())
