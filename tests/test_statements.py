from pyspark.sql import functions as F

from tablevault.functions.literals import row_tuple
from tablevault.operators.statements import insert_extended, insert_prefix, insert_single

SF = "/root/testdata/sf0.001"


def test_prefix_format():
    assert insert_prefix("t1", ["id", "name"]) == "INSERT INTO `t1` (`id`, `name`) VALUES "


def test_insert_single(spark):
    df = spark.createDataFrame([(1, "John"), (2, None)], "id int, name string")
    got = sorted(r.stmt for r in insert_single(df, "t1").collect())
    assert got == ["INSERT INTO `t1` (`id`, `name`) VALUES (1,'John');",
                   "INSERT INTO `t1` (`id`, `name`) VALUES (2,NULL);"]


def _check_packing(spark, df, key, max_packet, parts, fan=32):
    prefix = insert_prefix("orders", df.columns)
    out = insert_extended(df, "orders", key=key, max_packet=max_packet,
                          num_partitions=parts, fan=fan).orderBy("chunk", "seq").collect()
    tuples = [r.t for r in df.select(row_tuple(df).alias("t"), *key).orderBy(*key).collect()]
    joined = []
    for r in out:
        assert r.stmt.startswith(prefix) and r.stmt.endswith(";")
        assert r.n_bytes == len(r.stmt.encode())
        if r.n_rows > 1:
            assert r.n_bytes <= max_packet + 1
        joined.append(r.stmt[len(prefix):-1])
    assert ",".join(joined) == ",".join(tuples)
    assert sum(r.n_rows for r in out) == len(tuples)
    return [(r.chunk, r.seq, r.stmt) for r in out]


def test_extended_bound_and_order(spark):
    df = spark.read.parquet(f"{SF}/orders.parquet")
    a = _check_packing(spark, df, ["o_orderkey"], 4096, 3)
    b = _check_packing(spark, df, ["o_orderkey"], 4096, 64, fan=3)
    # the same table gives the same statements whatever the partition count
    assert a == b


def test_oversize_row_gets_own_statement(spark):
    df = spark.createDataFrame([(1, "x" * 500), (2, "y"), (3, "z" * 500)], "id int, s string")
    out = insert_extended(df, "t", key=["id"], max_packet=100).orderBy("chunk", "seq").collect()
    assert [r.n_rows for r in out] == [1, 1, 1]


def test_default_packet_packs_everything_small(spark):
    df = spark.read.parquet(f"{SF}/region.parquet")
    out = insert_extended(df, "region", key=["r_regionkey"]).collect()
    assert len(out) == 1 and out[0].n_rows == 5
    assert out[0].stmt.count("),(") == 4


def _greedy(tuples, prefix, max_packet):
    """One plain pass over the whole table."""
    out, used = [], 0
    for t in tuples:
        size = len(t.encode())
        if out and used + size <= max_packet - 1:
            out[-1].append(t)
            used += 1 + size
        else:
            out.append([t])
            used = len(prefix.encode()) + size
    return [prefix + ",".join(x) + ";" for x in out]


def test_packing_is_one_pass_whatever_the_partitions(spark):
    import random

    r = random.Random(4)
    # sizes lumped together, rows over the limit, rows of one byte
    rows = [(i, "x" * (r.randint(300, 900) if 400 < i < 460 else r.choice([0, 1, 5, 40, 130]))) for i in range(900)]
    df = spark.createDataFrame(rows, "id int, s string").repartition(9)
    prefix = insert_prefix("t", ["id", "s"])
    tuples = [f"({i},'{s}')" for i, s in rows]
    for max_packet in (60, 200, 700, 100_000):
        want = _greedy(tuples, prefix, max_packet)
        for parts, fan in ((1, 32), (7, 2), (64, 3)):
            got = insert_extended(df, "t", key=["id"], max_packet=max_packet, num_partitions=parts, fan=fan).collect()
            assert [x.stmt for x in sorted(got, key=lambda x: x.seq)] == want
            assert sorted(x.seq for x in got) == list(range(len(want)))
            assert all(x.n_bytes == len(x.stmt.encode()) for x in got)
    assert insert_extended(df.limit(0), "t", key=["id"]).count() == 0


def test_rows_without_a_key_keep_their_statements(spark):
    df = spark.createDataFrame([(i % 5, "text " * (i % 5), None) for i in range(200)], "a int, s string, n int")
    a, b = ([x.stmt for x in insert_extended(df.repartition(n), "t", max_packet=300, num_partitions=n).orderBy("seq").collect()]
            for n in (2, 6))
    assert a == b and sum(x.count("),(") + 1 for x in a) == 200


def test_floats_round_the_exact_binary_value(spark):
    import random

    from tablevault.functions.literals import lit_float

    r = random.Random(1)
    values = [0.0078125, 0.1234565, -0.0, 0.0, 0.9999995, 0.99999949, 2.5e-7, 5e-7, 1.5e-6, -1e-9, 123456789.123456789, 4.5e9 + 2**-20,
              9.2e12 + 0.001953125, 0.5, 1e15 + 0.125, 2**52 + 0.5, 1e22, -7.0000005] + [r.uniform(-1, 1) * 10 ** r.randint(-8, 12) for _ in range(3000)]
    values += [(2 * k + 1) / 2**n for n in range(1, 21) for k in range(40)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [x[0] for x in df.select(lit_float("x")).collect()] == ["%f" % v for v in values]
