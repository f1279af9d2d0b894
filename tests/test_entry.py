import importlib


def test_entry_and_registry(spark):
    E = importlib.import_module("__spark_entry__")
    df = E.entry(spark)
    assert df.count() > 0
    assert set(df.columns) == {"chunk", "seq", "stmt", "n_rows", "n_bytes"}
    qs, oracles = E.queries(), E.oracle_sql()
    assert set(oracles) <= set(qs)
    assert len(qs) >= 25
    # every query of the dump library has an oracle, the whole script included
    trained = {k for k in qs if k == "pipeline" or k.startswith("op")}
    assert set(qs) - trained == set(oracles) - trained


def test_hot_identical_rows_keep_text(spark):
    from tablevault.operators.statements import insert_extended

    rows = [(1, "same")] * 300 + [(i, f"v{i}") for i in range(600)]
    df = spark.createDataFrame(rows, "id int, s string")
    out = insert_extended(df, "t", key=["id", "s"], max_packet=200,
                          num_partitions=6).orderBy("chunk", "seq").collect()
    assert sum(r.n_rows for r in out) == 900
    body = ",".join(r.stmt[len("INSERT INTO `t` (`id`, `s`) VALUES "):-1] for r in out)
    assert body.count("(1,'same')") == 300
