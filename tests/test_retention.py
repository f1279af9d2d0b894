import datetime as dt

import pytest
from pyspark.sql import functions as F

from tablevault.functions.names import backup_name, extension, name_time
from tablevault.operators.retention import (classify_names, prune, prune_by_age, prune_by_count,
                                            prune_report, retention_count, retention_hours,
                                            validate_policy)

NOW = dt.datetime(2021, 1, 1, 0, 30, 0)
HOURS_AGO = [0.25, 1, 2, 3, 24, 36, 48, 60, 72, 167, 168, 240, 336, 504, 576, 744, 720, 1000, 1440,
             1800, 2160, 8760, 12000, 17520]


def names(safe=False):
    out = []
    for h in HOURS_AGO:
        t = NOW - dt.timedelta(hours=h) - dt.timedelta(minutes=30)
        fmt = "%Y-%m-%dT%H-%M-%S" if safe else "%Y-%m-%dT%H:%M:%S"
        out.append(f"db_backup_{t.strftime(fmt)}Z.gz")
    return out


def test_retention_parse(spark):
    cases = [("2h", 2, None), ("3w", 504, None), ("5d", 120, None), ("1m", 720, None),
             ("1y", 8760, None), ("100x", None, None), ("2c", None, 2), ("0h", 0, None)]
    df = spark.createDataFrame([(c[0],) for c in cases], "r string")
    got = {r.r: (r.h, r.c) for r in df.select("r", retention_hours("r").alias("h"),
                                                retention_count("r").alias("c")).collect()}
    for text, h, c in cases:
        assert got[text] == (h, c)


@pytest.mark.parametrize("bad", ["100x", "0h", "0c"])
def test_invalid_policy_fails(spark, bad):
    pol = spark.createDataFrame([("t", bad)], "target string, retention string")
    with pytest.raises(Exception, match="invalid retention string"):
        validate_policy(pol).collect()


@pytest.mark.parametrize("safe", [False, True])
@pytest.mark.parametrize("retention,kept", [("1h", 1), ("2h", 2), ("2d", 6), ("3w", 13), ("2c", 2)])
def test_prune_cases(spark, safe, retention, kept):
    files = names(safe)
    listing = spark.createDataFrame([("t", f) for f in files], "target string, filename string")
    pol = spark.createDataFrame([("t", retention)], "target string, retention string")
    cands = {r.filename for r in prune(listing, pol, NOW).collect()}
    after = sorted(set(files) - cands)
    assert after == sorted(files[:kept])


def test_prune_report(spark):
    files = names() + ["notes.txt", "db_backup_2020-13-01T00:00:00Z.gz"]
    listing = spark.createDataFrame([("t", f) for f in files], "target string, filename string")
    pol = spark.createDataFrame([("t", "2d")], "target string, retention string")
    rep = prune_report(listing, prune(listing, pol, NOW)).first()
    assert (rep.n_files, rep.n_matched, rep.n_ignored, rep.n_invalid_date, rep.n_pruned, rep.n_kept) == \
        (26, 24, 1, 1, 18, 6)


def test_name_edge_cases(spark):
    rows = [
        ("db_backup_2021-01-01T00:00:00Z.gz", "2021-01-01 00:00:00"),
        ("db_backup_2021-01-01T02:00:00+02:00.gz", "2021-01-01 02:00:00"),   # zone ignored
        ("db_backup_2021-13-01T00:00:00Z.gz", None),                           # month 13
        ("db_backup_2021-02-30T00:00:00Z.gz", None),                           # 30 February
        ("backup-2021.gz", None),                                              # custom name
        ("s3/bucket/dir/db_backup_2021-01-01T00-00-00Z.tgz", "2021-01-01 00:00:00"),  # path
    ]
    df = spark.createDataFrame([(r[0],) for r in rows], "filename string")
    got = [None if r.t is None else str(r.t) for r in df.select(name_time("filename").alias("t")).collect()]
    assert got == [r[1] for r in rows]
    zoned = df.select(name_time("filename", zone_aware=True).alias("t")).collect()[1].t
    assert str(zoned) == "2021-01-01 00:00:00"
    st = {r.filename: r.status for r in classify_names(df).collect()}
    assert st["backup-2021.gz"] == "ignored"
    assert st["db_backup_2021-13-01T00:00:00Z.gz"] == "invalid_date"


def test_age_boundary_and_future(spark):
    listing = spark.createDataFrame(
        [("t", "db_backup_2020-12-31T00:30:00Z.gz"),   # exactly 24h old: pruned
         ("t", "db_backup_2020-12-31T00:30:01Z.gz"),   # a second younger: kept
         ("t", "db_backup_2021-02-01T00:00:00Z.gz")],  # future: kept
        "target string, filename string")
    got = [r.filename for r in prune_by_age(classify_names(listing), 24, NOW).collect()]
    assert got == ["db_backup_2020-12-31T00:30:00Z.gz"]


def test_count_ties_and_hot_target(spark):
    # one hot target with many files, equal times broken by name
    rows = [("hot", f"db_backup_2021-01-01T00:00:{i % 60:02d}Z.{'gz' if i < 60 else 'tgz'}") for i in range(120)]
    rows += [("cold", "db_backup_2021-01-01T00:00:00Z.gz")]
    listing = spark.createDataFrame(rows, "target string, filename string")
    c = classify_names(listing)
    cands = prune_by_count(c, 3, salts=4).collect()
    kept = set(r[1] for r in rows) - {r.filename for r in cands if r.target == "hot"}
    assert len([r for r in cands if r.target == "hot"]) == 117
    assert kept == {"db_backup_2021-01-01T00:00:59Z.tgz", "db_backup_2021-01-01T00:00:59Z.gz",
                    "db_backup_2021-01-01T00:00:58Z.tgz"}
    assert not [r for r in cands if r.target == "cold"]


def test_backup_name_patterns(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 2, 3, 4, 5),)], "ts timestamp_ntz")
    r = df.select(backup_name("ts", extension(F.lit("gzip"))).alias("a"),
                  backup_name("ts", "tbz2", safe=True).alias("b"),
                  backup_name("ts", "tar", pattern="{{.year}}{{ .month }}/{{ .day }}-{{ .Sequence }}").alias("c"),
                  backup_name("ts", "tgz", pattern="").alias("d")).first()
    assert r.a == "db_backup_2024-01-02T03:04:05Z.tgz"
    assert r.b == "db_backup_2024-01-02T03-04-05Z.tbz2"
    assert r.c == "202401/02-<no value>"
    assert r.d == r.a


def test_unknown_compression_fails(spark):
    df = spark.createDataFrame([("zstd",)], "c string")
    with pytest.raises(Exception, match="unknown compression"):
        df.select(extension("c")).collect()
