"""Retention over backup listings: classify names, parse policies, choose what to prune.

One job covers every target: the listing is joined to its target's policy and each file is
judged by the age rule or the count rule in the same plan. The count rule ("keep the N newest per
target") is a top-N per target done in two stages so a target holding a third of all files never
lands in one task: a salted window keeps the N newest of every (target, salt) slice, then a second
window over those survivors (at most ``salts * N`` rows per target) keeps the N newest overall.
Every other file of that target is a candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablevault.functions.names import BACKUP_NAME_RE, base_name, name_time_of_base
from tablevault.operators.common import broadcast_if_small

MATCHED = "matched"
IGNORED = "ignored"
INVALID_DATE = "invalid_date"

# Hours per retention unit (a month is 30 days, a year 365 days).
UNIT_HOURS = {"h": 1, "d": 24, "w": 24 * 7, "m": 24 * 30, "y": 24 * 365}

HOURS_RE = r"^(\d+)([hdwmy])$"
COUNT_RE = r"^(\d+)c$"

DEFAULT_SALTS = 32


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def retention_hours(retention) -> Column:
    """``<int>`` + h/d/w/m/y -> hours (long); null when the text does not match."""
    r = _col(retention)
    n = F.regexp_extract(r, HOURS_RE, 1).try_cast("long")
    unit = F.regexp_extract(r, HOURS_RE, 2)
    per = F.element_at(F.create_map(*[x for k, v in UNIT_HOURS.items()
                                      for x in (F.lit(k), F.lit(v).cast("long"))]), unit)
    return F.when(r.rlike(HOURS_RE), n * per)


def retention_count(retention) -> Column:
    """``<int>c`` -> count (long); null when the text does not match."""
    r = _col(retention)
    return F.when(r.rlike(COUNT_RE), F.regexp_extract(r, COUNT_RE, 1).try_cast("long"))


def validate_policy(policies: DataFrame, retention: str = "retention") -> DataFrame:
    """Add ``hours`` and ``count``; a policy where both fail or both are <= 0 fails the job."""
    h, c = retention_hours(retention), retention_count(retention)
    out = policies.withColumn("hours", h).withColumn("count", c)
    bad = (F.col("hours").isNull() & F.col("count").isNull()) | (
        (F.coalesce(F.col("hours"), F.lit(0)) <= 0) & (F.coalesce(F.col("count"), F.lit(0)) <= 0))
    msg = F.concat(F.lit("invalid retention string: "), F.coalesce(F.col(retention), F.lit("")))
    return out.withColumn("hours", F.when(bad, F.raise_error(msg).cast("long"))
                          .otherwise(F.col("hours")))


def classify_names(listing: DataFrame, filename: str = "filename", zone_aware: bool = False) -> DataFrame:
    """F4 + N4: add ``filetime`` and ``status`` (matched / ignored / invalid_date)."""
    with_base = listing.withColumn("_base", base_name(filename)).withColumn(
        "_match", F.col("_base").rlike(BACKUP_NAME_RE))
    t = F.when(F.col("_match"), name_time_of_base(F.col("_base"), zone_aware))
    return (with_base.withColumn("filetime", t)
            .withColumn("status", F.when(~F.col("_match"), F.lit(IGNORED))
                        .when(F.col("filetime").isNull(), F.lit(INVALID_DATE))
                        .otherwise(F.lit(MATCHED)))
            .drop("_base", "_match"))


def _age_micros(filetime: Column, now) -> Column:
    now_c = now if isinstance(now, Column) else F.lit(now).cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", filetime, now_c)


def prune_by_age(classified: DataFrame, hours, now) -> DataFrame:
    """Matched files at least ``hours`` old at ``now`` (the exact boundary is pruned)."""
    h = hours if isinstance(hours, Column) else F.lit(hours)
    limit = h.cast("long") * F.lit(3600 * 1000000)
    # filetime is non-null exactly for matched names, and a null age fails the test; filtering
    # on filetime alone (not on status) keeps the predicate Catalyst pushes to the scan small
    return classified.where(_age_micros(F.col("filetime"), now) >= limit)


def _ranked(classified: DataFrame, n, target: str, salts: int) -> tuple[DataFrame, DataFrame]:
    """Two-stage ranking of matched files, newest first (by time, then by name).

    Returns ``(stage1, stage2)``: stage 1 ranks every file inside its (target, salt) slice, so a
    hot target is spread over ``salts`` tasks; stage 2 ranks the stage-1 survivors (at most
    ``salts * n`` rows per target) over the whole target. The global ``n`` newest are exactly the
    stage-2 rows ranked ``<= n``: each of them is within the ``n`` newest of its own slice.
    """
    keep_n = n if isinstance(n, Column) else F.lit(n)
    order = [F.col("filetime").desc(), F.col("filename").desc()]
    # matched <=> filetime is not null (see prune_by_age)
    m = classified.where(F.col("filetime").isNotNull()).withColumn("_keep_n", keep_n)
    salt = F.abs(F.xxhash64("filename")) % F.lit(salts)
    stage1 = (m.withColumn("_salt", salt)
              .withColumn("_r1", F.row_number().over(Window.partitionBy(target, "_salt").orderBy(*order))))
    stage2 = (stage1.where(F.col("_r1") <= F.col("_keep_n"))
              .withColumn("_r2", F.row_number().over(Window.partitionBy(target).orderBy(*order))))
    return stage1, stage2


def keep_newest(classified: DataFrame, n, target: str = "target", salts: int = DEFAULT_SALTS) -> DataFrame:
    """The ``n`` newest matched files per target (newest first by time, then by name)."""
    _, stage2 = _ranked(classified, n, target, salts)
    return stage2.where(F.col("_r2") <= F.col("_keep_n")).drop("_salt", "_r1", "_r2", "_keep_n")


def prune_by_count(classified: DataFrame, n, target: str = "target", salts: int = DEFAULT_SALTS) -> DataFrame:
    """P5: every matched file of a target except its ``n`` newest.

    A file with ``n`` newer files in its own salt slice is a candidate after stage 1; the
    survivors are decided by stage 2. No join back to the listing is needed.
    """
    stage1, stage2 = _ranked(classified, n, target, salts)
    cols = classified.columns
    beaten_in_slice = stage1.where(F.col("_r1") > F.col("_keep_n")).select(*cols)
    beaten_overall = stage2.where(F.col("_r2") > F.col("_keep_n")).select(*cols)
    return beaten_in_slice.unionByName(beaten_overall)


def prune(listing: DataFrame, policies: DataFrame, now, target: str = "target",
          salts: int = DEFAULT_SALTS) -> DataFrame:
    """Candidates over many targets; each target's policy picks the age or the count rule.

    ``listing``: (target, filename, ...); ``policies``: (target, retention). Returns the
    candidates with ``rule`` ('age' or 'count'). Targets without a policy are left alone; no policy at all is an error.
    """
    require_targets(policies)
    pol = validate_policy(policies).select(target, "hours", "count")
    pol = broadcast_if_small(pol)
    classified = classify_names(listing).join(pol, target)
    by_age = (prune_by_age(classified.where(F.col("hours") > 0), F.col("hours"), now)
              .withColumn("rule", F.lit("age")))
    counted = classified.where(~(F.coalesce(F.col("hours"), F.lit(0)) > 0) & (F.col("count") > 0))
    by_count = (prune_by_count(counted, F.col("count"), target, salts)
                .withColumn("rule", F.lit("count")))
    cols = listing.columns + ["filetime", "rule"]
    return by_age.select(*cols).unionByName(by_count.select(*cols))


def prune_report(listing: DataFrame, candidates: DataFrame, target: str = "target") -> DataFrame:
    """Per target: files, matched, ignored, invalid dates, candidates, kept."""
    classified = classify_names(listing)
    per_status = classified.groupBy(target).agg(
        F.count(F.lit(1)).alias("n_files"),
        F.count_if(F.col("status") == MATCHED).alias("n_matched"),
        F.count_if(F.col("status") == IGNORED).alias("n_ignored"),
        F.count_if(F.col("status") == INVALID_DATE).alias("n_invalid_date"),
    )
    pruned = candidates.groupBy(target).agg(F.count(F.lit(1)).alias("n_pruned"))
    return (per_status.join(pruned, target, "left")
            .withColumn("n_pruned", F.coalesce(F.col("n_pruned"), F.lit(0).cast("long")))
            .withColumn("n_kept", F.col("n_matched") - F.col("n_pruned")))


def require_targets(targets: DataFrame) -> None:
    """The reference refuses to prune with no targets at all."""
    if targets.isEmpty():
        raise ValueError("no targets")
