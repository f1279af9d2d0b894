"""Balanced shards by label propagation over equal texts.

Documents with equal texts are linked. Every linked document starts in a shard; in each round a document
looks at its neighbours' shards, joined through the text they share, and wants to go where most of them
are. A shard accepts moves up to its free room plus what leaves it, so sizes stay within their quotas.
Documents without links fill what is left. The law is ``rows``: shard counts differ by one at most.

All rows carried are an id, a digest and a few numbers. A text shared by a third of all rows is one row of
16 counts, and ranks inside it are counted in two steps, so no task holds a whole group.

Defined results: a null text is empty (size 1, crc32 0) and equals other empty texts; repeated rows are
separate rows; ties go by the digest; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablevault.llm.common import cut, numbered, text_of

ROUNDS = 3



def _propagate(state: DataFrame, capacity: list[int], shards: int, round_no: int) -> DataFrame:
    """One round over (group, n): n[s] members are in shard s. Returns the state after the accepted moves."""
    # the shard with most neighbours; ties by a hash, so that equal choices do not all meet in one shard
    best = F.array_max(F.transform("n", lambda x, s: F.struct(
        x.alias("n"), F.xxhash64("group", s).alias("h"), s.alias("s"))))
    state = state.withColumn("to", best["s"])
    size = F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)
    state = state.withColumn("size", size).withColumn("moving", F.col("size") - F.col("n")[F.col("to")])
    # per shard: members now, members that want to come, members that want to leave (16 rows)
    flows = state.agg(*[f for s in range(shards) for f in (
        F.sum(F.col("n")[s]).alias(f"now{s}"),
        F.sum(F.when(F.col("to") == s, F.col("moving")).otherwise(0)).alias(f"in{s}"),
        F.sum(F.when(F.col("to") == s, 0).otherwise(F.col("n")[s])).alias(f"out{s}"))]).first()
    now, come, leave = ([int(flows[f"{k}{s}"] or 0) for s in range(shards)] for k in ("now", "in", "out"))
    # what leaves counts at the rate at which the other shards accept; a few steps settle the rates
    rate = [1.0] * shards
    for _ in range(20):
        mean = sum(r * c for r, c in zip(rate, come, strict=True)) / max(1, sum(come))
        rate = [min(1.0, max(0.0, capacity[s] - now[s] + mean * leave[s]) / come[s]) if come[s] else 1.0
                for s in range(shards)]
    accept = F.array(*[F.lit(r) for r in rate])[F.col("to")]
    # a group goes as a whole or stays, but a large one sends the share that has room
    whole = F.pmod(F.xxhash64("group", F.lit(round_no)), F.lit(1_000_003)) < accept * 1_000_003
    share = F.when(F.col("size") * 8 > max(1, min(capacity)), accept).otherwise(whole.cast("double"))
    state = state.withColumn("share", share)
    goes = F.transform("n", lambda x, s: F.when(s == F.col("to"), F.lit(0).cast("long"))
                       .otherwise(F.floor(x * F.col("share")).cast("long")))
    state = state.withColumn("goes", goes)
    state = state.withColumn("gone", F.aggregate("goes", F.lit(0).cast("long"), lambda a, x: a + x))
    after = F.transform("n", lambda x, s: x - F.col("goes")[s] + F.when(s == F.col("to"), F.col("gone")).otherwise(0))
    return state.select("group", after.alias("n"))


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16,
          rounds: int = ROUNDS) -> DataFrame:
    """Per row: its id, size, crc32 of its text, law, shard and slot in the shard."""
    data = text_of(text_col).cast("binary")
    rows = cut(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text_col) + 1).alias("bytes"), F.crc32(data).alias("crc"),
        F.unhex(F.md5(data)).alias("group")).withColumn("rid", F.monotonically_increasing_id()))
    rows = rows.withColumn("part", F.shiftright("rid", 33))
    total = rows.count()
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    # cut, so that both sides of the join are plain exchanges and a hot group's side can be split
    groups = cut(rows.groupBy("group").agg(F.count("*").alias("members")).filter("members > 1").select("group"))
    linked = cut(rows.select("group", "rid", "part").join(groups, "group"))
    state = (numbered(linked, [], "rank", "part").withColumn("s", F.pmod("rank", F.lit(shards)))
             .groupBy("group").agg(F.array(*[F.sum((F.col("s") == i).cast("long")) for i in range(shards)]).alias("n")))
    for i in range(rounds):
        state = cut(_propagate(cut(state) if i == 0 else state, capacity, shards, i))
    # members take their group's places in the order of their rank in the group
    ends = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda k: F.aggregate(
        F.slice("n", F.lit(1), k), F.lit(0).cast("long"), lambda a, x: a + x))
    placed = numbered(linked, ["group"], "rank", "part").join(state.select("group", ends.alias("ends")), "group")
    placed = placed.select("rid", "part", F.size(F.filter("ends", lambda e: e <= F.col("rank"))).alias("shard"))
    # rounds accept by rate, not by count: what is over a quota is free to go elsewhere
    room = F.array(*[F.lit(c) for c in capacity])
    placed = cut(numbered(placed, ["shard"], "rank", "part").filter(F.col("rank") < room[F.col("shard")])
                 .select("rid", "shard"))
    held = {r["shard"]: r["n"] for r in placed.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    free_ends, end = [], 0
    for s in range(shards):
        end += capacity[s] - held.get(s, 0)
        free_ends.append(end)
    all_rows = cut(rows.join(placed, "rid", "left"))
    free = numbered(all_rows.filter(F.col("shard").isNull()).select("rid", "part"), [], "rank", "part")
    filled = free.select("rid", F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in free_ends]),
                                                lambda e: e <= F.col("rank"))).alias("filled"))
    done = all_rows.join(filled, "rid", "left").withColumn("shard", F.coalesce("shard", "filled")).drop("filled")
    done = numbered(cut(done), ["shard"], "slot", "part")
    return done.select("doc_id", F.coalesce("bytes", F.lit(1)).cast("long").alias("size"),
                       F.col("crc").cast("long").alias("text_crc32"), F.lit("rows").alias("law"),
                       F.col("shard").cast("int"), F.col("slot").cast("long"),
                       F.lit(None).cast("int").alias("grown_shard"))
