"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

How many rows each source partition sends to each shard is drawn first, from the exact law: the counts of a uniformly random
assignment with the given shard sizes follow a multivariate hypergeometric law, drawn here partition by partition from what room
the shards have left. Then each partition permutes its rows and deals them out by these counts, and each shard permutes what
it received. Rows only go through DataFrame operations; the driver holds just the matrix (partitions x shards).
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from . import common

#: Rows of a shard that are numbered in one task.
NUMBERED_ROWS = 500_000


def hypergeometric(rnd: random.Random, good: int, bad: int, draws: int) -> int:
    """How many good ones are among so many draws without replacement: inversion from the mode, outwards."""
    if not good or not draws:
        return 0
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(max((draws + 1) * (good + 1) // (good + bad + 2), low), high)
    lg = math.lgamma
    log_p = lg(good + 1) - lg(mode + 1) - lg(good - mode + 1) + lg(bad + 1) - lg(draws - mode + 1) - lg(bad - draws + mode + 1) - lg(good + bad + 1) + lg(draws + 1) + lg(good + bad - draws + 1)
    u, up, down = rnd.random(), mode, mode
    p_up = p_down = math.exp(log_p)
    u -= p_up
    while u > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
    return mode  # the rounding errors of the sum


def matrix(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """For each partition how many rows go to each shard; shard sizes are at most one apart."""
    rnd, total = random.Random(seed), sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    out = []
    for n in counts:
        left, others, row = n, sum(room), []
        for s in range(shards):
            others -= room[s]
            x = hypergeometric(rnd, room[s], others, left)
            row.append(x)
            left -= x
        room = [r - x for r, x in zip(room, row)]
        out.append(row)
    return out


def assign(rows: DataFrame, shards: int, seed: int = 7) -> DataFrame:
    """Adds shard int and slot long (0, 1, ... in each shard) to a written table with a column __rid from common.with_rid.

    Every assignment of rows to (shard, slot) is as likely as any other; shard sizes are at most one apart (so some shards
    are empty where there are fewer rows than shards). Neither nulls nor equal rows matter: only __rid does. An empty table stays empty.
    """
    spark = rows.sparkSession
    part = F.shiftright("__rid", 33)
    rows = rows.withColumn("__part", part)
    counts = sorted(rows.groupBy("__part").count().collect())  # one row a source partition
    dealt, total = [], sum(r["count"] for r in counts)
    for r, row in zip(counts, matrix([r["count"] for r in counts], shards, seed)):
        at, bounds = 0, []
        for x in row:
            at += x
            bounds.append(at)
        dealt.append((r["__part"], bounds))
    deal = spark.createDataFrame(dealt, "__part long, __bounds array<long>")
    deal = F.broadcast(deal) if len(dealt) * shards <= common.BROADCAST_ROWS * 4 else deal
    local = W.Window.partitionBy("__part").orderBy(F.xxhash64(F.lit(seed), "__rid"), "__rid")
    rank = F.row_number().over(local).cast("long") - 1
    # the exchange: sub cuts each shard into pieces that a task can number
    pieces = max(1, math.ceil(total / shards / NUMBERED_ROWS))
    key = F.xxhash64(F.lit(seed + 1), "__rid")
    sent = rows.withColumn("__rank", rank).join(deal, "__part").withColumn("shard", F.expr("size(filter(__bounds, b -> b <= __rank))"))
    sent = common.written(sent.withColumn("__key", key).withColumn("__sub", F.pmod(key, F.lit(pieces)).cast("int")).drop("__part", "__rank", "__bounds"), "sent")
    sizes = sent.groupBy("shard", "__sub").agg(F.count("*").alias("__n"))
    before = W.Window.partitionBy("shard").orderBy("__sub").rowsBetween(W.Window.unboundedPreceding, -1)
    bases = sizes.select("shard", "__sub", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    bases = F.broadcast(bases) if shards * pieces <= common.BROADCAST_ROWS else bases
    numbered = sent.withColumn("__at", F.row_number().over(W.Window.partitionBy("shard", "__sub").orderBy("__key", "__rid")))
    return numbered.join(bases, ["shard", "__sub"]).withColumn("slot", F.col("__base") + F.col("__at") - 1).drop("__sub", "__key", "__at", "__base")


def digest(df: DataFrame, shards: int = 24, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard): where each row goes, and what it weighs."""
    text = F.col(text_col).cast("string")
    rows = common.with_rid(df.select(F.col(id_col).alias("__id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32")))
    out = assign(common.written(rows, "rows"), shards, seed)
    return out.select(F.col("__id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shuffle(df: DataFrame, shards: int, seed: int = 7) -> DataFrame:
    """df with shard and slot added (columns of these names are replaced); df must be read from files, whose rows keep their order."""
    rows = common.packed(df.drop("shard", "slot"))
    places = assign(common.written(rows.select("__rid"), "rows"), shards, seed)
    return rows.join(places, "__rid").select("__row.*", "shard", "slot")


def write(df: DataFrame, path: str, shards: int, seed: int = 7) -> None:
    """Writes path/shard=k/*.parquet, each file in the order of slots; a shard of many rows takes several files, in slot order."""
    out = shuffle(df, shards, seed).withColumn("__piece", F.floor(F.col("slot") / NUMBERED_ROWS))
    out.repartition("shard", "__piece").sortWithinPartitions("shard", "slot").drop("__piece").write.partitionBy("shard").parquet(path)
