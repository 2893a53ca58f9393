"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def connected(edges: DataFrame) -> DataFrame:
    """(node long, comp long): the smallest node that each node of (u long, v long) reaches. Nodes without edges don't appear.

    Each round points every node's larger neighbours, then its smaller ones, at the smallest node that it knows; the rounds, of which
    there are logarithmically many, end when nothing changes. Every round is written to the shared folder.
    """
    now = common.written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if not state["n"] or state == before:
            break
        before, n = state, state["n"]
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k")).withColumn("m", F.least("m", "u"))
        large = common.join_counted(both, common.written(least, "least"), ["u"], "k", 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = common.written(large.distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k"))
        small = common.join_counted(large, common.written(least, "least"), ["u"], "k", n)
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        now = common.written(small.distinct(), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
