"""Continuous mining: supports of a pattern expression over sequences that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import kernel, native
from ..operators.dictionary import Dictionary
from ..plans.compiled import compile_


def supports(stream: DataFrame, dictionary: Dictionary, pattern: str, min_support: int) -> DataFrame:
    """Patterns (gids as a string) with their support so far, of a stream of (items array<int>, weight); for output mode complete or
    update. All state is one counter a pattern, kept by Spark's own aggregation."""
    c = compile_(pattern, dictionary)
    made = native.generate(stream, c, None)
    if made is None:
        made = kernel.generate(stream, c, None)
    return made.groupBy("pattern").agg(F.sum("weight").alias("support")).where(F.col("support") >= min_support)


def start(found: DataFrame, name: str, checkpoint: str, mode: str = "complete", available_now: bool = False) -> StreamingQuery:
    """Runs into an in-memory table, for small results and tests; with available_now it ends when all that is there has been read."""
    out = found.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()
