"""Temperature mixing of sources.

Source i, with a share p_i of all tokens, gets a weight proportional to p_i ** tau. The exponent is bisected so that the weights
meet a target entropy, or so that no source is repeated beyond a limit. The weights are realised by budgeted block permutations:
each pass over a source visits its blocks in an order of its own; the last pass takes blocks in that order as long as the source's
budget of tokens lasts, and documents of the block in which it ends.

Everything runs as DataFrame operations and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from . import common

STEPS = 60


def hashed(*parts: Column | str) -> Column:
    """A 60-bit number from the MD5 of the parts, which other SQL engines can compute as well."""
    text = F.concat_ws("|", *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def tokens(text: Column) -> Column:
    """Words between ASCII white space, at least one a document, so that empty ones have a weight too."""
    return F.greatest(F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(1)).cast("long")


def exponent(max_repetition: float | None, entropy: float | None, budget: float | None) -> str:
    """SQL for tau from t array<double>, the sources' tokens, and total. Bisects between 0 (uniform) and 1 (as they are)."""
    if entropy is not None:  # falls with tau: the largest tau whose weights have at least this entropy
        z = "aggregate(t, 0D, (a, x) -> a + pow(x / total, m))"
        plogp = f"aggregate(t, 0D, (a, x) -> a + pow(x / total, m) * (m * ln(x / total) - ln({z})))"
        holds, then, otherwise, end = f"-({plogp}) / {z} >= {entropy!r}D", "named_struct('lo', m, 'hi', s.hi)", "named_struct('lo', s.lo, 'hi', m)", "s.lo"
    else:  # the most repeated source is repeated less as tau grows: the smallest tau within the limit
        if budget is None:  # every source passes at least once
            most = "array_max(transform(t, x -> pow(x / total, m - 1))) / array_min(transform(t, x -> pow(x / total, m - 1)))"
        else:
            most = f"{float(budget)!r}D * array_max(transform(t, x -> pow(x / total, m) / x)) * total / aggregate(t, 0D, (a, x) -> a + pow(x / total, m))"
        holds, then, otherwise, end = f"{most} <= {max_repetition!r}D", "named_struct('lo', s.lo, 'hi', m)", "named_struct('lo', m, 'hi', s.hi)", "s.hi"
    # a one-element transform names the midpoint m
    step = f"element_at(transform(array((s.lo + s.hi) / 2), m -> IF({holds}, {then}, {otherwise})), 1)"
    return f"aggregate(sequence(1, {STEPS}), named_struct('lo', 0D, 'hi', 1D), (s, i) -> {step}, s -> {end})"


def plan(sources: DataFrame, max_repetition: float | None, entropy: float | None, budget: float | None) -> DataFrame:
    """From (src, n_docs, tokens): adds tau, weight, repetition, passes (whole ones) and rest (tokens of the last pass).

    budget is the wanted number of tokens as a multiple of all tokens; None takes the least number with which every source passes
    at least once, so that no document is lost.
    """
    row = sources.agg(F.sort_array(F.collect_list(F.struct("src", "n_docs", "tokens"))).alias("all"))  # a row a source
    row = row.where("size(all) > 0").selectExpr("all", "transform(all, x -> double(x.tokens)) AS t", "double(aggregate(all, 0L, (a, x) -> a + x.tokens)) AS total")
    row = row.selectExpr("*", f"{exponent(max_repetition, entropy, budget)} AS tau")
    row = row.selectExpr("*", "aggregate(t, 0D, (a, x) -> a + pow(x / total, tau)) AS z")
    wanted = f"{float(budget)!r}D * total" if budget is not None else "array_max(transform(t, x -> x / (pow(x / total, tau) / z)))"
    row = row.selectExpr("*", f"{wanted} AS wanted")
    each = row.selectExpr("inline(transform(all, x -> named_struct('src', x.src, 'n_docs', x.n_docs, 'tokens', x.tokens, 'tau', tau, 'weight', pow(x.tokens / total, tau) / z, 'repetition', wanted * pow(x.tokens / total, tau) / z / x.tokens)))")
    each = each.withColumn("passes", F.floor(F.col("repetition") + 1e-9).cast("int"))
    return each.withColumn("rest", F.greatest(F.floor((F.col("repetition") - F.col("passes")) * F.col("tokens") + 1e-6), F.lit(0)).cast("long")).withColumn("blocks", F.ceil(F.sqrt("n_docs")).cast("int"))


def mix(df: DataFrame, max_repetition: float | None = None, entropy: float | None = None, budget: float | None = 1.0, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each time that a document is taken: __rid, id_col, source_col, pass int, block int, block_pos int, tokens,
    tau, weight, repetition.

    A null source is a source of its own; null texts count one token, as empty ones do. Equal rows are told apart by __rid, which
    numbers the rows of df as common.with_rid does. A source's number of blocks is the root of its number of documents, so neither
    the order of blocks nor the block in which the budget ends grows beyond what a task can sort. Other columns aren't read.
    """
    if (max_repetition is None) == (entropy is None):
        raise ValueError("give either max_repetition or entropy")
    key = F.when(F.col(source_col).isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(source_col).cast("string")))
    rows = common.with_rid(df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), key.alias("src"), tokens(F.col(text_col)).alias("tokens")))
    rows = common.written(rows, "tokens")
    sources = common.written(plan(rows.groupBy("src").agg(F.count("*").alias("n_docs"), F.sum("tokens").alias("tokens")), max_repetition, entropy, budget), "sources")
    few = sources.count() <= common.BROADCAST_ROWS // 10
    by_source = sources.drop("tokens", "n_docs")
    rows = rows.join(F.broadcast(by_source) if few else by_source, "src").withColumn("block", F.pmod(hashed(F.lit(seed), "id"), F.col("blocks")).cast("int"))
    # the blocks of each pass in their order
    blocks = rows.groupBy("src", "block").agg(F.sum("tokens").alias("block_tokens"), F.first("passes").alias("passes"), F.first("rest").alias("rest"))
    blocks = blocks.withColumn("pass", F.explode(F.expr("sequence(0, IF(rest > 0, passes, passes - 1))"))).where("passes > 0 OR rest > 0")
    order = W.Window.partitionBy("src", "pass").orderBy(hashed(F.lit(seed + 1), "pass", "src", "block"), "block")
    blocks = blocks.withColumn("block_pos", F.row_number().over(order) - 1).withColumn("upto", F.sum("block_tokens").over(order.rowsBetween(W.Window.unboundedPreceding, 0)))
    blocks = blocks.withColumn("room", F.when(F.col("pass") < F.col("passes"), F.col("block_tokens")).otherwise(F.col("rest") - F.col("upto") + F.col("block_tokens")))
    blocks = common.written(blocks.where("room > 0").select("src", "block", "pass", "block_pos", "block_tokens", "room"), "blocks")
    small = blocks.count() <= common.BROADCAST_ROWS
    whole, cut = blocks.where("room >= block_tokens"), blocks.where("room < block_tokens")
    some = ["id", "source", "__rid", "src", "block", "pass", "block_pos", "tokens", "tau", "weight", "repetition"]
    taken = rows.join(F.broadcast(whole) if small else whole, ["src", "block"]).select(*some)
    # documents of the one block a source in which the budget ends
    inner = W.Window.partitionBy("src").orderBy(hashed(F.lit(seed + 2), "id"), "id", "tokens", "__rid").rowsBetween(W.Window.unboundedPreceding, 0)
    last = rows.join(F.broadcast(cut) if few else cut, ["src", "block"]).withColumn("upto", F.sum("tokens").over(inner)).where("upto <= room").select(*some)
    return taken.unionByName(last).select("__rid", F.col("id").alias(id_col), F.col("source").alias(source_col), "pass", "block", "block_pos", "tokens", "tau", "weight", "repetition")


def remix(df: DataFrame, **options) -> DataFrame:
    """The rows of df, with all their columns, each as often as mix takes it."""
    times = mix(df, **options).groupBy("__rid").agg(F.count("*").alias("__times"))
    rows = common.packed(df).join(times, "__rid")
    return rows.select("__row", F.explode(F.expr("sequence(1, int(__times))"))).select("__row.*")
