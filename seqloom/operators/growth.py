"""Level-wise growth: patterns are extended an item at a time, and only frequent prefixes go on.

Suits expressions whose sequences have very many outputs at a high support. What each sequence's run may write next from a state at a
position is tabulated once, in a row for each sequence; then each level is one pass over these tables, which extends patterns to its
length by the frequent prefixes of the levels before. Only supports, summed for pieces of the data, leave a pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.compiled import Compiled
from ..session import small, written
from . import chunks
from .kernel import Runner, with_outputs

#: Frequent prefixes of a level, as a number each, that may go to the driver and every worker; with more, levels are joins.
SHARED = 5_000_000
#: Extended patterns that a worker may hold at once, beside those of a single sequence.
HELD = 4_000_000
#: Rows of the tables of sequences that go to Spark at once.
ROWS = 1000


def next_writes(runner: Runner, seq: list, start: tuple[int, int], live: list[set[int]]) -> tuple[bool, set[tuple[int, int, int]]]:
    """From (position, state): whether the end can be reached without output, and the (item, position, state) of all next outputs."""
    seen, todo, ends, out = {start}, [start], False, set()
    while todo:
        p, s = todo.pop()
        if p == len(seq):
            ends |= s in runner.finals
            continue
        ends |= s in runner.done
        for a, t in runner.moves[s]:
            o = seq[p][a]
            if o is None or t not in live[p + 1]:
                continue
            if o:
                out.update((x, p + 1, t) for x in o)
            elif (p + 1, t) not in seen:
                seen.add((p + 1, t))
                todo.append((p + 1, t))
    return ends, out


def moves(sequences: DataFrame, c: Compiled, support: int | None) -> DataFrame:
    """(seq_id, weight, at array<long>, item array<int>, to array<long>, ends array<long>) of the sequences that have a run: at and to
    number a state at a position, what is written between them is an item; at ends, nothing more need be written."""
    rows, table = with_outputs(sequences.select("seq_id", "items", "weight"), c, support)
    shipped = sequences.sparkSession.sparkContext.broadcast(table) if table is not None else None
    fst, n = c.fst, c.fst.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runner, look = Runner(fst), shipped.value if shipped else None
        for b in batches:
            get = lambda name: b.column(b.schema.get_field_index(name)).to_pylist()  # noqa: B023, E731
            out: list[tuple] = []
            for sid, w, seq in zip(get("seq_id"), get("weight"), get("outs" if look is None else "items")):
                seq = seq or [] if look is None else [look[g] for g in seq or []]
                live = runner.live(seq)
                if live is None:
                    continue
                seen, todo, found, last = {(0, 0)}, [(0, 0)], [], []
                while todo:
                    at = todo.pop()
                    ends, nxt = next_writes(runner, seq, at, live)
                    if ends:
                        last.append(at[0] * n + at[1])
                    for item, p, s in nxt:
                        found.append((at[0] * n + at[1], item, p * n + s))
                        if (p, s) not in seen:
                            seen.add((p, s))
                            todo.append((p, s))
                out.append((sid, w, [f[0] for f in found], [f[1] for f in found], [f[2] for f in found], last))
                if len(out) == ROWS:
                    yield batch(out)
                    out = []
            yield batch(out)

    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()))

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["seq_id", "weight", "at", "item", "to", "ends"])

    cols = ["seq_id", "weight", "items" if table is not None else "outs"]
    return rows.select(*cols).mapInArrow(run, "seq_id long, weight long, at array<long>, item array<int>, to array<long>, ends array<long>")


def mine(sequences: DataFrame, c: Compiled, support: int, flist: int | None = None) -> DataFrame:
    """(pattern string of gids, support) of (seq_id unique, items, weight)."""
    table = written(moves(sequences, c, flist).where("size(at) > 0"), "moves")
    n = (table.agg(F.max(F.array_max("item"))).first()[0] or 0) + 1
    found, levels = None, []
    while True:
        sums = _supports(table, levels, n).groupBy("key").agg(F.sum("held").alias("held"), F.sum("support").alias("support")).where(F.col("held") >= support)
        sums = written(sums, "prefixes")
        rows = sums.count()
        if not rows:
            break
        done = _named(sums.where(F.col("support") >= support), levels, n)
        found = done if found is None else found.unionByName(done)
        if rows > SHARED:
            return joined(table, support)
        levels = [*levels, np.sort(chunks.numbers(sums.select("key").toArrow().column("key")))]
    if found is None:
        return sequences.sparkSession.createDataFrame([], "pattern string, support bigint")
    return found


def _longer(rows: pa.Table, levels: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(key, held, support) of the patterns of the next length in some sequences: the weights of those that have it as a prefix and of those
    that may end with it. key is the number of the prefix times n plus the item. None if several sequences have too many to hold at once."""
    (at, sizes), (ends, last) = chunks.flat(rows.column("at")), chunks.flat(rows.column("ends"))
    at, to, item = chunks.numbers(at), chunks.numbers(chunks.flat(rows.column("to"))[0]), chunks.numbers(chunks.flat(rows.column("item"))[0])
    far, row = int(max(at.max(), to.max())) + 1, np.repeat(np.arange(len(sizes)), sizes)
    starts = np.arange(len(sizes)) * far
    nodes = np.unique(np.concatenate([starts, row * far + at, row * far + to]))
    order = np.argsort(row * far + at, kind="stable")
    of, to, item = np.searchsorted(nodes, (row * far + at)[order]), np.searchsorted(nodes, (row * far + to)[order]), item[order]
    final = np.zeros(len(nodes), bool)
    where, there = chunks.found_in(nodes, np.repeat(np.arange(len(sizes)), last) * far + chunks.numbers(ends))
    final[where[there]] = True
    node, pattern = np.searchsorted(nodes, starts), np.zeros(len(sizes), np.int64)
    for level in [*levels, None]:
        low = np.searchsorted(of, node)
        more = np.searchsorted(of, node, "right") - low
        if more.sum() > HELD and len(sizes) > 1:
            return None
        edge = chunks.ranges(low, more)
        key, node = np.repeat(pattern, more) * n + item[edge], to[edge]
        if level is not None:
            number, ok = chunks.found_in(level, key)
            node, pattern = chunks.distinct(node[ok], number[ok], len(level))
    kinds, which = np.unique(key, return_inverse=True)
    weight, out = chunks.numbers(rows.column("weight")), []
    for some in (np.ones(len(node), bool), final[node]):
        k, r = chunks.distinct(which[some], nodes[node[some]] // far, len(sizes))
        total = np.zeros(len(kinds), np.int64)
        np.add.at(total, k, weight[r])
        out.append(total)
    return kinds, *out


def _supports(table: DataFrame, levels: list[np.ndarray], n: int) -> DataFrame:
    """(key, held, support) of the patterns of the next length, summed for pieces."""
    shipped = table.sparkSession.sparkContext.broadcast(levels)

    def run(t: pa.Table) -> pa.Table:
        found = chunks.halved(t, lambda part: _longer(part, shipped.value, n))
        return pa.concat_tables([pa.table(dict(zip(("key", "held", "support"), map(pa.array, f)))) for f in found])

    return chunks.in_pieces(table.select("weight", "at", "item", "to", "ends"), "at", run, "key long, held long, support long")


def _named(sums: DataFrame, levels: list[np.ndarray], n: int) -> DataFrame:
    """(pattern string of gids, support) of (key, support)."""
    shipped = sums.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, items = chunks.numbers(b.column(0)), []
            for level in reversed(shipped.value):
                items.append(key % n)
                key = level[key // n]
            items.append(key)
            yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(*[pa.array(i).cast(pa.string()) for i in reversed(items)], " "), b.column(1)], ["pattern", "support"])

    return sums.select("key", "support").mapInArrow(run, "pattern string, support long")


def joined(table: DataFrame, support: int) -> DataFrame:
    """The same with any number of frequent prefixes: each level joins them with a row for each move."""
    steps = written(table.select("seq_id", F.explode(F.arrays_zip("at", "item", "to")).alias("m")).select("seq_id", "m.at", "m.item", "m.to"), "steps").hint("merge")
    ends = written(table.select("seq_id", F.explode("ends").alias("at")), "ends").hint("merge")
    front, found = table.select("seq_id", "weight", F.lit("").alias("pattern"), F.lit(0).cast("long").alias("at")), None
    while True:
        longer = front.join(steps, ["seq_id", "at"]).select("seq_id", "weight", F.ltrim(F.concat("pattern", F.lit(" "), F.col("item").cast("string"))).alias("pattern"), F.col("to").alias("at"))
        longer = written(longer.distinct(), "front")
        # every sequence that ends a pattern or an extension of it is among those that hold it as a prefix
        sums = longer.select("pattern", "seq_id", "weight").distinct().groupBy("pattern").agg(F.sum("weight").alias("held")).where(F.col("held") >= support)
        sums = written(sums, "prefixes")
        if sums.isEmpty():
            break
        front = written(longer.join(small(sums.select("pattern")), "pattern", "left_semi"), "front")
        done = front.join(ends, ["seq_id", "at"], "left_semi").select("pattern", "seq_id", "weight").distinct().groupBy("pattern").agg(F.sum("weight").alias("support")).where(F.col("support") >= support)
        done = written(done, "found")
        found = done if found is None else found.unionByName(done)
    return found
