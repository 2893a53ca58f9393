"""Gap- and length-constrained sequence mining, with or without generalisation, by two level-wise algorithms on arrays.

Each level is one pass over the sequences: patterns are extended to this length within pieces of the data, by what was frequent at the
levels before, and only their supports, summed for each piece, leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import small, written
from . import chunks
from .dictionary import Dictionary

#: Frequent patterns of a level, as a number each, that may go to the driver and every worker; with more, levels are joins.
SHARED = 5_000_000
#: Places of patterns that a worker may hold at once, beside those of a single sequence.
HELD = 4_000_000


def mine(sequences: DataFrame, dictionary: Dictionary, support: int, gap: int, length: int, generalise: bool = False, gaps: bool = False, by_lists: bool = False) -> DataFrame:
    """(pattern string of gids, support). by_lists joins patterns with those that share all but an end, else they grow by an item. With
    gaps, a negative number -n among the items stands for n items that are left out."""
    rows = sequences.select("items", "weight")
    own = rows.withColumn("items", F.filter("items", lambda x: x >= 0)) if gaps else rows
    up = dictionary.closure().select("gid", "anc") if generalise else None
    frequent = written(chunks.frequencies(own, up).where(F.col("dfreq") >= support).select("gid", F.col("dfreq").alias("support")), "items")
    found = frequent.select(F.col("gid").cast("string").alias("pattern"), "support")
    if frequent.count() > SHARED:
        return joined(sequences, dictionary, support, gap, length, generalise, gaps)
    gids = _sorted(frequent, "gid")
    if length < 2 or not len(gids):
        return found
    levels = [Level(gids)]
    places = written(_places(rows, up, frequent, gids, gaps), "places")
    for k in range(2, length + 1):
        level = written(_supports(places, levels, gap, by_lists).groupBy("key").agg(F.sum("support").alias("support")).where(F.col("support") >= support), "level")
        n = level.count()
        if not n:
            break
        found = found.unionByName(_named(level, levels))
        if k < length:
            if n > SHARED:
                return joined(sequences, dictionary, support, gap, length, generalise, gaps)
            levels = [*levels, Level(_sorted(level, "key"), levels[-1], len(gids))]
    return found


def _sorted(table: DataFrame, column: str) -> np.ndarray:
    return np.sort(chunks.numbers(table.select(column).toArrow().column(column)))


def _places(rows: DataFrame, up: DataFrame | None, frequent: DataFrame, gids: np.ndarray, gaps: bool) -> DataFrame:
    """(weight, pos array<int>, item array<int>): the frequent items of each sequence, as numbers from 0, by position."""
    shipped = rows.sparkSession.sparkContext.broadcast(gids)

    def run(t: pa.Table, look: chunks.Lists | None) -> pa.Table:
        values, sizes = chunks.flat(t.column("items"))
        gid, row = chunks.numbers(pc.fill_null(values, -1)), np.repeat(np.arange(len(sizes)), sizes)
        step = np.where(gid < 0, -gid, 1) if gaps else np.ones(len(gid), np.int64)
        before = np.concatenate([[0], np.cumsum(step)])
        pos = before[:-1] - before[np.cumsum(sizes) - sizes][row]
        which, item = (np.arange(len(gid)), gid) if look is None else look.of(gid)
        code, there = chunks.found_in(shipped.value, item)
        which, code = which[there], code[there]
        sizes = np.bincount(row[which], minlength=len(sizes))
        out = pa.table({"weight": t.column("weight"), "pos": chunks.lists(pa.array(pos[which], pa.int32()), sizes), "item": chunks.lists(pa.array(code, pa.int32()), sizes)})
        return out.filter(pa.array(sizes > 0))

    kinds = "weight long, pos array<int>, item array<int>"
    if up is None:
        return chunks.in_pieces(rows, "items", lambda t: run(t, None), kinds)
    writable = up.join(small(frequent.select(F.col("gid").alias("anc"))), "anc", "left_semi")
    return chunks.with_lists(rows, "items", writable.groupBy(F.col("gid").alias("key")).agg(F.collect_set("anc").alias("values")), run, kinds)


class Level:
    """The frequent patterns of a length by number. keys: the number of all but the last item times the number of items, plus the last
    item; for single items the gid. head, tail: the numbers of all but the last and all but the first item, among shorter patterns."""

    def __init__(self, keys: np.ndarray, before: Level | None = None, n: int = 0):
        self.keys, self.shorter = keys, 1 if before is None else len(before.keys)
        if before is None:
            self.last, self.head = np.arange(len(keys)), np.zeros(len(keys), np.int64)
            self.tail = self.head
        else:
            self.last, self.head = keys % n, keys // n
            # what is without its first item is frequent too
            self.tail = self.last if before.shorter == 1 else chunks.found_in(before.keys, before.tail[self.head] * n + self.last)[0]


def _longer(rows: pa.Table, levels: list[Level], gap: int, by_lists: bool) -> tuple[np.ndarray, np.ndarray] | None:
    """(key, support) of the patterns of the next length in some sequences; None if several sequences have too many to hold at once.

    A spot is a position of a sequence that has items; patterns are at the spot where they end or, for lists, start.
    """
    n, (values, sizes) = len(levels[0].keys), chunks.flat(rows.column("pos"))
    row, pos = np.repeat(np.arange(len(sizes)), sizes), chunks.numbers(values)
    far = int(pos.max()) + gap + 2
    places, spot = np.unique(row * far + pos, return_inverse=True)
    spot, item = chunks.distinct(spot, chunks.numbers(chunks.flat(rows.column("item"))[0]), n)
    now, pattern = spot, item
    for k, level in enumerate(levels):
        if by_lists:
            right, head, last, tail, shorter = now, level.head[pattern], level.last[pattern], level.tail[pattern], level.shorter
        else:
            right, head, last, tail, shorter = spot, np.zeros(len(spot), np.int64), item, np.zeros(len(now), np.int64), 1
        ends = right * shorter + head
        order = np.argsort(ends, kind="stable")
        ends, met = ends[order], []
        for step in range(1, gap + 2):
            at, there = chunks.found_in(places, places[now] + step)
            which = np.flatnonzero(there)
            want = at[which] * shorter + tail[which]
            low = np.searchsorted(ends, want)
            met.append((which, low, np.searchsorted(ends, want, "right") - low))
        if sum(m.sum() for _, _, m in met) > HELD and len(sizes) > 1:
            return None
        left = np.concatenate([np.repeat(w, m) for w, _, m in met])
        other = order[np.concatenate([chunks.ranges(low, m) for _, low, m in met])]
        key, to = pattern[left] * n + last[other], now[left] if by_lists else right[other]
        if k + 1 == len(levels):
            break
        at, ok = chunks.found_in(levels[k + 1].keys, key)
        now, pattern = chunks.distinct(to[ok], at[ok], len(levels[k + 1].keys))
    kinds, which = np.unique(key, return_inverse=True)
    which, row = chunks.distinct(which, places[to] // far, len(sizes))
    which, total = chunks.summed(which, chunks.numbers(rows.column("weight"))[row])
    return kinds[which], total


def _supports(places: DataFrame, levels: list[Level], gap: int, by_lists: bool) -> DataFrame:
    """(key, support) of the patterns of the next length, summed for pieces."""
    shipped = places.sparkSession.sparkContext.broadcast(levels)

    def run(t: pa.Table) -> pa.Table:
        found = chunks.halved(t, lambda part: _longer(part, shipped.value, gap, by_lists))
        return pa.concat_tables([pa.table({"key": pa.array(key, pa.int64()), "support": pa.array(total, pa.int64())}) for key, total in found])

    return chunks.in_pieces(places, "pos", run, "key long, support long")


def _named(level: DataFrame, levels: list[Level]) -> DataFrame:
    """(pattern string of gids, support) of (key, support)."""
    shipped = level.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gids, n = shipped.value[0].keys, len(shipped.value[0].keys)
        for b in batches:
            number, items = chunks.numbers(b.column(0)), []
            for shorter in reversed(shipped.value):
                items.append(number % n)
                number = number // n
                if shorter is not shipped.value[0]:
                    number = shorter.keys[number]
            items.append(number)
            names = [pa.array(gids[i]).cast(pa.string()) for i in reversed(items)]
            yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(*names, " "), b.column(1)], ["pattern", "support"])

    return level.select("key", "support").mapInArrow(run, "pattern string, support long")


def positions(sequences: DataFrame, dictionary: Dictionary, support: int, generalise: bool, gaps: bool = False) -> DataFrame:
    """(seq_id, weight, pos, item string): items, with generalise also their ancestors, of which enough sequences have one. With gaps, a
    negative number -n among the items stands for n items that are left out."""
    each = sequences.select("seq_id", "weight", F.posexplode("items").alias("pos", "gid"))
    if gaps:
        before = Window.partitionBy("seq_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
        each = each.withColumn("pos", F.coalesce(F.sum(F.when(F.col("gid") < 0, -F.col("gid")).otherwise(1)).over(before), F.lit(0)).cast("int")).where("gid >= 0")
    if generalise:
        each = each.join(small(dictionary.closure().select("gid", "anc")), "gid").drop("gid").withColumnRenamed("anc", "gid")
    each = written(each.select("seq_id", "weight", "pos", F.col("gid").cast("string").alias("item")).distinct(), "positions")
    frequent = each.select("item", "seq_id", "weight").distinct().groupBy("item").agg(F.sum("weight").alias("n")).where(F.col("n") >= support)
    return written(each.join(small(written(frequent.select("item"), "items")), "item", "left_semi"), "positions")


def supports(rows: DataFrame, support: int) -> DataFrame:
    return written(rows.select("pattern", "seq_id", "weight").distinct().groupBy("pattern").agg(F.sum("weight").alias("support")).where(F.col("support") >= support), "supports")


def joined(sequences: DataFrame, dictionary: Dictionary, support: int, gap: int, length: int, generalise: bool = False, gaps: bool = False) -> DataFrame:
    """The same with any number of frequent patterns: each level joins pattern ends with the positions up to gap + 1 places later."""
    items = positions(sequences, dictionary, support, generalise, gaps)
    front = items.withColumnRenamed("item", "pattern")
    found = supports(front, support)
    # one row for each place from which the next position can be reached, so the range becomes an equality
    reach = items.select("seq_id", "item", F.col("pos").alias("next"), F.explode(F.sequence(F.col("pos") - gap - 1, F.col("pos") - 1)).alias("pos")).hint("merge")
    last = found
    for _ in range(1, length):
        front = front.join(small(last.select("pattern")), "pattern", "left_semi") if last is not None else front
        front = written(front.join(reach, ["seq_id", "pos"]).select("seq_id", "weight", F.concat_ws(" ", "pattern", "item").alias("pattern"), F.col("next").alias("pos")).distinct(), "front")
        last = supports(front, support)
        if last.isEmpty():
            break
        found = found.unionByName(last)
    return found


def pivoted(found: DataFrame, dictionary: Dictionary, begin: int, end: int) -> DataFrame:
    """The patterns whose least frequent item, that of the largest fid, is within these fids, as partitioned mining asks for."""
    rows = found.withColumn("__f", F.split("pattern", " ").cast("array<int>"))
    return dictionary.translate(rows, "__f", "fid").where(F.array_max("__f").between(begin, end)).drop("__f")
