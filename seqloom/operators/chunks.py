"""Sequences in chunks of bounded size, as arrays: what a table has for a chunk's distinct items goes to the task that has the chunk.

So no row is sent or hashed for a place: a chunk's sequences are sent as they are, and a row for each distinct item.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import small, written

#: Items of a chunk, beside a single longer sequence.
CHUNK = 200_000
#: Numbers of a table of lists that may go to every worker.
SHARED = 500_000


# arrays


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The values of all lists, and how many each list has (none for null)."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return a.flatten(), pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def lists(values: pa.Array, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def numbers(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """As 64-bit numbers; null is 0."""
    return pc.fill_null(column, 0).to_numpy(zero_copy_only=False).astype(np.int64) if isinstance(column, pa.Array) else pc.fill_null(column, 0).to_numpy().astype(np.int64)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, as many as its size."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys in order, and the sums of each of the values for them."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], *(np.add.reduceat(v[order], starts) if len(keys) else v for v in values)


def found_in(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each x is in the sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return at, keys[at] == x


def distinct(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs, where b is below n."""
    both = np.unique(a * n + b)
    return both // n, both % n


def halved(rows: pa.Table, run: Callable[[pa.Table], tuple | None]) -> list[tuple]:
    """What run gives for the rows, or for halves, quarters, ... of them where it gives None."""
    todo, out = [rows], []
    while todo:
        t = todo.pop()
        if (found := run(t)) is None:
            todo += [t.slice(0, t.num_rows // 2), t.slice(t.num_rows // 2)]
        else:
            out.append(found)
    return out


class Lists:
    """A list of numbers for each key."""

    def __init__(self, keys: pa.ChunkedArray, values: pa.ChunkedArray):
        k = numbers(keys)
        order = np.argsort(k, kind="stable")
        v, sizes = flat(values)
        self.keys, self.values, self.sizes, self.starts = k[order], numbers(v), sizes[order], (np.cumsum(sizes) - sizes)[order]

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each value of each x, in their order, the index in x and the value; keys that aren't there have none."""
        at, there = found_in(self.keys, x)
        if not len(self.keys):
            return at, at
        sizes = np.where(there, self.sizes[at], 0)
        return np.repeat(np.arange(len(x)), sizes), self.values[ranges(self.starts[at], sizes)]


def pieces(rows: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices with so many items at most, but with one row at least."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(rows.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < rows.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield rows.slice(at, to - at)
        at = to


# chunks


def cut(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(df with a number __chunk, (__chunk, key) of the distinct items in each chunk), both written."""
    at, names = df.columns.index(column), [*df.columns, "__chunk", "__keys"]
    kind = df.schema[column].dataType
    schema = StructType([*[StructField(f.name, f.dataType) for f in df.schema], StructField("__chunk", LongType()), StructField("__keys", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, places = TaskContext.get().partitionId() << 33, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            values, _ = flat(pa.Table.from_batches(held).column(at))
            keys = pc.drop_null(pc.unique(values))
            own = lists(keys, np.array([len(keys)]))
            for b in held:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, chunk)), pa.nulls(b.num_rows, own.type)], names)
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, f.type) for f in held[0].schema], pa.array([chunk]), own], names)

        for batch in batches:
            for b in pieces(batch, at, CHUNK):
                n = flat(b.column(at))[1].sum()
                if held and places + n > CHUNK:
                    yield from flush()
                    chunk, held, places = chunk + 1, [], 0
                held.append(b)
                places += n
        if held:
            yield from flush()

    both = written(df.mapInArrow(run, schema), "chunks")
    return both.where("__keys IS NULL").drop("__keys"), both.where("__keys IS NOT NULL").select("__chunk", F.explode("__keys").alias("key"))


def looked_up(chunks: tuple[DataFrame, DataFrame], table: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema) -> DataFrame:
    """run gets each chunk's rows and what a table (key unique, ...) has for its items, and gives the rows of the result."""
    rows, keys = chunks
    found = keys.withColumnRenamed("__chunk", "__of").join(small(table), "key")
    return rows.groupBy("__chunk").cogroup(found.groupBy("__of")).applyInArrow(lambda a, b: run(a.drop_columns(["__chunk"]), b), schema)


def with_lists(sequences: DataFrame, column: str, table: DataFrame, run: Callable[[pa.Table, Lists], pa.Table], schema: str) -> DataFrame:
    """run gets rows and the lists that a table (key unique, values array) has for their items. A small table goes to every worker."""
    table = written(table.select("key", "values"), "lists")
    if (table.agg(F.sum(F.size("values") + 1)).first()[0] or 0) > SHARED:
        return looked_up(cut(sequences, column), table, lambda rows, found: run(rows, Lists(found.column("key"), found.column("values"))), schema)
    t = table.toArrow()
    shipped = sequences.sparkSession.sparkContext.broadcast(Lists(t.column("key"), t.column("values")))
    return in_pieces(sequences, column, lambda rows: run(rows, shipped.value), schema)


def in_pieces(sequences: DataFrame, column: str, run: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """run gets rows with about CHUNK items in a column of lists at most."""
    at = sequences.columns.index(column)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in pieces(b, at, CHUNK):
                yield from run(pa.Table.from_batches([piece])).combine_chunks().to_batches()

    return sequences.mapInArrow(each, schema)


# frequencies


def _counted(rows: pa.Table, up: Lists | None) -> pa.Table:
    values, sizes = flat(rows.column("items"))
    known = pc.is_valid(values).to_numpy(zero_copy_only=False)
    key, n = np.unique((np.repeat(np.arange(len(sizes)), sizes) << 32 | numbers(values))[known], return_counts=True)
    if up is not None:
        which, anc = up.of(key & 0xFFFFFFFF)
        key, n = summed(key[which] & ~0xFFFFFFFF | anc, n[which])
    weight = numbers(rows.column("weight"))[key >> 32]
    gid, d, c = summed(key & 0xFFFFFFFF, weight, n * weight)
    return pa.table({"gid": pa.array(gid, pa.int32()), "dfreq": pa.array(d, pa.int64()), "cfreq": pa.array(c, pa.int64())})


def frequencies(sequences: DataFrame, closure: DataFrame | None) -> DataFrame:
    """(gid, dfreq, cfreq) of rows (items array<int>, weight): weights of the sequences that hold an item or, with a closure (gid, anc),
    a descendant, and of its occurrences. They are summed for each piece of the data before anything is sent."""
    rows, kinds = sequences.select("items", "weight"), "gid int, dfreq long, cfreq long"
    if closure is None:
        parts = in_pieces(rows, "items", lambda t: _counted(t, None), kinds)
    else:
        parts = with_lists(rows, "items", closure.groupBy(F.col("gid").alias("key")).agg(F.collect_list("anc").alias("values")), _counted, kinds)
    return parts.groupBy("gid").agg(F.sum("dfreq").alias("dfreq"), F.sum("cfreq").alias("cfreq"))
