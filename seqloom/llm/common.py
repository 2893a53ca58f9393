"""Shared pieces: the shared work folder, written tables, size-checked joins and Arrow batch helpers."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, written  # noqa: F401

#: Rows of a narrow table (keys and counters) that may be broadcast.
BROADCAST_ROWS = 500_000
#: Bytes of a batch that Spark and a Python worker hold at once, beside a single longer row.
BATCH_BYTES, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
#: Keys that may each hold over a thousandth of all rows: at most a thousand, so always small.
HOT_SHARE = 1000

def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/seqloom-{name}-{uuid.uuid4().hex[:12]}"


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def local_path(uri: str) -> str | None:
    """The path of a file URI, or None for other file systems."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if "://" not in uri else None


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI or a plain path."""
    from pyarrow import fs

    at = local_path(uri)
    return (fs.LocalFileSystem(), at) if at else fs.FileSystem.from_uri(uri)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def with_rid(df: DataFrame, name: str = "__rid") -> DataFrame:
    """Adds a row number that a second scan of the same files gives again: it numbers rows within file splits.

    How Spark cuts files would follow the number of live cores, which changes when executors are lost, so that is fixed first.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.sql.files.minPartitionNum", None):
        spark.conf.set("spark.sql.files.minPartitionNum", str(max(1, spark.sparkContext.defaultParallelism)))
    return df.withColumn(name, F.monotonically_increasing_id())


def join_counted(rows: DataFrame, counts: DataFrame, keys: list[str], n: str, total: int, size: int | None = None) -> DataFrame:
    """Inner join with a narrow table that holds each key once and in column n how many of the rows have it.

    Small tables are broadcast. Beyond BROADCAST_ROWS, only keys with over a thousandth of all rows are (there are fewer
    than a thousand of them), and the others, none of which can be hot, go through a shuffle.
    """
    if (counts.count() if size is None else size) <= BROADCAST_ROWS:
        return rows.join(F.broadcast(counts), keys)
    hot = counts.where(F.col(n) * HOT_SHARE > total)
    cold = counts.where(F.col(n) * HOT_SHARE <= total)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(rest.join(cold, keys))


def packed(df: DataFrame) -> DataFrame:
    """(__rid, __row): each row's number and the row as a struct, so that no name of its columns can clash."""
    return with_rid(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row")))


def drop_rows(rows: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """Anti join with a written table of single row numbers; they're unique, so no key is hot."""
    small = dropped.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(dropped) if small else dropped, key, "left_anti")


def without(df: DataFrame, dropped: DataFrame) -> DataFrame:
    """df without the rows whose numbers a written table (__rid) holds."""
    return drop_rows(packed(df), dropped, "__rid").select("__row.*")


_tool: list = []


def release() -> None:
    """Gives freed memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow in batches of bounded size; a worker that is done with its part gives freed memory back, as it may idle for long.

    The session's own limit on batches is kept where it is lower.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(BATCH_BYTES).rstrip("b")) <= BATCH:
        conf.set(BATCH_BYTES, str(BATCH))

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return df.mapInArrow(lean, schema)


#: Letters that stay one letter each when lower-cased and composed, and punctuation.
LETTERS = "".join(c for c in map(chr, range(0x250)) if c.isalpha() and (c.isascii() or c >= "\u00c0") and c != "\u0130")
PUNCTUATION = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())


def apart(chunks: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Which chunks are letters with nothing but punctuation behind them; these letters and this punctuation (not of the others)."""
    tail = pc.utf8_ltrim(chunks, LETTERS)
    plain = pc.and_(pc.equal(pc.utf8_rtrim(tail, PUNCTUATION), ""), pc.not_equal(tail, chunks))
    return plain, pc.utf8_rtrim(chunks.filter(plain), PUNCTUATION), tail.filter(plain)


class Seen:
    """Values of strings, of which two generations are kept: what is asked for goes to the recent one, and the older one goes when that is full."""

    def __init__(self, most: int, longest: int):
        self.most, self.longest = most, longest
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def __call__(self, strings: list[str], learn: Callable[[list[str]], Iterator[bytes]]) -> list[bytes]:
        """The values of distinct strings; learn gives those of new ones."""
        if len(self.recent) > self.most:
            self.recent, self.older = {}, self.recent
        recent, older = self.recent, self.older
        out = list(map(recent.get, strings))
        new = []
        for i in [i for i, x in enumerate(out) if x is None]:
            if (x := older.get(strings[i])) is None:
                new.append(i)
            else:
                out[i] = recent[strings[i]] = x
        if new:
            for i, x in zip(new, learn([strings[i] for i in new])):
                out[i] = x
                if len(strings[i]) <= self.longest:
                    recent[strings[i]] = x
        return out


def tool(kind, *args):
    """kind(*args), kept in this process until another one is asked for. Workers serve many operators, and each tool's caches are
    large; only one tool may hold memory at a time."""
    if not _tool or _tool[0] != (kind, args):
        if _tool:
            _tool.clear()
            gc.collect()
            release()
        _tool.extend([(kind, args), kind(*args)])
    return _tool[1]


def slices(sizes, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most so many bytes together (one row at least)."""
    start, held = 0, 0
    for i, x in enumerate(sizes):
        if held and held + x > most:
            yield start, i
            start, held = i, 0
        held += max(int(x), 1)
    if start < len(sizes):
        yield start, len(sizes)


def text_batches(batches, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Smaller Arrow batches, cut by the bytes of a string column."""
    import pyarrow.compute as pc

    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(column))), 0).to_pylist()
        for i, j in slices(sizes, most):
            yield b.slice(i, j - i)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def tokenizer_path(name: str) -> str:
    """A vocabulary file: $SEQLOOM_TOKENIZERS/name where that is set, else that of the installed package."""
    if at := os.environ.get("SEQLOOM_TOKENIZERS"):
        return os.path.join(at, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def drop_counted(rows: DataFrame, counts: DataFrame, keys: list[str], n: str, total: int, size: int) -> DataFrame:
    """The anti join that goes with join_counted."""
    if size <= BROADCAST_ROWS:
        return rows.join(F.broadcast(counts.select(*keys)), keys, "left_anti")
    hot = counts.where(F.col(n) * HOT_SHARE > total).select(*keys)
    return rows.join(F.broadcast(hot), keys, "left_anti").join(counts.where(F.col(n) * HOT_SHARE <= total).select(*keys), keys, "left_anti")
