"""Exact deduplication by counting quotient filters and byte verification.

Each partition builds a counting quotient filter of the fingerprints of its normalised texts. The filters, cut into blocks by
leading bits, merge losslessly: a block's entries are runs of sorted remainders, so a merge of runs that adds the counts of equal
remainders is again the filter of the union. Fingerprints that the merged filter counts more than once route their rows, and no
others, to verification, which groups by the bytes of the normalised texts themselves (pre-aggregated in each partition).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Fingerprints that one block of the merged filter should hold; the number of blocks follows the number of rows.
BLOCK_ENTRIES = 500_000


def normalised(text: Column) -> Column:
    """Null counts as empty; each run of ASCII white space becomes one space (single spaces are left as they are)."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def pack(prints: np.ndarray, counts: np.ndarray, shift: int) -> bytes:
    """The filter of sorted distinct fingerprints that agree in all but their low shift bits.

    The quotient has so many bits that there are about as many quotients as entries. Stored are, for each quotient, how many
    remainders its run has (the occupied and run-end bits in one), then the sorted remainders, then the counts.
    """
    n = len(prints)
    q = min(shift, max(0, int(n).bit_length() - 1))
    low = prints & np.uint64((1 << shift) - 1) if shift < 64 else prints
    quotient = (low >> np.uint64(shift - q)).astype(np.int64) if q else np.zeros(n, np.int64)
    rest = low & np.uint64((1 << (shift - q)) - 1) if shift - q < 64 else low
    runs = np.bincount(quotient, minlength=1 << q).astype("<u4")
    width = (shift - q + 7) // 8
    remainders = rest.astype("<u8").view(np.uint8).reshape(n, 8)[:, :width]
    big = counts > 254
    head = np.array([n, q, shift, int(big.sum())], "<u8").tobytes()
    runs8 = np.minimum(runs, 255).astype(np.uint8)  # a longer run's true length follows
    return b"".join([head, runs8.tobytes(), runs[runs8 == 255].tobytes(), remainders.tobytes(), np.where(big, 255, counts).astype(np.uint8).tobytes(), counts[big].astype("<u8").tobytes()])


def unpack(data: bytes, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted fingerprints and counts of a packed filter of the block with this number."""
    n, q, shift, large = np.frombuffer(data, "<u8", 4).tolist()
    at = 32
    runs8 = np.frombuffer(data, np.uint8, 1 << q, at)
    at += 1 << q
    runs = runs8.astype(np.int64)
    full = runs8 == 255
    runs[full] = np.frombuffer(data, "<u4", int(full.sum()), at)
    at += 4 * int(full.sum())
    width = (shift - q + 7) // 8
    rest = np.zeros((n, 8), np.uint8)
    rest[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
    at += n * width
    counts = np.frombuffer(data, np.uint8, n, at).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, "<u8", large, at + n)
    prints = rest.view("<u8").ravel().astype(np.uint64)
    if q:
        prints |= np.repeat(np.arange(1 << q, dtype=np.uint64), runs) << np.uint64(shift - q)
    if shift < 64:
        prints |= np.uint64(block) << np.uint64(shift)
    return prints, counts


def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    prints, counts = np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts])
    by = np.argsort(prints, kind="stable")
    prints, counts = prints[by], counts[by]
    first = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]])) if len(prints) else np.zeros(0, np.int64)
    return prints[first], np.add.reduceat(counts, first) if len(first) else counts


def repeated_fingerprints(df: DataFrame, fp: str, rows: int) -> DataFrame:
    """(fp long, n long): each fingerprint that at least two rows have. rows: about how many rows there are."""
    bits = max(0, int(rows // BLOCK_ENTRIES).bit_length())
    shift = 64 - bits

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(np.unique(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), return_counts=True))
            size += len(held[-1][0])
            if size > 2_000_000:  # merged from time to time; flushed when it's mostly distinct, so memory stays bounded
                held = [merge(held)]
                size = len(held[0][0])
                if size > 1_000_000:
                    yield blocks(*held[0])
                    held, size = [], 0
        if held:
            yield blocks(*merge(held))

    def blocks(prints: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        block = (prints >> np.uint64(shift)).astype(np.int64) if bits else np.zeros(len(prints), np.int64)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(prints)]]) if len(prints) else np.zeros(1, np.int64)
        spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
        return pa.RecordBatch.from_arrays([pa.array([int(block[i]) for i, _ in spans], pa.int64()), pa.array([pack(prints[i:j], counts[i:j], shift) for i, j in spans], pa.binary())], ["block", "filter"])

    def combine(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = key[0].as_py(), []
        for b in batches:
            for x in b.column(b.schema.get_field_index("filter")).to_pylist():
                held.append(unpack(x, block))
                if len(held) > 64:
                    held = [merge(held)]
        prints, counts = merge(held)
        twice = counts > 1
        yield pa.RecordBatch.from_arrays([pa.array(prints[twice].view(np.int64)), pa.array(counts[twice], pa.int64())], ["fp", "n"])

    filters = common.in_arrow(df.select(F.col(fp).alias("fp")), build, "block long, filter binary")
    return filters.groupBy("block").applyInArrow(combine, "fp long, n long")


def decide(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: __rid long, id_col, keep_id, group_size long, kept boolean, text_sha256 string.

    Texts are equal when their normalised bytes are. Of equal texts the row with the smallest id stays (one row, where repeated
    rows share that id; a null id stays only if all ids of its group are null). Null texts count as empty ones. Empty tables
    give an empty result. Columns other than the two named ones aren't read, so their names can't clash. __rid numbers the rows
    of df as common.with_rid does.
    """
    kind = dict(df.dtypes)[id_col]
    rows = common.with_rid(df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")))
    rows = rows.withColumn("norm", normalised(F.col("text"))).withColumn("fp", F.xxhash64("norm"))
    keys = common.written(rows.select("__rid", "id", "fp", F.sha2(F.col("norm").cast("binary"), 256).alias("sha")), "keys")
    total = keys.count()
    again = common.written(repeated_fingerprints(keys, "fp", total), "repeated")
    size = again.count()
    routed = common.join_counted(rows.select("__rid", "id", "fp", "norm"), again, ["fp"], "n", total, size)
    groups = routed.groupBy("fp", "norm").agg(F.min("id").alias("keep_id"), F.coalesce(F.min_by("__rid", "id"), F.min("__rid")).alias("keep_rid"), F.count("*").alias("group_size"))
    groups = common.written(groups.where("group_size > 1").select("fp", F.sha2(F.col("norm").cast("binary"), 256).alias("sha"), "keep_id", "keep_rid", "group_size"), "groups")
    copies = common.join_counted(keys, groups, ["fp", "sha"], "group_size", total)
    out = copies.select("__rid", "id", "keep_id", "group_size", (F.col("__rid") == F.col("keep_rid")).alias("kept"), "sha")
    n = groups.count()
    marks = groups.select("fp", "sha", F.col("group_size"))
    single = common.drop_counted(keys, marks, ["fp", "sha"], "group_size", total, n)
    out = out.unionByName(single.select("__rid", "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha"))
    return out.select("__rid", F.col("id").cast(kind).alias(id_col), F.col("keep_id").cast(kind).alias("keep_id"), "group_size", "kept", F.col("sha").alias("text_sha256"))


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that stay, with all their columns."""
    dropped = common.written(decide(df, id_col, text_col).where("not kept").select("__rid"), "dropped")
    return common.without(df, dropped)
