"""Removes spans of sentences that occurred before, anywhere in the corpus.

A text is cut into units: sentences, which end at a word ending in . ! or ? or at a line's end; a longer sentence ends after every
16th word as well, so that a passage of one long sentence has several units. Every run of three consecutive units is hashed. Hashes
are counted and joined over the whole corpus, and the units that a run's second or later occurrence covers are removed.

So it is in SQL, where a run of fewer than ten words is dropped. With whole=True it is extended by further units to ten words instead,
from its first unit on and from its last one back, so that passages of short sentences are found to both of their ends. Its units also
end after each word whose hash is a multiple of CUT_SHARE, so that equal passages have equal units wherever in a sentence they begin;
where longest words pass without such an end, units differ at most up to the next one.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

RUN, LEAST_WORDS, LONGEST = 3, 10, 16
#: With whole=True one word in so many ends a unit.
CUT_SHARE = 6


def unit_pattern(longest: int) -> re.Pattern:
    word, gap = r"[^\x20\x09-\x0D]", r"[\x20\x09\x0B-\x0D]"
    return re.compile(rf"(?:{word}++(?<![.!?]){gap}++(?={word})){{0,{longest - 1}}}+{word}++")


_pattern: dict[int, re.Pattern] = {}


def units(text: str, longest: int = LONGEST) -> Iterator[re.Match]:
    if longest not in _pattern:
        _pattern[longest] = unit_pattern(longest)
    return _pattern[longest].finditer(text)


def run_hashes(text: str | None, run: int, least_words: int, longest: int) -> np.ndarray:
    """A 64-bit number for the run that begins at each unit; 0 for runs of fewer than least_words words. Spacing doesn't count."""
    from xxhash import xxh3_64_intdigest as h

    words = [m.group().encode().split() for m in units(text or "", longest)]
    n = len(words) - run + 1
    if n < 1:
        return np.zeros(0, np.int64)
    each = np.fromiter((h(b" ".join(w)) for w in words), np.uint64, len(words))
    size = np.fromiter(map(len, words), np.int64, len(words))
    out, total = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    with np.errstate(over="ignore"):
        for k in range(run):
            out = (out ^ each[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
            total += size[k : k + n]
    out |= np.uint64(1)  # 0 stays free
    return np.where(total >= least_words, out.view(np.int64), 0)


def extended(sizes: np.ndarray, run: int, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First unit and number of units of each run, in order: the shortest ones of at least run units and least_words words that begin at a
    unit, and those that end at one."""
    n = len(sizes)
    total = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(n)
    ends = np.maximum(np.searchsorted(total, total[:-1] + least_words), at + run)  # beyond n: too few words are left
    starts = np.minimum(np.searchsorted(total, total[1:] - least_words, "right") - 1, at + 1 - run)
    spans = np.concatenate([np.stack([at, ends], 1)[ends <= n], np.stack([starts, at + 1], 1)[starts >= 0]])
    spans = np.unique(spans, axis=0) if len(spans) else spans
    return spans[:, 0], spans[:, 1] - spans[:, 0]


_word = re.compile(r"([^\x20\x09-\x0D]++)(?:[\x20\x09\x0B-\x0D]*+(\x0A))?")


def passage_units(text: str, longest: int = LONGEST) -> list[tuple[tuple[int, int], list[bytes]]]:
    """Place and words of each unit: as units, with ends after words of certain hashes."""
    out, words, start = [], [], 0
    for m in _word.finditer(text):
        word = m[1].encode()
        if not words:
            start = m.start()
        words.append(word)
        if word[-1] in b".!?" or m[2] or len(words) == longest or zlib.crc32(word) % CUT_SHARE == 0:
            out.append(((start, m.end(1)), words))
            words = []
    return [*out, ((start, len(text.rstrip("\x20\x09\x0A\x0B\x0C\x0D"))), words)] if words else out


def passage_runs(text: str | None, run: int, least_words: int, longest: int) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray, list[bytes]]:
    """Of a text: its units' places, the first unit and the number of units of each run, and the units' words."""
    found = passage_units(text or "", longest)
    starts, counts = extended(np.fromiter((len(w) for _, w in found), np.int64, len(found)), run, least_words)
    return [s for s, _ in found], starts, counts, [b" ".join(w) for _, w in found]


def passage_hashes(text: str | None, run: int, least_words: int, longest: int) -> np.ndarray:
    """A 64-bit number, never 0, for each of passage_runs. Spacing doesn't count."""
    from xxhash import xxh3_64_intdigest as h

    _, starts, counts, words = passage_runs(text, run, least_words, longest)
    each = np.fromiter(map(h, words), np.uint64, len(words))
    out = np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(int(counts.max(initial=0))):
            on = counts > k
            x = (out[on] ^ each[starts[on] + k]) * np.uint64(0x9E3779B97F4A7C15)
            out[on] = x ^ (x >> np.uint64(29))
    return (out | np.uint64(1)).view(np.int64)


def cut_passages(text: str, places: list[int], run: int, least_words: int, longest: int) -> tuple[str, int, list[int]]:
    """As cut, of these of passage_runs."""
    spans, starts, counts, _ = passage_runs(text, run, least_words, longest)
    return without(text, spans, sorted({i for p in places for i in range(starts[p], starts[p] + counts[p])}))


def cut(text: str, starts: list[int], run: int, longest: int) -> tuple[str, int, list[int]]:
    """The text without the units that runs at these units cover, the number of units, and which are removed."""
    spans = [m.span() for m in units(text, longest)]
    return without(text, spans, sorted({i for s in starts for i in range(s, s + run)}))


def without(text: str, spans: list[tuple[int, int]], gone: list[int]) -> tuple[str, int, list[int]]:
    out, at = [], 0
    for i in gone:  # a unit goes with the white space behind it
        a, b = spans[i][0], spans[i + 1][0] if i + 1 < len(spans) else len(text)
        out.append(text[at:a])
        at = b
    out.append(text[at:])
    return "".join(out), len(spans), gone


def clean(df: DataFrame, run: int = RUN, least_words: int = LEAST_WORDS, longest: int = LONGEST, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """For each row: __rid, id_col, n_units, removed array<int> (units, from 0), n_removed, text (what remains).

    The first occurrence is the one of the smallest id, then row, then place; null ids come first. A run may repeat within a document.
    Null texts have no units and stay null; equal rows are occurrences of their own. Only the two named columns are read.
    Repeated runs that overlap are removed with all their units. Empty tables give an empty result.
    whole: short runs are extended, not dropped.
    """
    kind = dict(df.dtypes)[id_col]
    rows = common.with_rid(df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")))

    def hash_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.text_batches(batches, "text"):
            each = [(passage_hashes if whole else run_hashes)(t, run, least_words, longest) for t in common.column(b, "text").to_pylist()]
            ends = pa.array(np.cumsum([0, *map(len, each)]), pa.int32())
            flat = pa.array(np.concatenate(each) if each else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([common.column(b, "__rid"), common.column(b, "id"), pa.ListArray.from_arrays(ends, flat)], ["__rid", "id", "runs"])

    hashed = common.written(common.in_arrow(rows, hash_, f"__rid long, id {kind}, runs array<long>"), "runs")
    runs = hashed.select("__rid", F.posexplode("runs").alias("pos", "run")).where("run <> 0")  # narrow: ids follow below
    repeated = common.written(runs.groupBy("run").agg(F.count("*").alias("k")).where("k > 1"), "repeated")
    total = repeated.agg(F.sum("k")).first()[0] or 0
    places = common.written(common.join_counted(runs, repeated, ["run"], "k", total), "places")
    # only rows with a repeated run need their id; a row's number is unique, and its runs are at most twice its units
    first = places.join(hashed.select("__rid", "id"), "__rid").groupBy("run").agg(F.min(F.struct("id", "__rid", "pos")).alias("first"), F.count("*").alias("k"))
    first = common.written(first.select("run", "k", F.col("first.__rid").alias("rid0"), F.col("first.pos").alias("pos0")), "first")
    later = common.join_counted(places.drop("k"), first, ["run"], "k", total).where("__rid <> rid0 OR pos <> pos0")
    starts = common.written(later.groupBy("__rid").agg(F.sort_array(F.collect_set("pos")).alias("starts")), "starts")  # bounded by a document's units

    def cut_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.text_batches(batches, "text"):
            done = [(None, 0, []) if t is None else cut_passages(t, s or [], run, least_words, longest) if whole else cut(t, s or [], run, longest) for t, s in zip(common.column(b, "text").to_pylist(), common.column(b, "starts").to_pylist())]
            yield pa.RecordBatch.from_arrays([common.column(b, "__rid"), common.column(b, "id"), pa.array([n for _, n, _ in done], pa.int32()), pa.array([g for _, _, g in done], pa.list_(pa.int32())), pa.array([len(g) for _, _, g in done], pa.int32()), pa.array([t for t, _, _ in done], pa.string())], ["__rid", "id", "n_units", "removed", "n_removed", "text"])

    done = common.in_arrow(rows.join(starts, "__rid", "left").select("__rid", "id", "text", "starts"), cut_, f"__rid long, id {kind}, n_units int, removed array<int>, n_removed int, text string")
    return done.withColumnRenamed("id", id_col) if id_col not in ("text", "removed", "n_units", "n_removed") else done


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """df with its texts cut, all other columns as they were; documents of which nothing remains go, unless they had no units."""
    done = clean(df, id_col=id_col, text_col=text_col, **options).where("n_units = 0 OR n_removed < n_units").select("__rid", F.col("text").alias("__text"))
    return common.packed(df).join(done, "__rid").select(*[F.col("__text").alias(c) if c == text_col else F.col(f"__row.`{c}`").alias(c) for c in df.columns])
