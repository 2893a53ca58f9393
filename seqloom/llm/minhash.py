"""Near-duplicate detection by circulant MinHash, banding and exact Jaccard verification.

Two permutations make the whole signature: the first scatters the shingles over a circle, and coordinate k is the minimum, over a
document's places p, of the second permutation at p + k, that is, of its copy shifted circularly by k.

Documents with the same set of shingles form a class, of which one goes on. Classes that agree in a band meet in a bucket. A
bucket's members are compared with its smallest one first. Where a bucket of at most CROWD members still holds different components,
those are compared with each other. The members of larger ones, as texts that share a passage make them, are never paired by bucket:
shingles are ordered by how many of these members have them, and only members that share one of their rarest shingles (as many as
two sets at the threshold can't both lack) are compared, which finds each link among them. What is compared is the full sets. Members of
one component need no comparison: the components can't change by it.

Pairs across components are first held against each other by their signatures (one byte a coordinate). Bands and that cut follow the
threshold, so that a pair at a similarity of just the threshold is missed with a probability of at most 1e-7 by the bands.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, components

BANDS, ROWS = 60, 5
#: The probability at which a pair at a similarity of just the threshold may be missed by the bands.
MISSED = 1e-7
CIRCLE = 1 << 20
#: Members that one task compares with the same document.
FAN = 2000
#: Members of a bucket up to which its components are compared pair by pair.
CROWD = 50


class Shingler:
    """The distinct 2-word shingles of a text as sorted 64-bit numbers. Words are cut at ASCII white space, A-Z lower-cased."""

    def __init__(self):
        from xxhash import xxh3_64_intdigest

        self.hash, self.cache = xxh3_64_intdigest, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.cache) > 200_000:
            self.cache = {}
        cache, h = self.cache, self.hash
        for w in set(words).difference(cache):
            cache[w] = h(w)
        x = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
        a, b = (x[:-1], x[1:]) if len(x) > 1 else (x, np.full(1, 0x5851F42D4C957F2D, np.uint64))
        with np.errstate(over="ignore"):
            y = a * np.uint64(0x9E3779B97F4A7C15)
            y ^= y >> np.uint64(32)
            y = (y + b) * np.uint64(0xBF58476D1CE4E5B9)
            y ^= y >> np.uint64(29)
            y *= np.uint64(0x94D049BB133111EB)
            y ^= y >> np.uint64(32)
        return np.unique(y)


class Circulant:
    """Signatures of k coordinates from two permutations of a circle."""

    def __init__(self, k: int, circle: int = CIRCLE, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.bits = np.uint64(64 - (circle.bit_length() - 1))
        self.first = rng.permutation(circle)
        second = rng.permutation(circle).astype(np.uint32)
        self.windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[: k - 1]]), k)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        places = self.first[(shingles >> self.bits).astype(np.int64)]
        out = self.windows[places[:512]].min(axis=0)
        for i in range(512, len(places), 512):
            np.minimum(out, self.windows[places[i : i + 512]].min(axis=0), out=out)
        return out


def banding(percent: int) -> tuple[int, int]:
    """Bands and rows of a signature of BANDS * ROWS coordinates: the most rows, ROWS at most, that miss a pair at percent rarely enough."""
    if percent > 100:
        raise ValueError("a similarity is at most 100 percent")
    for rows in range(ROWS, 0, -1):
        bands = BANDS * ROWS // rows
        if percent > 0 and (1 - (percent / 100) ** rows) ** bands <= MISSED:
            return bands, rows
    raise ValueError(f"signatures of {BANDS * ROWS} coordinates can't find pairs at {percent} percent")


def agreeing(percent: int) -> float:
    """The share of equal signature coordinates below which a pair's sets aren't compared: six standard deviations below percent."""
    share = percent / 100
    return share - 6 * (share * (1 - share) / (BANDS * ROWS)) ** 0.5 - 1e-9


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band, different for equal contents of different bands."""
    s = signature.reshape(bands, rows).astype(np.uint64)
    with np.errstate(over="ignore"):
        h = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for j in range(rows):
            h = (h ^ s[:, j]) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(31)
    return h.view(np.int64)


class Signer:
    """The shingles and the signature of a text."""

    def __init__(self, k: int):
        self.shingle, self.sign = Shingler(), Circulant(k)


def signatures(rows: DataFrame, bands: int = BANDS, per_band: int = ROWS) -> DataFrame:
    """(__rid, id, n_shingles long, h1 long, h2 long, bands array<long>, sketch binary) of (__rid, id, text); h1, h2: 128 bits of the whole set."""
    id_type = rows.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = common.tool(Signer, bands * per_band)
        shingle, sign = both.shingle, both.sign
        for b in common.text_batches(batches, "text"):
            n, h1, h2, keys, ends, sketch = [], [], [], [], [0], []
            for t in common.column(b, "text").to_pylist():
                s = shingle(t)
                a, c = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), "<i8").tolist()
                n.append(len(s))
                h1.append(a)
                h2.append(c)
                sketch.append(b"")
                if len(s):
                    signature = sign(s)
                    keys.append(band_keys(signature, bands, per_band))
                    sketch[-1] = (signature & 0xFF).astype(np.uint8).tobytes()
                ends.append(ends[-1] + (bands if len(s) else 0))
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([common.column(b, "__rid"), common.column(b, "id"), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), pa.array(sketch, pa.binary())], ["__rid", "id", "n_shingles", "h1", "h2", "bands", "sketch"])

    schema = T.StructType([T.StructField("__rid", T.LongType()), T.StructField("id", id_type), T.StructField("n_shingles", T.LongType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())])
    return common.in_arrow(rows, run, schema)


def confirmed(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct pairs (u, v) of row numbers whose full sets of shingles have 100 * intersection >= percent * union.

    u's text goes once to each task that compares with it, v's texts stream by; one set is held at a time.
    """
    pairs = common.written(pairs, "pairs")
    ends = common.written(pairs.select(F.col("u").alias("__rid")).unionByName(pairs.select(F.col("v").alias("__rid"))).distinct(), "ends")
    small = ends.count() <= common.BROADCAST_ROWS
    texts = rows.select("__rid", "text").join(F.broadcast(ends) if small else ends, "__rid", "left_semi")
    fans = pairs.groupBy("u").agg(F.ceil(F.count("*") / FAN).cast("int").alias("fans"), F.count("*").alias("k"))
    fans = common.written(fans, "fans")
    sides = common.join_counted(pairs, fans, ["u"], "k", pairs.count())
    members = sides.select("u", F.pmod(F.xxhash64("v"), F.col("fans")).cast("int").alias("fan"), F.col("v").alias("__rid"))
    centres = fans.select("u", F.explode(F.sequence(F.lit(0), F.col("fans") - 1)).alias("fan"), F.col("u").alias("__rid"))
    both = members.withColumn("first", F.lit(1)).unionByName(centres.withColumn("first", F.lit(0)))
    both = both.join(texts, "__rid")  # a row number has few copies here but for one in very many buckets, which AQE splits
    streamed = both.repartition("u", "fan").sortWithinPartitions("u", "fan", "first", "__rid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, at, centre = common.tool(Shingler), None, None
        for b in common.text_batches(batches, "text"):
            u_out, v_out = [], []
            for u, fan, rid, first, text in zip(*(common.column(b, c).to_pylist() for c in ("u", "fan", "__rid", "first", "text"))):
                s = shingle(text)
                if first == 0:
                    at, centre = (u, fan), s
                    continue
                if at != (u, fan):
                    raise ValueError("a pair's first text is missing")
                if len(s) * 100 < percent * len(centre) or len(centre) * 100 < percent * len(s):
                    continue
                both = np.concatenate([s, centre])
                both.sort()
                common_n = int((both[1:] == both[:-1]).sum())
                if 100 * common_n >= percent * (len(s) + len(centre) - common_n):
                    u_out.append(u)
                    v_out.append(rid)
            yield pa.RecordBatch.from_arrays([pa.array(u_out, pa.int64()), pa.array(v_out, pa.int64())], ["u", "v"])

    return common.in_arrow(streamed.select("u", "fan", "__rid", "first", "text"), run, "u long, v long")


def apart(placed: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (u, v) of rows of different components that may be linked and meet in a bucket, of (band, __rid, n_shingles, comp)."""
    sizes = placed.groupBy("band").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count("*").alias("members")).where("a <> b").select("band", "members")
    near = common.written(placed.join(sizes, "band"), "open")
    few = near.where(F.col("members") <= CROWD)
    other = few.select("band", F.col("__rid").alias("u"), F.col("n_shingles").alias("other"), F.col("comp").alias("comp_u"))
    pairs = few.join(other, "band").where(f"comp_u < comp AND n_shingles * 100 >= {percent} * other AND other * 100 >= {percent} * n_shingles")
    pairs = pairs.select(F.least("u", "__rid").alias("u"), F.greatest("u", "__rid").alias("v"))
    crowd = common.written(near.where(F.col("members") > CROWD).select("__rid", "n_shingles", "comp").distinct(), "crowd")
    return (pairs if crowd.isEmpty() else pairs.unionByName(by_rare_shingles(crowd, rows, percent))).distinct()


def by_rare_shingles(crowd: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v), possibly repeated, of different components that hold each link among crowd (__rid, n_shingles, comp).

    In a common order of all shingles, rarest first, two linked sets x and y share one within the first |x| - a + 1 and |y| - a + 1, where
    a is the least size of their intersection: percent of the larger set, and 2 * percent / (100 + percent) of the smaller one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = common.tool(Shingler)
        for b in common.text_batches(batches, "text", 1 << 20):
            each = [shingle(t) for t in common.column(b, "text").to_pylist()]
            ends = pa.array(np.cumsum([0, *map(len, each)]), pa.int32())
            yield pa.RecordBatch.from_arrays([common.column(b, "__rid"), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(each).view(np.int64)))], ["__rid", "shingles"])

    small = crowd.count() <= common.BROADCAST_ROWS
    ids = crowd.select("__rid")
    sets = common.written(common.in_arrow(rows.select("__rid", "text").join(F.broadcast(ids) if small else ids, "__rid", "left_semi"), run, "__rid long, shingles array<long>"), "sets")
    tokens = sets.select("__rid", F.explode("shingles").alias("token"))
    shared = common.written(tokens.groupBy("token").agg(F.count("*").alias("k")).where("k > 1"), "shared")
    total = shared.agg(F.sum("k")).first()[0] or 0
    found = common.join_counted(tokens, shared, ["token"], "k", total)
    # a set's shared shingles, at most as many as its text has, behind those that it has alone
    lists = found.groupBy("__rid").agg(F.sort_array(F.collect_list(F.struct("k", "token"))).alias("shared")).join(crowd, "__rid")
    alone = F.col("n_shingles") - F.size("shared")
    probe = F.col("n_shingles") - F.expr(f"({percent} * n_shingles + 99) div 100") + 1 - alone
    index = F.col("n_shingles") - F.expr(f"({2 * percent} * n_shingles + {99 + percent}) div {100 + percent}") + 1 - alone
    rare = lists.withColumns({"probe": probe.cast("int"), "index": index.cast("int")}).where("probe > 0").withColumn("shared", F.expr("slice(shared, 1, greatest(probe, 0))"))
    rare = common.written(rare.select("__rid", "n_shingles", "comp", "index", F.posexplode("shared").alias("pos", "s")).select("__rid", "n_shingles", "comp", F.expr("pos < index").alias("indexed"), "s.token"), "rare")
    left = rare.select("token", F.col("__rid").alias("u"), F.col("n_shingles").alias("other"), F.col("comp").alias("comp_u"))
    pairs = left.join(rare.where("indexed"), "token").where(f"u <> __rid AND comp_u <> comp AND n_shingles <= other AND n_shingles * 100 >= {percent} * other")
    return pairs.select(F.least("u", "__rid").alias("u"), F.greatest("u", "__rid").alias("v"))


def similar(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Those pairs whose signatures agree in at least a share agreeing(percent) of the coordinates."""
    least = agreeing(percent)
    pairs = common.written(pairs, "met")
    both = pairs.join(sketches.select(F.col("__rid").alias("u"), F.col("sketch").alias("a")), "u").join(sketches.select(F.col("__rid").alias("v"), F.col("sketch").alias("b")), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(common.column(b, c).to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in "ab")
                keep = pa.array((x == y).mean(axis=1) >= least)
                yield pa.RecordBatch.from_arrays([common.column(b, "u").filter(keep), common.column(b, "v").filter(keep)], ["u", "v"])

    return common.in_arrow(both.select("u", "v", "a", "b"), run, "u long, v long")


def components_of(df: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: __rid, id_col, n_shingles long, component_id, group_size long, first_rid long (the row that stays).

    Rows are linked if their sets of shingles have 100 * intersection >= percent * union. Null, empty and blank texts have an empty set
    and are linked with nothing. component_id is the smallest id of a component (null only if all its ids are); repeated ids are
    told apart by __rid (see common.with_rid). Only the two named columns are read. Empty tables give an empty result.
    """
    kind = dict(df.dtypes)[id_col]
    rows = common.with_rid(df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")))
    signed = common.written(signatures(rows, *banding(percent)), "signatures")
    total = signed.count()
    filled = signed.where("n_shingles > 0")
    # classes of equal sets
    classes = filled.groupBy("h1", "h2").agg(F.min("__rid").alias("rep"), F.count("*").alias("k")).where("k > 1")
    classes = common.written(classes, "classes")
    copies = common.written(common.join_counted(filled.select("__rid", "h1", "h2"), classes, ["h1", "h2"], "k", total).where("__rid <> rep").select("__rid", "rep"), "copies")
    reps = common.drop_rows(filled.select("__rid", "n_shingles", "bands"), copies.select("__rid"), "__rid")
    # buckets of at least two classes
    keyed = reps.select("__rid", "n_shingles", F.explode("bands").alias("band"))
    buckets = keyed.groupBy("band").agg(F.min("__rid").alias("least"), F.max("__rid").alias("most")).where("least <> most").select("band", "least")
    members = common.written(keyed.join(buckets, "band"), "members")
    alike = f"n_shingles * 100 >= {percent} * other AND other * 100 >= {percent} * n_shingles"
    sizes = members.where("__rid = least").select("band", F.col("n_shingles").alias("other"))
    # the size of a bucket's smallest member, known to all its rows
    stars = members.where("__rid <> least").select("band", "least", "__rid", "n_shingles").join(sizes, "band").where(alike)
    links = common.written(confirmed(stars.select(F.col("least").alias("u"), F.col("__rid").alias("v")).distinct(), rows, percent), "links")
    labels = common.written(components.connected(links), "labels")
    # buckets in which components are still apart
    small = labels.count() <= common.BROADCAST_ROWS
    known = labels.select(F.col("node").alias("__rid"), "comp")
    placed = members.select("band", "__rid", "n_shingles").join(F.broadcast(known) if small else known, "__rid", "left").withColumn("comp", F.coalesce("comp", "__rid"))
    across = similar(apart(placed, rows, percent), signed.select("__rid", "sketch"), percent)
    more = common.written(confirmed(across, rows, percent), "links")
    if more.count():
        labels = common.written(components.connected(links.unionByName(more)), "labels")
    # every row's component
    known = labels.select(F.col("node").alias("rep"), "comp")
    small = labels.count() <= common.BROADCAST_ROWS
    lists = signed.select("__rid", "id", "n_shingles")
    few = copies.count() <= common.BROADCAST_ROWS
    lists = lists.join(F.broadcast(copies) if few else copies, "__rid", "left").withColumn("rep", F.coalesce("rep", "__rid"))
    # copies of one class may be a third of all rows: their label is looked up by class, once, through the table of classes
    by_class = classes.select("rep").join(F.broadcast(known) if small else known, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    single = lists.where("rep = __rid").join(F.broadcast(known) if small else known, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    counted = classes.select("rep", "k").join(by_class, "rep")
    copied = common.join_counted(lists.where("rep <> __rid"), common.written(counted, "classes"), ["rep"], "k", total)
    lists = common.written(single.select("__rid", "id", "n_shingles", "comp").unionByName(copied.select("__rid", "id", "n_shingles", "comp")), "lists")
    groups = lists.groupBy("comp").agg(F.min("id").alias("component_id"), F.coalesce(F.min_by("__rid", "id"), F.min("__rid")).alias("first_rid"), F.count("*").alias("group_size")).where("group_size > 1")
    groups = common.written(groups, "groups")
    n = groups.count()
    grouped = common.join_counted(lists, groups, ["comp"], "group_size", total, n).select("__rid", "id", "n_shingles", "component_id", "group_size", "first_rid")
    alone = common.drop_counted(lists, groups, ["comp"], "group_size", total, n).select("__rid", "id", "n_shingles", F.col("id").alias("component_id"), F.lit(1).cast("long").alias("group_size"), F.col("__rid").alias("first_rid"))
    return grouped.unionByName(alone).select("__rid", F.col("id").cast(kind).alias(id_col), "n_shingles", F.col("component_id").cast(kind).alias("component_id"), "group_size", "first_rid")


def digest(df: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept)."""
    return components_of(df).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def dedup(df: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of df, that with the smallest id, with all its columns."""
    out = components_of(df, percent, id_col, text_col)
    dropped = common.written(out.where("__rid <> first_rid").select("__rid"), "dropped")
    return common.without(df, dropped)
