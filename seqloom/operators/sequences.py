"""Data sets of weighted item sequences with their dictionary, and the entry to mining."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import patex as language
from ..plans.compiled import compile_
from ..session import ship, written
from . import chunks, frontier, growth, kernel, native, traditional
from .dictionary import Dictionary

ALGORITHMS = ("auto", "native", "frontier", "kernel", "growth")


@dataclass(frozen=True)
class MinerConf:
    """What a mining run is asked for; only the first three decide the result."""

    pattern: str
    min_support: int
    algorithm: str = "auto"
    use_flist: bool = True
    prune_irrelevant: bool = False
    max_outputs: int = kernel.MAX_OUTPUTS

    @staticmethod
    def of(properties: dict[str, str]) -> MinerConf:
        """From string properties; a missing one without a default is an error."""
        flag = lambda k, d: str(properties.get(k, d)).lower() == "true"
        for k in ("pattern.expression", "min.support"):
            if k not in properties:
                raise KeyError(f"property {k} is not set")
        return MinerConf(properties["pattern.expression"], int(properties["min.support"]), properties.get("algorithm", "auto"), flag("use.flist", True), flag("prune.irrelevant.inputs", False))


class Sequences:
    """rows: seq_id bigint (unique), items array<int> (gids), weight bigint. Immutable."""

    def __init__(self, rows: DataFrame, dictionary: Dictionary, counted: bool = False):
        self.rows, self.dictionary, self.counted = rows.select("seq_id", "items", "weight"), dictionary, counted
        self.spark: SparkSession = rows.sparkSession
        ship(self.spark)

    # making

    @staticmethod
    def from_columns(df: DataFrame, items: str = "items", weight: str | Column | None = None, key: str | None = None, parents: DataFrame | None = None, dictionary: Dictionary | None = None, unknown: str = "error") -> Sequences:
        """From an array of sids. Without a dictionary one is built from the data and parents (child, parent), and counted."""
        w = F.lit(1) if weight is None else F.col(weight) if isinstance(weight, str) else weight
        rows = df.select((F.col(key) if key else F.monotonically_increasing_id()).cast("bigint").alias("seq_id"), F.coalesce(items, F.array().cast("array<string>")).alias("items"), w.cast("bigint").alias("weight"))
        if dictionary is None:
            cut = chunks.cut(rows, "items")
            d = Dictionary.from_data(cut[0], parents, seen=cut[1].select(F.col("key").alias("sid")))
            return Sequences(written(d.translate(cut[0].drop("__chunk"), "items", "gid", "sid", unknown=unknown, cut=cut), "sequences"), d).recompute_dictionary()
        if key is None:
            rows = written(rows, "sequences")
        return Sequences(dictionary.translate(rows, "items", "gid", "sid", unknown=unknown), dictionary)

    @staticmethod
    def from_events(df: DataFrame, key: str, order: list[str], item: str, **options) -> Sequences:
        """From one row an event: the items of each key, ordered; the order columns should leave no ties."""
        rows = df.where(F.col(item).isNotNull()).groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(*order, F.col(item).cast("string").alias("__item")))), lambda x: x["__item"]).alias("items"))
        if dict(rows.dtypes)[key] in ("bigint", "int", "smallint", "tinyint"):
            return Sequences.from_columns(rows, key=key, **options)
        return Sequences.from_columns(rows, **options)

    @staticmethod
    def build(df: DataFrame, parse: Callable[[dict], tuple[list, int]], key: str | None = None) -> Sequences:
        """From rows of any kind: parse gets a row as a dict and returns its items and its weight. An item is a sid or (sid, [parent sids]).

        The dictionary is made of all items and parents and counted. parse runs in Python workers, in batches.
        """
        names = df.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                items, weights, links = [], [], []
                for row in b.to_pylist():
                    found, weight = parse(row)
                    items.append([x if isinstance(x, str) else x[0] for x in found])
                    weights.append(weight)
                    links.append([{"child": x[0], "parent": p} for x in found if not isinstance(x, str) for p in x[1]])
                kept = [b.column(names.index(key))] if key else []
                link = pa.list_(pa.struct([("child", pa.string()), ("parent", pa.string())]))
                yield pa.RecordBatch.from_arrays([*kept, pa.array(items, pa.list_(pa.string())), pa.array(weights, pa.int64()), pa.array(links, link)], [*["key"] * len(kept), "items", "weight", "links"])

        own = f"key {dict(df.dtypes)[key]}, " if key else ""
        rows = written(df.mapInArrow(run, f"{own}items array<string>, weight long, links array<struct<child:string,parent:string>>"), "parsed")
        links = rows.select(F.explode("links").alias("e")).select("e.child", "e.parent").distinct()
        return Sequences.from_columns(rows, weight="weight", key="key" if key else None, parents=links)

    def with_rows(self, rows: DataFrame) -> Sequences:
        return Sequences(rows, self.dictionary, self.counted)

    def recompute_dictionary(self) -> Sequences:
        """Frequencies and fids as in these sequences."""
        return Sequences(self.rows, self.dictionary.recompute(self.rows), True)

    # looking

    def to_sids(self) -> DataFrame:
        """(items array<string>, weight)."""
        return self.dictionary.translate(self.rows, "items", "sid").select("items", "weight")

    def to_fids(self) -> DataFrame:
        return self.dictionary.translate(self.rows, "items", "fid")

    def printed(self) -> DataFrame:
        """(line): [sid sid ...], with @weight where it isn't 1."""
        return self.to_sids().select(F.concat(F.lit("["), F.concat_ws(" ", "items"), F.lit("]"), F.when(F.col("weight") != 1, F.concat(F.lit("@"), "weight")).otherwise("")).alias("line"))

    def show_sequences(self, n: int = -1) -> None:
        lines = self.printed()
        for r in (lines if n < 0 else lines.limit(n)).toLocalIterator():
            print(r["line"])

    # storing

    def save(self, path: str) -> Sequences:
        """Parquet tables and a descriptor; returns the data set read back from there."""
        self.rows.write.mode("overwrite").parquet(f"{path}/sequences")
        self.dictionary.save(f"{path}/dictionary")
        self.spark.createDataFrame([(json.dumps({"kind": "gid", "counted": self.counted}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/descriptor")
        return Sequences.load(self.spark, path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Sequences:
        about = json.loads(spark.read.text(f"{path}/descriptor").first()["value"])
        return Sequences(spark.read.parquet(f"{path}/sequences"), Dictionary.load(spark, f"{path}/dictionary"), about["counted"])

    # mining

    def relevant(self, pattern: str) -> Sequences:
        """The sequences that a pattern expression accepts."""
        return self.with_rows(kernel.relevant(self.rows, compile_(pattern, self.dictionary)))

    def mine(self, pattern: str | MinerConf, min_support: int | None = None, algorithm: str = "auto", use_flist: bool = True, prune_irrelevant: bool = False, max_outputs: int = kernel.MAX_OUTPUTS) -> Patterns:
        """All output sequences that sequences of a total weight of at least min_support have.

        algorithm: native (bounded expressions, in the JVM), frontier (a fold in the JVM), kernel (Arrow, any expression), growth
        (level-wise, for very many outputs a sequence), or auto, which takes native where it can and kernel elsewhere. use_flist drops items
        that can't be frequent before outputs are made; it needs a counted dictionary and is ignored without one.
        """
        conf = pattern if isinstance(pattern, MinerConf) else MinerConf(pattern, min_support, algorithm, use_flist, prune_irrelevant, max_outputs)
        if conf.algorithm not in ALGORITHMS:
            raise ValueError(f"algorithm must be one of {', '.join(ALGORITHMS)}")
        c = compile_(conf.pattern, self.dictionary)
        flist = conf.min_support if conf.use_flist and self.counted else None
        rows = kernel.relevant(self.rows, c, flist) if conf.prune_irrelevant else self.rows
        if conf.algorithm == "growth":
            return Patterns(growth.mine(rows, c, conf.min_support, flist), self.dictionary)
        made = None
        if conf.algorithm in ("auto", "native"):
            made = native.generate(rows, c, flist)
        elif conf.algorithm == "frontier":
            made = frontier.generate(rows, c, flist)
        if made is None:
            if conf.algorithm in ("native", "frontier"):
                raise ValueError(f"{conf.algorithm} can't run this expression with this dictionary")
            made = kernel.generate(rows, c, flist, conf.max_outputs)
        found = made.groupBy("pattern").agg(F.sum("weight").alias("support")).where(F.col("support") >= conf.min_support)
        return Patterns(found, self.dictionary)

    def mine_traditional(self, min_support: int, max_gap: int, max_length: int, generalise: bool = False, algorithm: str = "growth", begin: int | None = None, end: int | None = None, gaps: bool = False) -> Patterns:
        """Subsequences of up to max_length items with at most max_gap items between neighbours. algorithm: growth (by prefixes), lists (joins
        of id lists) or expression (the equivalent pattern expression). begin and end keep patterns whose largest fid is in that range.
        gaps: a negative number -n among the items stands for n items that are left out (not for expressions)."""
        if algorithm == "expression":
            if gaps:
                raise ValueError("pattern expressions don't know compressed gaps")
            out = self.mine(language.traditional(max_gap, max_length, generalise), min_support)
        elif algorithm in ("growth", "lists"):
            out = Patterns(traditional.mine(self.rows, self.dictionary, min_support, max_gap, max_length, generalise, gaps, algorithm == "lists"), self.dictionary)
        else:
            raise ValueError("algorithm must be growth, lists or expression")
        if begin is None and end is None:
            return out
        return Patterns(traditional.pivoted(out.found, self.dictionary, begin or 0, (1 << 31) - 1 if end is None else end), self.dictionary)

    def outputs(self, pattern: str, max_outputs: int = kernel.MAX_OUTPUTS) -> DataFrame:
        """(seq_id, pattern string of gids): the distinct outputs of each sequence."""
        return kernel.outputs_of_each(self.rows, compile_(pattern, self.dictionary), max_outputs)


class Patterns:
    """The result of mining. found: (pattern string of gids, support bigint)."""

    def __init__(self, found: DataFrame, dictionary: Dictionary):
        self.found, self.dictionary = found, dictionary

    def gids(self) -> DataFrame:
        """(pattern array<int>, support)."""
        return self.found.select(F.split("pattern", " ").cast("array<int>").alias("pattern"), "support")

    def sids(self) -> DataFrame:
        """(pattern array<string>, support)."""
        return self.dictionary.translate(self.gids(), "pattern", "sid")

    def fids(self) -> DataFrame:
        return self.dictionary.translate(self.gids(), "pattern", "fid")

    def text(self) -> DataFrame:
        """(pattern string, support): sids joined by spaces."""
        return self.sids().select(F.concat_ws(" ", "pattern").alias("pattern"), "support")

    def ordered(self) -> DataFrame:
        """By falling support, then items."""
        return self.gids().orderBy(F.col("support").desc(), "pattern")

    def stats(self) -> DataFrame:
        """(patterns, frequency): how many there are and their total support."""
        return self.found.agg(F.count("*").alias("patterns"), F.coalesce(F.sum("support"), F.lit(0)).cast("bigint").alias("frequency"))

    def sequences(self) -> Sequences:
        """The patterns as sequences weighted by their support, to be mined again."""
        rows = written(self.gids().select(F.monotonically_increasing_id().alias("seq_id"), F.col("pattern").alias("items"), F.col("support").alias("weight")), "patterns")
        return Sequences(rows, self.dictionary)
