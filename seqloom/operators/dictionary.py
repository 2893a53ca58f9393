"""Dictionaries: items, their hierarchy (a DAG), frequencies and identifiers, as DataFrames."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from ..plans.patex import Item, PatExError
from ..session import small, written
from . import chunks

SCHEMA = "gid int, sid string, dfreq bigint, cfreq bigint, parents array<int>, properties map<string,string>, fid int"
MAX_DEPTH = 1000
#: Places of an array by gid that may go to every executor, and items that a map may hold, which is searched from its start.
PLACES, MAPPED = 500_000, 200


class DictionaryError(ValueError):
    """Items that contradict each other or an unknown identifier."""


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with a column that numbers its rows from 1 in this order, by a distributed sort and the sizes of its partitions."""
    done = written(df.orderBy(*order).withColumn("__m", F.monotonically_increasing_id()), "ranked")
    sizes = sorted(done.groupBy(F.shiftright("__m", 33).alias("p")).count().collect())  # a row a partition
    at, rows = 0, []
    for r in sizes:
        rows.append((r["p"], at))
        at += r["count"]
    bases = F.broadcast(df.sparkSession.createDataFrame(rows, "__p long, __base long"))
    done = done.withColumn("__p", F.shiftright("__m", 33)).join(bases, "__p")
    return done.withColumn(name, (F.col("__base") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("int")).drop("__m", "__p", "__base")


class Dictionary:
    """Immutable; every operation returns a new one. items has the columns of SCHEMA; parents hold gids."""

    def __init__(self, items: DataFrame):
        self.items = items
        self.spark: SparkSession = items.sparkSession
        self._closure: DataFrame | None = None
        self._size: int | None = None

    # making

    @staticmethod
    def of(spark: SparkSession, rows: Iterable[tuple]) -> Dictionary:
        """From (sid, [parent sids]) or (gid, sid, [parent sids]) tuples; gids count from 1 where none is given."""
        rows = [(r if len(r) == 3 else (i + 1, *r)) for i, r in enumerate(rows)]
        gid = {}
        for g, sid, _ in rows:
            if sid in gid or g in gid.values() or g < 0 or sid is None:
                raise DictionaryError(f"item {sid!r} with gid {g} exists or is invalid")
            gid[sid] = g
        for _, sid, parents in rows:
            if missing := [p for p in parents if p not in gid]:
                raise DictionaryError(f"unknown parents of {sid!r}: {missing}")
        return Dictionary(spark.createDataFrame([(g, s, 0, 0, [gid[p] for p in ps], {}, None) for g, s, ps in rows], SCHEMA))

    @staticmethod
    def from_data(sequences: DataFrame, parents: DataFrame | None = None, items: str = "items", weight: str | None = "weight", seen: DataFrame | None = None) -> Dictionary:
        """From rows with an array of sids, and edges (child, parent) of sids that may name further items. Whole-number sids keep
        their number as gid; the others follow in alphabetical order. seen: (sid) of the items of the rows, where these are known."""
        if seen is None:
            seen = sequences.select(F.explode(items).alias("sid"))
        if parents is not None:
            parents = written(parents.select("child", "parent").distinct(), "links")
            seen = seen.unionByName(parents.select(F.col("child").alias("sid"))).unionByName(parents.select(F.col("parent").alias("sid")))
        sids = written(seen.where("sid IS NOT NULL").distinct(), "sids")
        number = F.when(F.col("sid").rlike(r"^(0|[1-9]\d{0,8})$"), F.col("sid").cast("int"))
        numbered = sids.withColumn("gid", number)
        top = numbered.agg(F.max("gid")).first()[0] or 0
        rest = ranked(numbered.where("gid IS NULL").drop("gid"), [F.col("sid")], "gid").withColumn("gid", F.col("gid") + F.lit(top))
        ids = written(numbered.where("gid IS NOT NULL").unionByName(rest.select("sid", "gid")), "ids")
        links = None
        if parents is not None:
            up = ids.select(F.col("sid").alias("parent"), F.col("gid").alias("p"))
            links = parents.join(small(up), "parent").groupBy(F.col("child").alias("sid")).agg(F.sort_array(F.collect_set("p")).alias("parents"))
        table = ids if links is None else ids.join(links, "sid", "left")
        if links is None:
            table = table.withColumn("parents", F.lit(None).cast("array<int>"))
        empty = F.coalesce("parents", F.array().cast("array<int>")).alias("parents")
        out = Dictionary(written(table.select("gid", "sid", F.lit(0).cast("bigint").alias("dfreq"), F.lit(0).cast("bigint").alias("cfreq"), empty, F.create_map().cast("map<string,string>").alias("properties"), F.lit(None).cast("int").alias("fid")), "dictionary"))
        return out

    def with_items(self, items: DataFrame) -> Dictionary:
        return Dictionary(items.select(*self.items.columns))

    def with_item(self, sid: str, parents: Iterable[str] = (), gid: int | None = None) -> Dictionary:
        """With one more item, below known ones; without a gid it gets the next free one."""
        rows = [Item("sid", p, (0, 0)) for p in parents]
        try:
            up = [self.find(rows)["sid", p][1] for p in dict.fromkeys(parents)] if rows else []
        except PatExError as e:
            raise DictionaryError(str(e)) from e
        if gid is None:
            gid = (self.items.agg(F.max("gid")).first()[0] or 0) + 1
        if not self.items.where((F.col("sid") == sid) | (F.col("gid") == gid)).isEmpty():
            raise DictionaryError(f"item {sid!r} with gid {gid} exists")
        return self.with_items(self.items.unionByName(self.spark.createDataFrame([(gid, sid, 0, 0, up, {}, None)], SCHEMA)))

    def with_parent(self, child: str, parent: str) -> Dictionary:
        """With one more link; DictionaryError if it is unknown or closes a cycle."""
        try:
            ids = {k[1]: v[1] for k, v in self.find([Item("sid", x, (0, 0)) for x in (child, parent)]).items() if k[0] == "sid"}
        except PatExError as e:
            raise DictionaryError(str(e)) from e
        more = F.array_union("parents", F.array(F.lit(ids[parent])))
        return self.with_items(self.items.withColumn("parents", F.when(F.col("gid") == ids[child], more).otherwise(F.col("parents")))).checked()

    def checked(self) -> Dictionary:
        """Itself, unless gids or sids repeat, parents are unknown or the hierarchy has a cycle."""
        for c in ("gid", "sid"):
            if r := self.items.groupBy(c).count().where("count > 1").first():
                raise DictionaryError(f"{c} {r[0]!r} isn't unique")
        known = self.items.select(F.col("gid").alias("parent"))
        if r := self.edges().join(known, "parent", "left_anti").first():
            raise DictionaryError(f"unknown parent {r['parent']} of {r['child']}")
        self.closure()
        return self

    # structure

    def by_gid(self, table: DataFrame, value: str, per_item: int = 1) -> DataFrame | None:
        """One row with an array that holds, at gid + 1, what a table (gid, value) has for the gid, for a broadcast; None if gids are too
        large or too sparse for that. per_item: how many numbers a value may have on average."""
        top = self.items.agg(F.max("gid")).first()[0]
        if top is None or (top + 1) * per_item > PLACES or top > 4 * self.size() + 1000:
            return None
        places = self.spark.range(top + 1).select(F.col("id").cast("int").alias("gid")).join(table.select("gid", value), "gid", "left")
        return places.agg(F.transform(F.sort_array(F.collect_list(F.struct("gid", F.struct(value).alias("v")))), lambda x: x["v"][value]).alias("__at"))

    def size(self) -> int:
        if self._size is None:
            self._size = self.items.count()
        return self._size

    def edges(self) -> DataFrame:
        """(child, parent) gids."""
        return self.items.select(F.col("gid").alias("child"), F.explode(F.array_distinct("parents")).alias("parent"))

    def closure(self) -> DataFrame:
        """(gid, anc, depth): each item with itself and all its ancestors, once; depth: the longest way up. Each round goes up a level."""
        if self._closure is None:
            own = self.items.select("gid", F.col("gid").alias("anc"), F.lit(0).alias("depth"))
            up = written(self.edges(), "edges")
            if up.isEmpty():
                self._closure = own
                return own
            steps, front, k = [own], written(up.select(F.col("child").alias("gid"), F.col("parent").alias("anc")).distinct(), "front"), 1
            while not front.isEmpty():
                if k > MAX_DEPTH or not front.where("gid = anc").isEmpty():
                    raise DictionaryError("the hierarchy has a cycle")
                steps.append(front.withColumn("depth", F.lit(k)))
                front = written(front.join(up.select(F.col("child").alias("anc"), F.col("parent").alias("next")), "anc").select("gid", F.col("next").alias("anc")).distinct(), "front")
                k += 1
            all_ = steps[0]
            for s in steps[1:]:
                all_ = all_.unionByName(s)
            self._closure = written(all_.groupBy("gid", "anc").agg(F.max("depth").alias("depth")), "closure")
        return self._closure

    def descendants(self, *gids: int) -> DataFrame:
        """(gid) of these items and everything below them."""
        return self.closure().where(F.col("anc").isin(list(gids))).select("gid").distinct()

    def ancestors(self, *gids: int) -> DataFrame:
        """(gid) of these items and everything above them."""
        return self.closure().where(F.col("gid").isin(list(gids))).select(F.col("anc").alias("gid")).distinct()

    def below_fid(self, fid: int) -> DataFrame:
        """(gid) of the items that are or have an ancestor with a smaller fid."""
        return self.closure().join(self.items.where(F.col("fid") < fid).select(F.col("gid").alias("anc")), "anc", "left_semi").select("gid").distinct()

    def neighbours(self) -> DataFrame:
        """(fid, gid, next, previous): the items in the order of fids with the fids beside them, null at the ends."""
        own = self.items.select("fid", "gid")
        after = own.select(F.col("fid").alias("next"), (F.col("fid") - 1).alias("fid"))
        before = own.select(F.col("fid").alias("previous"), (F.col("fid") + 1).alias("fid"))
        return own.join(after, "fid", "left").join(before, "fid", "left")

    def children(self, gid: int) -> DataFrame:
        return self.items.where(F.array_contains("parents", gid))

    def leaves(self) -> DataFrame:
        return self.items.join(self.edges().select(F.col("parent").alias("gid")), "gid", "left_anti")

    def is_forest(self) -> bool:
        return self.items.where("size(array_distinct(parents)) > 1").isEmpty()

    def restrict(self, gids: DataFrame) -> Dictionary:
        """Only these items (gid), and the direct links between them."""
        keep = gids.select("gid").distinct()
        kept = self.items.join(keep, "gid", "left_semi")
        links = self.edges().join(keep.withColumnRenamed("gid", "parent"), "parent", "left_semi").groupBy(F.col("child").alias("gid")).agg(F.sort_array(F.collect_set("parent")).alias("kept"))
        return self.with_items(kept.join(links, "gid", "left").withColumn("parents", F.coalesce("kept", F.array().cast("array<int>"))))

    def merge(self, other: Dictionary) -> Dictionary:
        """Matches by sid and adds frequencies; a gid that is taken is replaced by a new one. Error where parents differ."""
        mine, theirs = (d._with_parent_sids() for d in (self, other))
        both = mine.withColumn("side", F.lit(0)).unionByName(theirs.withColumn("side", F.lit(1)))
        merged = both.groupBy("sid").agg(F.sum("dfreq").alias("dfreq"), F.sum("cfreq").alias("cfreq"), F.min(F.struct("side", "gid")).alias("id"), F.count_distinct("up").alias("kinds"), F.first("up").alias("up"), F.first("properties").alias("properties"))
        merged = written(merged, "merged")
        if r := merged.where("kinds > 1").first():
            raise DictionaryError(f"parents of {r['sid']!r} differ")
        taken = self.items.select("gid")
        first = merged.where("id.side = 0").withColumn("gid", F.col("id.gid"))
        later = merged.where("id.side = 1").withColumn("gid", F.col("id.gid"))
        free = later.join(taken, "gid", "left_anti")
        clash = later.join(taken, "gid", "left_semi")
        top = first.select("gid").unionByName(free.select("gid")).agg(F.max("gid")).first()[0] or 0
        moved = ranked(clash.drop("gid"), [F.col("sid")], "gid").withColumn("gid", F.col("gid") + F.lit(top))
        cols = ["gid", "sid", "dfreq", "cfreq", "up", "properties"]
        rows = written(first.select(*cols).unionByName(free.select(*cols)).unionByName(moved.select(*cols)), "merged")
        ids = rows.select(F.col("sid").alias("p"), F.col("gid").alias("pg"))
        links = rows.select("sid", F.explode("up").alias("p")).join(ids, "p").groupBy("sid").agg(F.sort_array(F.collect_list("pg")).alias("parents"))
        out = rows.join(links, "sid", "left").withColumn("parents", F.coalesce("parents", F.array().cast("array<int>"))).withColumn("fid", F.lit(None).cast("int"))
        return self.with_items(out)

    def _with_parent_sids(self) -> DataFrame:
        names = self.items.select(F.col("gid").alias("parent"), F.col("sid").alias("name"))
        up = self.edges().join(names, "parent").groupBy(F.col("child").alias("gid")).agg(F.sort_array(F.collect_list("name")).alias("up"))
        return self.items.join(up, "gid", "left").withColumn("up", F.coalesce("up", F.array().cast("array<string>")))

    # frequencies and fids

    def clear_freqs(self) -> Dictionary:
        return self.with_items(self.items.withColumns({"dfreq": F.lit(0).cast("bigint"), "cfreq": F.lit(0).cast("bigint")}))

    def with_freqs(self, freqs: DataFrame, add: bool = False) -> Dictionary:
        """With the frequencies of (gid, dfreq, cfreq), or these added to its own; items that aren't in it keep theirs. fids stay."""
        new = freqs.groupBy("gid").agg(F.sum("dfreq").alias("__d"), F.sum("cfreq").alias("__c"))
        value = lambda own, more: F.when(F.col(more).isNull(), F.col(own)).otherwise(F.col(more) + (F.col(own) if add else 0)).cast("bigint")
        rows = self.items.join(new, "gid", "left").withColumns({"dfreq": value("dfreq", "__d"), "cfreq": value("cfreq", "__c")})
        return self.with_items(rows)

    def item_freqs(self, sequences: DataFrame) -> DataFrame:
        """(gid, dfreq, cfreq) of rows (items array<int>, weight): weights of the sequences that hold an item or a descendant, and of its
        occurrences."""
        up = self.closure()
        if up.where("depth > 0").isEmpty():
            return chunks.frequencies(sequences, None).join(small(self.items.select("gid"), self.size()), "gid", "left_semi")
        return chunks.frequencies(sequences, up)

    def recompute(self, sequences: DataFrame) -> Dictionary:
        """Frequencies as in the sequences, 0 for unseen items, and new fids."""
        freqs = self.item_freqs(sequences)
        rows = self.items.drop("dfreq", "cfreq").join(freqs, "gid", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("dfreq", "cfreq")})
        out = self.with_items(rows)
        out._closure = self._closure
        return out.recompute_fids()

    def recompute_fids(self) -> Dictionary:
        """fids from 1 by falling dfreq; parents come before children as they're less deep where frequencies tie."""
        depth = self.closure().groupBy("gid").agg(F.max("depth").alias("__d"))
        rows = self.items.drop("fid").join(depth, "gid")
        out = self.with_items(written(ranked(rows, [F.col("dfreq").desc(), F.col("__d"), F.col("gid")], "fid").select(*self.items.columns), "dictionary"))
        out._closure = self._closure
        return out

    def has_consistent_fids(self) -> bool:
        """Whether dfreq never grows with fid and parents come before children."""
        a = self.items.select(F.col("gid").alias("child"), F.col("fid").alias("f"), F.col("dfreq").alias("d"))
        b = self.items.select(F.col("gid").alias("parent"), F.col("fid").alias("pf"))
        if not self.edges().join(a, "child").join(b, "parent").where("pf >= f").isEmpty():
            return False
        pairs = self.items.select("fid", "dfreq").join(self.items.select((F.col("fid") - 1).alias("fid"), F.col("dfreq").alias("next")), "fid")
        return self.items.where("fid IS NULL").isEmpty() and pairs.where("next > dfreq").isEmpty()

    def last_fid_above(self, support: int) -> int:
        """The largest fid of an item with at least this dfreq; -1 if there is none."""
        r = self.items.where(F.col("dfreq") >= support).agg(F.max("fid")).first()[0]
        return -1 if r is None else r

    def largest_root_fid(self) -> int:
        r = self.items.where("size(parents) = 0").agg(F.max("fid")).first()[0]
        return -1 if r is None else r

    def frequent(self, support: int) -> DataFrame:
        return self.items.where(F.col("dfreq") >= support)

    # lookups

    def find(self, items: Iterable[Item]) -> dict[tuple[str, str], tuple[int | None, int, str]]:
        """(kind, ref) -> (fid, gid, sid) of the items of a pattern expression; PatExError for unknown ones."""
        items = list(items)
        if not items:
            return {}
        sids = [i.ref for i in items if i.kind == "sid"]
        gids, fids = ([int(i.ref) for i in items if i.kind == k] for k in ("gid", "fid"))
        rows = self.items.where(F.col("sid").isin(sids) | F.col("gid").isin(gids) | F.col("fid").isin(fids)).select("fid", "gid", "sid").collect()
        out = {}
        for r in rows:
            for kind, ref in (("sid", r["sid"]), ("gid", str(r["gid"])), ("fid", str(r["fid"]))):
                out[kind, ref] = (r["fid"], r["gid"], r["sid"])
        for i in items:
            if (i.kind, str(int(i.ref)) if i.kind != "sid" else i.ref) not in out:
                raise PatExError(f"{i.at[0]}:{i.at[1]}: unknown item {i.ref!r}")
        return out

    def lookup(self, column: str, values: Iterable) -> DataFrame:
        """Items by fid, gid or sid."""
        return self.items.where(F.col(column).isin(list(values)))

    def translate(self, df: DataFrame, column: str, to: str, of: str = "gid", unknown: str = "error", cut: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
        """df with an array column of one kind of identifiers replaced by another kind's. Unknown ones are an error, dropped, or -1.

        Where ids are gids that fit an array, or there are few items, a table goes to all executors; else the distinct items of chunks
        are joined. cut: df in chunks, where that was made before.
        """
        kind = dict(self.items.dtypes)[to]
        if unknown == "error":
            missing = lambda x: F.raise_error(F.concat(F.lit(f"unknown {of} "), F.coalesce(x.cast("string"), F.lit("null")))).cast(kind)
        table, at = None, None
        if self.size() <= MAPPED:
            rows = self.items.select(of, to).collect()
            table = F.create_map(*[F.lit(x) for r in rows for x in (r[0], r[1])]) if rows else F.create_map().cast(f"map<{dict(self.items.dtypes)[of]},{kind}>")
            look = lambda x: F.try_element_at(table, x)
        elif of == "gid" and (at := self.by_gid(self.items, to)) is not None:
            df = df.crossJoin(F.broadcast(at))  # a single row
            look = lambda x: F.when(x >= 0, F.try_element_at("__at", x + 1))
        if table is not None or at is not None:
            if unknown == "error":
                found = F.transform(column, lambda x: F.coalesce(look(x), missing(x)))
            elif unknown == "drop":
                found = F.filter(F.transform(column, look), lambda x: x.isNotNull())
            else:
                found = F.transform(column, lambda x: F.coalesce(look(x), F.lit(-1).cast(kind)))
            return df.withColumn(column, found).drop("__at")
        target = self.items.select(F.col(of).alias("key"), F.col(to).alias("__to"))

        def run(rows: pa.Table, found: pa.Table) -> pa.Table:
            values, sizes = chunks.flat(rows.column(column))
            got = found.column("__to").combine_chunks().take(pc.index_in(values, found.column("key").combine_chunks()))
            lost = pc.is_null(got)
            if unknown == "error" and got.null_count:
                raise DictionaryError(f"unknown {of} {values.filter(lost)[0].as_py()}")
            if unknown == "drop":
                row = np.repeat(np.arange(len(sizes)), sizes)[~lost.to_numpy(zero_copy_only=False)]
                got, sizes = got.drop_null(), np.bincount(row, minlength=len(sizes))
            elif unknown != "error":
                got = pc.fill_null(got, pa.scalar(-1).cast(got.type))
            return rows.set_column(rows.column_names.index(column), column, chunks.lists(got, sizes))

        schema = StructType([StructField(f.name, ArrayType(self.items.schema[to].dataType) if f.name == column else f.dataType) for f in df.schema])
        return chunks.looked_up(cut or chunks.cut(df, column), target, run, schema)

    # storing

    def save(self, path: str) -> None:
        self.items.write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Dictionary:
        return Dictionary(spark.read.schema(SCHEMA).parquet(path))
