"""From a pattern expression and a dictionary to what the mining operators run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.dictionary import Dictionary
from . import patex
from .automaton import Fst, Label, build
from .patex import Alt, Capture, Cat, Dot, Item, Rep

#: Forms (alternative fixed lengths), slots, and items named in a condition, up to which the native way is taken.
FORMS, SLOTS, NAMED = 48, 16, 2000


@dataclass
class Compiled:
    tree: patex.PatEx
    fst: Fst
    gids: dict[tuple[str, str], int]
    dictionary: Dictionary

    def label(self, e, captured: bool) -> Label:
        if isinstance(e, Dot):
            return Label(None, False, captured, captured and e.generalise)
        g = e.generalise
        return Label(self.gids[e.kind, key(e)], e.exact and (captured or not g), captured, captured and g)

    def forms(self) -> list[list[Label]] | None:
        """The expression as alternatives of fixed length, if it is bounded and there are few of them."""

        def go(e, captured: bool) -> list[list[Label]] | None:
            if isinstance(e, Capture):
                return go(e.part, True)
            if isinstance(e, Alt):
                out: list[list[Label]] = []
                for p in e.parts:
                    if (x := go(p, captured)) is None:
                        return None
                    out += x
                return dedup(out)
            if isinstance(e, Cat):
                return product([go(p, captured) for p in e.parts])
            if isinstance(e, Rep):
                if e.high is None:
                    return None
                one = go(e.part, captured)
                out = []
                for n in range(e.low, e.high + 1):
                    if (x := product([one] * n)) is None:
                        return None
                    out += x
                return dedup(out)
            return [[self.label(e, captured)]]

        def dedup(x: list[list[Label]]) -> list[list[Label]] | None:
            x = [list(t) for t in dict.fromkeys(map(tuple, x))]
            return x if len(x) <= FORMS and all(len(f) <= SLOTS for f in x) else None

        def product(parts) -> list[list[Label]] | None:
            out: list[list[Label]] = [[]]
            for p in parts:
                if p is None or (out := dedup([a + b for a in out for b in p])) is None:
                    return None
            return out

        return go(self.tree.root, False)


def key(i: Item) -> str:
    return i.ref if i.kind == "sid" else str(int(i.ref))


def compile_(text: str, dictionary: Dictionary, minimise: bool = True) -> Compiled:
    """Parses, resolves and translates on the driver, so that errors show before anything runs."""
    tree = patex.parse(text)
    found = dictionary.find(patex.items(tree))
    gids = {k: v[1] for k, v in found.items()}
    return Compiled(tree, build(tree, lambda i: gids[i.kind, key(i)], minimise), gids, dictionary)


def rewrite(text: str, dictionary: Dictionary, kind: str) -> str:
    """The expression with all items written as fid, gid or sid."""
    tree = patex.parse(text)
    found = dictionary.find(patex.items(tree))
    return patex.rewrite(tree, kind, lambda i: found[i.kind, key(i)])


def outputs(dictionary: Dictionary, labels: list[Label], support: int | None) -> DataFrame:
    """(gid, outs array<array<int>>): for each item and label, null where the label doesn't match, else what it may write (empty: nothing).

    With a support, items that aren't frequent are never written, and captured labels that could write nothing else don't match.
    """
    rows = dictionary.items.select("gid")
    up = dictionary.closure().select("gid", "anc")
    if support is not None:
        ok = dictionary.frequent(support).select(F.col("gid").alias("anc"))
        writable = up.join(ok, "anc", "left_semi")
    else:
        writable = up
    anc = up.groupBy("gid").agg(F.collect_set("anc").alias("anc"))
    out = writable.groupBy("gid").agg(F.sort_array(F.collect_set("anc")).alias("out"))
    rows = rows.join(anc, "gid").join(out, "gid", "left").withColumn("out", F.coalesce("out", F.array().cast("array<int>")))
    below = {}
    for a in {a.item for a in labels if a.generalise and not a.constant and a.item is not None}:
        # what (A^) may write: ancestors of the item that are A or below it
        part = writable.join(dictionary.descendants(a).withColumnRenamed("gid", "anc"), "anc", "left_semi").groupBy("gid").agg(F.sort_array(F.collect_set("anc")).alias(f"below_{a}"))
        rows = rows.join(part, "gid", "left")
        below[a] = F.coalesce(f"below_{a}", F.array().cast("array<int>"))
    none = F.lit(None).cast("array<int>")
    empty = F.array().cast("array<int>")

    def column(a: Label):
        if a.item is None:
            match = F.lit(True)
        elif a.exact and not a.constant:
            match = F.col("gid") == a.item
        else:
            match = F.array_contains("anc", a.item)
        if not a.capture:
            return F.when(match, empty).otherwise(none)
        if a.constant:
            writes = F.filter("out", lambda x: x == a.item)
        elif not a.generalise:
            writes = F.filter("out", lambda x: x == F.col("gid"))
        else:
            writes = F.col("out") if a.item is None else below[a.item]
        return F.when(match & (F.size(writes) > 0), writes).otherwise(none)

    return rows.select("gid", F.array(*[column(a) for a in labels]).alias("outs"))
