"""The relevance filter: which sequences an expression accepts, by a deterministic automaton over classes of items.

Only the set of labels that an item satisfies matters for acceptance. Each such set is a class, a small number; the transducer, with
outputs left out, is made deterministic over the classes on the driver, and a fold over the items' classes runs it inside the JVM,
one step an item, so that sequences may have any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.automaton import Dfa
from ..plans.compiled import Compiled, outputs
from ..session import join_items, written

#: Entries of the automaton's table that go with the plan; a larger one is made as it is used, in Python workers.
TARGETS = 20_000


def accepted(sequences: DataFrame, c: Compiled, support: int | None) -> DataFrame:
    """Sequences (with all their columns) that have an accepting run; a dictionary of any size. Unknown items raise an error."""
    table = outputs(c.dictionary, c.fst.labels, support)
    sets = written(table.select("gid", F.expr("filter(transform(outs, (o, i) -> IF(o IS NULL, -1, i)), i -> i >= 0)").alias("set")), "sets")
    found = sorted(tuple(r["set"]) for r in sets.select("set").distinct().collect())  # at most 2 ** labels, in practice few
    classes = [frozenset(s) for s in found] or [frozenset()]
    known = sequences.sparkSession.createDataFrame([(list(s), k) for k, s in enumerate(found)], "set array<int>, class int")
    of = sets.join(F.broadcast(known), "set").select("gid", "class")
    missing = F.raise_error(F.lit("an item that the dictionary lacks")).cast("int")
    one = c.dictionary.by_gid(of, "class")
    if one is not None:
        coded = sequences.crossJoin(F.broadcast(one)).withColumn("__class", F.transform(F.coalesce("items", F.array().cast("array<int>")), lambda x: F.coalesce(F.try_element_at("__at", x + 1), missing))).drop("__at")
    else:
        keyed = written(sequences.withColumn("__s", F.monotonically_increasing_id()), "keyed")
        each = join_items(keyed.select("__s", F.posexplode("items").alias("pos", "gid")), of, "gid", "class").withColumn("class", F.coalesce("class", missing))
        lists = each.groupBy("__s").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "class"))), lambda x: x["class"]).alias("__class"))
        coded = keyed.join(lists, "__s", "left").withColumn("__class", F.coalesce("__class", F.array().cast("array<int>"))).drop("__s")
    made = Dfa(c.fst).table(classes, TARGETS)
    if made is None:
        return _in_workers(coded, c, classes)
    targets, accept = made
    k = len(classes)
    end = F.expr(f"aggregate(__class, 0, (s, x) -> element_at(array({', '.join(map(str, targets))}), s * {k} + x + 1))")
    return coded.where(end.isin([i for i, a in enumerate(accept) if a])).drop("__class")


def _in_workers(coded: DataFrame, c: Compiled, classes: list[frozenset[int]]) -> DataFrame:
    fst = c.fst

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dfa = Dfa(fst)
        for b in batches:
            at = b.schema.get_field_index("__class")
            yield b.filter(pa.array([dfa.accepts([classes[x] for x in seq]) for seq in b.column(at).to_pylist()], pa.bool_()))

    return coded.mapInArrow(run, coded.schema).drop("__class")
