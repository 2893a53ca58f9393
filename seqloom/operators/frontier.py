"""The transducer as a fold over the array of items, in the JVM: an accumulator of (state, output) pairs, distinct at each step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.compiled import Compiled, outputs
from .native import GENERALISATIONS


def generate(sequences: DataFrame, c: Compiled, support: int | None) -> DataFrame | None:
    """(pattern string of gids, weight) for small dictionaries, None for others. Suits expressions with few outputs a sequence."""
    one = c.dictionary.by_gid(outputs(c.dictionary, c.fst.labels, support), "outs", GENERALISATIONS * len(c.fst.labels))
    if one is None:
        return None
    rows = sequences.select("items", "weight").crossJoin(F.broadcast(one))  # a single row with one array

    def branch(s: int) -> str:
        parts = []
        for a, t in c.fst.moves[s]:
            same = f"array(named_struct('s', {t}, 'o', f.o))"
            more = f"transform(w[{a}], x -> named_struct('s', {t}, 'o', ltrim(concat(f.o, ' ', string(x)))))"
            parts.append(f"CASE WHEN w[{a}] IS NULL THEN filter(array(f), y -> false) ELSE {more if c.fst.labels[a].capture else same} END")
        return f"concat({', '.join(parts)})" if parts else "filter(array(f), y -> false)"

    step = "CASE f.s " + " ".join(f"WHEN {s} THEN {branch(s)}" for s in range(c.fst.n)) + " ELSE filter(array(f), y -> false) END"
    fold = f"aggregate(transform(items, x -> try_element_at(__at, x + 1)), array(named_struct('s', 0, 'o', '')), (acc, w) -> array_distinct(flatten(transform(acc, f -> {step}))))"
    ends = ", ".join(map(str, sorted(c.fst.finals))) or "-1"
    found = f"array_distinct(transform(filter({fold}, f -> f.s IN ({ends}) AND f.o <> ''), f -> f.o))"
    return rows.select(F.explode(F.expr(found)).alias("pattern"), "weight")
