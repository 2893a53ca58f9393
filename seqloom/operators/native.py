"""Bounded pattern expressions as column expressions: every form of fixed length slides over the array of items inside the JVM."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.automaton import Label
from ..plans.compiled import NAMED, Compiled, outputs

#: Numbers that an item's generalisations have on average, at most, in the array that goes to every executor.
GENERALISATIONS = 8


def plan(c: Compiled, support: int | None) -> tuple[list[list[Label]], dict[Label, list[int] | None]] | None:
    """The forms and the items that each label's condition names (None: any), or None where this way isn't open."""
    forms = c.forms()
    if forms is None:
        return None
    forms = [f for f in forms if any(a.capture for a in f)]
    named: dict[Label, list[int] | None] = {}
    for a in {a for f in forms for a in f}:
        if a.item is None:
            named[a] = None
        elif a.exact and not a.constant:
            named[a] = [a.item]
        else:
            rows = c.dictionary.descendants(a.item).limit(NAMED + 1).collect()
            if len(rows) > NAMED:
                return None
            named[a] = sorted(r["gid"] for r in rows)
    return forms, named


def generate(sequences: DataFrame, c: Compiled, support: int | None) -> DataFrame | None:
    """(pattern string of gids, weight): each output of each sequence once; None where the expression isn't of this kind."""
    planned = plan(c, support)
    if planned is None:
        return None
    forms, named = planned
    rows = sequences.select("items", "weight")
    wide = sorted({a for a in named if a.generalise and not a.constant}, key=repr)
    if wide:
        table = outputs(c.dictionary, wide, support)
        one = c.dictionary.by_gid(table, "outs", GENERALISATIONS * len(wide))
        if one is None:
            return None
        rows = rows.crossJoin(F.broadcast(one))  # a single row with one array
        rows = rows.withColumn("__wide", F.expr("transform(items, x -> try_element_at(__at, x + 1))")).drop("__at")
    columns = [_form(f, named, wide, c.tree.start, c.tree.end) for f in forms]
    if not columns:
        return rows.select(F.lit("").alias("pattern"), "weight").where("false")
    all_ = columns[0] if len(columns) == 1 else f"concat({', '.join(columns)})"
    return rows.select(F.explode(F.expr(f"array_distinct({all_})")).alias("pattern"), "weight")


def _form(form: list[Label], named: dict, wide: list[Label], start: bool, end: bool) -> str:
    k = len(form)
    conditions, writes = [], []
    for j, a in enumerate(form):
        at = f"items[i + {j}]"
        if (gids := named[a]) is not None:
            conditions.append(f"{at} = {gids[0]}" if len(gids) == 1 else f"{at} IN ({', '.join(map(str, gids))})" if gids else "false")
        if a.capture:
            if a.constant:
                writes.append(f"array('{a.item}')")
            elif a.generalise:
                conditions.append(f"__wide[i + {j}][{wide.index(a)}] IS NOT NULL")
                writes.append(f"transform(__wide[i + {j}][{wide.index(a)}], o -> string(o))")
            else:
                writes.append(at)
    first = "IF(size(items) >= {k}, {a}, array())".format(k=k, a="array(0)" if start and not end else f"array(size(items) - {k})" if end and not start else "array(0)" if start else f"sequence(0, size(items) - {k})")
    if start and end:
        first = f"IF(size(items) = {k}, array(0), array())"
    places = f"filter({first}, i -> {' AND '.join(conditions)})" if conditions else first
    if not any("(" in w for w in writes):
        return f"transform({places}, i -> concat_ws(' ', {', '.join(f'string({w})' for w in writes)}))"
    out = ""
    for w in writes:
        w = w if "(" in w else f"array(string({w}))"
        out = w if not out else f"flatten(transform({out}, p -> transform({w}, q -> concat(p, ' ', q))))"
    return f"flatten(transform({places}, i -> {out}))"
