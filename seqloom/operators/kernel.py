"""Any pattern expression: an Arrow kernel that runs the transducer over each sequence.

A backward pass finds from which states a final one can be reached; the forward pass only visits those, and visits a state at a
position once for each output so far. Outputs are pre-aggregated in each task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.automaton import Fst
from ..plans.compiled import Compiled, outputs
from ..session import join_items, written

#: Outputs of one sequence beyond which the kernel raises an error; it never leaves any out.
MAX_OUTPUTS = 5_000_000
HELD = 200_000
#: Numbers in the table of what items may write that go to every worker.
CELLS = 500_000


class TooManyOutputs(RuntimeError):
    """A sequence has so many outputs that another way to mine (growth) or a tighter expression is called for."""


class Runner:
    """Runs a transducer over lists of what each label may write at each position (None: the label doesn't match)."""

    def __init__(self, fst: Fst, max_outputs: int = MAX_OUTPUTS):
        self.moves, self.finals, self.done, self.max = [tuple(m) for m in fst.moves], fst.finals, fst.done, max_outputs
        self.writes = [any(fst.labels[a].capture for a, _ in m) for m in fst.moves]

    def live(self, seq: list) -> list[set[int]] | None:
        """For each position the states from which the rest can be accepted; None if the sequence isn't accepted."""
        now, out = set(self.finals), [set(self.finals)]
        for outs in reversed(seq):
            now = {s for s, m in enumerate(self.moves) if any(t in now and outs[a] is not None for a, t in m)}
            if not now:
                return None
            out.append(now)
        out.reverse()
        return out if 0 in out[0] else None

    def run(self, seq: list) -> set[tuple[int, ...]]:
        live = self.live(seq)
        if live is None:
            return set()
        found: set[tuple[int, ...]] = set()
        now: dict[int, set[tuple[int, ...]]] = {0: {()}}
        for p, outs in enumerate(seq):
            ahead, nxt = live[p + 1], {}
            for s, prefixes in now.items():
                if s in self.done:
                    found |= prefixes
                    if not self.writes[s]:
                        continue
                for a, t in self.moves[s]:
                    o = outs[a]
                    if o is None or t not in ahead:
                        continue
                    to = nxt.setdefault(t, set())
                    if not o:
                        to |= prefixes
                    else:
                        for x in o:
                            to.update([(*q, x) for q in prefixes])
            now = nxt
            if sum(map(len, now.values())) > self.max or len(found) > self.max:
                raise TooManyOutputs(f"a sequence of {len(seq)} items has more than {self.max} outputs")
        for s, prefixes in now.items():
            if s in self.finals:
                found |= prefixes
        found.discard(())
        return found


def with_outputs(sequences: DataFrame, c: Compiled, support: int | None) -> tuple[DataFrame, dict[int, list] | None]:
    """Sequences and the table of what items may write; where that has more than CELLS numbers, sequences joined with it in a column outs.

    The joined form goes by stored row numbers, since a number that is made twice may not be the same twice. Items that the
    dictionary lacks raise an error.
    """
    table = written(outputs(c.dictionary, c.fst.labels, support), "outputs")
    cells = table.agg(F.sum(F.expr("1 + aggregate(outs, 0, (n, o) -> n + 1 + coalesce(size(o), 0))"))).first()[0] or 0
    if cells <= CELLS:
        return sequences, {r["gid"]: r["outs"] for r in table.collect()}
    keyed = written(sequences.withColumn("__s", F.monotonically_increasing_id()), "keyed")
    each = join_items(keyed.select("__s", F.posexplode("items").alias("pos", "gid")), table, "gid", "outs")
    each = each.withColumn("outs", F.coalesce("outs", F.raise_error(F.concat(F.lit("unknown gid "), F.coalesce(F.col("gid").cast("string"), F.lit("null")))).cast("array<array<int>>")))
    lists = each.groupBy("__s").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "outs"))), lambda x: x["outs"]).alias("outs"))
    return keyed.join(lists, "__s").drop("__s"), None  # a sequence without items has no output


def generate(sequences: DataFrame, c: Compiled, support: int | None, max_outputs: int = MAX_OUTPUTS) -> DataFrame:
    """(pattern string of gids, weight), partly summed within tasks; items that the dictionary lacks raise an error."""
    rows, table = with_outputs(sequences.select("items", "weight"), c, support)
    shipped = sequences.sparkSession.sparkContext.broadcast(table) if table is not None else None
    fst = c.fst

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runner, held = Runner(fst, max_outputs), {}
        look = shipped.value if shipped else None

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([" ".join(map(str, k)) for k in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["pattern", "weight"])

        for b in batches:
            seqs = b.column(b.schema.get_field_index("outs" if look is None else "items")).to_pylist()
            for seq, w in zip(seqs, b.column(b.schema.get_field_index("weight")).to_pylist()):
                for x in runner.run(seq or [] if look is None else [look[g] for g in seq or []]):
                    held[x] = held.get(x, 0) + w
                if len(held) > HELD:
                    yield flush()
                    held.clear()
        yield flush()

    cols = ["items", "weight"] if table is not None else ["outs", "weight"]
    return rows.select(*cols).mapInArrow(run, "pattern string, weight bigint")


def outputs_of_each(sequences: DataFrame, c: Compiled, max_outputs: int = MAX_OUTPUTS) -> DataFrame:
    """(seq_id, pattern string of gids): each output of each sequence."""
    rows, table = with_outputs(sequences.select("seq_id", "items"), c, None)
    shipped = sequences.sparkSession.sparkContext.broadcast(table) if table is not None else None
    fst, name = c.fst, "outs" if table is None else "items"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runner, look = Runner(fst, max_outputs), shipped.value if shipped else None
        for b in batches:
            sids, found = [], []
            for sid, seq in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for x in runner.run(seq or [] if look is None else [look[g] for g in seq or []]):
                    sids.append(sid)
                    found.append(" ".join(map(str, x)))
                if len(found) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(found, pa.string())], ["seq_id", "pattern"])
                    sids, found = [], []
            yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(found, pa.string())], ["seq_id", "pattern"])

    return rows.select("seq_id", name).mapInArrow(run, "seq_id long, pattern string")


def relevant(sequences: DataFrame, c: Compiled, support: int | None = None) -> DataFrame:
    """The sequences that the expression accepts; with a support, those that can write only frequent items."""
    from ..functions.classes import accepted

    return accepted(sequences, c, support)
