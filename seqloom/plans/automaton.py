"""Finite-state transducers without empty moves, built on the driver from syntax trees whose items are resolved to gids."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from .patex import Alt, Capture, Cat, Dot, Item, PatEx, Rep, quote


@dataclass(frozen=True)
class Label:
    """What a transition reads and writes. item None: any item. A captured label writes the item read, with generalise also its
    ancestors (below item), with constant item itself."""

    item: int | None = None
    exact: bool = False
    capture: bool = False
    generalise: bool = False

    @property
    def constant(self) -> bool:
        return self.capture and self.exact and self.generalise

    def text(self, name: Callable[[int], str] = lambda g: f"#{g}") -> str:
        s = ("." if self.item is None else name(self.item)) + "=" * self.exact + "^" * self.generalise
        return f"({s})" if self.capture else s


ANY = Label()


@dataclass
class Fst:
    """States 0..n-1, of which 0 is initial. moves[s]: (number of a label, target) pairs. done: states from which everything is
    accepted without further output."""

    n: int
    finals: frozenset[int]
    moves: list[list[tuple[int, int]]]
    labels: list[Label]
    done: frozenset[int] = field(default_factory=frozenset)

    def __str__(self) -> str:
        rows = [f"{s}{' final' if s in self.finals else ''}: " + ", ".join(f"{self.labels[a].text()} -> {t}" for a, t in self.moves[s]) for s in range(self.n)]
        return "\n".join(rows)

    def to_dot(self, name: Callable[[int], str] = lambda g: f"#{g}") -> str:
        """GraphViz text."""
        out = ["digraph g {", "  rankdir=LR; node [shape=circle]; start [shape=point]; start -> 0;"]
        out += [f"  {s} [shape=doublecircle];" for s in sorted(self.finals)]
        for s in range(self.n):
            for a, t in self.moves[s]:
                text = self.labels[a].text(name).replace('"', r"\"")
                out.append(f'  {s} -> {t} [label="{text}"];')
        return "\n".join([*out, "}"])

    def reverse(self) -> tuple[dict[int, list[tuple[int, int]]], frozenset[int]]:
        """Moves against their direction, and the states that then are initial."""
        back: dict[int, list[tuple[int, int]]] = {s: [] for s in range(self.n)}
        for s in range(self.n):
            for a, t in self.moves[s]:
                back[t].append((a, s))
        return back, self.finals

    def to_patex(self, name: Callable[[int], str] = lambda g: f"#{g}") -> str:
        """An anchored pattern expression for the same transducer, by eliminating states."""
        start, end = self.n, self.n + 1
        edge: dict[tuple[int, int], str] = {(start, 0): ""} | {(f, end): "" for f in self.finals}
        join = lambda x, y: x if y is None else y if x is None else x if x == y else f"[{x}]?" if not y else f"[{y}]?" if not x else f"[{x}|{y}]"
        for s in range(self.n):
            for a, t in self.moves[s]:
                edge[s, t] = join(self.labels[a].text(name), edge.get((s, t)))
        for q in range(self.n):
            loop = edge.pop((q, q), None)
            into = [(s, x) for (s, t), x in edge.items() if t == q]
            out = [(t, x) for (s, t), x in edge.items() if s == q]
            for s, x in into:
                for t, y in out:
                    via = " ".join(p for p in (x, f"[{loop}]*" if loop else "", y) if p)
                    edge[s, t] = join(via, edge.get((s, t)))
            edge = {(s, t): x for (s, t), x in edge.items() if q not in (s, t)}
        return f"^ {edge.get((start, end), '')} $"


def build(patex: PatEx, resolve: Callable[[Item], int], minimise: bool = True) -> Fst:
    """Thompson's construction, without empty moves, made small and annotated."""
    eps: list[set[int]] = []
    moves: list[list[tuple[Label, int]]] = []

    def state() -> int:
        eps.append(set())
        moves.append([])
        return len(eps) - 1

    def add(e, a: int, captured: bool) -> int:
        """Adds e from state a on and returns its end."""
        if isinstance(e, Capture):
            return add(e.part, a, True)
        if isinstance(e, Cat):
            for p in e.parts:
                a = add(p, a, captured)
            return a
        if isinstance(e, Alt):
            z = state()
            for p in e.parts:
                b = state()
                eps[a].add(b)
                eps[add(p, b, captured)].add(z)
            return z
        if isinstance(e, Rep):
            for _ in range(e.low):
                a = add(e.part, a, captured)
            if e.high is None:
                loop = state()
                eps[a].add(loop)
                eps[add(e.part, loop, captured)].add(loop)
                z = state()
                eps[loop].add(z)
                return z
            ends = [a]
            for _ in range(e.high - e.low):
                a = add(e.part, a, captured)
                ends.append(a)
            z = state()
            for x in ends:
                eps[x].add(z)
            return z
        if isinstance(e, Dot):
            label = Label(None, False, captured, captured and e.generalise)
        else:  # outside captures, A^ and A=^ match what A matches
            g = e.generalise
            label = Label(resolve(e), e.exact and (captured or not g), captured, captured and g)
        z = state()
        moves[a].append((label, z))
        return z

    first = state()
    if not patex.start:
        moves[first].append((ANY, first))
    inner = state()
    eps[first].add(inner)
    last = add(patex.root, inner, False)
    end = state()
    eps[last].add(end)
    if not patex.end:
        moves[end].append((ANY, end))

    def closure(s: int) -> set[int]:
        seen, todo = {s}, [s]
        while todo:
            for t in eps[todo.pop()] - seen:
                seen.add(t)
                todo.append(t)
        return seen

    close = [closure(s) for s in range(len(eps))]
    table = [{(a, t) for x in close[s] for a, t in moves[x]} for s in range(len(eps))]
    finals = {s for s in range(len(eps)) if end in close[s]}
    return finish(first, table, finals, minimise)


def finish(first: int, table: list[set], finals: set[int], minimise: bool = True) -> Fst:
    """Trims to useful states, merges states with equal futures (by partition refinement), renumbers and annotates."""
    alive, grown = set(finals), True
    while grown:
        new = {s for s in range(len(table)) if s not in alive and any(t in alive for _, t in table[s])}
        alive |= new
        grown = bool(new)
    table = [{(a, t) for a, t in row if t in alive} for row in table]
    block = [int(s in finals) for s in range(len(table))] if minimise else list(range(len(table)))
    while minimise:
        keys = [(block[s], frozenset((a, block[t]) for a, t in table[s])) for s in range(len(table))]
        number: dict = {}
        new = [number.setdefault(k, len(number)) for k in keys]
        if len(set(new)) == len(set(block)):
            break
        block = new
    order, todo = {block[first]: 0}, [first]
    rows: list[set] = [set()]
    while todo:
        s = todo.pop(0)
        for a, t in sorted(table[s], key=lambda x: (not x[0].capture, repr(x[0]), x[1])):
            if block[t] not in order:
                order[block[t]] = len(order)
                rows.append(set())
                todo.append(t)
            rows[order[block[s]]].add((a, order[block[t]]))
    labels = sorted({a for row in rows for a, _ in row}, key=lambda a: (not a.capture, repr(a)))
    number = {a: i for i, a in enumerate(labels)}
    end = frozenset(order[block[s]] for s in finals if block[s] in order)
    moves = [sorted((number[a], t) for a, t in row) for row in rows]
    done = set(end)
    while True:
        keep = {s for s in done if any(labels[a] == ANY and t in done for a, t in moves[s])}
        if keep == done:
            break
        done = keep
    return Fst(len(rows), end, moves, labels, frozenset(done))


class Dfa:
    """Deterministic acceptor over classes of items (which labels they satisfy), made state by state as it is used."""

    def __init__(self, fst: Fst):
        self.fst, self.memo = fst, {}

    def step(self, states: frozenset[int], satisfied: frozenset[int]) -> frozenset[int]:
        key = (states, satisfied)
        if key not in self.memo:
            self.memo[key] = frozenset(t for s in states for a, t in self.fst.moves[s] if a in satisfied)
        return self.memo[key]

    def table(self, classes: list[frozenset[int]], most: int) -> tuple[list[int], list[bool]] | None:
        """All states over these classes: targets (state * number of classes + class; 0 is the first state, 1 accepts whatever follows, 2
        nothing) and which accept. None beyond so many targets."""
        number: dict[frozenset[int], int] = {frozenset({0}): 0}
        rows, todo, k = {1: [1] * len(classes), 2: [2] * len(classes)}, [frozenset({0})], len(classes)

        def of(states: frozenset[int]) -> int:
            if states & self.fst.done:
                return 1
            if not states:
                return 2
            if states not in number:
                number[states] = len(number) + 2
                todo.append(states)
            return number[states]

        if number.keys() & {s for s in number if s & self.fst.done}:
            return [1] * 3 * k, [True, True, False]
        while todo:
            if (len(number) + 2) * k > most:
                return None
            states = todo.pop()
            rows[number[states]] = [of(self.step(states, c)) for c in classes]
        accept = [False] * (len(number) + 2)
        accept[1] = True
        for states, i in number.items():
            accept[i] = bool(states & self.fst.finals)
        return [t for i in range(len(accept)) for t in rows[i]], accept

    def accepts(self, classes: list[frozenset[int]]) -> bool:
        states = frozenset({0})
        for c in classes:
            if states & self.fst.done:
                return True
            states = self.step(states, c)
            if not states:
                return False
        return bool(states & self.fst.finals)


__all__ = ["ANY", "Dfa", "Fst", "Label", "build", "quote"]
