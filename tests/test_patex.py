import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqloom.operators.kernel import Runner, TooManyOutputs
from seqloom.plans import patex as P
from seqloom.plans.automaton import Dfa, Label, build

# items 1..6: 1 above 2 and 3, 4 above 3 (a DAG) and 5
UP = {1: {1}, 2: {2, 1}, 3: {3, 1, 4}, 4: {4}, 5: {5, 4}, 6: {6}}


def outs(t, a: Label):
    """What a label may write for item t, from the definition; None: no match."""
    if a.item is not None and (t != a.item if a.exact and not a.constant else a.item not in UP[t]):
        return None
    if not a.capture:
        return []
    if a.constant:
        return [a.item]
    if not a.generalise:
        return [t]
    return sorted(x for x in UP[t] if a.item is None or a.item in UP[x])


def brute(e, seq):
    """All (end, output) from each start, by the meaning of expressions."""

    def match(e, i, cap):
        if isinstance(e, P.Capture):
            return match(e.part, i, True)
        if isinstance(e, P.Alt):
            return set().union(*(match(p, i, cap) for p in e.parts))
        if isinstance(e, P.Cat):
            now = {(i, ())}
            for p in e.parts:
                now = {(k, o + q) for j, o in now for k, q in match(p, j, cap)}
            return now
        if isinstance(e, P.Rep):
            now, found = {(i, ())}, set()
            for n in itertools.count():
                if n >= e.low:
                    found |= now
                if e.high is not None and n >= e.high or n > e.low + len(seq) + 1:
                    return found
                now = {(k, o + q) for j, o in now for k, q in match(e.part, j, cap)}
        if i >= len(seq):
            return set()
        if isinstance(e, P.Dot):
            a = Label(None, False, cap, cap and e.generalise)
        else:
            a = Label(int(e.ref), e.exact and (cap or not e.generalise), cap, cap and e.generalise)
        w = outs(seq[i], a)
        return set() if w is None else {(i + 1, (x,)) for x in w} if w else {(i + 1, ())}

    out = set()
    for i in range(len(seq) + 1) if not e.start else [0]:
        out |= {o for j, o in match(e.root, i, False) if not e.end or j == len(seq)}
    return out - {()}


def fast(e, seq):
    fst = build(e, lambda i: int(i.ref))
    return Runner(fst).run([[outs(t, a) for a in fst.labels] for t in seq])


item = st.builds(P.Item, st.just("gid"), st.sampled_from("123456"), st.booleans(), st.booleans())
leaf = st.one_of(st.builds(P.Dot, st.booleans()), item)
tree = st.recursive(leaf, lambda x: st.one_of(st.builds(P.Capture, x), st.builds(lambda a, b: P.Cat((a, b)), x, x), st.builds(lambda a, b: P.Alt((a, b)), x, x), st.builds(lambda p, n, m: P.Rep(p, n, None if m is None else n + m), x, st.integers(0, 2), st.one_of(st.none(), st.integers(0, 2)))), max_leaves=5)
expression = st.builds(lambda r, a, b: P.PatEx(P.Capture(r), a, b), tree, st.booleans(), st.booleans())


@settings(max_examples=300, deadline=None)
@given(expression, st.lists(st.integers(1, 6), max_size=5))
def test_runner_is_brute_force(e, seq):
    assert fast(e, seq) == brute(e, seq)


@settings(max_examples=200, deadline=None)
@given(expression)
def test_printing_and_parsing(e):
    again = P.parse(P.to_text(e))
    assert P.to_text(again) == P.to_text(e)


@settings(max_examples=60, deadline=None)
@given(expression, st.lists(st.integers(1, 6), max_size=4))
def test_transducer_back_to_expression(e, seq):
    fst = build(e, lambda i: int(i.ref))
    if not fst.finals or max((len(m) for m in fst.moves), default=0) > 6 or fst.n > 6:
        return
    back = fst.to_patex()
    if "^  $" == back:
        return
    assert fast(P.parse(back), seq) == fast(e, seq)


@settings(max_examples=100, deadline=None)
@given(expression, st.lists(st.integers(1, 6), max_size=5))
def test_dfa_accepts_what_has_a_run(e, seq):
    fst = build(e, lambda i: int(i.ref))
    rows = [[outs(t, a) for a in fst.labels] for t in seq]
    classes = [frozenset(i for i, o in enumerate(r) if o is not None) for r in rows]
    assert Dfa(fst).accepts(classes) == (Runner(fst).live(rows) is not None)


@pytest.mark.parametrize("text", ["", "(a", "a)", "a{3,1}", "a{}", "a{,}", "[a|]", "a b ]", "(.) ^ x", "a=b=="])
def test_errors_have_a_place(text):
    with pytest.raises(P.PatExError, match=r"\d+:\d+"):
        P.parse(text)


def test_stacked_and_nested():
    assert P.to_text(P.parse("(a+? b{2,} c{,3})")) == "('a'+? 'b'{2,} 'c'{0,3})"
    # what follows a nested capture is still captured
    assert fast(P.parse("^((#1) #6) $"), [2, 6]) == {(2, 6)}
    with pytest.warns(UserWarning, match="captures nothing"):
        P.parse("a b")


def test_dollar_belongs_to_names():
    assert P.parse("(a) $").end and not P.parse("(a$)").end
    assert P.items(P.parse("(a$)"))[0].ref == "a$"


def test_traditional_and_dot():
    assert P.traditional(2, 3, True) == "(.^)[.{0,2}(.^)]{0,2}"
    assert P.traditional(2, 1) == "(.)"
    fst = build(P.parse("(#1)"), lambda i: int(i.ref))
    assert "digraph" in fst.to_dot() and "(#1)" in str(fst)


def test_too_many_outputs_is_an_error():
    fst = build(P.parse("[.*(.)]+"), lambda i: 0)
    with pytest.raises(TooManyOutputs):
        Runner(fst, 1000).run([[[i] if a.capture else [] for a in fst.labels] for i in range(30)])
