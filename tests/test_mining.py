import itertools
import random
from collections import Counter

import pytest

from seqloom import session
from seqloom.functions import classes
from seqloom.operators import dictionary as dictionary_module
from seqloom.operators import kernel
from seqloom.operators.dictionary import Dictionary, DictionaryError
from seqloom.operators.sequences import MinerConf, Sequences
from seqloom.plans.automaton import Dfa
from seqloom.plans.compiled import compile_, rewrite
from seqloom.plans.patex import PatExError

ITEMS = [("A", []), ("a1", ["A"]), ("a2", ["A"]), ("B", []), ("b1", ["B"]), ("b11", ["b1"]), ("b12", ["b1"]), ("b2", ["B"]), ("c", []), ("d", []), ("e", [])]
UP = {"A": "A", "a1": "a1 A", "a2": "a2 A", "B": "B", "b1": "b1 B", "b11": "b11 b1 B", "b12": "b12 b1 B", "b2": "b2 B", "c": "c", "d": "d", "e": "e"}
TEXTS = ["c a1 b12 e", "a1 b2 e", "d a2 a1 a2 b11 e", "d a1 B e", "e a1 b2 d", "c a1 a1 a1 b2 e"]


@pytest.fixture(scope="module")
def data(spark):
    rows = spark.createDataFrame([(i, t.split()) for i, t in enumerate(TEXTS)], "k long, items array<string>")
    return Sequences.from_columns(rows, key="k", dictionary=Dictionary.of(spark, ITEMS).checked()).recompute_dictionary()


def rows(p):
    return {r["pattern"]: r["support"] for r in p.text().collect()}


def brute(gap, length, generalise, support):
    found = Counter()
    for t in TEXTS:
        seq, mine = t.split(), set()
        for n in range(1, length + 1):
            for at in itertools.combinations(range(len(seq)), n):
                if all(b - a <= gap + 1 for a, b in zip(at, at[1:])):
                    mine.update(map(" ".join, itertools.product(*[UP[seq[i]].split() if generalise else [seq[i]] for i in at])))
        found.update(mine)
    return {k: v for k, v in found.items() if v >= support}


def test_frequencies(data):
    got = {r["sid"]: (r["dfreq"], r["cfreq"]) for r in data.dictionary.items.collect()}
    assert got == {"A": (6, 10), "a1": (6, 8), "a2": (1, 2), "B": (6, 6), "b1": (2, 2), "b11": (1, 1), "b12": (1, 1), "b2": (3, 3), "c": (2, 2), "d": (3, 3), "e": (6, 6)}
    d = data.dictionary
    assert d.has_consistent_fids() and d.is_forest() and d.last_fid_above(3) == 6 and d.last_fid_above(100) == -1


@pytest.mark.parametrize("algorithm", ["auto", "frontier", "kernel"])
@pytest.mark.parametrize("pattern,support,want", [("(a1)..", 3, {"a1": 6}), ("(a1).. $", 1, {"a1": 5}), ("^.(a1)", 1, {"a1": 4}), ("[c|d] ([A^|B=^]+) e", 2, {"A A A B": 2, "A a1 A B": 2, "A B": 2, "a1 B": 2}), ("[c|d] ([A^|B=^]+) e", 3, {})])
def test_expressions(data, algorithm, pattern, support, want):
    assert rows(data.mine(pattern, support, algorithm)) == want


@pytest.mark.parametrize("pattern,support,want", [("^.(a1)", 1, {"a1": 4}), ("[c|d] ([A^|B=^]+) e", 2, {"A A A B": 2, "A a1 A B": 2, "A B": 2, "a1 B": 2})])
def test_growth(data, pattern, support, want):
    assert rows(data.mine(pattern, support, "growth")) == want


@pytest.mark.parametrize("algorithm", ["growth", "lists", "expression"])
@pytest.mark.parametrize("support,gap,length,generalise", [(1, 2, 4, True), (3, 1, 5, True), (1, 1, 3, False)])
def test_traditional(data, algorithm, support, gap, length, generalise):
    assert rows(data.mine_traditional(support, gap, length, generalise, algorithm)) == brute(gap, length, generalise, support)


def test_flags_do_not_change_results(data):
    want = rows(data.mine("[c|d] ([A^|B=^]+) e", 2))
    for flist, prune in itertools.product((True, False), repeat=2):
        assert rows(data.mine("[c|d] ([A^|B=^]+) e", 2, "kernel", flist, prune)) == want


def test_sentences_with_a_hierarchy(spark):
    items = [("PERSON", []), ("CITY", [])] + [(p, ["PERSON"]) for p in ("Anna", "Bob", "Cathy", "Dave", "Eddie")] + [(c, ["CITY"]) for c in ("Melbourne", "Berlin", "Paris", "London", "New York City")] + [(w, []) for w in ("lives", "likes", "loves", "in")]
    texts = ["Anna lives in Melbourne", "Anna likes Bob", "Bob lives in Berlin", "Cathy loves Paris", "Cathy likes Dave", "Dave loves London"]
    lists = [t.split() for t in texts] + [["Eddie", "lives", "in", "New York City"]]
    s = Sequences.from_columns(spark.createDataFrame([(x,) for x in lists], "items array<string>"), dictionary=Dictionary.of(spark, items)).recompute_dictionary()
    assert rows(s.mine("(.^...^)", 2)) == {"PERSON lives in CITY": 3}
    assert rows(s.mine("PERSON (.*) CITY", 2)) == {"lives in": 3, "loves": 2}
    flat = Sequences.from_columns(spark.createDataFrame([(" ".join(x).split(),) for x in lists], "items array<string>"))
    assert rows(flat.mine("(..)", 2)) == {"lives in": 3}
    assert [r["line"] for r in flat.mine("(..)", 2).sequences().printed().collect()] == ["[lives in]@3"]


def test_weights_duplicates_and_empty(spark):
    df = spark.createDataFrame([(["x", "y"], 2), (["x", "y"], 3), ([], 5), (None, 1), (["x", "x", "x"], 1)], "items array<string>, w long")
    s = Sequences.from_columns(df, weight="w")
    assert rows(s.mine("(x)", 1)) == {"x": 6} and rows(s.mine("(x y)", 5)) == {"x y": 5}
    got = {r["sid"]: (r["dfreq"], r["cfreq"]) for r in s.dictionary.items.collect()}
    assert got == {"x": (6, 8), "y": (5, 5)}
    none = s.with_rows(s.rows.where("false"))
    assert rows(none.mine("(.)", 1)) == {} and rows(none.mine_traditional(1, 0, 2)) == {}


def test_errors_show_on_the_driver(data):
    with pytest.raises(PatExError, match="unknown item"):
        data.mine("(nothing)", 1)
    with pytest.raises(ValueError, match="algorithm"):
        data.mine("(.)", 1, "other")
    with pytest.raises(KeyError):
        MinerConf.of({"min.support": "1"})
    assert MinerConf.of({"min.support": "2", "pattern.expression": "(.)"}).min_support == 2


def test_rewriting(data):
    assert rewrite("(A^ #9)", data.dictionary, "sid") == "('A'^ 'c')"
    assert rewrite("(A^ c)", data.dictionary, "gid") == "(#1^ #9)"
    by_fid = rewrite("(A^) [c|d]", data.dictionary, "fid")
    assert rows(data.mine(by_fid, 1)) == rows(data.mine("(A^) [c|d]", 1))
    assert compile_("(A)", data.dictionary).fst.n == 2


def test_relevance(data):
    got = {r["seq_id"] for r in data.relevant("^ c .* e $").rows.collect()}
    assert got == {0, 5}


def test_dictionary_algebra(spark, data):
    d = data.dictionary
    sids = lambda df: {r["sid"] for r in d.items.join(df, "gid").collect()}
    assert sids(d.descendants(4)) == {"B", "b1", "b11", "b12", "b2"} and sids(d.ancestors(6)) == {"b11", "b1", "B"}
    assert {r["sid"] for r in d.leaves().collect()} == {"a1", "a2", "b11", "b12", "b2", "c", "d", "e"}
    small = d.restrict(d.items.where("sid <> 'b1'").select("gid"))
    assert {r["sid"]: r["parents"] for r in small.items.collect()}["b11"] == []
    one = Dictionary.of(spark, [("x", []), ("y", ["x"])])
    two = Dictionary.of(spark, [("z", []), ("y", ["x"]), ("x", [])])
    both = one.merge(two).checked()
    assert {r["sid"] for r in both.items.collect()} == {"x", "y", "z"}
    with pytest.raises(DictionaryError):
        one.merge(Dictionary.of(spark, [("y", []), ("x", [])]))
    with pytest.raises(DictionaryError):
        Dictionary.of(spark, [("x", ["nowhere"])])
    loop = Dictionary(spark.createDataFrame([(1, "x", 0, 0, [2], {}, None), (2, "y", 0, 0, [1], {}, None)], "gid int, sid string, dfreq bigint, cfreq bigint, parents array<int>, properties map<string,string>, fid int"))
    with pytest.raises(DictionaryError, match="cycle"):
        loop.checked()


@pytest.fixture
def many(spark):
    """2000 weighted sequences over a hierarchy, shuffled as they are read."""
    rnd = random.Random(4)
    rows = [(i, [f"i{int(rnd.paretovariate(0.6)) % 40}" for _ in range(rnd.randrange(0, 9))], i % 5 + 1) for i in range(2000)]
    items = [("X", []), ("Y", ["X"])] + [(f"i{k}", [["X"], ["Y"], []][k % 3]) for k in range(40)]
    df = spark.createDataFrame(rows, "k long, items array<string>, w long").repartition(7).orderBy("w", "items")
    return Sequences.from_columns(df, key="k", weight="w", dictionary=Dictionary.of(spark, items)).recompute_dictionary()


@pytest.mark.parametrize("advisory", ["1k", "64m"])
def test_large_dictionaries_give_the_same(many, spark, monkeypatch, advisory):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", advisory)
    try:
        patterns = ["^(.)(.)", "(Y^).*(i1)"]
        sids = sorted(map(repr, many.to_sids().collect()))
        want = [rows(many.mine(p, 20)) for p in patterns]
        chosen = [{r["seq_id"] for r in many.relevant(p).rows.collect()} for p in patterns]
        for module, name in ((kernel, "CELLS"), (dictionary_module, "PLACES"), (dictionary_module, "MAPPED"), (session, "HOT_SHARE")):
            monkeypatch.setattr(module, name, 10 if name == "HOT_SHARE" else 0)
        for p, w, c in zip(patterns, want, chosen):
            assert w and rows(many.mine(p, 20, "kernel", prune_irrelevant=True)) == w
            assert {r["seq_id"] for r in many.relevant(p).rows.collect()} == c
        assert rows(many.mine(patterns[0], 20, "growth")) == want[0]
        assert sorted(map(repr, many.to_sids().collect())) == sids
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


@pytest.mark.parametrize("pattern", ["[i0|i1]* (i2)", "^ .* (Y) [X|i3]{2,4} $", "(.)", "[[X|Y] (i1)]+ $", "^ [.? i4]* $"])
def test_relevance_is_the_automaton(many, pattern, monkeypatch):
    c = compile_(pattern, many.dictionary)
    up = {}
    for r in many.dictionary.closure().collect():
        up.setdefault(r["gid"], set()).add(r["anc"])
    fits = lambda a, g: a.item is None or (a.item == g if a.exact and not a.constant else a.item in up[g])
    dfa = Dfa(c.fst)
    want = {r["seq_id"] for r in many.rows.collect() if dfa.accepts([frozenset(i for i, a in enumerate(c.fst.labels) if fits(a, g)) for g in r["items"]])}
    assert {r["seq_id"] for r in many.relevant(pattern).rows.collect()} == want
    monkeypatch.setattr(classes, "TARGETS", 0)
    assert {r["seq_id"] for r in many.relevant(pattern).rows.collect()} == want


def test_relevance_of_long_sequences(spark):
    d = Dictionary.of(spark, [("a", []), ("b", [])])
    rows_ = spark.createDataFrame([(1, ["a"] * 100_000 + ["b"]), (2, ["a"] * 100_000), (3, ["b"]), (4, [])], "k long, items array<string>")
    s = Sequences.from_columns(rows_, key="k", dictionary=d)
    assert {r["seq_id"] for r in s.relevant("^ [a|b]* (b) $").rows.collect()} == {1, 3}
