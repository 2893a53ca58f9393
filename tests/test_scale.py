"""What mining moves and writes: rows of sequences and of results, not of places."""

import random

import pytest

from seqloom.operators import chunks, growth, traditional
from seqloom.operators import dictionary as dictionary_module
from seqloom.operators.dictionary import Dictionary
from seqloom.operators.sequences import Sequences
from seqloom.sources import etl

KINDS = 300


def shuffled(spark, run):
    """Bytes that run shuffles."""
    sc = spark.sparkContext._jsc.sc()

    def total():
        sc.listenerBus().waitUntilEmpty(10_000)
        return sum(sc.statusStore().executorList(False).apply(i).totalShuffleWrite() for i in range(sc.statusStore().executorList(False).size()))

    before = total()
    run()
    return total() - before


@pytest.fixture(scope="module")
def long(spark):
    """100,000 places in 500 sequences, below two levels of parents."""
    rnd = random.Random(7)
    rows = [(i, [f"i{int(rnd.paretovariate(0.3)) % KINDS}" for _ in range(200)], i % 3 + 1) for i in range(500)]
    items = [("X", []), ("Y", ["X"]), ("Z", [])] + [(f"i{k}", [["X"], ["Y"], ["Y", "Z"], []][k % 4]) for k in range(KINDS)]
    df = spark.createDataFrame(rows, "k long, items array<string>, w long").repartition(3)
    s = Sequences.from_columns(df, key="k", weight="w", dictionary=Dictionary.of(spark, items))
    out = s.with_rows(s.rows.localCheckpoint())
    out.dictionary.closure()
    up = {sid: {sid} for sid, _ in items}
    for sid, parents in items:
        up[sid].update(*[up[p] for p in parents])
    return out, rows, up


def test_frequencies_are_summed_before_they_are_sent(spark, long, monkeypatch):
    s, rows, up = long
    want = {}
    for _, items, w in rows:
        for a in {a for x in items for a in up[x]}:
            d, c = want.get(a, (0, 0))
            want[a] = d + w, c + w * sum(a in up[x] for x in items)
    names = {r["gid"]: r["sid"] for r in s.dictionary.items.collect()}
    got = lambda: {names[r["gid"]]: (r["dfreq"], r["cfreq"]) for r in s.dictionary.item_freqs(s.rows).collect()}
    assert got() == want
    assert shuffled(spark, got) < 30_000
    if hasattr(chunks, "SHARED"):
        monkeypatch.setattr(chunks, "SHARED", 0)
        monkeypatch.setattr(chunks, "CHUNK", 3000)
        assert got() == want


@pytest.mark.parametrize("algorithm", ["growth", "lists"])
def test_levels_write_rows_of_sequences_and_patterns(long, algorithm, monkeypatch):
    """Not a row for each place or pattern's end, which no size of a file tells."""
    s, kept = long[0], []
    monkeypatch.setattr(traditional, "written", lambda df, name, f=traditional.written: kept.append(f(df, name)) or kept[-1])
    found = s.mine_traditional(600, 1, 3, True, algorithm).found.count()
    assert found > 100 and sum(df.count() for df in kept) <= s.rows.count() + found


@pytest.mark.parametrize("algorithm", ["growth", "lists"])
@pytest.mark.parametrize("gaps", [False, True])
def test_pieces_and_joins_give_the_same(spark, algorithm, gaps, monkeypatch):
    rnd = random.Random(3)
    d = Dictionary.of(spark, [("a", []), ("b", ["a"]), ("c", ["a"]), ("d", [])])
    rows = [(i, [rnd.choice([1, 2, 3, 4, 4, -1 - i % 3 if gaps else 2]) for _ in range(rnd.randrange(9))], i % 3 + 1) for i in range(60)]
    up, want = {1: {1}, 2: {1, 2}, 3: {1, 3}, 4: {4}}, {}
    for _, items, w in rows:
        at, spots, mine = 0, [], set()
        for x in items:
            spots += [(at, x)] if x > 0 else []
            at += 1 if x > 0 else -x
        ends = {(p, (g,)) for p, x in spots for g in up[x]}
        for _ in range(4):
            mine |= {q for _, q in ends}
            ends = {(p, (*q, g)) for e, q in ends for p, x in spots if e < p <= e + 3 for g in up[x]}
        for q in mine:
            want[" ".join(map(str, q))] = want.get(" ".join(map(str, q)), 0) + w
    s = Sequences(spark.createDataFrame(rows, "seq_id long, items array<int>, weight long").localCheckpoint(), d)
    run = lambda: {r["pattern"]: r["support"] for r in s.mine_traditional(9, 2, 4, True, algorithm, gaps=gaps).found.collect()}
    want = {k: v for k, v in want.items() if v >= 9}
    assert len(want) > 50 and run() == want
    monkeypatch.setattr(chunks, "CHUNK", 20)
    monkeypatch.setattr(traditional, "HELD", 50)
    assert run() == want
    monkeypatch.setattr(chunks, "SHARED", 0)
    assert run() == want
    monkeypatch.setattr(traditional, "SHARED", 0)
    assert run() == want


def test_growth_writes_rows_of_sequences_and_prefixes(long, monkeypatch):
    s, kept = long[0], []
    monkeypatch.setattr(growth, "written", lambda df, name, f=growth.written: kept.append(f(df, name)) or kept[-1])
    mine = lambda: {r["pattern"]: r["support"] for r in s.mine("(.^)[.(.^)|(.)]", 300, "growth").found.collect()}
    got = mine()
    held = s.mine("(.^).{1,2}", 300).found.count()
    assert len(got) > 100 and sum(df.count() for df in kept) <= s.rows.count() + len(got) + held
    want = {r["pattern"]: r["support"] for r in s.mine("(.^)[.(.^)|(.)]", 300, "kernel").found.collect()}
    assert got == want
    monkeypatch.setattr(chunks, "CHUNK", 300)
    monkeypatch.setattr(growth, "HELD", 500)
    assert mine() == want
    monkeypatch.setattr(growth, "SHARED", 0)
    assert mine() == want


def test_translation_sends_sequences_as_they_are(spark, long, monkeypatch):
    s, rows, _ = long
    monkeypatch.setattr(dictionary_module, "MAPPED", 0)
    monkeypatch.setattr(dictionary_module, "PLACES", 0)
    got = []
    assert shuffled(spark, lambda: got.extend(s.to_sids().collect())) < 400_000  # 100,000 places
    assert sorted(map(tuple, (r["items"] for r in got))) == sorted(tuple(items) for _, items, _ in rows)


def test_links_of_movies_are_made_of_distinct_ratings(spark):
    rated = spark.createDataFrame([("u", "2001-01-01", 1, 5), ("v", "2001-01-01", 1, 5), ("v", "2001-01-02", 2, None), ("w", "2001-01-02", 3, 4)], "userId string, date string, movieId int, rating int")
    titles = spark.createDataFrame([(1, 1999, "T"), (2, 2000, "U"), (3, None, "V")], "movieId int, year int, title string")
    _, links = etl.movies(rated, titles, True)
    assert sorted(map(tuple, links.collect())) == [("T#1999#1", "1999"), ("T#1999#1@5", "5stars"), ("T#1999#1@5", "T#1999#1"), ("U#2000#2", "2000"), ("V#3@4", "4stars"), ("V#3@4", "V#3")]
    assert links._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
