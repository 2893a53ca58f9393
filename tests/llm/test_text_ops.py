"""Exact and near duplicates, spans, tokens and files against brute force, with awkward rows."""

import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from seqloom.llm import bpe, common, components, exact_dedup, minhash, queries, span_dedup, token_files

GPT, CLIP = common.tokenizer_path("byte_bpe_50k.json"), common.tokenizer_path("word_bpe_49k.json")
LONG = " ".join(f"w{i % 977} x{i % 31}." for i in range(20_000))
SHORT = "the quick brown fox jumps over the lazy dog. it runs far away from here. then it sleeps all day long."
ROWS = [
    (0, SHORT, "a"), (1, SHORT.replace(" ", "\t "), "b"), (2, None, None), (3, "", "a"), (4, "  \n ", "c"), (5, LONG, "a"), (6, LONG + " more", "a"),
    (7, SHORT, "a"), (7, SHORT, "a"), (8, "one", None), (9, "ONE", "a"), (None, "one", "b"), (10, "<|endoftext|> a  b<|endoftext|>", "a"),
    (11, SHORT.replace("lazy", "tired"), "a"), (12, "Ä ß 漢字 😀 é", "a"), (13, "x" * 70_000, "a"), (14, "intro words here. " + SHORT, "z"),
]
# names that operators use inside
EXTRA = "doc_id long, text string, source string, __text string, ids string, n_tokens string, band string, kept string"


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("docs") / "t")
    spark.createDataFrame([(*r, "q", None, "q", "q", "q") for r in ROWS], EXTRA).repartition(3).write.parquet(at)
    return spark.read.parquet(at)


@pytest.fixture(scope="module")
def empty(docs, spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("none") / "t")
    docs.where("doc_id > 1000").write.parquet(at)
    return spark.read.schema(docs.schema).parquet(at)


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_dedup(docs, empty):
    got = exact_dedup.decide(docs).collect()
    assert len(got) == len(ROWS)
    groups = {}
    for d, t, _ in ROWS:
        groups.setdefault(norm(t), []).append(d)
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append(r)
    for ids in groups.values():
        real = [i for i in ids if i is not None]
        for i in set(ids):
            assert all(r["keep_id"] == (min(real) if real else None) and r["group_size"] == len(ids) for r in by_id[i])
    assert sum(r["kept"] for r in got) == len(groups)
    kept = exact_dedup.dedup(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.decide(empty).count() == 0 and exact_dedup.dedup(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**40 - 1), st.integers(1, 70_000)), max_size=60), st.lists(st.tuples(st.integers(0, 2**40 - 1), st.integers(1, 300)), max_size=60))
def test_counting_quotient_filters_merge_without_loss(a, b):
    parts, want = [], {}
    for x in (a, b):
        d = {}
        for k, n in x:
            d[k] = d.get(k, 0) + n
            want[k + (5 << 40)] = want.get(k + (5 << 40), 0) + n
        keys = np.array(sorted(d), np.uint64)
        if len(keys):
            parts.append(exact_dedup.unpack(exact_dedup.pack(keys, np.array([d[int(k)] for k in keys]), 40), 5))
    if parts:
        prints, counts = exact_dedup.merge(parts)
        assert dict(zip(prints.tolist(), counts.tolist())) == want


def test_many_filter_blocks(spark):
    df = spark.range(3000).selectExpr("xxhash64(id % 2000) AS fp")
    got = {r["fp"]: r["n"] for r in exact_dedup.repeated_fingerprints(df, "fp", 50_000_000).collect()}
    assert len(got) == 1000 and set(got.values()) == {2}


def test_shuffled_joins_equal_broadcast_ones(docs, monkeypatch):
    want = sorted(map(repr, exact_dedup.decide(docs).drop("__rid").collect()))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert sorted(map(repr, exact_dedup.decide(docs).drop("__rid").collect())) == want


def shingles(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
    return {tuple(w)} if len(w) == 1 else set(zip(w, w[1:]))


def brute_components(texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def family(n=60):
    """Copies with changed words, and unlike texts that share a long passage."""
    rng = np.random.default_rng(1)
    word = lambda k: " ".join(f"v{i}" for i in rng.integers(0, 5000, k))
    base, shared = word(60).split(), word(60)
    out = []
    for i in range(n):
        w = list(base)
        for j in rng.integers(0, 60, i % 9):
            w[j] = f"z{i}"
        out.append(" ".join(w))
        out.append(f"{word(int(rng.integers(15, 70)))} {shared}")
    return out


def test_near_duplicates(spark, tmp_path):
    texts = family() + [None, "", "one", "One", "two  words", "two\nwords"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "d"))
    got = {r["doc_id"]: (r["component_id"], r["n_shingles"], r["kept"]) for r in minhash.digest(spark.read.parquet(str(tmp_path / "d"))).collect()}
    comps, sizes = brute_components(texts)
    assert got == {i: (c, n, c == i) for i, (c, n) in enumerate(zip(comps, sizes))}


def test_unlike_texts_with_one_passage(spark, tmp_path, monkeypatch):
    """Crowded buckets: pairs stay few, and no link is lost."""
    rnd = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(78))
    texts = [passage + " " + " ".join(f"w{rnd.randrange(10**6)}" for _ in range(21 + i % 5)) for i in range(500)]
    for i in range(0, 60, 2):  # linked to the one before by own words, some of other sizes
        words = texts[i].split()
        texts[i + 1] = " ".join([*words[: -3 - i % 8], *(f"n{rnd.randrange(10**6)}" for _ in range(i % 4))])
    met = []
    similar = minhash.similar
    monkeypatch.setattr(minhash, "similar", lambda pairs, *a: met.append(pairs.count()) or similar(pairs, *a))
    at = str(tmp_path / "t")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(at)
    got = {r["doc_id"]: r["component_id"] for r in minhash.digest(spark.read.parquet(at)).collect()}
    sets = [set(zip(w, w[1:])) for w in (t.split() for t in texts)]
    links = [(i, j) for i in range(500) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    assert 20 <= len(links) < 100 and all(got[i] == got[j] for i, j in links)
    assert sum(d == c for d, c in got.items()) == 500 - len({i for i, _ in links})
    assert met and sum(met) * 20 < 500 * 499 // 2


def test_banding_follows_the_threshold(spark, tmp_path):
    assert minhash.banding(75) == (60, 5) and abs(minhash.agreeing(75) - 0.6) < 1e-6 and minhash.banding(50) == (150, 2)
    for percent in (0, 2, 101):
        with pytest.raises(ValueError):
            minhash.banding(percent)
    texts = []
    for i in range(60):  # pairs of 90 shingles each, 62 of them in common: 62 / 118 = 0.525
        w = [f"t{i}x{k}" for k in range(91)]
        texts += [" ".join(w), " ".join(w[:63] + [f"o{i}x{k}" for k in range(28)])]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2).write.parquet(str(tmp_path / "d"))
    got = minhash.components_of(spark.read.parquet(str(tmp_path / "d")), 50).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i - i % 2 for i in range(len(texts))}


def test_near_duplicates_of_awkward_rows(docs, empty):
    got = minhash.dedup(docs)
    ids = [r["doc_id"] for r in got.collect()]
    # of the copies of SHORT one stays, the near copy of LONG and the two spellings of one go
    assert got.columns == docs.columns
    assert ids.count(7) == 0 and ids.count(0) == 1 and ids.count(6) == 0 and {2, 3, 4} <= set(ids) and 9 not in ids and None not in ids
    assert minhash.dedup(empty).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (3, 2)]
    got = dict(map(tuple, components.connected(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}
    assert components.connected(spark.createDataFrame([], "u long, v long")).count() == 0


def test_circulant_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    both, a, b = (np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2)) for n in (600, 200, 200))
    sign = minhash.Circulant(300)
    x, y = sign(np.union1d(both, a)), sign(np.union1d(both, b))
    assert abs((x == y).mean() - 0.6) < 0.1


def test_spans(spark, docs, empty, tmp_path):
    con = duckdb.connect()
    docs.select("doc_id", "text").where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    con.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    want = con.execute(queries.OP1_SQL)
    names = [c[0] for c in want.description]
    from pyspark.sql import functions as F

    got = span_dedup.clean(df).select("doc_id", "n_units", "n_removed", F.concat_ws(",", "removed").alias("removed_units"), "text").select(*names)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)
    assert span_dedup.clean(docs).count() == len(ROWS) and span_dedup.clean(empty).count() == 0
    assert span_dedup.dedup(docs).columns == docs.columns


def test_units_cut_long_sentences():
    text = " ".join(f"w{i}" for i in range(60)) + " end. Next one!\nlast"
    assert [len(m.group().split()) for m in span_dedup.units(text)] == [16, 16, 16, 13, 2, 1]
    passage = " ".join(f"p{i}" for i in range(55)) + "."
    starts = [k for k, h in enumerate(span_dedup.run_hashes(passage, 3, 10, 16)) if h]
    assert len(starts) == 2 and span_dedup.cut(passage, starts, 3, 16) == ("", 4, [0, 1, 2, 3])


def removed_by_definition(texts, cut):
    """Units removed from each text if every run, grown to ten words from its first unit on or its last one back, is compared in full."""
    seen, out = set(), []
    for t in texts:
        u = [" ".join(m.split()) for m in cut(t)]
        size = [len(x.split()) for x in u]
        runs = set()
        for i in range(len(u)):
            runs.add(next(((i, e) for e in range(i + 3, len(u) + 1) if sum(size[i:e]) >= 10), None))
            runs.add(next(((s, i + 1) for s in range(i - 2, -1, -1) if sum(size[s : i + 1]) >= 10), None))
        gone = set()
        for s, e in sorted(runs - {None}):
            if tuple(u[s:e]) in seen:
                gone.update(range(s, e))
            seen.add(tuple(u[s:e]))
        out.append((len(u), sorted(gone)))
    return out


def test_passages_of_short_sentences(spark, tmp_path):
    rng = np.random.default_rng(3)
    short = " ".join(f"s{i}!!" for i in range(60))
    uneven = " ".join(f"u{i}" for i in range(9)) + ". one! two! three! " + " ".join(f"v{i}" for i in range(8)) + ". end!"
    mixed = [" ".join(f"m{i}" + ".  "[i % 3] for i in rng.integers(0, 6, 40)) for _ in range(8)]
    texts = [short, short.replace(" ", "  "), f"Other words come first. {short} And last!", uneven, f"Before it! {uneven} After it.", "a. b. c. d.", "a. b. c. d.", "", *mixed]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    got = {r["doc_id"]: r for r in span_dedup.clean(spark.read.parquet(str(tmp_path / "d")), whole=True).collect()}
    want = removed_by_definition(texts, lambda t: [b' '.join(w).decode() for _, w in span_dedup.passage_units(t)])
    assert [(got[i]["n_units"], got[i]["removed"]) for i in range(len(texts))] == want
    assert got[1]["text"] == "" and got[2]["text"] == "Other words come first. And last!" and got[4]["text"] == "Before it! After it."
    assert got[6]["n_removed"] == 0


def test_passages_at_any_offset_of_a_long_sentence(spark, tmp_path):
    rng = np.random.default_rng(4)
    words = lambda k: [f"w{i}" for i in rng.integers(0, 10**6, k)]
    passage = words(55)
    texts = [" ".join(words(20 + k) + passage + words(30)) for k in range(17)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    got = {r["doc_id"]: r["text"].split() for r in span_dedup.clean(spark.read.parquet(str(tmp_path / "d")), whole=True).collect()}
    ends = {tuple(w) for _, w in span_dedup.passage_units(" ".join(passage))}
    assert got[0] == texts[0].split() and len(ends) > 5
    for k in range(1, 17):
        left = len(set(passage) & set(got[k]))
        assert left <= 11 and set(got[k]) >= set(texts[k].split()) - set(passage)
    for t in ("", " a  b\t\n c. d ", "x " * 40 + "\n\n y", "\n"):  # every word is in one unit, spans in order
        u = span_dedup.passage_units(t)
        assert [t[a:b].encode().split() for (a, b), _ in u] == [w for _, w in u] and [x for _, w in u for x in w] == t.encode().split()


def test_bpe_is_the_library(docs, empty):
    lib = Tokenizer.from_file(GPT)
    got = {}
    for r in bpe.decode(bpe.encode(docs, GPT), GPT).collect():
        got.setdefault(r["doc_id"], []).append((r["n_tokens"], r["ids"], r["decoded"]))
    for d, t, _ in ROWS:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert (len(ids), np.array(ids, "<u4").tobytes(), lib.decode(ids, skip_special_tokens=False)) in [(n, bytes(i), s) for n, i, s in got[d]]
    assert bpe.roundtrip_digest(empty, GPT).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("  \n\taeiounst'.,<|endoftext|>")), max_size=80), max_size=4))
def test_bpe_of_any_text(texts):
    lib, mine = Tokenizer.from_file(GPT) if "lib" not in _lib else _lib["lib"], bpe.model(GPT)
    _lib["lib"] = lib
    assert mine.encode_batch(texts) == [np.array(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


_lib: dict = {}


def test_bpe_speculates_and_verifies():
    m = bpe.ByteBpe(GPT)
    words = [" the", " thonanorthe", " erblessing", "x" * 40, " 漢字"]
    tokens, owner = m.greedy([w.encode() for w in words])
    lists = [tokens[owner == i].tolist() for i in range(len(words))]
    assert all(b"".join(m.bytes[t] for t in x).decode() == w for x, w in zip(lists, words))
    exact = [m.exact(w.encode()) for w in words]
    assert exact == m.exact_many([w.encode() for w in words])
    for x, e in zip(lists, exact):  # compatible everywhere: exactly the right ones
        pairs = np.array(list(zip(x, x[1:])) or [(0, 0)])[: len(x) - 1].reshape(-1, 2)
        assert bool(m.compatible(pairs[:, 0], pairs[:, 1]).all()) == (x == e)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.characters(max_codepoint=0x2FF), st.sampled_from("  \n\taeiounstISÉİß'.,!12<|endoftext|>")), max_size=80), max_size=4))
def test_word_encoder_of_any_text(texts):
    e = token_files.encoder(CLIP)
    assert e.joins and e.agrees([*texts, "", "Plain words, of which several. stand here"])
    assert e.agrees([" ".join(texts), "".join(texts).upper()])


def test_word_encoder_forgets(monkeypatch):
    monkeypatch.setattr(token_files, "CACHED_WORDS", 3)
    monkeypatch.setattr(token_files, "JOINED", 2)
    e = token_files.WhitespaceEncoder(CLIP)
    for k in range(6):
        assert e.agrees([f"some words {k} that, word{'x' * k}! come back again. " * 2, "x" * 50])


def test_equal_ids_go_to_several_shards(spark, tmp_path):
    at = str(tmp_path / "t")
    spark.createDataFrame([(None if i % 2 else 5, f"text {i}") for i in range(400)], "doc_id long, text string").repartition(3).write.parquet(at)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        manifest = token_files.write(spark.read.parquet(at), f"file://{tmp_path}/s", CLIP, 1).cache()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert max(r["n_docs"] for r in manifest.collect()) < 120
    got = sorted((r["start"], r["id"], r["n_tokens"]) for r in token_files.read(manifest).collect())
    assert [d for _, d, _ in got] == [None] * 200 + [5] * 200 and [s for s, _, _ in got] == np.cumsum([0, *[n for _, _, n in got[:-1]]]).tolist()


def test_token_files(spark, docs, empty, tmp_path):
    lib = Tokenizer.from_file(CLIP)
    at = f"file://{tmp_path}/tokens"
    manifest = token_files.write(docs, at, CLIP, 1, length=64).cache()
    got = sorted((r["start"], r["id"], r["n_tokens"], bytes(r["ids"])) for r in token_files.read(manifest).collect())
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at_token = 0
    for (start, d, n, ids), (want, t, _) in zip(got, order):
        tokens = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        assert (start, d, n, ids) == (at_token, want, len(tokens), np.array(tokens, "<u4").tobytes())
        at_token += n
    seqs = token_files.sequences(manifest).orderBy("shard", "sequence").collect()
    flat = [t for r in seqs for t, m in zip(r["ids"], r["mask"]) if m]
    assert all(len(r["ids"]) == 64 for r in seqs) and len(flat) == at_token and flat == [t for _, _, _, i in got for t in np.frombuffer(i, "<u4").tolist()]
    uri = manifest.orderBy("shard").first()["uri"]
    ids, mask = token_files.Shard(uri).sequence(0)
    assert ids.tolist() == seqs[0]["ids"] and mask.tolist() == seqs[0]["mask"] and not ids.flags.owndata
    assert zlib.crc32(got[0][3]) >= 0
    none = token_files.write(empty, f"{at}-none", CLIP, 1)
    assert none.count() == 0 and token_files.read(none).count() == 0


def test_sql_of_the_queries(spark, testdata):
    con = duckdb.connect()
    for f in os.listdir(testdata):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{testdata}/{f}'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, testdata)
        want = con.execute(sql)
        names = [c[0] for c in want.description]
        assert sorted(map(repr, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(repr, want.fetchall())), name
