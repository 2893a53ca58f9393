"""Sharding, mixing, audio, toxicity, HTML and the pipeline, with awkward rows."""

import hashlib
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from seqloom.llm import common, html_text, mixing, sharding, telephony, toxicity

ROWS = [(i, None if i == 3 else "" if i == 4 else f"text {i % 7} " * (i % 40), "big" if i % 3 else ("s1", "s2", None)[i % 4 % 3]) for i in range(500)] + [(None, "x", "big"), (7, "text 0 ", "big"), (9, "long " * 40_000, "s1")]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("docs") / "t")
    spark.createDataFrame([(*r, "q", 1, "q") for r in ROWS], "doc_id long, text string, source string, shard string, slot int, block string").repartition(5).write.parquet(at)
    return spark.read.parquet(at)


@pytest.fixture(scope="module")
def empty(docs, spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("none") / "t")
    docs.where("doc_id > 100000").write.parquet(at)
    return spark.read.schema(docs.schema).parquet(at)


def test_shards(docs, empty, monkeypatch):
    monkeypatch.setattr(sharding, "NUMBERED_ROWS", 7)
    got = sharding.digest(docs, 24).collect()
    sizes = Counter(r["shard"] for r in got)
    assert len(got) == len(ROWS) and set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n)) for s, n in sizes.items())
    weight = lambda t: (len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d, *weight(t)) for d, t, _ in ROWS)
    assert sorted(map(tuple, sharding.digest(docs, 24).collect()), key=repr) == sorted(map(tuple, got), key=repr)
    assert sharding.digest(empty, 24).count() == 0
    few = sharding.digest(docs.limit(5), 24)
    assert few.count() == 5 and few.select("shard").distinct().count() == 5
    assert set(sharding.shuffle(docs, 3).columns) == set(docs.columns)


def test_hypergeometric_law():
    rnd = random.Random(1)
    x = np.array([sharding.hypergeometric(rnd, 30, 70, 20) for _ in range(20_000)])
    assert abs(x.mean() - 6) < 0.05 and abs(x.var() - 20 * 0.3 * 0.7 * 80 / 99) < 0.15
    assert sharding.hypergeometric(rnd, 5, 0, 3) == 3 and sharding.hypergeometric(rnd, 0, 5, 3) == 0
    big = [sharding.hypergeometric(rnd, 4 * 10**9, 6 * 10**9, 10**6) for _ in range(30)]
    assert all(abs(b - 400_000) < 5000 for b in big)
    m = sharding.matrix([10, 0, 37, 5], 6, 3)
    assert [sum(r) for r in m] == [10, 0, 37, 5] and sorted(map(sum, zip(*m))) == [8, 8, 9, 9, 9, 9]


def brute_plan(tokens, limit, budget):
    lo, hi, total = 0.0, 1.0, sum(tokens)
    reps = lambda m: [(budget * total if budget else max(t / (t / total) ** m for t in tokens) * sum((t / total) ** m for t in tokens)) * (t / total) ** m / sum((u / total) ** m for u in tokens) / t for t in tokens]
    for _ in range(60):
        m = (lo + hi) / 2
        lo, hi = (lo, m) if max(reps(m)) <= limit else (m, hi)
    return hi, reps(hi)


@pytest.mark.parametrize("limit,budget", [(2.0, 1.0), (1.5, None), (3.0, 0.5)])
def test_mixing(docs, limit, budget):
    got = mixing.mix(docs, max_repetition=limit, budget=budget).collect()
    size = lambda t: max(1, len((t or "").split()))
    tokens = Counter()
    for _, t, s in ROWS:
        tokens[s] += size(t)
    tau, reps = brute_plan(list(tokens.values()), limit, budget)
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["tokens"]
        assert abs(r["tau"] - tau) < 1e-6
    largest = max(size(t) for _, t, _ in ROWS)
    for s, rep in zip(tokens, reps):
        assert rep <= limit + 1e-6 and rep * tokens[s] - largest <= taken[s] <= rep * tokens[s] + 1
    times = Counter(r["__rid"] for r in got)
    assert max(times.values()) - min(times.values()) <= max(reps) - min(reps) + 2
    if budget is None:
        assert len(times) == len(ROWS)  # no document is lost


def test_mixing_by_entropy_and_rows(docs, empty):
    w = {r["source"]: r["weight"] for r in mixing.mix(docs, entropy=1.0).collect()}
    assert abs(-sum(p * np.log(p) for p in w.values()) - 1.0) < 1e-6 and abs(sum(w.values()) - 1) < 1e-9
    out = mixing.remix(docs, max_repetition=1.5, budget=None)
    assert out.columns == docs.columns and out.count() >= len(ROWS) and out.select("text").distinct().count() == docs.select("text").distinct().count()
    assert mixing.mix(empty, max_repetition=2.0).count() == 0 and mixing.remix(empty, max_repetition=2.0).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs)


def test_companding_tables():
    assert [int(telephony.TABLES[telephony.MULAW][i]) for i in (0, 0x7F, 0x80, 0xFF)] == [-32124, 0, 32124, 0]
    assert [int(telephony.TABLES[telephony.ALAW][i]) for i in (0xD5, 0x55, 0xAA, 0x2A)] == [8, -8, 32256, -32256]


def slow_adpcm(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for n in (byte & 15, byte >> 4):
            step = int(telephony.STEPS[index])
            diff = (step >> 3) + (step if n & 4 else 0) + (step >> 1 if n & 2 else 0) + (step >> 2 if n & 1 else 0)
            value = max(-32768, min(32767, value - diff if n & 8 else value + diff))
            index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][n & 7]))
            out.append(value)
    return out


def test_adpcm_blocks():
    rng = np.random.default_rng(4)
    data = rng.integers(0, 256, (50, 64)).astype(np.uint8)
    assert telephony.adpcm_blocks(data).tolist() == [slow_adpcm(bytes(b)) for b in data]


def test_resampling():
    x = np.array([0, 10, -10, 7], np.int16)
    assert telephony.resample(x, 8000, 16000).tolist() == [0, 5, 10, 0, -10, -2, 7, 7]
    assert telephony.resample(x, 8000, 8000) is x and len(telephony.resample(x, 8000, 11025)) == 5
    assert telephony.resample(x[:0], 8000, 16000).size == 0


def test_audio_round_trip(spark, docs, empty):
    got = {}
    for r in telephony.digest(docs).collect():
        got.setdefault((r["doc_id"], r["n_bytes"]), r)
    for d, t, _ in ROWS:
        raw = (t or "").encode()
        data = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        r = got[d, len(raw)]
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
    assert {r["feature"].split()[0] for r in got.values()} == {"mulaw", "alaw", "ima_adpcm"}
    pcm = telephony.decode(telephony.pack(docs)).where("doc_id = 8").first()
    tag, rate, samples = telephony.parse(bytes(pcm["pcm"]))
    assert (tag, rate) == (telephony.PCM, 16000) and len(samples) > 0
    assert telephony.digest(empty).count() == 0
    with pytest.raises(ValueError):
        telephony.parse(b"no audio")


def test_query_stores_pcm(docs, monkeypatch):
    tables = {}
    written = common.written
    monkeypatch.setattr(common, "written", lambda df, name: tables.setdefault(name, written(df, name)))
    got = sorted((r["media_sha256"], r["feature"]) for r in telephony.digest(docs).collect())
    stored = tables["pcm"].collect()
    want = {hashlib.sha256(r["media"]).hexdigest(): bytes(r["pcm"]) for r in telephony.decode(tables["media"]).collect()}
    assert len(stored) == len(ROWS) and all(bytes(r["pcm"]) == want[r["media_sha256"]] for r in stored)
    crc = {m: zlib.crc32(telephony.parse(p)[2]) for m, p in want.items()}
    assert len(got) == len(ROWS) and all(f.endswith(f" crc={crc[m]:08x}") for m, f in got)


def test_stored_audio_is_compressed(spark, tmp_path, monkeypatch):
    """Files and PCM together take little more than the texts' own Parquet table (they took over three times that), every row is there, and the session keeps its settings."""
    rng = random.Random(4)
    words = {x: ["".join(rng.choices(s, k=rng.randint(1, 4))) for _ in range(3000)] for x, s in (("en", ["th", "er", "on", "an"]), ("de", ["sch", "ei", "un", "ö"]))}
    rows = [(i, " ".join(rng.choices(words[x], k=rng.randint(1, 600))), x) for i in range(900) for x in [rng.choice(["en", "de"])]] + [(900, None, None), (901, "", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2).write.parquet(at := f"{tmp_path}/docs")
    docs = spark.read.parquet(at)
    size = lambda files: sum(os.path.getsize(common.local_path(f)) for f in files)
    tables = {}
    written = common.written
    monkeypatch.setattr(common, "written", lambda df, name: tables.setdefault(name, written(df, name)))
    settings = ("spark.sql.parquet.compression.codec", "parquet.page.size", "parquet.compression.codec.zstd.level")
    before = [spark.conf.get(k, None) for k in settings]
    got = telephony.digest(docs, like="lang")
    assert [spark.conf.get(k, None) for k in settings] == before
    assert size(tables["media"].inputFiles()) + size(tables["pcm"].inputFiles()) < 2 * size(docs.inputFiles())
    assert {r["doc_id"]: r["payload_sha256"] for r in got.collect()} == {i: hashlib.sha256(data).hexdigest() for i, t, _ in rows for raw in [(t or "").encode()] for data in [raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))]}
    codecs = {r["doc_id"]: r["codec"] for r in tables["pcm"].select("doc_id", "codec").collect()}
    assert all(("mulaw", "alaw", "ima_adpcm")[r["k"]] == codecs[r["doc_id"]] for r in docs.select("doc_id", telephony.codec_of(docs["text"]).alias("k")).collect())


INSULTS = ["idiot", "moron", "scum"]


def labelled(n=400, seed=1):
    rng = random.Random(seed)
    syl = ["th", "er", "on", "an", "re", "ed", "nd", "ing", "ha", "ou"]
    out = []
    for i in range(n):
        words = ["".join(rng.choice(syl) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 60))]
        toxic = i % 5 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(INSULTS)
        out.append((i, " ".join(words) + ".", int(toxic)))
    return out


def test_toxicity_held_out_and_obfuscated():
    rows = labelled(800)
    model = toxicity.fit([t for _, t, _ in rows[:600]], [y for _, _, y in rows[:600]])
    p = model.score([t for _, t, _ in rows[600:]])
    y = np.array([y for _, _, y in rows[600:]])
    assert ((p >= toxicity.THRESHOLD) == y).mean() > 0.97
    bad = model.score([f"the {w} erthan" for w in ("i.d.i.o.t", "id-iot", "idiiot", "mo_ron", "s.c.u.m", "m o r o n")])
    assert (bad >= toxicity.THRESHOLD).sum() >= 5, bad
    fine = model.score([None, "", "  ", "erthan onre", "x" * 50_000])
    assert (fine < toxicity.THRESHOLD).all() and ((fine >= 0) & (fine <= 1)).all()


def test_string_kernel_is_its_definition():
    def phi(w):
        w = [0xE000, *map(ord, w), 0xE001]
        out = Counter()
        for i in range(len(w)):
            for j in range(i + 1, len(w)):
                for k in range(j + 1, min(len(w), i + toxicity.STRETCH)):
                    c = [int(toxicity.CODES[x]) for x in (w[i], w[j], w[k])]
                    if all(c):
                        out[tuple(c)] += toxicity.DECAY ** (k - i + 1)
        return out

    words = ["idiot", "i.d.i.o.t", "aaa", "ab", "trash1"]
    want = [[sum(phi(a)[u] * v for u, v in phi(b).items()) / np.sqrt(sum(v * v for v in phi(a).values()) * sum(v * v for v in phi(b).values())) for b in words] for a in words]
    assert np.allclose(toxicity.kernel(words, words), want)


def test_decisions_are_the_sum_over_landmarks():
    """The table of weights against the Nyström map and the kernel's definition, string by string."""
    bad, good = ["idiot", "id.iot", "moron", "mmoron", "xidiotx"], ["table", "window", "garden", "maroon", "idea", "edit"]
    marks = ["idiot", "moron", "table", "garden", "idea"]
    m = toxicity.machine(bad, good, marks, 60)
    k = lambda a, b: brute_kernel(a, b)
    gram = np.array([[k(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(gram)
    root = vectors[:, values > 1e-6] / np.sqrt(values[values > 1e-6])
    w, bias = toxicity.svm(np.array([[k(a, b) for b in marks] for a in bad + good]) @ root, np.array([1.0] * 5 + [-1.0] * 6))
    for x in [*bad, *good, "idi0t", "zz", "", "i d i o t", "\U0001d422diot"]:
        assert toxicity.decisions([x], m.table, m.bias)[0] == pytest.approx(np.array([k(x, b) for b in marks]) @ root @ w + bias, abs=1e-6), x
    model = toxicity.Model(m.table, m.bias, 2.0, 0.5)
    text = "the garden has an i d i o t. And a table"
    assert model.score([text])[0] == pytest.approx(1 / (1 + np.exp(-(2 * max(toxicity.decisions(toxicity.strings(text), m.table, m.bias)) + 0.5))))


def brute_kernel(a, b):
    def parts(s):
        code = lambda c: toxicity.CODES[ord(c)] if ord(c) < 0x10000 else toxicity.CODES[0x4E00]
        s, out = [code(c) for c in f"\ue000{s}\ue001"], Counter()
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                for l in range(j + 1, min(i + toxicity.STRETCH, len(s))):
                    if s[i] and s[j] and s[l]:
                        out[s[i], s[j], s[l]] += toxicity.DECAY ** (l - i + 1)
        return out

    x, y = parts(a), parts(b)
    norm = (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5
    return sum(v * y[t] for t, v in x.items()) / norm if norm else 0.0


def test_toxicity_frames(spark, tmp_path):
    rows = labelled()
    spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, "x"), (9999, None), (0, rows[0][1])], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.digest(spark, docs, labels).collect()
    assert len(got) == len(rows) + 3
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < len(rows)]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    assert np.mean([r["predicted"] == rows[r["doc_id"]][2] for r in held]) > 0.9
    none = toxicity.digest(spark, docs.where("doc_id > 1000000"), labels)
    assert none.count() == 0
    assert all(r["score"] == pytest.approx(1e-6) for r in toxicity.digest(spark, docs, labels.where("false")).collect())


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="no-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies on this site, please accept them all.</p></div><div class="ad">Buy now.</div>
<article><header><h1>Title &amp; more</h1></header><p>First   paragraph
of text.<p>Second <b>one</b><br>goes on.</p><script>var a="</p>";</script><ul><li>Item one<li>Item two</ul><form><p>Your name</p></form>
<aside>Related things</aside><div id="comments"><p>Nice article, thanks a lot for it!</p></div><p>Last.</p></article><footer>&copy; us</footer></body></html>"""


def test_main_text():
    assert html_text.extract(PAGE) == "Title & more\n\nFirst paragraph of text.\n\nSecond one goes on.\n\nItem one\n\nItem two\n\nLast."
    plain = "<body><div class=menu><a href=1>a</a><a href=2>b</a></div><div><p>" + "Long text here, with many words. " * 8 + "</p><p>Short.</p><p>" + "More long text follows in this one. " * 8 + "</p></div><div class=footer>x</div></body>"
    got = html_text.extract(plain).split("\n\n")
    assert len(got) == 3 and got[1] == "Short."
    assert [html_text.extract(x) for x in (None, "", "<p></p>", "<nav>a</nav>")] == ["", "", "", ""]
    assert html_text.extract("just text &lt;3") == "just text <3"
    assert html_text.extract("<article><p>a</article></div></p><p>b") .startswith("a")
    assert html_text.extract("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>") == "deep"


def test_layout_classes_keep_the_article():
    for around in ("content has-sidebar", "no-sidebar", "comments-open", "header-fixed", "page-with-menu"):
        assert html_text.extract(f'<body><div class="{around}"><p>The text is here.</p></div></body>') == "The text is here."
    for around in ("sidebar-layout", "widget", "social page"):  # names of parts, but they hold the article
        page = f'<body><div class="{around}"><div class="menu-items">Home</div><nav>All</nav><article><p>The text is here.</p><div class="comment-list">Nice!</div></article></div></body>'
        assert html_text.extract(page) == "The text is here."
        assert html_text.extract(page.replace("article", "main")) == "The text is here."
    page = '<body><article><p>The text is here.</p></article><div class="related"><article><p>Another text, for later on.</p></article></div></body>'
    assert html_text.extract(page) == "The text is here."


def test_short_lines_without_an_article():
    long = [f"{w} text here, with many words. " * 12 for w in ("Some", "More")]
    inner = f"<h2>Top</h2><p>By me</p><p>{long[0]}</p><ul><li>a<li>b<li>c<li>d<li>e</ul><div>fig</div><p>{long[1]}</p><p>x</p><p>y</p><p>End</p>"
    got = html_text.extract(f"<body><div><a href=1>Home</a></div><div>{inner}</div><div class=footer>z</div></body>").split("\n\n")
    assert got[-13:] == ["Top", "By me", long[0].strip(), "a", "b", "c", "d", "e", "fig", long[1].strip(), "x", "y", "End"]


def test_regions_follow_ratio_smoothing_and_threshold():
    long = [f"{w} text here, with many words. " * 8 for w in ("Some", "More", "Last")]
    sections = "".join(f"<section><h2>Part {i}</h2><p>{t}</p></section>" for i, t in enumerate(long))
    page = f"<body><div><p>Copy <b>right</b> <i>2024</i> all <u>rights</u> reserved</p></div><h1>Title</h1>{sections}<div><a href=1>One</a> <a href=2>Two</a></div><div><p>Imprint</p></div></body>"
    want = ["Title", *(x for i, t in enumerate(long) for x in (f"Part {i}", t.strip()))]
    assert html_text.extract(page).split("\n\n") == want
    assert len(html_text.extract(page, share=0.0).split("\n\n")) > len(want)  # without a threshold, everything is content
    assert html_text.extract(f"<body><article><p>{long[0]}</p></article><div><p>Copyright 2024 all rights reserved</p></div></body>") == long[0].strip()


def brute_region(lines, parents, is_article, sigma, share):
    """As the docstring of the module says, step by step."""
    n = len(lines)
    own = [0 if x.dropped else len(x.text) / max(x.tags, 1) for x in lines]
    reach = int(np.ceil(2 * sigma)) if n > 2 * np.ceil(2 * sigma) else n
    ratio = []
    for i in range(n):
        near = [j for j in range(n) if abs(i - j) <= reach]
        w = [np.exp(-((i - j) ** 2) / (2 * sigma**2)) for j in near]
        ratio.append(sum(a * own[j] for a, j in zip(w, near)) / sum(w))
    kept = [i for i in range(n) if not lines[i].dropped]
    if not kept:
        return []
    mean = sum(ratio) / n
    limit = min(share * (sum((r - mean) ** 2 for r in ratio) / n) ** 0.5, max(ratio[i] for i in kept))
    above = [i for i in kept if ratio[i] >= limit - 1e-9]
    clusters = [[above[0]]]
    for a, b in zip(above, above[1:]):
        clusters[-1].append(b) if b - a <= html_text.BETWEEN + 1 else clusters.append([b])
    weight = lambda ix: sum(len(lines[i].text) for i in ix)
    seeds = [i for c in clusters if weight(c) >= html_text.LEAST * max(map(weight, clusters)) for i in c]
    inside = lambda i, c: c == -1 or lines[i].container == c or (lines[i].container >= 0 and any(x == c for x in above_of(lines[i].container)))

    def above_of(c):
        while c >= 0:
            yield c
            c = parents[c]

    node = -1
    while node < 0 or not is_article[node]:
        children = [c for c in range(len(parents)) if parents[c] == node and weight([i for i in seeds if inside(i, c)]) >= max(html_text.NEARLY * weight(seeds), 1)]
        if not children:
            break
        node = children[0]
    within = [i for i in kept if inside(i, node)]
    if node >= 0 and is_article[node]:
        return within
    part = lambda i: next((c for c in above_of(lines[i].container) if parents[c] == node), node) if lines[i].container != node else node
    seeds = [i for i in seeds if i in within]
    level = min(limit, max(own[i] for i in seeds))
    good = {part(i) for i in seeds if own[i] >= level - 1e-9}
    chosen = [i for i in within if part(i) in good]
    out = [i for i in within if chosen[0] <= i <= chosen[-1]]
    before = [i for i in kept if i < out[0]]
    while before and lines[before[-1]].heading:
        out.insert(0, before.pop())
    return out


def random_page(rnd):
    def node(depth):
        tag = rnd.choice(["p", "p", "p", "div", "div", "section", "article", "ul", "h2", "nav", "span", "table"])
        if tag in ("p", "h2", "span") or depth > 4:
            return f"<{tag}>{'word ' * rnd.choice([1, 2, 5, 30, 90])}{'<b>x</b>' * rnd.randrange(3)}</{tag}>"
        return f"<{tag}>{''.join(node(depth + 1) for _ in range(rnd.randrange(1, 5)))}</{tag}>"

    return "<body>" + "".join(node(0) for _ in range(rnd.randrange(1, 7))) + "</body>"


def test_regions_equal_brute_force():
    rnd, differs = random.Random(8), 0
    for _ in range(400):
        parser = html_text.Lines()
        parser.feed(random_page(rnd))
        lines = parser.finish()
        got = [html_text.region(lines, parser.parents, parser.is_article, 1.0, share) for share in (1.0, 0.0)]
        assert got == [brute_region(lines, parser.parents, parser.is_article, 1.0, share) for share in (1.0, 0.0)]
        differs += got[0] != got[1]
    assert differs > 40


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=8), st.sampled_from("<![foo bar]> <![CDATA[ ]]> <!-- --> <!doctype <? ?> </ <p <a href=' <article> </article> <main> </div> <div> <td> <script> </script> <textarea> &#x110000; &#0; &amp <![if x]> <![ <!".split())), max_size=12).map("".join))
def test_any_page_is_parsed(html):
    assert isinstance(html_text.extract(html), str)


def test_pages_frame(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None)], "page_id long, url string, html string, text string")
    got = html_text.extract_pages(df).collect()
    assert [r["n_chars"] for r in got] == [len(html_text.extract(PAGE))] * 2 + [0]
    assert html_text.extract_pages(df.where("false")).count() == 0


def test_pipeline(spark, tmp_path):
    """Each stage on the rows that the one before kept, against what each must do."""
    rows = labelled(300)
    long = "unique opening words stand here before anything else happens in this text and it goes on for some more words"
    extra = [(1000, long, 0), (1001, long.replace(" ", "  "), 0), (1002, long + " end", 0), (1003, "you are an idiot", 1)]
    sf = tmp_path / "sf"
    spark.createDataFrame([(i, t, "en", f"s{i % 2}" if i % 3 else "hot", len(t)) for i, t, _ in rows + extra], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept, at = docs, 0
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, str(sf))
        out.write.parquet(str(tmp_path / str(at)))
        before, kept = kept, spark.read.parquet(str(tmp_path / str(at)))
        at += 1
        ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
        if name != "bpe":
            assert kept.columns == docs.columns
        if name == "toxicity":
            assert 1003 not in ids and {1000, 1001, 1002} <= ids and len(ids) >= 235
        elif name == "exact_dedup":
            assert 1000 in ids and 1001 not in ids and 1002 in ids
        elif name == "minhash":
            assert 1000 in ids and 1002 not in ids
        else:
            assert ids == {r["doc_id"] for r in before.select("doc_id").collect()}
    assert kept.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in kept.collect())
