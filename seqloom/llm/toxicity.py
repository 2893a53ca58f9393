"""Toxicity by a support vector machine on a gapped subsequence string kernel with Nyström landmarks.

The kernel compares two strings by the subsequences of three characters that they share, each weighted by DECAY to the power of
the stretch it spans (six characters at most), so that inserted characters weaken a match but don't undo it. A Nyström map over
landmark strings makes the kernel linear; a linear SVM is trained on it. As the map is a fixed mixture of landmarks, the decision is
a weighted sum over the string's subsequences, and one table with a weight for each subsequence scores any string.

Labels are known for whole documents only, and a toxic one has an insult in a sentence or two. So training goes by sentences, as bags
of strings (multi-instance learning). At first a toxic document's sentence is chosen if it has a string that significantly more
toxic than clean documents have; from then on the machine adds those sentences with a string that it finds worse than almost any
clean sentence's, if other toxic documents have it too. A sentence is stood for by its worst string, clean ones too. What is chosen, also with characters inserted, trains the
next round. A document's score comes from its worst string, by logistic calibration.

Training takes at most TOXIC_DOCS toxic and CLEAN_DOCS clean labelled documents (those whose hashes come first), a bound that is
documented and doesn't depend on the size of the corpus. Scoring covers every whole text.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TOXIC_DOCS, CLEAN_DOCS = 1500, 3000
#: Sentences of clean documents that stand for all of these in training, strings of clean sentences in a round, rounds.
CLEAN_SENTENCES, CLEAN_STRINGS, ROUNDS = 20_000, 6000, 3
#: How often a string counts at most that stands for many sentences; it is in more than so many times as many toxic as clean documents.
COPIES, PURITY = 4, 2
#: A toxic document's sentence is chosen if this share of clean sentences has no string as bad.
CLEAN_SHARE = 0.9997
DECAY, STRETCH, WIDTH = 0.7, 6, 24
LANDMARKS = 192
THRESHOLD = 0.3
#: Of the likelihood ratio statistic; chance gives this less than once in a million strings.
SIGNIFICANT = 25.0
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def letters(word: str) -> str:
    """Lower case, without accents and without punctuation at its ends."""
    w = EDGES.sub("", word.lower())
    return w if w.isascii() else "".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c))


def strings(text: str | None) -> list[str]:
    """The distinct strings to score: words, and runs of single characters joined (i d i o t); long ones in overlapping windows."""
    tokens = (text or "").split()
    found = {letters(w) for w in set(tokens)}
    run: list[str] = []
    for w in (*tokens, "  "):
        if len(w) == 1:
            run.append(w)
        elif run:
            if len(run) > 2:
                found.add(letters("".join(run)))
            run = []
    out = set()
    for w in found:
        if len(w) <= WIDTH:
            out.add(w)
        else:
            out.update(w[i : i + WIDTH] for i in range(0, len(w) - WIDTH // 2, WIDTH // 2))
    out.discard("")
    return sorted(out)


def sentences(text: str | None) -> list[list[str]]:
    """The strings of three characters or more of each sentence that has any; equal strings are one object."""
    return [x for x in ([sys.intern(w) for w in strings(t) if len(w) > 2] for t in SENTENCE.split(text or "")) if x]


CODES = np.zeros(0x10000, np.uint8)
CODES[[c for c in range(0x10000) if chr(c).isalnum()]] = [37 + c % 24 for c in range(0x10000) if chr(c).isalnum()]
CODES[[0xE000, 0xE001]] = 62, 63  # a string's ends
CODES[ord("a") : ord("z") + 1] = np.arange(1, 27)
CODES[ord("0") : ord("9") + 1] = np.arange(27, 37)


def subsequences(words: list[str], gaps: list[tuple[int, int]], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, subsequence, weight): each subsequence of three letters or digits once a word, its weights added up. Other characters
    only stretch what they stand between."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    width = int(size.max(initial=1))
    chars = np.frombuffer("".join(f"\ue000{w}\ue001" for w in words).encode("utf-32-le"), "<u4")
    chars = np.where(chars < 0x10000, chars, 0x4E00)  # what lies beyond counts as one letter
    grid = np.zeros((len(words), width + STRETCH), np.int64)
    grid[:, :width][np.arange(width) < size[:, None]] = CODES[chars]
    keys, values = [], []
    for (i, j), weight in zip(gaps, weights):
        code = grid[:, :width] << 12 | grid[:, i : i + width] << 6 | grid[:, j : j + width]
        w, at = np.nonzero((grid[:, :width] > 0) & (grid[:, i : i + width] > 0) & (grid[:, j : j + width] > 0))
        keys.append(w << 18 | code[w, at])
        values.append(np.full(len(w), weight))
    key = np.concatenate(keys)
    by = np.argsort(key, kind="stable")
    key, value = key[by], np.concatenate(values)[by]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first] >> 18, key[first] & 0x3FFFF, np.add.reduceat(value, first) if len(first) else value


GAPS = [(i, j) for j in range(2, STRETCH) for i in range(1, j)]
WEIGHTS = np.array([DECAY ** (j + 1) for _, j in GAPS])


def decisions(words: list[str], table: np.ndarray, bias: float) -> np.ndarray:
    """The SVM's decision for each string; strings of fewer than three characters only get the bias."""
    if not words:
        return np.zeros(0)
    w, code, value = subsequences(words, GAPS, WEIGHTS)
    dot = np.bincount(w, value * table[code], len(words))
    norm = np.sqrt(np.bincount(w, value * value, len(words)))
    return dot / np.maximum(norm, 1e-12) + bias


class Model:
    """Scores documents: a table of subsequence weights, a bias and the calibration's slope and offset."""

    def __init__(self, table: np.ndarray, bias: float, slope: float, offset: float):
        self.table, self.bias, self.slope, self.offset = table, bias, slope, offset
        self.cache: dict[str, float] = {}

    def worst(self, texts: list[str | None]) -> np.ndarray:
        """The decision for each text's worst string; a text without strings counts as one without any subsequence."""
        if len(self.cache) > 200_000:
            self.cache = {}
        each = [strings(t) for t in texts]
        new = list({w for ws in each for w in ws}.difference(self.cache))
        for i in range(0, len(new), 5000):
            part = new[i : i + 5000]
            self.cache.update(zip(part, decisions(part, self.table, self.bias).tolist()))
        look = self.cache
        return np.array([max(map(look.__getitem__, ws), default=self.bias) for ws in each])

    def worst_strings(self, bags: list[list[str]]) -> tuple[list[str], list[float]]:
        """The worst string of each bag and the decision for it."""
        known = sorted({w for x in bags for w in x})
        value = dict(zip(known, np.concatenate([decisions(known[i : i + 5000], self.table, self.bias) for i in range(0, len(known), 5000)] or [[]]).tolist()))
        best = [max(x, key=lambda w: (value[w], w)) for x in bags]
        return best, [value[w] for w in best]

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.worst(texts) + self.offset, -30, 30)))


def kernel(a: list[str], b: list[str]) -> np.ndarray:
    """The normalised kernel between two lists of strings."""
    wb, cb, vb = subsequences(b, GAPS, WEIGHTS)
    nb = np.sqrt(np.bincount(wb, vb * vb, len(b)))
    used, place = np.unique(cb, return_inverse=True)
    cols = np.zeros((len(used) + 1, len(b)))
    cols[place, wb] = vb / np.maximum(nb[wb], 1e-12)
    out = np.zeros((len(a), len(b)))
    for i in range(0, len(a), 2000):
        part = a[i : i + 2000]
        wa, ca, va = subsequences(part, GAPS, WEIGHTS)
        na = np.sqrt(np.bincount(wa, va * va, len(part)))
        at = np.minimum(np.searchsorted(used, ca), max(len(used) - 1, 0))
        hit = used[at] == ca if len(used) else np.zeros(len(ca), bool)
        wa, at, va = wa[hit], at[hit], va[hit] / np.maximum(na[wa[hit]], 1e-12)
        first = np.flatnonzero(np.concatenate([[True], wa[1:] != wa[:-1]])) if len(wa) else []
        if len(wa):
            out[i + wa[first]] = np.add.reduceat(cols[at] * va[:, None], first, axis=0)
    return out


def svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 60, seed: int = 3) -> tuple[np.ndarray, float]:
    """A linear SVM (squared hinge loss, both classes weighing the same) by dual coordinate descent; the last feature is the bias."""
    rng = np.random.default_rng(seed)
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = np.where(y > 0, len(y) / (2 * max((y > 0).sum(), 1)), len(y) / (2 * max((y < 0).sum(), 1)))
    diag = 1 / (2 * cost * weight)
    q = (x * x).sum(1) + diag
    alpha, w = np.zeros(len(y)), np.zeros(x.shape[1])
    for _ in range(rounds):
        for i in rng.permutation(len(y)):
            g = y[i] * (w @ x[i]) - 1 + diag[i] * alpha[i]
            new = max(alpha[i] - g / q[i], 0)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w[:-1], float(w[-1])


def calibrate(f: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope (not negative) and offset of the logistic curve of y (0, 1) over f, by Newton's method with a small ridge."""
    x, beta, ridge = np.column_stack([f, np.ones(len(f))]), np.array([1.0, 0.0]), np.diag([1e-2, 1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ beta)
        norm = np.abs(step).max()
        beta = beta - step * min(1, 3 / norm if norm else 1)
        beta[0] = max(beta[0], 0)
        if norm < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def significance(k1: int, n1: int, k0: int, n0: int) -> float:
    """The likelihood ratio statistic of k1 of n1 toxic documents having a string and k0 of n0 clean ones, 0 where these have it more."""
    if k1 * n0 <= k0 * n1:
        return 0.0
    p = (k1 + k0) / (n1 + n0)
    ll = lambda k, n, q: (k * np.log(q) if k else 0.0) + ((n - k) * np.log(1 - q) if n > k else 0.0)
    return 2 * (ll(k1, n1, k1 / n1) + ll(k0, n0, k0 / n0 if n0 else 0) - ll(k1, n1, p) - ll(k0, n0, p))


def distinct(each: Iterable[Iterable[str]], size: int = 16) -> list[int]:
    """The numbers of the lists that don't share half of their smallest hashes with an earlier one."""
    seen: dict[int, list[int]] = {}
    out = []
    for i, ws in enumerate(each):
        sketch = sorted(zlib.crc32(w.encode()) for w in ws)[:size]
        if not sketch or max(Counter(j for h in sketch for j in seen.get(h, ())).values(), default=0) * 2 < len(sketch):
            out.append(i)
            for h in sketch:
                seen.setdefault(h, []).append(i)
    return out


def variants(word: str, rng: np.random.Generator) -> list[str]:
    """The word with a mark between all characters, with a letter doubled, and with a character inserted."""
    out = [".".join(word)]
    for _ in range(3):
        i = int(rng.integers(1, max(len(word), 2)))
        out += [word[:i] + word[i - 1 : i] + word[i:], word[:i] + chr(97 + int(rng.integers(26))) + word[i:]]
    return out


def fit(texts: list[str | None], labels: list[int], seed: int = 3) -> Model:
    """Trains on labelled texts. Without both labels, or where no toxic text has a string, every score is the share of label 1 (0 where
    there are no texts)."""
    y = np.array(labels, np.int64)
    bags = [sentences(t) for t in texts]
    if not any(x and v for x, v in zip(bags, labels)) or y.min() == y.max():
        p = float(np.clip(y.mean() if len(y) else 0.0, 1e-6, 1 - 1e-6))
        return Model(np.zeros(1 << 18), 0.0, 0.0, float(np.log(p / (1 - p))))
    alone = distinct({w for x in bag for w in x} for bag in bags)  # copies of a document would make its rare strings look significant
    toxic, clean = Counter(), Counter()
    for i in alone:
        (toxic if y[i] else clean).update({w for x in bags[i] for w in x})
    clean = {w: clean[w] for w in toxic}  # of other strings no count is needed
    n1, n0 = sum(int(y[i]) for i in alone), sum(1 - int(y[i]) for i in alone)
    worth = {w: significance(k, n1, clean[w], n0) for w, k in toxic.items()}
    least = SIGNIFICANT if max(worth.values(), default=0) >= SIGNIFICANT else 0  # too few examples for significance
    rng = np.random.default_rng(seed)
    # the first choice: of each toxic document the most significant string, of clean sentences those most like these
    suspects = [x for i in alone if y[i] for x in bags[i]]
    bad = [max(x, key=lambda w: (worth[w], w)) for x in suspects]
    first = bad = [w for w in bad if worth[w] > least and toxic[w] > PURITY * clean[w]] or bad
    chosen_first = set(first)
    good = [x for i in alone if not y[i] for x in bags[i]]
    good = [good[i] for i in rng.permutation(len(good))[:CLEAN_SENTENCES]]
    bags.clear()
    near = decider(dict(zip(sorted(set(bad)), np.ones(len(bad)))))
    model = None
    for last in (*[False] * (ROUNDS - 1), True):
        found = Counter(bad)
        likely = near if model is None else model.worst_strings
        hard = [w for w, _ in sorted(zip(*likely(good)), key=lambda x: (-x[1], x[0])) if w not in found]
        hard = list(dict.fromkeys(hard))
        rest = sorted({w for x in good for w in x}.difference(found))
        rest = [rest[i] for i in rng.permutation(len(rest))[: CLEAN_STRINGS // 2]]
        hard = hard[: CLEAN_STRINGS // 2]
        rows = [v for w, n in sorted(found.items()) for v in [w] * min(n, COPIES) + variants(w, rng)] or [""]
        marks = list(dict.fromkeys([w for w, _ in found.most_common(LANDMARKS // 2)] + hard[: LANDMARKS // 4] + rest[: LANDMARKS // 4]))
        model = machine(rows, hard + rest, marks, 60 if last else 20)
        if not last:
            chosen, f = model.worst_strings(suspects)
            limit = np.quantile(model.worst_strings(good)[1], CLEAN_SHARE) if good else 0.0
            bad = first + [w for w, v in zip(chosen, f) if v > max(limit, 0) and w not in chosen_first and toxic[w] > 1 + PURITY * clean[w]]
    model.slope, model.offset = calibrate(model.worst(texts), y.astype(float))
    return model


def decider(found: dict[str, float]):
    """As Model.worst_strings, by the greatest kernel with these strings."""
    marks = list(found)

    def worst(bags: list[list[str]]) -> tuple[list[str], list[float]]:
        known = sorted({w for x in bags for w in x})
        value = dict(zip(known, kernel(known, marks).max(axis=1).tolist() if known and marks else [0.0] * len(known)))
        best = [max(x, key=lambda w: (value[w], w)) for x in bags]
        return best, [value[w] for w in best]

    return worst


def machine(bad: list[str], good: list[str], marks: list[str], rounds: int) -> Model:
    """The SVM of bad and good strings over the Nyström map of the marks, as a table of weights; not calibrated."""
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    keep = values > 1e-6
    root = vectors[:, keep] / np.sqrt(values[keep])
    rows = bad + good
    signs = np.array([1.0] * len(bad) + [-1.0] * len(good))
    w, bias = svm(kernel(rows, marks) @ root, signs, rounds=rounds)
    mix = root @ w
    mark, code, value = subsequences(marks, GAPS, WEIGHTS)
    norm = np.sqrt(np.bincount(mark, value * value, len(marks)))
    table = np.bincount(code, value / np.maximum(norm[mark], 1e-12) * mix[mark], 1 << 18)
    return Model(table, bias, 1.0, 0.0)


def remainder(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 4


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits on labelled documents whose crc32(id as text) mod 4 isn't 2. Labels other than 0 and 1 and null ids don't count; an id with
    several labels counts as toxic if one is."""
    known = labels.select(F.col(id_col).alias("id"), "toxic").where((remainder(F.col("id")) != 2) & F.col("id").isNotNull() & F.col("toxic").isin(0, 1))
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic")).withColumn("key", F.xxhash64("id"))
    picks = [known.where(f"toxic = {t}").orderBy("key", "id").limit(n) for t, n in ((1, TOXIC_DOCS), (0, CLEAN_DOCS))]
    chosen = common.written(picks[0].unionByName(picks[1]), "chosen")  # at most TOXIC_DOCS + CLEAN_DOCS rows
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")
    rows = texts.groupBy("id", "toxic").agg(F.min("text").alias("text")).orderBy("id").select("text", "toxic").collect()
    model = fit([r["text"] for r in rows], [r["toxic"] for r in rows])
    common.release()
    return model


def unpacked(at: bytes, weights: bytes, bias: float, slope: float, offset: float) -> Model:
    table = np.zeros(1 << 18)
    table[np.frombuffer(at, np.int64)] = np.frombuffer(weights, np.float64)
    return Model(table, bias, slope, offset)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(__rid, id_col, score double, predicted int) for each row, whatever its id; null, empty and wordless texts get the score of no string."""
    table, bias, slope, offset = model.table, model.bias, model.slope, model.offset
    at = np.flatnonzero(table).astype(np.int64)
    weights = table[at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = common.tool(unpacked, at.tobytes(), weights.tobytes(), bias, slope, offset)
        for b in common.text_batches(batches, "text"):
            p = m.score(common.column(b, "text").to_pylist())
            yield pa.RecordBatch.from_arrays([common.column(b, "__rid"), common.column(b, "id"), pa.array(p, pa.float64()), pa.array((p >= THRESHOLD).astype(np.int32))], ["__rid", "id", "score", "predicted"])

    rows = common.with_rid(df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")))
    out = common.in_arrow(rows, run, f"__rid long, id {dict(rows.dtypes)['id']}, score double, predicted int")
    return out.select("__rid", F.col("id").alias(id_col), "score", "predicted")


def digest(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted)."""
    out = score(docs, train(docs, labels))
    return out.select("doc_id", (remainder(F.col("doc_id")) == 2).alias("held_out"), "score", "predicted")


def clean(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df, with all their columns, that aren't predicted toxic."""
    gone = common.written(score(df, model, id_col, text_col).where("predicted = 1").select("__rid"), "toxic")
    return common.without(df, gone)
