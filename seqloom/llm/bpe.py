"""Byte-level BPE by speculation and verification.

Greedy longest matches propose the tokens of each new word. A proposal is right exactly if each adjacent pair of its tokens
is compatible, that is, if merging the bytes of the two tokens gives these two tokens; a vectorised check walks back through the
merges of all pairs at once. Only words with an incompatible pair are merged exactly, with a heap.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space beside white space.
WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
BESIDE = f"{WHITE} | {WHITE}"
NOTHING = pa.scalar(b"", pa.large_binary())
NEVER = np.iinfo(np.int64).max
#: Strings that a process keeps in each of two generations, and the longest of them; bytes of text that are encoded at once.
CACHED, CACHED_LENGTH, ENCODED_BYTES = 150_000, 48, 2 << 20


def byte_chars() -> dict[str, int]:
    """The character by which byte-level vocabularies write each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteBpe:
    """Encoder and decoder for a tokenizers file of kind byte-level BPE.

    Tokens are numbered inside by time: first those that no merge makes, then the results of the merges in their order.
    """

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            raise ValueError("only plain byte-level BPE files are supported")
        self.words = regex.compile(PATTERN).findall
        vocab, chars = model["vocab"], byte_chars()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = [a + b for a, b in merges]
        if len(results := set(made)) < len(made):
            raise ValueError("two merges make the same token")
        base = [t for t in vocab if t not in results]
        order = base + made
        number = {t: i for i, t in enumerate(order)}
        self.n = n = len(order)
        self.ids = np.array([vocab[t] for t in order], np.uint32)
        self.bytes = [bytes(chars[c] for c in t) for t in order]
        self.left, self.right = np.arange(n), np.arange(n)
        left = np.array([number[a] for a, _ in merges], np.int64)
        right = np.array([number[b] for _, b in merges], np.int64)
        self.left[len(base) :], self.right[len(base) :] = left, right
        keys = left * n + right
        by = np.argsort(keys)
        self.pair_keys, self.pair_makes = keys[by], by + len(base)
        self.merge_of = dict(zip(keys.tolist(), range(len(base), n)))
        self.single = {b[0]: i for i, b in enumerate(self.bytes[: len(base)]) if len(b) == 1}
        if len(self.single) < 256:
            raise ValueError("the vocabulary lacks single bytes")
        # a token that its own bytes don't give is never proposed
        fine = np.ones(n, bool)
        fine[len(base) :] = self.compatible(left, right, np.arange(len(base), n))
        for i in range(len(base), n):
            fine[i] &= fine[self.left[i]] and fine[self.right[i]]
        self.known = {self.bytes[i]: i for i in range(n) if fine[i]}
        self.trie()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that strip or match single words are not supported")
        top = max([int(self.ids.max()), *self.special.values()]) + 1
        self.by_id: list[bytes] = [b""] * top
        for i, b in zip(self.ids.tolist(), self.bytes):
            self.by_id[i] = b
        for t, i in self.special.items():
            self.by_id[i] = t.encode()
        self.token_bytes = pa.array(self.by_id, pa.large_binary())
        self.seen = common.Seen(CACHED, CACHED_LENGTH)
        self.exact_words = self.new_words = 0

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """For each pair of tokens, whether merging their joined bytes (by merges before limit) leaves just these two."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        lim = np.full(len(a), NEVER) if limit is None else limit.astype(np.int64)
        ok, at = np.ones(len(a), bool), np.arange(len(a))
        while at.size:
            key = a * self.n + b
            i = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            bad = (self.pair_keys[i] == key) & (self.pair_makes[i] < lim)
            ok[at[bad]] = False
            go = ~bad
            at, a, b = at[go], a[go], b[go]
            # undo the later of the two tokens; one that is not made by a merge can't be undone, so undo the other
            ra, lb = self.right[a], self.left[b]
            undo_a = np.where(a > b, ra != a, (lb == b) & (ra != a))
            undo_b = ~undo_a & (lb != b)
            lim = np.where(undo_a, a, b + 1)
            a, b = np.where(undo_a, ra, a), np.where(undo_b, lb, b)
            go = undo_a | undo_b
            at, a, b, lim = at[go], a[go], b[go], lim[go]
        return ok

    def trie(self) -> None:
        """Sorted (state, byte) keys of the tokens' trie, for many words at once."""
        steps: dict[int, int] = {}
        accept = [-1]
        for word, t in self.known.items():
            state = 0
            for c in word:
                key = state << 8 | c
                if (to := steps.get(key)) is None:
                    to = steps[key] = len(accept)
                    accept.append(-1)
                state = to
            accept[state] = t
        keys = np.fromiter(steps.keys(), np.int64, len(steps))
        by = np.argsort(keys)
        self.step_keys, self.step_to, self.accept = keys[by], np.fromiter(steps.values(), np.int64, len(steps))[by], np.array(accept, np.int64)

    def greedy(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Longest matches from left to right, all words in step: (tokens, for each the number of its word), in order."""
        text = np.frombuffer(b"".join(words) + b"\0", np.uint8).astype(np.int64)
        end = np.cumsum([len(w) for w in words])
        pos = np.concatenate([[0], end[:-1]]).astype(np.int64)
        word = np.flatnonzero(end > pos)
        pos, end = pos[word], end[word]
        cur, state = pos.copy(), np.zeros(len(word), np.int64)
        best, after = np.full(len(word), -1, np.int64), pos.copy()
        toks, owners = [], []
        while len(word):
            key = state << 8 | text[cur]
            i = np.minimum(np.searchsorted(self.step_keys, key), len(self.step_keys) - 1)
            on = (self.step_keys[i] == key) & (cur < end)
            state = np.where(on, self.step_to[i], 0)
            cur += on
            hit = np.where(on, self.accept[state], -1)
            found = hit >= 0
            best, after = np.where(found, hit, best), np.where(found, cur, after)
            if not on.all():
                off = np.flatnonzero(~on)
                toks.append(best[off])
                owners.append(word[off])
                cur[off] = after[off]
                keep = after < end
                keep[on] = True
                word, end, cur, state, best, after = word[keep], end[keep], cur[keep], state[keep], best[keep], after[keep]
        if not toks:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        owner = np.concatenate(owners)
        by = np.argsort(owner, kind="stable")
        return np.concatenate(toks)[by], owner[by]

    def pair_makes_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that merging each pair makes, NEVER where none does or one is absent (-1)."""
        out = np.full(a.shape, NEVER)
        at = np.flatnonzero((a >= 0) & (b >= 0))
        key = a.ravel()[at] * self.n + b.ravel()[at]
        i = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        hit = self.pair_keys[i] == key
        out.ravel()[at[hit]] = self.pair_makes[i[hit]]
        return out

    def exact_many(self, words: list[bytes]) -> list[list[int]]:
        """Exact merging of short words side by side: each round applies every word's first merge; leftmost first."""
        n, width = len(words), max(map(len, words))
        size = np.array([len(w) for w in words])
        of = np.array([self.single[b] for b in range(256)], np.int64)
        tok = np.full((n, width + 2), -1, np.int64)
        inside = np.arange(width + 2) < size[:, None]
        tok[inside] = of[np.frombuffer(b"".join(words), np.uint8)]
        rank = self.pair_makes_of(tok[:, :-1], tok[:, 1:])
        at, cols = np.arange(n), np.arange(width + 2)
        done = [None] * n
        while len(at):
            j = rank.argmin(1)
            v = rank[np.arange(len(at)), j]
            over = v == NEVER
            if over.any():
                for i, row in zip(at[over].tolist(), tok[over].tolist()):
                    done[i] = [t for t in row if t >= 0]
                go = ~over
                at, tok, rank, j, v = at[go], tok[go], rank[go], j[go], v[go]
                if not len(at):
                    break
            k = np.arange(len(at))
            src = np.minimum(cols + (cols > j[:, None]), len(cols) - 1)
            tok = np.take_along_axis(tok, src, 1)
            tok[:, -1] = -1
            tok[k, j] = v
            rank = np.take_along_axis(rank, np.minimum(src[:, :-1], len(cols) - 2), 1)
            rank[:, -1] = NEVER
            rank[k, j] = self.pair_makes_of(v, tok[k, j + 1])
            i = np.flatnonzero(j > 0)
            rank[i, j[i] - 1] = self.pair_makes_of(tok[i, j[i] - 1], v[i])
        return done

    def exact(self, word: bytes) -> list[int]:
        """Merges the bytes in the order of the merges, leftmost first."""
        tok = [self.single[b] for b in word]
        n = len(tok)
        nxt, prev, merge = [*range(1, n), -1], [-1, *range(n - 1)], self.merge_of
        heap = [(m, i, tok[i], tok[i + 1]) for i in range(n - 1) if (m := merge.get(tok[i] * self.n + tok[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            m, i, a, b = heapq.heappop(heap)
            j = nxt[i] if tok[i] == a else -1
            if j < 0 or tok[j] != b:
                continue
            tok[i], tok[j], nxt[i] = m, -1, nxt[j]
            if nxt[j] >= 0:
                prev[nxt[j]] = i
            for x in (prev[i], i):
                if x >= 0 and (y := nxt[x]) >= 0 and (k := merge.get(tok[x] * self.n + tok[y])) is not None:
                    heapq.heappush(heap, (k, x, tok[x], tok[y]))
        return [t for t in tok if t >= 0]

    def learn(self, words: list[str]) -> list[bytes]:
        """The ids of each new word as little-endian 32-bit bytes."""
        raw = [w.encode() for w in words]
        flat, owner = self.greedy(raw)
        at = np.flatnonzero(owner[:-1] == owner[1:])  # no pair across words
        pairs, back = np.unique(flat[at] * self.n + flat[at + 1], return_inverse=True)
        failing = np.unique(owner[at[~self.compatible(pairs // self.n, pairs % self.n)[back]]]) if len(at) else at
        ends = np.searchsorted(owner, np.arange(len(words)), side="right") * 4
        ids = self.ids[flat].astype("<u4").tobytes()
        out = [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
        by_width: dict[int, list[int]] = {}
        for w in failing.tolist():
            by_width.setdefault(min((len(raw[w]) + 3) // 4, 9), []).append(w)
        for width, some in by_width.items():
            for i in range(0, len(some), 20_000):
                part = some[i : i + 20_000]
                exact = self.exact_many([raw[w] for w in part]) if width < 9 else [self.exact(raw[w]) for w in part]
                for w, x in zip(part, exact):
                    out[w] = self.ids[x].astype("<u4").tobytes()
        self.new_words += len(words)
        self.exact_words += len(failing)
        return out

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of texts that are cut where words surely end, by way of their distinct words."""
        cut = list(map(self.words, chunks))
        words = list({w for ws in cut for w in ws})
        known = dict(zip(words, self.seen(words, self.learn)))
        return [b"".join(map(known.__getitem__, ws)) for ws in cut]

    def encode_odd(self, texts: list[str]) -> list[bytes]:
        """Ids of texts with added tokens, or with white space beside a space, where the pattern must see whole texts."""
        cut = [[x for x in self.cut(t) if x] if self.cut else [t] for t in texts]
        pieces = list({x for c in cut for x in c if x not in self.special})
        known = dict(zip(pieces, self.encode_chunks(pieces))) | {t: i.to_bytes(4, "little") for t, i in self.special.items()}
        return [b"".join(map(known.__getitem__, c)) for c in cut]

    def encode(self, texts: pa.Array) -> pa.Array:
        """Ids of each text as little-endian 32-bit bytes; null counts as empty.

        A space between two characters that aren't white space begins a word, whatever stands around them. So texts are split
        there, and each distinct chunk of a batch is looked up once: a chunk of letters and the punctuation behind it as two words, any
        other by the pattern. Words that weren't seen before are matched and merged.
        """
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        odd = pc.match_substring_regex(texts, BESIDE)
        for t in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, t))
        lists = pc.split_pattern(texts.filter(pc.invert(odd)), " ")
        ends = lists.offsets.to_numpy()
        flat = lists.values.slice(ends[0], ends[-1] - ends[0])
        ends = ends - ends[0]
        words = flat.dictionary_encode()
        chunks, first = words.dictionary, flat.take(pa.array(ends[:-1])).dictionary_encode()  # a text's first chunk has no space before it
        plain, body, tail = common.apart(chunks)
        body, tail = body.dictionary_encode(), tail.dictionary_encode()
        spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), body.dictionary, pa.scalar("", pa.large_string())).to_pylist()
        found = [self.ids_of(self.seen(x, self.learn)).take(y.indices) for x, y in ((spaced, body), (tail.dictionary.to_pylist(), tail))]
        ids = pc.replace_with_mask(pa.nulls(len(chunks), pa.large_binary()), plain, pc.binary_join_element_wise(*found, NOTHING))
        other = [" " + x for x in chunks.filter(pc.invert(plain)).to_pylist()]
        ids = pc.replace_with_mask(ids, pc.invert(plain), self.ids_of(self.seen(other, self.encode_chunks)))
        at = words.indices.to_numpy().copy()
        at[ends[:-1]] = len(chunks) + first.indices.to_numpy()
        ids = pa.concat_arrays([ids, self.ids_of(self.seen(first.dictionary.to_pylist(), self.encode_chunks))]).take(pa.array(at))
        even = self.strung(ids, ends, pa.large_binary())
        if not pc.any(odd).as_py():
            return even
        out = pc.replace_with_mask(pa.nulls(len(texts), pa.large_binary()), pc.invert(odd), even)
        return pc.replace_with_mask(out, odd, self.ids_of(self.encode_odd(texts.filter(odd).to_pylist())))

    @staticmethod
    def ids_of(values: list[bytes]) -> pa.Array:
        return pa.array(values, pa.large_binary())

    @staticmethod
    def strung(values: pa.Array, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
        """What lies between these ends in an array of bytes, strung together."""
        _, offsets, data = values.buffers()
        upto = np.frombuffer(offsets, np.int64, len(values) + 1, 8 * values.offset) if offsets else np.zeros(1, np.int64)
        return pa.Array.from_buffers(kind, len(ends) - 1, [None, pa.py_buffer(upto[ends].tobytes()), data if data is not None else pa.py_buffer(b"")])

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        return self.encode(pa.array(texts, pa.large_string())).to_pylist()

    def decode(self, ids: pa.Array) -> pa.Array:
        """The texts of little-endian 32-bit ids; null for null. Bytes that aren't UTF-8 are replaced."""
        raw = pc.fill_null(ids.cast(pa.large_binary()), b"")
        ends = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, 8 * raw.offset) // 4
        data = raw.buffers()[2]
        flat = np.frombuffer(data, "<u4", ends[-1]) if data is not None else np.zeros(0, np.uint32)
        out = self.strung(self.token_bytes.take(pa.array(flat[ends[0] :])), ends - ends[0], pa.large_string())
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:
            out = pa.array([x.decode("utf-8", "replace") for x in out.view(pa.large_binary()).to_pylist()], pa.large_string())
        return pc.if_else(pc.is_null(ids), pa.scalar(None, pa.large_string()), out) if ids.null_count else out


def model(path: str) -> ByteBpe:
    """The model of a file, loaded once while this process needs no other tool."""
    return common.tool(ByteBpe, path)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of each row's whole text: (id_col, n_tokens long, ids binary), ids as little-endian unsigned 32-bit integers.

    Null and empty texts have no tokens. One row comes out for each row that goes in, with whatever id it has (null and repeated
    ids too); other columns are left out, so they can't clash. Added tokens in a text are recognised, as the library does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in common.text_batches(batches, "__text", ENCODED_BYTES):
            ids = m.encode(common.column(b, "__text"))
            yield pa.RecordBatch.from_arrays([common.column(b, id_col), pc.divide(pc.binary_length(ids), 4), ids.cast(pa.binary())], [id_col, "n_tokens", "ids"])

    rows = df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    return common.in_arrow(rows, run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, n_tokens long, ids binary")


def decode(df: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the text of ids, added tokens included; null for null ids. A column that is already called out_col is replaced."""

    rows = df.drop(out_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = model(path)
        for b in common.text_batches(batches, ids_col, 8 << 20):
            yield pa.RecordBatch.from_arrays([*b.columns, by.decode(common.column(b, ids_col)).cast(pa.string())], [*b.schema.names, out_col])

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return common.in_arrow(rows, run, f"{schema}, `{out_col}` string")


def roundtrip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What encode and decode give, (id_col, n_tokens, ids, decoded), in one pass, so that each task needs one Python worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in common.text_batches(batches, "__text", ENCODED_BYTES):
            ids = m.encode(common.column(b, "__text"))
            yield pa.RecordBatch.from_arrays([common.column(b, id_col), pc.divide(pc.binary_length(ids), 4), ids.cast(pa.binary()), m.decode(ids).cast(pa.string())], [id_col, "n_tokens", "ids", "decoded"])

    rows = df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    return common.in_arrow(rows, run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, n_tokens long, ids binary, decoded string")


def roundtrip_digest(df: DataFrame, path: str) -> DataFrame:
    """Encodes and decodes; (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    both = roundtrip(df, path)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
