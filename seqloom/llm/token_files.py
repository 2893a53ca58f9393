"""Token ids as Arrow stream files of equal-length sequences with masks.

A shard file is an Arrow IPC stream. Its schema has ids: fixed_size_list<uint16 or uint32>[length] and mask:
fixed_size_list<bool>[length], false behind the last token. Record batches all have the same number of sequences but for the
last, and buffers are stored uncompressed, so any sequence can be read in place from a memory map. A side file, an Arrow IPC file
too, gives each document's place: its id column, start within the shard, n_tokens. Shards follow each other in the order of ids.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LENGTH, BATCH = 2048, 256
#: Texts that one shard holds, in bytes, and what goes to the encoder at once.
SHARD_BYTES, ENCODED_BYTES = 128 << 20, 8 << 20
#: Words that a process keeps in each of two generations, and the longest of them; words that the library gets in one text.
CACHED_WORDS, CACHED_LENGTH, JOINED = 400_000, 40, 2000


class WhitespaceEncoder:
    """Encodes whole texts by a tokenizers file whose normaliser and pre-tokenizer never look across white space.

    Texts are cut at ASCII white space, and each distinct chunk of a batch is looked up once. Where the file lower-cases, cuts words
    from punctuation and marks the last token of each word, a word goes to the library apart from the punctuation behind it and beside
    many others, as the marks tell their tokens apart. Other chunks go to the library by themselves.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.wide = self.lib.get_vocab_size(with_added_tokens=True) > 1 << 16
        self.kind = np.dtype("<u4" if self.wide else "<u2")
        suffix, vocab = json.loads(self.lib.to_str())["model"].get("end_of_word_suffix"), self.lib.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        if suffix:
            self.last[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.seen, self.joins = common.Seen(CACHED_WORDS, CACHED_LENGTH), False
        if not self.agrees(["a  b\nc\td<|endoftext|> e", "<|endoftext|>x"]):
            raise ValueError("this tokenizer looks across white space")
        if suffix:
            self.joins = True
            self.joins = self.agrees([" ".join(f"{c}a{c}{d} {d}A{c}" for c, d in zip(common.LETTERS, common.PUNCTUATION * 20)), "don't l'\u00e9t\u00e9, 'tis ''s a's x'' 12a, a1. $$$ (the) THE!?"])

    def agrees(self, texts: list[str]) -> bool:
        ids, counts = self.encode(pa.array(texts))
        want = [self.lib.encode(t, add_special_tokens=False).ids for t in texts]
        return counts.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]

    def single(self, pieces: list[str]) -> Iterator[bytes]:
        for i in range(0, len(pieces), 10_000):
            for e in self.lib.encode_batch_fast(pieces[i : i + 10_000], add_special_tokens=False):
                yield np.array(e.ids, self.kind).tobytes()

    def joined(self, words: list[str]) -> Iterator[bytes]:
        for i in range(0, len(words), JOINED):
            part = words[i : i + JOINED]
            ids = np.array(self.lib.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.int64)
            ends = (np.flatnonzero(self.last[ids]) + 1).tolist()
            if len(ends) != len(part) or ends[-1] != len(ids):
                yield from self.single(part)
                continue
            raw, k = ids.astype(self.kind).tobytes(), self.kind.itemsize
            yield from [raw[k * a : k * b] for a, b in zip([0, *ends], ends)]

    def look(self, pieces: pa.Array, learn) -> pa.Array:
        """The ids of distinct pieces as bytes."""
        return pa.array(self.seen(pieces.to_pylist(), learn), pa.large_binary())

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one behind another, and how many each text has; null counts as empty."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
        ends = lists.offsets.to_numpy()
        words = lists.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
        chunks = words.dictionary
        if self.joins:
            plain, body, tail = common.apart(chunks)
            body, tail = pc.utf8_lower(body).dictionary_encode(), tail.dictionary_encode()
            ids = pc.binary_join_element_wise(self.look(body.dictionary, self.joined).take(body.indices), self.look(tail.dictionary, self.single).take(tail.indices), pa.scalar(b"", pa.large_binary()))
            ids = pc.replace_with_mask(pa.nulls(len(chunks), pa.large_binary()), plain, ids)
            ids = pc.replace_with_mask(ids, pc.invert(plain), self.look(chunks.filter(pc.invert(plain)), self.single))
        else:
            ids = self.look(chunks, self.single)
        found = ids.take(words.indices)
        upto = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1, 8 * found.offset)
        flat = np.frombuffer(found.buffers()[2], self.kind)[upto[0] // self.kind.itemsize : upto[-1] // self.kind.itemsize] if len(found) else np.zeros(0, self.kind)
        return flat, np.diff(upto[ends - ends[0]]) // self.kind.itemsize


def encoder(path: str) -> WhitespaceEncoder:
    return common.tool(WhitespaceEncoder, path)


class ShardWriter:
    """Writes one shard; keeps at most one batch of sequences, and what one add brings, in memory."""

    def __init__(self, uri: str, kind: np.dtype, id_type: pa.DataType, length: int = LENGTH, batch: int = BATCH):
        self.fs, self.at = common.filesystem(uri)
        self.fs.create_dir(os.path.dirname(self.at), recursive=True)
        # a retried or speculative task writes under another name first
        self.temp = f"{self.at}.{os.getpid()}-{os.urandom(4).hex()}"
        self.kind, self.length, self.room = kind, length, length * batch
        item = pa.uint16() if kind.itemsize == 2 else pa.uint32()
        self.schema = pa.schema([("ids", pa.list_(pa.field("item", item, False), length)), ("mask", pa.list_(pa.field("item", pa.bool_(), False), length))])
        self.places = pa.schema([("id", id_type), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.sink, self.side = self.fs.open_output_stream(self.temp), self.fs.open_output_stream(self.temp + ".docs")
        self.out, self.docs = pa.ipc.new_stream(self.sink, self.schema), pa.ipc.new_file(self.side, self.places)
        self.rest, self.total, self.n_docs = np.zeros(0, kind), 0, 0

    def add(self, ids: pa.Array, tokens: np.ndarray, counts: np.ndarray) -> None:
        """Documents with these ids, with so many each of the tokens."""
        starts = self.total + np.cumsum(counts) - counts
        self.docs.write_batch(pa.record_batch([ids, pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], schema=self.places))
        self.total += len(tokens)
        self.n_docs += len(ids)
        self.flush(np.concatenate([self.rest, tokens]), False)

    def flush(self, flat: np.ndarray, last: bool) -> None:
        whole = len(flat) if last else len(flat) // self.room * self.room
        for i in range(0, whole, self.room):
            part = flat[i : min(i + self.room, whole)]
            pad = -len(part) % self.length
            ids = pa.array(np.concatenate([part, np.zeros(pad, self.kind)]) if pad else part)
            mask = pa.array(np.arange(len(part) + pad) < len(part))
            self.out.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(x, type=f.type) for x, f in zip((ids, mask), self.schema)], schema=self.schema))
        self.rest = flat[whole:].copy()

    def close(self) -> None:
        self.flush(self.rest, True)
        for x in (self.out, self.sink, self.docs, self.side):
            x.close()
        self.fs.move(self.temp + ".docs", self.at + ".docs")
        self.fs.move(self.temp, self.at)


class Shard:
    """Random access to a shard: sequence(i) and tokens(start, n), views into the memory map where one batch holds them."""

    def __init__(self, uri: str):
        at = common.local_path(uri)
        fs, path = common.filesystem(uri)
        self.source = pa.memory_map(at) if at else fs.open_input_file(path)
        reader = pa.ipc.open_stream(self.source)
        self.length = reader.schema.field("ids").type.list_size
        # with a memory map, a batch is pointers only
        self.batches = [b for b in reader]
        self.per = self.batches[0].num_rows * self.length if self.batches else 0
        f = fs.open_input_file(path + ".docs")
        self.docs = pa.ipc.open_file(f)

    def flat(self, k: int) -> np.ndarray:
        c = self.batches[k].column(0)
        return c.values.slice(c.offset * self.length, len(c) * self.length).to_numpy()

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        k, j = divmod(i * self.length, self.per)
        mask = self.batches[k].column(1)
        return self.flat(k)[j : j + self.length], mask.values.slice(j, self.length).to_numpy(zero_copy_only=False)

    def tokens(self, start: int, n: int) -> np.ndarray:
        if not n:
            return np.zeros(0, np.uint16)
        k, end, parts = start // self.per, start + n, []
        while k * self.per < end:
            lo = k * self.per
            parts.append(self.flat(k)[max(start - lo, 0) : min(end - lo, self.per)])
            k += 1
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def write(df: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Encodes whole texts, appends end_id to each, and writes shards under path in ascending order of ids.

    Returns the manifest, one row a shard: shard int, uri string, base long (tokens of all shards before it), n_docs, n_tokens.
    Null texts count as empty (just end_id); null ids come first; rows that share an id follow each other in the order of their
    rows and may be cut into several shards, so that no id is too frequent. An empty table gives an empty manifest. Columns other
    than the two named ones aren't read. There is a shard for each SHARD_BYTES of text, or spark.sql.shuffle.partitions of them.
    The manifest goes by the driver; it has a row for each shard, not for each document.
    """
    spark = df.sparkSession
    rows = common.with_rid(df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES), 1)
    rows = rows.repartitionByRange(parts, "id", "__rid").sortWithinPartitions("id", "__rid").select("id", "text", F.spark_partition_id().alias("shard"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, out = encoder(tokenizer), None
        for b in common.text_batches(batches, "text", ENCODED_BYTES):
            ids = common.column(b, "id")
            if out is None:
                shard = common.column(b, "shard")[0].as_py()
                uri = f"{path}/shard-{shard:06d}.arrows"
                out = ShardWriter(uri, enc.kind, ids.type, length)
            tokens, counts = enc.encode(common.column(b, "text"))
            out.add(ids, np.insert(tokens, np.cumsum(counts), end_id), counts + 1)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([uri]), pa.array([out.n_docs], pa.int64()), pa.array([out.total], pa.int64())], ["shard", "uri", "n_docs", "n_tokens"])

    done = sorted(common.in_arrow(rows, run, "shard int, uri string, n_docs long, n_tokens long").collect())
    base, out = 0, []
    for r in done:
        out.append((r.shard, r.uri, base, r.n_docs, r.n_tokens))
        base += r.n_tokens
    return spark.createDataFrame(out, "shard int, uri string, base long, n_docs long, n_tokens long")


def read(manifest: DataFrame, id_type: str = "bigint") -> DataFrame:
    """One row a document, from the files: id, start long (over all shards), n_tokens long, ids binary (little-endian 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, base in zip(common.column(b, "uri").to_pylist(), common.column(b, "base").to_pylist()):
                s = Shard(uri)
                for k in range(s.docs.num_record_batches):
                    docs = s.docs.get_batch(k)
                    starts, counts = docs.column(1).to_pylist(), docs.column(2).to_pylist()
                    for i, j in common.slices([4 * n for n in counts], 8 << 20):
                        ids = [s.tokens(a, n).astype("<u4").tobytes() for a, n in zip(starts[i:j], counts[i:j])]
                        yield pa.RecordBatch.from_arrays([docs.column(0).slice(i, j - i), pa.array([base + a for a in starts[i:j]], pa.int64()), docs.column(2).slice(i, j - i), pa.array(ids, pa.binary())], ["id", "start", "n_tokens", "ids"])

    n = max(manifest.count(), 1)
    return common.in_arrow(manifest.select("uri", "base").repartition(n, "uri"), run, f"id {id_type}, start long, n_tokens long, ids binary")


def sequences(manifest: DataFrame) -> DataFrame:
    """One row a sequence, from the files: shard, sequence long (within the shard), ids array<int>, mask array<boolean>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, shard in zip(common.column(b, "uri").to_pylist(), common.column(b, "shard").to_pylist()):
                at = 0
                for x in Shard(uri).batches:
                    n = x.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int32()), pa.array(range(at, at + n), pa.int64()), x.column(0).cast(pa.list_(pa.int32())), x.column(1).cast(pa.list_(pa.bool_()))], ["shard", "sequence", "ids", "mask"])
                    at += n

    return common.in_arrow(manifest.select("uri", "shard"), run, "shard int, sequence long, ids array<int>, mask array<boolean>")


def file_digest(spark: SparkSession, docs: DataFrame, path: str, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Writes the files, reads them back: (doc_id, start, n_tokens, ids_crc32)."""
    kind = dict(docs.dtypes)["doc_id"]
    back = read(write(docs, path, tokenizer, end_id), kind)
    return back.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
