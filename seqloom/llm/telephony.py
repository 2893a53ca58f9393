"""Telephony audio in binary columns: mu-law, A-law and IMA ADPCM in WAV files, decoded, resampled and stored as PCM.

mu-law and A-law bytes are expanded by tables of 256 entries. ADPCM is decoded step by step within a block, but all blocks of a
batch at once, across files.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PCM, ALAW, MULAW, ADPCM = 1, 6, 7, 0x11
NAMES = {PCM: "pcm", ALAW: "alaw", MULAW: "mulaw", ADPCM: "ima_adpcm"}
BLOCK = 64  # bytes of an ADPCM block: 4 of header, 60 of two samples each
PER_BLOCK = 1 + 2 * (BLOCK - 4)
#: Parquet's own compression of the stored tables, lossless: the zstd levels of the files and of their PCM, and the bytes of a page, within which repeats are found.
MEDIA_LEVEL, PCM_LEVEL, PAGE = 12, 13, 64 << 20


def mulaw_table() -> np.ndarray:
    u = ~np.arange(256, dtype=np.int32) & 0xFF
    t = (((u & 15) << 3) + 0x84 << ((u >> 4) & 7)) - 0x84
    return np.where(u & 0x80, -t, t).astype(np.int16)


def alaw_table() -> np.ndarray:
    a = np.arange(256, dtype=np.int32) ^ 0x55
    seg, t = (a >> 4) & 7, (a & 15) << 4
    t = np.where(seg == 0, t + 8, (t + 0x108) << np.maximum(seg - 1, 0))
    return np.where(a & 0x80, t, -t).astype(np.int16)


TABLES = {MULAW: mulaw_table(), ALAW: alaw_table()}
STEPS = np.array(
    "7 8 9 10 11 12 13 14 16 17 19 21 23 25 28 31 34 37 41 45 50 55 60 66 73 80 88 97 107 118 130 143 157 173 190 209 230 253 279 307 337 371 408 449 494 544 598 658 724 796 876 963 1060 1166 1282 1411 1552 1707 1878 2066 2272 2499 2749 3024 3327 3660 4026 4428 4871 5358 5894 6484 7132 7845 8630 9493 10442 11487 12635 13899 15289 16818 18500 20350 22385 24623 27086 29794 32767".split(),
    np.int32,
)
CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
#: The signed step of each (index, nibble).
DELTA = np.array([[(-1 if n & 8 else 1) * ((s >> 3) + (s if n & 4 else 0) + (s >> 1 if n & 2 else 0) + (s >> 2 if n & 1 else 0)) for n in range(16)] for s in STEPS.tolist()], np.int32)


def adpcm_blocks(data: np.ndarray) -> np.ndarray:
    """int16[blocks, 121] of uint8[blocks, 64], all blocks in step."""
    value = np.ascontiguousarray(data[:, :2]).view("<i2").ravel().astype(np.int32)
    index = np.minimum(data[:, 2].astype(np.int32), 88)
    nibbles = np.empty((2 * (data.shape[1] - 4), len(data)), np.uint8)
    nibbles[0::2], nibbles[1::2] = (data[:, 4:] & 15).T, (data[:, 4:] >> 4).T
    out = np.empty((len(nibbles) + 1, len(data)), np.int16)
    out[0] = value
    for k, n in enumerate(nibbles):
        value = np.clip(value + DELTA[index, n], -32768, 32767)
        index = np.clip(index + CHANGE[n], 0, 88)
        out[k + 1] = value
    return out.T


def wav(tag: int, data: bytes, rate: int = 8000) -> bytes:
    """A mono WAV file around sample data."""
    bits, align = {PCM: (16, 2), ALAW: (8, 1), MULAW: (8, 1), ADPCM: (4, BLOCK)}[tag]
    samples = len(data) // align * (PER_BLOCK if tag == ADPCM else 1)
    extra = struct.pack("<HH", 2, PER_BLOCK) if tag == ADPCM else b"" if tag == PCM else struct.pack("<H", 0)
    per_s = rate * align // PER_BLOCK if tag == ADPCM else rate * align
    fmt = struct.pack("<HHIIHH", tag, 1, rate, per_s, align, bits) + extra
    fact = b"" if tag == PCM else b"fact" + struct.pack("<II", 4, samples)
    pad = b"\0" * (len(data) & 1)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + fact + b"data" + struct.pack("<I", len(data)) + data + pad
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse(file: bytes) -> tuple[int, int, bytes]:
    """(format tag, sample rate, sample data) of a mono WAV file."""
    if file[:4] != b"RIFF" or file[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, tag, rate = 12, None, 0
    while at + 8 <= len(file):
        name, n = file[at : at + 4], int.from_bytes(file[at + 4 : at + 8], "little")
        if name == b"fmt ":
            tag, channels, rate = struct.unpack_from("<HHI", file, at + 8)
            if channels != 1:
                raise ValueError("only mono files are supported")
        elif name == b"data":
            if tag is None:
                raise ValueError("the data come before the format")
            return tag, rate, file[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    raise ValueError("no sample data")


def decode_many(files: list[tuple[int, bytes]]) -> list[np.ndarray]:
    """int16 samples of (tag, sample data) pairs; the ADPCM blocks of all of them are decoded together."""
    out: list[np.ndarray | None] = [None] * len(files)
    adpcm = []
    for i, (tag, data) in enumerate(files):
        if tag == ADPCM:
            adpcm.append((i, data[: len(data) // BLOCK * BLOCK]))
        elif tag == PCM:
            out[i] = np.frombuffer(data[: len(data) // 2 * 2], "<i2")
        elif tag in TABLES:
            out[i] = TABLES[tag][np.frombuffer(data, np.uint8)]
        else:
            raise ValueError(f"format {tag} is not supported")
    if adpcm:
        samples = adpcm_blocks(np.frombuffer(b"".join(d for _, d in adpcm), np.uint8).reshape(-1, BLOCK))
        at = 0
        for i, d in adpcm:
            n = len(d) // BLOCK
            out[i] = samples[at : at + n].ravel()
            at += n
    return out


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation in whole numbers; the last sample is held."""
    if rate == to or not len(pcm):
        return pcm
    x = pcm.astype(np.int32)
    if to == 2 * rate:
        out = np.empty(2 * len(x), np.int16)
        out[0::2], out[1:-1:2], out[-1] = x, (x[:-1] + x[1:]) >> 1, x[-1]
        return out
    t = np.arange(len(x) * to // rate, dtype=np.int64) * rate
    i, f = t // to, t % to
    return ((x[i] * (to - f) + x[np.minimum(i + 1, len(x) - 1)] * f) // to).astype(np.int16)


def pcm_files(files: list[tuple[int, int, bytes] | None], rate: int = 16000) -> list[bytes | None]:
    """A 16-bit PCM WAV file of the given rate for each parsed file; None for None."""
    pcm = iter(decode_many([(f[0], f[2]) for f in files if f]))
    return [None if f is None else wav(PCM, resample(next(pcm), f[1], rate).astype("<i2").tobytes(), rate) for f in files]


def decode(df: DataFrame, media_col: str = "media", out_col: str = "pcm", rate: int = 16000) -> DataFrame:
    """Adds out_col (replacing one of that name): each file as a 16-bit PCM WAV file of the given rate; null for null."""
    rows = df.drop(out_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.text_batches(batches, media_col, 2 << 20):
            files = [None if x is None else parse(x) for x in common.column(b, media_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pcm_files(files, rate), pa.binary())], [*b.schema.names, out_col])

    return common.in_arrow(rows, run, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + f", `{out_col}` binary")


@contextmanager
def compressed(spark: SparkSession, level: int) -> Iterator[None]:
    """Parquet files written within are compressed by zstd in large pages; the session's settings come back afterwards."""
    conf = {"spark.sql.parquet.compression.codec": "zstd", "parquet.compression.codec.zstd.level": str(level), "parquet.page.size": str(PAGE)}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def codec_of(text: Column) -> Column:
    """0, 1 or 2, as pack picks the codec."""
    raw = F.coalesce(text.cast("string"), F.lit("")).cast("binary")
    n = F.octet_length(raw)
    return F.crc32(F.concat(raw, F.repeat(F.lit("\0"), F.when(n == 0, BLOCK).otherwise(F.pmod(-n, F.lit(BLOCK)))).cast("binary"))) % 3


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", like: str | None = None) -> DataFrame:
    """(id_col, n_bytes long, media binary): each whole text's UTF-8 bytes as the sample data of a telephony WAV file.

    Null counts as empty. Bytes 0 fill it up to a positive multiple of 64. The bytes' CRC picks the codec, so equal texts give equal files.
    Within a partition files stand by column like (say, the language), codec and text, as what is alike compresses better side by side.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.text_batches(batches, "__text"):
            sizes, files = [], []
            for t in common.column(b, "__text").to_pylist():
                raw = (t or "").encode()
                data = raw + b"\0" * (-len(raw) % BLOCK or (0 if raw else BLOCK))
                sizes.append(len(raw))
                files.append(wav((MULAW, ALAW, ADPCM)[zlib.crc32(data) % 3], data))
            yield pa.RecordBatch.from_arrays([common.column(b, id_col), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], [id_col, "n_bytes", "media"])

    order = [F.col(f"`{like}`")] if like else []
    rows = df.sortWithinPartitions(*order, codec_of(F.col(text_col)), F.col(text_col)).select(id_col, F.col(text_col).cast("string").alias("__text"))
    return common.in_arrow(rows, run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, n_bytes long, media binary")


def described(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The stored files' payload's and their own digests, their codec and, as from decode, their PCM file, without the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.text_batches(batches, "media", 1 << 20):
            media = common.column(b, "media").to_pylist()
            files = [parse(m) for m in media]
            data = [f[2] for f in files]
            yield pa.RecordBatch.from_arrays(
                [common.column(b, id_col), common.column(b, "n_bytes"), pa.array(map(len, data), pa.int64()), pa.array([hashlib.sha256(d).hexdigest() for d in data]), pa.array([zlib.crc32(d[-64:]) for d in data], pa.int64()), pa.array(map(len, media), pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in media]), pa.array([NAMES[f[0]] for f in files]), pa.array(pcm_files(files), pa.binary())],
                [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "codec", "pcm"],
            )

    return common.in_arrow(stored.select(id_col, "n_bytes", "media"), run, f"`{id_col}` {dict(stored.dtypes)[id_col]}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, codec string, pcm binary")


def features(stored: DataFrame) -> DataFrame:
    """Reads stored PCM files back: what they are like takes the place of codec and pcm."""
    kept = stored.columns[:-2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.text_batches(batches, "pcm"):
            feature = []
            for name, pcm in zip(common.column(b, "codec").to_pylist(), common.column(b, "pcm").to_pylist()):
                x = np.frombuffer(parse(pcm)[2], "<i2")
                y = x.astype(np.float64)
                signs = np.signbit(x)
                feature.append(f"{name} samples={len(x)} rms={np.sqrt(np.dot(y, y) / len(y)):.3f} peak={int(np.abs(x.astype(np.int32)).max())} crossings={int((signs[1:] != signs[:-1]).sum())} crc={zlib.crc32(x.tobytes()):08x}")
            yield pa.RecordBatch.from_arrays([*(common.column(b, c) for c in kept), pa.array(feature, pa.string())], [*kept, "feature"])

    return common.in_arrow(stored, run, ", ".join(f"`{c}` {t}" for c, t in stored.dtypes[:-2]) + ", feature string")


def digest(df: DataFrame, like: str | None = None) -> DataFrame:
    """Stores every text as audio, then its resampled PCM, in tables of the shared folder and describes what is read back from them."""
    with compressed(df.sparkSession, MEDIA_LEVEL):
        media = common.written(pack(df, like=like), "media")
    with compressed(df.sparkSession, PCM_LEVEL):
        pcm = common.written(described(media), "pcm")
    return features(pcm)
