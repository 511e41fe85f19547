"""Telephony audio as media columns: mu-law, A-law and IMA ADPCM in WAV, expanded and resampled to PCM."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import doc_text, text_blocks

BLOCK = 64
RATE = 8000

# WAV format tags, and the tables of IMA ADPCM.
PCM, ALAW, MULAW, IMA = 0x0001, 0x0006, 0x0007, 0x0011
STEPS = (
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
    7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
)
MOVES = (-1, -1, -1, -1, 2, 4, 6, 8)


@cache
def mulaw_table() -> np.ndarray:
    """Sample of each mu-law byte: inverted bits are sign, exponent (3) and mantissa (4), with a bias of 132."""
    c = ~np.arange(256) & 255
    size = (((c & 15) << 3) + 132 << (c >> 4 & 7)) - 132
    return np.where(c & 128, -size, size).astype(np.int16)


@cache
def alaw_table() -> np.ndarray:
    """Sample of each A-law byte: every other bit inverted; exponent 0 has no hidden bit."""
    c = np.arange(256) ^ 0x55
    e, m = c >> 4 & 7, (c & 15) << 4
    size = np.where(e == 0, m + 8, m + 264 << np.maximum(e - 1, 0))
    return np.where(c & 128, size, -size).astype(np.int16)


def decode_ima(blocks: np.ndarray) -> np.ndarray:
    """Samples (int16) of mono IMA ADPCM blocks, one row each: first sample, step index, a spare byte, then nibbles, low first.

    All blocks advance together, one nibble a step. A step index over 88 counts as 88.
    """
    n, width = blocks.shape
    steps, moves = np.array(STEPS, np.int32), np.array(MOVES, np.int32)
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    out = np.empty((1 + 2 * (width - 4), n), np.int16)
    out[0] = value
    for k in range(4, width):
        byte = blocks[:, k].astype(np.int32)
        for j, code in enumerate((byte & 15, byte >> 4)):
            step, size = steps[index], code & 7
            # The exact sum of shifted steps that the codec defines, not its rounded product.
            move = (step >> 3) + np.where(size & 4, step, 0) + np.where(size & 2, step >> 1, 0) + np.where(size & 1, step >> 2, 0)
            value = np.clip(np.where(code & 8, value - move, value + move), -32768, 32767)
            index = np.clip(index + moves[size], 0, 88)
            out[1 + 2 * (k - 4) + j] = value
    return out.T


@cache
def half_taps() -> np.ndarray:
    """Eight taps of a Hann-windowed sinc that interpolates half-way between samples, summing to 1."""
    at = np.arange(8) - 3.5
    taps = np.sinc(at) * np.cos(np.pi * at / 9) ** 2
    return (taps / taps.sum()).astype(np.float32)


def resample_double(samples: np.ndarray) -> np.ndarray:
    """int16 samples at twice the rate: the old ones, and between them eight-tap interpolations; edges repeat."""
    if not len(samples):
        return samples
    wide = np.pad(samples.astype(np.float32), (3, 4), mode="edge")
    between = np.convolve(wide, half_taps(), mode="valid")
    out = np.empty(2 * len(samples), "<i2")
    out[0::2] = samples
    out[1::2] = np.clip(np.rint(between), -32768, 32767)
    return out


def wav(data: bytes, kind: int, rate: int) -> bytes:
    """A mono WAV file; compressed kinds have the fact chunk that the format asks for."""
    bits, align = {PCM: (16, 2), ALAW: (8, 1), MULAW: (8, 1), IMA: (4, BLOCK)}[kind]
    samples = {PCM: len(data) // 2, IMA: len(data) // BLOCK * (1 + 2 * (BLOCK - 4))}.get(kind, len(data))
    per_second = rate * BLOCK // (1 + 2 * (BLOCK - 4)) if kind == IMA else rate * align
    form = struct.pack("<HHIIHH", kind, 1, rate, per_second, align, bits)
    if kind == IMA:
        form += struct.pack("<HH", 2, 1 + 2 * (BLOCK - 4))
    elif kind != PCM:
        form += struct.pack("<H", 0)
    chunks = b"fmt " + struct.pack("<I", len(form)) + form
    if kind != PCM:
        chunks += b"fact" + struct.pack("<II", 4, samples)
    chunks += b"data" + struct.pack("<I", len(data))
    return b"".join((b"RIFF", struct.pack("<I", 4 + len(chunks) + len(data) + len(data) % 2), b"WAVE", chunks, data, b"\0" * (len(data) % 2)))


def read_wav(file: bytes) -> tuple[int, int, bytes]:
    """Format tag, rate and data of a WAV file; anything else raises ValueError."""
    if file[:4] != b"RIFF" or file[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    at, kind, rate = 12, None, None
    while at + 8 <= len(file):
        name, size = file[at : at + 4], int.from_bytes(file[at + 4 : at + 8], "little")
        if name == b"fmt ":
            kind, _, rate = struct.unpack_from("<HHI", file, at + 8)
        elif name == b"data":
            if kind is None or at + 8 + size > len(file):
                break
            return kind, rate, file[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("WAV file without format or whole data")


def expand(kind: int, data: bytes) -> np.ndarray:
    """PCM samples of WAV data."""
    raw = np.frombuffer(data, np.uint8)
    if kind == MULAW:
        return mulaw_table()[raw]
    if kind == ALAW:
        return alaw_table()[raw]
    if kind == IMA:
        return decode_ima(raw[: len(raw) // BLOCK * BLOCK].reshape(-1, BLOCK)).reshape(-1)
    if kind == PCM:
        return raw.view("<i2")
    raise ValueError(f"format {kind} isn't supported")


def payload(text: str | None) -> tuple[int, bytes]:
    """Bytes of a text (null: none) and the same filled up with zeros to a positive multiple of BLOCK."""
    raw = (text or "").encode()
    return len(raw), raw + b"\0" * (max(BLOCK, -(-len(raw) // BLOCK) * BLOCK) - len(raw))


def store(docs: DataFrame, kind: int = MULAW) -> DataFrame:
    """doc_id, n_bytes, media: each whole text's payload as the samples of a WAV file at 8 kHz.

    Null and empty texts become one block of zeros. Repeated rows are kept one for one; other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_blocks(batches, 2 << 20):
            sizes, data = zip(*map(payload, texts), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array([wav(d, kind, RATE) for d in data], pa.binary())], ["doc_id", "n_bytes", "media"])

    return doc_text(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def pcm_wav(media: bytes) -> bytes:
    """A WAV file of telephony audio as 16-bit PCM at twice its rate."""
    kind, rate, data = read_wav(media)
    return wav(resample_double(expand(kind, data)).tobytes(), PCM, 2 * rate)


def to_pcm(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media, and pcm: each media value expanded and stored as 16-bit PCM WAV at twice its rate; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, size = 0, 0
            for z, m in enumerate(b.column(2), 1):
                size += len(m.as_buffer()) if m.is_valid else 0
                if size >= 2 << 20 or z == b.num_rows:
                    part = b.slice(a, z - a)
                    out = [None if m is None else pcm_wav(m) for m in part.column(2).to_pylist()]
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], ["doc_id", "n_bytes", "media", "pcm"])
                    a, size = z, 0

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, media binary, pcm binary")


def _features(data: list[bytes], pcm: list[bytes]) -> list[str]:
    """For each payload the mean absolute sample as mu-law, A-law and ADPCM, and of its PCM the mean power and the sign changes."""
    raw = np.frombuffer(b"".join(data), np.uint8)
    edges = np.cumsum([0, *map(len, data)])
    law, other = np.abs(mulaw_table().astype(np.int32))[raw], np.abs(alaw_table().astype(np.int32))[raw]
    ima = np.abs(decode_ima(raw.reshape(-1, BLOCK)).astype(np.int32)).sum(axis=1, dtype=np.int64)
    starts = edges[:-1]
    sums = [np.add.reduceat(law, starts, dtype=np.int64), np.add.reduceat(other, starts, dtype=np.int64), np.add.reduceat(ima, starts // BLOCK)]
    counts = [np.diff(edges), np.diff(edges), np.diff(edges) // BLOCK * (1 + 2 * (BLOCK - 4))]
    means = [(s // n).tolist() for s, n in zip(sums, counts, strict=True)]
    wide = np.frombuffer(b"".join(pcm), "<i2").astype(np.int64)
    at = np.cumsum([0, *(len(p) // 2 for p in pcm)])
    power = (np.add.reduceat(wide * wide, at[:-1]) // np.diff(at)).tolist()
    turns = np.r_[False, (wide[1:] < 0) != (wide[:-1] < 0)]
    turns[at[:-1]] = False
    changes = np.add.reduceat(turns, at[:-1], dtype=np.int64).tolist()
    return [f"mulaw={u} alaw={a} ima={d} power={w} changes={c}" for u, a, d, w, c in zip(*means, power, changes, strict=True)]


_DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def described(media: DataFrame) -> DataFrame:
    """Digests and features of the stored bytes (doc_id, n_bytes, media) and, in a column pcm, their PCM as by to_pcm."""

    def rows(ids: list, sizes: list, media: list[bytes]) -> pa.RecordBatch:
        data, pcm = [read_wav(m)[2] for m in media], list(map(pcm_wav, media))
        columns = [
            pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(map(len, data), pa.int64()), pa.array([hashlib.sha256(d).hexdigest() for d in data]),
            pa.array([zlib.crc32(d[-BLOCK:]) for d in data], pa.int64()), pa.array(map(len, media), pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in media]),
            pa.array(_features(data, [read_wav(p)[2] for p in pcm])), pa.array(pcm, pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, [*(c.split(" ")[0] for c in _DIGESTS.split(", ")), "pcm"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sizes, held, size = [], [], [], 0
            for i, n, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                ids.append(i)
                sizes.append(n)
                held.append(m.as_py())
                size += len(held[-1])
                if size >= 1 << 20:
                    yield rows(ids, sizes, held)
                    ids, sizes, held, size = [], [], [], 0
            if ids:
                yield rows(ids, sizes, held)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"{_DIGESTS}, pcm binary")


def digests(media: DataFrame) -> DataFrame:
    """described() with the PCM column read back as its pcm_bytes and pcm_crc32, in the JVM: it is four times the text."""
    return described(media).withColumns({"pcm_bytes": F.octet_length("pcm").cast("long"), "pcm_crc32": F.crc32("pcm")}).drop("pcm")
