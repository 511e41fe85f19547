"""Length-delimited binary records of token ids, with masked checksums and a separate offset index.

A record file is a run of frames: length (uint64), masked checksum of those 8 bytes (uint32), payload,
masked checksum of the payload (uint32); all little-endian. A payload is doc_id (int64), whether there is
one (uint8), bytes per id (uint8), six zero bytes, and the ids. The checksum is CRC-32 as in zlib, masked
by a rotation and a constant, so that a checksum stored in checked data doesn't check itself. The index
file has for each record its offset and the tokens before it in the file, both int64.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from millrace.llm.common import doc_text, new_folder, written
from millrace.llm.tokens import encoder, text_slices

# Fixed values of the mask.
ROTATE, MASK_ADD = 15, 0xA282EAD8

HEAD = struct.Struct("<QI")
FOOT = struct.Struct("<I")
NAME = struct.Struct("<qBB6x")
#: Bytes of text that are encoded together.
TEXT_BYTES = 8 << 20


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> ROTATE | c << (32 - ROTATE)) + MASK_ADD) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = len(payload).to_bytes(8, "little")
    return b"".join((size, FOOT.pack(masked(size)), payload, FOOT.pack(masked(payload))))


def read_frame(stream) -> bytes | None:
    """The next payload, or None at the end; a frame that is cut off or damaged raises ValueError."""
    head = stream.read(HEAD.size)
    if not head:
        return None
    if len(head) < HEAD.size:
        raise ValueError("record cut off in its head")
    size, check = HEAD.unpack(head)
    if masked(head[:8]) != check:
        raise ValueError("record length doesn't match its checksum")
    body = stream.read(size + FOOT.size)
    if len(body) < size + FOOT.size:
        raise ValueError("record cut off")
    payload = body[:size]
    if masked(payload) != FOOT.unpack(body[size:])[0]:
        raise ValueError("record doesn't match its checksum")
    return payload


def payloads(doc_ids: list, ids: np.ndarray, starts: np.ndarray) -> Iterator[bytes]:
    """The payload of each of consecutive records (none empty): ids in two bytes where all of a record's fit."""
    narrow = (np.maximum.reduceat(ids, starts[:-1]) < 1 << 16).tolist() if len(doc_ids) else []
    two, four, ends = ids.astype("<u2").tobytes(), ids.tobytes(), starts.tolist()
    for doc_id, small, a, z in zip(doc_ids, narrow, ends, ends[1:], strict=False):
        width = 2 if small else 4
        yield NAME.pack(doc_id or 0, doc_id is not None, width) + (two if small else four)[width * a : width * z]


def unpack_ids(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, known, width = NAME.unpack_from(payload)
    return doc_id if known else None, np.frombuffer(payload, f"<u{width}", offset=NAME.size).astype("<u4")


def write_records(docs: DataFrame, tokenizer: str, end_id: int, folder: str) -> DataFrame:
    """Encodes docs and writes them in ascending doc_id order (nulls first; repeated doc_ids by text) below folder.

    folder is a URI that all executors reach. Returns the manifest, already written and read back: part,
    records, tokens, data, index (paths), one row per file; part numbers follow the order of doc_id. A task
    that is run again writes other files; only those in the manifest count. Null and empty texts have end_id
    alone. An empty table has an empty manifest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part = encoder(tokenizer), TaskContext.get().partitionId()
        files, root = fs.FileSystem.from_uri(folder)
        name = f"{root}/part-{part:06d}-{uuid.uuid4().hex}"
        data, at, before, index, offsets = None, 0, 0, [], []
        for doc_ids, texts in text_slices(batches, TEXT_BYTES):
            if data is None:
                files.create_dir(root, recursive=True)
                data = files.open_output_stream(f"{name}.rec.tmp", buffer_size=1 << 20)
            ids, starts = tokens.column(texts, end_id)
            index += (before + starts[:-1]).tolist()
            before += len(ids)
            for payload in payloads(doc_ids.to_pylist(), ids, starts):
                framed = frame(payload)
                data.write(framed)
                offsets.append(at)
                at += len(framed)
        if data is None:
            return
        data.close()
        with files.open_output_stream(f"{name}.idx.tmp") as f:
            f.write(np.array([offsets, index], dtype="<i8").T.tobytes())
        for kind in ("rec", "idx"):
            files.move(f"{name}.{kind}.tmp", f"{name}.{kind}")
        paths = [f"{folder}/{name.rpartition('/')[2]}.{kind}" for kind in ("rec", "idx")]
        yield pa.RecordBatch.from_pylist([{"part": part, "records": len(offsets), "tokens": before, "data": paths[0], "index": paths[1]}])

    ordered = doc_text(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(run, "part long, records long, tokens long, data string, index string"), "manifest")


def _stream(uri: str):
    files, path = fs.FileSystem.from_uri(uri)
    return files, path


def read_records(manifest: DataFrame) -> DataFrame:
    """doc_id, start (tokens of all records before it), ids array<int>, in file order within a part."""
    return _read(manifest, digest=False)


def read_digests(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every record, read back and checked."""
    return _read(manifest, digest=True)


def _read(manifest: DataFrame, digest: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            files, path = _stream(row["data"])
            start, done, out = row["before"], 0, []
            with files.open_input_stream(path, buffer_size=1 << 20) as f:
                while (payload := read_frame(f)) is not None:
                    doc_id, ids = unpack_ids(payload)
                    out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())) if digest else (doc_id, start, ids.astype(np.int32)))
                    start, done = start + len(ids), done + 1
                    if len(out) == (8192 if digest else 256):
                        yield batch(out)
                        out = []
            if done != row["records"]:
                raise ValueError(f"{path}: {done} records; the manifest has {row['records']}")
            if out:
                yield batch(out)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 4 if digest else [pa.int64(), pa.int64(), pa.list_(pa.int32())]
        names = ["doc_id", "start", "n_tokens", "ids_crc32"] if digest else ["doc_id", "start", "ids"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    # The window is over one row per file.
    before = F.coalesce(F.sum("tokens").over(W.Window.orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    parts = manifest.select("part", "records", "data", before.cast("long").alias("before"))
    n = max(1, manifest.count())
    return parts.repartition(n, "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" if digest else "doc_id long, start long, ids array<int>")


def read_index(manifest: DataFrame) -> DataFrame:
    """data (path), offset, before (tokens before it in the file) of every record, from the index files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            files, path = _stream(row["index"])
            with files.open_input_stream(path) as f:
                got = np.frombuffer(f.read(), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array([row["data"]] * len(got), pa.string()), pa.array(got[:, 0]), pa.array(got[:, 1])], ["data", "offset", "before"])

    return manifest.select("index", "data").mapInArrow(run, "data string, offset long, before long")


def shuffled_records(manifest: DataFrame, seed: int, partitions: int) -> DataFrame:
    """doc_id, ids of all records, dealt over `partitions` and ordered within each by a hash of place and seed.

    Only index rows are shuffled; each record is then read at its offset.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict = {}
        for b in batches:
            out = []
            for row in b.to_pylist():
                if row["data"] not in opened:
                    if len(opened) >= 64:
                        opened.pop(next(iter(opened))).close()
                    files, path = _stream(row["data"])
                    opened[row["data"]] = files.open_input_file(path)
                f = opened[row["data"]]
                f.seek(row["offset"])
                out.append(unpack_ids(read_frame(f)))
                if len(out) == 256:
                    yield batch(out)
                    out = []
            if out:
                yield batch(out)

    def batch(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1].astype(np.int32) for r in rows], pa.list_(pa.int32()))], ["doc_id", "ids"])

    order = F.xxhash64(F.lit(seed), "data", "offset")
    return read_index(manifest).withColumn("_order", order).repartition(partitions, "_order").sortWithinPartitions("_order").select("data", "offset").mapInArrow(run, "doc_id long, ids array<int>")


def records(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Writes docs to the shared folder and returns what reading the files back gives (see read_digests)."""
    return read_digests(write_records(docs, tokenizer, end_id, new_folder(docs.sparkSession, "records")))
