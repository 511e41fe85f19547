"""Removal of repeated byte strings by a collection's Burrows-Wheeler transform and common prefixes.

A string of SPAN bytes that starts earlier (smaller doc_id, or earlier in the same document) marks its
bytes for removal. Inserting one symbol per document a round takes as many rounds as the longest document
has bytes, so the collection isn't made of whole documents but of pieces of at most SPAN + WINDOW - 1
bytes. A piece holds the windows of SPAN bytes that share one anchor: the GRAM bytes of least hash in the
window. Equal windows have equal anchors, so pieces are dealt out by anchor and every pair of equal
windows meets. Equal pieces are merged first, by 96 bits of their hash and the anchor; those that share an
anchor but differ become one collection, whose transform and common prefixes are built column by column, in
files that each round reads and writes from end to end.

A document is a doc_id with a text: rows that repeat both are one document, rows that repeat a doc_id with
another text are documents of the same rank, neither of which is earlier. Among them a document is named by
its doc_id and a variant, the text's hash; everywhere else the variant is 0.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import broadcast_if_small, new_folder, written

SPAN = 100
GRAM = 24
#: Grams in a window of SPAN bytes.
WINDOW = SPAN - GRAM + 1
#: Bytes hashed together; a longer text is read in overlapping parts.
PART = 1 << 18
#: Pieces in one collection, as far as one anchor has no more.
COLLECTION = 1000
#: Bytes of a collection's files up to which they stay in memory.
FILE_MEMORY = 8 << 20
#: An anchor is hot if at least HOT_LEAST pieces of one document in SAMPLE have it, and at least one in HOT_MOST of
#: them; so at most HOT_MOST anchors are. Windows with a hot anchor are dealt out one by one.
HOT_LEAST, HOT_MOST, SAMPLE = 200, 1_000_000, 32
#: Different pieces of one anchor that make up a collection together; of an anchor that has more, windows are dealt out.
LARGE = 50_000
#: Bytes of text whose pieces one task brings together.
BUCKET_BYTES = 64 << 20

_NO_ID = -(1 << 63)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * _ODD[0]
    x ^= x >> np.uint64(32)
    return x


_BYTES = _mix(_mix(np.arange(1, 257, dtype=np.uint64) * _ODD[1]) + _ODD[2])


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mix(a * _ODD[1] + b)


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on (GRAM is 16 + 8)."""
    h = _BYTES[raw]
    for k in (1, 2, 4):
        h = _pair(h[:-k], h[k:])
    h8 = h
    h16 = _pair(h8[:-8], h8[8:])
    n = len(raw) - GRAM + 1
    return _pair(h16[:n], h8[16 : 16 + n])


def anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the window at each place: the place of its anchor; and the grams' hashes. Ties go to the first gram."""
    h = gram_hashes(raw)
    low = np.uint64((1 << 20) - 1)
    m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    for k in (1, 2, 4, 8, 16, 32):
        m = np.minimum(m[:-k], m[k:])
    n = len(raw) - SPAN + 1
    return (np.minimum(m[:n], m[WINDOW - 64 : WINDOW - 64 + n]) & low).astype(np.int64), h


def _parts(texts: list[str | None]) -> Iterator[tuple[list[tuple[int, int, int, int]], bytes]]:
    """Texts as bytes, joined into parts of about PART: (text, its place in the part, its start in the text, bytes)."""
    found, held, size = [], [], 0
    for k, t in enumerate(texts):
        raw = t.encode() if t else b""
        for at in range(0, max(0, len(raw) - SPAN + 1), PART):
            piece = raw[at : at + PART + SPAN - 1]
            if len(piece) >= SPAN:
                found.append((k, size, at, len(piece)))
                held.append(piece)
                size += len(piece)
                if size >= PART:
                    yield found, b"".join(held)
                    found, held, size = [], [], 0
    if found:
        yield found, b"".join(held)


def pieces(texts: list[str | None], hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pieces of all texts: anchor hash, two parts of the piece's hash, text, start, windows; `hot` is a sorted array of anchors."""
    digest, long = xxhash.xxh3_64_intdigest, xxhash.xxh3_128_digest
    out: list[list[np.ndarray]] = []
    for found, raw in _parts(texts):
        place, h = anchors(np.frombuffer(raw, np.uint8))
        text, at, start, size = (np.array(x, dtype=np.int64) for x in zip(*found, strict=True))
        # Windows that lie in one text; each run of them with one anchor is a piece.
        inside = np.concatenate([np.arange(a, a + n - SPAN + 1) for a, n in zip(at, size, strict=True)])
        of = np.repeat(np.arange(len(at)), size - SPAN + 1)
        p = place[inside]
        first = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (of[1:] != of[:-1])])
        windows = np.diff(np.r_[first, len(p)])
        anchor, begin, of = h[p[first]], inside[first], of[first]
        if len(hot):
            burns = np.isin(anchor, hot)
            if burns.any():
                reps = np.where(burns, windows, 1)
                k = np.repeat(np.arange(len(first)), reps)
                step = np.arange(len(k)) - np.repeat(np.cumsum(reps) - reps, reps)
                burns, begin, of, windows, anchor = burns[k], begin[k] + step, of[k], np.where(burns[k], 1, windows[k]), anchor[k]
                for i in np.flatnonzero(burns).tolist():
                    b = int(begin[i])
                    anchor[i] = digest(raw[b : b + SPAN], 1)
        ends = begin + windows + SPAN - 1
        whole = np.frombuffer(b"".join([long(raw[a:b]) for a, b in zip(begin.tolist(), ends.tolist(), strict=True)]), ">u8").reshape(-1, 2)
        out.append([anchor, whole[:, 0].astype(np.uint64), (whole[:, 1] >> np.uint64(32)).astype(np.uint32), text[of], begin - at[of] + start[of], windows])
    if not out:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.uint32), *(np.empty(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


_HEAD = struct.Struct("<IIBB")


def _to_blob(doc, variant, start, windows, anchor=None, whole=None, more=None) -> bytes:
    """Places of pieces, as bytes; with their hashes, unless they are later places. Of an anchor half goes: the bucket tells it apart enough."""
    both = np.rec.fromarrays([doc, variant])
    names, index = np.unique(both, return_inverse=True)
    plain = not variant.any()
    parts = [_HEAD.pack(len(doc), len(names), plain, anchor is None), names.f0.astype("<i8").tobytes()]
    if not plain:
        parts.append(names.f1.astype("<i8").tobytes())
    parts += [index.astype("<u4" if len(names) > 65535 else "<u2").tobytes(), start.astype("<u4").tobytes(), windows.astype("u1").tobytes()]
    if anchor is not None:
        parts += [(anchor >> np.uint64(32)).astype("<u4").tobytes(), whole.astype("<u8").tobytes(), more.astype("<u4").tobytes()]
    return b"".join(parts)


def _from_blob(blob: bytes) -> list[np.ndarray]:
    n, m, plain, bare = _HEAD.unpack_from(blob)
    at = _HEAD.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(blob, kind, count, at)
        at += got.nbytes
        return got

    doc = take("<i8", m)
    variant = np.zeros(m, np.int64) if plain else take("<i8", m)
    index = take("<u4" if m > 65535 else "<u2", n)
    out = [doc[index], variant[index], take("<u4", n).astype(np.int64), take("u1", n).astype(np.int64)]
    return out if bare else [*out, take("<u4", n), take("<u8", n), take("<u4", n)]


def _after(fresh: np.ndarray, doc: np.ndarray, variant: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Of places sorted by string, doc, variant and start (fresh where a string begins), those that a place of the same string is earlier than."""
    n = np.arange(len(doc))
    string = np.maximum.accumulate(np.where(fresh, n, 0))
    new = fresh.copy()
    new[1:] |= (doc[1:] != doc[:-1]) | (variant[1:] != variant[:-1])
    own = np.maximum.accumulate(np.where(new, n, 0))
    return (doc != doc[string]) | (start != start[own])


def _later(doc, variant, start, anchor, whole, more) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by piece and place; and in that order whether a piece begins, and whether a place is a later one of its piece."""
    order = np.lexsort((start, variant, doc, whole, anchor)) if variant.any() else np.lexsort((start, doc, whole, anchor))
    a, w, m = anchor[order], whole[order], more[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (w[1:] != w[:-1]) | (m[1:] != m[:-1])
    return order, fresh, _after(fresh, doc[order], variant[order], start[order])


def _blocks(batches: Iterator[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """doc, variant, texts in blocks of about `limit` characters (columns doc, variant, text)."""
    doc, variant, texts, size = [], [], [], 0
    for b in batches:
        for d, v, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            t = t.as_py()
            doc.append(d)
            variant.append(v)
            texts.append(t)
            size += len(t) if t else 1
            if size >= limit:
                yield np.array(doc, np.int64), np.array(variant, np.int64), texts
                doc, variant, texts, size = [], [], [], 0
    if doc:
        yield np.array(doc, np.int64), np.array(variant, np.int64), texts


def _scan(docs: DataFrame, buckets: int, hot: np.ndarray) -> DataFrame:
    """bucket, later, blob: the pieces of each block of texts. Of equal pieces of a block only the first is dealt out by anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs_of, variants, texts in _blocks(batches):
            anchor, whole, more, text, start, windows = pieces(texts, hot)
            if not len(anchor):
                continue
            doc, variant = docs_of[text], variants[text]
            order, _, later = _later(doc, variant, start, anchor, whole, more)
            doc, variant, start, windows, anchor, whole, more = (x[order] for x in (doc, variant, start, windows, anchor, whole, more))
            rows = []
            if later.any():
                rows.append((int(anchor[0] % np.uint64(buckets)), True, _to_blob(*(c[later] for c in (doc, variant, start, windows)))))
            columns = [c[~later] for c in (doc, variant, start, windows, anchor, whole, more)]
            bucket = (columns[4] % np.uint64(buckets)).astype(np.int64)
            by = np.lexsort((columns[2], columns[0], bucket))
            columns, bucket = [c[by] for c in columns], bucket[by]
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            for a, b in zip(cuts, np.r_[cuts[1:], len(bucket)], strict=True):
                rows.append((int(bucket[a]), False, _to_blob(*(c[a:b] for c in columns))))
            for i in range(0, len(rows), 512):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[i : i + 512], strict=True), (pa.int32(), pa.bool_(), pa.binary()), strict=True)], ["bucket", "later", "blob"])

    return docs.select("doc", "variant", "text").mapInArrow(run, "bucket int, later boolean, blob binary")


def _hot_anchors(docs: DataFrame) -> np.ndarray:
    """The hot anchors by a sample of the documents; they only say how windows are dealt out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.uint64)
        for _, _, texts in _blocks(batches):
            anchor, count = np.unique(pieces(texts, none)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(count.astype(np.int64))], ["anchor", "n"])

    sample = docs.select("doc", "variant", "text").where(F.pmod(F.xxhash64("doc"), F.lit(SAMPLE)) == 0)
    counted = written(sample.mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_LEAST), "anchors")
    total = counted.agg(F.sum("n")).first()[0] or 0
    rows = counted.where(F.col("n") * HOT_MOST >= total).select("anchor").collect()
    return np.sort(np.array([r["anchor"] for r in rows], dtype=np.int64).view(np.uint64))


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, variant, place (start * 128 + windows), anchor: later places of equal pieces (anchor null), and first places of
    pieces whose anchor other pieces have, too. A partition is one bucket."""
    blobs, bucket = [], 0
    for b in batches:
        for bucket, later, blob in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if later:
                yield _places(*_from_blob(blob), None)
            else:
                blobs.append(_from_blob(blob))
    if not blobs:
        return
    doc, variant, start, windows, anchor, whole, more = (np.concatenate(x) for x in zip(*blobs, strict=True))
    del blobs
    order, fresh, later = _later(doc, variant, start, anchor, whole, more)
    doc, variant, start, windows, anchor = (x[order] for x in (doc, variant, start, windows, anchor))
    if later.any():
        yield _places(*(x[later] for x in (doc, variant, start, windows)), None)
    # Anchors with more than one piece.
    first = np.ones(len(anchor), bool)
    first[1:] = anchor[1:] != anchor[:-1]
    group = np.cumsum(first) - 1
    shared = (np.bincount(group[fresh]) > 1)[group] & ~later
    if shared.any():
        name = (anchor[shared].astype(np.int64) << 24) | (bucket & 0xFFFFFF)
        yield _places(*(x[shared] for x in (doc, variant, start, windows)), name)


def _places(doc: np.ndarray, variant: np.ndarray, start: np.ndarray, windows: np.ndarray, anchor: np.ndarray | None) -> pa.RecordBatch:
    of = pa.nulls(len(doc), pa.int64()) if anchor is None else pa.array(anchor)
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(variant), pa.array(start * 128 + windows), of], ["doc", "variant", "place", "anchor"])


class ColumnFile:
    """One array of a collection, read and written from end to end below a shared folder; small ones stay in memory."""

    def __init__(self, kind: str, folder: str):
        self.kind, self.folder = np.dtype(kind), folder
        self.held: np.ndarray | None = None
        self.path: str | None = None

    def put(self, values: np.ndarray) -> None:
        """What is read next; the old file goes."""
        self.close()
        values = values.astype(self.kind, copy=False)
        if values.nbytes <= FILE_MEMORY:
            self.held = values
            return
        files, root = fs.FileSystem.from_uri(self.folder)
        files.create_dir(root, recursive=True)
        self.path = f"{root}/{uuid.uuid4().hex}"
        with files.open_output_stream(self.path) as f:
            f.write(memoryview(np.ascontiguousarray(values)).cast("B"))

    def get(self) -> np.ndarray:
        if self.path is None:
            return self.held
        with fs.FileSystem.from_uri(self.folder)[0].open_input_stream(self.path) as f:
            return np.frombuffer(f.read(), self.kind)

    def close(self) -> None:
        if self.path is not None:
            fs.FileSystem.from_uri(self.folder)[0].delete_file(self.path)
        self.held = self.path = None


def collection_bwt(strings: list[bytes], folder: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """String number, suffix length and common prefix with the suffix before, of all non-empty suffixes in order.

    Strings end in marks that differ, in their order, and come before all bytes. Round j inserts the suffix of
    length j of every string that has one. The transform is kept as the places of each symbol in order (its
    stable sort), which only shifts when suffixes are inserted: the place of the suffix that a symbol begins is
    the symbol's own place in that sort. A new suffix shares with its neighbour of the same first symbol one more
    than the least common prefix between the two symbols' places. Common prefixes count up to 255. Each round
    reads the files of the round before from end to end and writes new ones, below folder.
    """
    m = len(strings)
    size = np.array([len(s) for s in strings], dtype=np.int64)
    joined = np.frombuffer(b"".join(strings), np.uint8)
    ends = np.cumsum(size)
    # Symbols count from 1; 0 is the mark.
    symbols = np.concatenate(([0], joined.astype(np.int64) + 1))
    small = m + len(joined) < 1 << 23
    bits, wide = (23, "<u4") if small else (40, "<u8")
    low = (1 << bits) - 1
    # Number of the string and length of the suffix in one number, too.
    shift, named = (8, "<u4") if size.max(initial=0) < 256 and m < 1 << 24 else (32, "<u8")
    symbol = symbols[np.where(size > 0, ends, 0)]
    keys = np.sort(symbol << bits | np.arange(m))
    files = [ColumnFile(k, folder) for k in (wide, named, "u1")]
    for f, x in zip(files, (keys, np.arange(m) << shift, np.zeros(m)), strict=True):
        f.put(x)
    newest = np.flatnonzero(size > 0)  # places of the suffixes of the round before that go on, and their strings
    own, at = newest, np.searchsorted(keys, symbol[newest] << bits | newest)
    for j in range(1, int(size.max(initial=0)) + 1):
        keys, name, common = (f.get() for f in files)
        marks = int(np.searchsorted(keys, keys.dtype.type(1 << bits)))
        to = at - marks + m  # after the m marks alone come the suffixes, by first symbol
        here, last = keys[at], len(keys) - 1
        tail = np.append(common, np.uint8(0))

        def between(first: np.ndarray, stop: np.ndarray, tail: np.ndarray = tail) -> np.ndarray:
            """The least common prefix at first + 1 .. stop, one more, 255 at most."""
            edges = np.empty(2 * len(first), np.int64)
            edges[0::2], edges[1::2] = first + 1, stop + 1
            return np.minimum(np.minimum.reduceat(tail, edges)[0::2], 254) + np.uint8(1)

        one, two = keys[np.maximum(at - 1, 0)], keys[np.minimum(at + 1, last)]
        has = (at > 0) & (one >> bits == here >> bits)
        before = np.zeros(len(at), np.uint8)
        if has.any():
            before[has] = between((one[has] & low).astype(np.int64), newest[has])
        has = (at < last) & (two >> bits == here >> bits)
        follows = between(newest[has], (two[has] & low).astype(np.int64)) if has.any() else None
        old = np.ones(len(name) + len(to), bool)
        old[to] = False

        def merge(x: np.ndarray, new: np.ndarray, old: np.ndarray, places: np.ndarray) -> np.ndarray:
            out = np.empty(len(old), x.dtype)
            out[old] = x
            out[places] = new
            return out

        prefixes = merge(common, before, old, to)
        if follows is not None:
            prefixes[to[has] + 1] = follows
        names = merge(name, (own << shift) + j, old, to)
        # Old symbols move to their suffixes' new places; those before the new suffixes come in.
        moved = np.flatnonzero(old).astype(keys.dtype).take((keys & keys.dtype.type(low)).astype(np.int64))
        moved |= keys & keys.dtype.type(~low & ((1 << 8 * keys.itemsize) - 1))
        after = symbols[np.where(size[own] > j, ends[own] - j, 0)]
        new = (after << bits | to).astype(keys.dtype)
        rank = np.argsort(new)
        spot = np.empty(len(new), np.int64)
        spot[rank] = np.searchsorted(moved, new[rank]) + np.arange(len(new))
        old = np.ones(len(old), bool)
        old[spot] = False
        for f, x in zip(files, (merge(moved, new, old, spot), names, prefixes), strict=True):
            f.put(x)
        on = after > 0
        newest, own, at = to[on], own[on], spot[on]
    _, name, common = (f.get() for f in files)
    for f in files:
        f.close()
    name = name[m:].astype(np.int64)
    return name >> shift, name & ((1 << shift) - 1), common[m:].astype(np.int64)


def later_windows(strings: list[bytes], doc: np.ndarray, variant: np.ndarray, start: np.ndarray, folder: str) -> tuple[np.ndarray, ...]:
    """Document, variant and start of each window of SPAN bytes that stands earlier in another of the strings."""
    owner, length, common = collection_bwt(strings, folder)
    size = np.array([len(s) for s in strings], dtype=np.int64)
    full = common >= SPAN  # equal in SPAN bytes to the suffix before
    member = full.copy()
    member[:-1] |= full[1:]
    owner, place, full = owner[member], (size[owner] - length)[member], full[member]
    kind = np.cumsum(~full)
    d, v, s = doc[owner], variant[owner], start[owner] + place
    order = np.lexsort((s, v, d, kind))
    kind, d, v, s = kind[order], d[order], v[order], s[order]
    fresh = np.ones(len(kind), bool)
    fresh[1:] = kind[1:] != kind[:-1]
    later = _after(fresh, d, v, s)
    return d[later], v[later], s[later]


def _runs(d: np.ndarray, v: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    """doc, variant, place of windows that begin one after the other, up to 127 a row."""
    order = np.lexsort((s, v, d))
    d, v, s = d[order], v[order], s[order]
    same = (d[1:] == d[:-1]) & (v[1:] == v[:-1])
    fresh = np.ones(len(d), bool)
    fresh[1:] = ~same | (s[1:] != s[:-1])
    d, v, s = d[fresh], v[fresh], s[fresh]
    breaks = np.ones(len(d), bool)
    breaks[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1]) | (s[1:] != s[:-1] + 1)
    n = np.arange(len(d))
    first = np.flatnonzero((n - np.maximum.accumulate(np.where(breaks, n, 0))) % 127 == 0)
    return pa.RecordBatch.from_arrays([pa.array(d[first]), pa.array(v[first]), pa.array(s[first] * 128 + np.diff(np.r_[first, len(d)]))], ["doc", "variant", "place"])


def _collections(folder: str):
    """doc, variant, place: later windows among the pieces of one partition (sorted by anchor; columns anchor, doc, variant, start, bytes)."""

    def solve(held: list[tuple]) -> pa.RecordBatch:
        _, doc, variant, start, strings = zip(*held, strict=True)
        return _runs(*later_windows(list(strings), *(np.array(x, np.int64) for x in (doc, variant, start)), folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if len(held) >= COLLECTION and row[0] != held[-1][0]:
                    yield solve(held)
                    held = []
                held.append(row)
        if held:
            yield solve(held)

    return run


_CUT = "anchor long, doc long, variant long, start long, bytes binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """anchor, doc, variant, start, bytes of the pieces that are asked for (columns doc, variant, text, asked); of large anchors, of each window."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    digest = xxhash.xxh3_64_intdigest

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["anchor", "doc", "variant", "start", "bytes"])

    for b in batches:
        out: list[tuple] = []
        for doc, variant, text, asked in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
            raw = (text.as_py() or "").encode()
            for q in asked:
                start, windows = divmod(q["place"], 128)
                if q["large"]:
                    for k in range(start, start + windows):
                        out.append((digest(raw[k : k + SPAN]) >> 1, doc, variant, k, raw[k : k + SPAN]))
                else:
                    out.append((q["anchor"], doc, variant, start, raw[start : start + windows + SPAN - 1]))
            if len(out) >= 8192:
                yield batch(out)
                out = []
        if out:
            yield batch(out)


def covered(places: list[int], size: int) -> list[tuple[int, int]]:
    """Maximal removed runs (from, to) of a document of `size` bytes, from the places of its later windows."""
    if not places:
        return []
    p = np.array(places, dtype=np.int64)
    a = p >> 7
    b = np.minimum(a + (p & 127) + SPAN - 1, size)
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    first = np.flatnonzero(np.r_[True, a[1:] > b[:-1]])
    last = np.r_[first[1:] - 1, len(a) - 1]
    return [(x, y) for x, y in zip(a[first].tolist(), b[last].tolist(), strict=True) if x < y]


def without(raw: bytes, gone: list[tuple[int, int]]) -> bytes:
    if not gone:
        return raw
    ends = [0, *(b for _, b in gone)]
    starts = [*(a for a, _ in gone), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(ends, starts, strict=True))


def _named(docs: DataFrame) -> DataFrame:
    """docs with columns __mr_doc and __mr_variant, which name each row's document; a null doc_id comes before all others."""
    doc, key = F.coalesce(docs["doc_id"].cast("long"), F.lit(_NO_ID)), F.xxhash64(docs["text"].cast("string"))
    ids = docs.select(doc.alias("__mr_doc"), key.alias("key")).groupBy("__mr_doc").agg(F.min("key").alias("a"), F.max("key").alias("b"))
    several = written(ids.where("a <> b").select("__mr_doc", F.lit(True).alias("__mr_several")), "several")
    named = docs.withColumn("__mr_doc", doc)
    n = several.count()
    if not n:
        return named.withColumn("__mr_variant", F.lit(0).cast("long"))
    joined = named.join(F.broadcast(several) if n <= 1_000_000 else several, "__mr_doc", "left")
    return joined.withColumn("__mr_variant", F.when(F.col("__mr_several"), F.xxhash64(F.col("text").cast("string"))).otherwise(F.lit(0).cast("long"))).drop("__mr_several")


def _with_places(docs: DataFrame) -> DataFrame:
    """docs with a column __mr_places: the later windows of each row's document (null: none)."""
    spark = docs.sparkSession
    named = _named(docs)
    texts = named.select(F.col("__mr_doc").alias("doc"), F.col("__mr_variant").alias("variant"), F.col("text").cast("string").alias("text"))
    size = docs.select(F.sum(F.octet_length(docs["text"].cast("string")))).first()[0] or 0
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    met = written(_scan(texts, buckets, _hot_anchors(texts)).repartitionById(buckets, "bucket").mapInArrow(_meet, "doc long, variant long, place long, anchor long"), "places")
    asked = met.where("anchor is not null")
    large = asked.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > LARGE).select("anchor", F.lit(True).alias("large"))
    large = broadcast_if_small(large, "large")
    told = asked.join(large, "anchor", "left").groupBy("doc", "variant").agg(F.collect_list(F.struct("place", "anchor", "large")).alias("asked"))
    # A repeated row gives each piece again, at the same place.
    cut = texts.join(told, ["doc", "variant"]).select("doc", "variant", "text", "asked").mapInArrow(_cut, _CUT)
    folder = new_folder(spark, "columns")
    found = cut.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_collections(folder), "doc long, variant long, place long")
    every = met.where("anchor is null").select("doc", "variant", "place").unionAll(found)
    lists = every.groupBy("doc", "variant").agg(F.collect_list("place").alias("__mr_places")).withColumnsRenamed({"doc": "__mr_doc", "variant": "__mr_variant"})
    return named.join(lists, ["__mr_doc", "__mr_variant"], "left").drop("__mr_doc", "__mr_variant")


def removals(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Null texts are empty. Rows that repeat doc_id and text are one document. Rows that repeat a doc_id with another
    text are documents of their own, neither earlier than the other. A null doc_id comes before all others. An
    empty table has no rows. Extra columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, text, places in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                raw = (text.as_py() or "").encode()
                gone = covered(places.as_py() or [], len(raw))
                out.append((doc_id, len(raw), sum(y - x for x, y in gone), len(gone), hashlib.sha256(without(raw, gone)).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _with_places(docs.select("doc_id", "text")).select("doc_id", "text", "__mr_places").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def removed_texts(docs: DataFrame) -> DataFrame:
    """docs with the repeated strings taken out of text, all columns kept; n_chars is set anew where text changed.

    A character of which only some bytes go is dropped whole. A text of which nothing is left becomes empty.
    """

    @F.pandas_udf("string")
    def keep(text, places):
        import pandas as pd

        out = []
        for t, p in zip(text, places, strict=True):
            if t is not None and p is not None and len(p):
                raw = t.encode()
                t = without(raw, covered([int(x) for x in p], len(raw))).decode("utf-8", "ignore")
            out.append(t)
        return pd.Series(out, dtype=object)

    joined = _with_places(docs)
    kept = joined.withColumn("__mr_kept", F.when(F.col("__mr_places").isNull(), F.col("text")).otherwise(keep("text", "__mr_places")))
    out = {"text": F.col("__mr_kept")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("__mr_places").isNull(), F.col("n_chars")).otherwise(F.length("__mr_kept").cast(docs.schema["n_chars"].dataType))
    return kept.select(*((out[c].alias(c)) if c in out else F.col(c) for c in docs.columns))
