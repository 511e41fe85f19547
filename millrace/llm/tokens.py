"""Whole-text encoding with the tokenizers library, by pieces of text that are looked up or encoded once a block.

Texts are cut, as bytes and in numpy, only where the tokenizer's own pre-tokenizer always cuts, so the ids of
the pieces, joined, are the ids of the whole text. Arrow finds the different pieces of a block; the library
encodes those that a worker hasn't met lately, many in one call. The cache has two generations of CACHE_BYTES
each, and texts are read CHUNK bytes at a time, so memory stays bounded however long a text is.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

#: Bytes of one generation of the cache, as counted by ENTRY and the lengths.
CACHE_BYTES = 64 << 20
#: Memory of one cached piece besides its bytes and ids.
ENTRY = 150
#: Pieces longer than this are encoded but not kept.
LONG_PIECE = 64
#: Pieces in one call of the library.
CALL_PIECES = 200
#: Bytes of text that are cut together.
CHUNK = 8 << 20
#: A word that the pre-tokenizers here leave whole: Latin letters (composed, each with one lower-case letter), one mark at most.
_WORD = re.compile("( ?)([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([.,;:!?]?)")

# Kinds of bytes. UNSURE is next to nothing that may be cut; LETTERS are ASCII only, WIDE are all bytes over 127.
SPACE, LINE, UNSURE, LETTERS, DIGITS, QUOTE, MARKS, WIDE = range(8)


def _kinds() -> np.ndarray:
    kinds = np.full(256, MARKS, np.uint8)
    kinds[[9, 11, 12, 13, 32]] = SPACE
    kinds[10] = LINE
    kinds[28:32] = UNSURE  # white space to some, not to others
    kinds[[*range(65, 91), *range(97, 123)]] = LETTERS
    kinds[48:58] = DIGITS
    kinds[39] = QUOTE  # may begin a clitic, so it is never cut off
    kinds[128:] = WIDE
    return kinds


_KINDS = _kinds()
#: By kinds of the byte before and the byte itself: whether a piece may begin there.
_CUTS = np.zeros((8, 8), bool)
_CUTS[np.ix_([LETTERS, DIGITS, QUOTE, MARKS, WIDE], [SPACE, LINE])] = True
for _a in (LETTERS, DIGITS, MARKS):
    for _b in (LETTERS, DIGITS, MARKS):
        _CUTS[_a, _b] = _a != _b
_CUTS = _CUTS.reshape(-1)
_LOWER = np.array([b + 32 * (65 <= b < 91) for b in range(256)], np.uint8)
#: First bytes of the marks that compose with ASCII letters.
_COMPOSE = np.isin(np.arange(256), [0xCC, 0xCD])
#: First bytes of white space beyond ASCII, as UTF-8.
_LEADS = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])


def byte_letters() -> list[str]:
    """The printable letter that byte-level BPE writes for each byte: itself where visible, else the next from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in own else next(spare)) for b in range(256)]


_BYTES = byte_letters()
#: Latin letters beyond ASCII, as the byte-level letters of their UTF-8.
_LETTERS = {c: "".join(_BYTES[b] for b in chr(c).encode()) for c in range(0xC0, 0x250)}


def kinds_of(raw: np.ndarray) -> np.ndarray:
    """The kind of each byte; white space beyond ASCII counts as SPACE in all its bytes, one doubtful sign as UNSURE."""
    kinds = _KINDS[raw]
    at = np.flatnonzero(_LEADS[raw])
    if len(at):
        at = at[at < len(raw) - 1]
        a, b = raw[at], raw[at + 1]
        c = raw[np.minimum(at + 2, len(raw) - 1)]
        two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        general = (a == 0xE2) & (b == 0x80) & (((c >= 0x80) & (c <= 0x8A)) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
        three = general | ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE2) & (b == 0x81) & (c == 0x9F)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
        doubtful = (a == 0xE1) & (b == 0xA0) & (c == 0x8E)
        for found, size, kind in ((two, 2, SPACE), (three, 3, SPACE), (doubtful, 3, UNSURE)):
            for k in range(size):
                kinds[at[found] + k] = kind
    return kinds


def cut_points(raw: np.ndarray) -> np.ndarray:
    """Places where a piece of a text may begin: before white space, between ASCII letters, digits and marks, and after
    a line feed that stands alone. Both kinds of tokenizer here end a token at all of them, whatever follows."""
    kinds = kinds_of(raw)
    cut = np.empty(len(raw), bool)
    cut[:1] = True
    cut[1:] = _CUTS[(kinds[:-1] << 3) | kinds[1:]]
    lines = np.flatnonzero(kinds[:-1] == LINE) if len(raw) else np.empty(0, np.int64)
    if len(lines):
        alone = (kinds[lines + 1] > UNSURE) & (kinds[np.maximum(lines - 1, 0)] > UNSURE)
        cut[lines[alone] + 1] = True
    return cut


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column in a row, and the place where each text begins (and the end); nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at - at[0]


def chunks(column: pa.Array, whole: list[bytes], lower: bool = False, size: int = CHUNK) -> Iterator[tuple[np.ndarray, list[bytes], np.ndarray]]:
    """The pieces of all texts, a chunk at a time: index of each into the different pieces, those, and the number of
    pieces of the column before the end of each text that ends in the chunk. `whole` are strings never cut into.
    With lower, ASCII letters are in lower case where nothing is there to be composed with them."""
    raw, starts = text_buffers(column)
    at = done = pieces = 0
    while at < len(raw) or done < len(column):
        step = size
        while True:
            end = min(at + step, len(raw))
            part = raw[at:end]
            cut = cut_points(part)
            cut[starts[(starts >= at) & (starts < end)] - at] = True
            _keep_whole(part, at, starts, whole, cut)
            places = np.flatnonzero(cut)
            if end == len(raw):
                break
            # What may go on beyond the end waits; a longer string never begins in it.
            last = places[places <= len(part) - 16]
            if len(last) > 1:
                end = at + int(last[-1])
                places = last[:-1]
                break
            step *= 2
        edges = np.append(places, end - at).astype(np.int32)
        part = raw[at:end]
        if lower and not _COMPOSE[part].any():
            part = _LOWER[part]
        data = pa.py_buffer(np.ascontiguousarray(part))
        found = pa.Array.from_buffers(pa.binary(), len(places), [None, pa.py_buffer(edges), data]).dictionary_encode()
        stop = np.searchsorted(starts, end, side="right") - 1  # texts that end here: their end is the start of the next
        ends = starts[done + 1 : stop + 1]
        yield found.indices.to_numpy(), _values(found.dictionary), pieces + np.searchsorted(places, ends - at, side="left")
        done, at, pieces = done + len(ends), end, pieces + len(places)


def _values(column: pa.Array) -> list[bytes]:
    """The values of a binary column (32-bit places, no nulls), faster than one by one."""
    _, places, data = column.buffers()
    ends, data = np.frombuffer(places, np.int32)[: len(column) + 1].tolist(), data.to_pybytes() if data else b""
    return [data[a:z] for a, z in zip(ends, ends[1:], strict=False)]


def _keep_whole(part: np.ndarray, at: int, starts: np.ndarray, whole: list[bytes], cut: np.ndarray) -> None:
    """Puts cuts around the strings of `whole` that stand in one text, and none into them."""
    data = part.tobytes() if whole else b""
    for w in whole:
        k = data.find(w)
        while k >= 0:
            if np.searchsorted(starts, at + k, side="right") == np.searchsorted(starts, at + k + len(w) - 1, side="right"):
                cut[k + 1 : k + len(w)] = False
                cut[k] = True
                if k + len(w) < len(cut):
                    cut[k + len(w)] = True
            k = data.find(w, k + len(w))


def text_slices(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(doc_id, text) columns of consecutive rows with about `limit` bytes of text; batches have doc_id and text first."""
    for b in batches:
        ids, texts = b.column(0), b.column(1)
        ends = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        a = 0
        while a < len(texts):
            z = max(a + 1, int(np.searchsorted(ends, ends[a] + limit)))
            z = min(z, len(texts))
            yield ids.slice(a, z - a), texts.slice(a, z - a)
            a = z


class TextEncoder:
    """The ids that the library gives for whole texts.

    Two kinds of file are cut into pieces: a pre-tokenizer that drops white space, and byte-level BPE whose
    pattern attaches one space to the next word; in both, added tokens are pieces of their own. With any other
    file a text is one piece. A null or empty text has no ids.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = {a["content"].encode(): a["id"] for a in spec["added_tokens"]}
        odd = lambda a: a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] or re.search(r"\s", a["content"])
        apart = all(not x.startswith(y[k:]) for x in self.added for y in self.added for k in range(1, len(y)))
        plain = bool(self.added) and apart and max(map(len, self.added)) <= 16 and not any(map(odd, spec["added_tokens"]))
        pre = spec["pre_tokenizer"] or {}
        first = pre.get("pretokenizers", [pre])[0]
        self.drops_space = plain and first.get("type") == "Split" and first.get("behavior") == "Removed" and "Lowercase" in json.dumps(spec["normalizer"])
        self.joins_space = plain and first is pre and first.get("type") == "ByteLevel" and bool(first.get("use_regex")) and not first.get("add_prefix_space") and spec["normalizer"] is None
        self.cuts = self.drops_space or self.joins_space
        self.model = self.tokenizer.model
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.held = 0
        if plain:
            self.mark = next(reversed(self.added)).decode()
            self.mark_id = self.added[self.mark.encode()]

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()

    def single(self, piece: bytes) -> bytes | None:
        """The ids of a word of Latin letters with at most one mark behind: the model's own, as the pre-tokenizer leaves them whole."""
        tokenize = self.model.tokenize
        if piece.isascii() and (piece.isalpha() or (piece[:1] == b" " and piece[1:].isalpha())):
            word = piece.decode()
            if self.drops_space:
                word = word.strip(" ").lower()
            return array("I", [t.id for t in tokenize(word.replace(" ", "\u0120"))]).tobytes()
        found = _WORD.fullmatch(piece.decode())
        if not found:
            return None
        space, word, mark = found.groups()
        if self.drops_space:
            space, word = "", word.lower()
        ids = [t.id for t in tokenize(("\u0120" if space else "") + word.translate(_LETTERS))]
        if mark:
            ids += [t.id for t in tokenize(mark)]
        return array("I", ids).tobytes()

    def ids_of(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as little-endian uint32 bytes."""
        young, old = self.young, self.old
        out: list = list(map(young.get, pieces))
        todo = []
        for k in [k for k, v in enumerate(out) if v is None]:
            p = pieces[k]
            ids = old.get(p)
            if ids is None:
                if p in self.added:
                    out[k] = np.array([self.added[p]], "<u4").tobytes()
                    continue
                if len(p) > LONG_PIECE:
                    out[k] = self.whole(p.decode())
                    continue
                ids = self.single(p)
                if ids is None:
                    todo.append(k)
                    continue
            out[k] = young[p] = ids
            self.held += ENTRY + len(p) + len(ids)
        for i in range(0, len(todo), CALL_PIECES):
            group = todo[i : i + CALL_PIECES]
            ids = np.asarray(self.tokenizer.encode_batch_fast([self.mark.join([pieces[k].decode() for k in group])], add_special_tokens=False)[0].ids, dtype="<u4")
            data, at = ids.tobytes(), 0
            for k, cut in zip(group, [*np.flatnonzero(ids == self.mark_id).tolist(), len(ids)], strict=True):
                out[k] = young[pieces[k]] = data[4 * at : 4 * cut]
                self.held += ENTRY + len(pieces[k]) + 4 * (cut - at)
                at = cut + 1
        if self.held > CACHE_BYTES:
            self.old, self.young, self.held = young, {}, 0
        return out

    def column(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids (uint32) of all texts in a row, each followed by end_id if there is one, and the place where each begins (and the end)."""
        if not self.cuts:
            each = [self.whole(t) if t else b"" for t in texts.to_pylist()]
            ids, ends = [np.frombuffer(b"".join(each), "<u4")], np.cumsum([len(e) // 4 for e in each], dtype=np.int64)
        else:
            ids, counts, stops = [np.empty(0, "<u4")], [np.zeros(1, np.int64)], []
            for index, pieces, ends in chunks(texts, list(self.added), self.drops_space):
                each = self.ids_of(pieces)
                size = np.fromiter(map(len, each), np.int64, len(each)) >> 2
                first = np.cumsum(size) - size
                n = size[index]
                stop = np.cumsum(n)
                flat = np.frombuffer(b"".join(each), "<u4")
                ids.append(flat[np.repeat(first[index] - stop + n, n) + np.arange(stop[-1] if len(stop) else 0)])
                counts.append(stop + counts[-1][-1])
                stops.append(ends)
            upto = np.concatenate(counts)
            ends = upto[np.concatenate(stops)] if stops else np.empty(0, np.int64)
        flat = np.concatenate(ids)
        starts = np.r_[np.int64(0), ends]
        if end_id is None:
            return flat, starts
        starts = starts + np.arange(len(starts))
        out = np.empty(len(flat) + len(ends), "<u4")
        own = np.ones(len(out), bool)
        own[starts[1:] - 1] = False
        out[own] = flat
        out[~own] = end_id
        return out, starts


def normal(text: str) -> str:
    """The normal form of word tokenizers: composed, sigma without its final form, lower case."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


@cache
def encoder(path: str) -> TextEncoder:
    """One encoder per file and Python worker."""
    return TextEncoder(path)
