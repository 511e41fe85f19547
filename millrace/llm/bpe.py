"""BPE encoding by a priority queue of merge ranks over a doubly linked symbol list, and decoding.

The file is read as data (vocabulary, merges, added tokens); the library itself isn't used.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from millrace.llm.common import doc_text, text_blocks
from millrace.llm.tokens import byte_letters, chunks, normal, text_slices

CACHE_WORDS = 300_000
#: Bytes of one generation of the cache of pieces, as counted by ENTRY and the lengths; longer pieces aren't kept.
CACHE_BYTES, ENTRY, LONG_PIECE = 64 << 20, 300, 64


class WordBpe:
    """The encoder and decoder of one tokenizer file with lower-casing, Split and ByteLevel steps and word-end marks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        steps = spec["pre_tokenizer"]["pretokenizers"]
        kinds = [s["type"] for s in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in steps] != ["Split", "ByteLevel"] or steps[1]["use_regex"]:
            raise ValueError(f"{path}: not a tokenizer of the kind that this operator encodes")
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.added_bytes = {t.encode(): i for t, i in self.added.items()}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        self.split_added = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        self.words = regex.compile(steps[0]["pattern"]["Regex"])
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        letters = byte_letters()
        self.first = [self.vocab[c] for c in letters]
        self.last = [self.vocab[c + self.end] for c in letters]
        self.by_word: dict[str, list[int]] = {}
        self.young: dict[bytes, tuple[int, bytes, bytes]] = {}
        self.old: dict[bytes, tuple[int, bytes, bytes]] = {}
        self.held = 0

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: the lowest rank is merged first, leftmost first among equals."""
        ids = [self.first[b] for b in word[:-1]] + [self.last[word[-1]]]
        n = len(ids)
        if n == 1:
            return ids
        ranks = self.merges
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        after[-1] = -1
        queue = [(r[0], i, r[1], ids[i], ids[i + 1]) for i in range(n - 1) if (r := ranks.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, new, a, b = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:  # stale: one of the two has gone or has changed
                continue
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if r := ranks.get((new, ids[k])):
                    heapq.heappush(queue, (r[0], i, r[1], new, ids[k]))
            h = before[i]
            if h >= 0 and (r := ranks.get((ids[h], new))):
                heapq.heappush(queue, (r[0], h, r[1], ids[h], new))
        return [i for i in ids if i >= 0]

    def piece(self, text: str) -> list[int]:
        """Ids of a text without added tokens."""
        out: list[int] = []
        for w in self.words.findall(normal(text)):
            ids = self.by_word.get(w)
            if ids is None:
                ids = self.merge(w.encode())
                if len(w) <= 64:
                    if len(self.by_word) >= CACHE_WORDS:
                        self.by_word.clear()
                    self.by_word[w] = ids
            out += ids
        return out

    def encode(self, text: str) -> list[int]:
        parts = self.split_added.split(text) if self.split_added else [text]
        return [i for p in parts if p for i in ([self.added[p]] if p in self.added else self.piece(p))]

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings of ids; the file names no decoder, so a space stands between them, as in the library."""
        return " ".join(self.names[i] for i in ids if i in self.names)

    def told(self, piece: bytes) -> tuple[int, bytes, bytes]:
        """Number of ids of a piece of text, those in decimal and the strings they stand for, each with a space behind."""
        if piece in self.added_bytes:
            ids = [self.added_bytes[piece]]
        elif piece.isascii() and (word := piece.strip(b" ")).isalpha():
            ids = self.merge(word.lower())
        else:
            ids = self.piece(piece.decode())
        return len(ids), b"".join([b"%d " % i for i in ids]), "".join([f"{self.names[i]} " for i in ids]).encode()

    def lookup(self, pieces: list[bytes]) -> list[tuple[int, bytes, bytes]]:
        """told() of each piece, from the cache as far as it goes."""
        young, old = self.young, self.old
        out: list = list(map(young.get, pieces))
        for k in [k for k, v in enumerate(out) if v is None]:
            p = pieces[k]
            out[k] = got = old.get(p) or self.told(p)
            if len(p) <= LONG_PIECE:
                young[p] = got
                self.held += ENTRY + len(p) + len(got[1]) + len(got[2])
        if self.held > CACHE_BYTES:
            self.old, self.young, self.held = young, {}, 0
        return out

    def digests(self, texts: pa.Array) -> Iterator[tuple[int, str, str]]:
        """For each text n_tokens, sha256 of the decimal ids and of the decoded text, put together from its pieces.

        A text may go on over several chunks; its hashes do, too.
        """
        n, hashes, begun = 0, [hashlib.sha256(), hashlib.sha256()], [False, False]
        upto = 0
        for index, pieces, ends in chunks(texts, list(self.added_bytes), lower=True):
            told = self.lookup(pieces)
            counts = np.r_[0, np.cumsum(np.fromiter((t[0] for t in told), np.int64, len(told))[index])]
            edges = np.r_[0, ends - upto, len(index)]
            upto += len(index)
            streams = []
            for k in (1, 2):
                joined = pa.array([t[k] for t in told], pa.binary()).take(pa.array(index))
                places = np.frombuffer(joined.buffers()[1], np.int32)[: len(index) + 1][edges].tolist()
                streams.append((memoryview(joined.buffers()[2] or b""), places))
            for i, m in enumerate(np.diff(counts[edges]).tolist()):
                n += m
                for k, (data, places) in enumerate(streams):
                    a, z = places[i], places[i + 1]
                    if z > a:
                        if begun[k]:
                            hashes[k].update(b" ")
                        hashes[k].update(data[a : z - 1])
                        begun[k] = True
                if i < len(ends):
                    yield n, hashes[0].hexdigest(), hashes[1].hexdigest()
                    n, hashes, begun = 0, [hashlib.sha256(), hashlib.sha256()], [False, False]


@cache
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def encode_column(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int>, decoded string of each row: the operator itself.

    A null or empty text has no ids and decodes to "". Rows, also repeated ones, are kept one for one;
    other columns of docs aren't read. The file must be readable at `path` on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for ids, texts in text_blocks(batches):
            got = [bpe.encode(t or "") for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(got, pa.list_(pa.int32())), pa.array([bpe.decode(g) for g in got])], ["doc_id", "ids", "decoded"])

    return doc_text(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row, without moving ids; nulls as in encode_column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for ids, texts in text_slices(batches, 8 << 20):
            n, a, b = zip(*bpe.digests(texts), strict=True)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return doc_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
