"""Sum-of-squares online packing of token sequences into windows of fixed length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from millrace.llm.common import doc_text, give_back_memory
from millrace.llm.tokens import encoder, text_slices

WINDOW = 2048
#: Sequence ids of one partition start at its number times this.
IDS_PER_PARTITION = 1 << 36
#: Bytes of text that are encoded together, and ids that are handed on together: some 30 times as many bytes are held at once.
TEXT_BYTES, ROW_IDS = 2 << 20, 1 << 19


class SquaresPacker:
    """Places items one by one into windows of `size`, tracking in `level` how many open windows have each fill.

    An item goes where the sum of squared counts of partially filled windows becomes least: from fill h it
    moves a window to h + item, which changes the sum by 2 * (level[h + item] - level[h]) + 2 (h > 0), or by
    2 * level[item] + 1 for a new window; full windows don't count. Ties go to the fullest window, and among
    windows of one fill to the one opened last.
    """

    def __init__(self, size: int):
        self.size = size
        self.level = np.zeros(size + 1, dtype=np.int64)
        self.open: list[list[int]] = [[] for _ in range(size)]
        self.windows = 0

    def place(self, item: int) -> tuple[int, int]:
        """(window, offset) of an item of 1 to size tokens."""
        n, level = self.size, self.level
        fills = n - item + 1  # fills 0 .. n - item
        count = level[:fills].copy()
        to = level[item : n + 1].copy()
        to[-1] = 0  # a full window isn't counted
        change = 2 * (to - count) + 2
        change[0] = 2 * to[0] + 1
        if item == n:
            change[0] = 0
        else:
            change[-1] = -2 * count[-1] + 1
        change[1:][count[1:] == 0] = np.iinfo(np.int64).max
        fill = fills - 1 - int(np.argmin(change[::-1]))
        if fill:
            window = self.open[fill].pop()
            level[fill] -= 1
        else:
            window = self.windows
            self.windows += 1
        if fill + item < n:
            self.open[fill + item].append(window)
            level[fill + item] += 1
        return window, fill

    def whole(self) -> int:
        """A new window that one item fills."""
        self.windows += 1
        return self.windows - 1


#: A piece: doc_id, start and tokens of its document, offset in its window, ids as bytes.
Piece = tuple[int | None, int, int, int, bytes]


class WindowFiller:
    """Cuts documents into pieces and hands each window on when it is full: (window, its pieces).

    Only a document longer than a window is cut: into whole windows and a rest, which SquaresPacker places.
    """

    def __init__(self, size: int):
        self.size, self.packer = size, SquaresPacker(size)
        self.held: dict[int, list[Piece]] = {}

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[tuple[int, list[Piece]]]:
        n, size = len(ids) // 4, self.size
        whole = n // size * size
        for at in range(0, whole, size):
            yield self.packer.whole(), [(doc_id, at, n, 0, ids[4 * at : 4 * (at + size)])]
        if n > whole:
            window, offset = self.packer.place(n - whole)
            piece = (doc_id, whole, n, offset, ids[4 * whole :])
            if offset + n - whole == size:
                yield window, [*self.held.pop(window, []), piece]
            else:
                self.held.setdefault(window, []).append(piece)

    def rest(self) -> Iterator[tuple[int, list[Piece]]]:
        """The windows that aren't full, in as few as hold them: the emptiest are taken apart to fill the others.

        The pieces of the others stay where the sum of squares has put them; those of the windows taken apart
        are cut as needed. What stays empty in all is less than a window.
        """
        fill = {w: sum(len(p[4]) for p in ps) // 4 for w, ps in self.held.items()}
        order = sorted(fill, key=lambda w: (-fill[w], w))
        keep = -(-sum(fill.values()) // self.size)
        loose = chain.from_iterable(self.held[w] for w in order[keep:])
        doc_id, at, n, raw = None, 0, 0, b""
        for w in order[:keep]:
            pieces, filled = self.held[w], fill[w]
            while filled < self.size:
                if not raw:
                    doc_id, at, n, _, raw = next(loose, (None, 0, 0, 0, b""))
                    if not raw:
                        break
                part = raw[: 4 * (self.size - filled)]
                pieces.append((doc_id, at, n, filled, part))
                at, filled, raw = at + len(part) // 4, filled + len(part) // 4, raw[len(part) :]
            yield w, pieces
        self.held = {}


def pack(docs: DataFrame, path: str, end_id: int, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each partition of docs packs its own rows in their order, so nothing is shuffled, a lost task packs again
    just the same, and what stays empty is less than one window per partition. Only the pieces of windows that
    aren't full are held. Null and empty texts hold end_id alone; repeated rows and null doc_ids are packed like
    others; other columns aren't read; an empty table has no rows.
    """
    return _packed(docs, path, end_id, window, with_ids=False)


def pack_sequences(docs: DataFrame, path: str, end_id: int, window: int = WINDOW) -> DataFrame:
    """Like pack, with the ids of each piece (array<int>): the rows of a sequence in order of offset, joined, are its tokens."""
    return _packed(docs, path, end_id, window, with_ids=True)


def _packed(docs: DataFrame, path: str, end_id: int, window: int, with_ids: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back_memory()
        tokens, first = encoder(path), TaskContext.get().partitionId() * IDS_PER_PARTITION
        filler = WindowFiller(window)

        def filled() -> Iterator[tuple[int, list[Piece]]]:
            for doc_ids, texts in text_slices(batches, TEXT_BYTES):
                ids, starts = tokens.column(texts, end_id)
                raw, ends = ids.tobytes(), (4 * starts).tolist()
                for i, a, z in zip(doc_ids.to_pylist(), ends, ends[1:], strict=False):
                    yield from filler.add(i, raw[a:z])
            yield from filler.rest()

        rows: list[tuple] = []
        held = 0
        for w, pieces in filled():
            rows += [(first + w, *p) for p in pieces]
            held += window
            if held >= ROW_IDS:
                yield _batch(rows, with_ids)
                rows, held = [], 0
        if rows:
            yield _batch(rows, with_ids)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return doc_text(docs).mapInArrow(run, schema)


def _batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    sequence, doc_id, start, total, offset, raw = zip(*rows, strict=True)
    length = [len(r) // 4 for r in raw]
    columns = {"doc_id": doc_id, "start": start, "length": length, "ids_crc32": [zlib.crc32(r) for r in raw], "doc_tokens": total, "sequence_id": sequence, "offset": offset}
    arrays = {name: pa.array(c, pa.int64()) for name, c in columns.items()}
    if with_ids:
        ends = np.cumsum([0, *length], dtype=np.int32)
        arrays["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), "<i4")))
    return pa.RecordBatch.from_pydict(arrays)
