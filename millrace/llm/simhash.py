"""SimHash fingerprints and their links within a Hamming distance, by a Gray-order hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import broadcast_if_small, doc_text, join_with_hot_keys, text_blocks, whole_groups, written
from millrace.llm.components import components

SEED = 42
WORDS = 3
DISTANCE = 3
BLOCKS = DISTANCE + 1
#: A group of more fingerprints than this that share a block is split by blocks of their other bits.
HOT_GROUP = 20_000
#: Children of a node of the index.
FAN = 8
#: Node pairs that are looked at together.
FRONT = 1 << 19

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The 64-bit SimHash of a text's word shingles; 0 where there is no word."""
    if not text:
        return 0
    parts = text.encode().translate(_LOWER).split()
    n = len(parts)
    if not n:
        return 0
    whole = b" ".join(parts)
    if n <= words:
        hashes = [xxhash.xxh64_intdigest(whole, SEED)]
    else:
        ends = list(accumulate((len(p) + 1 for p in parts), initial=0))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(whole[a : b - 1], SEED) for a, b in zip(ends, ends[words:], strict=False)]
    return majority(np.array(hashes, dtype="<u8"))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of some 64-bit hashes; 0 of none."""
    n = len(hashes)
    bits = np.unpackbits(hashes.astype("<u8", copy=False).view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    most = 2 * bits.sum(axis=0, dtype=np.int64) > n
    return int(np.packbits(most, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_blocks(batches):
            fp = np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fp)], ["doc_id", "fp"])

    return doc_text(docs).mapInArrow(run, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each 64-bit word in the reflected Gray sequence."""
    x = x.astype(np.uint64)
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def _roots(parent: np.ndarray, i: np.ndarray) -> np.ndarray:
    r = parent[i]
    while True:
        up = parent[r]
        if np.array_equal(up, r):
            return r
        r = up


def _unite(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    while True:
        a, b = _roots(parent, i), _roots(parent, j)
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


class GrayIndex:
    """The hierarchical index over fingerprints that are sorted by group and then by Gray rank.

    Level 0 is the fingerprints themselves, with all bits masked. A node above keeps the bits in which all
    of its up to FAN children, of one group, agree (mask and pattern). Two nodes differ at least in the
    bits that both keep, and going down only bits that are newly kept are compared and added.
    """

    def __init__(self, fp: np.ndarray, group: np.ndarray):
        self.masks, self.bits, self.first, self.groups = [np.full(len(fp), ~np.uint64(0))], [fp.astype(np.uint64)], [], [group]
        while len(self.groups[-1]) > 1 and (np.diff(self.groups[-1]) == 0).any():
            g = self.groups[-1]
            starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            place = np.arange(len(g)) - np.repeat(starts, np.diff(np.r_[starts, len(g)]))
            first = np.flatnonzero(place % FAN == 0)
            mask, bits = self.masks[-1], self.bits[-1]
            every = np.bitwise_and.reduceat(bits, first)
            some = np.bitwise_or.reduceat(bits, first)
            self.masks.append(np.bitwise_and.reduceat(mask, first) & ~(every ^ some))
            self.bits.append(every)
            self.groups.append(g[first])
            self.first.append(np.r_[first, len(g)])

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.first[level - 1][nodes], self.first[level - 1][nodes + 1]

    def join(self, distance: int) -> np.ndarray:
        """For each fingerprint the index of its component's first member: links are pairs of a group within distance.

        Pairs of nodes whose fingerprints are all in one component already are dropped unseen.
        """
        parent = np.arange(len(self.bits[0]))
        if len(parent) > 1:
            close = np.flatnonzero((self.groups[0][1:] == self.groups[0][:-1]) & (np.bitwise_count(self.bits[0][1:] ^ self.bits[0][:-1]) <= distance))
            _unite(parent, close, close + 1)
        for a, b in self.pairs(distance, parent):
            _unite(parent, a, b)
        return _roots(parent, np.arange(len(parent)))

    def pairs(self, distance: int, parent: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a group within distance, a part at a time, but for those of one component as `parent` has it by then."""
        top = len(self.masks) - 1
        nodes = np.arange(len(self.masks[top]))
        zero = np.zeros(len(nodes), dtype=np.uint64)
        stack = [(top, nodes[i : i + FRONT], nodes[i : i + FRONT], zero[i : i + FRONT].astype(np.int64), zero[i : i + FRONT]) for i in range(0, len(nodes), FRONT)]
        while stack:
            level, a, b, differ, seen = stack.pop()
            both = self.masks[level][a] & self.masks[level][b]
            differ = differ + np.bitwise_count((self.bits[level][a] ^ self.bits[level][b]) & both & ~seen)
            keep = differ <= distance
            a, b, differ, seen = a[keep], b[keep], differ[keep], both[keep]
            if level == 0:
                apart = (a != b) & (_roots(parent, a) != _roots(parent, b))
                if apart.any():
                    yield a[apart], b[apart]
                continue
            low, high = self._spread(level, parent)
            keep = ~((low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b]))
            a, b, differ, seen = a[keep], b[keep], differ[keep], seen[keep]
            if not len(a):
                continue
            (a0, a1), (b0, b1) = self.children(level, a), self.children(level, b)
            wide, count = b1 - b0, (a1 - a0) * (b1 - b0)
            of = np.repeat(np.arange(len(a)), count)
            k = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            ca, cb = a0[of] + k // wide[of], b0[of] + k % wide[of]
            # Of a node and itself each pair of children counts once.
            keep = (a[of] != b[of]) | (ca < cb if level == 1 else ca <= cb)
            ca, cb, of = ca[keep], cb[keep], of[keep]
            for i in range(0, len(ca), FRONT):
                part = of[i : i + FRONT]
                stack.append((level - 1, ca[i : i + FRONT], cb[i : i + FRONT], differ[part], seen[part]))

    def _spread(self, level: int, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest component below each node of a level."""
        low = high = _roots(parent, np.arange(len(parent)))
        for first in self.first[:level]:
            low, high = np.minimum.reduceat(low, first[:-1]), np.maximum.reduceat(high, first[:-1])
        return low, high


def local_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """u, v: links that connect what is linked within the groups of one partition (columns key, fp; sorted by key)."""
    for key, fp in whole_groups(batches):
        fp = fp.view(np.uint64)
        order = np.lexsort((gray_rank(fp), key))
        key, fp = key[order], fp[order]
        alone = np.r_[True, key[1:] != key[:-1]] & np.r_[key[1:] != key[:-1], True]
        key, fp = key[~alone], fp[~alone]
        if len(fp):
            root = GrayIndex(fp, key).join(DISTANCE)
            linked = root != np.arange(len(fp))
            yield pa.RecordBatch.from_arrays([pa.array(fp[linked].view(np.int64)), pa.array(fp[root[linked]].view(np.int64))], ["u", "v"])


def links(fps: DataFrame, hot_group: int = HOT_GROUP) -> DataFrame:
    """u, v: fingerprints within DISTANCE bits, enough of them to connect every component; fps has distinct fp.

    Two such fingerprints agree in one of BLOCKS blocks of bits, so each group that shares a block is joined
    by itself. In a group over hot_group one of BLOCKS blocks of the other bits must agree too, and the group
    is split by those.
    """
    width = 64 // BLOCKS
    low = (1 << width) - 1
    part = lambda x, at, bits: F.shiftrightunsigned(x, at).bitwiseAND(F.lit((1 << bits) - 1))
    blocks = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(b).cast("long").alias("b"), part(F.col("fp"), width * b, width).alias("value")) for b in range(BLOCKS)))).alias("x"))
    keyed = blocks.select("fp", "x.b", (F.col("x.b") * (low + 1) + F.col("x.value")).alias("key"))
    hot = keyed.groupBy("key").count().where(F.col("count") > hot_group).select("key", F.lit(True).alias("hot"))
    joined = keyed.join(hot, "key", "left")
    # The other bits, closed up: below the block as they are, above it moved down.
    under = F.expr(f"fp & (shiftleft(1L, cast({width} * b as int)) - 1)")
    over = F.when(F.col("b") == BLOCKS - 1, F.lit(0)).otherwise(F.expr(f"shiftleft(shiftrightunsigned(fp, cast({width} * (b + 1) as int)), cast({width} * b as int))"))
    rest = under.bitwiseOR(over)
    fine = (64 - width) // BLOCKS
    subkeys = F.array(*((F.lit(1 + s) * (1 << fine) + part(rest, fine * s, fine)) for s in range(BLOCKS)))
    split = joined.select("fp", "key", F.explode(F.when(F.col("hot"), subkeys).otherwise(F.array(F.lit(0).cast("long")))).alias("sub"))
    group = (F.col("key") * (1 << (fine + 3)) + F.col("sub")).alias("key")
    return split.select(group, "fp").repartition("key").sortWithinPartitions("key").mapInArrow(local_links, "u long, v long")


def near_duplicates(docs: DataFrame, hot_group: int = HOT_GROUP) -> DataFrame:
    """doc_id, fp, component_id of each row.

    component_id is the smallest doc_id whose fingerprint is reached by links of DISTANCE bits or fewer.
    Null and empty texts have fingerprint zero, linked like any other. Repeated rows are kept; a row without
    doc_id takes part but never names a component unless none of its component has one.
    """
    marked = written(fingerprints(docs), "fingerprints")
    nodes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("own"), F.count("*").alias("rows")), "nodes")
    labels = components(links(nodes.select("fp"), hot_group))
    roots = labels.select("label").distinct().select(F.col("label").alias("u"), "label")
    of = nodes.select("fp", "own").join(labels.unionAll(roots).withColumnRenamed("u", "fp"), "fp")
    least = of.groupBy("label").agg(F.min("own").alias("component"))
    linked = of.join(least, "label").select("fp", "component")
    named = written(nodes.join(linked, "fp", "left").select("fp", F.coalesce("component", "own").alias("component_id"), "rows"), "components")
    return join_with_hot_keys(marked, named, "fp", "rows", marked.count(), "doc_id").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: str = "fp") -> F.Column:
    """The fingerprint as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without the rows whose text's component has a smaller doc_id; all columns stay.

    Of rows that repeat a doc_id all stay, as does a row without doc_id.
    """
    return without(docs, near_duplicates(docs))


def without(docs: DataFrame, components: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id isn't its component_id. Texts stay where they are as long as the ids are few."""
    gone = components.where("doc_id <> component_id").select(F.col("doc_id").alias("__mr_gone")).distinct()
    return docs.join(broadcast_if_small(gone, "gone"), docs["doc_id"].cast("long") == F.col("__mr_gone"), "left_anti").select(*docs.columns)
