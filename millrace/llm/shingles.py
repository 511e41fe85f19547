"""Near copies at a Jaccard similarity of word shingles, by SimHash fingerprints in the Gray-order index.

Fingerprints of 64 bits at similarity 0.8 differ in 10 bits on average, too many to deal them out by blocks of
equal bits as for three bits. So the groups that the index looks through are bands of a MinHash signature; within
a group it prunes by accumulated differences at DISTANCE bits; sketches of the signatures drop most of what remains,
and the whole shingle sets decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import SPACES, broadcast_if_small, doc_text, join_with_hot_keys, text_blocks, whole_groups, written
from millrace.llm.components import components
from millrace.llm.simhash import GrayIndex, _unite, gray_rank, majority, without

SEED = 42
WORDS = 5
SIMILARITY = 0.8
#: A pair of similarity s shares no band with probability (1 - s ** ROWS) ** BANDS: 5e-8 at 0.8.
BANDS = 32
ROWS = 4
#: Bits in which fingerprints of a pair may differ: over 24 of 64 at similarity 0.8 has a probability below 1e-4, and
#: fingerprints of texts that have nothing in common differ in 24 or fewer with 0.03.
DISTANCE = 24
#: Values of two sketches that agree at least: fewer than 84 of 128 at similarity 0.8 has a probability below 1e-4.
AGREE = 84
#: Pairs of sketches that are compared together.
SKETCHES = 1 << 16
#: Members of a band that are looked through together; a larger band is dealt out by pairs of parts.
GROUP = 20_000
#: Shingles that are multiplied out together.
BLOCK = 1 << 14

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_SPACES = SPACES.encode()
_RANDOM = np.random.default_rng(SEED).integers(0, 1 << 63, size=(2, BANDS * ROWS, 1), dtype=np.uint64)
_ODD, _ADD = _RANDOM[0] * np.uint64(2) + np.uint64(1), _RANDOM[1]


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted, distinct hashes of a text's word shingles; a text of fewer words is one shingle."""
    parts = (text or "").encode().translate(_LOWER).translate(bytes.maketrans(_SPACES, b" " * len(_SPACES))).split()
    if not parts:
        return np.empty(0, np.uint64)
    whole = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(whole, SEED)], dtype=np.uint64)
    ends = list(accumulate((len(p) + 1 for p in parts), initial=0))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(whole[a : b - 1], SEED) for a, b in zip(ends, ends[words:], strict=False)], dtype=np.uint64))


def _signed(values: list[int]) -> list[int]:
    return np.array(values, dtype=np.uint64).view(np.int64).tolist()


def node(s: np.ndarray) -> int:
    """What stands for a shingle set: its hash."""
    return xxhash.xxh64_intdigest(s.tobytes(), SEED)


def minhash(s: np.ndarray) -> np.ndarray:
    """The least value of each of BANDS * ROWS hash functions over a set; none of an empty one."""
    if not len(s):
        return np.empty(0, np.uint64)
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for i in range(0, len(s), BLOCK):
        least = np.minimum(least, (s[None, i : i + BLOCK] * _ODD + _ADD).min(axis=1))
    return least


def bands(least: np.ndarray) -> list[int]:
    """A hash of each band of a MinHash signature, as signed longs."""
    return _signed([xxhash.xxh64_intdigest(r.tobytes(), b) for b, r in enumerate(least.reshape(-1, ROWS))])


def sketch(least: np.ndarray) -> bytes:
    """One byte of each value of a MinHash signature."""
    return (least >> np.uint64(8)).astype(np.uint8).tobytes()


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, node, n (shingles), fp (SimHash of the set), bands and sketch of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_blocks(batches):
            sets = [shingles(t) for t in texts]
            least = list(map(minhash, sets))
            columns = [
                pa.array(ids, pa.int64()), pa.array(_signed(list(map(node, sets))), pa.int64()), pa.array(list(map(len, sets)), pa.int64()),
                pa.array(_signed(list(map(majority, sets))), pa.int64()), pa.array(list(map(bands, least)), pa.list_(pa.int64())), pa.array(list(map(sketch, least)), pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "node", "n", "fp", "bands", "sketch"])

    return doc_text(docs).mapInArrow(run, "doc_id long, node long, n long, fp long, bands array<long>, sketch binary")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """node, shingles of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_blocks(batches):
            sets = [shingles(t) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(_signed(list(map(node, sets))), pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "shingles"])

    return doc_text(docs).mapInArrow(run, "node long, shingles array<long>")


def _to_center(members: DataFrame) -> DataFrame:
    """u, v: each member of a band and its centre, as far as sizes and fingerprints allow SIMILARITY.

    The centre is the member whose fingerprint is nearest to the bits that most members have: among copies of one
    text with different changes that is the text itself. A band of over GROUP members is dealt out to parts, each
    with a centre.
    """
    size = members.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > GROUP).select("key", F.ceil(F.col("m") / GROUP).cast("int").alias("p"))
    part = F.coalesce(F.pmod(F.xxhash64("node"), F.col("p")), F.lit(0))
    # At most one band in GROUP of all members has more: these are few.
    cells = members.join(broadcast_if_small(size, "bands"), "key", "left").select(F.when(F.col("p").isNull(), F.col("key")).otherwise(F.xxhash64("key", part)).alias("cell"), "node", "n", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, nodes, n, fp in whole_groups(batches):
            order = np.lexsort((nodes, cell))
            cell, nodes, n, fp = (x[order] for x in (cell, nodes, n, fp.view(np.uint64)))
            first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            count = np.diff(np.r_[first, len(cell)])
            bits = np.unpackbits(fp.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            most = (2 * np.add.reduceat(bits, first, axis=0, dtype=np.int64) > count[:, None]).astype(np.uint8)
            middle = np.packbits(most, axis=1, bitorder="little").view("<u8")[:, 0]
            of = np.repeat(np.arange(len(first)), count)
            away = np.bitwise_count(fp ^ middle[of]).astype(np.int64)
            nearest = np.lexsort((np.arange(len(of)), away, of))[first][of]
            near = (nodes != nodes[nearest]) & (np.bitwise_count(fp ^ fp[nearest]) <= DISTANCE) & (np.minimum(n, n[nearest]) >= SIMILARITY * np.maximum(n, n[nearest]))
            if near.any():
                yield pa.RecordBatch.from_arrays([pa.array(nodes[near]), pa.array(nodes[nearest[near]])], ["u", "v"])

    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "u long, v long").distinct()


def _cells(labelled: DataFrame, total: int) -> DataFrame:
    """cell, key, node, n, fp, label: the members of bands that have several labels, once for each cell they are looked at in.

    A band of up to GROUP members is one cell. In a larger one the members of its most frequent label make up some
    parts, all others some more, and a cell is a pair of parts, at least one of them of the others.
    """
    counts = labelled.groupBy("key", "label").agg(F.count("*").alias("c"))
    bands_of = counts.groupBy("key").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("m"), F.count("*").alias("k")).where("k > 1")
    parts = bands_of.select("key", F.col("top.label").alias("main"), F.col("m").alias("rows"), F.expr(f"if(m <= {GROUP}, 0, cast(ceil(top.c / {GROUP}) as int))").alias("p"), F.expr(f"if(m <= {GROUP}, 0, cast(ceil((m - top.c) / {GROUP}) as int))").alias("q"))
    placed = join_with_hot_keys(labelled, written(parts, "bands"), "key", "rows", total, "node")
    part = placed.withColumn("part", F.expr("if(p = 0, 0, if(label = main, pmod(xxhash64(node), p), p + pmod(xxhash64(node), q)))"))
    others = "transform(sequence(p, p + q - 1), j -> struct(cast(least(part, j) as long) as i, cast(greatest(part, j) as long) as j))"
    mains = "transform(sequence(0, p - 1), i -> struct(cast(i as long) as i, cast(part as long) as j))"
    pairs = F.expr(f"case when p = 0 then array(struct(0L as i, 0L as j)) when part < p then {others} else concat({mains}, {others}) end")
    return part.withColumn("at", F.explode(pairs)).select(F.expr("xxhash64(key, at.i, at.j)").alias("cell"), "key", "node", "n", "fp", "label")


def _between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """u, v: links of SIMILARITY or more between different labels of a cell (rows sorted by cell).

    Of the pairs that fingerprints, sizes and sketches allow, the whole sets are compared, in the cell of the first
    band that the two share; so no pair leaves its task but a link, and pairs that links have connected are dropped.
    """
    for cell, nodes, n, fp, label, band, sketches, shared, sets in whole_groups(batches, 1 << 13):
        fp, marks = fp.view(np.uint64), np.frombuffer(b"".join(sketches), np.uint8).reshape(len(fp), -1)
        order = np.lexsort((gray_rank(fp), cell))
        cell, nodes, n, fp, label, band, marks, sets = (x[order] for x in (cell, nodes, n, fp, label, band, marks, sets))
        every = np.stack(shared)[order]
        _, first, of = np.unique(label, return_index=True, return_inverse=True)
        parent = first[of]
        for a, b in GrayIndex(fp, cell).pairs(DISTANCE, parent):
            near = np.minimum(n[a], n[b]) >= SIMILARITY * np.maximum(n[a], n[b])
            a, b = a[near], b[near]
            for i in range(0, len(a), SKETCHES):
                x, y = a[i : i + SKETCHES], b[i : i + SKETCHES]
                alike = (marks[x] == marks[y]).sum(axis=1) >= AGREE
                x, y = x[alike], y[alike]
                here = (every[x] == every[y]).argmax(axis=1) == band[x]
                links = [(j, k) for j, k in zip(x[here].tolist(), y[here].tolist(), strict=True) if _alike(sets[j], sets[k])]
                if links:
                    u, v = (np.array(z) for z in zip(*links, strict=True))
                    _unite(parent, u, v)
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(nodes[u], nodes[v])), pa.array(np.minimum(nodes[u], nodes[v]))], ["u", "v"])


def _alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets (as signed longs of unsigned order) have a Jaccard similarity of SIMILARITY or more."""
    same = len(a) + len(b) - len(np.unique(np.concatenate((a, b))))
    return same >= SIMILARITY * (len(a) + len(b) - same)


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets' Jaccard similarity is SIMILARITY or more."""
    a = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
    b = sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    both = pairs.join(a, "u").join(b, "v").select("u", "v", (F.size("a") + F.size("b")).alias("n"), F.size(F.array_intersect("a", "b")).alias("same"))
    return both.where(F.col("same") >= F.lit(SIMILARITY) * (F.col("n") - F.col("same"))).select("u", "v")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, component_id of each row with a doc_id: the smallest doc_id reached by links of SIMILARITY or more.

    Equal sets are one node; texts without words are one. Members of a band are held against its centre; then all
    pairs of a band that no link connects so far, so a dense group costs no quadratic time and no proposed pair stays
    unseen. Only doc_id and text are read; an empty table has no rows.
    """
    marked = written(signatures(docs.where("doc_id is not null")), "signatures")
    nodes = written(marked.groupBy("node").agg(F.min("doc_id").alias("own"), F.min("n").alias("n"), F.min("fp").alias("fp"), F.min("bands").alias("bands"), F.min("sketch").alias("sketch"), F.count("*").alias("rows")), "nodes")
    each = nodes.select(F.explode("bands").alias("key"), "node", "n", "fp", "own")
    shared = each.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    members = written(each.join(shared, "key"), "members")
    total = members.count()
    wanted = members.select(F.col("own").alias("doc_id")).distinct()
    sets = written(shingle_sets(doc_text(docs).join(wanted, "doc_id")).dropDuplicates(["node"]), "shingles")
    first = written(_similar(_to_center(members), sets), "links")
    labels = components(first)
    labelled = written(members.join(labels.withColumnRenamed("u", "node"), "node", "left").select("key", "node", "n", "fp", F.coalesce("label", "node").alias("label")), "labelled")
    more = nodes.select("node", "sketch", "bands").join(sets, "node")
    cells = _cells(labelled, total).join(more, "node").select("cell", "node", "n", "fp", "label", (F.array_position("bands", F.col("key")) - 1).alias("band"), "sketch", "bands", "shingles")
    rest = cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_between, "u long, v long").distinct()
    labels = components(first.unionAll(rest)).withColumnRenamed("u", "node")
    named = nodes.join(labels, "node", "left").select("node", "own", "rows", F.coalesce("label", "node").alias("label"))
    least = named.groupBy("label").agg(F.min("own").alias("component_id"))
    found = written(named.join(least, "label").select("node", "component_id", "rows"), "components")
    return join_with_hot_keys(marked.select("doc_id", "node"), found, "node", "rows", marked.count(), "doc_id").select("doc_id", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without the rows whose text's component has a smaller doc_id; all columns stay.

    Of rows that repeat a doc_id all stay, as does a row without doc_id.
    """
    return without(docs, near_duplicates(docs))
