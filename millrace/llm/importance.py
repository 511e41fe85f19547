"""Importance resampling: documents drawn by the ratio of hashed n-gram models of target and raw text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import doc_text, text_blocks, written

BUCKETS = 10_000
#: The target model is fitted on at most so many labelled documents, those of least hash.
TARGET_DOCS = 20_000
SMOOTHING = 0.5
#: Share of the rejected labels' share that the drawing leaves out: all of it.
STRICTNESS = 1.0
SEED = 8

_ODD = np.uint64(0x9E3779B97F4A7C15)


def features(text: str | None) -> np.ndarray:
    """Bucket of each word and of each pair of neighbouring words, lower-cased, with repeats."""
    if not text:
        return np.empty(0, np.int64)
    digest = xxhash.xxh64_intdigest
    words = np.array([digest(w) for w in text.lower().encode().split()], dtype=np.uint64)
    pairs = (words[:-1] * _ODD + words[1:]) * _ODD
    return ((np.concatenate([words, pairs]) >> np.uint64(20)) % np.uint64(BUCKETS)).astype(np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> float:
    """A Gumbel variate that depends on doc_id and seed only."""
    u = (xxhash.xxh64_intdigest(str(doc_id), seed) >> 11) + 0.5
    return float(-np.log(-np.log(u / (1 << 53))))


class Ratio:
    """log p_target - log p_raw of each bucket, from counts."""

    def __init__(self, target: np.ndarray, raw: np.ndarray):
        model = lambda c: np.log(c + SMOOTHING) - np.log(c.sum() + SMOOTHING * len(c))
        self.of = model(target.astype(float)) - model(raw.astype(float))

    def weigh(self, text: str | None) -> tuple[float, int]:
        """Log importance weight of a text, and how many n-grams it has."""
        f = features(text)
        return float(self.of[f].sum()), len(f)


def key(weight: float, count: int, doc_id: int | None) -> float:
    """The Gumbel key by which documents are drawn: the log importance weight plus noise. No n-grams: the least key."""
    return weight + noise(doc_id) if count else -1e300


def sortable(x: np.ndarray) -> np.ndarray:
    """Doubles as longs of the same order."""
    bits = x.view(np.int64)
    return bits ^ ((bits >> np.int64(63)) & np.int64((1 << 63) - 1))


def target_ids(labels: DataFrame, most: int = TARGET_DOCS) -> DataFrame:
    """doc_id of at most `most` labelled documents of good quality that aren't toxic: those of least hash."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def fit(docs: DataFrame, labels: DataFrame) -> Ratio:
    """The target model from the sample of labelled documents, the raw model from all documents, in one pass."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), dtype=np.int64)
        for b in batches:
            for good, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = np.bincount(features(text.as_py()), minlength=BUCKETS)
                counts[0] += own
                if good:
                    counts[1] += own
        some = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[0][some]), pa.array(counts[1][some])], ["bucket", "raw", "target"])

    # At most TARGET_DOCS ids, eight bytes each.
    marked = doc_text(docs).join(F.broadcast(target_ids(labels).withColumn("good", F.lit(True))), "doc_id", "left").select("good", "text")
    sums = marked.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in sums:
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    return Ratio(target, raw)


def weights(docs: DataFrame, ratio: Ratio) -> DataFrame:
    """doc_id, log_weight, n_ngrams, gumbel_key, place (the key as a long of the same order) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_blocks(batches):
            w, n = zip(*map(ratio.weigh, texts), strict=True)
            keys = np.array([key(*x) for x in zip(w, n, ids, strict=True)])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(w, pa.float64()), pa.array(n, pa.int64()), pa.array(keys), pa.array(sortable(keys))], ["doc_id", "log_weight", "n_ngrams", "gumbel_key", "place"])

    return doc_text(docs).mapInArrow(run, "doc_id long, log_weight double, n_ngrams long, gumbel_key double, place long")


def kth_largest(values: DataFrame, column: str, k: int) -> int:
    """The k-th largest long of a column, exactly, by its digits of 16 bits: each round brings at most 65536 counts to the driver."""
    # The sign bit turned: then unsigned digits are in order.
    word = F.col(column).bitwiseXOR(F.lit(-(1 << 63)))
    prefix, left = 0, k
    for shift in (48, 32, 16, 0):
        rows = values.select(word.alias("w"))
        if shift < 48:
            rows = rows.where(F.shiftrightunsigned("w", shift + 16) == F.lit(prefix))
        counts = rows.groupBy(F.shiftrightunsigned("w", shift).bitwiseAND(F.lit(65535)).alias("d")).count().collect()
        for d, n in sorted(((r["d"], r["count"]) for r in counts), reverse=True):
            if left <= n:
                break
            left -= n
        prefix = prefix << 16 | d
    return prefix - (1 << 63)


def drawn_share(labels: DataFrame) -> float:
    """Share of documents to draw: all but STRICTNESS of the share of labelled documents that are of poor quality."""
    n, poor = labels.where("quality is not null").agg(F.count("*"), F.sum((F.col("quality") != 1).cast("long"))).first()
    return 1 - STRICTNESS * (poor or 0) / n if n else 1.0


def threshold(weighed: DataFrame, share: float) -> int:
    """The least place of the top `share` of rows (rows of that very place all count); weighed has been written."""
    n = weighed.count()
    return kth_largest(weighed, "place", max(1, round(share * n))) if n else 0


def resample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, log_weight, n_ngrams, gumbel_key, selected of each row of docs: selected is the Gumbel top-k without replacement.

    Without labels of good quality all rows with words have equal weight. Null and empty texts come last. Repeated
    rows have equal keys and are drawn together; at the least key all are drawn.
    """
    weighed = written(weights(docs, fit(docs, labels)), "weights")
    least = threshold(weighed, drawn_share(labels))
    return weighed.select("doc_id", "log_weight", "n_ngrams", "gumbel_key", (F.col("place") >= least).alias("selected"))


def keep_selected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The selected rows of docs, all columns. They are weighed again where they stand, so texts aren't shuffled."""
    ratio = fit(docs, labels)
    least = threshold(written(weights(docs, ratio).select("place"), "places"), drawn_share(labels))

    @F.pandas_udf("long")
    def place(doc_id: pd.Series, text: pd.Series) -> pd.Series:
        ids = [None if pd.isna(i) else int(i) for i in doc_id]
        return pd.Series(sortable(np.array([key(*ratio.weigh(t), i) for t, i in zip(text, ids, strict=True)])))

    return docs.where(place(docs["doc_id"].cast("long"), docs["text"].cast("string")) >= least)
