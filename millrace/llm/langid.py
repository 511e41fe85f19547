"""Language identification by rank-order profiles of character n-grams and out-of-place distance."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import text_blocks

#: N-grams of one to this many letters, word edges included.
LONGEST = 3
#: Ranks in a language's profile, and n-grams of a document that are ranked.
PROFILE, RANKED = 600, 300
#: About so many documents of each language are learned from at most.
LEARNED = 3000
#: Documents with this remainder of crc32(doc_id) modulo FOLDS are held out.
FOLDS, HELD_OUT = 4, 2


@cache
def letters() -> np.ndarray:
    """For each code point the lower-case letter it stands for, 0 where it is no letter."""
    out = np.zeros(0x110000, dtype=np.int64)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def ngrams(text: str) -> np.ndarray:
    """All n-grams of a text as numbers (21 bits a letter, word edges as spaces in longer ones); none without letters."""
    c = letters()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    c = np.concatenate(([0], c, [0]))
    c = c[np.r_[True, (c[1:] != 0) | (c[:-1] != 0)]]  # runs of other characters become one edge
    if len(c) < 3:
        return np.empty(0, np.int64)
    marked = np.where(c == 0, ord(" "), c)
    found, gram = [c[c != 0]], marked
    for n in range(2, LONGEST + 1):
        gram = (gram[:-1] << 21) | marked[n - 1 :]
        good = np.ones(len(gram), bool)
        for k in range(1, n - 1):  # an edge stands first or last only
            good &= c[k : k + len(gram)] != 0
        found.append(gram[good])
    return np.concatenate(found)


def ranked(text: str, most: int) -> np.ndarray:
    """The `most` most frequent n-grams, most frequent first; ties by the n-gram's number."""
    grams, counts = np.unique(ngrams(text), return_counts=True)
    if len(grams) > most:
        least = np.partition(counts, -most)[-most]
        keep = counts >= least
        grams, counts = grams[keep], counts[keep]
    return grams[np.argsort(-counts, kind="stable")][:most]


class Profiles:
    """Ranks of each language's profile, by n-gram."""

    def __init__(self, profiles: dict[str, list[int]]):
        self.languages = sorted(profiles)
        self.grams = np.unique(np.array([g for p in profiles.values() for g in p], dtype=np.int64))
        self.ranks = np.full((len(self.grams) + 1, len(self.languages)), PROFILE, dtype=np.int64)
        for k, name in enumerate(self.languages):
            self.ranks[np.searchsorted(self.grams, profiles[name]), k] = np.arange(len(profiles[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language of least out-of-place distance (ties: first by name), and 1 - distance / greatest distance.

        An n-gram that a profile lacks counts as PROFILE places off.
        """
        grams = ranked(text, RANKED) if text else np.empty(0, np.int64)
        if not len(grams) or not self.languages:
            return "und", 0.0
        at = np.searchsorted(self.grams, grams)
        at[at == len(self.grams)] = 0
        known = self.grams[at] == grams
        own = np.arange(len(grams))[:, None]
        off = np.where(known[:, None] & (self.ranks[at] < PROFILE), np.abs(self.ranks[at] - own), PROFILE)
        distance = off.sum(axis=0)
        best = int(np.argmin(distance))
        return self.languages[best], float(1 - distance[best] / (PROFILE * len(grams)))


def remainder(doc_id: F.Column) -> F.Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def learn(docs: DataFrame, learned: int = LEARNED) -> Profiles:
    """Profiles from documents with a language that aren't held out, of each about `learned` by a hash of doc_id."""
    fit = docs.where(docs["lang"].isNotNull() & docs["text"].isNotNull() & (F.coalesce(remainder(docs["doc_id"]), F.lit(0)) != HELD_OUT))
    sizes = {r["lang"]: r["count"] for r in fit.groupBy("lang").count().collect()}
    if not sizes:
        return Profiles({})
    share = F.create_map(*(F.lit(x) for name, n in sorted(sizes.items()) for x in (name, min(1.0, learned / n))))[F.col("lang")]
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / (1 << 20)
    sample = fit.where(place < share).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = np.array(b.column(2).to_pylist(), dtype=object)
            for name in sorted(set(langs)):
                for _, texts in text_blocks(iter([b.filter(pa.array(langs == name))]), 1 << 20):
                    grams, counts = np.unique(np.concatenate([ngrams(t) for t in texts]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams), pa.array(counts.astype(np.int64))], ["lang", "gram", "n"])

    counted = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # Of each language only its first PROFILE n-grams come to the driver.
    first = counted.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= PROFILE)
    found: dict[str, list[int]] = {}
    for r in first.orderBy("lang", "r").collect():
        found.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(found)


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row; only text is looked at.

    `und` and 0 where the text is null or has no letters, or where nothing was learned. Repeated rows stay.
    A null doc_id isn't held out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_blocks(batches):
            names, scores = zip(*map(profiles.predict, texts), strict=True)
            held = [i is not None and zlib.crc32(str(i).encode()) % FOLDS == HELD_OUT for i in ids]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held), pa.array(names), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Learns from docs (columns doc_id, text, lang) and predicts each row's language; see learn and predict."""
    return predict(docs, learn(docs))
