from __future__ import annotations

import random

import corpus_pipeline
import numpy as np
from millrace.llm import common, shingles, simhash


def plain_components(texts: dict[int, str]) -> dict[int, int]:
    """The smallest id linked by a Jaccard similarity of 0.8 or more of five-word shingles, by all pairs."""
    cut = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    sets = {i: cut(t.lower().split()) for i, t in texts.items()}
    of = {i: i for i in texts}
    for i in texts:
        for j in texts:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((of[i], of[j]))
                of = {k: a if x == b else x for k, x in of.items()}
    return of


def corpus() -> dict[int, str]:
    """Random texts, some with copies in which up to a tenth of the words are others, and chains of copies."""
    r = random.Random(5)
    word = lambda: f"w{r.randrange(5000)}"
    texts = [[word() for _ in range(r.randint(1, 400))] for _ in range(60)]
    for _ in range(100):
        t = list(r.choice(texts))
        for _ in range(r.randint(0, max(1, len(t) // 40))):
            t[r.randrange(len(t))] = word()
        texts.append(t)
    r.shuffle(texts)
    return dict(enumerate([" ".join(t) for t in texts] + ["", " \n", "One two", "one TWO"]))


def test_components_are_those_of_all_pairs(spark):
    texts = corpus()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = plain_components(texts)
    assert {r.doc_id: r.component_id for r in shingles.near_duplicates(df).collect()} == want
    # Some of these copies are beyond op2's three bits.
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()} != want


def test_bands_over_many_parts(spark, monkeypatch):
    """Bands cut into parts of a few members, and keys that are hot: the same components."""
    texts = corpus()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    monkeypatch.setattr(shingles, "GROUP", 2)
    monkeypatch.setattr(common, "HOT_LEAST", 3)
    monkeypatch.setattr(common, "FEW_ROWS", 0)
    assert {r.doc_id: r.component_id for r in shingles.near_duplicates(df).collect()} == plain_components(texts)


def test_index_proposes_all_pairs_within_the_distance():
    r = np.random.default_rng(3)
    centers = r.integers(0, 1 << 63, 6, dtype=np.uint64)
    fp = np.array([int(c) ^ sum(1 << b for b in set(r.integers(0, 64, 14).tolist())) for c in centers for _ in range(40)], dtype=np.uint64)
    group = np.sort(r.integers(0, 3, len(fp)))
    order = np.lexsort((simhash.gray_rank(fp), group))
    fp, group, label = fp[order], group[order], np.arange(len(fp)) // 5 * 5
    found = {(int(a), int(b)) for x, y in simhash.GrayIndex(fp, group).pairs(shingles.DISTANCE, label) for a, b in zip(x, y, strict=True)}
    want = {(i, j) for i in range(len(fp)) for j in range(i + 1, len(fp)) if group[i] == group[j] and label[i] != label[j] and int(fp[i] ^ fp[j]).bit_count() <= shingles.DISTANCE}
    assert found == want and want


def test_pipeline_drops_copies_at_a_similarity_of_eight_tenths(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, source string")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()}
    assert kept == {i for i, c in plain_components(texts).items() if i == c}
