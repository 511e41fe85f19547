from __future__ import annotations

import numpy as np
import pytest
from millrace.ml import neighbours
from pyspark.sql import functions as F


def plain(x, points, values, k, vote):
    """All training rows by distance, then by the last feature, the others and the value."""
    rank = np.lexsort((values, *points.T))
    points, values = points[rank], values[rank]
    out = []
    for q in x:
        near = values[np.argsort(((points - q) ** 2).sum(1), kind="stable")[:k]]
        out.append(np.bincount(near.astype(int)).argmax() if vote else near.mean())
    return np.array(out)


@pytest.mark.parametrize("features, lattice, n", [(1, 0, 3000), (2, 9, 4000), (2, 0, 4000), (3, 0, 3000), (20, 0, 400), (2, 3, 40)])
@pytest.mark.parametrize("k, vote", [(1, True), (5, True), (7, False), (600, False)])
def test_against_brute_force(features, lattice, n, k, vote):
    r = np.random.default_rng(n + features)
    points = r.integers(0, lattice, (n, features)).astype(float) if lattice else r.normal(size=(n, features)).round(3)
    values = r.integers(0, 4, n).astype(float)
    rows, counts = np.unique(np.c_[points, values], axis=0, return_counts=True)
    state = neighbours.prepared(rows[:, :-1], rows[:, -1], counts)
    x = np.r_[points[:60], r.normal(size=(60, features)) * 3]
    assert np.allclose(neighbours.search(state, x, k, vote), plain(x, points, values, k, vote))


def test_more_rows_than_one_worker_would_compare(spark, op):
    """300,000 training rows, which were refused, and as many different points."""
    rows = spark.range(300_000).select((F.col("id") % 1000 / 10).alias("a"), F.floor(F.col("id") / 1000).cast("double").alias("b"), F.when(F.col("id") % 1000 < 500, "left").otherwise("right").alias("kind"))
    literal = [{"parameter": "n_neighbors", "value": "3", "parametersSource": False}]
    model = op("KNNClassifierTrainer", rows, spark.createDataFrame([(1,)], "unused int"), groundTruthAttribute="kind", selectedFeatures=["a", "b"], paraList=literal)
    asked = rows.where("b % 30 = 7")
    got = op("SklearnPrediction", model, asked, model="Model", **{"Ground Truth Attribute Name to Ignore": "kind"})
    assert got.count() == 10_000 and got.where("kind <> prediction").count() == 0
