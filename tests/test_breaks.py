"""Natural breaks stay exact for many values and outliers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from terrano.operators import stats


def test_outlier_leaves_the_other_classes(spark):
    df = spark.range(6000).select((F.col("id") + (F.col("id") / 1000).cast("int") * 20_000).cast("double").alias("v")).union(spark.createDataFrame([(1e9,)], "v double"))
    got = [(r["class"], r.upper, r.n) for r in stats.natural_breaks(df, "v", 7).orderBy("class").collect()]
    # in equal-width bins the outlier left two classes
    assert got == [(g + 1, g * 20_000.0 + g * 1000 + 999, 1000) for g in range(6)] + [(7, 1e9, 1)]


def test_breaks_against_the_quadratic_search(spark):
    v = np.round(np.random.default_rng(4).lognormal(3, 1.5, 700), 2)
    x, n = np.unique(v, return_counts=True)
    one = lambda i, j: (n[i:j] * (x[i:j] - np.average(x[i:j], weights=n[i:j])) ** 2).sum()
    cost = np.array([[one(i, j) if i < j else np.inf for j in range(len(x) + 1)] for i in range(len(x))])
    best = np.concatenate([[0], np.full(len(x), np.inf)])
    for _ in range(5):
        best = np.array([np.inf, *[(best[:j] + cost[:j, j]).min() for j in range(1, len(x) + 1)]])
    got = stats.natural_breaks(spark.createDataFrame([(float(a),) for a in v], "v double"), "v", 5).orderBy("class").collect()
    edge = np.searchsorted(x, [r.upper for r in got], side="right")
    assert abs(sum(one(i, j) for i, j in zip([0, *edge], edge, strict=False)) / best[-1] - 1) < 1e-9
