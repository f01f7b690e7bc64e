"""Nearest vectors of rows that the sample's own neighbours say little of."""

import collections

import numpy as np
from pyspark.sql import functions as F


def recall(spark, x, **more):
    from termweave.llm.ann import search

    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>").repartition(3)
    got = collections.defaultdict(list)
    for r in search(frame, F.col("vec_id") % 50 == 0, **more).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in range(0, len(x), 50):
        s = u @ u[q]
        s[q] = -9
        want = np.argsort(-s, kind="stable")[:5]
        assert [r for r, _, _ in sorted(got[q])] == [1, 2, 3, 4, 5]
        hit += len({v for _, v, _ in got[q]} & set(want.tolist()))
    return hit / (5 * len(range(0, len(x), 50)))


def test_queries_unlike_the_sample(spark):
    """Tight groups, so a sample's neighbours lie in one list; what is asked lies between them."""
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(60, 32)), 60, axis=0) + 0.05 * rng.normal(size=(3600, 32))
    x[::50] = rng.normal(size=(72, 32))
    assert recall(spark, x) == 1


def test_differences_finer_than_codes(spark):
    """Near copies within wide noise: a codebook of the noise doesn't tell them apart."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 32))
    x[1500:] = np.repeat(x[1500:1550], 30, axis=0) + 0.02 * rng.normal(size=(1500, 32))
    assert recall(spark, x, lists=1) == 1 and recall(spark, x) == 1
