"""The Voronoi join against plain search, and on odd rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq.llm import topk

SCHEMA = "vec_id long, embedding array<double>, row long, cell int, score long, rank int, at int"


def brute(rows, k, step):
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, q) in enumerate(whole):
        if i is not None and i % step == 0:
            score = lambda v, q=q: min(2**63 - 1, max(-(2**63), sum(a * b for a, b in zip(q, v, strict=False))))
            found = sorted((-score(v), j is None, j or 0) for n, (j, v) in enumerate(whole) if n != at)
            out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(found[:k])]
    return sorted(out, key=str)


def result(df):
    return sorted(((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, 4, 5) for i, v in rows], SCHEMA).repartition(5)


def clustered(rng, n, dim, clusters, spread):
    centres = rng.normal(size=(clusters, dim))
    m = centres[rng.integers(0, clusters, n)] + spread * rng.normal(size=(n, dim))
    return m / np.linalg.norm(m, axis=1, keepdims=True)


@pytest.mark.parametrize(("cells", "block", "group", "home"), [(None, 4096, 4096, 4), (6, 10, 7, 1), (1, 5, 3, 1), (40, 20, 50, 2)])
def test_join_equals_brute_force(spark, cells, block, group, home):
    rng = np.random.default_rng(4)
    m = clustered(rng, 400, 8, 5, 0.2) * rng.choice([0.5, 1, 3], (400, 1))
    rows = [(k, v.tolist()) for k, v in enumerate(m)] + [(1000 + k, m[3].tolist()) for k in range(200)]  # one vector in a third of all rows
    got = topk.topk_join(frame(spark, rows), F.col("vec_id") % 5 == 0, 4, cells, block, group, home)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert result(got) == brute(rows, 4, 5)


def test_odd_rows(spark):
    r = random.Random(2)
    odd = [(0, None), (5, [None, 1.0]), (10, [float("nan"), 1.0]), (15, [float("inf")]), (20, []), (25, [0.0, 0.0]), (30, [0.5]), (35, [0.5, -0.25, 3.0]), (None, [0.5, 0.5]), (None, [0.5, 0.5]), (40, [0.5, 0.5]), (40, [0.5, 0.5]), (40, [0.5]),
           (45, [1e6, -1e6]), (-5, [-0.001, 0.001]), (50, [2.0**40]), (55, [2.0**14, 1.0])]
    rows = odd + [(100 + k, [r.choice([0.5, 0.25, -1.0]), r.choice([0.5, 0.0])]) for k in range(30)]
    assert result(topk.topk_join(frame(spark, rows), F.col("vec_id") % 5 == 0, 5)) == brute(rows, 5, 5)
    assert result(topk.topk_join(frame(spark, rows), F.col("vec_id") % 5 == 0, 5, 3, 4, 2, 1)) == brute(rows, 5, 5)
    assert result(topk.topk_join(frame(spark, odd[-2:]), F.col("vec_id") % 5 == 0, 5)) == brute(odd[-2:], 5, 5)
    assert topk.topk_join(frame(spark, rows), F.lit(False), 5).count() == 0
    assert topk.topk_join(frame(spark, [(5, [1.0])]), F.lit(True), 5).count() == 0
    assert topk.topk_join(frame(spark, rows).limit(0), F.lit(True), 5).count() == 0


def test_scores_beyond_doubles():
    a = np.array([[2.0**30, 1.0], [3.0, 2.0**29]])
    b = np.array([[2.0**31, 1.0], [1.0, 7.0]])
    assert topk.scores(a, b).tolist() == [[2**61 + 1, 2**30 + 7], [3 * 2**31 + 2**29, 3 + 7 * 2**29]]
    assert topk.scores(np.array([[2.0**40]]), np.array([[2.0**40], [-(2.0**40)]])).tolist() == [[2**63 - 1, -(2**63)]]


def test_far_blocks_are_not_sent(spark):
    """On tight clusters most blocks are never sent to a group, and the result is whole."""
    rng = np.random.default_rng(1)
    m = clustered(rng, 1500, 6, 30, 0.02)
    rows = [(k, v.tolist()) for k, v in enumerate(m)]
    sent = []
    plain = topk._solved
    topk._solved = lambda groups, pairs, blocks, k: (sent.append(pairs.count()), plain(groups, pairs, blocks, k))[1]
    try:
        got = topk.topk_join(frame(spark, rows), F.col("vec_id") % 10 == 0, 3, cells=30, block=50, group=5)
        assert result(got) == brute(rows, 3, 10)
    finally:
        topk._solved = plain
    blocks, groups = 30, 150 / 5
    assert sum(sent) < 0.4 * blocks * groups
