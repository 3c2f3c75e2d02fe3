import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mustra.llm import collisions, queries


def brute(rows, k=10, every=100):
    width = max((len(v) for _, v in rows if v), default=0)
    whole = [(i, np.array([float(x) for x in v] + [0.0] * (width - len(v)))) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for i, q in whole:
        if i % every == 0:
            scored = sorted((float(np.sqrt(((v - q) ** 2).sum())), j) for j, v in whole if j != i)
            out += [(i, rank, j, s) for rank, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


def got(spark, rows, **options):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return sorted(map(tuple, collisions.nearest(frame, F.col("vec_id") % 100 == 0, **options).collect()))


def recall(found, exact):
    """Part of what brute force finds that is found."""
    return len({(q, v) for q, _, v, _ in found} & {(q, v) for q, _, v, _ in exact}) / len(exact)


@pytest.mark.parametrize("kind", ["clusters", "even", "copies"])
def test_recall_by_small_blocks_and_groups(spark, kind):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 24))
    if kind == "clusters":
        x = 5 * rng.normal(size=(12, 24))[np.arange(3000) % 12] + 0.3 * x
    if kind == "copies":
        x[200:1400] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    found, exact = got(spark, rows, block_rows=400, group_queries=7, sample_rows=300), brute(rows)
    assert len(found) == len(exact) and recall(found, exact) >= 0.97
    of = {i: np.array(v) for i, v in rows}
    assert all(s == np.sqrt(((of[q] - of[v]) ** 2).sum()) for q, _, v, s in found)
    by_query = {}
    for q, rank, v, s in found:
        by_query.setdefault(q, []).append((rank, s, v))
    assert all([r for r, *_ in x] == list(range(1, 11)) and [y[1:] for y in x] == sorted(y[1:] for y in x) for x in by_query.values())


def test_a_query_among_copies_gets_those_of_smallest_ids(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 == 0 else rng.normal(size=3).tolist()) for i in range(900)]
    of = [r for r in got(spark, rows, block_rows=100) if r[0] == 300]
    assert [r[2:] for r in of] == [(3 * i, 0.0) for i in range(10)]


def test_hard_vectors(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (100, [0.5]), (7, [3e9, -1.0]), (200, [1e12, 1e12]), (8, None), (9, [float("nan"), 1.0]), (10, [None, 1.0]), (11, [float("inf"), 1.0]), (None, [1.0, 1.0]), (12, [1.0, 2.0]), (13, [1.0, 2.0]), (14, [0.0, 0.0]), (15, [])]
    assert got(spark, rows) == brute(rows)
    assert got(spark, [(1, [1.0])]) == got(spark, [(0, [1.0])]) == got(spark, []) == []


def test_components_of_any_size(spark):
    rows = [(i, [s * 2.0**900 for s in (1.0, i, i * i)]) for i in range(30)]
    small = [(i, [x / 2.0**900 / 2.0**900 for x in v]) for i, v in rows]
    for unit, these in ((2.0**900, rows), (2.0**-900, small)):
        assert [(q, r, v) for q, r, v, _ in got(spark, these)] == [(0, r, r) for r in range(1, 11)]
        assert got(spark, these)[0][3] == math.sqrt(2) * unit


def test_threshold_is_the_largest_that_misses_seldom():
    for m, w, miss in ((96, 1.4, 0.01), (10, 0.5, 0.2), (40, 3.0, 1e-6)):
        p, enough = math.erf(w / math.sqrt(2)), collisions.threshold(m, w, miss)
        below = lambda t: sum(math.comb(m, i) * p**i * (1 - p) ** (m - i) for i in range(t))  # noqa: B023, E731
        assert below(enough) <= miss < below(enough + 1) or enough in (1, m)


def test_far_vectors_are_not_verified():
    rng = np.random.default_rng(5)
    near, far = 0.01 * rng.normal(size=(50, 16)), 50 + rng.normal(size=(950, 16))
    block = collisions.Block(np.arange(1000), np.concatenate([near, far]), collisions.directions(1, 96, 16))
    windows = block.windows(near[:1], np.array([0.2]), 1.4)
    places, _, verified = block.nearest(0, near[0], 0.2, windows[0], 10, collisions.threshold(96, 1.4, 0.01))
    exact = np.argsort(collisions.distances(near, near[0]))[1:11]
    assert set(places) == set(exact) and verified < 60


def test_query_reaches_its_recall(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    found = sorted(map(tuple, queries.op11_collision_search(spark, sf_dir).collect()))
    exact = brute(rows)
    assert len(found) == len(exact) and recall(found, exact) >= 0.95
