import numpy as np
from pyspark.sql import functions as F

from mustra.llm import voronoi


def brute(rows, k=5):
    whole = [(i, [int(np.floor(256 * np.float64(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (i, q) in enumerate(whole):
        if i % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for m, (j, v) in enumerate(whole) if j != i)
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


def got(spark, rows, **options):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return sorted(map(tuple, voronoi.top_k(frame, F.col("vec_id") % 50 == 0, **options).collect()))


def test_clustered_vectors_by_small_cells_and_chunks(spark):
    rng = np.random.default_rng(4)
    centres = 4 * rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + 0.05 * rng.normal(size=8)).tolist()) for i in range(400)]
    assert got(spark, rows, group_queries=1, block_queries=2, chunk_rows=50) == brute(rows)
    assert got(spark, rows) == brute(rows)


def test_hard_vectors(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (50, [0.5]), (7, [3e9, -1.0]), (100, [1e12, 1e12]), (8, None), (9, [float("nan"), 1.0]), (10, [None, 1.0]), (11, [float("inf"), 1.0]), (None, [1.0, 1.0]), (12, [1.0, 2.0]), (13, [1.0, 2.0])]
    expected = brute(rows)
    assert got(spark, rows) == [(q, r, i, min(s, 2**63 - 1)) for q, r, i, s in expected]
    assert got(spark, [(1, [1.0])]) == [] and got(spark, [(0, [1.0])]) == []
    assert spark.createDataFrame([], "vec_id long, embedding array<double>").transform(lambda d: voronoi.top_k(d, F.col("vec_id") % 50 == 0)).count() == 0


def test_cells_are_pruned(spark):
    rng = np.random.default_rng(1)
    data = np.concatenate([[10, 0] + 0.01 * rng.normal(size=(50, 2)), [0, 10] + 0.01 * rng.normal(size=(50, 2))])
    rows = list(zip(range(0, 5000, 50), data.tolist(), strict=True))
    assert got(spark, rows, group_queries=10) == brute(rows)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    join = voronoi.voronoi_join(frame, F.col("vec_id") % 50 == 0, group_queries=10)
    groups = len(set(join.group.tolist()) - {-1})
    assert groups >= 4 and not join.meet.all()
    copies = join.copied().count()
    assert copies <= 0.6 * groups * len(rows)  # the rows of the other cluster stay away


def test_bounds_hold_for_every_pair():
    rng = np.random.default_rng(3)
    x = np.concatenate([c + rng.normal(size=(40, 4)) for c in 9 * rng.normal(size=(6, 4))])
    pivots = x[rng.choice(len(x), 8, replace=False)]
    of = ((x[:, None] - pivots) ** 2).sum(2).argmin(1)
    far, norm = np.sqrt(((x - pivots[of]) ** 2).sum(1)), np.sqrt((x**2).sum(1))
    most = lambda v: np.array([v[of == j].max() for j in range(8)])
    near = [(int(i), j, float(far[i])) for j in range(8) for i in sorted(np.flatnonzero(of == j), key=lambda i: far[i])[:4]]
    division = voronoi.Division(pivots, np.bincount(of, minlength=8), most(far), np.full(8, -np.inf), most(far), most(norm), near).raised(3)
    scores = x @ x.T
    np.fill_diagonal(scores, -np.inf)
    third = np.sort(scores, 1)[:, -3]
    meet = division.meet()
    assert all(division.floor[of[i]] <= third[i] for i in range(len(x))) and np.isfinite(division.floor).all() and not meet.all()
    assert all(meet[of[i], of[j]] for i in range(len(x)) for j in range(len(x)) if scores[i, j] >= third[i])
    assert set(division.groups(3)) == {0, 1, 2}


def test_many_rows_by_the_default_plan(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(3000)] + [(i, [1.0] * 6) for i in range(3000, 4000)]
    assert got(spark, rows) == brute(rows)
