"""Exact top-k search by inner product as a Voronoi join.

Division. Pivots are rows of the data; every query and every data row falls to its nearest pivot. The queries of a pivot are a
cell with a summary: their number, how far they are from the pivot (``reach``) and a score that all of them surpass k times
(``floor``). The data of a pivot are a part with a summary: their number, their distance from the pivot at most
(``radius``), their largest norm, and the ids and distances of the k + 1 rows nearest to it.

Bounds. A query of cell i and a row of part j score at most ``p_i . p_j + reach_i |p_j| + |p_i| radius_j + reach_i radius_j``
and at most the product of their largest norms; they score at least ``p_i . p_j - reach_i |p_j| - (|p_i| + reach_i) d`` for a row
at distance d from its pivot. The (k + 1)-th largest of these lower bounds (one may be the query's own id) is a floor of the
cell; the k-th best of a bounded set of reference rows, least over the cell, is another. Cells and parts whose upper bound is
under the floor don't meet; in those that do, a row x meets the cell only if ``p_i . x + reach_i |x|`` is up to the floor.

Join. Cells that are close are put into groups, so a row is copied once per group that has a cell for it. A group of many
queries is split into blocks of ``block_queries``, and what is copied to it into chunks by its own count, so a task holds one block
and one chunk however hot a cell or a vector is; queries are copied only to the chunks of their group. A task scores in slices by
matrix products and keeps what may be among the k best; these rows are merged per query.

There are as many pivots as the square root of the number of queries, at most ``most_pivots``, and a group for each ``group_queries``
queries, at least ``least_groups``, because every group that can't be pruned copies the data once. Pivots and references are
rows of the smallest seeded hashes; they and the summaries (a row per pivot) are all that the driver holds.

Components become ``floor(scale * x)`` and scores are exact integers: products are taken in doubles while their sums
stay under 2^53, else in Python integers; components beyond 2^62 and scores beyond 2^63 - 1 are held there.

Defined results: rows whose id or vector is null, or with a null, NaN or infinite component, take no part; shorter
vectors are filled up with zeros; rows that repeat are candidates and queries of their own; a query never meets rows of its
own id; equal scores go by the smaller id; fewer than k candidates give fewer rows; an empty table gives no rows; other
columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mustra.llm.common import stage

SCALE = 256
SEED = 4
GROUP_QUERIES = 256
LEAST_GROUPS = 4
MOST_PIVOTS = 256
REFERENCES = 256
BLOCK_QUERIES = 4096
CHUNK_ROWS = 16384
SLICE_SCORES = 1 << 22
_MOST = 1 << 62


class Division(NamedTuple):
    """What the driver knows of cells (rows of the arrays) and parts (columns), all bounded by the number of pivots."""

    pivots: np.ndarray
    #: of each pivot's queries
    queries: np.ndarray
    reach: np.ndarray
    floor: np.ndarray
    #: of each pivot's data
    radius: np.ndarray
    norm: np.ndarray
    #: id, pivot and distance of the rows nearest to their pivots
    near: list[tuple[int, int, float]]

    def raised(self, k: int) -> Division:
        """With the floors that the parts' nearest rows give."""
        p, size = self.pivots, np.sqrt((self.pivots**2).sum(1))
        if not self.near:
            return self
        ids, of, far = (np.array(x) for x in zip(*self.near, strict=True))
        with np.errstate(invalid="ignore"):
            low = p @ p[of].T - self.reach[:, None] * size[of] - (size + self.reach)[:, None] * far
        low -= 1e-9 * (np.abs(low) + 1)
        floor = self.floor.copy()
        for i in np.flatnonzero(self.queries):
            best: dict[int, float] = {}
            for row, bound in zip(ids.tolist(), low[i].tolist(), strict=True):
                best[row] = max(bound, best.get(row, -np.inf))
            if len(best) > k:
                floor[i] = max(floor[i], sorted(best.values())[-k - 1])
        return self._replace(floor=floor)

    def meet(self) -> np.ndarray:
        """Which cells may have one of their k best in which parts."""
        p, size = self.pivots, np.sqrt((self.pivots**2).sum(1))
        apart = p @ p.T + self.reach[:, None] * size + (size + self.reach)[:, None] * self.radius
        high = np.minimum(apart, (size + self.reach)[:, None] * self.norm)
        return (self.queries > 0)[:, None] & (high + 1e-9 * (np.abs(apart) + 1) >= self.floor[:, None])

    def groups(self, n: int) -> np.ndarray:
        """The group of each cell: cells that have queries go to the nearest of ``n`` of them that lie far apart."""
        used = np.flatnonzero(self.queries)
        out = np.full(len(self.pivots), -1)
        x = self.pivots[used]
        seeds = [int(self.queries[used].argmax())]
        gap = ((x - x[seeds[0]]) ** 2).sum(1)
        while len(seeds) < min(n, len(used)):
            seeds.append(int(np.where(np.isin(np.arange(len(used)), seeds), -1, gap).argmax()))
            gap = np.minimum(gap, ((x - x[seeds[-1]]) ** 2).sum(1))
        out[used] = ((x[:, None] - x[seeds][None]) ** 2).sum(2).argmin(1)
        return out


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))


def _quantised(values: pa.Array, width: int, scale: int) -> np.ndarray:
    """Rows of integers, filled up to ``width``."""
    flat = np.asarray(values.flatten().to_numpy(zero_copy_only=False), float)
    whole = np.clip(np.floor(scale * flat), -float(_MOST), float(_MOST)).astype(np.int64)
    sizes = np.diff(values.offsets.to_numpy())
    if len(sizes) and (sizes == width).all():
        return whole.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(whole)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = whole
    return out


def _packed(rows: np.ndarray) -> list[bytes]:
    """Bytes of each row, four a component where that is enough."""
    small = np.abs(rows).max(1, initial=0) < 2**31
    return [r.astype(np.int32).tobytes() if s else r.tobytes() for r, s in zip(rows, small, strict=True)]


def _unpacked(packed, width: int) -> np.ndarray:
    if not width:
        return np.zeros((len(packed), 0), np.int64)
    if all(len(b) == 4 * width for b in packed):
        return np.frombuffer(b"".join(packed), np.int32).reshape(len(packed), width).astype(np.int64)
    return np.stack([np.frombuffer(b, np.int32 if len(b) == 4 * width else np.int64).astype(np.int64) for b in packed])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products, exact: doubles if they can hold them, else Python integers."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1]) < 2.0**53:
        return a.astype(float) @ b.astype(float).T
    return a.astype(object) @ b.astype(object).T


def best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, data: np.ndarray, k: int) -> pd.DataFrame:
    """The k best of ``data`` for each query, as rows (query, vec_id, score); query: the query's position."""
    parts, floor = [], None
    step = max(1, SLICE_SCORES // max(1, len(queries)))
    own = pd.DataFrame({"id": query_ids, "query": np.arange(len(query_ids))})
    for start in range(0, len(ids), step):
        some = ids[start : start + step]
        scores = products(queries, data[start : start + step])
        low = -np.inf if scores.dtype == float else -(1 << 400)
        same = own.merge(pd.DataFrame({"id": some, "row": np.arange(len(some))}), on="id")
        scores[same["query"].to_numpy(), same["row"].to_numpy()] = low
        if scores.shape[1] >= k:
            kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
            floor = kth if floor is None else np.maximum(floor, kth)
        keep = scores > low if floor is None else (scores >= floor[:, None]) & (scores > low)
        q, x = np.nonzero(keep)
        parts.append(pd.DataFrame({"query": q, "vec_id": some[x], "score": [min(max(int(s), -(2**63)), 2**63 - 1) for s in scores[q, x]]}))
    found = pd.concat(parts) if parts else pd.DataFrame({"query": [], "vec_id": [], "score": []})
    found = found.sort_values(["query", "score", "vec_id"], ascending=[True, False, True], kind="stable")
    return found[found.groupby("query").cumcount() < k]


def _reference(rows: DataFrame, width: int, scale: int, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and components of the ``n`` rows of the smallest hashes."""
    table = rows.orderBy(F.xxhash64(F.lit(seed), "id", "v"), "id").limit(n).toArrow()
    vectors = table.column("v").combine_chunks()
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return table.column("id").to_numpy(), _quantised(vectors, width, scale)


class VoronoiJoin:
    """One search over one table; ``division``, ``copied`` (data rows by the group that they are copied to) and ``best``."""

    def __init__(self, vectors: DataFrame, is_query: Column, k: int, id_col: str, vector_col: str, scale: int, seed: int, group_queries: int, least_groups: int, most_pivots: int, block_queries: int, chunk_rows: int):
        self.spark, self.k, self.block_queries, self.chunk_rows = vectors.sparkSession, k, block_queries, chunk_rows
        rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
        rows = rows.filter(F.col("id").isNotNull() & usable(F.col("v")))
        size = rows.agg(F.count_if("is_query").alias("queries"), F.max(F.size("v")).alias("width")).first()
        self.queries, self.width = size.queries, size.width
        if not self.queries:
            return
        pivots = _reference(rows, self.width, scale, min(most_pivots, math.isqrt(self.queries - 1) + 1), seed)[1].astype(float)
        self.packed = self._assigned(rows, pivots, *_reference(rows, self.width, scale, REFERENCES, seed + 1), scale)
        self.division = self._division(pivots).raised(k)
        self.meet = self.division.meet()
        self.group = self.division.groups(max(least_groups, -(-self.queries // group_queries)))

    def _assigned(self, rows: DataFrame, pivots: np.ndarray, reference_ids: np.ndarray, references: np.ndarray, scale: int) -> DataFrame:
        """Packed rows with pivot, distance from it and norm; queries also with the score that k references surpass."""
        width, k = self.width, self.k

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                whole = _quantised(batch.column(1), width, scale)
                x, ids, query = whole.astype(float), batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
                pivot = ((pivots**2).sum(1) - 2 * x @ pivots.T).argmin(1).astype(np.int32) if len(x) else np.zeros(0, np.int32)
                far, norm, floor = np.sqrt(((x - pivots[pivot]) ** 2).sum(1)), np.sqrt((x**2).sum(1)), np.full(len(x), -np.inf)
                if query.any():
                    scores = x[query] @ references.astype(float).T
                    scores[ids[query][:, None] == reference_ids] = -np.inf
                    if scores.shape[1] >= k:
                        floor[query] = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_packed(whole), pa.binary()), batch.column(2), pa.array(pivot), pa.array(far), pa.array(norm), pa.array(floor)], names=["id", "v", "is_query", "pivot", "far", "norm", "floor"])

        packed = rows.mapInArrow(assign, "id long, v binary, is_query boolean, pivot int, far double, norm double, floor double")
        return stage(packed.withColumn("row", F.monotonically_increasing_id()))

    def _division(self, pivots: np.ndarray) -> Division:
        asked = lambda c, of: of(F.when(F.col("is_query"), F.col(c)))
        cells = self.packed.groupBy("pivot").agg(F.count_if("is_query").alias("queries"), asked("far", F.max).alias("reach"), asked("floor", F.min).alias("floor"), F.max("far").alias("radius"), F.max("norm").alias("norm")).collect()
        out = Division(pivots, *(np.full(len(pivots), x) for x in (0, 0.0, np.inf, 0.0, 0.0)), [])
        for r in cells:
            out.queries[r.pivot], out.radius[r.pivot], out.norm[r.pivot] = r.queries, r.radius, r.norm
            if r.queries:
                out.reach[r.pivot], out.floor[r.pivot] = r.reach, r.floor
        rank = F.row_number().over(Window.partitionBy("pivot").orderBy("far", "id", "row"))
        first = self.packed.withColumn("rank", rank).filter(F.col("rank") <= self.k + 1).select("id", "pivot", "far").collect()
        return out._replace(near=[tuple(r) for r in first])

    def copied(self) -> DataFrame:
        """id, v, row, group: every data row for each group that has a cell in which it may be among the k best."""
        used = np.flatnonzero(self.division.queries)
        centres, reach, floor, meet, group, width = self.division.pivots[used], self.division.reach[used], self.division.floor[used], self.meet[used].T, self.group[used], self.width
        n = int(group.max()) + 1
        member = group[:, None] == np.arange(n)

        def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, pivot, norm = _unpacked(batch.column(1).to_pylist(), width).astype(float), batch.column(3).to_numpy(), batch.column(4).to_numpy()
                middle, spread = x @ centres.T, reach * norm[:, None]
                may = meet[pivot] & (middle + spread + 1e-9 * (np.abs(middle) + spread + 1) >= floor)
                groups = [np.flatnonzero(m).astype(np.int32) for m in may @ member]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(groups, pa.list_(pa.int32()))], names=["id", "v", "row", "groups"])

        rows = self.packed.select("id", "v", "row", "pivot", "norm").mapInArrow(needed, "id long, v binary, row long, groups array<int>")
        return rows.select("id", "v", "row", F.explode("groups").alias("group"))

    def best(self) -> DataFrame:
        out, k, width = "query_id long, rank int, vec_id long, score long", self.k, self.width
        if not self.queries:
            return self.spark.createDataFrame([], out)
        copied = self.copied()
        counts = {r.group: r["count"] for r in copied.groupBy("group").count().collect()}
        asked = [int(self.division.queries[self.group == g].sum()) for g in range(int(self.group.max()) + 1)]
        blocks = F.array(*(F.lit(-(-q // self.block_queries)) for q in asked))
        chunks = F.array(*(F.lit(-(-counts.get(g, 0) // self.chunk_rows)) for g in range(len(asked))))
        every = lambda of: F.explode(F.sequence(F.lit(0), of[F.col("group")] - 1))
        data = copied.select("id", "v", "group", F.pmod("row", chunks[F.col("group")]).cast("int").alias("chunk")).withColumn("block", every(blocks))
        of_pivot = F.array(*map(F.lit, self.group.tolist()))
        queries = self.packed.filter("is_query").select("id", "v", "row", of_pivot[F.col("pivot")].alias("group")).filter(chunks[F.col("group")] > 0)
        queries = queries.withColumn("block", F.pmod("row", blocks[F.col("group")]).cast("int")).withColumn("chunk", every(chunks))

        def solve(some: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
            if not len(some) or not len(others):
                return pd.DataFrame({"row": [], "query_id": [], "vec_id": [], "score": []}).astype("int64")
            ids = some["id"].to_numpy()
            got = best(ids, _unpacked(some["v"].tolist(), width), others["id"].to_numpy(), _unpacked(others["v"].tolist(), width), k)
            at = got["query"].to_numpy(int)
            return pd.DataFrame({"row": some["row"].to_numpy()[at], "query_id": ids[at], "vec_id": got["vec_id"].to_numpy("int64"), "score": got["score"].to_numpy("int64")})

        key = ["group", "block", "chunk"]
        partial = queries.groupBy(*key).cogroup(data.groupBy(*key)).applyInPandas(solve, "row long, query_id long, vec_id long, score long")
        rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
        return partial.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def voronoi_join(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, seed: int = SEED, group_queries: int = GROUP_QUERIES, least_groups: int = LEAST_GROUPS, most_pivots: int = MOST_PIVOTS, block_queries: int = BLOCK_QUERIES, chunk_rows: int = CHUNK_ROWS) -> VoronoiJoin:
    return VoronoiJoin(vectors, is_query, k, id_col, vector_col, scale, seed, group_queries, least_groups, most_pivots, block_queries, chunk_rows)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, **options) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that ``is_query`` (an expression over ``vectors``), the k best others.

    ``options`` are those of ``voronoi_join``.
    """
    return voronoi_join(vectors, is_query, k, **options).best()
