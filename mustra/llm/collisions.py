"""Approximate nearest neighbours by collision-counting hashing.

Index. Each of ``projections`` seeded normal directions gives a sorted array of all vectors' projections, in blocks of at most
``block_rows`` vectors; every vector is in all arrays.

Search. A query's window around its own projection has the half width ``half_width`` times a radius, in every array. A
vector collides once for each window it is in, and is verified, by its exact distance, once it has collided ``threshold``
times. Virtual rehashing widens the windows: the radius grows by steps to the query's reach, and only what a window
gains is counted. The reach is the k-th smallest distance to a bounded sample of vectors, so no neighbour is farther; once the radius
has come to the k-th distance of those verified, it stops. A query that has no k sample vectors opens its
windows to the ends of the arrays, which verifies all.

Recall. A vector as far as the reach is in a window with the probability that a normal value is within ``half_width``, nearer ones more
likely; ``threshold`` is the largest count that such a vector misses with a probability of at most ``miss``. Nothing else is lost: no number
of collisions, candidates or members of a bucket is capped. The sample's nearest are among what is found, so every query has its k rows.

Scale. Data are dealt to blocks and queries to groups of ``group_queries`` by row number, so many equal vectors or rows of one id are spread;
a task holds one block and one group and gives k rows a query. A row is copied once to each group, a query once to each block.
The driver holds the counts and the sample: ``sample_rows`` vectors, fewer if they are of more than ``sample_values`` components together.

Defined results: rows whose id or vector is null, whose vector is zero or empty, or with a null, NaN or infinite component take no part; shorter
vectors are filled up with zeros; rows that repeat are candidates and queries of their own; a query never meets rows of its own id; equal
distances go by the smaller id; fewer candidates than k give fewer rows; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mustra.llm.common import stage
from mustra.llm.voronoi import usable

PROJECTIONS = 96
HALF_WIDTH = 1.4
MISS = 0.01
SEED = 11
BLOCK_ROWS = 8192
GROUP_QUERIES = 1024
SAMPLE_ROWS = 2048
SAMPLE_VALUES = 1 << 20
#: Radii of the virtual rehashing as parts of the reach.
STEPS = (0.5, 0.8, 1.0)
#: Of the lengths of direction and query; far above the error of a product, far below what parts vectors that differ.
ROUNDING = 1e-12
_FOUND = "ask long, query_id long, row long, vec_id long, score double"


def threshold(projections: int, half_width: float, miss: float) -> int:
    """The most collisions asked for that a vector at the radius misses with a probability of at most ``miss``."""
    within = math.erf(half_width / math.sqrt(2))
    below, count = 0.0, 0
    while count < projections:
        below += math.comb(projections, count) * within**count * (1 - within) ** (projections - count)
        if below > miss:
            break
        count += 1
    return max(1, count)


def _matrix(values: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows, filled up to ``width``."""
    if isinstance(values, pa.ChunkedArray):
        values = pa.concat_arrays(values.chunks) if values.num_chunks else pa.array([], values.type)
    flat = values.flatten().to_numpy(zero_copy_only=False)
    sizes = values.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def distances(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    return np.sqrt(((rows - query) ** 2).sum(1))


def directions(seed: int, projections: int, width: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((projections, width))


class Block:
    """Vectors with a sorted array of their projections on each direction."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, along: np.ndarray):
        self.ids, self.vectors, self.along = ids, vectors, along
        projected = along @ vectors.T
        self.order = np.argsort(projected, axis=1, kind="stable")
        self.sorted = np.take_along_axis(projected, self.order, 1)

    def windows(self, queries: np.ndarray, reaches: np.ndarray, half_width: float) -> np.ndarray:
        """For each query and step, and for the empty window before them, where its window begins and ends in each array."""
        centres = queries @ self.along.T
        # copies of a query may differ from it in the last digits of a projection
        slack = ROUNDING * np.sqrt((queries**2).sum(1))[:, None] * np.sqrt((self.along**2).sum(1))
        halves = half_width * reaches[:, None, None] * np.array(STEPS)[:, None] + slack[:, None]
        out = np.empty((len(queries), len(STEPS) + 1, 2, len(self.along)), np.int64)
        for i, (values, centre) in enumerate(zip(self.sorted, centres.T, strict=True)):
            out[:, 0, :, i] = values.searchsorted(centre)[:, None]
            out[:, 1:, 0, i] = values.searchsorted(centre[:, None] - halves[:, :, i])
            out[:, 1:, 1, i] = values.searchsorted(centre[:, None] + halves[:, :, i], "right")
        return out

    def nearest(self, own: int, query: np.ndarray, reach: float, windows: np.ndarray, k: int, enough: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and distances of the k nearest found, and how many vectors were verified."""
        count, open_ = np.zeros(len(self.ids), np.int64), self.ids != own
        places, far, verified, least = np.zeros(0, np.int64), np.zeros(0), 0, reach
        for part, (low, high), (left, right) in zip(STEPS, windows[:-1], windows[1:], strict=True):
            gained = [o[a:b] for o, a, b in zip(self.order, left.tolist(), low.tolist(), strict=True)]
            gained += [o[a:b] for o, a, b in zip(self.order, high.tolist(), right.tolist(), strict=True)]
            count += np.bincount(np.concatenate(gained), minlength=len(count))
            new = np.flatnonzero((count >= enough) & open_)
            open_[new] = False
            verified += len(new)
            places, far = np.append(places, new), np.append(far, distances(self.vectors[new], query))
            best = np.lexsort((self.ids[places], far))[:k]
            places, far = places[best], far[best]
            if len(far) == k:
                least = min(least, float(far[-1]))
            if part * reach >= least:
                break
        return places, far, verified


def nearest(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", projections: int = PROJECTIONS, half_width: float = HALF_WIDTH, miss: float = MISS, block_rows: int = BLOCK_ROWS, group_queries: int = GROUP_QUERIES, sample_rows: int = SAMPLE_ROWS, sample_values: int = SAMPLE_VALUES, seed: int = SEED) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: of each row for which ``queries`` holds the k nearest vectors found."""
    vector = F.col(vector_col)
    good = F.col(id_col).isNotNull() & usable(vector) & F.exists(vector, lambda x: x != 0)
    rows = vectors.filter(good).select(F.col(id_col).cast("long").alias("vec_id"), vector.cast("array<double>").alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks"), F.monotonically_increasing_id().alias("row"))
    # row numbers are those of the files from here on, whatever is computed anew
    rows = stage(rows)
    largest = F.array_max(F.transform("vector", lambda x: F.abs(x)))
    known = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("asked"), F.max(F.size("vector")).alias("width"), F.max(largest).alias("largest")).first()
    width, blocks, groups = known.width or 0, max(1, -(-known.n // block_rows)), max(1, -(-known.asked // group_queries))
    # squares of components of any size stay in range: a power of two changes no digit
    unit = 1.0 if not known.n or abs(math.frexp(known.largest)[1]) < 400 else math.ldexp(1.0, math.frexp(known.largest)[1])
    some = rows.orderBy(F.xxhash64(F.lit(seed), "row"), "row").limit(min(sample_rows, max(k + 1, sample_values // max(1, width)))).select("row", "vec_id", "vector").toArrow()
    sample_rows_, sample_ids, sample = some["row"].to_numpy(), some["vec_id"].to_numpy(), _matrix(some["vector"], width) / unit
    enough = threshold(projections, half_width, miss)

    def with_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries with their reach and the sample's nearest."""
        for batch in batches:
            reach, near = [], []
            for own, query in zip(batch.column(1).to_pylist(), _matrix(batch.column(2), width) / unit, strict=True):
                others = np.flatnonzero(sample_ids != own)
                far = distances(sample[others], query)
                best = np.lexsort((sample_ids[others], far))[:k]
                reach.append(float(far[best[-1]]) if len(best) == k else math.inf)
                near.append([{"row": r, "vec_id": v, "score": s} for r, v, s in zip(sample_rows_[others[best]].tolist(), sample_ids[others[best]].tolist(), (far[best] * unit).tolist(), strict=True)])
            kind = pa.list_(pa.struct([("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(reach, pa.float64()), pa.array(near, kind)], names=["ask", "query_id", "query", "reach", "near"])

    def search(data: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        if len(data) and len(asked):
            ids, numbers = data["vec_id"].to_numpy(), data["row"].to_numpy()
            block = Block(ids, _matrix(data["vector"], width) / unit, directions(seed, projections, width))
            wanted, reaches = _matrix(asked["query"], width) / unit, asked["reach"].to_numpy()
            windows = block.windows(wanted, reaches, half_width)
            for ask, own, query, reach, window in zip(asked["ask"].to_pylist(), asked["query_id"].to_pylist(), wanted, reaches.tolist(), windows, strict=True):
                at, far, _ = block.nearest(own, query, reach, window, k, enough)
                for column, values in zip(out, ([ask] * len(at), [own] * len(at), numbers[at].tolist(), ids[at].tolist(), (far * unit).tolist()), strict=True):
                    column.extend(values)
        return pa.table([pa.array(c, t) for c, t in zip(out, [pa.int64()] * 4 + [pa.float64()], strict=True)], ["ask", "query_id", "row", "vec_id", "score"])

    dealt = lambda row, n: F.pmod(F.xxhash64(F.lit(seed), row), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = rows.filter("asks").select("row", "vec_id", "vector").mapInArrow(with_sample, "ask long, query_id long, query array<double>, reach double, near array<struct<row: bigint, vec_id: bigint, score: double>>")
    sent = asked.drop("near").withColumn("of", dealt("ask", groups)).withColumn("block", every(blocks))
    data = rows.select("row", "vec_id", "vector", dealt("row", blocks).alias("block")).withColumn("of", every(groups))
    found = data.groupBy("block", "of").cogroup(sent.groupBy("block", "of")).applyInArrow(search, _FOUND)
    # what the sample holds is found in any case, so each query has its k rows; it may be found twice
    found = found.unionByName(asked.select("ask", "query_id", F.inline("near"))).repartition("ask")
    found = found.groupBy("ask", "query_id", "row", "vec_id").agg(F.min("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("ask").orderBy("score", "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
