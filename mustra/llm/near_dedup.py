"""MinHash near-dedup with DartMinHash signatures.

Signatures. A document is a weighted set of its distinct runs of five words; each weighs 1, or on demand as much as it occurs.
Every element owns a region of height its weight along a rank axis, into which hashed darts fall as a Poisson process that depends on the
element alone: gaps between darts are exponential, drawn from the hash of element, unit of weight and dart number. A dart
also has a hashed coordinate and a hashed height; it counts if its height is within the weight. The earliest dart of each
coordinate is the signature, and two sets agree in a coordinate with probability of their weighted Jaccard similarity.
Only darts up to rank ``t (ln t + 3) / weight`` are thrown; a document with an empty coordinate throws on, twice as far.

Joining. Equal texts become one node. Nodes whose signatures agree in a band of ``BAND_ROWS`` coordinates share a
bucket. Instead of a bucket's pairs, every member is compared with the bucket's leader; texts that are similar
enough (an exact check of the runs of words, for pairs whose sizes and signatures admit it) are linked, and linked nodes
form components. Buckets whose members are all in one component are done. In the others, members outside the leader's
component get another leader, drawn anew for each round, as long as that links more of them; at last they are compared with
all members of other components, block by block and again by signature first. So no link between different components is
lost, beyond what bands (1 of 37,000 pairs of similarity 0.8) and the signature test (``SLACK`` standard deviations) miss.

Scale. Buckets are aggregated to their leaders before they are joined; the texts of nodes that have any pair to check are
kept in a table of their own. Components stay in tables.

Defined results: words are ``\\w+`` of the lower-cased text; fewer than five words make one run; texts without words are alike
only if equal; null text is empty; null ids belong to their text's class, whose id is the smallest that isn't null;
repeated rows give a row each; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mustra.llm.common import fresh, stage, valid_text

WORDS = 5
#: Similarity of a link, as a fraction.
LINK = (4, 5)
COORDINATES = 128
BANDS = 20
BAND_ROWS = 4
#: A pair's signatures may agree in so many standard deviations less than the threshold.
SLACK = 4.0
ROUNDS = 5
#: Members of a bucket that meet in one task.
BLOCK_ROWS = 2048
#: Rows of a partition in the tables of components.
PART_ROWS = 200_000
#: Signatures are made for so many elements or texts at a time, and so many darts are thrown at once; each bounds memory.
BATCH_ELEMENTS = 1 << 16
BATCH_TEXTS = 512
DARTS = 1 << 18
#: Words whose hashes a worker remembers.
MEMO_WORDS = 1 << 17
_WORD = re.compile(r"\w+")
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def _uniform(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54


class Shingler:
    """Distinct hashed runs of words and, on demand, how often each occurs; the hashes of words are remembered, up to a bound."""

    def __init__(self, words: int = WORDS, most: int = MEMO_WORDS):
        import xxhash

        self.words, self.most, self.hash_of, self.known = words, most, xxhash.xxh64_intdigest, {}

    def _runs(self, text: str) -> np.ndarray:
        words = _WORD.findall(text.lower())
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > self.most:
            self.known.clear()
        known, hash_of = self.known, self.hash_of
        each = np.array([known[w] if w in known else known.setdefault(w, hash_of(w)) for w in words], np.uint64)
        n = min(self.words, len(each))
        runs = np.full(len(each) - n + 1, n, np.uint64)
        for i in range(n):
            runs = _mixed(runs * _A + each[i : len(each) - n + 1 + i])
        return runs

    def __call__(self, text: str) -> np.ndarray:
        return np.unique(self._runs(text))

    def weighted(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(self._runs(text), return_counts=True)


def _pieces(x: np.ndarray, size: int) -> Iterator[np.ndarray]:
    for start in range(0, len(x), max(1, size)):
        yield x[start : start + max(1, size)]


def dart_signatures(sets: list[np.ndarray], weights: list[np.ndarray] | None = None, coordinates: int = COORDINATES) -> np.ndarray:
    """A row of ``coordinates`` 16-bit values per set of uint64 elements; rows of sets without weight are zeros."""
    out = np.zeros((len(sets), coordinates), np.uint16)
    total = np.array([len(s) if weights is None else weights[i].sum() for i, s in enumerate(sets)], float)
    reach = np.divide(coordinates * (math.log(coordinates) + 3), total, out=np.zeros(len(sets)), where=total > 0)
    todo = np.flatnonzero(total > 0)
    while len(todo):
        element = np.concatenate([sets[i] for i in todo])
        row = np.repeat(np.arange(len(todo)), [len(sets[i]) for i in todo])
        weight = np.ones(len(element)) if weights is None else np.concatenate([weights[i] for i in todo]).astype(float)
        units = np.ceil(weight).astype(np.int64)
        unit = np.arange(units.sum()) - np.repeat(np.cumsum(units) - units, units)
        element, row, room = np.repeat(element, units), np.repeat(row, units), np.repeat(weight, units) - unit
        seed = _mixed(element + unit.astype(np.uint64) * _D)
        keys, ranks, values = [], [], []
        far = reach[todo][row]
        for least, most, step in ((0, 1, 1), (1, 16, 4), (16, np.inf, 64)):
            for some in _pieces(np.flatnonzero((far >= least) & (far < most)), DARTS // step):
                at, first = np.zeros(len(some)), 0
                while len(some):
                    dart = _mixed(seed[some][:, None] + np.arange(first + 1, first + step + 1, dtype=np.uint64) * _A)
                    rank = at[:, None] - np.log(_uniform(dart)).cumsum(1)
                    hit = rank <= far[some][:, None]
                    where, _ = np.nonzero(hit)
                    found = _mixed(dart[hit] + _D)
                    if weights is not None:
                        low = _uniform(_mixed(found + _D)) <= room[some][where]
                        where, found = where[low], found[low]
                    keys.append(row[some][where] * coordinates + (found % np.uint64(coordinates)).astype(np.int64))
                    ranks.append(rank[hit] if weights is None else rank[hit][low])
                    values.append((found >> np.uint64(48)).astype(np.uint16))
                    on = rank[:, -1] <= far[some]
                    at, some, first = rank[on, -1], some[on], first + step
        key, rank, value = np.concatenate(keys), np.concatenate(ranks), np.concatenate(values)
        order = np.lexsort((rank, key))
        key, value = key[order], value[order]
        earliest = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        filled = np.bincount(key[earliest] // coordinates, minlength=len(todo)) == coordinates
        done = earliest[filled[key[earliest] // coordinates]]
        out[todo[key[done] // coordinates], key[done] % coordinates] = value[done]
        todo = todo[~filled]
        reach[todo] *= 2
    return out


def similar(a: np.ndarray, b: np.ndarray, link: tuple[int, int] = LINK) -> bool:
    """Whether the Jaccard similarity of two arrays of distinct elements is ``link`` or more; of empty ones it is not."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common > 0 and common * link[1] >= (len(a) + len(b) - common) * link[0]


def similar_weighted(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], link: tuple[int, int] = LINK) -> bool:
    """The same for the weighted Jaccard similarity of (elements, weights)."""
    _, at_a, at_b = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = int(np.minimum(a[1][at_a], b[1][at_b]).sum())
    return common > 0 and common * link[1] >= (int(a[1].sum()) + int(b[1].sum()) - common) * link[0]


def _compared(words: int, weighted: bool) -> tuple[Callable, Callable]:
    """What makes a text's set and what compares two of them."""
    shingles = Shingler(words)
    return (shingles.weighted, similar_weighted) if weighted else (shingles, similar)


def _key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def sign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, coordinates: int = COORDINATES, weighted: bool = False) -> DataFrame:
    """Per row: id, key (of its text), n (distinct runs of words; all runs if ``weighted``), signature (16-bit values)."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(words)
        for batch in batches:
            sets: list[np.ndarray] = []
            counts: list[np.ndarray] = []
            sizes, packed, size = [], [], 0
            texts = batch.column(2)
            for i in range(len(texts)):
                if weighted:
                    elements, times = shingles.weighted(texts[i].as_py())
                    counts.append(times)
                    sizes.append(int(times.sum()))
                else:
                    elements = shingles(texts[i].as_py())
                    sizes.append(len(elements))
                sets.append(elements)
                size += len(elements)
                if size >= BATCH_ELEMENTS or len(sets) == BATCH_TEXTS or i == len(texts) - 1:
                    packed += [s.tobytes() for s in dart_signatures(sets, counts if weighted else None, coordinates)]
                    sets, counts, size = [], [], 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(packed, pa.binary())], names=["id", "key", "n", "signature"])

    text = valid_text(text_col)
    rows = docs.select(F.col(id_col).alias("id"), _key(text).alias("key"), text.alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, key binary, n int, signature binary")


def _parts(rows: int) -> int:
    """Partitions for a table of so many rows: the tables of components shrink fast, and their files should with them."""
    return -(-rows // PART_ROWS) or 1


def components(edges: DataFrame) -> DataFrame:
    """node, comp for the nodes of ``edges`` (a, b; distinct, a and b differ, lineage cut): each component's smallest node, by
    contraction to smallest neighbours."""
    labels, labelled = None, 1
    while rows := edges.count():
        edges, parts = edges.coalesce(_parts(rows)), _parts(2 * rows)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("to")).coalesce(parts))
        step = to.withColumnRenamed("to", "comp")
        labelled = max(labelled, parts)
        labels = step if labels is None else stage(labels.join(to, labels.comp == to.node, "left").select(labels.node, F.coalesce("to", "comp").alias("comp")).coalesce(labelled))
        moved = edges.join(to.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(to.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        edges = stage(moved.filter(F.col("x") != F.col("y")).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct().coalesce(_parts(rows)))
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))


def joined_components(labels: DataFrame, more: DataFrame) -> DataFrame:
    """``labels`` (node, comp) with the components that the edges ``more`` join; only their ends' components are worked on."""
    of = lambda end, as_: labels.select(F.col("node").alias(end), F.col("comp").alias(as_))
    rows = more.count()
    ends = more.coalesce(_parts(rows)).join(of("a", "x"), "a", "left").join(of("b", "y"), "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
    moves = components(stage(ends.filter(F.col("a") != F.col("b")).distinct().coalesce(_parts(rows))))
    to = moves.select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    moved = labels.join(to, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    return stage(moved.unionByName(moves.join(labels.select("node"), "node", "left_anti")).coalesce(_parts(labels.count() + 2 * rows)))


class NearClasses:
    """One run over one table of documents."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, words: int, link: tuple[int, int], coordinates: int, bands: int, band_rows: int, slack: float, rounds: int, weighted: bool):
        self.spark: SparkSession = docs.sparkSession
        self.weighted = weighted
        self.docs, self.id_col, self.text_col, self.words, self.link, self.rounds = docs, id_col, text_col, words, link, rounds
        self.coordinates, self.bands, self.band_rows = coordinates, bands, band_rows
        share = link[0] / link[1]
        self.agree = math.floor(coordinates * share - slack * math.sqrt(coordinates * share * (1 - share)))

    def pairs(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """``left`` (a, b, ...) are keys of nodes; those whose sizes and signatures admit a link."""
        a, b = (right.select(F.col("key").alias(k), F.struct("n", "values").alias(f"of_{k}")) for k in ("a", "b"))
        known = left.join(a, "a").join(b, "b")
        n_a, n_b = F.col("of_a.n"), F.col("of_b.n")
        p, q = self.link
        agreed = F.size(F.filter(F.zip_with("of_a.values", "of_b.values", lambda x, y: x == y), lambda x: x))
        return known.filter((F.least(n_a, n_b) * q >= F.greatest(n_a, n_b) * p) & (agreed >= self.agree)).select("a", "b")

    def classes(self) -> DataFrame:
        """Per row of the documents: id, key, comp (the class by its smallest key) and class_id."""
        signed = stage(sign(self.docs, self.id_col, self.text_col, self.words, self.coordinates, self.weighted))
        nodes = signed.filter("n > 0").groupBy("key").agg(F.first("n").alias("n"), F.first("signature").alias("signature"))
        width = 2
        values = F.transform(F.sequence(F.lit(0), F.lit(self.coordinates - 1)), lambda i: F.substring(F.col("signature"), i * width + 1, F.lit(width)))
        bands = [F.xxhash64(F.lit(i), F.substring("signature", i * self.band_rows * width + 1, self.band_rows * width)) for i in range(self.bands)]
        nodes = stage(nodes.select("key", "n", "signature"))
        buckets = nodes.select("key", F.posexplode(F.array(*bands)).alias("band", "bucket"))
        leaders = buckets.groupBy("bucket").agg(F.min("key").alias("a"), F.count("*").alias("members")).filter("members > 1").select("bucket", "a")
        shared = stage(buckets.join(leaders, "bucket").select("bucket", "band", "a", "key"))
        seen = nodes.join(shared.select("key").distinct(), "key", "left_semi").select("key", "n", values.alias("values"))
        seen = stage(seen)
        first = self.pairs(shared.filter("a <> key").select("a", F.col("key").alias("b")).distinct(), seen)
        texts = self.texts(shared.select("key").distinct())
        labels = components(stage(self.verify(first, texts)))
        left = None
        for turn in range(self.rounds + 1):
            places = shared.join(labels.withColumnRenamed("node", "key"), "key", "left").select("bucket", "band", "a", "key", F.coalesce("comp", "key").alias("comp"))
            lead = places.filter("a = key").select("bucket", F.col("comp").alias("main"))
            places = places.select("bucket", "band", "key", "comp").join(lead, "bucket")
            outside = stage(places.filter("comp <> main"))
            now = outside.count()
            if not now:
                break
            last = turn == self.rounds or left is not None and now > 0.7 * left
            if last:
                found = self.remaining(outside, places, nodes, texts)
            else:
                draw = F.min(F.struct(F.xxhash64(F.lit(turn), "bucket", "key").alias("draw"), F.col("key").alias("a"))).alias("best")
                inside = places.filter("comp = main").join(outside.select("bucket").distinct(), "bucket", "left_semi")
                again = inside.groupBy("bucket").agg(draw).select("bucket", "best.a")
                found = self.verify(self.pairs(outside.join(again, "bucket").select("a", F.col("key").alias("b")).distinct(), seen), texts)
            labels = joined_components(labels, stage(found))
            left = now
            if last:
                break
        of_key = signed.groupBy("key").agg(F.min("id").alias("smallest")).join(labels.withColumnRenamed("node", "key"), "key", "left").select("key", "smallest", F.coalesce("comp", "key").alias("comp"))
        named = of_key.groupBy("comp").agg(F.min("smallest").alias("class_id"), F.count("*").alias("texts"))
        linked = of_key.join(named.filter("texts > 1"), "comp").select("key", "comp", "class_id")
        own = of_key.join(linked.select("key"), "key", "left_anti").select("key", "comp", F.col("smallest").alias("class_id"))
        # a table of its own, so that the rows of a hot key can be split
        known = stage(linked.unionByName(own))
        return signed.select("id", "key").join(known, "key").select("id", "key", "comp", "class_id")

    def remaining(self, outside: DataFrame, places: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
        """Links (a, b) of members outside their bucket's main component with members of other components.

        A bucket's members meet in blocks of bounded size. First their signatures tell which members may be linked at
        all; only these come again with their texts, and links are found inside the blocks, one for each member and
        component, so no pair that isn't a link is ever a row. A pair that shares several buckets is met in one.
        """
        open_ = places.join(outside.select("bucket").distinct(), "bucket", "left_semi").join(nodes, "key")
        sides = open_.select("bucket", "band", "key", "comp", "n", "signature", (F.col("comp") != F.col("main")).alias("outside"))
        sides = stage(sides)
        met = stage(self.blocks(sides, self._may_link, "bucket long, band int, key binary").distinct())
        known = sides.join(met, ["bucket", "band", "key"], "left_semi").join(texts, "key")
        return self.blocks(known, self._links, "a binary, b binary").distinct()

    def blocks(self, rows: DataFrame, solve, schema: str) -> DataFrame:
        """``solve(outside, members)`` over blocks: a large bucket's members outside and all its members meet in several
        blocks of bounded size, small buckets share a block."""
        size = rows.groupBy("bucket", "band").agg(F.ceil(F.count_if("outside") / BLOCK_ROWS).cast("int").alias("high"), F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("wide")).filter("high > 0")
        placed = rows.join(size, ["bucket", "band"])
        shares = max(1, rows.count() // (2 * BLOCK_ROWS))
        bucket = F.xxhash64("bucket", "band")
        placed = placed.withColumn("deal", F.when(F.col("wide") == 1, F.pmod(bucket, F.lit(shares))).otherwise(bucket))
        number = lambda c: F.pmod(F.xxhash64("key"), F.col(c)).cast("int")
        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        left = placed.filter("outside").withColumn("i", number("high")).withColumn("j", every("wide")).drop("high", "wide")
        right = placed.withColumn("j", number("wide")).withColumn("i", every("high")).drop("high", "wide")
        right = right.select(*(F.col(c).alias(c) for c in right.columns))  # columns of its own, as both sides come from the same rows
        key = ["deal", "i", "j"]
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(solve, schema)

    @property
    def _candidates(self):
        """A function that gives, for two blocks, the pairs (positions) that sizes, signatures and components admit."""
        (p, q), agree, bands, rows_, coordinates = self.link, self.agree, self.bands, self.band_rows, self.coordinates

        def candidates(left: pd.DataFrame, right: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
            if not len(left) or not len(right):
                return
            every_a, every_b = (np.frombuffer(b"".join(x["signature"]), np.uint16).reshape(len(x), coordinates) for x in (left, right))
            sizes_a, sizes_b, comp_a, comp_b = left["n"].tolist(), right["n"].to_numpy(np.int64), left["comp"].tolist(), right["comp"].to_numpy()
            members = right.groupby(["bucket", "band"]).indices
            for (bucket, band), own in left.groupby(["bucket", "band"]).indices.items():
                others = members.get((bucket, band), [])
                if not len(others):
                    continue
                b, n, of = every_b[others], sizes_b[others], comp_b[others]
                for i in own:
                    same = every_a[i] == b
                    at = np.flatnonzero((same.sum(1) >= agree) & (np.minimum(n, sizes_a[i]) * q >= np.maximum(n, sizes_a[i]) * p) & (of != comp_a[i]))
                    if len(at):
                        first = same[at, : bands * rows_].reshape(len(at), bands, rows_).all(2).argmax(1)
                        yield i, others[at[first == band]]

        return candidates

    @property
    def _may_link(self):
        candidates = self._candidates

        def solve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            hit_left, hit_right = np.zeros(len(left), bool), np.zeros(len(right), bool)
            for i, at in candidates(left, right):
                hit_left[i] |= len(at) > 0
                hit_right[at] = True
            names = ["bucket", "band", "key"]
            return pd.concat([left.loc[hit_left, names], right.loc[hit_right, names]])

        return solve

    @property
    def _links(self):
        candidates, words, link, weighted = self._candidates, self.words, self.link, self.weighted

        def solve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            (shingles, similar), out, done = _compared(words, weighted), [], set()
            sets = {k: shingles(t) for x in (left, right) for k, t in dict(zip(x["key"], x["text"], strict=True)).items()}
            keys_a, keys_b, comps = left["key"].tolist(), right["key"].tolist(), right["comp"].tolist()
            for i, at in candidates(left, right):
                for j in at:
                    own, other = keys_a[i], keys_b[j]
                    if (own, comps[j]) not in done and similar(sets[own], sets[other], link):
                        done.add((own, comps[j]))
                        out.append((min(own, other), max(own, other)))
            return pd.DataFrame(out, columns=["a", "b"])

        return solve

    def texts(self, keys: DataFrame) -> DataFrame:
        """key, text of the nodes named."""
        text = valid_text(self.text_col)
        # copies are combined before the shuffle, so that no task gets all rows of a hot key
        once = self.docs.select(_key(text).alias("key"), text.alias("text")).groupBy("key").agg(F.first("text").alias("text"))
        return stage(once.join(keys, "key"))

    def verify(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """The pairs (a, b) that are linked indeed."""
        both = pairs.join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a")
        words, link, weighted = self.words, self.link, self.weighted

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (shingles, similar), last, of_last = _compared(words, weighted), None, None
            for batch in batches:
                keep = []
                for a, text_a, text_b in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                    if a != last:
                        last, of_last = a, shingles(text_a.as_py())
                    keep.append(similar(of_last, shingles(text_b.as_py()), link))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, link: tuple[int, int] = LINK, coordinates: int = COORDINATES, bands: int = BANDS, band_rows: int = BAND_ROWS, slack: float = SLACK, rounds: int = ROUNDS, weighted: bool = False) -> DataFrame:
    """One row per row of ``docs``: id and class_id, the smallest id among the documents that links lead to.

    ``weighted``: every run of words weighs as much as it occurs, and similarity is the weighted Jaccard similarity.
    """
    found = NearClasses(docs, id_col, text_col, words, link, coordinates, bands, band_rows, slack, rounds, weighted).classes()
    return found.select(F.col("id").alias(id_col), "class_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each class one row of its smallest id stays."""
    settings = {"words": WORDS, "link": LINK, "coordinates": COORDINATES, "bands": BANDS, "band_rows": BAND_ROWS, "slack": SLACK, "rounds": ROUNDS, "weighted": False} | options
    found = NearClasses(docs, id_col, text_col, **settings).classes()
    stays = found.filter(F.col("id").eqNullSafe(F.col("class_id"))).groupBy("comp", "class_id").agg(F.min("key").alias("key"))
    key = fresh(docs, "text_key")
    marked = docs.withColumn(key, _key(valid_text(text_col)))
    kept = marked.alias("d").join(stays.alias("s"), (F.col(f"d.{key}") == F.col("s.key")) & F.col(f"d.{id_col}").eqNullSafe(F.col("s.class_id"))).select("d.*")
    return kept.dropDuplicates([key, id_col]).drop(key)
