import random
import time
import tracemalloc
from fractions import Fraction

from mustra.llm import mixing, queries


def test_targets_share_all_and_stop():
    sizes = {"b": 100, "a": 10, None: 50, "c": 1000}
    out = mixing.targets(sizes)
    assert sum(out.values()) == Fraction(3, 2) * 1160 and all(t <= 2 * sizes[s] for s, t in out.items())
    assert out["a"] == 20 and mixing.targets({}) == {}
    assert mixing.targets({"a": 0}) == {"a": 0}


def test_fit_meets_reachable_budgets():
    rng = random.Random(2)
    for _ in range(60):
        counts = {rng.randrange(1, 40): rng.randrange(1, 6) for _ in range(rng.randrange(1, 8))}
        budget = rng.randrange(0, 1 + sum(x * n for x, n in counts.items()))
        take = mixing.fit(counts, budget)
        assert all(0 <= take.get(x, 0) <= n for x, n in counts.items())
        reach = {0}
        for x, n in counts.items():
            reach = {r + x * i for r in reach for i in range(n + 1)}
        assert abs(sum(x * k for x, k in take.items()) - budget) == min(abs(r - budget) for r in reach)
    assert mixing.fit({7: 100, 3: 100}, 500) and sum(x * k for x, k in mixing.fit({7: 100, 3: 100}, 500).items()) == 500


def test_fit_of_long_documents():
    words = lambda lengths, budget: sum(x * n for x, n in mixing.fit(dict.fromkeys(lengths, 1), budget).items())
    assert words([100000, 80000, 70000], 150000) == 150000
    assert words([200000, 190000, 150000], 340000) == 340000
    rng = random.Random(4)
    for _ in range(20):
        lengths = {rng.randrange(1000, 400000) for _ in range(8)}
        budget, reach = rng.randrange(sum(lengths)), {0}
        for x in lengths:
            reach |= {r + x for r in reach}
        assert abs(words(lengths, budget) - budget) == min(abs(r - budget) for r in reach)


def test_a_long_document_that_breaks_the_divisor_costs_little():
    for n, odd in ((501, 2_000_001), (1001, 6_000_001), (2000, 50_000_001)):
        counts = {2 * (i + 10): 1000 for i in range(n - 1)} | {odd: 1}
        total = sum(x * k for x, k in counts.items())
        for budget in (total // 3 | 1, total // 3 & ~1, total * 7 // 10 | 1):
            tracemalloc.start()
            begun = time.perf_counter()
            take = mixing.fit(counts, budget)
            took, peak = time.perf_counter() - begun, tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
            assert sum(x * k for x, k in take.items()) == budget and all(0 <= k <= counts[x] for x, k in take.items())
            assert took < 5 and peak < 100e6


def test_memory_is_bounded_where_only_long_documents_are_left():
    counts = {1_000_000 + 1009 * i: 2 for i in range(200)} | {7_000_003: 1, 30: 1}
    tracemalloc.start()
    take = mixing.fit(counts, 123_456_789)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500e6 and abs(sum(x * k for x, k in take.items()) - 123_456_789) < 5000


def test_documents(spark, sf_dir):
    import re

    docs = {r.doc_id: (r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op3_mixing(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    taken, target, size = {}, {}, {}
    for r in rows:
        words = len(re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id][0] or ""))
        source = docs[r.doc_id][1]
        assert r.size == words and r.taken in (0, words, 2 * words)
        taken[source] = taken.get(source, 0) + r.taken
        size[source] = size.get(source, 0) + words
        target[source] = r.target
    assert {s: r for s, r in target.items()} == {s: float(t) for s, t in mixing.targets(size).items()}
    for source, want in target.items():
        reach, repeats = 1, int(want // max(1, size[source]))
        for r in rows:
            if docs[r.doc_id][1] == source:
                reach |= reach << r.size
        sums = [i for i in range(reach.bit_length()) if reach >> i & 1]
        best = min(abs(repeats * size[source] + i - want) for i in sums)
        assert abs(taken[source] - want) <= best + 1
    assert sorted(map(tuple, rows)) == sorted(map(tuple, queries.op3_mixing(spark, sf_dir).collect()))


def test_hot_length_is_dealt_to_buckets(spark):
    docs = spark.range(700).selectExpr("id AS doc_id", "'a b c' AS text", "if(id % 10 = 0, 'y', 'x') AS source")
    rows = mixing.mix_words(docs, bucket_rows=16).collect()
    for source_size in {r.source_size for r in rows}:
        own = [r for r in rows if r.source_size == source_size]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 3


def test_hard_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 1), (1, "a b", "s", 1), (1, "a b", "s", 1), (2, None, None, 2), (None, "x", None, 3), (4, " \t", "s", 4)], "doc_id long, text string, source string, source_key int")
    rows = mixing.mix_words(docs).collect()
    assert len(rows) == 6 and sum(r["size"] for r in rows) == 7
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert sum(len((r.text or "").split()) for r in mixed.collect()) == sum(r.taken for r in rows)
    assert mixing.mix_words(docs.limit(0)).count() == mixing.mix(docs.limit(0)).count() == 0


def test_very_long_texts(spark):
    rows = [(i, "w " * n, "s") for i, n in enumerate((400_001, 300_000, 200_002, 5, 5, 5, 3))] + [(9, "x" * 500_000, "s"), (10, " " * 500_000, "s")]
    out = {r.doc_id: r for r in mixing.mix_words(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert [out[i].size for i in (0, 1, 2, 9, 10)] == [400_001, 300_000, 200_002, 1, 0]
    sizes, reach = [r.size for r in out.values()], {0}
    for n in sizes:
        reach |= {r + n for r in reach}
    taken, want = sum(r.taken for r in out.values()), out[0].target
    assert abs(taken - want) == min(abs(sum(sizes) + r - want) for r in reach)
