import random
import re
from collections import Counter, defaultdict

import numpy as np

from mustra.llm import near_dedup, queries


def shingles(text):
    words = re.findall(r"\w+", (text or "").lower())
    n = min(5, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else frozenset()


def brute(rows):
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [shingles(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (rows[i][1] or "") == (rows[j][1] or "") or both and 5 * both >= 4 * len(sets[i] | sets[j]):
                parent[top(i)] = top(j)
    held = defaultdict(list)
    for i in range(len(rows)):
        held[top(i)].append(rows[i][0])
    smallest = {t: min((x for x in ids if x is not None), default=None) for t, ids in held.items()}
    return sorted(((rows[i][0], smallest[top(i)]) for i in range(len(rows))), key=repr)


def got(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert got(queries.op6_near_dedup(spark, sf_dir)) == brute(rows)


def chains():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = []
    for g in range(3):  # each a chain: neighbours are alike, the ends are not
        text = [word() for _ in range(120)]
        for k in range(14):
            rows.append((100 * g + 50 - 3 * k, " ".join(text)))
            for _ in range(2):
                text[rng.randrange(len(text))] = word()
    return rows


def test_chains_of_near_copies_and_hard_rows(spark):
    rows = chains() + [(900, None), (901, ""), (902, "!!!"), (903, "..."), (904, "One two"), (905, "one, TWO"), (905, "one, TWO"), (None, "one two."), (None, "alone here"), (906, "a b c d e"), (907, "a b c d e f")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, class_id int")
    assert got(near_dedup.near_classes(docs)) == brute(rows)
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for _, c in brute(rows) if c is not None})
    assert ids.count(None) == 1  # the one that is alone; the other belongs to a class with ids


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.near_classes(docs).count() == near_dedup.keep_one(docs).count() == 0


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    a = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
    w = rng.integers(1, 4, len(a)).astype(float)
    v = np.where(rng.random(len(a)) < 0.5, w, w / 2)
    one, two = near_dedup.dart_signatures([a, a], [w, v], coordinates=2048)
    assert abs((one == two).mean() - np.minimum(w, v).sum() / np.maximum(w, v).sum()) < 0.05
    sets = [a[:300], a[100:], a[:1], a[:0]]
    out = near_dedup.dart_signatures(sets, coordinates=2048)
    assert abs((out[0] == out[1]).mean() - 200 / 400) < 0.05 and not out[3].any()
    assert (near_dedup.dart_signatures([a[:300]], coordinates=2048)[0] == out[0]).all()


def brute_weighted(rows):
    """Classes by the weighted Jaccard similarity of runs counted as often as they occur."""
    bags = []
    for _, text in rows:
        words = re.findall(r"\w+", (text or "").lower())
        n = min(5, len(words))
        bags.append(Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else Counter())
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both, either = sum((bags[i] & bags[j]).values()), sum((bags[i] | bags[j]).values())
            if (rows[i][1] or "") == (rows[j][1] or "") or both and 5 * both >= 4 * either:
                parent[max(top(i), top(j))] = min(top(i), top(j))
    held = defaultdict(list)
    for i in range(len(rows)):
        held[top(i)].append(rows[i][0])
    return sorted(((rows[i][0], min(held[top(i)])) for i in range(len(rows))), key=repr)


def test_weighted_classes_equal_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for g in range(12):  # a line again and again: as sets these are alike, weighted they are not where it is there more often
        line, text = (" ".join(rng.choice("abcdefghij") * 3 + str(rng.randrange(99)) for _ in range(n)) for n in (9, 60))
        rows += [(10 * g + k, text + " " + " ".join([line] * times)) for k, times in enumerate((3, 4, 12, 13, 40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(near_dedup.near_classes(docs, weighted=True)) == brute_weighted(rows)
    assert got(near_dedup.near_classes(docs)) == brute(rows) and brute(rows) != brute_weighted(rows)


def test_very_long_texts(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(5000)}" for _ in range(120_000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:60_000], "other", *words[60_001:]])), (3, " ".join(words[:60_000])), (4, " ".join(words[::-1])), (5, "x" * 300_000), (6, "x" * 300_000)]
    assert got(near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string"))) == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 5)]
