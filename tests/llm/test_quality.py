import math
import zlib

import numpy as np

from mustra.llm import queries, quality


def test_trees_find_a_rule_and_flat_walk_equals_a_plain_walk():
    rng = np.random.default_rng(1)
    x = rng.random((600, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    trees = quality.grow(x, y, trees=20, depth=3)
    assert ((trees.score(x) > 0.5) == y).mean() > 0.97

    def plain(row):
        total = trees.base
        for t in range(len(trees.feature)):
            node = 0
            while node < trees.feature.shape[1]:
                node = 2 * node + 1 + int(row[trees.feature[t, node]] > trees.cut[t, node])
            total += trees.leaf[t, node - trees.feature.shape[1]]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(trees.score(x[:50]), [plain(r) for r in x[:50]])


def plain_boosting(x, y, trees, depth, bins, rate):
    """Scores of the rows from trees that try every cut of every statistic on the rows of a node, one after the other."""
    share = (sum(y) + 0.5) / (len(y) + 1)
    raw = [math.log(share / (1 - share))] * len(y)
    cuts = [sorted(set(np.quantile([r[j] for r in x], [i / bins for i in range(1, bins)]).tolist())) for j in range(len(x[0]))]

    def worth(rows, p):
        return sum(p[i] - y[i] for i in rows), sum(p[i] * (1 - p[i]) for i in rows)

    def split(rows, p, levels):
        best, sides = 1e-6, None
        g, h = worth(rows, p)
        for j, cut in ((j, cut) for j in range(len(cuts)) for cut in cuts[j]):
            left, right = [i for i in rows if x[i][j] <= cut], [i for i in rows if x[i][j] > cut]
            (gl, hl), (gr, hr) = worth(left, p), worth(right, p)
            gain = gl**2 / (hl + quality.RIDGE) + gr**2 / (hr + quality.RIDGE) - g**2 / (h + quality.RIDGE)
            if hl >= quality.LEAST_HESSIAN and hr >= quality.LEAST_HESSIAN and gain > best + 1e-9:
                best, sides = gain, (left, right)
        if levels and sides:
            return [leaf for side in sides for leaf in split(side, p, levels - 1)]
        return [(rows, -rate * g / (h + quality.RIDGE))]

    for _ in range(trees):
        p = [1 / (1 + math.exp(-r)) for r in raw]
        for rows, value in split(list(range(len(y))), p, depth):
            for i in rows:
                raw[i] += value
    return [1 / (1 + math.exp(-r)) for r in raw]


def test_growth_equals_a_plain_search_of_cuts():
    rng = np.random.default_rng(4)
    x = rng.random((120, 3))
    y = ((x[:, 0] + 0.3 * rng.random(120) > 0.6) & (x[:, 1] > 0.2)).astype(float)
    expected = plain_boosting(x.tolist(), y.tolist(), 4, 2, 12, 0.3)
    assert np.allclose(quality.grow(x, y, trees=4, depth=2, bins=12, rate=0.3).score(x), expected)


def plain_word_statistics(text):
    words = text.split()
    n, runs = max(1, len(words)), sum(a == b for a, b in zip(words, words[1:], strict=False))
    shares = {"distinct_words": len(set(words)) / n, "commonest_word": max((words.count(w) for w in set(words)), default=0) / n}
    shares |= {"repeated_next": runs / n, "word_length": sum(map(len, words)) / n, "log_words": math.log1p(len(words))}
    return shares | {"short_words": sum(len(w) < 4 for w in words) / n, "capital_words": sum(w[0].isupper() for w in words) / n}


def test_word_statistics_equal_plain_ones():
    for text in ("one", "a a b A  a\tb\nb b", "Über Straße 12 12", " "):
        got = dict(zip(quality.FEATURES, quality.describe(text).tolist(), strict=True))
        assert all(abs(got[name] - value) < 1e-12 for name, value in plain_word_statistics(text).items())


def test_one_kind_of_label_or_none():
    assert quality.grow(np.zeros((0, 2)), np.zeros(0)).score(np.zeros((2, 2))).tolist() == [0.5, 0.5]
    assert quality.grow(np.zeros((3, 2)), np.ones(3)).score(np.zeros((1, 2)))[0] > 0.8


def test_windows_of_long_texts():
    text = "ab cd ef " * 300_000
    assert quality.describe(text).shape == (len(quality.FEATURES),)
    assert quality.describe("").tolist() == [0.0] * len(quality.FEATURES)


def test_statistics_of_long_texts_are_those_of_the_whole(monkeypatch):
    text = "same same Other words x\n" * 60_000
    assert len(text) > quality.WINDOW_CHARS
    long = quality.describe(text)
    at = quality.FEATURES.index("distinct_words")
    assert long[at] == 4 / 300_000
    monkeypatch.setattr(quality, "WINDOW_CHARS", len(text))
    assert long.tolist() == quality.describe(text).tolist()


def test_held_out_rows_are_predicted(spark, sf_dir):
    rows = {r.doc_id: r for r in queries.op1_quality(spark, "/root/testdata/sf0.01").collect()}
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [(rows[i].predicted, q) for i, q in labels.items() if rows[i].held_out]
    assert sum(p == q for p, q in held) / len(held) > 0.95


def test_hard_cases(spark):
    docs = spark.createDataFrame([(1, "One good line here.", 1), (1, "One good line here.", 1), (2, None, 0), (None, "", 2), (3, "BUY!! " * 50, 3)], "doc_id long, text string, score long")
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (None, 1), (2, None), (2, 7)], "doc_id long, quality int")
    trees = quality.train(docs, labels)
    kept = quality.keep_good(docs, trees, cutoff=0.0)
    assert kept.columns == docs.columns and kept.count() == 5
    assert quality.train(docs.limit(0), labels.limit(0)).score(np.zeros((1, len(quality.FEATURES))))[0] == 0.5
    assert quality.score(docs.limit(0), trees).count() == 0
