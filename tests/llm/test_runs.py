import random
import zlib
from hashlib import sha256

import numpy as np
import pytest

from mustra.llm import queries, runs


def brute(words, exponent=4, least=6):
    """All stretches that can't be extended, by each period in turn."""
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            end = i
            while end + q < n and words[end] == words[end + q]:
                end += 1
            if end + q - i >= max(least, exponent * q):
                found.setdefault((i, end + q - i), q)
            i = end
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def some_words(rng):
    """Words with runs in runs, neighbours that extend them, and others."""
    out = []
    for _ in range(rng.randrange(1, 6)):
        part = [rng.choice("abc") for _ in range(rng.randrange(1, 7))]
        out += part * rng.randrange(1, 8) + part[: rng.randrange(len(part) + 1)]
        out += [rng.choice("abcdefgh") for _ in range(rng.randrange(4))]
    return out * rng.choice([1, 1, 4])


def got(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words int")
    return sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in runs.find_runs(docs, **options).collect()), key=repr)


def expected(rows):
    words = [(i, (t or "").split()) for i, t, *_ in rows]
    return sorted(((i, len(w), b := brute(w), brute_collapsed(w, b)) for i, w in words), key=repr)


@pytest.mark.parametrize("batch_words", [1, 200, runs.BATCH_WORDS])
def test_runs_equal_brute_force(spark, batch_words):
    rng = random.Random(batch_words)
    rows = [(i, " ".join(some_words(rng)), "x", 3) for i in range(150)]
    assert got(spark, rows, batch_words=batch_words) == expected(rows)


def test_hard_rows(spark):
    texts = [None, "", " \t", "a", "a a a a a", "a a a a a a", "b " + "a " * 7 + "a\nc", "a b " * 4, "a b " * 3 + "a b a", "a\u2003" * 8, "long " * 40_000, "x y z " * 10_000 + "x y"]
    rows = [(i, t, "x", 3) for i, t in enumerate(texts)] + [(None, "a a a a a a", "x", 3)] * 2
    out = {i: (n, found) for i, n, found, _ in got(spark, rows)}
    assert out[0] == out[1] == out[2] == (0, []) and out[4] == (5, []) and out[5] == (6, [(0, 6, 1)]) and out[6] == (10, [(1, 8, 1)])
    assert out[7] == (8, [(0, 8, 2)]) and out[8] == (9, [(0, 9, 2)]) and out[9] == (1, [])  # one word, as only ASCII white space parts words
    assert out[10] == (40_000, [(0, 40_000, 1)]) and out[11] == (30_002, [(0, 30_002, 3)]) and out[None] == (6, [(0, 6, 1)])
    assert got(spark, []) == []


def test_bytes_that_are_not_utf8_are_replaced(spark):
    docs = spark.sql("SELECT 4L AS doc_id, CAST(X'61FF20FF' AS STRING) AS text")
    assert runs.find_runs(docs).first().collapsed == "a� �"


def test_suffixes_equal_sorted_ones():
    rng = random.Random(2)
    for _ in range(60):
        text = np.array([rng.randrange(3) for _ in range(rng.randrange(1, 90))] + [9])
        suffixes, places = runs.Suffixes(text), sorted(range(len(text)), key=lambda i: text[i:].tolist())
        assert np.argsort(suffixes.rank).tolist() == places
        a, b = np.array([(i, j) for i in range(len(text)) for j in range(len(text)) if i != j]).T
        common = [next(k for k in range(len(text)) if max(i, j) + k >= len(text) or text[i + k] != text[j + k]) for i, j in zip(a, b, strict=True)]
        assert suffixes.extension(a, b).tolist() == common


def test_range_minima():
    rng = np.random.default_rng(1)
    for n in (1, 15, 16, 17, 32, 300, 1000):
        values = rng.integers(0, 1000, n)
        a, b = np.sort(rng.integers(0, n, (2, 500)), axis=0)
        assert runs.RangeMinimum(values)(a, b).tolist() == [values[x : y + 1].min() for x, y in zip(a, b, strict=True)]


def test_query_equals_brute_force(spark, sf_dir):
    """Each text changed by its id as the contract words it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want, with_runs = [], 0
    for r in docs:
        words = (r.text or "").encode().split()
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        words = [w.decode() for w in words]
        found = brute(words)
        best = max(found, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
        want.append((r.doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha256(lines.encode()).hexdigest(), sha256(brute_collapsed(words, found).encode()).hexdigest()))
        with_runs += bool(found)
    out = queries.op12_periodic_runs(spark, sf_dir)
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, out.collect())) == sorted(want) and with_runs > 5
