import re
import tracemalloc
from hashlib import sha256

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mustra.llm import fim, queries

UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
TEXTS = st.text(st.sampled_from("ab \t\n\x0b\x1c é\U0001f600<PSM>"), max_size=60)


def plainly(text, key):
    """By a list of all units."""
    units, h = re.findall(UNIT, text), sha256(f"42:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    out = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < 80 else f"<P>{p}<S>{s}<M>{m}"
    return len(units), "spm" if h4 % 100 < 80 else "psm", len(p), len(m), out


@settings(max_examples=400, deadline=None)
@given(TEXTS, st.integers(-5, 10**12))
def test_transform_equals_one_by_a_list_of_units(text, key):
    assert tuple(fim.transform(text, str(key))) == plainly(text, key)


def test_rows_go_there_and_back(spark):
    texts = [None, "", " ", "one", "a <P> b", "x<", "<S", "é b \U0001f600 c\td", "word " * 30_000 + "\n", " " * 50_000, "n" * 50_000]
    rows = [(i, texts[i % len(texts)], "kept", 1) for i in range(88)] + [(3, "one", "kept", 1)] * 2 + [(None, "nobody's text", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, n int")
    made = fim.transform_documents(docs, batch_bytes=1000)
    got = made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    expected = [(i, *plainly(t or "", "" if i is None else i), t or "") for i, t, *_ in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))
    assert {"plain", "psm", "spm"} == {r.form for r in got}
    assert fim.transform_documents(docs.limit(0)).count() == 0


def test_bytes_that_are_not_utf8_are_replaced(spark):
    docs = spark.sql("SELECT 4L AS doc_id, CAST(X'61FF62' AS STRING) AS text")
    made = fim.transform_documents(docs).select(fim.restored(F.col("output"), F.col("form")).alias("text")).first()
    assert made.text == "a�b"


def test_no_units_are_stored():
    text = "w " * 400_000
    tracemalloc.start()
    assert fim.count_units(text) == 400_001 and fim.ends(text, [0, 200_000, 400_001]) == [0, 399_999, 800_000]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20_000


def test_query_equals_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    got = queries.op13_fim(spark, sf_dir)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, con.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.SQL['op13_fim']})").fetchall()))
