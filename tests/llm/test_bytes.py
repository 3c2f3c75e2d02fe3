"""Texts with bytes that are not UTF-8 count as such with U+FFFD in their place."""

import public_tokenizers
import pytest

from mustra.llm import byte_bpe, line_dedup, merkle, mixing, near_dedup, quality, token_count

BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = ["good words in a row that are long enough to be compared with others", "a \\xff b\\n\\xc3( the rest of it is as long as that of the first one", "\\xe2\\x82", "\\x80\\x80 x"]


@pytest.fixture(scope="module")
def both(spark):
    """The texts as bytes, and with the replacement made."""
    raw = [t.encode().decode("unicode_escape").encode("latin-1") for t in TEXTS]
    rows = [(i, b, "s") for i, b in enumerate(raw)]
    frame = spark.createDataFrame(rows, "doc_id long, bytes binary, source string")
    broken = frame.selectExpr("doc_id", "CAST(bytes AS STRING) AS text", "source")
    whole = spark.createDataFrame([(i, b.decode("utf-8", "replace"), "s") for i, b, _ in rows], "doc_id long, text string, source string")
    return broken, whole


@pytest.mark.parametrize("of", [
    lambda d: quality.score(d, quality.train(d, d.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS quality"))).select("doc_id", "score"),
    lambda d: token_count.count_tokens(d, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "n_tokens"),
    lambda d: near_dedup.near_classes(d),
    lambda d: byte_bpe.digest_documents(d, BPE, public_tokenizers.PATTERN),
    lambda d: merkle.neighbour_likeness(d),
    lambda d: mixing.mix_words(d),
    lambda d: line_dedup.clean(d.select("doc_id", "text"), counts=True).select("doc_id", "n_lines"),
])
def test_broken_bytes(both, of):
    broken, whole = (sorted(map(tuple, of(d).collect())) for d in both)
    assert broken == whole and len(broken) == len(TEXTS)
