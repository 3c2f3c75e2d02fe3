import hashlib
import random

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from mustra.llm import byte_bpe, queries

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = byte_bpe.load_ranks(PATH)
TINY = byte_bpe.TreeBpe(RANKS, public_tokenizers.PATTERN, leaf_chars=3, window_chars=1)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab1 2'st.,\n\t é中　́_#<|>rR!?？")), max_size=80) | st.text(max_size=60))
def test_tree_equals_flat(text):
    ids = TINY.encode(text)
    assert ids == TINY.flat.encode_ordinary(text) and TINY.decode(ids) == text.encode()


def test_long_runs():
    whole = byte_bpe.TreeBpe(RANKS, public_tokenizers.PATTERN, leaf_chars=1000)
    rng = random.Random(1)
    for text in ("a" * 30_000, " " * 9_000 + "x", "中文" * 9_000, "".join(rng.choice("ab 1.'") for _ in range(30_000))):
        ids = whole.encode(text)
        assert ids == whole.flat.encode_ordinary(text) and whole.decode(ids) == text.encode()
    normal = byte_bpe.TreeBpe(RANKS, public_tokenizers.PATTERN)
    for text in ("z" * 300_000, "ab" * 110_000, " " * 400_000 + "x", " " * 600_000 + "x", "中文字" * 75_000, " \n" * 120_000 + "x", "#!" * 130_000, "words and 12 more, " * 20_000):
        ids = normal.encode(text)
        assert ids == normal.flat.encode_ordinary(text) and normal.decode(ids) == text.encode()
    space = " " * 3_000_000 + "x"  # where the library's matcher fails
    ids = normal.encode(space)
    assert ids == normal.flat._encode_single_piece(space[:-2]) + normal.flat.encode_ordinary(" x") and normal.decode(ids) == space.encode()



def test_documents(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in queries.op7_byte_bpe(spark, sf_dir).collect():
        ids = TINY.flat.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids)).encode()), sha(texts[r.doc_id].encode()))


def test_hard_rows(spark):
    docs = spark.createDataFrame([(1, None, 3), (1, None, 3), (None, "<|endoftext|>", 4)], "doc_id long, text string, n_tokens int")
    assert sorted(r.n_tokens for r in byte_bpe.digest_documents(docs, PATH, public_tokenizers.PATTERN).collect())[:2] == [0, 0]
    coded = byte_bpe.decode_documents(byte_bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN)
    assert coded.columns == [*docs.columns, "ids"] and {r.text for r in coded.collect()} == {"", "<|endoftext|>"}
    assert byte_bpe.digest_documents(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_columns_of_an_empty_table_and_own_names(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, ids string")
    coded = byte_bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN, ids_col="token_ids")
    assert coded.columns == ["doc_id", "text", "ids", "token_ids"]
    assert byte_bpe.decode_documents(coded, PATH, public_tokenizers.PATTERN, ids_col="token_ids").count() == 0


def test_recoding_is_encoding_and_decoding(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "nullif(text, '') AS text", "map(lang, array(n_chars)) AS rest")
    both = byte_bpe.decode_documents(byte_bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN)
    for rows in (3, 256):
        once = byte_bpe.recode_documents(docs, PATH, public_tokenizers.PATTERN, rows=rows)
        assert once.columns == both.columns and sorted(map(str, once.collect())) == sorted(map(str, both.collect()))
    assert byte_bpe.recode_documents(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
