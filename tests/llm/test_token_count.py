import public_tokenizers
from tokenizers import Tokenizer

from mustra.llm import queries, token_count

PATH = public_tokenizers.path("word_bpe_49k.json")
HARD = ["", " ", "it's  A.B. 12ab éÉ x\x1cy <|endoftext|>a <|startoftext|>", "é ́a", "a." * 40, "...  ,,, a,. b., Σσς. don't.", "x" * 5000, "中文，字。", " end", "İstanbul. ǅ,"]


LIBRARY = Tokenizer.from_file(PATH)


def exact(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


def test_hard_texts_by_any_window():
    expected = [exact(t) for t in HARD]
    for window, batch, memo in ((1, 1, 1), (7, 20, 3), (1 << 20, 1 << 18, 1000)):
        counter = token_count.PieceCounter(Tokenizer.from_file(PATH), window, batch, memo)
        assert counter.count_all([t.encode() for t in HARD]) == expected


def test_texts_without_white_space_are_cut_at_marks():
    texts = ["我们在这里写一些字，然后再写。한국어도씁니다！かな、カナ。" * 40, "one,two.three;four:five!six?" * 40, "'s,x's.'ll,it'll。don't！" * 20, "ế,é́.字́,가́。" * 20, "字" * 3000]
    expected = [exact(t) for t in texts]
    for window in (1, 50, 1000):
        counter = token_count.PieceCounter(Tokenizer.from_file(PATH), window, 1 << 18, 1000)
        assert counter.count_all([t.encode() for t in texts]) == expected
        for t in texts[:2]:
            windows = list(counter._windows(t.encode()))
            assert b"".join(windows) == t.encode() and max(map(len, windows)) < window + 60


def test_documents_as_the_library_counts_them(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op2_token_counts(spark, sf_dir).collect():
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), exact(docs[r.doc_id]), exact(docs[r.doc_id]) > 2048)


def test_hard_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (1, None, 5), (None, "a b", 6)], "doc_id long, text string, n_tokens int")
    assert sorted(map(repr, map(tuple, token_count.count_tokens(docs, PATH).collect()))) == sorted(map(repr, [(1, 0, 0, False), (1, 0, 0, False), (None, 3, 2, False)]))
    assert token_count.count_tokens(docs.limit(0), PATH).count() == 0
