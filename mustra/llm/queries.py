"""The queries of the training-data operators, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mustra.llm import byte_bpe, chat, collisions, fim, line_dedup, merkle, mixing, near_dedup, quality, runs, token_count, url_filter, voronoi
from mustra.llm.common import read
from mustra.llm.sql import SQL


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.train(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality.CUTOFF).cast("int").alias("predicted"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_words(read(spark, sf_dir, "documents"))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi.top_k(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


#: A conversation that says what a template might say itself.
CONTROL_TURNS = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turn = lambda c, t, r, x: F.struct(F.lit(c).cast("long").alias("conv_id"), F.lit(t).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(x).alias("text"))
    control = spark.range(1).select(F.inline(F.array(*(turn(*x) for x in CONTROL_TURNS))))
    return chat.digest_windows(chat.format_windows(turns.unionByName(control)))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(read(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digest_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


RULES = [url_filter.rule("allow", "org/"), url_filter.rule("block", "example.org/es/"), url_filter.rule("block", "example.org/en/1"), url_filter.rule("allow", "com/fr/"), url_filter.rule("block", "com/de/")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.neighbour_likeness(read(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.clean(docs, counts=True).select("doc_id", "n_lines", "n_dropped", "text")


def op11_collision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collisions.nearest(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


def periodic(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Every tenth text, as a hash of its id says, repeats a stretch of words from some word on; a null id counts as an empty one."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest_runs(runs.find_runs(read(spark, sf_dir, "documents"), change=periodic))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform_documents(read(spark, sf_dir, "documents"))
    back = fim.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of ``op3_mixing``: sizes and targets."""
    return op3_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of ``op9_fingerprints``: order and edited texts, and that equal texts have equal fingerprints."""
    rows = op9_fingerprints(spark, sf_dir)
    return rows.select("doc_id", "n_chars", "edited_sha256", (F.col("fingerprint") == F.col("edited_fingerprint")).alias("same"))


__all__ = ["QUERIES", "SQL"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality, op2_token_counts, op3_mixing, op4_top_k, op5_chat_format, op6_near_dedup, op7_byte_bpe, op8_url_filter, op9_fingerprints, op10_line_dedup, op11_collision_search, op12_periodic_runs, op13_fim, mixing_targets, edited_texts)}
