"""Bitmap forms of sets: fixed blocks of 32,768 ids, for exact counts that combine without the ids.

A bitmap set is a table (bucket, bitmap). All is done by the JVM: ``and`` and ``or`` are aggregates, a block's complement is
read off its hexadecimal digits, and ids come out of the bytes that aren't zero.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 4096
BLOCK_IDS = 8 * BLOCK_BYTES
#: A part of a block: so many words of 64 ids.
WORDS = tuple(f"w{i}" for i in range(16))
PART_IDS = 64 * len(WORDS)
PARTS = BLOCK_IDS // PART_IDS


def part_of(person: Column) -> tuple[Column, Column]:
    """The bucket and the part that a person's bit is in."""
    place = person + 1
    return F.bitmap_bucket_number(place), F.shiftright(F.bitmap_bit_position(place), 10).cast("int")


def to_parts(facts: DataFrame, *keys: str, scattered: bool = False) -> DataFrame:
    """keys, bucket, part, w0 to w15: the ids of a block's 32 parts as bits of long words.

    Words are added to by hash aggregates, so facts needn't be sorted for it; a binary block would sort every fact of a task.
    Ids are moved by one, as the built-in blocks begin with 1. ``scattered``: few facts of a part lie together, so they are
    shuffled as they are, not combined before.
    """
    at = F.bitmap_bit_position(F.col("person_id") + 1)
    bucket, part = part_of(F.col("person_id"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), _place_in_word(at))
    placed = facts.select(*keys, bucket.alias("bucket"), part.alias("part"), F.shiftright(at, 6).bitwiseAND(15).cast("int").alias("word"), bit.alias("bit"))
    if scattered:
        placed = placed.repartition(*keys, "bucket", "part")
    words = (F.bit_or(F.when(F.col("word") == i, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(w) for i, w in enumerate(WORDS))
    return placed.groupBy(*keys, "bucket", "part").agg(*words)


def _place_in_word(at: Column) -> Column:
    """How far left the bit of a place is in its word, whose digits are to give a block's bytes in order."""
    return (56 - at.bitwiseAND(56) + at.bitwiseAND(7)).cast("int")


def blocks_of_parts(parts: DataFrame, *keys: str) -> DataFrame:
    """keys, bucket, bitmap."""
    zeros = "0" * 16
    digits = F.concat(*(F.when(F.col(w) == 0, zeros).otherwise(F.lpad(F.hex(w), 16, "0")) for w in WORDS))
    dealt = parts.select(*keys, "bucket", F.coalesce("part", F.lit(0)).alias("part"), F.unhex(digits).alias("bytes")).repartition(*keys, "bucket")
    met = dealt.groupBy(*keys, "bucket").agg(F.map_from_entries(F.collect_list(F.struct("part", "bytes"))).alias("parts"))
    none = F.lit(bytes(PART_IDS // 8))
    return met.select(*keys, "bucket", F.concat(*(F.coalesce(F.element_at("parts", i), none) for i in range(PARTS))).alias("bitmap"))


def to_bitmaps(facts: DataFrame, *keys: str) -> DataFrame:
    """keys, bucket, bitmap."""
    return blocks_of_parts(to_parts(facts, *keys), *keys)


def fact_blocks(parts: DataFrame) -> DataFrame:
    """attr, value, yyyymm, bucket, bitmap of facts' parts by attr, value and yyyymm: a block for each value and month, and one with a
    null month over all facts of the value, which the months' blocks are united for."""
    by_month = blocks_of_parts(parts, "attr", "value", "yyyymm")
    places = F.array_compact(F.array(F.lit(-1), F.col("yyyymm")))
    dealt = by_month.select("attr", "value", F.explode(places).alias("month"), "bucket", "bitmap")
    united = dealt.groupBy("attr", "value", "month", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    return united.select("attr", "value", F.nullif(F.col("month"), F.lit(-1)).alias("yyyymm"), "bucket", "bitmap")


def count_parts() -> Column:
    """An aggregate: how many ids parts hold."""
    return F.coalesce(F.sum(reduce(add, (F.bit_count(w) for w in WORDS))), F.lit(0))


def ids_of_parts(parts: DataFrame, *keys: str) -> DataFrame:
    """keys, person_id of every bit, in the order of the parts and of the places in them."""
    eight = F.array(*map(F.lit, range(8)))
    words = parts.select(*keys, "bucket", "part", F.posexplode(F.array(*WORDS)).alias("word", "bits")).filter("bits != 0")
    digits = words.select(*keys, "bucket", "part", "word", "bits", F.explode(eight).alias("byte")).filter("shiftright(bits, 56 - 8 * byte) & 255 != 0")
    set_ = digits.select("*", F.explode(eight).alias("bit")).filter("shiftright(bits, 56 - 8 * byte + bit) & 1 = 1")
    return set_.select(*keys, _id_at(F.col("bucket"), F.col("part") * PART_IDS + F.col("word") * 64 + F.col("byte") * 8 + F.col("bit")).alias("person_id"))


def _id_at(bucket: Column, bit: Column) -> Column:
    # buckets up to 0 hold places up to 0, counted backwards
    return F.when(bucket > 0, (bucket - 1) * BLOCK_IDS + bit).otherwise(bucket * BLOCK_IDS - bit - 1).cast("long")


def merged(blocks: DataFrame, *keys: str) -> DataFrame:
    """One block a bucket and key, of blocks that came at different times."""
    return blocks.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def whole(blocks: DataFrame) -> DataFrame:
    """attr, value, bucket, bitmap over all facts of each value."""
    return merged(blocks.filter(F.col("yyyymm").isNull()), "attr", "value")


def count_bitmaps(bitmaps: DataFrame, *keys: str) -> DataFrame:
    return bitmaps.groupBy(*keys).agg(F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0)).alias("count"))


def or_bitmaps(*sets: DataFrame) -> DataFrame:
    both = sets[0].select("bucket", "bitmap")
    for s in sets[1:]:
        both = both.unionByName(s.select("bucket", "bitmap"))
    return both.groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def and_bitmaps(*sets: DataFrame) -> DataFrame:
    """Buckets that some set lacks are empty."""
    both = sets[0].select("bucket", "bitmap", F.lit(0).alias("of"))
    for i, s in enumerate(sets[1:], 1):
        both = both.unionByName(s.select("bucket", "bitmap", F.lit(i).alias("of")))
    met = both.groupBy("bucket").agg(F.bitmap_and_agg("bitmap").alias("bitmap"), F.countDistinct("of").alias("sets"))
    return met.filter(F.col("sets") == len(sets)).select("bucket", "bitmap")


def complement(bitmap: Column) -> Column:
    """The ids of a block that it lacks; Spark has no such function, so its digits are exchanged."""
    return F.unhex(F.translate(F.hex(bitmap), "0123456789ABCDEF", "FEDCBA9876543210"))


def subtract_bitmaps(left: DataFrame, right: DataFrame) -> DataFrame:
    """The ids of ``left`` that ``right`` lacks; both hold a bucket once."""
    both = left.select("bucket", "bitmap", F.lit(True).alias("own")).unionByName(right.select("bucket", complement(F.col("bitmap")).alias("bitmap"), F.lit(False).alias("own")))
    return both.groupBy("bucket").agg(F.bitmap_and_agg("bitmap").alias("bitmap"), F.bool_or("own").alias("own")).filter("own").select("bucket", "bitmap")


def ids_of(bitmaps: DataFrame) -> DataFrame:
    """person_id of every bit."""
    one = lambda i: F.substring(F.col("bitmap"), i + 1, F.lit(1))
    used = F.filter(F.sequence(F.lit(0), F.lit(BLOCK_BYTES - 1)), lambda i: one(i) != F.lit(b"\0"))
    bytes_ = F.transform(used, lambda i: F.struct(i.alias("at"), F.conv(F.hex(one(i)), 16, 10).cast("int").alias("bits")))
    spread = bitmaps.select("bucket", F.explode(bytes_).alias("byte"))
    set_ = F.expr("filter(array(0, 1, 2, 3, 4, 5, 6, 7), b -> shiftright(byte.bits, b) & 1 = 1)")
    placed = spread.select("bucket", F.explode(set_).alias("bit"), F.col("byte.at").alias("at"))
    bit = F.col("at") * 8 + F.col("bit")
    return placed.select(_id_at(F.col("bucket"), bit).alias("person_id"))


def profile(blocks: DataFrame, cohort: DataFrame) -> DataFrame:
    """attr, value, count: how many of a bitmap set hold each value that ``blocks`` (over all facts, once a bucket) have; none for zero."""
    met = blocks.join(cohort.select("bucket", F.col("bitmap").alias("cohort")), "bucket")
    pairs = met.select("attr", "value", "bucket", F.explode(F.array("bitmap", "cohort")).alias("bitmap"))
    both = pairs.groupBy("attr", "value", "bucket").agg(F.bitmap_and_agg("bitmap").alias("bitmap"))
    return count_bitmaps(both, "attr", "value").filter("count > 0")


def clauses(blocks: DataFrame, all_of: Sequence[Column], none_of: Sequence[Column] = (), counted: Mapping[int, Column] = {}) -> DataFrame:  # noqa: B006
    """bucket, bitmap: the ids that some block of each predicate in ``all_of`` holds and none of ``none_of``.

    The blocks wanted are united per clause and bucket before they are shuffled; the clauses of a bucket then meet in one row.
    ``counted``: by the place of a clause of ``all_of``, a scalar that says whether it is asked for at all.
    """
    flags = [*all_of, *none_of]
    united = blocks.filter(reduce(or_, flags)).groupBy("bucket").agg(*(F.bitmap_or_agg(F.when(f, F.col("bitmap"))).alias(f"c{i}") for i, f in enumerate(flags)))
    sets = [F.col(f"c{i}") if i < len(all_of) else complement(F.col(f"c{i}")) for i in range(len(flags))]
    sets = [F.when(counted[i], s) if i in counted else s for i, s in enumerate(sets)]
    met = united.select("bucket", F.explode(F.array(*sets)).alias("bitmap")).filter(F.col("bitmap").isNotNull())
    return met.groupBy("bucket").agg(F.bitmap_and_agg("bitmap").alias("bitmap")).filter(F.bitmap_count("bitmap") > 0)
