"""Fact tables: building them, writing them as an index, reading it again.

Facts are one long table (person_id, attr, value, yyyymm); attributes have no month. They are unions of one projection
per attribute with a literal ``attr``, so a filter on ``attr`` removes whole branches and one on ``value`` reaches the scan.

An index is a log of snapshots. A snapshot names the folders that make it up and which attributes of each are its own::

    meta/number=7        version, folder (that of the persons), parts: (folder, attrs; null: all), sealed
    data-<id>/facts      attr=...: person_id, value, yyyymm, sorted by value
    data-<id>/blocks     attr=...: value, yyyymm, bucket, bitmap, sorted by value; a null month stands for all facts of a value
    data-<id>/vocabulary attr, value, n_persons: how many persons this folder adds to the value
    data-<id>/grams      attr=...: gram, value, sorted by gram: the short substrings of the vocabulary's values
    data-<id>/persons    person_id, person_guid

A save, an append and a compaction each write a folder of their own and then one snapshot, so what isn't written to the end
is never read, and a reader keeps what it has opened. Blocks are united and counts added, so both stay right under appends;
facts may repeat between folders until a compaction, which rewrites only attributes that several folders hold.

Facts are shuffled at most once on their way into a folder: they become parts of bitmaps by value and month (``parts``, gone when the
folder is done), which are their distinct set, and facts and blocks are both made of those. Where a row makes several facts, rows
are dealt instead (``deal_rows``), and only parts are shuffled behind that.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable, Mapping
from functools import reduce
from typing import NamedTuple
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from mustra.operators import bitmap, search
from mustra.sources.store import exists, folders, remove_folder

FORMAT_VERSION = 3
FACTS = "person_id long, attr string, value string, yyyymm int"
BLOCKS = "attr string, value string, yyyymm int, bucket long, bitmap binary"
WORDS = "attr string, value string, n_persons long"
PERSONS = "person_id long, person_guid string"
META = "version int, folder string, parts array<struct<folder: string, attrs: array<string>>>, sealed boolean, number long"
GRAMS = "attr string, gram string, value string"
LEASES = "number long, until double"
#: So many facts a task writes, about.
TASK_FACTS = 1_000_000


class IndexFormatError(ValueError):
    """A folder that is no index of this format."""


class IndexConflictError(RuntimeError):
    """Another writer has made a snapshot meanwhile; what was written is not part of the index."""


class Index(NamedTuple):
    """A snapshot as tables."""

    facts: DataFrame
    persons: DataFrame
    words: DataFrame
    blocks: DataFrame
    grams: DataFrame


def facts_of(rows: DataFrame, person: Column, attr: str, value: Column, month: Column | None = None) -> DataFrame:
    """One attribute's or event type's facts; rows without a person or a value make none."""
    out = rows.select(person.cast("long").alias("person_id"), F.lit(attr).alias("attr"), value.cast("string").alias("value"), (F.lit(None) if month is None else month).cast("int").alias("yyyymm"))
    return out.filter(F.col("person_id").isNotNull() & F.col("value").isNotNull())


def traits(rows: DataFrame, person: Column, columns: Mapping[str, Column]) -> DataFrame:
    """Timeless facts, several attributes of the same rows."""
    return union(facts_of(rows, person, attr, value) for attr, value in columns.items())


def deal_rows(rows: DataFrame) -> DataFrame:
    """Rows of persons and months (person_id, yyyymm), shuffled so that those of a month and a part of a block lie together.

    It is done before a row becomes several facts, so rows are shuffled, not facts; these are then combined where they lie
    (``save_index`` with ``scattered=False``). A month and part of very many rows is split, as dealing is a help, not a need.
    """
    bucket, part = bitmap.part_of(F.col("person_id"))
    return rows.withColumns({"dealt_bucket": bucket, "dealt_part": part}).hint("rebalance", "yyyymm", "dealt_bucket", "dealt_part").drop("dealt_bucket", "dealt_part")


def union(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def vocabulary(facts: DataFrame) -> DataFrame:
    """attr, value, n_persons."""
    return facts.groupBy("attr", "value").agg(F.countDistinct("person_id").alias("n_persons"))


def _snapshots(spark: SparkSession, path: str) -> list[Row]:
    """The newest first; an error of the store or of rights is not taken for a missing index."""
    if not exists(spark, f"{path}/meta"):
        raise IndexFormatError(f"{path}: no index")
    return spark.read.schema(META).parquet(f"{path}/meta").orderBy(F.col("number").desc_nulls_last()).collect()


def _current(spark: SparkSession, path: str) -> list[Row]:
    """The snapshots of an index that can be read."""
    found = _snapshots(spark, path)
    if not found or found[0].version != FORMAT_VERSION or not found[0].parts:
        raise IndexFormatError(f"{path}: version {found[0].version if found else None}, not {FORMAT_VERSION}")
    return found


def has_index(spark: SparkSession, path: str) -> bool:
    return exists(spark, f"{path}/meta")


def snapshot_number(spark: SparkSession, path: str) -> int:
    return _current(spark, path)[0].number


def _add_snapshot(spark: SparkSession, path: str, before: list[Row], folder: str, parts: list[tuple[str, list[str] | None]], sealed: bool) -> None:
    """One that follows ``before``; a number exists once, so of two writers one gets an error."""
    number = max((s.number or 0 for s in before), default=0) + 1
    row = spark.createDataFrame([(FORMAT_VERSION, folder, parts, sealed)], META.rpartition(",")[0])
    try:
        row.coalesce(1).write.mode("errorifexists").parquet(f"{path}/meta/number={number}")
    except AnalysisException as e:
        raise IndexConflictError(f"{path}: snapshot {number} is there already") from e


def _folders_of(snapshots: Iterable[Row]) -> set[str]:
    return {f for s in snapshots for f in [s.folder, *(p.folder for p in s.parts or [])] if f}


def _still_read(spark: SparkSession, path: str, found: list[Row]) -> set[str]:
    """Folders of the snapshots since the last but one seal, and of those under a lease."""
    kept = found[: next((i for i, s in enumerate(found) if s.sealed), len(found)) + 1]
    if exists(spark, f"{path}/leases"):
        leased = {r.number for r in spark.read.schema(LEASES).parquet(f"{path}/leases").filter(F.col("until") > time.time()).collect()}
        kept += [s for s in found if s.number in leased]
    return _folders_of(kept)


def lease(spark: SparkSession, path: str, seconds: float) -> int:
    """Keeps the newest snapshot's folders for so long, whatever is saved meanwhile; the snapshot's number."""
    number = snapshot_number(spark, path)
    spark.createDataFrame([(number, time.time() + seconds)], LEASES).coalesce(1).write.mode("append").parquet(f"{path}/leases")
    return number


def remove_orphans(spark: SparkSession, path: str, older_than: float = 86_400) -> list[str]:
    """Removes folders of no snapshot that nobody has written to for so many seconds: of broken saves and lost races."""
    known = _folders_of(_snapshots(spark, path))
    gone = [name for name, changed in folders(spark, path) if name.startswith("data-") and name not in known and changed / 1000 <= time.time() - older_than]
    for name in gone:
        remove_folder(spark, f"{path}/{name}")
    return gone


def _write_parts(facts: DataFrame, folder: str, scattered: bool) -> tuple[DataFrame, int]:
    """The distinct facts as parts of bitmaps, which are few against the facts, and how many facts they hold; read for facts and
    blocks, then removed."""
    parts, counted = bitmap.to_parts(facts, "attr", "value", "yyyymm", scattered=scattered), Observation()
    # words hardly repeat, so dictionaries of them are given up after they were made
    plain = {f"parquet.enable.dictionary#{w}": "false" for w in bitmap.WORDS}
    parts.observe(counted, bitmap.count_parts().alias("n")).write.options(**plain).parquet(f"{folder}/parts")
    return facts.sparkSession.read.schema(parts.schema).parquet(f"{folder}/parts"), counted.get["n"]


def _write_facts(parts: DataFrame, n_facts: int, folder: str) -> None:
    # range partitioning by value keeps a code's facts in few files and splits attributes of any size; parts are dealt, not facts,
    # and to a number of tasks that follows the facts, as a part may hold a thousand
    order = ["attr", "value", "yyyymm", "bucket", "part"]
    tasks = -(-n_facts // TASK_FACTS)
    dealt = parts.repartitionByRange(max(1, tasks), *order).sortWithinPartitions(*order)
    facts = bitmap.ids_of_parts(dealt, "attr", "value", "yyyymm").select("person_id", "attr", "value", "yyyymm")
    facts.sortWithinPartitions("attr", "value", "yyyymm").write.partitionBy("attr").parquet(f"{folder}/facts")


def _write_facts_and_blocks(facts: DataFrame, folder: str, scattered: bool = False) -> DataFrame:
    """Writes both and gives the blocks. ``scattered``: the facts lie in no order."""
    parts, n_facts = _write_parts(facts, folder, scattered)
    _write_facts(parts, n_facts, folder)
    blocks = _write_blocks(bitmap.fact_blocks(parts), folder)
    remove_folder(facts.sparkSession, f"{folder}/parts")
    return blocks


def _write_blocks(blocks: DataFrame, folder: str) -> DataFrame:
    dealt = blocks.repartitionByRange(F.col("attr"), F.col("value"), F.col("yyyymm"), F.col("bucket")).sortWithinPartitions("attr", "value", "yyyymm", "bucket")
    # mostly zeros where a value is rare, which compress to almost nothing
    dealt.write.partitionBy("attr").option("compression", "zstd").parquet(f"{folder}/blocks")
    return blocks.sparkSession.read.schema(BLOCKS).parquet(f"{folder}/blocks")


def _write_words(words: DataFrame, folder: str) -> None:
    words.write.parquet(f"{folder}/vocabulary")
    found = search.grams(words.sparkSession.read.schema(WORDS).parquet(f"{folder}/vocabulary"))
    found.repartitionByRange("attr", "gram", "value").sortWithinPartitions("attr", "gram", "value").write.partitionBy("attr").parquet(f"{folder}/grams")


def save_index(facts: DataFrame, persons: DataFrame, path: str, scattered: bool = True) -> None:
    """Distinct facts, their blocks, vocabulary and persons, as a snapshot of one folder.

    ``scattered``: whether facts lie in no order, as those of source tables do; those of an index lie by value, so many become one
    part before a shuffle. The index is the same.
    An index may be saved over itself. The seal before and what came since stay for those who still read it, as do leased
    snapshots; older folders go.
    """
    spark = facts.sparkSession
    before = _snapshots(spark, path) if has_index(spark, path) else []
    name = f"data-{uuid.uuid4().hex}"
    folder = f"{path}/{name}"
    blocks = _write_facts_and_blocks(facts, folder, scattered)
    _write_words(bitmap.count_bitmaps(bitmap.whole(blocks), "attr", "value").withColumnRenamed("count", "n_persons"), folder)
    persons.select("person_id", "person_guid").write.parquet(f"{folder}/persons")
    _add_snapshot(spark, path, before, name, [(name, None)], sealed=True)
    _forget_old(spark, path, before)


def _forget_old(spark: SparkSession, path: str, before: list[Row]) -> None:
    newest = _snapshots(spark, path)[:1]
    for old in _folders_of(before) - _still_read(spark, path, before) - _folders_of(newest):
        remove_folder(spark, f"{path}/{old}")


def append_to_index(facts: DataFrame, path: str) -> None:
    """Facts behind those of a saved index. Their blocks and the persons they add to each value come with them, so counts stay
    right where facts are there already; an append that breaks off or is done again changes no answer."""
    spark = facts.sparkSession
    before = _current(spark, path)
    old = _tables(spark, path, before[0])
    name = f"data-{uuid.uuid4().hex}"
    folder = f"{path}/{name}"
    blocks = _write_facts_and_blocks(facts, folder)
    new = bitmap.whole(blocks)
    met = bitmap.whole(old.blocks).join(new.select("attr", "value", "bucket"), ["attr", "value", "bucket"], "left_semi")
    both = new.withColumn("old", F.lit(False)).unionByName(met.withColumn("old", F.lit(True)))
    grown = both.groupBy("attr", "value", "bucket").agg((F.bitmap_count(F.bitmap_or_agg("bitmap")) - F.bitmap_count(F.bitmap_or_agg(F.when(F.col("old"), F.col("bitmap"))))).alias("n"))
    _write_words(grown.groupBy("attr", "value").agg(F.sum("n").alias("n_persons")).filter("n_persons > 0"), folder)
    parts = [(p.folder, p.attrs) for p in before[0].parts]
    _add_snapshot(spark, path, before, before[0].folder, [*parts, (name, None)], sealed=False)


def compact_index(spark: SparkSession, path: str) -> list[str]:
    """Seals what was appended: attributes that several folders hold are merged, their facts distinct and sorted, their blocks
    united; the others stay where they are. The attributes that were merged."""
    before = _current(spark, path)
    held = [(p.folder, sorted(p.attrs if p.attrs is not None else _attrs_of(spark, f"{path}/{p.folder}/facts"))) for p in before[0].parts]
    touched = sorted(a for a in {a for _, attrs in held for a in attrs} if sum(a in attrs for _, attrs in held) > 1)
    if not touched:
        return []
    now, name = _tables(spark, path, before[0]), f"data-{uuid.uuid4().hex}"
    folder, of = f"{path}/{name}", F.col("attr").isin(*touched)
    _write_facts(*_write_parts(now.facts.filter(of), folder, scattered=False), folder)
    remove_folder(spark, f"{folder}/parts")
    blocks = _write_blocks(bitmap.merged(now.blocks.filter(of), "attr", "value", "yyyymm"), folder)
    _write_words(bitmap.count_bitmaps(bitmap.whole(blocks), "attr", "value").withColumnRenamed("count", "n_persons"), folder)
    rest = [(f, [a for a in attrs if a not in touched]) for f, attrs in held]
    _add_snapshot(spark, path, before, before[0].folder, [*((f, attrs) for f, attrs in rest if attrs), (name, touched)], sealed=True)
    _forget_old(spark, path, before)
    return touched


def _attrs_of(spark: SparkSession, folder: str) -> list[str]:
    """The attributes of a folder of facts, by the names of its folders."""
    return [unquote(name.partition("=")[2]) for name, _ in folders(spark, folder) if name.startswith("attr=")]


def _tables(spark: SparkSession, path: str, snapshot: Row) -> Index:
    def read(kind: str, schema: str) -> DataFrame:
        tables = ((spark.read.schema(schema).parquet(f"{path}/{p.folder}/{kind}"), p.attrs) for p in snapshot.parts)
        return union(t if attrs is None else t.filter(F.col("attr").isin(*attrs)) for t, attrs in tables)

    try:
        words, blocks = read("vocabulary", WORDS), read("blocks", BLOCKS)
        if len(snapshot.parts) > 1:
            words = words.groupBy("attr", "value").agg(F.sum("n_persons").alias("n_persons"))
        return Index(read("facts", FACTS), spark.read.schema(PERSONS).parquet(f"{path}/{snapshot.folder}/persons"), words, blocks, read("grams", GRAMS))
    except AnalysisException as e:
        raise IndexFormatError(f"{path}: a part is missing") from e


def open_index(spark: SparkSession, path: str) -> Index:
    """The newest snapshot. Blocks of one value, month and bucket may come from several folders; they are to be united."""
    return _tables(spark, path, _current(spark, path)[0])


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """facts, persons and vocabulary of a saved index."""
    return open_index(spark, path)[:3]
