from pyspark.sql import functions as F

from mustra.sources.facts import FACTS, load_index, save_index
from mustra.streaming.append import append_facts, stream_facts


def test_stream_of_events_becomes_distinct_facts(spark, sf_dir, tmp_path):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = tmp_path / "in"
    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(3).write.parquet(str(source))
    stream = spark.readStream.schema(schema).parquet(str(source))
    facts = stream_facts(stream, F.col("user_id"), "event_type", F.col("event_type"), F.col("ts"), delay="400 days")
    append_facts(facts, str(tmp_path / "index"), str(tmp_path / "check")).awaitTermination()
    got = spark.read.schema(FACTS).parquet(str(tmp_path / "index" / "facts"))
    expected = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type", F.date_format("ts", "yyyyMM")).distinct().count()
    assert got.count() == got.distinct().count() == expected


def test_a_stream_is_appended_to_a_saved_index(spark, tmp_path):
    path = str(tmp_path / "index")
    save_index(spark.createDataFrame([(1, "kind", "old", 202001)], FACTS), spark.createDataFrame([(1, "one")], "person_id long, person_guid string"), path)
    spark.createDataFrame([(1, "new", "2020-02-03 04:05:06"), (2, "new", "2020-03-03 04:05:06")], "who long, what string, at string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("who long, what string, at string").parquet(str(tmp_path / "in"))
    append_facts(stream_facts(stream, F.col("who"), "kind", F.col("what"), F.col("at")), path, str(tmp_path / "check")).awaitTermination()
    facts, _, words = load_index(spark, path)
    assert {(r.person_id, r.value, r.yyyymm) for r in facts.collect()} == {(1, "old", 202001), (1, "new", 202002), (2, "new", 202003)}
    assert {(r.value, r.n_persons) for r in words.collect()} == {("old", 1), ("new", 2)}
