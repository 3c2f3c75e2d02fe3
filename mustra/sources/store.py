"""Folders and shared places of any store that Spark knows."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    """Hadoop's file system and path, or None if the session has ended."""
    context = spark.sparkContext
    if context._jsc is None or context._jsc.sc().isStopped():
        return None
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(context._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    found = _at(spark, path)
    return found is not None and found[0].exists(found[1])


def folders(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Names of the folders inside ``path`` and when they were changed, in milliseconds."""
    found = _at(spark, path)
    if found is None or not found[0].exists(found[1]):
        return []
    return [(s.getPath().getName(), s.getModificationTime()) for s in found[0].listStatus(found[1]) if s.isDirectory()]


def remove_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder, as long as the session lives."""
    found = _at(spark, path)
    if found is not None:
        found[0].delete(found[1], True)


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: what the cluster names; the warehouse only where all is one machine."""
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None) or (known.get() if known.isDefined() else None)
    if named is None and not context.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return named or spark.conf.get("spark.sql.warehouse.dir")


def gone_at_exit(spark: SparkSession, path: str) -> None:
    """Removes a folder that is there when the driver ends, also where the session was stopped before: the JVM's own hook does it then."""
    atexit.register(remove_folder, spark, path)
    found = _at(spark, path)
    if found is not None:
        found[0].deleteOnExit(found[1])


def new_place(spark: SparkSession, kind: str) -> str:
    """A path for a new table or index, in a folder of its own in the shared one, that is gone when the driver ends."""
    folder = f"{shared_root(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    found = _at(spark, folder)
    if found is not None:
        found[0].mkdirs(found[1])
    gone_at_exit(spark, folder)
    return f"{folder}/{kind}"
