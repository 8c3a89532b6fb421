"""Tables that cut a lineage: written to the shared folder in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


class NoSharedFolder(RuntimeError):
    """A cluster without spark.checkpoint.dir: what one machine writes the others would not see."""


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir.

    Only a session whose executors are threads of the driver (a local master) may go without the setting and gets a
    temporary folder; any other is refused, as tables written to a machine's own disk would be read back incomplete.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_kbspark_scratch", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise NoSharedFolder(f"set spark.checkpoint.dir to a folder that all machines share (master {master})")
        base = spark._kbspark_scratch = "file://" + tempfile.mkdtemp(prefix="kbspark-")
    return f"{base}/kbspark-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    for paths in getattr(spark, "_kbspark_scopes", ()):
        paths.append(path)
    return path


@contextmanager
def scope(spark: SparkSession) -> Iterator[Callable[[Stored], Stored]]:
    """Scratch tables made inside are deleted at the end, but for those that the function given is called with.

    Keep what is still to be read: a result that isn't stored yet reads the tables that it was made from.
    """
    scopes = spark._kbspark_scopes = getattr(spark, "_kbspark_scopes", [])
    paths, kept = [], set()
    scopes.append(paths)

    def keep(table: Stored) -> Stored:
        kept.add(table.path)
        return table

    try:
        yield keep
    finally:
        scopes.remove(paths)
        for path in paths:
            if path not in kept:
                remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Hadoop's file system, whatever store holds it."""
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)


def clean_up(spark: SparkSession) -> None:
    """Delete all scratch tables of this application. Call it when no result that reads them is needed any more."""
    remove(spark, scratch_dir(spark))


class Stored:
    """A table written to the scratch folder. df reads it; drop() deletes its files."""

    def __init__(self, spark: SparkSession, path: str, schema) -> None:
        self.spark, self.path = spark, path
        self.df = spark.read.schema(schema).parquet(path)

    def drop(self) -> None:
        remove(self.spark, self.path)


def stored(df: DataFrame, label: str) -> Stored:
    """Write df as Parquet to shared storage and read it back: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return Stored(spark, path, df.schema)


def store(df: DataFrame, label: str) -> DataFrame:
    """Write df and read it back."""
    return stored(df, label).df

