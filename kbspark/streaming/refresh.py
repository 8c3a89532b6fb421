"""Continuous scans: new and changed files of a bundle as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..config import Bundle
from ..sources.bundle import Manifest, manifest_of

_BINARY = "path string, modificationTime timestamp, length long, content binary"


def stream(spark: SparkSession, bundle: Bundle, sink: Callable[[Manifest, int], None], checkpoint: str) -> StreamingQuery:
    """Call sink with the manifest of each batch of files not seen before, then stop when there are no more."""
    from pyspark.sql import functions as F

    root = bundle.root.rstrip("/")
    files = spark.readStream.format("binaryFile").schema(_BINARY).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)

    def batch(df: DataFrame, number: int) -> None:
        rel = F.substring_index("path", root.split("://", 1)[-1] + "/", -1)
        rows = df.select(rel.alias("rel_path"), F.unix_millis("modificationTime").alias("mtime_ms"), F.col("length").alias("size"), "content")
        sink(manifest_of(rows, bundle), number)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
