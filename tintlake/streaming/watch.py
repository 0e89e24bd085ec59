"""Occurrences of sources that arrive as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tintlake.sources.stylesheet import occurrences

SOURCES = "rel_path string, contents string, read_at timestamp"


def watch(spark: SparkSession, folder: str, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Parses every new JSON file of sources in a folder once, and gives the occurrences of each batch to `each`."""
    stream = spark.readStream.schema(SOURCES).json(folder)
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: each(occurrences(batch), n)).trigger(availableNow=True).start()
