"""Streaming ingest: each micro-batch of (path, content) goes through a collection's add."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from loam.collection import Collection
from loam.sources.loaders import decoded


def file_stream(spark, folder: str, *, per_trigger: int = 100) -> DataFrame:
    """New files of a folder as (path, content)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    s = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", per_trigger).load(folder)
    return decoded(s.select("path", "content"))


def ingest_stream(docs: DataFrame, into: Collection, checkpoint: str) -> DataStreamWriter:
    """A writer to start; a batch that is repeated after a failure finds its documents stored and adds nothing."""
    return docs.writeStream.foreachBatch(lambda batch, _: into.add(batch) and None).option("checkpointLocation", checkpoint)
