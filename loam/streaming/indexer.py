"""Incremental indexing: each micro-batch of new lines becomes a segment; the index can be searched meanwhile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from loam.sources.segments import Index


def index_stream(lines: DataFrame, root: str, checkpoint: str, merge: bool = False, once: bool = True) -> StreamingQuery:
    """Starts indexing a stream of lines (id, content). A batch that runs again is recognised by its number and adds
    nothing; the checkpoint gives resumption. once: stops when what is there is indexed."""

    def add(batch: DataFrame, number: int) -> None:
        now = Index.open(batch.sparkSession, root).add(batch, number)
        if merge:
            now.merge()

    writer = lines.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_lines(spark: SparkSession, path: str, key: str = "id", content: str = "content", files: int = 1000) -> DataFrame:
    """A stream of the Parquet files that appear in a folder, as (id, content); at most `files` of them a batch."""
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return rows.selectExpr(f"{key} AS id", f"{content} AS content")
