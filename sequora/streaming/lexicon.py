"""Lexicon files as a stream: each new file's words reach the same table as a batch load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.readers import parse_lexicon


def stream_lexicon(spark: SparkSession, folder: str) -> DataFrame:
    """A streaming ``(word, transcription)`` over the files of a folder."""
    return parse_lexicon(spark.readStream.text(folder).select(F.trim("value").alias("line")))


def load_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived to a table, once and only once, and stop."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
