"""Sentences and candidates of pages that keep arriving.

Segmentation and prefilter are row-local, so the batch functions run on a stream as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from normspark.config import Config
from normspark.operators import prefilter, segment

PAGE = "source STRING, page BIGINT, raw_text STRING"


def page_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Page tables as they are added to a folder."""
    return spark.readStream.schema(PAGE).parquet(folder)


def candidate_stream(pages: DataFrame, config: Config) -> DataFrame:
    return prefilter.candidates(segment.sentences(pages), config)


def write_candidates(
    pages: DataFrame, config: Config, folder: str, checkpoint: str
) -> StreamingQuery:
    """Append candidates to a table; takes what has arrived and stops."""
    return (
        candidate_stream(pages, config)
        .writeStream.format("parquet")
        .option("path", folder)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
