"""Incremental ingestion (an extension): new report files become chunk windows as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.operators.chunking import OVERLAP, SIZE, windows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def stream_windows(spark: SparkSession, folder: str, size: int = SIZE, overlap: int = OVERLAP, per_trigger: int = 100) -> DataFrame:
    """A stream of chunk windows over Parquet files of documents that appear under ``folder``; stateless, so it scales with its input."""
    docs = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_trigger).parquet(folder)
    return windows(docs, size=size, overlap=overlap)


def append_units(stream: DataFrame, path: str, checkpoint: str):
    """Appends a stream's rows to a Parquet table exactly once; runs until what is there is done."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
