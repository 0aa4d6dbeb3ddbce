"""Incremental ingestion: the audit's de-duplication over streams of measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def deduplicate_stream(rows: DataFrame, key: list[str], at: str, delay: str) -> DataFrame:
    """First row of each key within the watermark's delay; later copies go, and so does the state of old keys."""
    return rows.withWatermark(at, delay).dropDuplicatesWithinWatermark(key)


def windowed_source_counts(rows: DataFrame, at: str, source: str, window: str, delay: str) -> DataFrame:
    """(window, source, n, mean): late rows within the delay are counted in."""
    return rows.withWatermark(at, delay).groupBy(F.window(at, window), source).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
