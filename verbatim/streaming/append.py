"""Streams of records: exactly one row a key, and windowed counts of late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.writers import append_new


def once_per_key(stream: DataFrame, key: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key within the lateness that state is kept for."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def append_stream(stream: DataFrame, path: str, checkpoint: str, *key: str):
    """Append each micro-batch's new keys to a table; a batch that is run twice adds nothing."""
    return stream.writeStream.foreachBatch(lambda batch, _: append_new(batch, path, *key)).option("checkpointLocation", checkpoint)


def windowed_counts(stream: DataFrame, at: str, width: str, *keys: str, value: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Rows (and a sum) by window and keys."""
    more = [F.sum(value).alias("total")] if value else []
    out = stream.withWatermark(at, late).groupBy(F.window(at, width), *keys).agg(F.count(F.lit(1)).alias("n_rows"), *more)
    return out.select(F.col("window.start").alias("window_start"), *keys, "n_rows", *[c for c in ("total",) if value])
