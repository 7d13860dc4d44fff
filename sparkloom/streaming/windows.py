"""Time windows of event tables, batch or streaming: the same calls give both, as a stream's state is bounded by its watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _late(df: DataFrame, ts: str, late: str | None) -> DataFrame:
    if df.isStreaming and late is None:
        raise ValueError("a stream needs a bound on lateness, or its state grows for ever")
    return df.withWatermark(ts, late) if df.isStreaming else df


def windowed(df: DataFrame, ts: str, size: str, keys: list[str], slide: str | None = None, late: str | None = None, **aggs: Column) -> DataFrame:
    """Aggregates by keys and tumbling windows (sliding ones, with slide): keys, start, end, aggregates. Null times are left out."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = _late(df, ts, late).groupBy(window.alias("_w"), *keys).agg(*(c.alias(k) for k, c in aggs.items()))
    return out.select(*keys, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *aggs)


def sessions(df: DataFrame, ts: str, gap: str, keys: list[str], late: str | None = None, **aggs: Column) -> DataFrame:
    """Aggregates by keys and sessions: events less than gap apart."""
    out = _late(df, ts, late).groupBy(F.session_window(ts, gap).alias("_w"), *keys).agg(*(c.alias(k) for k, c in aggs.items()))
    return out.select(*keys, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *aggs)


def once(df: DataFrame, ts: str, keys: list[str], late: str | None = None) -> DataFrame:
    """One row for each value of keys; in a stream, copies within the watermark are dropped."""
    return _late(df, ts, late).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)
