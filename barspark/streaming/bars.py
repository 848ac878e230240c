"""Bars and gaps over a stream of ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_bars(ticks: DataFrame, minutes: int, late: str = "10 minutes") -> DataFrame:
    """OHLCV bars of a stream of (symbol, ts TIMESTAMP, seq, price); a bar is final once the watermark has passed it."""
    order = F.struct("ts", "seq")
    w = F.window("ts", f"{minutes} minutes")
    return (
        ticks.withWatermark("ts", late)
        .groupBy("symbol", w.alias("w"))
        .agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count("*").cast("double").alias("volume"))
        .select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")
    )
