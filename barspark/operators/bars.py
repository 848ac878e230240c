"""Bars: from ticks, rolled up, numbered, and with true range and ATR."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import MINUTES, bar_time, forex_bar_time, forex_day, ny_time, with_tags

KEY = ("symbol", "tf")


def series(*order: str, key: tuple[str, ...] = KEY):
    return Window.partitionBy(*key).orderBy(*(order or ("bar_index",)))


def ticks_to_bars(ticks: DataFrame, tf: str) -> DataFrame:
    """Bars of (symbol, ts, seq, price) ticks by New York wall clock. One shuffle of partial aggregates."""
    ny = ny_time(F.col("ts"))
    order = F.struct("ts", "seq")
    bucket = bar_time(ny, MINUTES[tf])
    return (
        ticks.groupBy("symbol", bucket.alias("ts_ny"))
        .agg(F.min("ts").alias("ts"), F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count("*").cast("double").alias("volume"))
        .select("symbol", F.lit(tf).alias("tf"), "ts", "ts_ny", "open", "high", "low", "close", "volume", (F.col("volume") == 0).alias("is_ghost"))
    )


def _bucket(tf: str, align: str) -> Column:
    ny = F.col("ts_ny")
    if tf == "1D":
        return forex_day(ny).cast("timestamp_ntz")
    if tf == "W1":
        return F.to_date(F.date_trunc("week", forex_day(ny))).cast("timestamp_ntz")
    if tf == "MN":
        return F.trunc(forex_day(ny), "month").cast("timestamp_ntz")
    return forex_bar_time(ny, MINUTES[tf]) if align == "forex" else bar_time(ny, MINUTES[tf])


def rollup(bars: DataFrame, tf: str, align: str = "midnight") -> DataFrame:
    """OHLCV bars of a longer timeframe: 5m, 15m, 1H and 4H from midnight (4H from 17:00 with align='forex'), 1D, W1 and MN by forex day. Ghosts count; a bar is one if all in it are."""
    return (
        bars.groupBy("symbol", _bucket(tf, align).alias("bucket"))
        .agg(F.min("ts").alias("ts"), F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"), F.bool_and("is_ghost").alias("is_ghost"), F.count("*").alias("bar_count"))
        .select("symbol", F.lit(tf).alias("tf"), "ts", F.col("bucket").alias("ts_ny"), "open", "high", "low", "close", "volume", "is_ghost", "bar_count")
    )


def with_bar_index(bars: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    return bars.withColumn("bar_index", F.row_number().over(series("ts_ny", key=key)) - 1)


def prepared(bars: DataFrame) -> DataFrame:
    """Numbered and tagged bars, as the detectors take them."""
    return with_tags(with_bar_index(bars))


def with_true_range(bars: DataFrame) -> DataFrame:
    before = F.lag("close").over(series())
    spread = F.col("high") - F.col("low")
    return bars.withColumn("true_range", F.when(before.isNull(), spread).otherwise(F.greatest(spread, F.abs(F.col("high") - before), F.abs(F.col("low") - before))))


def with_atr(bars: DataFrame, period: int = 14, block: int = 256) -> DataFrame:
    """Adds Wilder's ATR: the mean of the first `period` true ranges, then (previous (period-1) + true range) / period.

    The recurrence y = a y' + c is a weighted running sum, taken within blocks of rows; what enters each block is folded
    over the blocks' ends, of which a series has 1/block of its rows.
    """
    a = (period - 1) / period
    bars = with_true_range(bars)
    first = F.avg("true_range").over(series().rowsBetween(-(period - 1), 0))
    i = F.col("bar_index")
    c = F.when(i == period - 1, first).when(i >= period, F.col("true_range") / period).otherwise(0.0)
    bars = bars.withColumn("_c", c).withColumn("_b", F.floor(i / block)).withColumn("_k", i % block)
    inside = series("bar_index", key=(*KEY, "_b")).rowsBetween(Window.unboundedPreceding, 0)
    bars = bars.withColumn("_s", F.sum(F.col("_c") * F.pow(F.lit(1 / a), F.col("_k"))).over(inside) * F.pow(F.lit(a), F.col("_k")))
    ends = bars.groupBy(*KEY, "_b").agg(F.max_by("_s", "_k").alias("s"), F.max("_k").alias("k"))
    folded = ends.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("_b", "s", "k"))).alias("e"))
    start = F.array(F.struct(F.lit(0).cast("bigint").alias("_b"), F.lit(0.0).alias("y")))
    carry = F.aggregate("e", start, lambda done, x: F.concat(done, F.array(F.struct((x["_b"] + 1).alias("_b"), (x["s"] + F.pow(F.lit(a), x["k"] + 1) * F.element_at(done, -1)["y"]).alias("y")))))
    carries = folded.select(*KEY, F.explode(carry).alias("x")).select(*KEY, F.col("x._b").alias("_b"), F.col("x.y").alias("_y"))
    joined = bars.join(carries.hint("merge"), [*KEY, "_b"], "left")
    atr = F.when(i >= period - 1, F.col("_s") + F.pow(F.lit(a), F.col("_k") + 1) * F.coalesce("_y", F.lit(0.0)))
    return joined.withColumn("atr", atr).drop("_c", "_b", "_k", "_s", "_y")
