"""Three-bar gaps, their states, their overlaps, and gaps between bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bars import KEY, series
from .search import forward

# Bars to look ahead for a gap's states, by timeframe.
LOOKAHEAD = {"1m": 500, "5m": 200, "15m": 100}


def fair_value_gaps(bars: DataFrame, tf: str, pip: float, floor: float = 0.0, states: bool = True) -> DataFrame:
    """Gaps between the bars i-2 and i, none of i-2..i a ghost: one row for each, anchored at i-2.

    ce_touched_bar is the first later bar that reaches the middle, boundary_closed_bar the first that closes beyond the far
    edge, both within LOOKAHEAD. Gaps below `floor` pips are flagged only.
    """
    w = series()
    high2, low2 = F.lag("high", 2).over(w), F.lag("low", 2).over(w)
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    top2, bottom2 = F.lag(top, 2).over(w), F.lag(bottom, 2).over(w)
    real = ~(F.col("is_ghost") | F.lag("is_ghost", 1).over(w) | F.lag("is_ghost", 2).over(w))
    direction = F.when(F.col("low") > high2, "bullish").when(F.col("high") < low2, "bearish")
    g = bars.select(*KEY, "bar_index", "session", "forex_day", F.col("ts_ny").alias("detect_time"), F.lag("ts_ny", 2).over(w).alias("time"), direction.alias("direction"), real.alias("_real"),
                    F.when(direction == "bullish", high2).otherwise(F.col("high")).alias("bottom"), F.when(direction == "bullish", F.col("low")).otherwise(low2).alias("top"),
                    F.when(direction == "bullish", bottom > top2).otherwise(top < bottom2).alias("vi_confluent"))
    g = g.where("_real and direction is not null").drop("_real")
    g = g.withColumn("ce", (F.col("top") + F.col("bottom")) / 2).withColumn("gap_pips", F.round((F.col("top") - F.col("bottom")) / pip, 2)).withColumn("above_floor", F.col("gap_pips") >= floor)
    g = g.withColumn("event", F.struct(*KEY, "bar_index"))
    if not states:
        return g.drop("event")
    up = F.col("direction") == "bullish"
    touched = F.when(up, F.col("b_low") <= F.col("ce")).otherwise(F.col("b_high") >= F.col("ce"))
    closed = F.when(up, F.col("b_close") < F.col("bottom")).otherwise(F.col("b_close") > F.col("top"))
    found = forward(g, bars, LOOKAHEAD.get(tf, 200), "bar_index", {"ce_touched_bar": F.min(F.when(touched, F.col("b_bar_index"))), "boundary_closed_bar": F.min(F.when(closed, F.col("b_bar_index")))}, touched | closed)
    return g.join(found.hint("merge"), "event", "left").drop("event")


def inverse_gaps(gaps: DataFrame) -> DataFrame:
    """Gaps whose boundary has been closed beyond."""
    return gaps.where("boundary_closed_bar is not null")


def balanced_ranges(gaps: DataFrame, width: float) -> DataFrame:
    """Overlaps in price of bullish with bearish gaps of a series.

    Both are dealt by cells of `width` in price, in which they lie; the cell of the overlap's bottom gives each pair once.
    """
    low, high = F.floor(F.col("bottom") / width), F.floor(F.col("top") / width)
    celled = gaps.select(*KEY, "direction", "bar_index", "bottom", "top", F.explode(F.sequence(low, high)).alias("cell"))
    bull = celled.where("direction = 'bullish'").select(*KEY, "cell", F.col("bar_index").alias("bull_bar"), F.col("bottom").alias("b1"), F.col("top").alias("t1"))
    bear = celled.where("direction = 'bearish'").select(*KEY, "cell", F.col("bar_index").alias("bear_bar"), F.col("bottom").alias("b2"), F.col("top").alias("t2"))
    bottom, top = F.greatest("b1", "b2"), F.least("t1", "t2")
    pairs = bull.join(bear.hint("merge"), [*KEY, "cell"]).where((top > bottom) & (F.floor(bottom / width) == F.col("cell")))
    return pairs.select(*KEY, "bull_bar", "bear_bar", bottom.alias("bottom"), top.alias("top"))


def body_gaps(bars: DataFrame, pip: float) -> DataFrame:
    """Gaps between the bodies of the bars i-2 and i."""
    w = series()
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    top2, bottom2 = F.lag(top, 2).over(w), F.lag(bottom, 2).over(w)
    direction = F.when(bottom > top2, "bullish").when(top < bottom2, "bearish")
    size = F.when(direction == "bullish", bottom - top2).otherwise(bottom2 - top)
    return bars.select(*KEY, "bar_index", "ts_ny", direction.alias("direction"), F.round(size / pip, 2).alias("gap_pips")).where("direction is not null")
