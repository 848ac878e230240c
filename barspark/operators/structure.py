"""Breaks of structure, order blocks, and retracement zones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import map_session
from .bars import KEY, series
from .search import forward

# How many bars after an order block its retests may come (the last excluded), by timeframe, and for others.
RETESTS, OTHER_RETESTS = {"1m": 100, "5m": 50, "15m": 30}, 30


def right_pivots(bars: DataFrame, length: int) -> DataFrame:
    """Pivots that beat the `length` bars after them, where the side changes; ghosts are none."""
    w = series()
    right = w.rowsBetween(1, length)
    whole = F.count("*").over(right) == length
    state = F.when(~whole | F.col("is_ghost"), None).when(F.col("high") > F.max("high").over(right), "high").when(F.col("low") < F.min("low").over(right), "low")
    b = bars.withColumn("side", state)
    before = F.last("side", True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    b = b.withColumn("_before", before).where(F.col("side").isNotNull() & ~F.col("side").eqNullSafe(F.col("_before")))
    return b.select(*KEY, "bar_index", "side", F.when(F.col("side") == "high", F.col("high")).otherwise(F.col("low")).alias("price"))


def structure_breaks(bars: DataFrame, length: int, level: str) -> DataFrame:
    """The first close across each latest pivot: BOS in the direction of the break before, or the first one; CHoCH against it."""
    w = series()
    pivots = right_pivots(bars, length).withColumnRenamed("price", "pivot")
    b = bars.join(pivots, [*KEY, "bar_index"], "left")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    for side in ("high", "low"):
        b = b.withColumn(f"_{side}", F.last(F.when(F.col("side") == side, F.struct(F.col("bar_index").alias("at"), F.col("pivot").alias("price"))), True).over(past))
    b = b.withColumn("_close", F.lag("close").over(w))
    up = (F.col("close") > F.col("_high.price")) & (F.col("_close") <= F.col("_high.price")) & ~F.col("is_ghost")
    down = (F.col("close") < F.col("_low.price")) & (F.col("_close") >= F.col("_low.price")) & ~F.col("is_ghost")
    event = lambda d, p: F.struct(F.lit(d).alias("direction"), F.col(f"{p}.at").alias("pivot_bar"), F.col(f"{p}.price").alias("pivot_price"))
    e = b.select(*KEY, "bar_index", "ts_ny", "close", F.explode(F.array_compact(F.array(F.when(up, event("bullish", "_high")), F.when(down, event("bearish", "_low"))))).alias("e")).select(*KEY, "bar_index", "ts_ny", "close", "e.*")
    once = F.row_number().over(Window.partitionBy(*KEY, "direction", "pivot_bar").orderBy("bar_index"))
    e = e.withColumn("_once", once).where("_once = 1").drop("_once")
    before = F.lag("direction").over(Window.partitionBy(*KEY).orderBy("bar_index", "direction"))
    return e.withColumn("break_type", F.when(before.isNull() | (before == F.col("direction")), "BOS").otherwise("CHoCH")).withColumn("level", F.lit(level))


def order_blocks(bars: DataFrame, breaks: DataFrame, tf: str, back: int = 3, least_body: float = 0.10) -> DataFrame:
    """The nearest opposing bar among the `back` before each break, and the later bars that come back to its body.

    `breaks` are any with symbol, tf, bar_index and direction, as from structure_shifts or structure_breaks. A bar whose
    body is less than `least_body` of its range, or that has no range, opposes nothing. Retests are those fewer than
    RETESTS bars after the block.
    """
    w = series()
    solid = (F.col("high") > F.col("low")) & (F.abs(F.col("close") - F.col("open")) / (F.col("high") - F.col("low")) >= least_body)
    candle = F.struct("bar_index", "ts_ny", "open", "high", "low", "close")
    options = {}
    for direction, opposing in (("bullish", F.col("close") < F.col("open")), ("bearish", F.col("close") > F.col("open"))):
        fits = F.when(opposing & solid & ~F.col("is_ghost"), candle)
        options[direction] = F.coalesce(*[F.lag(fits, k).over(w) for k in range(1, back + 1)])
    b = bars.select(*KEY, "bar_index", *[v.alias(f"_{k}") for k, v in options.items()])
    e = breaks.join(b, [*KEY, "bar_index"]).withColumn("block", F.when(F.col("direction") == "bullish", F.col("_bullish")).otherwise(F.col("_bearish"))).where("block is not null").drop("_bullish", "_bearish")
    e = e.withColumns({"block_bar": F.col("block.bar_index"), "body_top": F.greatest("block.open", "block.close"), "body_bottom": F.least("block.open", "block.close"), "wick_top": F.col("block.high"), "wick_bottom": F.col("block.low")})
    e = e.drop("block").withColumn("event", F.struct(*KEY, "bar_index", "direction"))
    back_again = F.when(F.col("direction") == "bullish", F.col("b_low") <= F.col("body_top")).otherwise(F.col("b_high") >= F.col("body_bottom"))
    found = forward(e, bars, RETESTS.get(tf, OTHER_RETESTS) - 1, "block_bar", {"retests": F.array_sort(F.collect_list(F.col("b_bar_index")))}, back_again)
    return e.join(found.hint("merge"), "event", "left").drop("event").withColumn("retests", F.coalesce("retests", F.array().cast("array<int>")))


def retracements(breaks: DataFrame, levels: tuple[float, ...] = (0.618, 0.705, 0.79)) -> DataFrame:
    """Levels back from the close of the break towards the broken pivot."""
    reach = F.abs(F.col("close") - F.col("pivot_price"))
    sign = F.when(F.col("direction") == "bullish", -1.0).otherwise(1.0)
    prices = [F.round(F.col("close") + sign * reach * x, 6).alias(f"level_{str(x)[2:]}") for x in levels]
    return breaks.where(reach >= 1e-10).select(*KEY, "bar_index", "direction", reach.alias("range"), *prices)


def shift_retracements(shifts: DataFrame, bars: DataFrame, levels: tuple[float, ...] = (0.618, 0.705, 0.79), gate: bool = True) -> DataFrame:
    """The retracements of structure shifts with their break type, session and whether they are actionable: in lokz and nyokz alone, or anywhere without `gate`."""
    at = bars.select(*KEY, "bar_index", "close", map_session(F.col("session")).alias("session"))
    met = shifts.drop("close", "session").join(at.hint("merge"), [*KEY, "bar_index"])
    found = retracements(met, levels).join(met.select(*KEY, "bar_index", "direction", "break_type", "session").hint("merge"), [*KEY, "bar_index", "direction"])
    return found.withColumn("actionable", F.col("session").isin("lokz", "nyokz") | F.lit(not gate))
