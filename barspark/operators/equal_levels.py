"""Highs, or lows, that stop at about the same price: pools of pivots around the first of them, and counts of equal pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import MINUTES
from .bars import KEY
from .pivots import swings
from .sweeps import in_chunks, of_chunks

# Tolerance in pips and as a share of ATR, least minutes between first and last touch, least retracement in pips and as a
# share of ATR, and for pools within sessions the tolerances, the ATR in pips where there is none, and the least bars.
TOLERANCE, TOLERANCE_ATR, APART, RETRACE, RETRACE_ATR = 5.0, 0.15, 60, 10.0, 0.3
GATED, GATED_ATR, GATED_DEFAULT, GATED_BARS = 2.0, 0.1, 3.0, 5
GATES = ("asia", "pre_london", "pre_ny")
TOUCHES = 2


def _clustered(pivots: DataFrame, *keep: str) -> DataFrame:
    """Clusters of pivots (bar_index, price, tol) of a series and side: each pivot goes to the earliest one before it that
    has it within its tolerance and went to none itself, or stands for itself. One fold over the pivots, with the leaders
    as its state; leaders lie apart by their tolerance, so there are as many as the range of prices holds. Give series of bounded length.
    """
    pivot = F.struct("bar_index", "price", "tol", *keep)
    lists = pivots.groupBy(*KEY, "side").agg(F.array_sort(F.collect_list(pivot)).alias("of"))
    none = F.filter(F.transform("of", lambda p: F.struct(p.alias("first"), p.alias("last"), F.lit(0).alias("touches"), F.lit(0.0).alias("total"), F.lit(0.0).alias("least"), F.lit(0.0).alias("most"))), lambda x: F.lit(False))

    def step(done: Column, p: Column) -> Column:
        at = F.array_position(F.transform(done, lambda c: F.abs(p["price"] - c["first"]["price"]) <= c["first"]["tol"]), True)
        fresh = F.struct(p.alias("first"), p.alias("last"), F.lit(1).alias("touches"), p["price"].alias("total"), p["price"].alias("least"), p["price"].alias("most"))
        more = lambda c: F.struct(c["first"].alias("first"), p.alias("last"), (c["touches"] + 1).alias("touches"), (c["total"] + p["price"]).alias("total"), F.least(c["least"], p["price"]).alias("least"), F.greatest(c["most"], p["price"]).alias("most"))
        return F.when(at == 0, F.concat(done, F.array(fresh))).otherwise(F.transform(done, lambda c, k: F.when(k == at - 1, more(c)).otherwise(c)))

    out = lists.select(*KEY, "side", F.explode(F.aggregate("of", none, step)).alias("c")).where(F.col("c.touches") >= TOUCHES)
    level = F.col("c.total") / F.col("c.touches")
    spread = F.greatest(F.col("c.most") - level, level - F.col("c.least"))
    return out.select(*KEY, "side", F.col("c.first.bar_index").alias("first_bar"), F.col("c.last.bar_index").alias("last_bar"), level.alias("level"), F.col("c.touches").alias("touches"), spread.alias("half_width"), *[F.col(f"c.first.{k}").alias(k) for k in keep])


def equal_pools(bars: DataFrame, tf: str, pip: float) -> DataFrame:
    """Pools of `bars` (with atr), at least APART minutes long, with a retracement in between; role is INTERNAL up to 15m, else EXTERNAL."""
    at = bars.select(*KEY, "bar_index", F.coalesce("atr", F.lit(0.0)).alias("atr"))
    pivots = swings(bars, 2, 1, pip).select(*KEY, "side", "bar_index", "price").join(at.hint("merge"), [*KEY, "bar_index"])
    pools = _clustered(pivots.withColumn("tol", F.greatest(F.lit(TOLERANCE * pip), TOLERANCE_ATR * F.col("atr"))), "atr")
    pools = pools.where(F.col("last_bar") - F.col("first_bar") >= max(1, APART // MINUTES.get(tf, 1440)))
    between = bars.select(*KEY, F.col("bar_index").alias("b"), "high", "low").hint("merge")
    met = pools.join(between, list(KEY)).where((F.col("b") > F.col("first_bar")) & (F.col("b") < F.col("last_bar")))
    away = F.max(F.when(F.col("side") == "high", F.col("level") - F.col("low")).otherwise(F.col("high") - F.col("level")))
    out = met.groupBy(*pools.columns).agg(away.alias("retraced")).where(F.col("retraced") >= F.greatest(F.lit(RETRACE * pip), RETRACE_ATR * F.col("atr")))
    return out.withColumns({"pip_width": F.round(F.col("half_width") / pip * 2, 2), "retraced_pips": F.round(F.col("retraced") / pip, 1), "role": F.lit("INTERNAL" if tf in ("1m", "5m", "15m") else "EXTERNAL")}).drop("half_width", "retraced", "atr")


def gated_pools(bars: DataFrame, pip: float) -> DataFrame:
    """Pools within asia, pre_london and pre_ny of a forex day alone: pivots are those of the window's own bars, of which there are five or more. Adds forex_day and window; bars count from the window's first."""
    inside = bars.where(F.col("session").isin(*GATES))
    chunked = in_chunks(inside, F.concat_ws(":", F.date_format("forex_day", "yyyy-MM-dd"), "session"))
    whole = chunked.groupBy(*KEY).agg(F.count("*").alias("n")).where(F.col("n") >= GATED_BARS).select(*KEY)
    chunked = chunked.join(whole.hint("merge"), list(KEY), "left_semi")
    at = chunked.select(*KEY, "bar_index", F.coalesce("atr", F.lit(GATED_DEFAULT * pip)).alias("atr"))
    pivots = swings(chunked, 2, 1, pip).select(*KEY, "side", "bar_index", "price").join(at.hint("merge"), [*KEY, "bar_index"])
    pools = of_chunks(_clustered(pivots.withColumn("tol", F.greatest(F.lit(GATED * pip), GATED_ATR * F.col("atr")))))
    return pools.withColumns({"forex_day": F.to_date(F.split_part("chunk", F.lit(":"), F.lit(1))), "window": F.split_part("chunk", F.lit(":"), F.lit(2)), "pip_width": F.round(F.col("half_width") / pip * 2, 2)}).drop("chunk", "half_width")


def equal_matrix(pairs: DataFrame, tolerances: tuple[float, ...], pip: float, *by: str) -> DataFrame:
    """Pairs of near_prices (side, price, price2) at most so many pips apart, for each tolerance. A literal of few tolerances, so a pair becomes few rows."""
    apart = F.round(F.abs(F.col("price") - F.col("price2")) / pip, 2)
    each = pairs.select(*by, "side", apart.alias("pips"), F.explode(F.array(*map(F.lit, tolerances))).alias("tolerance")).where("pips <= tolerance")
    return each.groupBy(*by, "tolerance").agg(F.count_if(F.col("side") == "high").alias("equal_highs"), F.count_if(F.col("side") == "low").alias("equal_lows"))
