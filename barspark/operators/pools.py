"""Levels that highs or lows of long timeframes have touched more than once."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bars as B
from .bars import KEY
from .pivots import swings
from .search import first_later

# Fixed values by timeframe: tolerance in pips, least bars between touches, least retracement in pips, and how many of the
# last bars are looked at. For all: least retracement as a share of ATR, tolerances within which pools are merged, least touches.
POOLS = {"1H": (2, 6, 5, 500), "4H": (3, 3, 8, 300), "1D": (5, 2, 12, 180), "W1": (10, 2, 20, 104), "MN": (15, 2, 30, 60)}
ATR_SHARE, MERGE, TOUCHES = 0.25, 1.5, 2
_POOL = "symbol string, tf string, side string, price double, touches int, first_bar int, last_bar int"


def _grouped(rows: pd.DataFrame, side: str, tolerance: float, between: int, retrace: float) -> list[tuple[float, list[int]]]:
    """Pools of one series and side, as (price, bar numbers of the touches); `rows` are its last bars in order.

    A pivot joins the nearest live pool within the tolerance whose last touch is far enough back, with enough retracement
    in between; a pool whose level was traded through since its last touch dies instead. Otherwise the pivot opens a pool.
    """
    base, sign = int(rows["bar_index"].iloc[0]), 1 if side == "high" else -1
    # Prices of lows are negated, so that every level is a ceiling.
    toward = (sign * rows["high" if side == "high" else "low"]).to_numpy()
    away = (sign * rows["low" if side == "high" else "high"]).to_numpy()
    asia, day, atr = (rows["session"] == "asia").to_numpy(), rows["forex_day"].to_numpy(), rows["atr"].fillna(0.0).to_numpy()
    prices: list[float] = []
    touches: list[list[int]] = []
    live: list[bool] = []
    for k in rows["pivot"].to_numpy().nonzero()[0]:
        price, joined = toward[k], False
        for p in sorted((p for p in range(len(prices)) if live[p] and abs(price - prices[p]) <= tolerance), key=lambda p: abs(price - prices[p])):
            last = touches[p][-1]
            if (asia[last] and asia[k] and day[last] == day[k]) or k - last < between:
                continue
            if k > last + 1:
                if prices[p] - away[last + 1 : k].min() < max(retrace, ATR_SHARE * atr[k]):
                    continue
                if toward[last + 1 : k].max() > prices[p] + tolerance:
                    live[p] = False
                    continue
            touches[p].append(int(k))
            prices[p], joined = _middle(toward, touches[p], sign), True
            break
        if not joined:
            prices.append(price)
            touches.append([int(k)])
            live.append(True)
    done: list[tuple[float, list[int]]] = []
    for price, at in sorted(((sign * prices[p], touches[p]) for p in range(len(prices)) if live[p] and len(touches[p]) >= TOUCHES), key=lambda x: x[0]):
        if done and abs(price - done[-1][0]) <= MERGE * tolerance:
            at = sorted(done.pop()[1] + at)
            price = sign * _middle(toward, at, sign)
        done.append((price, at))
    return [(float(price), [base + k for k in at]) for price, at in done]


def _middle(toward, at: list[int], sign: int) -> float:
    """The upper median of the touches' prices."""
    return sign * sorted(sign * toward[k] for k in at)[len(at) // 2]


def level_pools(bars: DataFrame, tf: str, pip: float) -> DataFrame:
    """Pools of highs and lows of the bars rolled up to `tf`, with the first bar that trades beyond them (taken_bar, null while untouched).

    Only pivots among a series' last bars count, as many as POOLS has for the timeframe, so a pandas group holds no more than that.
    """
    tolerance, between, retrace, lookback = POOLS[tf]
    b = B.with_atr(B.prepared(B.rollup(bars, tf)))
    last = F.max("bar_index").over(Window.partitionBy(*KEY))
    recent = b.withColumn("_last", last).where((F.col("bar_index") >= F.col("_last") - lookback) & (F.col("_last") >= 4))
    marked = swings(b, 2, 1, pip).select(*KEY, "bar_index", "side", F.lit(True).alias("pivot"))
    sides = F.explode(F.array(F.lit("high"), F.lit("low"))).alias("side")
    rows = recent.select(*KEY, "bar_index", "high", "low", "atr", "session", "forex_day", sides).join(marked.hint("merge"), [*KEY, "side", "bar_index"], "left").withColumn("pivot", F.coalesce("pivot", F.lit(False)))

    def group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = _grouped(pdf.sort_values("bar_index"), key[2], tolerance * pip, between, retrace * pip)
        return pd.DataFrame([(*key, price, len(at), at[0], at[-1]) for price, at in found], columns=["symbol", "tf", "side", "price", "touches", "first_bar", "last_bar"])

    pools = rows.groupBy(*KEY, "side").applyInPandas(group, _POOL).withColumn("event", F.struct(*KEY, "side", "price", "last_bar"))
    values = b.select(*KEY, "bar_index", F.explode(F.array(F.struct(F.lit("high").alias("side"), (-F.col("high")).alias("v")), F.struct(F.lit("low").alias("side"), F.col("low").alias("v")))).alias("s")).select(*KEY, "bar_index", "s.*")
    asked = pools.withColumns({"at": F.col("last_bar"), "x": F.when(F.col("side") == "high", -F.col("price")).otherwise(F.col("price")), "strict": F.lit(True)})
    return first_later(asked, values).drop("event", "at", "x", "strict").withColumnRenamed("found", "taken_bar")
