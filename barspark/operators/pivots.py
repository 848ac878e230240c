"""Pivots: swing highs and lows, their strength and height, and their labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bars import KEY, series


def swings(bars: DataFrame, n: int, cap: int, pip: float) -> DataFrame:
    """Bars that reach at least as far as the n before and farther than the n after, one row for each side.

    strength: bars after those, up to `cap`, before the extreme is passed. height_pips: distance to the latest of the 49
    pivots before that is of the other side, else 999; on one bar the high comes first.
    """
    w = series()
    left, right = w.rowsBetween(-n, -1), w.rowsBetween(1, n)
    later = w.rowsBetween(n + 1, n + cap)
    whole = (F.count("*").over(left) == n) & (F.count("*").over(right) == n)
    sides = []
    marked = bars.withColumns({
        "_whole": whole, "_hl": F.max("high").over(left), "_hr": F.max("high").over(right), "_ll": F.min("low").over(left), "_lr": F.min("low").over(right),
        "_highs": F.collect_list("high").over(later), "_lows": F.collect_list("low").over(later),
    })
    for side, price, is_pivot, list_, over in (
        ("high", "high", (F.col("high") >= F.col("_hl")) & (F.col("high") > F.col("_hr")), "_highs", F.transform("_highs", lambda x: x > F.col("high"))),
        ("low", "low", (F.col("low") <= F.col("_ll")) & (F.col("low") < F.col("_lr")), "_lows", F.transform("_lows", lambda x: x < F.col("low"))),
    ):
        at = F.array_position(over, True)
        strength = F.when(at > 0, at - 1).otherwise(F.size(list_)).cast("int")
        sides.append(F.when(is_pivot, F.struct(F.lit(side).alias("side"), F.col(price).alias("price"), strength.alias("strength"))))
    rows = marked.where("_whole").select(*KEY, "bar_index", "ts_ny", "session", "forex_day", F.explode(F.array_compact(F.array(*sides))).alias("p"))
    rows = rows.select(*KEY, "bar_index", "ts_ny", "session", "forex_day", "p.side", "p.price", "p.strength")
    before = Window.partitionBy(*KEY).orderBy("bar_index", "side").rowsBetween(-49, -1)
    other = F.when(F.col("side") == "high", F.last(F.when(F.col("side") == "low", F.col("price")), True).over(before)).otherwise(F.last(F.when(F.col("side") == "high", F.col("price")), True).over(before))
    return rows.withColumn("height_pips", F.coalesce(F.round(F.abs(F.col("price") - other) / pip, 2), F.lit(999.0)))


def classify_swings(swings: DataFrame) -> DataFrame:
    """HH, LH, HL or LL against the pivot before on the same side; null for the first and for equal prices."""
    before = F.lag("price").over(Window.partitionBy(*KEY, "side").orderBy("bar_index"))
    p, high = F.col("price"), F.col("side") == "high"
    label = F.when(p > before, F.when(high, "HH").otherwise("HL")).when(p < before, F.when(high, "LH").otherwise("LL"))
    return swings.withColumn("label", label)


def near_prices(swings: DataFrame, ranks: int, most: float) -> DataFrame:
    """Pairs of pivots of a side, fewer than `ranks` apart in order, within `most` in price."""
    rank = F.row_number().over(Window.partitionBy(*KEY, "side").orderBy("bar_index"))
    p = swings.select(*KEY, "side", "bar_index", "price", rank.alias("rank")).withColumn("bucket", F.floor(F.col("rank") / ranks))
    one = p.withColumn("bucket", F.explode(F.array(F.col("bucket"), F.col("bucket") + 1)))
    two = p.select(*KEY, "side", "bucket", F.col("bar_index").alias("bar2"), F.col("price").alias("price2"), F.col("rank").alias("rank2"))
    near = (F.col("rank2") > F.col("rank")) & (F.col("rank2") < F.col("rank") + ranks) & (F.abs(F.col("price") - F.col("price2")) <= most)
    return one.join(two.hint("merge"), [*KEY, "side", "bucket"]).where(near).select(*KEY, "side", F.col("bar_index").alias("bar1"), "bar2", "price", "price2")
