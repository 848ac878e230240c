"""Blocks at the extreme of a leg, events in the New York windows, and the displacements around an event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bars import KEY, series
from .search import first_later


def extreme_blocks(bars: DataFrame, breaks: DataFrame, multiple: float = 2.0) -> DataFrame:
    """The bar with the lowest low (highest high before bearish breaks) between each break's pivot and the break, and what became of it.

    Ghosts and bars as wide as `multiple` ATR or wider are left out; of equal extremes the first counts. The zone is the
    bar's whole range. Later bars that reach it mitigate it, a close beyond its far side invalidates it. `bars` have
    atr; `breaks` are of one length. Intervals of breaks in one direction don't overlap, so each bar lies in one at most:
    that of the latest broken pivot before it.
    """
    sides = F.explode(F.array(F.lit("bullish"), F.lit("bearish"))).alias("direction")
    pivots = breaks.select(*KEY, "direction", F.col("pivot_bar").alias("bar_index"), F.lit(True).alias("_pivot")).distinct()
    calm = ~F.col("is_ghost") & (F.col("atr").isNull() | (F.col("high") - F.col("low") < F.col("atr") * multiple))
    each = bars.select(*KEY, "bar_index", "high", "low", calm.alias("_calm"), sides)
    w = Window.partitionBy(*KEY, "direction").orderBy("bar_index").rowsBetween(Window.unboundedPreceding, -1)
    each = each.join(pivots.hint("merge"), [*KEY, "direction", "bar_index"], "left").withColumn("pivot_bar", F.last(F.when(F.col("_pivot"), F.col("bar_index")), True).over(w))
    inside = each.where("_calm and pivot_bar is not null").select(*KEY, "direction", "pivot_bar", F.col("bar_index").alias("b"), "high", "low")
    reach = F.when(F.col("direction") == "bullish", F.col("low")).otherwise(-F.col("high"))
    best = F.min(F.struct(reach.alias("reach"), "b", "high", "low")).alias("best")
    met = breaks.join(inside.hint("merge"), [*KEY, "direction", "pivot_bar"]).where(F.col("b") < F.col("bar_index")).groupBy(*KEY, "bar_index", "direction", "pivot_bar").agg(best)
    blocks = met.select(*KEY, "bar_index", "direction", "pivot_bar", F.col("best.b").alias("block_bar"), F.col("best.high").alias("zone_high"), F.col("best.low").alias("zone_low"))
    up = F.col("direction") == "bullish"
    ask = lambda test, near, far, strict: F.struct(F.lit(test).alias("test"), F.when(up, F.col(near)).otherwise(-F.col(far)).alias("x"), F.lit(strict).alias("strict"))
    tests = F.explode(F.array(ask("mitigated", "zone_high", "zone_low", False), ask("invalidated", "zone_low", "zone_high", True))).alias("t")
    asked = blocks.select(*KEY, "bar_index", "direction", "pivot_bar", "block_bar", "zone_high", "zone_low", tests)
    asked = asked.select("*", "t.*", F.concat_ws(" ", "direction", "t.test").alias("side"), F.col("block_bar").alias("at"), F.struct(*KEY, "bar_index", "direction", "t.test").alias("event")).drop("t")
    value = lambda side, v: F.struct(F.lit(side).alias("side"), v.alias("v"))
    seen = F.explode(F.array(value("bullish mitigated", F.col("low")), value("bearish mitigated", -F.col("high")), value("bullish invalidated", F.col("close")), value("bearish invalidated", -F.col("close")))).alias("s")
    values = bars.where(~F.col("is_ghost")).select(*KEY, "bar_index", seen).select(*KEY, "bar_index", "s.*")
    when = lambda test: F.max(F.when(F.col("test") == test, F.col("found"))).alias(f"{test}_bar")
    found = first_later(asked, values).groupBy(*KEY, "bar_index", "direction", "pivot_bar", "block_bar", "zone_high", "zone_low").agg(when("mitigated"), when("invalidated"))
    state = F.when(F.col("invalidated_bar").isNotNull(), "INVALIDATED").when(F.col("mitigated_bar").isNotNull(), "MITIGATED").otherwise("ACTIVE")
    return found.withColumn("state", state)


def window_events(bars: DataFrame, gaps: DataFrame, swings: DataFrame, displacements: DataFrame, least_gap: float, atr: float = 1.5, body: float = 0.6) -> DataFrame:
    """Gaps of `least_gap` pips or more, swings and strong displacements (those of two bars by either bar) in the New York windows a and b."""
    kinds = [
        gaps.where(F.col("gap_pips") >= least_gap).select(*KEY, "bar_index", F.col("bar_index").alias("end"), F.lit("fvg").alias("kind"), F.col("direction").alias("subtype"), F.col("gap_pips").alias("value")),
        swings.select(*KEY, "bar_index", F.col("bar_index").alias("end"), F.lit("swing").alias("kind"), F.col("side").alias("subtype"), F.col("price").alias("value")),
        displacements.where(((F.col("atr_exact") >= atr) & (F.col("body_exact") >= body)) | F.col("decisive")).select(*KEY, "bar_index", F.col("bar_index_end").alias("end"), F.lit("displacement").alias("kind"), F.col("direction").alias("subtype"), F.col("range_pips").alias("value")),
    ]
    every = kinds[0].unionByName(kinds[1]).unionByName(kinds[2])
    inside = bars.where("ny_window is not null").select(*KEY, F.col("bar_index").alias("at"), F.col("ny_window").alias("window"))
    asked = every.withColumn("at", F.explode(F.array_distinct(F.array("bar_index", "end"))))
    return asked.join(inside.hint("merge"), [*KEY, "at"]).select(*KEY, "window", "kind", "subtype", "bar_index", "value").distinct()


def qualified(events: DataFrame, bars: DataFrame, displacements: DataFrame, back: int = 10, ahead: int = 5) -> DataFrame:
    """Tags events (bar_index, direction) with DISP_BEFORE where a displacement against them starts in the `back` bars before, else DISP_AFTER where one their way starts on their bar or in the `ahead` after."""
    w = series()
    starts = displacements.select(*KEY, "bar_index", F.col("direction").alias("_d")).distinct()
    b = bars.select(*KEY, "bar_index").join(starts.hint("merge"), [*KEY, "bar_index"], "left")
    seen = lambda d, rows: F.coalesce(F.max(F.col("_d") == d).over(rows), F.lit(False))
    near: dict[str, Column] = {}
    for d, against in (("bullish", "bearish"), ("bearish", "bullish")):
        near[f"_{d}"] = F.when(seen(against, w.rowsBetween(-back, -1)), "DISP_BEFORE").when(seen(d, w.rowsBetween(0, ahead)), "DISP_AFTER")
    tags = b.select(*KEY, "bar_index", *[c.alias(k) for k, c in near.items()])
    out = events.join(tags.hint("merge"), [*KEY, "bar_index"], "left").withColumn("qualification", F.when(F.col("direction") == "bullish", F.col("_bullish")).otherwise(F.col("_bearish")))
    return out.drop("_bullish", "_bearish")


def with_created_gap(displacements: DataFrame, gaps: DataFrame, least_gap: float) -> DataFrame:
    """Adds created_fvg: a gap of `least_gap` pips or more has the displacement's first bar in its middle."""
    middle = gaps.where(F.col("gap_pips") >= least_gap).select(*KEY, (F.col("bar_index") - 1).alias("bar_index"), F.lit(True).alias("_made"))
    return displacements.join(middle.hint("merge"), [*KEY, "bar_index"], "left").withColumn("created_fvg", F.coalesce("_made", F.lit(False))).drop("_made")
