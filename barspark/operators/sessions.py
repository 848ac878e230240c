"""Levels and boxes of sessions and days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bars import KEY, series

# Thresholds of the asia range, and the boxes with the session or hours and the cap on their range.
ASIA_THRESHOLDS = (12, 15, 18, 20, 25, 30)
BOXES = (("ASIA_BOX", "asia", 30.0), ("PRE_LONDON_BOX", "pre_london", 15.0), ("PRE_NY_BOX", "pre_ny", 20.0))
LEVEL_SESSIONS = ("asia", "pre_london", "lokz", "pre_ny", "nyokz")


def session_levels(bars: DataFrame) -> DataFrame:
    """High and low of each session of a forex day, a row for each side."""
    wide = bars.where(F.col("session").isin(*LEVEL_SESSIONS)).groupBy(*KEY, "forex_day", "session").agg(F.max("high").alias("high"), F.min("low").alias("low"))
    return wide.unpivot([*KEY, "forex_day", "session"], ["high", "low"], "side", "price")


def asia_range(bars: DataFrame, pip: float, thresholds: tuple[int, ...] = ASIA_THRESHOLDS) -> DataFrame:
    """Range of the asia session of each forex day, TIGHT below each threshold, else WIDE."""
    day = bars.where("session = 'asia'").groupBy(*KEY, "forex_day").agg(F.max("high").alias("high"), F.min("low").alias("low"), F.count("*").alias("bar_count"))
    day = day.withColumn("range_pips", F.round((F.col("high") - F.col("low")) / pip, 1))
    kinds = F.create_map(*[x for t in thresholds for x in (F.lit(str(t)), F.when(F.col("range_pips") < t, "TIGHT").otherwise("WIDE"))])
    return day.withColumn("classifications", kinds)


def asia_matrix(ranges: DataFrame) -> DataFrame:
    """Tight and wide days for each threshold."""
    each = ranges.select("symbol", F.explode("classifications").alias("threshold", "kind"))
    return each.groupBy("symbol", "threshold").agg(F.count_if(F.col("kind") == "TIGHT").alias("tight"), F.count_if(F.col("kind") == "WIDE").alias("wide"))


def reference_levels(bars: DataFrame) -> DataFrame:
    """High, low and midnight open of each forex day, those of the day before with their middle, and the series' extremes."""
    early = F.hour("ts_ny") < 17
    day = bars.groupBy(*KEY, "forex_day").agg(
        F.max("high").alias("day_high"), F.min("low").alias("day_low"),
        F.coalesce(F.min_by(F.when(early, F.col("open")), F.when(early, F.col("bar_index"))), F.min_by("open", "bar_index")).alias("midnight_open"),
    )
    w = series("forex_day")
    every = Window.partitionBy(*KEY)
    day = day.withColumns({"pdh": F.lag("day_high").over(w), "pdl": F.lag("day_low").over(w), "pwh": F.max("day_high").over(every), "pwl": F.min("day_low").over(every)})
    return day.withColumn("equilibrium", (F.col("pdh") + F.col("pdl")) / 2)


def session_boxes(bars: DataFrame, pip: float, efficiency: float = 0.60, crosses: int = 2, balance: float = 0.30) -> DataFrame:
    """Boxes of three bars or more, consolidating if all gates hold, with the first times that later bars of the day pass either side."""
    kinds = F.when(F.lit(False), F.lit(None).cast("string"))
    caps = F.when(F.lit(False), F.lit(None).cast("double"))
    for name, session, cap in BOXES:
        kinds, caps = kinds.when(F.col("session") == session, name), caps.when(F.col("box") == name, cap)
    day = [*KEY, "forex_day"]
    inside = bars.withColumn("box", kinds).where("box is not null")
    both = Window.partitionBy(*day, "box")
    mid = (F.max("high").over(both) + F.min("low").over(both)) / 2
    inside = inside.withColumn("mid", mid).withColumn("before", F.lag("close").over(both.orderBy("bar_index")))
    crossing = ((F.col("before") < F.col("mid")) & (F.col("close") > F.col("mid"))) | ((F.col("before") > F.col("mid")) & (F.col("close") < F.col("mid")))
    box = inside.groupBy(*day, "box").agg(
        F.max("high").alias("high"), F.min("low").alias("low"), F.count("*").alias("bar_count"), F.first("mid").alias("mid"), F.max("bar_index").alias("last_bar"),
        F.min_by("open", "bar_index").alias("first_open"), F.max_by("close", "bar_index").alias("last_close"), F.min("ts_ny").alias("start_time"), F.max("ts_ny").alias("end_time"),
        F.count_if(crossing).alias("mid_cross_count"), F.count_if(F.col("close") > F.col("mid")).alias("above"), F.count_if(F.col("close") < F.col("mid")).alias("below"),
    ).where("bar_count >= 3")
    spread, net = (F.col("high") - F.col("low")) / pip, F.abs(F.col("last_close") - F.col("first_open")) / pip
    box = box.withColumns({"range": spread, "efficiency": F.when(spread > 0, net / spread).otherwise(0.0), "balance_score": F.least("above", "below") / F.col("bar_count")})
    calm = (F.col("range") <= caps) & (F.col("efficiency") <= efficiency) & (F.col("mid_cross_count") >= crosses) & (F.col("balance_score") >= balance)
    box = box.withColumn("classification", F.when(calm, "CONSOLIDATION_BOX").otherwise("TREND_OR_EXPANSION"))
    box = box.withColumn("trend_direction", F.when(~calm, F.when(F.col("last_close") > F.col("first_open"), "UP").otherwise("DOWN")))
    later = bars.select(*day, F.col("bar_index").alias("b"), F.col("ts_ny").alias("t"), F.col("high").alias("bh"), F.col("low").alias("bl"), F.col("close").alias("bc"))
    joined = box.select(*day, "box", "last_bar", F.col("high").alias("h"), F.col("low").alias("l")).join(later, day).where("b > last_bar")
    first = lambda condition, name: F.min(F.when(F.expr(condition), F.col("t"))).alias(name)
    tests = [first(f"{price} {sign} {level}", f"{side}_{verb}_{word}") for side, level in (("high", "h"), ("low", "l")) for verb, prices in (("traded", ("bh", "bl")), ("closed", ("bc", "bc"))) for price, sign, word in ((prices[0], ">", "above"), (prices[1], "<", "below"))]
    found = joined.groupBy(*day, "box").agg(*tests)
    return box.join(found, [*day, "box"], "left").drop("above", "below", "first_open", "last_close")


def session_coverage(bars: DataFrame, bars_per_hour: int) -> DataFrame:
    """Bars of each session of a forex day, and their share of what the session's hours would hold."""
    # Hours of each session.
    hours = F.create_map(*[x for k, v in (("asia", 5), ("pre_london", 2), ("lokz", 3), ("pre_ny", 2), ("nyokz", 3), ("other", 9)) for x in (F.lit(k), F.lit(v))])
    per = bars.groupBy(*KEY, "forex_day", "session").agg(F.count("*").alias("bars"))
    return per.withColumn("coverage", F.round(F.col("bars") / (F.element_at(hours, F.col("session")) * bars_per_hour), 4))


def session_close(session: Column, day: Column) -> Column:
    """When asia (midnight) and lokz (five o'clock) of a forex day are over; null for others."""
    return F.when(session == "asia", day.cast("timestamp_ntz")).when(session == "lokz", day.cast("timestamp_ntz") + F.expr("INTERVAL 5 HOURS"))


def carried_levels(levels: DataFrame, bars: DataFrame) -> DataFrame:
    """Levels of asia and lokz under the series' next forex day, named prev_, valid from the end of their session."""
    days = bars.select(*KEY, "forex_day").distinct().withColumn("from_day", F.lag("forex_day").over(series("forex_day")))
    old = levels.where(F.col("session").isin("asia", "lokz")).withColumnRenamed("forex_day", "from_day")
    valid = session_close(F.col("session"), F.col("from_day")).alias("valid_from")
    return old.join(days, [*KEY, "from_day"]).select(*KEY, "forex_day", "from_day", F.concat(F.lit("prev_"), "session").alias("session"), "side", "price", valid)
