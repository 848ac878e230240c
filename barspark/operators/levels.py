"""The pool of price levels that sweeps are looked for at: gathered from sessions, days, boxes, pools and pivots, without doubles, merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import sessions
from .bars import KEY

# Sources by priority; ranks of timeframes; sessions in order; strength and height from which a pivot counts.
SOURCES = ("PROMOTED_SWING", "PDH_PDL", "PWH", "PWL", "HTF_EQH", "HTF_EQL", "LONDON_H_L", "ASIA_H_L", "LTF_BOX", "SWEEP_EVENT")
TF_RANKS = {"MN": 5, "W1": 4, "1D": 3, "4H": 2, "1H": 1}
LEAST_STRENGTH, LEAST_HEIGHT = 10, 10.0
_COLUMNS = (*KEY, "side", "source", "level_id", "price", "valid_from", "forex_day", "level_bar", "raw")


def _rows(df: DataFrame, source: Column | str, id_: Column, place: tuple[Column, ...], valid: Column, day: Column | None = None, bar: Column | None = None) -> DataFrame:
    """`place`: group, and up to three numbers and a text, which tell in what order levels came up."""
    group, numbers = place[0], [*place[1:], F.lit(0), F.lit(0), F.lit(0)][:3]
    raw = F.struct(group.cast("int").alias("group"), *[n.cast("long").alias(f"n{k}") for k, n in enumerate(numbers)], F.col("price").alias("price"))
    return df.select(*KEY, "side", (F.lit(source) if isinstance(source, str) else source).alias("source"), id_.alias("level_id"), F.col("price").cast("double").alias("price"), valid.cast("timestamp_ntz").alias("valid_from"),
                     (day if day is not None else F.lit(None)).cast("date").alias("forex_day"), (bar if bar is not None else F.lit(0)).cast("int").alias("level_bar"), raw.alias("raw"))


def gathered(bars: DataFrame, swings: DataFrame, pip: float, pools: DataFrame | None = None) -> DataFrame:
    """All levels of each series with the time from which each is valid: high and low of asia and lokz from the session's
    end, of the day before from 17:00, of session boxes from the box's end, of the whole series from 17:00 before its
    first week, of untaken pools (`pools`: symbol, tf of the series, pool_tf, side, price, valid_from) from their last touch, and
    strong pivots from their own time.
    """
    high = F.col("side") == "high"
    word = lambda up, down: F.when(high, up).otherwise(down)
    number = F.datediff("forex_day", F.lit("1970-01-01"))
    low_last = F.when(high, 0).otherwise(1)
    s = sessions.session_levels(bars).where(F.col("session").isin("asia", "lokz"))
    place = (F.lit(1), number, F.when(F.col("session") == "asia", 0).otherwise(1), low_last)
    found = [_rows(s, F.when(F.col("session") == "asia", "ASIA_H_L").otherwise("LONDON_H_L"), F.concat_ws("_", "session", word("H", "L"), "forex_day"), place, sessions.session_close(F.col("session"), F.col("forex_day")), F.col("forex_day"))]
    days = sessions.reference_levels(bars)
    before = days.unpivot([*KEY, "forex_day"], ["pdh", "pdl"], "which", "price").where("price is not null").withColumn("side", F.when(F.col("which") == "pdh", "high").otherwise("low"))
    found.append(_rows(before, "PDH_PDL", F.concat_ws("_", word("PDH", "PDL"), "forex_day"), (F.lit(2), number, low_last), F.col("forex_day").cast("timestamp_ntz") - F.expr("INTERVAL 7 HOURS"), F.col("forex_day")))
    boxes = sessions.session_boxes(bars, pip).unpivot([*KEY, "forex_day", "box", "end_time"], ["high", "low"], "side", "price")
    order = F.when(F.col("box") == "ASIA_BOX", 0).when(F.col("box") == "PRE_LONDON_BOX", 1).otherwise(2)
    found.append(_rows(boxes, "LTF_BOX", F.concat_ws("_", "box", "forex_day", word("H", "L")), (F.lit(3), number, order, low_last), F.col("end_time"), F.col("forex_day")))
    if pools is not None:
        rank = F.element_at(F.create_map(*[F.lit(x) for kv in TF_RANKS.items() for x in kv]), F.col("pool_tf"))
        name = word("HTF_EQH", "HTF_EQL")
        found.append(_rows(pools, name, F.concat_ws("_", name, "pool_tf", F.format_string("%.5f", "price")), (F.lit(4), -F.coalesce(rank, F.lit(0)), low_last), F.col("valid_from")))
    week = days.groupBy(*KEY).agg(F.max("day_high").alias("high"), F.min("day_low").alias("low"), F.date_trunc("week", F.min("forex_day")).cast("timestamp_ntz").alias("monday")).unpivot([*KEY, "monday"], ["high", "low"], "side", "price")
    found.append(_rows(week, word("PWH", "PWL"), word("PWH", "PWL"), (F.lit(5), low_last), F.col("monday") - F.expr("INTERVAL 7 HOURS")))
    strong = swings.where((F.col("strength") >= LEAST_STRENGTH) & (F.col("height_pips") >= LEAST_HEIGHT))
    found.append(_rows(strong, "PROMOTED_SWING", F.concat_ws("_", F.lit("PS"), "bar_index", "side"), (F.lit(0), F.col("bar_index"), low_last), F.col("ts_ny"), F.col("forex_day"), F.col("bar_index")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select(*_COLUMNS)


def level_pool(levels: DataFrame, pip: float, tf: str, within: float = 1.0, same: float = 0.1) -> DataFrame:
    """The levels that count on bars of `tf`: of equal ones (one source and side, prices alike to `same` pips) the first, then neighbours merged.

    Levels of a side and day merge with the lowest of their pool if they are at most `within` pips above it; the pool goes
    by its member of the best source. Pivots stay single, and don't count on 1m and 5m. Levels of one series, side and
    day are all that is ever gathered in a row. `place` numbers the levels of a series in the order in which they are tried.
    """
    swings = levels.where("source = 'PROMOTED_SWING'").select(*_COLUMNS, F.array("source").alias("sources_merged"), F.lit(1).alias("touch_count"), F.col("raw").alias("first"), F.lit(None).cast("int").alias("k"))
    others = levels.where("source <> 'PROMOTED_SWING'")
    double = Window.partitionBy(*KEY, "source", "side", F.bround(F.col("price") / (same * pip)))
    others = others.withColumn("_n", F.row_number().over(double.orderBy("raw", "level_id"))).where("_n = 1").drop("_n")
    priority = F.element_at(F.create_map(*[F.lit(x) for k, s in enumerate(SOURCES) for x in (s, k)]), F.col("source"))
    member = F.struct("price", "raw", priority.alias("priority"), "source", "level_id", "valid_from", "level_bar")
    days = others.groupBy(*KEY, "side", "forex_day").agg(F.array_sort(F.collect_list(member)).alias("members"), F.min("raw").alias("first"))
    # A pool is the array of its members; the lowest comes first.
    none = F.filter(F.array(F.col("members")), lambda x: F.lit(False))
    near = lambda pools, m: (F.size(pools) > 0) & (F.abs(m["price"] - F.element_at(F.element_at(pools, -1), 1)["price"]) <= within * pip)
    joined = lambda pools, m: F.concat(F.slice(pools, 1, F.size(pools) - 1), F.array(F.concat(F.element_at(pools, -1), F.array(m))))
    merged = F.aggregate("members", none, lambda pools, m: F.when(near(pools, m), joined(pools, m)).otherwise(F.concat(pools, F.array(F.array(m)))))
    pools = days.select(*KEY, "side", "forex_day", "first", F.posexplode(merged).alias("k", "pool"))
    ranked = F.array_sort(F.transform("pool", lambda m, i: F.struct(m["priority"].alias("priority"), i.alias("i"), m.alias("m"))))
    best = ranked[0]["m"]
    pools = pools.select(*KEY, "side", best["source"].alias("source"), best["level_id"].alias("level_id"), best["price"].alias("price"), best["valid_from"].alias("valid_from"), "forex_day", best["level_bar"].alias("level_bar"), best["raw"].alias("raw"), F.transform(ranked, lambda x: x["m"]["source"]).alias("sources_merged"), F.size("pool").alias("touch_count"), "first", "k")
    out = pools if tf in ("1m", "5m") else swings.unionByName(pools)
    return out.withColumn("place", F.row_number().over(Window.partitionBy(*KEY).orderBy("first", F.col("side").desc(), "k", "level_id")).cast("long")).drop("raw", "first", "k")
