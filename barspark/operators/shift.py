"""Structure shifts: breaks of the latest pivot that a displacement confirms, with suppression after each.

What a bar needs to know is computed with windows; the suppression depends on what was found before. But all that goes
from one forex day into the next is how many of its first bars are still skipped, and whether either pivot that is the
latest as the day begins was used up. So each day is folded by itself, once for each of these few states, the days of
a series are chained by their small tables of states, and each day's branch is picked by a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import stored
from .bars import KEY, series

DAY = (*KEY, "forex_day")


def _features(bars: DataFrame, swings: DataFrame, disp: DataFrame, window: int) -> DataFrame:
    """Per bar: the latest pivots before it with the two before those, and the confirming displacement of either direction."""
    w = series()
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    sides = swings.withColumn("before", F.lag("price").over(Window.partitionBy(*KEY, "side").orderBy("bar_index"))).withColumn("before2", F.lag("price", 2).over(Window.partitionBy(*KEY, "side").orderBy("bar_index")))
    other = Window.partitionBy(*KEY).orderBy("bar_index").rangeBetween(Window.unboundedPreceding, -1)
    sides = sides.withColumns({"lows": F.count_if(F.col("side") == "low").over(other), "highs": F.count_if(F.col("side") == "high").over(other)})
    per = sides.groupBy(*KEY, "bar_index").pivot("side", ["high", "low"]).agg(F.first(F.struct(F.col("bar_index").alias("at"), "price", "before", "before2", "lows", "highs")).alias("p")).withColumnsRenamed({"high": "p_high", "low": "p_low"})
    starts = disp.select(*KEY, "bar_index", F.struct(F.col("bar_index").alias("at"), F.col("bar_index_end").alias("end"), "direction").alias("d"))
    ends = disp.where("bar_index_end > bar_index").select(*KEY, F.col("bar_index_end").alias("bar_index"), F.struct(F.col("bar_index").alias("at"), F.col("bar_index_end").alias("end"), "direction").alias("e"))
    b = bars.join(per, [*KEY, "bar_index"], "left").join(starts, [*KEY, "bar_index"], "left").join(ends, [*KEY, "bar_index"], "left").withColumn("d", F.coalesce("d", "e")).drop("e")
    for side in ("high", "low"):
        b = b.withColumn(f"_{side}", F.last(f"p_{side}", True).over(past))

    def confirmed(direction: str) -> Column:
        found = []
        for k in range(-1, window + 1):
            d = F.lag("d", -k).over(w) if k < 0 else F.lead("d", k).over(w)
            good = (d["direction"] == direction) & ((d["end"] >= F.col("bar_index")) | F.lit(k >= 0))
            found.append(F.when(good, d))
        return F.coalesce(*found)

    b = b.withColumns({"up": confirmed("bullish"), "down": confirmed("bearish")})
    names = {f"{s}_{c}": F.col(f"_{s}.{c}") for s in ("high", "low") for c in ("at", "price", "before", "before2", "lows", "highs")}
    reach = lambda c, of: F.array(*[of(c).over(w.rowsBetween(0, k)) for k in range(window + 2)])
    b = b.withColumns({"tops": reach("high", F.max), "bottoms": reach("low", F.min)})
    return b.select(*KEY, "bar_index", "high", "low", "close", "is_ghost", "forex_day", "atr", "tops", "bottoms", F.col("d.direction").alias("here"), F.col("up.at").alias("up_at"), F.col("up.end").alias("up_end"), F.col("down.at").alias("down_at"), F.col("down.end").alias("down_end"), *[v.alias(k) for k, v in names.items()])


def _let(values: dict[str, Column], then) -> Column:
    """`then` of a struct of the values, each computed once."""
    return F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), then)[0]


def _step(least: float, pullback_atr: float):
    """The fold over the bars of a day. Its state: direction of the shift that suppresses (`carried` from the day before), extreme, last bar to skip, the last pivot used up of either side, and the shifts found."""

    def step(s: Column, r: Column) -> Column:
        up = s["direction"] == "bullish"
        skip = (r["bar_index"] < 1) | (s["direction"].isNotNull() & (r["bar_index"] <= s["until"]))
        back = F.when(up, s["extreme"] - r["low"]).otherwise(r["high"] - s["extreme"])
        free = s["direction"].isNull() | (s["direction"] == "carried") | (back >= F.greatest(F.lit(least), pullback_atr * F.coalesce(r["atr"], F.lit(0.0)))) | (r["here"].isNotNull() & (r["here"] != s["direction"]))
        broken = lambda side, past: r[f"{side}_at"].isNotNull() & past & ~s[f"used_{side}"].eqNullSafe(r[f"{side}_at"])
        high, low = broken("high", r["close"] > r["high_price"]), broken("low", r["close"] < r["low_price"])
        first = {"skip": skip, "live": ~skip & F.coalesce(free, F.lit(False)), "high": F.coalesce(high, F.lit(False)), "low": F.coalesce(low, F.lit(False))}
        second = lambda f: {"skip": f["skip"], "live": f["live"], "high": f["live"] & f["high"], "up": f["live"] & f["high"] & r["up_at"].isNotNull(), "low": f["live"] & f["low"]}
        third = lambda f: {"skip": f["skip"], "live": f["live"], "high": f["high"], "up": f["up"], "low": f["low"] & ~f["up"], "down": f["low"] & ~f["up"] & r["down_at"].isNotNull(), "until": F.greatest(r["bar_index"], F.when(f["up"], r["up_end"]).otherwise(r["down_end"]))}

        def after(f: Column) -> Column:
            hit, held = f["up"] | f["down"], ~f["skip"] & ~f["live"]
            ahead = f["until"] - r["bar_index"] + 1
            found = F.struct(
                r["bar_index"].alias("bar_index"), F.when(f["up"], "bullish").otherwise("bearish").alias("direction"), F.when(F.when(f["up"], r["turned_up"]).otherwise(r["turned_down"]), "REVERSAL").otherwise("CONTINUATION").alias("break_type"),
                F.when(f["up"], r["high_at"]).otherwise(r["low_at"]).alias("pivot_bar"), F.when(f["up"], r["high_price"]).otherwise(r["low_price"]).alias("pivot_price"), F.when(f["up"], r["up_at"]).otherwise(r["down_at"]).alias("displacement_bar"), F.when(f["up"], r["up_end"]).otherwise(r["down_end"]).alias("displacement_end"),
            )
            return F.struct(
                F.when(f["up"], "bullish").when(f["down"], "bearish").when(f["skip"] | held, s["direction"]).alias("direction"),
                F.when(f["up"], F.get(r["tops"], ahead - 1)).when(f["down"], F.get(r["bottoms"], ahead - 1)).when(held & up, F.greatest(s["extreme"], r["high"])).when(held, F.least(s["extreme"], r["low"])).otherwise(s["extreme"]).alias("extreme"),
                F.when(hit, f["until"]).otherwise(s["until"]).alias("until"), F.when(f["high"], r["high_at"]).otherwise(s["used_high"]).alias("used_high"), F.when(f["low"], r["low_at"]).otherwise(s["used_low"]).alias("used_low"),
                F.when(hit, F.concat(s["shifts"], F.array(found))).otherwise(s["shifts"]).alias("shifts"),
            )

        return _let(first, lambda f: _let(second(f), lambda g: _let(third(g), after)))

    return step


_SHIFT = "array<struct<bar_index:int,direction:string,break_type:string,pivot_bar:int,pivot_price:double,displacement_bar:int,displacement_end:int>>"


def structure_shifts(bars: DataFrame, swings: DataFrame, disp: DataFrame, pip: float, window: int = 3, pullback_pips: float = 5.0, pullback_atr: float = 0.25, gaps: DataFrame | None = None, least_gap: float = 0.5) -> DataFrame:
    """Shifts of `bars` (with atr) from `swings` and the qualifying displacements `disp`, confirmed from the bar before to `window` bars after (3 on short timeframes, 1 from 1H on).

    After a shift nothing is looked for until price comes back from its extreme by max(pullback_pips, pullback_atr ATR), an
    opposite displacement stands at the bar, or the forex day changes. A pivot that was broken is used up, confirmed or not.
    With `gaps` (bar_index, gap_pips) there is fvg_created, too: a gap of `least_gap` pips has a bar of the displacement in its middle.
    No group is larger than a day's bars, but for one small row for each day when the days are chained.
    """
    f = _features(bars, swings, disp, window)
    turned = lambda one, two, others, falls: two.isNotNull() & (others >= 2) & (one < two if falls else one > two)
    f = f.withColumns({"turned_up": turned(F.col("high_before"), F.col("high_before2"), F.col("high_lows"), True), "turned_down": turned(F.col("low_before"), F.col("low_before2"), F.col("low_highs"), False)})
    integers = ("bar_index", "up_at", "up_end", "down_at", "down_end", "high_at", "low_at")
    row = F.struct("bar_index", *[F.col(c).cast("int").alias(c) for c in integers[1:]], "high", "low", "close", "atr", "here", "tops", "bottoms", "high_price", "low_price", "turned_up", "turned_down")
    f = f.withColumn("bar_index", F.col("bar_index").cast("int"))
    days = f.groupBy(*DAY).agg(F.array_sort(F.collect_list(F.when(~F.col("is_ghost"), row))).alias("rows"), F.min("bar_index").alias("first"), F.min_by("high_at", "bar_index").cast("int").alias("high_at"), F.min_by("low_at", "bar_index").cast("int").alias("low_at"))
    # The states in which a day can begin: bars skipped, and either pivot used up or not.
    states = F.array(*[F.struct(F.lit(k).alias("skipped"), F.lit(h).alias("high"), F.lit(x).alias("low")) for k in range(window + 2) for h in (False, True) for x in (False, True)])

    def begun(b: Column) -> Column:
        return F.struct(
            F.when(b["skipped"] > 0, "carried").alias("direction"), F.lit(None).cast("double").alias("extreme"), (F.col("first") + b["skipped"] - 1).cast("int").alias("until"), F.when(b["high"], F.col("high_at")).alias("used_high"), F.when(b["low"], F.col("low_at")).alias("used_low"),
            F.array().cast(_SHIFT).alias("shifts"),
        )

    branches = F.transform(states, lambda b: F.struct(b.alias("state"), F.aggregate("rows", begun(b), _step(pullback_pips * pip, pullback_atr)).alias("end")))
    folded = stored(days.select(*DAY, "first", "high_at", "low_at", branches.alias("branches")), "folded")
    # Chained: what a day leaves is the state of the next. The arrays hold states only, a few numbers for each day.
    ends = F.transform("branches", lambda b: F.struct(b["state"].alias("state"), b["end"]["until"].alias("until"), b["end"]["used_high"].alias("used_high"), b["end"]["used_low"].alias("used_low")))
    small = folded.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("forex_day", "first", "high_at", "low_at", ends.alias("ends")))).alias("days"))
    state = lambda d, left: F.struct(F.greatest(F.lit(0), F.least(F.lit(window + 1), left["until"] - d["first"] + 1)).alias("skipped"), F.coalesce(left["used_high"] == d["high_at"], F.lit(False)).alias("high"), F.coalesce(left["used_low"] == d["low_at"], F.lit(False)).alias("low"))
    nothing = F.struct(F.lit(-1).alias("until"), F.lit(None).cast("int").alias("used_high"), F.lit(None).cast("int").alias("used_low"), F.array().cast("array<struct<forex_day:date,state:struct<skipped:int,high:boolean,low:boolean>>>").alias("done"))

    def chain(left: Column, d: Column) -> Column:
        def picked(x: Column) -> Column:
            end = F.filter(d["ends"], lambda e: e["state"] == x["state"])[0]
            return F.struct(end["until"].alias("until"), F.coalesce(end["used_high"], left["used_high"]).alias("used_high"), F.coalesce(end["used_low"], left["used_low"]).alias("used_low"), F.concat(left["done"], F.array(F.struct(d["forex_day"].alias("forex_day"), x["state"].alias("state")))).alias("done"))

        return _let({"state": state(d, left)}, picked)

    chosen = small.select(*KEY, F.explode(F.aggregate("days", nothing, chain, lambda s: s["done"])).alias("d")).select(*KEY, "d.*")
    met = folded.join(chosen.hint("merge"), list(DAY))
    shifts = F.filter("branches", lambda b: b["state"] == F.col("state"))[0]["end"]["shifts"]
    out = met.select(*KEY, F.explode(shifts).alias("s")).select(*KEY, "s.*").withColumn("window_used", F.col("displacement_bar") - F.col("bar_index"))
    if gaps is not None:
        made = gaps.where(F.col("gap_pips") >= least_gap).select(*KEY, (F.col("bar_index") - 1).alias("_bar"), F.lit(True).alias("_made")).distinct()
        each = out.withColumn("_bar", F.explode(F.array_distinct(F.array("displacement_bar", "displacement_end"))))
        out = each.join(made.hint("merge"), [*KEY, "_bar"], "left").groupBy(*out.columns).agg(F.coalesce(F.max("_made"), F.lit(False)).alias("fvg_created"))
    return out.drop("displacement_end")
