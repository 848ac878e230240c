"""Sweeps of price levels: bars that pass a level and close back, go on beyond it, or use it up.

Whether a bar's breach of a level is a sweep, a continuation or a mere probe follows from the two and the next few bars
alone. So breaches come from a join of levels with the bars beyond them, and each level's own end (its first sweep or
continuation, or its fifth probe in a row) from a window over its breaches. Levels that sweeps create are looked up in
the same way, twice. What ties levels together is that a bar that ends one level uses up all others on its side
that it crosses: the possible ends of a series and side, one for each level, are gone through in order in one
`aggregate`, which keeps those whose level was still there.

A series should be as long as its levels stay of interest, such as an ISO week: see `in_chunks`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import boundaries_between, map_session
from ..sources.store import stored
from .bars import KEY, with_bar_index

# Fixed values by timeframe (others as 5m, but for two closes): least breach and reclaim in pips, bars within which a close
# has to come back, closes beyond a level that use it up. For all: greatest breach of a sweep in ATR, least rejection, bars for
# which a pivot counts, probes that use a level up, bars without that start them anew, generations of levels that sweeps create, and
# the session boundaries that these live through.
FLOORS, WINDOWS, DWELLS = {"1m": 0.5, "5m": 0.5, "15m": 1.0}, {"1m": 2, "5m": 3, "15m": 4}, {"1m": 3, "5m": 3, "15m": 2}
MOST_ATR, REJECTION, STALE, PROBES, RESET, GENERATIONS, BOUNDARIES = 1.5, 0.40, 20, 5, 3, 2, 3
DWELL_BREACH, DELAYED_REJECTION = 0.5, 0.30

SIDE = (*KEY, "side")
LEVEL = (*SIDE, "level_id")


def in_chunks(bars: DataFrame, chunk: Column) -> DataFrame:
    """Bars as series of their own for each chunk (a week, a window): its name is put behind the symbol's, and bars are numbered anew. All that is then computed starts afresh in each."""
    return with_bar_index(bars.withColumn("symbol", F.concat_ws("|", "symbol", chunk)))


def of_chunks(df: DataFrame) -> DataFrame:
    """Takes the names of `in_chunks` apart again: symbol and chunk."""
    return df.withColumns({"symbol": F.regexp_extract("symbol", r"^(.*)\|([^|]*)$", 1), "chunk": F.regexp_extract("symbol", r"^(.*)\|([^|]*)$", 2)})


def _mirrored(bars: DataFrame, ahead: int) -> DataFrame:
    """Bars once for each side, with the `ahead` closes and times from each on. Prices of the low side are negated, so that every level is a ceiling."""
    w = Window.partitionBy(*KEY).orderBy("bar_index")
    lead = lambda c: F.array(*[F.lead(c, k).over(w) for k in range(ahead)])
    b = bars.select(*KEY, "bar_index", "ts_ny", "session", "forex_day", "is_ghost", "atr", "open", "high", "low", lead("close").alias("closes"), lead("ts_ny").alias("times"), lead("session").alias("sessions"))
    same = ["bar_index", "ts_ny", "session", "forex_day", "is_ghost", "atr", "times", "sessions"]
    up = F.struct(F.lit("high").alias("side"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("closes").alias("c"))
    down = F.struct(F.lit("low").alias("side"), (-F.col("open")).alias("o"), (-F.col("low")).alias("h"), (-F.col("high")).alias("l"), F.transform("closes", lambda x: -x).alias("c"))
    return b.select(*KEY, *same, F.explode(F.array(up, down)).alias("b")).select(*KEY, *same, "b.*")


def _valid(levels_from: Column, at: Column) -> Column:
    return levels_from.isNull() | (at >= levels_from)


def _back(closes: Column, p: Column, n: int) -> Column:
    """How many bars later the first of n closes is back below p; null if none is."""
    return reduce(lambda later, k: F.when(closes[k] < p, k).otherwise(later), reversed(range(n)), F.lit(None).cast("int"))


def _rejection(p: Column) -> Column:
    """On the breaching bar its upper wick by its range, later the reclaim by all of the way back."""
    spread = F.col("h") - F.col("l")
    one = F.when(spread > 0, (F.col("h") - F.greatest("o", F.col("c")[0])) / spread).otherwise(0.0)
    reclaim = p - F.col("c")[F.col("back")]
    total = F.col("h") - p + reclaim
    return F.when(F.col("back") == 0, one).otherwise(F.when(total > 0, reclaim / total).otherwise(0.0))


def breaches(levels: DataFrame, mirrored: DataFrame, tf: str, pip: float) -> DataFrame:
    """All bars that breach a level while it counts, as `sweep`, `continuation` or `probe`. `levels` have p, the mirrored price."""
    floor, n = FLOORS.get(tf, 0.5) * pip, WINDOWS.get(tf, 3)
    usable = mirrored.where(~F.col("is_ghost") & F.col("atr").isNotNull()).withColumnRenamed("forex_day", "day").hint("merge")
    age = F.col("bar_index") - F.col("level_bar")
    pivot = (age > 0) & (age <= STALE) & (F.col("forex_day").isNull() | F.col("day").isNull() | (F.col("forex_day") == F.col("day")))
    event = (F.col("ts_ny") > F.col("valid_from")) & (boundaries_between(F.col("valid_from"), F.col("ts_ny")) <= BOUNDARIES)
    gate = F.when(F.col("source") == "PROMOTED_SWING", pivot).when(F.col("source") == "SWEEP_EVENT", event).otherwise(_valid(F.col("valid_from"), F.col("ts_ny")))
    p = F.col("p")
    met = levels.join(usable, list(SIDE)).where((F.col("h") > p) & (F.col("h") - p >= floor) & gate)
    met = met.withColumn("back", _back(F.col("c"), p, n))
    reclaim = p - F.col("c")[F.col("back")]
    met = met.withColumns({"breach": F.col("h") - p, "reclaim": reclaim, "rejection": _rejection(p)})
    swept = F.coalesce((reclaim >= floor) & (F.col("rejection") >= REJECTION), F.lit(False))
    return met.withColumn("kind", F.when(swept, "sweep").when(F.col("breach") > MOST_ATR * F.col("atr"), "continuation").otherwise("probe"))


def _ends(levels: DataFrame, mirrored: DataFrame, tf: str, pip: float) -> DataFrame:
    """Each level with the breach that would end it; levels without are left out."""
    own = Window.partitionBy(*LEVEL).orderBy("bar_index")
    b = breaches(levels, mirrored, tf, pip)
    gap = F.col("bar_index") - F.lag("bar_index").over(own)
    b = b.withColumn("run", F.sum(F.when(gap >= RESET, 1).otherwise(0)).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    b = b.withColumn("probes", F.row_number().over(Window.partitionBy(*LEVEL, "run").orderBy("bar_index")))
    b = b.where((F.col("kind") != "probe") | (F.col("probes") >= PROBES))
    row = F.struct("bar_index", "ts_ny", "session", "day", "h", "l", "kind", "back", "breach", "reclaim", "rejection", F.col("times")[F.col("back")].alias("confirmed"), F.col("sessions")[F.col("back")].alias("confirm_session"))
    return b.groupBy(*LEVEL).agg(F.min(row).alias("end"))


def _created(ended: DataFrame) -> DataFrame:
    """The levels that sweeps would create, at the extreme of the breach and valid after the confirming bar. Their place is behind all that were there before."""
    at = F.col("end.bar_index")
    return ended.where("end.kind = 'sweep'").select(
        *SIDE, F.concat_ws(">", "level_id", at.cast("string")).alias("level_id"), F.lit("SWEEP_EVENT").alias("source"), F.col("end.h").alias("p"), F.col("end.confirmed").alias("valid_from"), F.col("end.day").alias("forex_day"),
        (at + F.col("end.back")).cast("int").alias("level_bar"), F.array(F.lit("SWEEP_EVENT")).alias("sources_merged"), F.lit(1).alias("touch_count"), F.concat(F.array(F.lit(1).cast("long"), at.cast("long")), "place").alias("place"), F.col("level_id").alias("parent"), (F.col("generation") + 1).alias("generation"),
    )


def level_fates(bars: DataFrame, levels: DataFrame, tf: str, pip: float) -> DataFrame:
    """Every level that came to exist, with its `end`, the struct of the breach that ended it, or null, and `crossed`, the bar that used it up before, or null.

    `bars` have atr; `levels` as from level_pool. Levels that sweeps create are named after their parent and the bar.
    """
    mirrored = stored(_mirrored(bars, WINDOWS.get(tf, 3)), "mirrored")
    sign = F.when(F.col("side") == "high", 1.0).otherwise(-1.0)
    born = levels.select(*SIDE, "level_id", "source", (sign * F.col("price")).alias("p"), "valid_from", "forex_day", "level_bar", "sources_merged", "touch_count", F.array(F.lit(0).cast("long"), "place").alias("place"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("generation"))
    generations = []
    for g in range(GENERATIONS + 1):
        born = stored(born, "levels")
        ended = stored(born.join(_ends(born, mirrored, tf, pip).hint("merge"), list(LEVEL), "left"), "ended")
        generations.append(ended)
        if g < GENERATIONS:
            born = _created(ended)
    every = reduce(DataFrame.unionByName, generations)

    # The ends of a series and side in order of bar and place; kept are those whose level was still there.
    ends = every.where("end is not null").groupBy(*SIDE).agg(F.array_sort(F.collect_list(F.struct(F.col("end.bar_index").alias("i"), "place", "level_id", "p", "valid_from", "parent", F.col("end.kind").alias("kind"), F.col("end.h").alias("h"), F.col("end.l").alias("l"), F.col("end.ts_ny").alias("t")))).alias("ends"))
    inside = lambda by, x: (by["kind"] != "probe") & (by["l"] < x["p"]) & (x["p"] < by["h"]) & (F.abs(x["p"] - by["p"]) >= 1e-10) & _valid(x["valid_from"], by["t"])
    there = lambda done, x: (x["parent"].isNull() | F.exists(done, lambda d: d["level_id"] == x["parent"])) & ~F.exists(done, lambda d: inside(d, x))
    none = F.filter("ends", lambda x: F.lit(False))
    true = ends.select(*SIDE, F.aggregate("ends", none, lambda done, x: F.when(there(done, x), F.concat(done, F.array(x))).otherwise(done)).alias("true"))
    # What a level meets before its own end are the true ends of its side, one for each level at most.
    by = F.filter("true", lambda d: (d["kind"] != "probe") & (d["level_id"] != F.col("level_id")) & (d["l"] < F.col("p")) & (F.col("p") < d["h"]) & (F.abs(F.col("p") - d["p"]) >= 1e-10) & _valid(F.col("valid_from"), d["t"])
                  & (F.col("end").isNull() | (d["i"] < F.col("end.bar_index")) | ((d["i"] == F.col("end.bar_index")) & (d["place"] < F.col("place")))))
    met = every.join(true.hint("merge"), list(SIDE), "left").withColumn("true", F.coalesce("true", F.filter(F.array(F.struct(F.col("end.bar_index").alias("i"), "place", "level_id", "p", "valid_from", "parent", F.col("end.kind").alias("kind"), F.col("end.h").alias("h"), F.col("end.l").alias("l"), F.col("end.ts_ny").alias("t"))), lambda x: F.lit(False))))
    real = F.col("parent").isNull() | F.exists("true", lambda d: d["level_id"] == F.col("parent"))
    out = met.where(real).withColumn("crossed", F.get(by, F.lit(0))).drop("true")
    return out.withColumn("end", F.when(F.col("crossed").isNull(), F.col("end")))


def _unmirrored(side: Column, x: Column) -> Column:
    return F.when(side == "high", x).otherwise(-x)


def dwellings(bars: DataFrame, fates: DataFrame, displaced: DataFrame, tf: str, pip: float) -> DataFrame:
    """For each level the first bar from which closes stay beyond it: DWELLS closes in a row, no close back with reclaim and
    rejection within two more bars, and no displacement against the breach (`displaced`: bar_index, direction) that starts in these. Levels that were swept count, too."""
    n, floor = DWELLS.get(tf, 2), FLOORS.get(tf, 0.5) * pip
    w = Window.partitionBy(*SIDE).orderBy("bar_index")
    against = displaced.select(*KEY, F.when(F.col("direction") == "bearish", "high").otherwise("low").alias("side"), "bar_index", F.lit(True).alias("_against")).distinct()
    m = _mirrored(bars, n + 2).join(against.hint("merge"), [*SIDE, "bar_index"], "left")
    m = m.withColumn("_held", F.max(F.coalesce("_against", F.lit(False))).over(w.rowsBetween(0, n + 1)))
    stay = F.least(*[F.col("c")[k] for k in range(n)])
    whole = F.col("c")[n - 1].isNotNull()
    m = m.where(~F.col("is_ghost") & ~F.col("_held") & whole).select(*SIDE, "bar_index", "ts_ny", F.col("forex_day").alias("day"), "o", "h", "l", "c", stay.alias("stay")).hint("merge")
    p = F.col("p")
    met = fates.select(*LEVEL, "source", "p", "valid_from").join(m, list(SIDE)).where((F.col("stay") > p) & (F.col("h") - p >= DWELL_BREACH * pip) & _valid(F.col("valid_from"), F.col("ts_ny")))
    met = met.withColumn("back", _back(F.col("c"), p, n + 2))
    swept = F.coalesce((p - F.col("c")[F.col("back")] >= floor) & (_rejection(p) >= REJECTION), F.lit(False))
    return met.where(~swept).groupBy(*LEVEL, "source", "p").agg(F.min(F.struct("bar_index", "ts_ny", "day", (F.col("h") - p).alias("breach"))).alias("dwelt"))


def liquidity_sweeps(bars: DataFrame, levels: DataFrame, displaced: DataFrame, tf: str, pip: float) -> DataFrame:
    """Sweeps, continuations and what uses levels up (`reason`: dwell, pass_through, probes), one row each.

    bar_index is the confirming bar of a sweep, else the breaching one. A sweep that is confirmed after its level was used
    up by dwelling is left out, but not what followed from it.
    """
    fates = stored(level_fates(bars, levels, tf, pip), "fates")
    dwelt = stored(dwellings(bars, fates, displaced, tf, pip), "dwelt")
    side, pips = F.col("side"), lambda c: F.round(c / pip, 1)
    base = [*KEY, "side", "level_id", "source", _unmirrored(side, F.col("p")).alias("level_price")]
    none = lambda t: F.lit(None).cast(t)
    e = F.col("end")
    own = fates.where("end is not null")
    sweep = e["kind"] == "sweep"
    kinds = F.when(sweep, "sweep").when(e["kind"] == "continuation", "sweep_continuation").otherwise("sweep_consumed")
    ended = own.select(*base, kinds.alias("type"), F.when(e["kind"] == "probe", "probes").alias("reason"), (e["bar_index"] + F.when(sweep, e["back"]).otherwise(0)).cast("int").alias("bar_index"), F.when(sweep, e["confirmed"]).otherwise(e["ts_ny"]).alias("time"), e["bar_index"].alias("breach_bar"),
                       pips(e["breach"]).alias("breach_pips"), F.when(sweep, pips(e["reclaim"])).alias("reclaim_pips"), F.when(sweep, F.round(e["rejection"], 3)).alias("rejection"), F.when(sweep, e["back"] + 1).alias("return_bars"), e["day"].alias("forex_day"), F.when(sweep, map_session(e["confirm_session"])).alias("session"), "touch_count")
    ended = ended.join(dwelt.select(*LEVEL, F.col("dwelt.bar_index").alias("_dwelt")).hint("merge"), list(LEVEL), "left").where((F.col("type") != "sweep") | F.col("_dwelt").isNull() | (F.col("bar_index") <= F.col("_dwelt"))).drop("_dwelt")
    x = F.col("crossed")
    days = bars.select(*KEY, "bar_index", "forex_day")
    crossed = fates.where("crossed is not null").select(*base, F.lit("sweep_consumed").alias("type"), F.lit("pass_through").alias("reason"), x["i"].cast("int").alias("bar_index"), x["t"].alias("time"), x["i"].cast("int").alias("breach_bar"), none("double").alias("breach_pips"), none("double").alias("reclaim_pips"), none("double").alias("rejection"), none("int").alias("return_bars"), none("string").alias("session"), "touch_count")
    crossed = crossed.join(days.hint("merge"), [*KEY, "bar_index"])
    d = F.col("dwelt")
    stayed = dwelt.select(*base, F.lit("sweep_consumed").alias("type"), F.lit("dwell").alias("reason"), d["bar_index"].alias("bar_index"), d["ts_ny"].alias("time"), d["bar_index"].alias("breach_bar"), pips(d["breach"]).alias("breach_pips"), none("double").alias("reclaim_pips"), none("double").alias("rejection"), none("int").alias("return_bars"), d["day"].alias("forex_day"), none("string").alias("session"), F.lit(1).alias("touch_count"))
    return ended.unionByName(crossed).unionByName(stayed).withColumn("direction", F.when(side == "high", "bearish").otherwise("bullish"))


def delayed_sweeps(bars: DataFrame, levels: DataFrame, found: DataFrame, tf: str, pip: float) -> DataFrame:
    """Bars that close beyond a level by at most MOST_ATR and are followed by a close back inside, one for each level: the first. `found` are the levels (symbol, tf, side, level_id) that were swept already."""
    w = Window.partitionBy(*SIDE).orderBy("bar_index")
    floor = FLOORS.get(tf, 0.5) * pip
    wick = lambda o, h, l, c: F.when(h > l, (h - F.greatest(o, c)) / (h - l)).otherwise(0.0)  # noqa: E731, E741
    m = _mirrored(bars, 2)
    m = m.withColumns({"wick": wick(F.col("o"), F.col("h"), F.col("l"), F.col("c")[0])})
    m = m.withColumn("wick", F.greatest("wick", F.lead("wick").over(w))).withColumnRenamed("forex_day", "day").where(F.col("atr").isNotNull() & (F.col("atr") != 0) & F.col("c")[1].isNotNull() & (F.col("c")[1] < F.col("c")[0]) & (F.col("wick") >= DELAYED_REJECTION))
    sign = F.when(F.col("side") == "high", 1.0).otherwise(-1.0)
    left = levels.join(found.select(*LEVEL).distinct().hint("merge"), list(LEVEL), "left_anti").withColumn("p", sign * F.col("price"))
    p, age = F.col("p"), F.col("bar_index") - F.col("level_bar")
    pivot = (age > 0) & (age <= STALE) & (F.col("forex_day").isNull() | (F.col("forex_day") == F.col("day")))
    gate = F.when(F.col("source") == "PROMOTED_SWING", pivot).otherwise(_valid(F.col("valid_from"), F.col("ts_ny")))
    breach, reclaim = F.col("h") - p, p - F.col("c")[1]
    # Two closes enclose the level, so that a bar meets only the levels between them.
    met = left.join(m.hint("merge"), list(SIDE)).where((p <= F.col("c")[0]) & (p > F.col("c")[1]) & (F.col("h") > p) & (breach >= floor) & (breach <= MOST_ATR * F.col("atr")) & (reclaim >= floor) & gate)
    first = met.groupBy(*LEVEL, "source", "price").agg(F.min(F.struct("bar_index", F.round(breach / pip, 1).alias("breach_pips"), F.round(reclaim / pip, 1).alias("reclaim_pips"), F.round("wick", 3).alias("rejection"))).alias("s"))
    return first.select(*LEVEL, "source", "price", "s.*", F.when(F.col("side") == "high", "bearish").otherwise("bullish").alias("direction"))


def sweep_health(sweeps: DataFrame, *by: str) -> DataFrame:
    """Events, sweeps, continuations, levels used up and passed through, events by source, and continuations for each sweep."""
    n = lambda c: F.count_if(c)
    per = sweeps.groupBy(*by, "source").agg(F.count("*").alias("n"), n(F.col("type") == "sweep").alias("s"), n(F.col("type") == "sweep_continuation").alias("c"), n(F.col("type") == "sweep_consumed").alias("u"), n(F.col("reason").eqNullSafe(F.lit("pass_through"))).alias("t"))
    total = per.groupBy(*by).agg(F.sum("n").alias("total_events"), F.sum("s").alias("sweep_count"), F.sum("c").alias("continuation_count"), F.sum("u").alias("consumed_count"), F.sum("t").alias("pass_through_count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("pool_sources"))
    return total.withColumn("cont_sweep_ratio", F.when(F.col("sweep_count") > 0, F.round(F.col("continuation_count") / F.col("sweep_count"), 3)))
