"""Displacements: strong single bars, pairs of bars that go on, and decisive bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import ATR_MULTIPLES, BODY_RATIOS, close_near_extreme, grade, grid
from .bars import KEY, series

# Default parameters.
DEFAULTS = {"close_most": 0.25, "efficiency": 0.65, "overlap": 0.35, "atr": 1.0, "body": 0.55, "override_body": 0.75, "override_close": 0.10, "pip_floor": 5.0}


def displacements(bars: DataFrame, pip: float, params: dict[str, float] | None = None) -> DataFrame:
    """One row for each displacement of `bars` (with atr).

    A pair is two bars of one direction that go on, with little overlap, whose second closes near its extreme and that
    is wide or full enough; the second bar of a pair starts no other, so of a run of bars that could all start pairs every
    second one does. Others are single bars; one without a grade may still be decisive.
    """
    p = DEFAULTS | (params or {})
    w = series()
    nxt = {c: F.lead(c).over(w) for c in ("open", "high", "low", "close", "is_ghost", "ts_ny")}
    b = bars.withColumns({f"_{k}": v for k, v in nxt.items()})
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    o1, h1, l1, c1 = (F.col(f"_{x}") for x in ("open", "high", "low", "close"))
    up = c > o
    direction = F.when(up, "bullish").otherwise("bearish")
    usable = ~F.col("is_ghost") & (F.col("atr") > 0) & (h > lo) & (F.col("bar_index") >= 1)
    spread = F.greatest(h, h1) - F.least(lo, l1)
    body = F.abs(c1 - o)
    on = F.when(up, (h1 > h) & (l1 >= lo)).otherwise((l1 < lo) & (h1 <= h))
    overlap = F.try_divide(F.greatest(F.lit(0.0), F.least(h, h1) - F.greatest(lo, l1)), F.least(h - lo, h1 - l1))
    fits = usable & ~F.coalesce(F.col("_is_ghost"), F.lit(True)) & ((c1 > o1) == up) & (h1 > l1) & on & (F.try_divide(body, h - lo + h1 - l1) >= p["efficiency"]) & (overlap <= p["overlap"])
    fits = fits & close_near_extreme(h1, l1, c1, direction, p["close_most"]) & ((F.try_divide(spread, F.col("atr")) >= p["atr"]) | (F.try_divide(body, spread) >= p["body"]))
    b = b.withColumn("_fits", F.coalesce(fits, F.lit(False)))
    # Runs of bars that could start a pair: every second bar of a run does.
    run = b.withColumn("_run", F.sum(F.when(F.col("_fits"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy(*KEY, "_run", "_fits").orderBy("bar_index"))
    b = run.withColumn("pair", F.col("_fits") & (place % 2 == 1))
    b = b.withColumn("_taken", F.coalesce(F.lag("pair").over(w), F.lit(False))).where(usable & ~F.col("_taken"))
    pair = F.col("pair")
    b = b.withColumns({"direction": direction, "range": F.when(pair, spread).otherwise(h - lo), "body": F.when(pair, body).otherwise(F.abs(c - o))})
    b = b.withColumns({"atr_multiple": F.try_divide("range", "atr"), "body_ratio": F.try_divide("body", "range")})
    near = F.when(pair, True).otherwise(close_near_extreme(h, lo, c, direction, p["close_most"]))
    plain = grade(F.col("atr_multiple"))
    decisive = ~pair & plain.isNull() & (F.col("body_ratio") >= p["override_body"]) & close_near_extreme(h, lo, c, direction, p["override_close"]) & ((h - lo) / pip >= p["pip_floor"])
    b = b.withColumn("decisive", decisive)
    b = b.withColumns({"quality_grade": F.when(F.col("decisive"), "VALID").otherwise(plain), "close_location_pass": F.col("decisive") | near})
    b = b.withColumn("qualifies", grid(F.col("atr_multiple"), F.col("body_ratio"), F.col("close_location_pass"), F.col("decisive")))
    extreme = F.when(up, F.when(pair, F.greatest(h, h1)).otherwise(h)).otherwise(F.when(pair, F.least(lo, l1)).otherwise(lo))
    gate = (F.col("atr_multiple") >= ATR_MULTIPLES[0]) | (F.col("body_ratio") >= BODY_RATIOS[0]) | F.col("decisive")
    return b.where(gate).select(
        *KEY, "bar_index", (F.col("bar_index") + pair.cast("int")).alias("bar_index_end"), "ts_ny", "session", "forex_day", "direction",
        F.when(pair, "CLUSTER_2").otherwise("SINGLE").alias("displacement_type"), F.when(F.col("decisive"), "DECISIVE_OVERRIDE").otherwise("ATR_RELATIVE").alias("qualification_path"), "quality_grade",
        "close_location_pass", F.round(F.col("range") / pip, 2).alias("range_pips"), F.round(F.col("body") / pip, 2).alias("body_pips"), F.round("body_ratio", 4).alias("body_ratio"), F.round("atr_multiple", 4).alias("atr_multiple"), extreme.alias("extreme_price"), "qualifies", F.col("atr_multiple").alias("atr_exact"), F.col("body_ratio").alias("body_exact"), "decisive",
    )


def displacement_matrix(dets: DataFrame, *by: str) -> DataFrame:
    """Displacements that pass both thresholds, and either, for each pair of thresholds. The pairs are a literal of 16, so a row becomes 16."""
    pairs = F.array(*[F.struct(F.lit(a).alias("atr"), F.lit(b).alias("br")) for a in ATR_MULTIPLES for b in BODY_RATIOS])
    each = dets.select(*by, "atr_exact", "body_exact", "decisive", F.explode(pairs).alias("t"))
    atr, body = F.col("atr_exact") >= F.col("t.atr"), F.col("body_exact") >= F.col("t.br")
    return each.groupBy(*by, F.col("t.atr").alias("atr"), F.col("t.br").alias("br")).agg(F.count_if((atr & body) | F.col("decisive")).alias("n_and"), F.count_if(atr | body | F.col("decisive")).alias("n_or"))
