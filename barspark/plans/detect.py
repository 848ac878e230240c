"""All detectors over timeframes, sets of parameters and variants, as one table of detections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import map_session
from ..functions.measures import config_id, detection_id, null_nonfinite
from ..operators import bars as B
from ..operators import equal_levels, gaps, pivots, sessions, shift, structure, sweeps, zones
from ..operators import levels as L
from ..operators.displacement import displacements
from ..sources.store import stored

# Pivot lengths by timeframe, and how far their strength is followed.
SWING_N = {"1m": 5, "5m": 3, "15m": 2}
SWING_CAP = 20
DEFAULTS = {"gap_floor": 0.5, "swing_n": None, "internal": 5, "external": 50, "atr_multiple": 1.5, "body_ratio": 0.6, "window": 3}
#: What each primitive is built from, by variant; the first is taken unless another is asked for.
VARIANTS = {"mss": ("shift", "break"), "order_block": ("opposing", "extreme")}
PRIMITIVES = ("fvg", "ifvg", "bpr", "swing", "displacement", "mss", "break", "order_block", "ote", "asia_range", "session_box", "reference_level", "window", "equal_level", "sweep")


def _view(df: DataFrame, primitive: str, variant: str, time: str, direction: Column, price: Column, run: Column) -> DataFrame:
    """The common columns; everything else as JSON."""
    common = {"symbol", "tf", "session", "forex_day", time}
    df = null_nonfinite(df)
    rest = F.to_json(F.struct(*[c for c in df.columns if c not in common]))
    day = F.col("forex_day") if "forex_day" in df.columns else F.lit(None).cast("date")
    session = map_session(F.col("session")) if "session" in df.columns else F.lit(None).cast("string")
    return df.select("symbol", "tf", F.lit(primitive).alias("primitive"), F.lit(variant).alias("variant"), run.alias("run_id"), detection_id(primitive, F.col("tf"), F.col(time), direction).alias("id"), F.col(time).alias("time"), direction.alias("direction"), price.cast("double").alias("price"), session.alias("session"), day.alias("forex_day"), rest.alias("properties"))


class _Shared:
    """What sets of parameters and variants have in common on the bars of one timeframe, each written once when first asked for."""

    def __init__(self, bars: DataFrame, tf: str, pip: float):
        self.tf, self.pip = tf, pip
        self.bars = stored(B.with_atr(B.prepared(bars)), "bars")
        self.made: dict[tuple, DataFrame] = {}

    def once(self, *key: object, make) -> DataFrame:
        if key not in self.made:
            self.made[key] = stored(make(), str(key[0]))
        return self.made[key]

    def place(self, df: DataFrame, bar: str = "bar_index") -> DataFrame:
        """Time, session and day of a bar that `df` names."""
        at = self.bars.select(*B.KEY, F.col("bar_index").alias(bar), F.col("ts_ny").alias("time"), "session", "forex_day")
        return df.drop("time", "session", "forex_day").join(at.hint("merge"), [*B.KEY, bar])


def _detected(x: _Shared, params: dict[str, float] | None, variants: dict[str, str] | None, primitives: tuple[str, ...]) -> DataFrame:
    p = DEFAULTS | (params or {})
    kind = {k: (variants or {}).get(k, v[0]) for k, v in VARIANTS.items()}
    for k, v in kind.items():
        if v not in VARIANTS[k]:
            raise ValueError(f"{k} has no variant {v}")
    run = config_id(*[F.lit(v).alias(k) for k, v in sorted(p.items())])
    b, tf, pip, n = x.bars, x.tf, x.pip, p["swing_n"] or SWING_N.get(x.tf, 3)
    g = lambda: x.once("gaps", p["gap_floor"], make=lambda: gaps.fair_value_gaps(b, tf, pip, p["gap_floor"]))
    s = lambda: x.once("swings", n, make=lambda: pivots.swings(b, n, SWING_CAP, pip))
    d = lambda: x.once("displacements", make=lambda: displacements(b, pip).drop("qualifies"))
    strong = lambda: d().where(((F.col("atr_exact") >= p["atr_multiple"]) & (F.col("body_exact") >= p["body_ratio"])) | F.col("decisive"))
    shifts = lambda: x.once("shifts", n, p["atr_multiple"], p["body_ratio"], p["window"], make=lambda: shift.structure_shifts(b, s(), strong(), pip, p["window"], gaps=g()))
    breaks = lambda level: x.once("breaks", level, p[level], make=lambda: structure.structure_breaks(b, p[level], level))
    mss = shifts if kind["mss"] == "shift" else lambda: breaks("internal")
    direction, mean = F.col("direction"), lambda c, e: (F.col(c) + F.col(e)) / 2
    view = lambda df, name, time, toward, price, variant="": _view(df, name, variant, time, toward, price, run)

    def blocks() -> DataFrame:
        if kind["order_block"] == "opposing":
            found = structure.order_blocks(b, mss().select(*B.KEY, "bar_index", "direction"), tf)
            return view(x.place(found, "block_bar"), "order_block", "time", direction, mean("body_top", "body_bottom"), "opposing")
        found = zones.extreme_blocks(b, breaks("internal"))
        return view(x.place(found, "block_bar"), "order_block", "time", direction, mean("zone_high", "zone_low"), "extreme")

    def retraced() -> DataFrame:
        found = structure.shift_retracements(mss(), b)
        return view(x.place(found), "ote", "time", direction, F.col("level_705"), kind["mss"])

    def swept() -> DataFrame:
        pool = stored(L.level_pool(L.gathered(b, s(), pip), pip, tf), "pool")
        return view(sweeps.liquidity_sweeps(b, pool, strong(), tf, pip), "sweep", "time", direction, F.col("level_price"))

    day = lambda df: df.withColumn("time", F.col("forex_day").cast("timestamp_ntz"))
    both = F.lit("neutral")
    makers = {
        "fvg": lambda: view(g(), "fvg", "time", direction, F.col("ce")),
        "ifvg": lambda: view(gaps.inverse_gaps(g()), "ifvg", "time", direction, F.col("ce")),
        "bpr": lambda: view(x.place(gaps.balanced_ranges(g(), 10 * pip).withColumn("bar_index", F.greatest("bull_bar", "bear_bar"))), "bpr", "time", F.when(F.col("bull_bar") > F.col("bear_bar"), "bullish").otherwise("bearish"), mean("top", "bottom")),
        "swing": lambda: view(s(), "swing", "ts_ny", F.col("side"), F.col("price")),
        "displacement": lambda: view(d(), "displacement", "ts_ny", direction, F.col("extreme_price")),
        "mss": lambda: view(x.place(mss()), "mss", "time", direction, F.col("pivot_price"), kind["mss"]),
        "break": lambda: view(x.place(breaks("internal").unionByName(breaks("external"))), "break", "time", direction, F.col("pivot_price")),
        "order_block": blocks,
        "ote": retraced,
        "asia_range": lambda: view(day(sessions.asia_range(b, pip)), "asia_range", "time", both, mean("high", "low")),
        "session_box": lambda: view(sessions.session_boxes(b, pip), "session_box", "start_time", F.lower("box"), mean("high", "low")),
        "reference_level": lambda: view(day(sessions.reference_levels(b)), "reference_level", "time", both, F.col("day_high")),
        "window": lambda: view(x.place(zones.window_events(b, g(), s(), d(), p["gap_floor"])), "window", "time", F.concat_ws("_", "window", "kind", "subtype"), F.col("value")),
        "equal_level": lambda: view(x.place(equal_levels.equal_pools(b, tf, pip), "last_bar"), "equal_level", "time", F.col("side"), F.col("level")),
        "sweep": swept,
    }
    return reduce(DataFrame.unionByName, [makers[k]() for k in PRIMITIVES if k in primitives])


def detect(bars: DataFrame, tf: str, pip: float, params: dict[str, float] | None = None, variants: dict[str, str] | None = None, primitives: tuple[str, ...] = PRIMITIVES) -> DataFrame:
    """Detections of one timeframe's bars under one set of parameters; run_id is the hash of the set. `variants` picks another way to build a primitive and what builds on it, see VARIANTS."""
    return _detected(_Shared(bars, tf, pip), params, variants, primitives)


def detect_all(bars: DataFrame, tfs: tuple[str, ...], pip: float, params: list[dict[str, float]] | None = None, variants: list[dict[str, str]] | None = None, primitives: tuple[str, ...] = PRIMITIVES) -> DataFrame:
    """Detections over several timeframes, sets of parameters and variants. Each timeframe's bars, and all that sets and variants have in common, are written once; equal rows of several variants come once."""
    parts = []
    for tf in tfs:
        shared = _Shared(B.rollup(bars, tf), tf, pip)
        parts += [_detected(shared, p, v, primitives) for p in params or [{}] for v in variants or [{}]]
    out = reduce(DataFrame.unionByName, parts)
    return out.distinct() if len(variants or []) > 1 else out
