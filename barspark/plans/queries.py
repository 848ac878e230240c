"""The registered queries on bars: ticks come from the events table, symbol = event type, 15-minute bars, one pip = 1.0."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import gaps, pivots, sessions, shift, structure
from ..operators.displacement import displacement_matrix as matrix
from ..operators.displacement import displacements
from ..sources.bars import available_range, integrity
from . import evaluation as E
from . import search
from .detect import detect

TF, PIP = "15m", 1.0


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.ticks_to_bars(ticks(spark, sf_dir), TF)


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.prepared(bars(spark, sf_dir))


def _text(df: DataFrame) -> DataFrame:
    """Dates and times as text."""
    forms = {"date": "yyyy-MM-dd", "timestamp_ntz": "yyyy-MM-dd HH:mm:ss", "timestamp": "yyyy-MM-dd HH:mm:ss"}
    return df.select(*[F.date_format(c, forms[t]).alias(c) if t in forms else F.col(c) for c, t in df.dtypes])


def _rolled(tf: str, align: str = "midnight") -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _text(B.rollup(bars(spark, sf_dir), tf, align).select("symbol", "ts_ny", "open", "high", "low", "close", "volume", "bar_count"))

    return run


def bars_15m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(bars(spark, sf_dir).select("symbol", "ts_ny", "open", "high", "low", "close", "volume"))


def session_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(prepared(spark, sf_dir).select("symbol", "bar_index", "session", "kill_zone", "ny_window", "forex_day"))


def atr_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.with_atr(prepared(spark, sf_dir)).select("symbol", "bar_index", F.round("true_range", 6).alias("true_range"), F.round("atr", 6).alias("atr"))


def fvg(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gaps.fair_value_gaps(prepared(spark, sf_dir), TF, PIP, floor=5.0)
    return _text(g.select("symbol", "bar_index", "direction", "bottom", "top", F.round("ce", 6).alias("ce"), "gap_pips", "vi_confluent", "above_floor", "ce_touched_bar", "boundary_closed_bar", "time"))


def inverse_fvg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.inverse_gaps(gaps.fair_value_gaps(prepared(spark, sf_dir), TF, PIP)).groupBy("symbol", "direction").agg(F.count("*").alias("n"), F.round(F.avg(F.col("boundary_closed_bar") - F.col("bar_index")), 6).alias("mean_bars"))


def balanced_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gaps.fair_value_gaps(prepared(spark, sf_dir), TF, PIP, states=False)
    pairs = gaps.balanced_ranges(g, 10.0)
    return pairs.groupBy("symbol", "bull_bar").agg(F.count("*").alias("n"), F.round(F.sum(F.col("top") - F.col("bottom")), 4).alias("overlap"))


def body_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.body_gaps(prepared(spark, sf_dir), PIP).select("symbol", "bar_index", "direction", "gap_pips")


def _swings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.swings(prepared(spark, sf_dir), 2, 20, PIP)


def swings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _swings(spark, sf_dir).select("symbol", "bar_index", "side", "price", "strength", "height_pips")


def swing_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.classify_swings(_swings(spark, sf_dir)).select("symbol", "bar_index", "side", "label")


def near_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_prices(_swings(spark, sf_dir), 20, 2.0).select("symbol", "side", "bar1", "bar2")


def displacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = displacements(B.with_atr(prepared(spark, sf_dir)), PIP)
    return d.select("symbol", "bar_index", "bar_index_end", "direction", "displacement_type", "qualification_path", "quality_grade", "close_location_pass", "range_pips", "body_pips", "extreme_price")


def displacement_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix(displacements(B.with_atr(prepared(spark, sf_dir)), PIP), "symbol")


def session_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(sessions.session_levels(prepared(spark, sf_dir)).drop("tf"))


def asia_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(sessions.asia_range(prepared(spark, sf_dir), 10.0).select("symbol", "forex_day", "high", "low", "bar_count", "range_pips", F.element_at("classifications", "20").alias("at_20")))


def asia_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.asia_matrix(sessions.asia_range(prepared(spark, sf_dir), 10.0))


def reference_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(sessions.reference_levels(prepared(spark, sf_dir)).drop("tf"))


def session_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = sessions.session_boxes(prepared(spark, sf_dir), 10.0)
    return _text(b.select("symbol", "forex_day", "box", "high", "low", "bar_count", "mid_cross_count", F.round("range", 6).alias("range"), F.round("efficiency", 6).alias("efficiency"), F.round("balance_score", 6).alias("balance_score"), "classification", "trend_direction", "high_traded_above", "low_closed_below"))


def session_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(sessions.session_coverage(prepared(spark, sf_dir), 4).drop("tf"))


def _breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.structure_breaks(prepared(spark, sf_dir), 5, "internal")


def structure_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _breaks(spark, sf_dir).select("symbol", "bar_index", "direction", "pivot_bar", "pivot_price", "break_type")


def order_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(structure.order_blocks(prepared(spark, sf_dir), _breaks(spark, sf_dir), TF))


def _blocks(b: DataFrame) -> DataFrame:
    return b.select("symbol", "bar_index", "direction", "block_bar", "body_top", "body_bottom", "wick_top", "wick_bottom", F.size("retests").alias("n_retests"), F.array_join("retests", ",").alias("retests"))


def shift_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order blocks before structure shifts."""
    b = B.with_atr(prepared(spark, sf_dir))
    d = displacements(b, PIP).where("(atr_exact >= 1.5 AND body_exact >= 0.6) OR decisive")
    return _blocks(structure.order_blocks(b, shift.structure_shifts(b, _swings(spark, sf_dir), d, PIP), TF))


def retracements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.retracements(_breaks(spark, sf_dir)).drop("tf").withColumn("range", F.round("range", 6))


def _gap_detections(spark: SparkSession, sf_dir: str, floor: float) -> DataFrame:
    from ..functions.calendar import map_session
    from ..functions.measures import detection_id

    g = gaps.fair_value_gaps(prepared(spark, sf_dir), TF, PIP, floor, states=False).where("above_floor")
    return g.select("symbol", "tf", "direction", "forex_day", map_session(F.col("session")).alias("session"), detection_id("fvg", F.col("tf"), F.col("time"), F.col("direction")).alias("id"))


def per_day_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.per_day_stats(_gap_detections(spark, sf_dir, 0.0), "symbol", "direction")


def session_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.session_distribution(_gap_detections(spark, sf_dir, 0.0), "symbol").select("symbol", "session", "n", F.col("pct"))


def weekly_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(E.weekly_stats(_gap_detections(spark, sf_dir, 20.0), "symbol"))


def compared_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.compared(_gap_detections(spark, sf_dir, 5.0), _gap_detections(spark, sf_dir, 20.0), "symbol")


def gap_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gaps.fair_value_gaps(prepared(spark, sf_dir), TF, PIP, states=False)
    return _text(E.gap_matrix(g, (1.0, 5.0, 20.0), "symbol", "forex_day"))


def swing_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.swing_matrix(_swings(spark, sf_dir), (0, 5, 10), "symbol")


def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    dets = _gap_detections(spark, sf_dir, 0.0)
    windows = E.rolling_windows(dets.select("forex_day"), 10, 5, 5)
    return E.walk_forward(dets, windows, 20.0, "symbol")


def structure_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = B.with_atr(prepared(spark, sf_dir))
    d = displacements(b, PIP).where("(atr_exact >= 1.5 AND body_exact >= 0.6) OR decisive")
    g = gaps.fair_value_gaps(prepared(spark, sf_dir), TF, PIP, states=False)
    return shift.structure_shifts(b, _swings(spark, sf_dir), d, PIP, gaps=g).drop("tf")


def shift_retracements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retracement levels of structure shifts, with whether the shift's session is one to act in."""
    b = B.with_atr(prepared(spark, sf_dir))
    d = displacements(b, PIP).where("(atr_exact >= 1.5 AND body_exact >= 0.6) OR decisive")
    return structure.shift_retracements(shift.structure_shifts(b, _swings(spark, sf_dir), d, PIP), b).drop("tf")


def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = B.with_atr(prepared(spark, sf_dir))
    d = displacements(b, PIP).where("(atr_exact >= 1.5 AND body_exact >= 0.6) OR decisive")
    s = _swings(spark, sf_dir)
    mss = shift.structure_shifts(b, s, d, PIP)
    parts = [x.select("symbol", "tf", F.lit(n).alias("primitive")) for x, n in ((d, "displacement"), (s, "swing"), (mss, "mss"))]
    return E.funnel(parts[0].unionByName(parts[1]).unionByName(parts[2])).drop("tf")


def weekly_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    dets = _gap_detections(spark, sf_dir, 20.0)
    weekly = dets.groupBy("symbol", F.to_date(F.date_trunc("week", "forex_day")).alias("week")).agg(F.count("*").alias("n"))
    return _text(E.outliers(weekly, E.weekly_stats(dets, "symbol").select("symbol", "mean", "std"), "symbol", deviations=1.0).select("symbol", "week", "n"))


def detection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    dets = detect(bars(spark, sf_dir), TF, PIP, {"swing_n": 2}, primitives=("fvg", "swing", "displacement"))
    return E.counts(dets, "symbol", "primitive")


def swept_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = search.combinations(spark, {"atr": [1.1, 1.4, 1.8, 2.5], "body": [0.5, 0.62, 0.8]})
    d = displacements(B.with_atr(prepared(spark, sf_dir)), PIP)
    return search.swept(d, sets, "atr", "body", "symbol").drop("run_id")


def bar_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    return _text(integrity(b).join(available_range(b), "symbol"))


_TICKS = "e AS (SELECT event_type AS symbol, ts, value AS price, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS ny FROM events)"
_BARS = _TICKS + """,
b AS (SELECT symbol, date_trunc('day', ny) + to_minutes(((hour(ny) * 60 + minute(ny)) // 15 * 15)::INT) AS ts_ny, min(ts) AS ts, arg_min(price, ts) AS open, max(price) AS high, min(price) AS low,
      arg_max(price, ts) AS close, count(*)::DOUBLE AS volume FROM e GROUP BY 1, 2),
p AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_ny) - 1 AS i, CAST(ts_ny + INTERVAL 7 HOUR AS DATE) AS day,
      CASE WHEN hour(ts_ny) >= 19 THEN 'asia' WHEN hour(ts_ny) < 2 THEN 'pre_london' WHEN hour(ts_ny) < 5 THEN 'lokz' WHEN hour(ts_ny) < 7 THEN 'pre_ny' WHEN hour(ts_ny) < 10 THEN 'nyokz' ELSE 'other' END AS session FROM b)"""
_ATR = _BARS + """,
tr AS (SELECT *, CASE WHEN i = 0 THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS t FROM p WINDOW w AS (PARTITION BY symbol ORDER BY i)),
a(symbol, i, atr) AS (SELECT symbol, 13::BIGINT, avg(t) FROM tr WHERE i < 14 GROUP BY symbol HAVING count(*) = 14 UNION ALL SELECT a.symbol, a.i + 1, (a.atr * 13 + tr.t) / 14 FROM a JOIN tr ON tr.symbol = a.symbol AND tr.i = a.i + 1)"""
_GAPS = _BARS + """,
l AS (SELECT *, lag(high, 2) OVER w AS h2, lag(low, 2) OVER w AS l2, lag(ts_ny, 2) OVER w AS t2, lag(greatest(open, close), 2) OVER w AS bt2, lag(least(open, close), 2) OVER w AS bb2 FROM p WINDOW w AS (PARTITION BY symbol ORDER BY i)),
g AS (SELECT symbol, i, day, session, t2, CASE WHEN low > h2 THEN 'bullish' ELSE 'bearish' END AS direction, CASE WHEN low > h2 THEN h2 ELSE high END AS bottom, CASE WHEN low > h2 THEN low ELSE l2 END AS top,
      CASE WHEN low > h2 THEN least(open, close) > bt2 ELSE greatest(open, close) < bb2 END AS vi FROM l WHERE low > h2 OR high < l2)"""
_SWINGS = _BARS + """,
m AS (SELECT *, max(high) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS hl, max(high) OVER (w ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS hr, min(low) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS ll,
      min(low) OVER (w ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS lr, count(*) OVER (PARTITION BY symbol) AS n FROM p WINDOW w AS (PARTITION BY symbol ORDER BY i)),
s AS (SELECT symbol, i, n, 'high' AS side, high AS price FROM m WHERE i >= 2 AND i < n - 2 AND high >= hl AND high > hr UNION ALL SELECT symbol, i, n, 'low', low FROM m WHERE i >= 2 AND i < n - 2 AND low <= ll AND low < lr)"""
_BREAKS = _BARS + """,
r AS (SELECT *, max(high) OVER f AS hr, min(low) OVER f AS lr, count(*) OVER f AS n FROM p WINDOW f AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)),
st AS (SELECT *, CASE WHEN n < 5 THEN NULL WHEN high > hr THEN 'high' WHEN low < lr THEN 'low' END AS side FROM r),
ch AS (SELECT *, last_value(side IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM st),
pv AS (SELECT *, CASE WHEN side = 'high' AND was IS DISTINCT FROM side THEN i END AS hi, CASE WHEN side = 'low' AND was IS DISTINCT FROM side THEN i END AS lo FROM ch),
k AS (SELECT symbol, i, open, high, low, close, ts_ny, lag(close) OVER w AS c1, last_value(hi IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hi, last_value(lo IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lo
      FROM pv WINDOW w AS (PARTITION BY symbol ORDER BY i)),
x AS (SELECT k.symbol, k.i, k.close, 'bullish' AS direction, k.hi AS pivot_bar, q.high AS pivot_price FROM k JOIN p q ON q.symbol = k.symbol AND q.i = k.hi WHERE k.close > q.high AND k.c1 <= q.high
      UNION ALL SELECT k.symbol, k.i, k.close, 'bearish', k.lo, q.low FROM k JOIN p q ON q.symbol = k.symbol AND q.i = k.lo WHERE k.close < q.low AND k.c1 >= q.low),
br AS (SELECT *, CASE WHEN coalesce(lag(direction) OVER (PARTITION BY symbol ORDER BY i, direction), direction) = direction THEN 'BOS' ELSE 'CHoCH' END AS break_type
       FROM (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY symbol, direction, pivot_bar ORDER BY i) = 1))"""


def _rolled_sql(bucket: str) -> str:
    return f"""WITH {_BARS} SELECT symbol, strftime({bucket}, '%Y-%m-%d %H:%M:%S') AS ts_ny, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume, count(*) AS bar_count FROM p GROUP BY 1, 2"""


_FLOOR = "CASE WHEN round(top - bottom, 2) >= {0} THEN 1 END"
_DETS = _GAPS + ", d AS (SELECT symbol, direction, day, CASE WHEN session IN ('asia', 'lokz', 'nyokz') THEN session ELSE 'other' END AS session, round(top - bottom, 2) AS gap, strftime(t2, '%Y-%m-%dT%H:%M:%S') || direction AS id FROM g)"
_DISPLACEMENT = _ATR + """,
n AS (SELECT tr.*, a.atr, lead(open) OVER w AS o1, lead(high) OVER w AS h1, lead(low) OVER w AS l1, lead(close) OVER w AS c1 FROM tr LEFT JOIN a ON a.symbol = tr.symbol AND a.i = tr.i WINDOW w AS (PARTITION BY tr.symbol ORDER BY tr.i)),
u AS (SELECT *, close > open AS up, coalesce(atr > 0 AND high > low AND i >= 1, FALSE) AS usable, greatest(high, h1) - least(low, l1) AS spread, abs(c1 - open) AS pbody,
      greatest(0, least(high, h1) - greatest(low, l1)) / nullif(least(high - low, h1 - l1), 0) AS overlap FROM n),
v AS (SELECT *, coalesce(usable AND (c1 > o1) = up AND h1 > l1 AND (CASE WHEN up THEN h1 > high AND l1 >= low ELSE l1 < low AND h1 <= high END) AND pbody / (high - low + h1 - l1) >= 0.65 AND overlap <= 0.35
      AND (CASE WHEN up THEN h1 - c1 ELSE c1 - l1 END) / nullif(h1 - l1, 0) <= 0.25 AND (spread / atr >= 1.0 OR pbody / spread >= 0.55), FALSE) AS fits FROM u),
z AS (SELECT *, sum(CASE WHEN fits THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY i) AS run FROM v),
y AS (SELECT *, fits AND row_number() OVER (PARTITION BY symbol, run, fits ORDER BY i) % 2 = 1 AS pair FROM z),
t AS (SELECT *, coalesce(lag(pair) OVER (PARTITION BY symbol ORDER BY i), FALSE) AS taken FROM y),
q AS (SELECT *, CASE WHEN pair THEN spread ELSE high - low END AS rng, CASE WHEN pair THEN pbody ELSE abs(close - open) END AS body FROM t WHERE usable AND NOT taken),
o AS (SELECT *, rng / atr AS am, body / rng AS bo, CASE WHEN up THEN high - close ELSE close - low END / (high - low) AS away FROM q),
f AS (SELECT *, coalesce(NOT pair AND am < 1.25 AND bo >= 0.75 AND away <= 0.10 AND high - low >= 5.0, FALSE) AS decisive FROM o)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "bars_15m": bars_15m,
    "rollup_1h": _rolled("1H"),
    "rollup_4h": _rolled("4H"),
    "rollup_4h_forex": _rolled("4H", "forex"),
    "rollup_1d": _rolled("1D"),
    "rollup_week": _rolled("W1"),
    "rollup_month": _rolled("MN"),
    "session_tags": session_tags,
    "atr_14": atr_14,
    "fvg": fvg,
    "inverse_fvg": inverse_fvg,
    "balanced_ranges": balanced_ranges,
    "body_gaps": body_gaps,
    "swings": swings,
    "swing_labels": swing_labels,
    "near_prices": near_prices,
    "displacement": displacement,
    "displacement_matrix": displacement_matrix,
    "session_levels": session_levels,
    "asia_range": asia_range,
    "asia_matrix": asia_matrix,
    "reference_levels": reference_levels,
    "session_boxes": session_boxes,
    "session_coverage": session_coverage,
    "structure_breaks": structure_breaks,
    "order_blocks": order_blocks,
    "shift_blocks": shift_blocks,
    "retracements": retracements,
    "per_day_stats": per_day_stats,
    "session_distribution": session_distribution,
    "weekly_stats": weekly_stats,
    "compared_runs": compared_runs,
    "weekly_outliers": weekly_outliers,
    "detection_counts": detection_counts,
    "swept_grid": swept_grid,
    "gap_matrix": gap_matrix,
    "swing_matrix": swing_matrix,
    "walk_forward": walk_forward,
    "structure_shifts": structure_shifts,
    "shift_retracements": shift_retracements,
    "funnel": funnel,
    "bar_integrity": bar_integrity,
}

ORACLE_SQL: dict[str, str] = {
    "bars_15m": f"WITH {_BARS} SELECT symbol, strftime(ts_ny, '%Y-%m-%d %H:%M:%S') AS ts_ny, open, high, low, close, volume FROM b",
    "rollup_1h": _rolled_sql("date_trunc('day', ts_ny) + to_minutes(((hour(ts_ny) * 60 + minute(ts_ny)) // 60 * 60)::INT)"),
    "rollup_4h": _rolled_sql("date_trunc('day', ts_ny) + to_minutes(((hour(ts_ny) * 60 + minute(ts_ny)) // 240 * 240)::INT)"),
    "rollup_4h_forex": _rolled_sql("day::TIMESTAMP - INTERVAL 7 HOUR + to_minutes(((hour(ts_ny) * 60 + minute(ts_ny) + 420) % 1440 // 240 * 240)::INT)"),
    "rollup_1d": _rolled_sql("day::TIMESTAMP"),
    "rollup_week": _rolled_sql("date_trunc('week', day)::TIMESTAMP"),
    "rollup_month": _rolled_sql("date_trunc('month', day)::TIMESTAMP"),
    "session_tags": f"WITH {_BARS} SELECT symbol, i AS bar_index, session, CASE WHEN session IN ('lokz', 'nyokz') THEN session END AS kill_zone, CASE hour(ts_ny) WHEN 8 THEN 'a' WHEN 10 THEN 'b' END AS ny_window, strftime(day, '%Y-%m-%d') AS forex_day FROM p",
    "atr_14": f"WITH RECURSIVE {_ATR} SELECT tr.symbol, tr.i AS bar_index, round(t, 6) AS true_range, round(atr, 6) AS atr FROM tr LEFT JOIN a ON a.symbol = tr.symbol AND a.i = tr.i",
    "fvg": f"""WITH {_GAPS} SELECT g.symbol, g.i AS bar_index, g.direction, g.bottom, g.top, round((g.top + g.bottom) / 2, 6) AS ce, round(g.top - g.bottom, 2) AS gap_pips, g.vi AS vi_confluent, round(g.top - g.bottom, 2) >= 5 AS above_floor,
        min(p.i) FILTER (CASE WHEN g.direction = 'bullish' THEN p.low <= (g.top + g.bottom) / 2 ELSE p.high >= (g.top + g.bottom) / 2 END) AS ce_touched_bar,
        min(p.i) FILTER (CASE WHEN g.direction = 'bullish' THEN p.close < g.bottom ELSE p.close > g.top END) AS boundary_closed_bar, strftime(g.t2, '%Y-%m-%d %H:%M:%S') AS time
        FROM g LEFT JOIN p ON p.symbol = g.symbol AND p.i > g.i AND p.i <= g.i + 100 GROUP BY ALL""",
    "inverse_fvg": f"""WITH {_GAPS}, c AS (SELECT g.symbol, g.direction, g.i, min(p.i) AS at_bar FROM g JOIN p ON p.symbol = g.symbol AND p.i > g.i AND p.i <= g.i + 100 AND CASE WHEN g.direction = 'bullish' THEN p.close < g.bottom ELSE p.close > g.top END GROUP BY ALL)
        SELECT symbol, direction, count(*) AS n, round(avg(at_bar - i), 6) AS mean_bars FROM c GROUP BY ALL""",
    "balanced_ranges": f"""WITH {_GAPS} SELECT u.symbol, u.i AS bull_bar, count(*) AS n, round(sum(least(u.top, d.top) - greatest(u.bottom, d.bottom)), 4) AS overlap
        FROM g u JOIN g d ON d.symbol = u.symbol AND u.direction = 'bullish' AND d.direction = 'bearish' AND least(u.top, d.top) > greatest(u.bottom, d.bottom) GROUP BY ALL""",
    "body_gaps": f"""WITH {_GAPS} SELECT symbol, i AS bar_index, CASE WHEN least(open, close) > bt2 THEN 'bullish' ELSE 'bearish' END AS direction, round(CASE WHEN least(open, close) > bt2 THEN least(open, close) - bt2 ELSE bb2 - greatest(open, close) END, 2) AS gap_pips
        FROM l WHERE least(open, close) > bt2 OR greatest(open, close) < bb2""",
    "swings": f"""WITH {_SWINGS}, v AS (SELECT s.symbol, s.i, s.side, min(p.i) AS at_bar FROM s JOIN p ON p.symbol = s.symbol AND p.i > s.i + 2 AND p.i <= s.i + 22 AND CASE s.side WHEN 'high' THEN p.high > s.price ELSE p.low < s.price END GROUP BY ALL),
        o AS (SELECT *, last_value(CASE WHEN side = 'low' THEN price END IGNORE NULLS) OVER f AS pl, last_value(CASE WHEN side = 'high' THEN price END IGNORE NULLS) OVER f AS ph FROM s WINDOW f AS (PARTITION BY symbol ORDER BY i, side ROWS BETWEEN 49 PRECEDING AND 1 PRECEDING))
        SELECT o.symbol, o.i AS bar_index, o.side, o.price, (coalesce(v.at_bar - o.i - 3, least(20, o.n - 1 - o.i - 2)))::INT AS strength, coalesce(round(abs(o.price - CASE o.side WHEN 'high' THEN pl ELSE ph END), 2), 999.0) AS height_pips FROM o LEFT JOIN v ON v.symbol = o.symbol AND v.i = o.i AND v.side = o.side""",
    "swing_labels": f"""WITH {_SWINGS}, w AS (SELECT *, lag(price) OVER (PARTITION BY symbol, side ORDER BY i) AS was FROM s) SELECT symbol, i AS bar_index, side, CASE WHEN price > was THEN CASE side WHEN 'high' THEN 'HH' ELSE 'HL' END WHEN price < was THEN CASE side WHEN 'high' THEN 'LH' ELSE 'LL' END END AS label FROM w""",
    "near_prices": f"""WITH {_SWINGS}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY i) AS rk FROM s) SELECT x.symbol, x.side, x.i AS bar1, z.i AS bar2 FROM k x JOIN k z ON z.symbol = x.symbol AND z.side = x.side AND z.rk > x.rk AND z.rk < x.rk + 20 AND abs(x.price - z.price) <= 2""",
    "displacement": f"""WITH RECURSIVE {_DISPLACEMENT} SELECT symbol, i AS bar_index, i + pair::INT AS bar_index_end, CASE WHEN up THEN 'bullish' ELSE 'bearish' END AS direction, CASE WHEN pair THEN 'CLUSTER_2' ELSE 'SINGLE' END AS displacement_type,
        CASE WHEN decisive THEN 'DECISIVE_OVERRIDE' ELSE 'ATR_RELATIVE' END AS qualification_path, CASE WHEN decisive THEN 'VALID' WHEN am >= 2 THEN 'STRONG' WHEN am >= 1.5 THEN 'VALID' WHEN am >= 1.25 THEN 'WEAK' END AS quality_grade,
        pair OR decisive OR away <= 0.25 AS close_location_pass, round(rng, 2) AS range_pips, round(body, 2) AS body_pips, CASE WHEN up THEN CASE WHEN pair THEN greatest(high, h1) ELSE high END ELSE CASE WHEN pair THEN least(low, l1) ELSE low END END AS extreme_price
        FROM f WHERE am >= 1.0 OR bo >= 0.55 OR decisive""",
    "displacement_matrix": f"""WITH RECURSIVE {_DISPLACEMENT} SELECT symbol, atr_.x AS atr, br_.x AS br, count(*) FILTER ((am >= atr_.x AND bo >= br_.x) OR decisive) AS n_and, count(*) FILTER (am >= atr_.x OR bo >= br_.x OR decisive) AS n_or
        FROM (SELECT * FROM f WHERE am >= 1.0 OR bo >= 0.55 OR decisive), (SELECT unnest([1.0, 1.25, 1.5, 2.0])::DOUBLE AS x) atr_, (SELECT unnest([0.55, 0.6, 0.65, 0.7])::DOUBLE AS x) br_ GROUP BY ALL""",
    "session_levels": f"""WITH {_BARS}, h AS (SELECT symbol, strftime(day, '%Y-%m-%d') AS forex_day, session, max(high) AS high, min(low) AS low FROM p WHERE session <> 'other' GROUP BY ALL) SELECT symbol, forex_day, session, 'high' AS side, high AS price FROM h UNION ALL SELECT symbol, forex_day, session, 'low', low FROM h""",
    "asia_range": f"""WITH {_BARS} SELECT symbol, strftime(day, '%Y-%m-%d') AS forex_day, max(high) AS high, min(low) AS low, count(*) AS bar_count, round((max(high) - min(low)) / 10, 1) AS range_pips, CASE WHEN round((max(high) - min(low)) / 10, 1) < 20 THEN 'TIGHT' ELSE 'WIDE' END AS at_20 FROM p WHERE session = 'asia' GROUP BY symbol, day""",
    "asia_matrix": f"""WITH {_BARS}, r AS (SELECT symbol, day, round((max(high) - min(low)) / 10, 1) AS r FROM p WHERE session = 'asia' GROUP BY ALL) SELECT symbol, t::VARCHAR AS threshold, count(*) FILTER (r < t) AS tight, count(*) FILTER (r >= t) AS wide FROM r, (SELECT unnest([12, 15, 18, 20, 25, 30]) AS t) GROUP BY ALL""",
    "reference_levels": f"""WITH {_BARS}, d AS (SELECT symbol, day, max(high) AS day_high, min(low) AS day_low, coalesce(arg_min(open, i) FILTER (hour(ts_ny) < 17), arg_min(open, i)) AS midnight_open FROM p GROUP BY ALL),
        l AS (SELECT *, lag(day_high) OVER w AS pdh, lag(day_low) OVER w AS pdl, max(day_high) OVER (PARTITION BY symbol) AS pwh, min(day_low) OVER (PARTITION BY symbol) AS pwl FROM d WINDOW w AS (PARTITION BY symbol ORDER BY day))
        SELECT symbol, strftime(day, '%Y-%m-%d') AS forex_day, day_high, day_low, midnight_open, pdh, pdl, pwh, pwl, (pdh + pdl) / 2 AS equilibrium FROM l""",
    "session_boxes": f"""WITH {_BARS}, w AS (SELECT *, CASE session WHEN 'asia' THEN 'ASIA_BOX' WHEN 'pre_london' THEN 'PRE_LONDON_BOX' WHEN 'pre_ny' THEN 'PRE_NY_BOX' END AS box FROM p),
        m AS (SELECT *, (max(high) OVER k + min(low) OVER k) / 2 AS mid, lag(close) OVER (PARTITION BY symbol, day, box ORDER BY i) AS c1 FROM w WHERE box IS NOT NULL WINDOW k AS (PARTITION BY symbol, day, box)),
        x AS (SELECT symbol, day, box, max(high) AS high, min(low) AS low, count(*) AS bar_count, max(i) AS last, count(*) FILTER ((c1 < mid AND close > mid) OR (c1 > mid AND close < mid)) AS mid_cross_count, (max(high) - min(low)) / 10 AS rng,
              abs(arg_max(close, i) - arg_min(open, i)) / 10 AS net, arg_max(close, i) > arg_min(open, i) AS up, least(count(*) FILTER (close > mid), count(*) FILTER (close < mid)) / count(*) AS bal FROM m GROUP BY symbol, day, box HAVING count(*) >= 3),
        y AS (SELECT *, CASE WHEN rng > 0 THEN net / rng ELSE 0 END AS eff, rng <= CASE box WHEN 'ASIA_BOX' THEN 30 WHEN 'PRE_LONDON_BOX' THEN 15 ELSE 20 END AND CASE WHEN rng > 0 THEN net / rng ELSE 0 END <= 0.6 AND mid_cross_count >= 2 AND bal >= 0.3 AS calm FROM x)
        SELECT y.symbol, strftime(y.day, '%Y-%m-%d') AS forex_day, y.box, y.high, y.low, y.bar_count, y.mid_cross_count, round(rng, 6) AS range, round(eff, 6) AS efficiency, round(bal, 6) AS balance_score, CASE WHEN calm THEN 'CONSOLIDATION_BOX' ELSE 'TREND_OR_EXPANSION' END AS classification,
        CASE WHEN NOT calm THEN CASE WHEN up THEN 'UP' ELSE 'DOWN' END END AS trend_direction, strftime(min(p.ts_ny) FILTER (p.high > y.high), '%Y-%m-%d %H:%M:%S') AS high_traded_above, strftime(min(p.ts_ny) FILTER (p.close < y.low), '%Y-%m-%d %H:%M:%S') AS low_closed_below
        FROM y LEFT JOIN p ON p.symbol = y.symbol AND p.day = y.day AND p.i > y.last GROUP BY ALL""",
    "session_coverage": f"""WITH {_BARS} SELECT symbol, strftime(day, '%Y-%m-%d') AS forex_day, session, count(*) AS bars, round(count(*) / (4.0 * CASE session WHEN 'asia' THEN 5 WHEN 'pre_london' THEN 2 WHEN 'lokz' THEN 3 WHEN 'pre_ny' THEN 2 WHEN 'nyokz' THEN 3 ELSE 9 END), 4) AS coverage FROM p GROUP BY symbol, day, session""",
    "structure_breaks": f"WITH {_BREAKS} SELECT symbol, i AS bar_index, direction, pivot_bar, pivot_price, break_type FROM br",
    "order_blocks": f"""WITH {_BREAKS}, ob AS (SELECT br.symbol, br.i, br.direction, max(p.i) AS j FROM br JOIN p ON p.symbol = br.symbol AND p.i < br.i AND p.i >= br.i - 3 AND CASE br.direction WHEN 'bullish' THEN p.close < p.open ELSE p.close > p.open END AND p.high > p.low AND abs(p.close - p.open) / (p.high - p.low) >= 0.1::DOUBLE GROUP BY ALL)
        SELECT ob.symbol, ob.i AS bar_index, ob.direction, ob.j AS block_bar, greatest(q.open, q.close) AS body_top, least(q.open, q.close) AS body_bottom, q.high AS wick_top, q.low AS wick_bottom, count(r.i)::INT AS n_retests, coalesce(string_agg(r.i, ',' ORDER BY r.i), '') AS retests FROM ob JOIN p q ON q.symbol = ob.symbol AND q.i = ob.j
        LEFT JOIN p r ON r.symbol = ob.symbol AND r.i > ob.j AND r.i < ob.j + 30 AND CASE ob.direction WHEN 'bullish' THEN r.low <= greatest(q.open, q.close) ELSE r.high >= least(q.open, q.close) END GROUP BY ALL""",
    "retracements": f"""WITH {_BREAKS}, c AS (SELECT *, abs(close - pivot_price) AS reach, CASE direction WHEN 'bullish' THEN -1.0 ELSE 1.0 END::DOUBLE AS sgn FROM br)
        SELECT symbol, i AS bar_index, direction, round(reach, 6) AS range, round(close + sgn * reach * 0.618::DOUBLE, 6) AS level_618, round(close + sgn * reach * 0.705::DOUBLE, 6) AS level_705, round(close + sgn * reach * 0.79::DOUBLE, 6) AS level_79 FROM c WHERE reach >= 1e-10""",
    "per_day_stats": f"WITH {_DETS}, n AS (SELECT symbol, direction, day, count(*) AS n FROM d GROUP BY ALL) SELECT symbol, direction, count(*) AS days, round(avg(n), 2) AS mean_per_day, round(stddev_pop(n), 2) AS std_per_day FROM n GROUP BY ALL",
    "session_distribution": f"""WITH {_DETS}, n AS (SELECT symbol, session, count(*) AS n FROM d GROUP BY ALL), k AS (SELECT s.symbol, f.session, f.place, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT symbol FROM d) s, (VALUES (0, 'asia'), (1, 'lokz'), (2, 'nyokz'), (3, 'other')) f(place, session) LEFT JOIN n ON n.symbol = s.symbol AND n.session = f.session),
        c AS (SELECT *, round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY symbol), 1) AS pct FROM k), x AS (SELECT *, round(100.0::DOUBLE - sum(pct) OVER (PARTITION BY symbol), 1) AS rest, row_number() OVER (PARTITION BY symbol ORDER BY n DESC, place) AS rk FROM c)
        SELECT symbol, session, n, CASE WHEN rk = 1 AND abs(rest) >= 0.01 THEN round(pct + rest, 1) ELSE pct END AS pct FROM x""",
    "weekly_stats": f"""WITH {_DETS}, v AS (SELECT symbol, date_trunc('week', day)::DATE AS week FROM d WHERE gap >= 20), k AS (SELECT s.symbol, w.week, (SELECT count(*) FROM v WHERE v.symbol = s.symbol AND v.week = w.week) AS n FROM (SELECT DISTINCT symbol FROM v) s, (SELECT DISTINCT week FROM v) w)
        SELECT symbol, count(*) AS weeks, round(avg(n), 4) AS mean, round(stddev_samp(n), 4) AS std, min(n) AS least, max(n) AS most, strftime(first(week ORDER BY n, week), '%Y-%m-%d') AS least_week, count(*) FILTER (n = 0) AS zero_weeks, round(stddev_samp(n) / avg(n), 4) AS cv FROM k GROUP BY symbol""",
    "compared_runs": f"""WITH {_DETS} SELECT symbol, count(*) FILTER (gap >= 5) AS rows_a, count(*) FILTER (gap >= 20) AS rows_b, count(DISTINCT id) FILTER (gap >= 20) AS agreed, count(DISTINCT id) FILTER (gap >= 5) - count(DISTINCT id) FILTER (gap >= 20) AS only_a, 0::BIGINT AS only_b,
        round(count(DISTINCT id) FILTER (gap >= 20)::DOUBLE / count(DISTINCT id) FILTER (gap >= 5), 4) AS agreement FROM d WHERE gap >= 5 GROUP BY symbol""",
    "gap_matrix": f"""WITH {_DETS}, x AS (SELECT d.*, t::DOUBLE AS threshold FROM d, (SELECT unnest([1.0, 5.0, 20.0]) AS t) WHERE gap >= t) SELECT symbol, strftime(day, '%Y-%m-%d') AS forex_day, threshold, count(*) AS n, count(*) FILTER (direction = 'bullish') AS bull, count(*) FILTER (direction = 'bearish') AS bear,
        list_sort(list(gap))[count(*) // 2 + 1] AS median FROM x GROUP BY symbol, day, threshold""",
    "swing_matrix": f"""WITH {_SWINGS}, v AS (SELECT s.symbol, s.i, s.side, min(p.i) AS at_bar FROM s JOIN p ON p.symbol = s.symbol AND p.i > s.i + 2 AND p.i <= s.i + 22 AND CASE s.side WHEN 'high' THEN p.high > s.price ELSE p.low < s.price END GROUP BY ALL),
        g AS (SELECT s.symbol, s.side, coalesce(v.at_bar - s.i - 3, least(20, s.n - 1 - s.i - 2)) AS strength FROM s LEFT JOIN v ON v.symbol = s.symbol AND v.i = s.i AND v.side = s.side)
        SELECT symbol, t AS threshold, count(*) AS n, count(*) FILTER (side = 'high') AS highs, count(*) FILTER (side = 'low') AS lows, round(avg(strength), 4) AS mean_strength FROM g, (SELECT unnest([0, 5, 10]) AS t) WHERE strength >= t GROUP BY ALL""",
    "walk_forward": f"""WITH {_DETS}, m AS (SELECT min(day) AS a, max(day) AS b FROM d), w AS (SELECT a, unnest(range(0, greatest(1, date_diff('day', a, b) - 13), 5)) AS k FROM m),
        x AS (SELECT d.symbol, (w.k // 5)::INT AS window_index, count(*) FILTER (d.day < w.a + w.k::INT + 10) AS train_metric, count(*) FILTER (d.day >= w.a + w.k::INT + 10) AS test_metric FROM d JOIN w ON d.day >= w.a + w.k::INT AND d.day <= w.a + w.k::INT + 14 GROUP BY ALL)
        SELECT symbol, window_index, train_metric, test_metric, test_metric - train_metric AS delta, CASE WHEN train_metric <> 0 THEN round((test_metric - train_metric) * 100.0::DOUBLE / train_metric, 2) END AS delta_pct,
        coalesce(abs(round((test_metric - train_metric) * 100.0::DOUBLE / nullif(train_metric, 0), 2)) <= 20, TRUE) AS passed FROM x""",
    "bar_integrity": f"WITH {_BARS} SELECT symbol, count(*) AS bar_count, 0::BIGINT AS ghost_count, greatest(0, count(DISTINCT ts::DATE) * 1440 - count(*)) AS gap_count, strftime(min(ts::DATE), '%Y-%m-%d') AS first_date, strftime(max(ts::DATE), '%Y-%m-%d') AS last_date FROM b GROUP BY symbol",
}

#: Bar after bar: what suppresses (dir, ext, until, its day), the last pivot used up on either side, and what was found (up, dn).
_SHIFTS = _DISPLACEMENT + _SWINGS[len(_BARS):] + """,
sv AS (SELECT *, lag(price) OVER q AS b1, lag(price, 2) OVER q AS b2, count(*) FILTER (side = 'low') OVER r AS lows, count(*) FILTER (side = 'high') OVER r AS highs FROM s WINDOW q AS (PARTITION BY symbol, side ORDER BY i), r AS (PARTITION BY symbol ORDER BY i RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
dd AS (SELECT symbol, i AS a, i + pair::INT AS e, up, unnest(list_distinct([i, i + pair::INT])) AS b FROM f WHERE (am >= 1.5 AND bo >= 0.6) OR decisive),
cu AS (SELECT p.symbol, p.i, up, arg_min(a, b) AS a, arg_min(e, b) AS e FROM p JOIN dd ON dd.symbol = p.symbol AND dd.b BETWEEN p.i - 1 AND p.i + 3 AND (dd.b >= p.i OR dd.e >= p.i) GROUP BY ALL),
mx AS (SELECT symbol, i, day, high, low, close, [max(high) OVER w0, max(high) OVER w1, max(high) OVER w2, max(high) OVER w3, max(high) OVER w4] AS tops, [min(low) OVER w0, min(low) OVER w1, min(low) OVER w2, min(low) OVER w3, min(low) OVER w4] AS bots FROM p
      WINDOW w0 AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN CURRENT ROW AND CURRENT ROW), w1 AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING), w2 AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING),
      w3 AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING), w4 AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
ft AS MATERIALIZED (SELECT mx.*, coalesce(atr.atr, 0) AS atr, hs.i AS hi, hs.price AS hp, coalesce(hs.lows >= 2 AND hs.b1 < hs.b2, FALSE) AS tu, lo.i AS li, lo.price AS lp, coalesce(lo.highs >= 2 AND lo.b1 > lo.b2, FALSE) AS td, bu.a AS ua, bu.e AS ue, be.a AS da, be.e AS de, hd.up AS here
      FROM mx LEFT JOIN a atr ON atr.symbol = mx.symbol AND atr.i = mx.i ASOF LEFT JOIN (SELECT * FROM sv WHERE side = 'high') hs ON hs.symbol = mx.symbol AND mx.i > hs.i ASOF LEFT JOIN (SELECT * FROM sv WHERE side = 'low') lo ON lo.symbol = mx.symbol AND mx.i > lo.i
      LEFT JOIN cu bu ON bu.symbol = mx.symbol AND bu.i = mx.i AND bu.up LEFT JOIN cu be ON be.symbol = mx.symbol AND be.i = mx.i AND NOT be.up LEFT JOIN dd hd ON hd.symbol = mx.symbol AND hd.b = mx.i),
sf(symbol, i, dir, ext, until, uh, ul, sday, up, dn) AS (SELECT symbol, 0::BIGINT, NULL::BOOLEAN, NULL::DOUBLE, -1::BIGINT, -1::BIGINT, -1::BIGINT, NULL::DATE, FALSE, FALSE FROM ft WHERE i = 0 UNION ALL
  SELECT symbol, i, CASE WHEN up THEN TRUE WHEN dn THEN FALSE WHEN skip OR NOT live THEN dir END, CASE WHEN up THEN tops[(upto - i + 1)] WHEN dn THEN bots[(upto - i + 1)] WHEN skip OR live THEN ext WHEN dir THEN greatest(ext, high) ELSE least(ext, low) END,
      CASE WHEN up OR dn THEN upto ELSE until END, CASE WHEN hb THEN hi ELSE uh END, CASE WHEN lb AND NOT up THEN li ELSE ul END, CASE WHEN up OR dn THEN day ELSE sday END, up, dn
  FROM (SELECT *, greatest(i, CASE WHEN up THEN ue ELSE de END) AS upto FROM (SELECT *, hb AND ua IS NOT NULL AS up, lb AND da IS NOT NULL AND NOT (hb AND ua IS NOT NULL) AS dn FROM
    (SELECT *, live AND coalesce(close > hp AND hi <> uh, FALSE) AS hb, live AND coalesce(close < lp AND li <> ul, FALSE) AS lb FROM
    (SELECT *, NOT skip AND (dir IS NULL OR CASE WHEN dir THEN ext - low ELSE high - ext END >= greatest(5.0, 0.25 * atr) OR coalesce(here <> dir, FALSE) OR day <> sday) AS live FROM
    (SELECT ft.*, sf.dir, sf.ext, sf.until, sf.uh, sf.ul, sf.sday, sf.dir IS NOT NULL AND ft.i <= sf.until AS skip FROM sf JOIN ft ON ft.symbol = sf.symbol AND ft.i = sf.i + 1))))) z),
sh AS (SELECT ft.symbol, ft.i, CASE WHEN sf.up THEN 'bullish' ELSE 'bearish' END AS direction, CASE WHEN CASE WHEN sf.up THEN tu ELSE td END THEN 'REVERSAL' ELSE 'CONTINUATION' END AS break_type, CASE WHEN sf.up THEN hi ELSE li END AS pivot_bar,
      CASE WHEN sf.up THEN hp ELSE lp END AS pivot_price, CASE WHEN sf.up THEN ua ELSE da END AS displacement_bar, CASE WHEN sf.up THEN ue ELSE de END AS displacement_end FROM sf JOIN ft ON ft.symbol = sf.symbol AND ft.i = sf.i WHERE sf.up OR sf.dn)"""
ORACLE_SQL["structure_shifts"] = f"""WITH RECURSIVE {_SHIFTS}, made AS (SELECT DISTINCT symbol, i - 1 AS b FROM (SELECT symbol, bar_index AS i, gap_pips FROM ({ORACLE_SQL["fvg"]})) WHERE gap_pips >= 0.5)
    SELECT symbol, i::INT AS bar_index, direction, break_type, pivot_bar::INT AS pivot_bar, pivot_price, displacement_bar::INT AS displacement_bar, (displacement_bar - i)::INT AS window_used,
    EXISTS (SELECT 1 FROM made WHERE made.symbol = sh.symbol AND made.b IN (sh.displacement_bar, sh.displacement_end)) AS fvg_created FROM sh"""
ORACLE_SQL["shift_blocks"] = ORACLE_SQL["order_blocks"].replace(f"WITH {_BREAKS}", f"WITH RECURSIVE {_SHIFTS}, br AS (SELECT symbol, i, direction FROM sh)")
ORACLE_SQL["shift_retracements"] = f"""WITH RECURSIVE {_SHIFTS}, c AS (SELECT sh.*, p.close, p.session, p.day, abs(p.close - pivot_price) AS reach, CASE direction WHEN 'bullish' THEN -1.0 ELSE 1.0 END::DOUBLE AS sgn FROM sh JOIN p ON p.symbol = sh.symbol AND p.i = sh.i)
    SELECT symbol, i::INT AS bar_index, direction, break_type, round(reach, 6) AS range, round(close + sgn * reach * 0.618::DOUBLE, 6) AS level_618, round(close + sgn * reach * 0.705::DOUBLE, 6) AS level_705, round(close + sgn * reach * 0.79::DOUBLE, 6) AS level_79,
    session IN ('lokz', 'nyokz') AS actionable, CASE WHEN session IN ('asia', 'lokz', 'nyokz') THEN session ELSE 'other' END AS session FROM c WHERE reach >= 1e-10"""
ORACLE_SQL["funnel"] = f"""WITH RECURSIVE {_SHIFTS}, fn AS (SELECT symbol, 'displacement' AS primitive, count(*) AS n FROM f WHERE (am >= 1.5 AND bo >= 0.6) OR decisive GROUP BY symbol UNION ALL SELECT symbol, 'swing', count(*) FROM s GROUP BY symbol UNION ALL SELECT symbol, 'mss', count(*) FROM sh GROUP BY symbol)
    SELECT x.symbol, x.primitive, y.primitive AS upstream, x.n, y.n AS n_upstream, round(x.n::DOUBLE / y.n, 4) AS rate FROM fn x JOIN fn y ON y.symbol = x.symbol AND x.primitive = 'mss' AND y.primitive IN ('displacement', 'swing')"""
ORACLE_SQL["detection_counts"] = " UNION ALL ".join(f"SELECT symbol, '{p}' AS primitive, count(*) AS n FROM ({ORACLE_SQL[q]}) GROUP BY symbol" for p, q in (("fvg", "fvg"), ("swing", "swings"), ("displacement", "displacement")))
ORACLE_SQL["weekly_outliers"] = f"""WITH {_DETS}, v AS (SELECT symbol, date_trunc('week', day)::DATE AS week, count(*) AS n FROM d WHERE gap >= 20 GROUP BY ALL)
    SELECT v.symbol, strftime(v.week, '%Y-%m-%d') AS week, v.n FROM v JOIN ({ORACLE_SQL["weekly_stats"]}) s ON s.symbol = v.symbol WHERE abs(v.n - s.mean) > s.std"""
ORACLE_SQL["swept_grid"] = f"""WITH RECURSIVE {_DISPLACEMENT} SELECT symbol, x.v AS atr, y.v AS body, count(*) FILTER ((am >= x.v AND bo >= y.v) OR decisive) AS detections
    FROM (SELECT * FROM f WHERE am >= 1.0 OR bo >= 0.55 OR decisive), (SELECT unnest([1.1, 1.4, 1.8, 2.5])::DOUBLE AS v) x, (SELECT unnest([0.5, 0.62, 0.8])::DOUBLE AS v) y GROUP BY ALL"""
