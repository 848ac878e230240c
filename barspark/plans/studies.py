"""The registered queries on evaluations and reports, beside those of the detectors in queries.py; the same bars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.calendar import iso_week, with_tags
from ..operators import bars as B
from ..operators import gaps, pools, sessions, structure, zones
from ..operators.displacement import displacements
from ..operators.sweeps import in_chunks, of_chunks
from . import detect, reports, search
from . import evaluation as E
from .queries import _BARS, _BREAKS, _DETS, _DISPLACEMENT, _GAPS, _SWINGS, PIP, TF, _breaks, _gap_detections, _swings, _text, bars, prepared
from .queries import ORACLE_SQL as _OTHER

KNOWN = {"2024-W01": "New Year week"}


def extreme_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = B.with_atr(prepared(spark, sf_dir))
    return zones.extreme_blocks(b, structure.structure_breaks(b, 5, "internal")).drop("tf")


def window_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = B.with_atr(prepared(spark, sf_dir))
    g = gaps.fair_value_gaps(b, TF, PIP, states=False)
    return zones.window_events(b, g, _swings(spark, sf_dir), displacements(b, PIP), 3.0).drop("tf")


def level_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pools of hours and of four hours; grouping is greedy in time, so there is no SQL."""
    b = bars(spark, sf_dir)
    return pools.level_pools(b, "1H", PIP).unionByName(pools.level_pools(b, "4H", PIP))


def qualified_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = B.with_atr(prepared(spark, sf_dir))
    d = displacements(b, PIP).where("(atr_exact >= 1.5 AND body_exact >= 0.6) OR decisive")
    return zones.qualified(_breaks(spark, sf_dir), b, d).select("symbol", "bar_index", "direction", "qualification")


def created_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = B.with_atr(prepared(spark, sf_dir))
    d = zones.with_created_gap(displacements(b, PIP), gaps.fair_value_gaps(b, TF, PIP, states=False), 5.0)
    return d.select("symbol", "bar_index", "bar_index_end", "direction", "created_fvg")


def box_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All eight first times of each box."""
    return _text(sessions.session_boxes(prepared(spark, sf_dir), 10.0).select("symbol", "forex_day", "box", *[f"{s}_{v}_{w}" for s in ("high", "low") for v in ("traded", "closed") for w in ("above", "below")]))


def carried_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of asia and lokz of the day before, with the day that they are carried to."""
    levels = sessions.session_levels(prepared(spark, sf_dir))
    return _text(sessions.carried_levels(levels, prepared(spark, sf_dir)).drop("tf"))


def candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(reports.candles(bars(spark, sf_dir), ("15m", "1H", "4H")).drop("is_ghost"))


def session_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(reports.session_bands(prepared(spark, sf_dir)))


def week_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = reports.candles(bars(spark, sf_dir), ("15m", "4H"))
    return _text(reports.week_manifest(both, _gap_detections(spark, sf_dir, 5.0)))


def direction_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _swings(spark, sf_dir).select("symbol", F.lit("swing").alias("primitive"), F.col("side").alias("direction"))
    g = _gap_detections(spark, sf_dir, 5.0).select("symbol", F.lit("fvg").alias("primitive"), "direction")
    return E.direction_distribution(s.unionByName(g), "symbol", "primitive")


def config_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reports.config_report(_gap_detections(spark, sf_dir, 5.0), "symbol")
    text = lambda c, k: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x[k], x["n"].cast("string"))), ",").alias(c)
    return r.select("symbol", "detections", "days", "mean_per_day", "std_per_day", text("by_session", "session"), text("by_direction", "direction"))


def walk_forward_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    dets = _gap_detections(spark, sf_dir, 0.0)
    return E.walk_forward_summary(E.walk_forward(dets, E.rolling_windows(dets.select("forex_day"), 10, 5, 5), 20.0, "symbol"), "symbol")


def divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    big, bull = _gap_detections(spark, sf_dir, 20.0), _gap_detections(spark, sf_dir, 5.0).where("direction = 'bullish'")
    return E.divergence(big, bull, "symbol", "session")


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs that differ in the least gap: of one scan, each gap goes to the runs that keep it."""
    g = gaps.fair_value_gaps(prepared(spark, sf_dir), TF, PIP, states=False)
    kept = F.array_compact(F.array(*[F.when(F.col("gap_pips") >= v, F.lit(f"floor_{v}")) for v in (1, 5, 20)]))
    return g.select("symbol", "forex_day", F.concat_ws("_", F.col("bar_index").cast("string"), "direction").alias("id"), F.explode(kept).alias("run_id"))


def compared_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.compared_all(_runs(spark, sf_dir), "symbol")


def reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs ranked by their detections, those found unstable by walk-forward windows last; the smallest run isn't checked."""
    runs = _runs(spark, sf_dir)
    n = runs.groupBy("symbol", "run_id").agg(F.count("*").alias("score"))
    ranked = n.withColumn("rank", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("score"), "run_id")))
    checked = runs.where("run_id <> 'floor_20'")
    done = E.walk_forward(checked, E.rolling_windows(runs.select("forex_day"), 10, 5, 5), 20.0, "symbol", "run_id")
    return E.reranked(ranked, E.walk_forward_summary(done, "symbol", "run_id"), "symbol").select("symbol", "run_id", "score", "rank", "verdict", "new_rank")


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ("symbol", "direction", "primitive", "tf")
    dets = _gap_detections(spark, sf_dir, 5.0).withColumn("primitive", F.lit("fvg"))
    stats = E.weekly_stats(dets, *by)
    weekly = dets.groupBy(*by, F.to_date(F.date_trunc("week", "forex_day")).alias("week")).agg(F.count("*").alias("n"))
    return E.stability(stats, E.outliers(weekly, stats.select(*by, "mean", "std"), *by, deviations=1.0), *by)


def stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(spark, sf_dir).drop("primitive", "tf")


def stability_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.stability_verdict(_flags(spark, sf_dir))


def outlier_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    dets = _gap_detections(spark, sf_dir, 20.0)
    weekly = dets.groupBy("symbol", F.to_date(F.date_trunc("week", "forex_day")).alias("week")).agg(F.count("*").alias("n"))
    out = E.outliers(weekly, E.weekly_stats(dets, "symbol").select("symbol", "mean", "std"), "symbol", deviations=1.0)
    return _text(E.outlier_causes(out, KNOWN, 1.0).select("symbol", "week", "n", "iso_week", "cause"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels made from the gaps themselves, as the given tables hold none: the kind goes by the bar's number."""
    g = gaps.fair_value_gaps(prepared(spark, sf_dir), TF, PIP, states=False)
    kind = F.element_at(F.array(*map(F.lit, ("CORRECT", "NOISE", "MISSED", "BORDERLINE", "CORRECT"))), F.col("bar_index") % 5 + 1)
    return g.select("symbol", "direction", "gap_pips", F.concat_ws("_", F.col("bar_index").cast("string"), "direction").alias("id"), kind.alias("label"))


def label_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.label_summary(_labels(spark, sf_dir), "symbol", "direction")


def config_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, runs = _labels(spark, sf_dir), _runs(spark, sf_dir)
    out = E.config_scores(labels, runs.where("run_id = 'floor_5'"), runs.where("run_id = 'floor_20'"), "symbol", "direction")
    return out.select("symbol", "direction", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


def scored_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of thresholds ranked by precision and recall over the labels that each detects."""
    sets = search.combinations(spark, {"floor": [1.0, 5.0, 20.0, 50.0]})
    out = search.scored(_labels(spark, sf_dir), sets, F.col("gap_pips") >= F.col("floor"), ["floor"], "symbol")
    return out.select("symbol", "floor", "correct", "noise", "missed", F.round("score", 6).alias("score"), "rank")


def completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order blocks whose breaks are found again when only CHoCH breaks are taken."""
    b = prepared(spark, sf_dir)
    name = F.concat_ws("_", F.col("symbol"), F.col("bar_index").cast("string"), "direction")
    breaks = _breaks(spark, sf_dir)
    blocks = structure.order_blocks(b, breaks, TF).select("symbol", name.alias("id"), F.array(name).alias("upstream_refs"))
    found = breaks.where("break_type = 'CHoCH'").select("symbol", name.alias("id"))
    return E.completion(blocks, found, found, "symbol")


#: The space of the search: thresholds of displacements, whether decisive bars count at any threshold, and which way they point.
SPACE = {
    "displacement.ltf.atr_multiplier": {"type": "numeric", "base": 1.5, "min": 1.0, "max": 3.0, "step": 0.05},
    "displacement.ltf.body_ratio": {"type": "numeric", "base": 0.60, "min": 0.40, "max": 0.85},
    "displacement.override": {"type": "boolean", "base": True},
    "displacement.toward": {"type": "categorical", "base": "both", "options": ["both", "bullish", "bearish"]},
}


def random_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 perturbed sets over all displacements, whose labels go by the bar's number, as the given tables hold none."""
    d = displacements(B.with_atr(prepared(spark, sf_dir)), PIP)
    kind = F.element_at(F.array(*map(F.lit, ("CORRECT", "NOISE", "MISSED", "BORDERLINE", "CORRECT"))), F.col("bar_index") % 5 + 1)
    names = dict(zip(sorted(SPACE), ("atr", "body", "override", "toward"), strict=True))
    of = lambda path, c: F.max(F.when(F.col("path") == path, F.col(c))).alias(names[path])
    sets = search.perturbed(spark, SPACE, 40, 7).groupBy("iteration").agg(*[of(p, "choice" if SPACE[p]["type"] == "categorical" else "value") for p in sorted(SPACE)])
    found = search.searched(d.withColumn("label", kind), sets, "symbol").join(sets.hint("merge"), "iteration")
    return found.select("symbol", "iteration", F.round("atr", 6).alias("atr"), F.round("body", 6).alias("body"), F.col("override").cast("int").alias("override"), "toward", "correct", "noise", "missed", *[F.round(c, 6).alias(c) for c in ("score", "gain")], "kept", "rank")


#: Two ways to build structure shifts and order blocks, in one run.
BOTH = [{"mss": "shift", "order_block": "opposing"}, {"mss": "break", "order_block": "extreme"}]


def detect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections by primitive, variant and direction in both variants; boxes and windows by kind."""
    which = ("fvg", "ifvg", "swing", "displacement", "mss", "order_block", "ote", "asia_range", "session_box", "reference_level", "window")
    found = detect.detect_all(bars(spark, sf_dir), (TF,), PIP, [{"gap_floor": 3.0}], BOTH, which)
    return found.groupBy("symbol", "tf", "primitive", "variant", "direction").agg(F.count("*").alias("n"))


def detect_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels and their sweeps, blocks and retracements on hours and quarters of an hour, each ISO week a series of its own: detections as they are."""
    b = with_tags(bars(spark, sf_dir))
    found = detect.detect_all(in_chunks(b, iso_week(F.col("forex_day"))), ("15m", "1H"), PIP, primitives=("order_block", "ote", "equal_level", "sweep"))
    return _text(of_chunks(found).select("symbol", "chunk", "tf", "primitive", "variant", "id", "time", "direction", F.round("price", 6).alias("price"), "session", "forex_day", F.get_json_object("properties", "$.bar_index").alias("bar_index")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "random_search": random_search,
    "detect_all": detect_all,
    "detect_weekly": detect_weekly,
    "extreme_blocks": extreme_blocks,
    "level_pools": level_pools,
    "window_events": window_events,
    "qualified_breaks": qualified_breaks,
    "created_gaps": created_gaps,
    "box_interactions": box_interactions,
    "carried_levels": carried_levels,
    "candles": candles,
    "session_bands": session_bands,
    "week_manifest": week_manifest,
    "direction_distribution": direction_distribution,
    "config_report": config_report,
    "walk_forward_summary": walk_forward_summary,
    "divergence": divergence,
    "compared_all": compared_all,
    "reranked": reranked,
    "stability": stability,
    "stability_verdict": stability_verdict,
    "outlier_causes": outlier_causes,
    "label_summary": label_summary,
    "config_scores": config_scores,
    "scored_search": scored_search,
    "completion": completion,
}

_STRONG = "(am >= 1.5 AND bo >= 0.6) OR decisive"
_KEPT = "(am >= 1.0 OR bo >= 0.55 OR decisive)"
_LABELS = _GAPS + """, la AS (SELECT symbol, direction, day, round(top - bottom, 2) AS gap, i || '_' || direction AS id, ['CORRECT', 'NOISE', 'MISSED', 'BORDERLINE', 'CORRECT'][(i % 5 + 1)::INT] AS label FROM g),
ru AS (SELECT la.*, 'floor_' || t AS run_id FROM la, (SELECT unnest([1, 5, 20]) AS t) WHERE gap >= t)"""
_SHARE = "CASE WHEN rk = 1 AND abs(rest) >= 0.01 THEN round(pct + rest, 1) ELSE pct END"
_WALK = _LABELS + """, m AS (SELECT min(day) AS a, max(day) AS b FROM ru), w AS (SELECT a, unnest(range(0, greatest(1, date_diff('day', a, b) - 13), 5)) AS k FROM m),
x AS (SELECT d.symbol, d.run_id, (w.k // 5)::INT AS window_index, count(*) FILTER (d.day < w.a + w.k::INT + 10) AS train, count(*) FILTER (d.day >= w.a + w.k::INT + 10) AS test FROM ru d JOIN w ON d.day >= w.a + w.k::INT AND d.day <= w.a + w.k::INT + 14 WHERE run_id <> 'floor_20' GROUP BY ALL),
y AS (SELECT *, coalesce(abs(round((test - train) * 100.0::DOUBLE / nullif(train, 0), 2)) <= 20, TRUE) AS passed FROM x),
v AS (SELECT symbol, run_id, CASE WHEN count(*) FILTER (NOT passed) = 0 THEN 'STABLE' WHEN count(*) FILTER (passed) > count(*) FILTER (NOT passed) THEN 'CONDITIONALLY_STABLE' ELSE 'UNSTABLE' END AS verdict FROM y GROUP BY ALL),
sc AS (SELECT symbol, run_id, count(*) AS score FROM ru GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY score DESC, run_id)::INT AS rank FROM sc)"""
_FLAGS = _DETS + """, k0 AS (SELECT symbol, direction, date_trunc('week', day)::DATE AS week, count(*) AS n FROM d WHERE gap >= 5 GROUP BY ALL),
k AS (SELECT s.symbol, s.direction, w.week, coalesce(k0.n, 0) AS n FROM (SELECT DISTINCT symbol, direction FROM k0) s CROSS JOIN (SELECT DISTINCT week FROM k0) w LEFT JOIN k0 ON k0.symbol = s.symbol AND k0.direction = s.direction AND k0.week = w.week),
st AS (SELECT symbol, direction, round(avg(n), 4) AS mean, round(stddev_samp(n), 4) AS std, round(stddev_samp(n) / avg(n), 4) AS cv, count(*) FILTER (n = 0) AS zero_weeks FROM k GROUP BY ALL),
o AS (SELECT k0.symbol, k0.direction, count(*) AS outlier_weeks FROM k0 JOIN st ON st.symbol = k0.symbol AND st.direction = k0.direction WHERE abs(k0.n - mean) > std GROUP BY ALL),
fl AS (SELECT st.symbol, st.direction, cv, zero_weeks, coalesce(outlier_weeks, 0) AS outlier_weeks, concat_ws(', ', CASE WHEN cv > 0.5 THEN 'variation' END, CASE WHEN zero_weeks > 0 THEN 'zero weeks' END, CASE WHEN outlier_weeks > 3 THEN 'outliers' END) AS reasons
       FROM st LEFT JOIN o ON o.symbol = st.symbol AND o.direction = st.direction)"""
_BOX_TIMES = ", ".join(f"strftime(min(p.ts_ny) FILTER (p.{'close' if v == 'closed' else ('high' if w == 'above' else 'low')} {'>' if w == 'above' else '<'} y.{s}), '%Y-%m-%d %H:%M:%S') AS {s}_{v}_{w}" for s in ("high", "low") for v in ("traded", "closed") for w in ("above", "below"))


def _scores(run: str, suffix: str) -> str:
    c, n, m = (f"count(*) FILTER (label = '{k}')" for k in ("CORRECT", "NOISE", "MISSED"))
    return f"(SELECT symbol, direction, {c}::DOUBLE / nullif({c} + {n}, 0) AS precision_{suffix}, {c}::DOUBLE / nullif({c} + {m}, 0) AS recall_{suffix} FROM ru WHERE run_id = '{run}' GROUP BY ALL)"


def _f1(s: str) -> str:
    return f"CASE WHEN precision_{s} + recall_{s} > 0 THEN 2 * precision_{s} * recall_{s} / (precision_{s} + recall_{s}) END"


ORACLE_SQL: dict[str, str] = {
    "extreme_blocks": f"""WITH RECURSIVE {_BREAKS}, tr AS (SELECT *, CASE WHEN i = 0 THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS t FROM p WINDOW w AS (PARTITION BY symbol ORDER BY i)),
        a(symbol, i, atr) AS (SELECT symbol, 13::BIGINT, avg(t) FROM tr WHERE i < 14 GROUP BY symbol HAVING count(*) = 14 UNION ALL SELECT a.symbol, a.i + 1, (a.atr * 13 + tr.t) / 14 FROM a JOIN tr ON tr.symbol = a.symbol AND tr.i = a.i + 1),
        c AS (SELECT p.*, a.atr FROM p LEFT JOIN a ON a.symbol = p.symbol AND a.i = p.i),
        z AS (SELECT br.symbol, br.i, br.direction, br.pivot_bar, c.i AS block_bar, c.high AS zone_high, c.low AS zone_low FROM br JOIN c ON c.symbol = br.symbol AND c.i > br.pivot_bar AND c.i < br.i AND (c.atr IS NULL OR c.high - c.low < c.atr * 2)
              QUALIFY row_number() OVER (PARTITION BY br.symbol, br.i, br.direction ORDER BY CASE br.direction WHEN 'bullish' THEN c.low ELSE -c.high END, c.i) = 1),
        y AS (SELECT z.*, min(p.i) FILTER (CASE z.direction WHEN 'bullish' THEN p.low <= zone_high ELSE p.high >= zone_low END)::INT AS mitigated_bar, min(p.i) FILTER (CASE z.direction WHEN 'bullish' THEN p.close < zone_low ELSE p.close > zone_high END)::INT AS invalidated_bar
              FROM z LEFT JOIN p ON p.symbol = z.symbol AND p.i > z.block_bar GROUP BY ALL)
        SELECT symbol, i AS bar_index, direction, pivot_bar, block_bar, zone_high, zone_low, mitigated_bar, invalidated_bar, CASE WHEN invalidated_bar IS NOT NULL THEN 'INVALIDATED' WHEN mitigated_bar IS NOT NULL THEN 'MITIGATED' ELSE 'ACTIVE' END AS state FROM y""",
    "window_events": f"""WITH RECURSIVE {_DISPLACEMENT}, dd AS (SELECT symbol, i, i + pair::INT AS e, CASE WHEN up THEN 'bullish' ELSE 'bearish' END AS direction, round(rng, 2) AS value FROM f WHERE {_KEPT} AND ({_STRONG})),
        ny AS (SELECT symbol, i, CASE hour(ts_ny) WHEN 8 THEN 'a' WHEN 10 THEN 'b' END AS win FROM p WHERE hour(ts_ny) IN (8, 10)),
        k AS (SELECT symbol, 'fvg' AS kind, direction AS subtype, bar_index AS i, bar_index AS e, gap_pips AS value FROM ({_OTHER["fvg"]}) WHERE gap_pips >= 3 UNION ALL SELECT symbol, 'swing', side, bar_index, bar_index, price FROM ({_OTHER["swings"]}) UNION ALL SELECT symbol, 'displacement', direction, i, e, value FROM dd)
        SELECT DISTINCT k.symbol, ny.win AS window, k.kind, k.subtype, k.i AS bar_index, k.value FROM k JOIN ny ON ny.symbol = k.symbol AND (ny.i = k.i OR ny.i = k.e)""",
    "qualified_breaks": f"""WITH RECURSIVE {_DISPLACEMENT}, dd AS (SELECT symbol, i, CASE WHEN up THEN 'bullish' ELSE 'bearish' END AS direction FROM f WHERE {_KEPT} AND ({_STRONG})), ev AS ({_OTHER["structure_breaks"]})
        SELECT ev.symbol, ev.bar_index, ev.direction, CASE WHEN bool_or(dd.i < ev.bar_index AND dd.direction <> ev.direction) THEN 'DISP_BEFORE' WHEN bool_or(dd.i >= ev.bar_index AND dd.i <= ev.bar_index + 5 AND dd.direction = ev.direction) THEN 'DISP_AFTER' END AS qualification
        FROM ev LEFT JOIN dd ON dd.symbol = ev.symbol AND dd.i >= ev.bar_index - 10 AND dd.i <= ev.bar_index + 5 GROUP BY ALL""",
    "created_gaps": f"""SELECT d.symbol, d.bar_index, d.bar_index_end, d.direction, g.bar_index IS NOT NULL AS created_fvg FROM ({_OTHER["displacement"]}) d LEFT JOIN (SELECT * FROM ({_OTHER["fvg"]}) WHERE gap_pips >= 5) g ON g.symbol = d.symbol AND g.bar_index = d.bar_index + 1""",
    "box_interactions": f"""WITH {_BARS}, w AS (SELECT *, CASE session WHEN 'asia' THEN 'ASIA_BOX' WHEN 'pre_london' THEN 'PRE_LONDON_BOX' WHEN 'pre_ny' THEN 'PRE_NY_BOX' END AS box FROM p),
        y AS (SELECT symbol, day, box, max(high) AS high, min(low) AS low, max(i) AS last FROM w WHERE box IS NOT NULL GROUP BY ALL HAVING count(*) >= 3)
        SELECT y.symbol, strftime(y.day, '%Y-%m-%d') AS forex_day, y.box, {_BOX_TIMES} FROM y LEFT JOIN p ON p.symbol = y.symbol AND p.day = y.day AND p.i > y.last GROUP BY y.symbol, y.day, y.box, y.high, y.low""",
    "carried_levels": f"""WITH {_BARS}, dy AS (SELECT symbol, day, lag(day) OVER (PARTITION BY symbol ORDER BY day) AS was FROM (SELECT DISTINCT symbol, day FROM p)), h AS (SELECT symbol, day, session, max(high) AS high, min(low) AS low FROM p WHERE session IN ('asia', 'lokz') GROUP BY ALL),
        l AS (SELECT symbol, day, session, 'high' AS side, high AS price FROM h UNION ALL SELECT symbol, day, session, 'low', low FROM h)
        SELECT l.symbol, strftime(dy.day, '%Y-%m-%d') AS forex_day, strftime(l.day, '%Y-%m-%d') AS from_day, 'prev_' || l.session AS session, l.side, l.price, strftime(l.day::TIMESTAMP + INTERVAL 1 HOUR * CASE l.session WHEN 'asia' THEN 0 ELSE 5 END, '%Y-%m-%d %H:%M:%S') AS valid_from FROM l JOIN dy ON dy.symbol = l.symbol AND dy.was = l.day""",
    "candles": " UNION ALL ".join(f"SELECT symbol, '{tf}' AS tf, strftime(CAST(ts_ny::TIMESTAMP + INTERVAL 7 HOUR AS DATE), '%Y-%m-%d') AS forex_day, ts_ny, open, high, low, close, volume FROM ({q})" for tf, q in (("15m", _OTHER["bars_15m"]), ("1H", _OTHER["rollup_1h"]), ("4H", _OTHER["rollup_4h"]))),
    "session_bands": f"""WITH {_BARS}, s AS (SELECT DISTINCT symbol, day, session AS band FROM p WHERE session IN ('asia', 'lokz', 'nyokz') UNION SELECT DISTINCT symbol, day, CASE hour(ts_ny) WHEN 8 THEN 'ny_a' ELSE 'ny_b' END FROM p WHERE hour(ts_ny) IN (8, 10))
        SELECT symbol, strftime(day, '%Y-%m-%d') AS forex_day, band, strftime(day::TIMESTAMP + INTERVAL 1 HOUR * CASE band WHEN 'asia' THEN -5 WHEN 'lokz' THEN 2 WHEN 'nyokz' THEN 7 WHEN 'ny_a' THEN 8 ELSE 10 END, '%Y-%m-%d %H:%M:%S') AS start_time,
        strftime(day::TIMESTAMP + INTERVAL 1 HOUR * CASE band WHEN 'asia' THEN 0 WHEN 'lokz' THEN 5 WHEN 'nyokz' THEN 10 WHEN 'ny_a' THEN 9 ELSE 11 END, '%Y-%m-%d %H:%M:%S') AS end_time FROM s""",
    "direction_distribution": f"""WITH a AS (SELECT symbol, 'swing' AS primitive, side AS direction FROM ({_OTHER["swings"]}) UNION ALL SELECT symbol, 'fvg', direction FROM ({_OTHER["fvg"]}) WHERE gap_pips >= 5),
        s AS (SELECT DISTINCT symbol, primitive, direction FROM (SELECT * FROM a UNION ALL SELECT symbol, primitive, unnest(['bullish', 'bearish']) FROM a)), n AS (SELECT s.*, count(a.direction) AS n, CASE s.direction WHEN 'bullish' THEN 0 WHEN 'bearish' THEN 1 ELSE 2 END AS place FROM s LEFT JOIN a ON a.symbol = s.symbol AND a.primitive = s.primitive AND a.direction = s.direction GROUP BY ALL),
        c AS (SELECT *, round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY symbol, primitive), 1) AS pct FROM n), x AS (SELECT *, round(100.0::DOUBLE - sum(pct) OVER (PARTITION BY symbol, primitive), 1) AS rest, row_number() OVER (PARTITION BY symbol, primitive ORDER BY n DESC, place, direction) AS rk FROM c)
        SELECT symbol, primitive, direction, n, {_SHARE} AS pct FROM x""",
    "config_report": f"""WITH {_DETS}, kept AS (SELECT * FROM d WHERE gap >= 5), n AS (SELECT symbol, day, count(*) AS n FROM kept GROUP BY ALL), s AS (SELECT symbol, sum(n)::BIGINT AS detections, count(*) AS days, round(avg(n), 2) AS mean_per_day, round(stddev_pop(n), 2) AS std_per_day FROM n GROUP BY ALL)
        SELECT s.*, concat_ws(',', 'asia:' || count(*) FILTER (session = 'asia'), 'lokz:' || count(*) FILTER (session = 'lokz'), 'nyokz:' || count(*) FILTER (session = 'nyokz'), 'other:' || count(*) FILTER (session = 'other')) AS by_session,
        concat_ws(',', 'bearish:' || count(*) FILTER (direction = 'bearish'), 'bullish:' || count(*) FILTER (direction = 'bullish')) AS by_direction FROM s JOIN kept ON kept.symbol = s.symbol GROUP BY ALL""",
    "walk_forward_summary": f"""SELECT symbol, count(*) AS windows, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, round(avg(test_metric), 6) AS mean_test_metric, round(stddev_pop(test_metric), 6) AS std_test_metric, round(avg(delta), 6) AS mean_delta, first(window_index ORDER BY test_metric, window_index) AS worst_window,
        CASE WHEN count(*) FILTER (NOT passed) = 0 THEN 'STABLE' WHEN count(*) FILTER (passed) > count(*) FILTER (NOT passed) THEN 'CONDITIONALLY_STABLE' ELSE 'UNSTABLE' END AS verdict FROM ({_OTHER["walk_forward"]}) GROUP BY symbol""",
    "divergence": f"""WITH {_DETS}, once AS (SELECT DISTINCT symbol, session, replace(id, direction, '') AS t, direction, gap FROM d) SELECT symbol, session, 'fvg_15m_' || t || '_' || CASE direction WHEN 'bullish' THEN 'bull' ELSE 'bear' END AS id, CASE WHEN gap >= 20 AND direction = 'bullish' THEN 'Both' WHEN gap >= 20 THEN 'A only' ELSE 'B only' END AS status
        FROM once WHERE gap >= 20 OR (gap >= 5 AND direction = 'bullish')""",
    "compared_all": f"""WITH {_LABELS}, n AS (SELECT s.symbol, r.run_id, count(ru.id) AS n FROM (SELECT DISTINCT symbol FROM ru) s CROSS JOIN (SELECT DISTINCT run_id FROM ru) r LEFT JOIN ru ON ru.symbol = s.symbol AND ru.run_id = r.run_id GROUP BY ALL),
        q AS (SELECT x.symbol, x.run_id AS run_a, y.run_id AS run_b, x.n AS na, y.n AS nb, (SELECT count(*) FROM ru u JOIN ru v ON v.symbol = u.symbol AND v.id = u.id WHERE u.symbol = x.symbol AND u.run_id = x.run_id AND v.run_id = y.run_id) AS agreed FROM n x JOIN n y ON y.symbol = x.symbol AND y.run_id > x.run_id)
        SELECT symbol, run_a, run_b, agreed, na - agreed AS only_a, nb - agreed AS only_b, CASE WHEN na + nb - agreed = 0 THEN 1.0 ELSE round(agreed::DOUBLE / (na + nb - agreed), 4) END AS agreement FROM q""",
    "reranked": f"""WITH {_WALK} SELECT r.symbol, r.run_id, r.score, r.rank, v.verdict, row_number() OVER (PARTITION BY r.symbol ORDER BY CASE WHEN v.verdict IS NULL THEN 1 WHEN v.verdict = 'UNSTABLE' THEN 2 ELSE 0 END, r.score DESC, r.rank)::INT AS new_rank FROM r LEFT JOIN v ON v.symbol = r.symbol AND v.run_id = r.run_id""",
    "stability": f"WITH {_FLAGS} SELECT *, reasons <> '' AS flagged FROM fl",
    "stability_verdict": f"WITH {_FLAGS} SELECT count(*) AS total, count(*) FILTER (reasons <> '') AS flagged, min(cv) AS least_cv, max(cv) AS most_cv, CASE WHEN count(*) FILTER (reasons <> '') = 0 THEN 'PASS' WHEN count(*) FILTER (reasons <> '') <= count(*) * 0.15 THEN 'CONDITIONAL_PASS' ELSE 'FAIL' END AS status FROM fl",
    "outlier_causes": f"""SELECT o.symbol, o.week, o.n, strftime(o.week::DATE, '%G-W%V') AS iso_week, CASE WHEN strftime(o.week::DATE, '%G-W%V') = '2024-W01' THEN 'New Year week' WHEN o.n = 0 THEN 'no detections' WHEN o.n > s.mean + s.std THEN 'more than expected' WHEN o.n < s.mean - s.std THEN 'fewer than expected' ELSE 'within the expected range' END AS cause
        FROM ({_OTHER["weekly_outliers"]}) o JOIN ({_OTHER["weekly_stats"]}) s ON s.symbol = o.symbol""",
    "week_manifest": f"""WITH c AS (SELECT symbol, '15m' AS tf, CAST(ts_ny::TIMESTAMP + INTERVAL 7 HOUR AS DATE) AS day FROM ({_OTHER["bars_15m"]}) UNION ALL SELECT symbol, '4H', CAST(ts_ny::TIMESTAMP + INTERVAL 7 HOUR AS DATE) FROM ({_OTHER["rollup_4h"]})),
        {_DETS}, dw AS (SELECT symbol, date_trunc('week', day)::DATE AS mo, count(*) AS n FROM d WHERE gap >= 5 AND isodow(day) <= 5 GROUP BY ALL), k AS (SELECT symbol, date_trunc('week', day)::DATE AS mo, tf, day FROM c WHERE isodow(day) <= 5)
        SELECT k.symbol, strftime(mo, '%G-W%V') AS week, strftime(mo, '%Y-%m-%d') AS monday, strftime(mo + 4, '%Y-%m-%d') AS friday, count(*) AS bars, count(DISTINCT day)::INT AS forex_days, concat_ws(',', '15m:' || count(*) FILTER (tf = '15m'), '4H:' || count(*) FILTER (tf = '4H')) AS bars_by_tf,
        coalesce((SELECT n FROM dw WHERE dw.symbol = k.symbol AND dw.mo = k.mo), 0) AS detections FROM k GROUP BY k.symbol, k.mo""",
    "label_summary": f"WITH {_LABELS} SELECT symbol, direction, count(*) AS total, count(*) FILTER (label = 'CORRECT') AS correct, count(*) FILTER (label = 'NOISE') AS noise, count(*) FILTER (label = 'BORDERLINE') AS borderline FROM la GROUP BY ALL",
    "config_scores": f"""WITH {_LABELS}, j AS (SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.direction, b.direction) AS direction, precision_a, recall_a, precision_b, recall_b FROM {_scores("floor_5", "a")} a FULL JOIN {_scores("floor_20", "b")} b ON b.symbol = a.symbol AND b.direction = a.direction),
        f AS (SELECT *, {_f1("a")} AS f1_a, {_f1("b")} AS f1_b FROM j) SELECT symbol, direction, round(precision_a, 6) AS precision_a, round(recall_a, 6) AS recall_a, round(f1_a, 6) AS f1_a, round(precision_b, 6) AS precision_b, round(recall_b, 6) AS recall_b, round(f1_b, 6) AS f1_b,
        round(precision_b - precision_a, 6) AS delta_precision, round(recall_b - recall_a, 6) AS delta_recall, round(f1_b - f1_a, 6) AS delta_f1 FROM f""",
    "scored_search": f"""WITH {_LABELS}, n AS (SELECT symbol, t::DOUBLE AS floor, count(*) FILTER (label = 'CORRECT' AND gap >= t) AS correct, count(*) FILTER (label = 'NOISE' AND gap >= t) AS noise, count(*) FILTER (label = 'MISSED' AND gap >= t) AS missed FROM la, (SELECT unnest([1.0, 5.0, 20.0, 50.0]) AS t) GROUP BY ALL),
        s AS (SELECT *, coalesce(correct::DOUBLE / nullif(correct + noise, 0), 0) + coalesce(correct::DOUBLE / nullif(correct + missed, 0), 0) AS score FROM n) SELECT symbol, floor, correct, noise, missed, round(score, 6) AS score, row_number() OVER (PARTITION BY symbol ORDER BY score DESC, floor)::INT AS rank FROM s""",
    "completion": f"""SELECT o.symbol, count(*) AS total, count(b.symbol) AS complete, count(*) - count(b.symbol) AS incomplete FROM ({_OTHER["order_blocks"]}) o LEFT JOIN (SELECT * FROM ({_OTHER["structure_breaks"]}) WHERE break_type = 'CHoCH') b ON b.symbol = o.symbol AND b.bar_index = o.bar_index AND b.direction = o.direction GROUP BY o.symbol""",
}
_PARTS = {
    "fvg": ("''", "direction", _OTHER["fvg"]), "ifvg": ("''", "direction", f"SELECT * FROM ({_OTHER['fvg']}) WHERE boundary_closed_bar IS NOT NULL"), "swing": ("''", "side", _OTHER["swings"]), "displacement": ("''", "direction", _OTHER["displacement"]),
    "mss": ("'shift'", "direction", _OTHER["structure_shifts"]), "mss ": ("'break'", "direction", _OTHER["structure_breaks"]), "order_block": ("'opposing'", "direction", _OTHER["shift_blocks"]), "order_block ": ("'extreme'", "direction", ORACLE_SQL["extreme_blocks"]),
    "ote": ("'shift'", "direction", _OTHER["shift_retracements"]), "ote ": ("'break'", "direction", _OTHER["retracements"]), "asia_range": ("''", "'neutral'", _OTHER["asia_range"]), "session_box": ("''", "lower(box)", _OTHER["session_boxes"]), "reference_level": ("''", "'neutral'", _OTHER["reference_levels"]),
    "window": ("''", '"window" || \'_\' || kind || \'_\' || subtype', ORACLE_SQL["window_events"]),
}
ORACLE_SQL["detect_all"] = " UNION ALL ".join(f"SELECT symbol, '15m' AS tf, '{k.strip()}' AS primitive, {variant} AS variant, {direction} AS direction, count(*) AS n FROM ({sql}) GROUP BY ALL" for k, (variant, direction, sql) in _PARTS.items())
_U = "(('0x' || substr(md5('7:' || it || ':{0}:{1}'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"
_MOVE = "(1.0::DOUBLE + CASE WHEN {1} < 0.5 THEN -1.0 ELSE 1.0 END::DOUBLE * (0.10::DOUBLE + 0.10::DOUBLE * {0}))"
_moved = lambda path, base: f"{base}::DOUBLE * " + _MOVE.format(_U.format(path, 0), _U.format(path, 1))
_A, _B, _O, _T = sorted(SPACE)
ORACLE_SQL["random_search"] = f"""WITH RECURSIVE {_DISPLACEMENT}, it AS (SELECT unnest(range(0, 40))::INT AS it),
    mv AS (SELECT it, greatest(1.0, least(3.0, {_moved(_A, 1.5)}))::DOUBLE AS m, greatest(0.40, least(0.85, {_moved(_B, 0.60)}))::DOUBLE AS body, {_U.format(_O, 0)} < 0.5 AS override, ['both', 'bullish', 'bearish'][floor({_U.format(_T, 0)} * 3)::INT + 1] AS toward FROM it),
    st AS (SELECT it AS iteration, CASE WHEN it = 0 THEN 1.5 ELSE greatest(1.0, least(3.0, 1.0::DOUBLE + round_even((m - 1.0) / 0.05::DOUBLE, 0) * 0.05::DOUBLE)) END::DOUBLE AS atr, CASE WHEN it = 0 THEN 0.60 ELSE body END::DOUBLE AS body, it = 0 OR override AS override, CASE WHEN it = 0 THEN 'both' ELSE toward END AS toward FROM mv),
    lb AS (SELECT symbol, am, bo, decisive, CASE WHEN up THEN 'bullish' ELSE 'bearish' END AS direction, ['CORRECT', 'NOISE', 'MISSED', 'BORDERLINE', 'CORRECT'][i % 5 + 1] AS label FROM f WHERE am >= 1.0 OR bo >= 0.55 OR decisive),
    ct AS (SELECT symbol, iteration, atr, body, override, toward, count(*) FILTER (hit AND label = 'CORRECT') AS correct, count(*) FILTER (hit AND label = 'NOISE') AS noise, count(*) FILTER (hit AND label = 'MISSED') AS missed
      FROM (SELECT *, ((am >= atr AND bo >= body) OR (decisive AND override)) AND toward IN ('both', direction) AS hit FROM lb, st) GROUP BY ALL),
    sc AS (SELECT *, coalesce(correct::DOUBLE / nullif(correct + noise, 0), 0) + coalesce(correct::DOUBLE / nullif(correct + missed, 0), 0) AS score FROM ct),
    gn AS (SELECT *, score - max(score) FILTER (iteration = 0) OVER (PARTITION BY symbol) AS gain FROM sc)
    SELECT symbol, iteration, round(atr, 6) AS atr, round(body, 6) AS body, override::INT AS override, toward, correct, noise, missed, round(score, 6) AS score, round(gain, 6) AS gain, gain > 0 AS kept, row_number() OVER (PARTITION BY symbol ORDER BY score DESC, iteration) AS rank FROM gn"""
