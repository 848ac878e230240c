"""The registered queries on price levels, their sweeps, equal levels and labels: 15-minute bars of the events table; for levels each ISO week is a series of its own, and every 24th bar a ghost."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import iso_week, ny_time, with_tags
from ..functions.measures import detection_id
from ..operators import bars as B
from ..operators import equal_levels, gaps, pivots, sweeps, zones
from ..operators import levels as L
from ..operators.displacement import displacements
from ..operators.search import nearest_bars
from ..sources.store import stored
from . import evaluation as E
from .queries import _ATR, _BARS, _DISPLACEMENT, _GAPS, _SWINGS, _TICKS, PIP, TF, _swings, _text, bars, prepared, ticks
from .queries import ORACLE_SQL as BASE_SQL

_GHOST = "hour(ts_ny) % 6 = 5 AND minute(ts_ny) = 30"


def weekly(spark: SparkSession, sf_dir: str, ghosts: bool = True) -> DataFrame:
    """Bars with ATR, by week."""
    b = with_tags(bars(spark, sf_dir).withColumn("is_ghost", F.expr(_GHOST if ghosts else "false")))
    return stored(B.with_atr(sweeps.in_chunks(b, iso_week(F.col("forex_day")))), "weekly")


def _pool(b: DataFrame) -> DataFrame:
    return stored(L.level_pool(L.gathered(b, pivots.swings(b, 2, 20, PIP), PIP), PIP, TF), "pool")


def _displaced(b: DataFrame) -> DataFrame:
    return displacements(b, PIP).where("(atr_exact >= 1.5 AND body_exact >= 0.6) OR decisive").select("symbol", "tf", "bar_index", "direction")


def level_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = sweeps.of_chunks(_pool(weekly(spark, sf_dir)))
    return _text(pool.select("symbol", "chunk", "side", "level_id", "source", "price", "valid_from", "touch_count", F.array_join("sources_merged", ",").alias("sources")))


def level_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often bars of the week would sweep, go on beyond or probe each level, and where first."""
    b = weekly(spark, sf_dir)
    sign = F.when(F.col("side") == "high", 1.0).otherwise(-1.0)
    met = sweeps.breaches(_pool(b).withColumn("p", sign * F.col("price")), sweeps._mirrored(b, sweeps.WINDOWS[TF]), TF, PIP)
    n = lambda k: F.count_if(F.col("kind") == k).alias(k)
    return met.groupBy("symbol", "side", "level_id").agg(n("sweep"), n("continuation"), n("probe"), F.min("bar_index").alias("first_bar"), F.max_by("kind", -F.col("bar_index")).alias("first_kind"))


def level_dwellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = weekly(spark, sf_dir)
    sign = F.when(F.col("side") == "high", 1.0).otherwise(-1.0)
    d = sweeps.dwellings(b, _pool(b).withColumn("p", sign * F.col("price")), _displaced(b), TF, PIP)
    return d.select("symbol", "side", "level_id", "dwelt.bar_index")


def _sweeps(b: DataFrame) -> DataFrame:
    return sweeps.liquidity_sweeps(b, _pool(b), _displaced(b), TF, PIP)


def liquidity_sweeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds, sweeps with their displacements before or after."""
    b = weekly(spark, sf_dir)
    found = zones.qualified(_sweeps(b), b, _displaced(b))
    found = found.withColumn("qualification", F.when(F.col("type") == "sweep", F.col("qualification")))
    return _text(sweeps.of_chunks(found).drop("tf"))


def sweep_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sweeps.sweep_health(sweeps.of_chunks(_sweeps(weekly(spark, sf_dir))), "symbol", "chunk")
    entries = F.array_join(F.transform(F.array_sort(F.map_entries("pool_sources")), lambda x: F.concat_ws(":", x["key"], x["value"].cast("string"))), ",")
    return found.withColumn("pool_sources", entries)


def delayed_sweeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those at levels that no bar sweeps by itself."""
    b = weekly(spark, sf_dir)
    pool = _pool(b)
    sign = F.when(F.col("side") == "high", 1.0).otherwise(-1.0)
    at_once = sweeps.breaches(pool.withColumn("p", sign * F.col("price")), sweeps._mirrored(b, sweeps.WINDOWS[TF]), TF, PIP).where("kind = 'sweep' and back = 0")
    return sweeps.delayed_sweeps(b, pool, at_once, TF, PIP).drop("tf", "breach_pips", "reclaim_pips")


def equal_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = equal_levels.equal_pools(weekly(spark, sf_dir), TF, PIP)
    return found.select("symbol", "side", "first_bar", "last_bar", F.round("level", 6).alias("level"), "touches", "role")


def gated_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = B.with_atr(prepared(spark, sf_dir))
    return _text(equal_levels.gated_pools(b, PIP).select("symbol", "side", "first_bar", "last_bar", F.round("level", 6).alias("level"), "touches", "forex_day", "window"))


def equal_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = pivots.near_prices(_swings(spark, sf_dir), 20, 5.0)
    return equal_levels.equal_matrix(near, (0.5, 1.0, 2.0, 5.0), PIP, "symbol")


def nearest_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each tick the nearest hourly candle within 900 seconds."""
    t = ticks(spark, sf_dir).select("symbol", F.lit("1H").alias("tf"), "seq", ny_time(F.col("ts")).alias("time"))
    return _text(nearest_bars(t, B.rollup(bars(spark, sf_dir), "1H")).select("symbol", F.col("seq").alias("event_id"), "nearest", "seconds"))


def label_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of gaps and swings by the bar's number (the given tables hold none), those of wide gaps as a variant."""
    g = gaps.fair_value_gaps(prepared(spark, sf_dir), TF, PIP, states=False)
    kind = F.element_at(F.array(*map(F.lit, ("CORRECT", "NOISE", "MISSED", "BORDERLINE", "CORRECT"))), F.col("bar_index") % 5 + 1)
    name = lambda p, time, d: F.concat(F.col("symbol"), F.lit("_"), detection_id(p, F.lit(TF), time, d))
    labels = g.select(name("fvg", F.col("time"), F.col("direction")).alias("detection_id"), F.lit("fvg").alias("primitive"), kind.alias("label"), F.when(F.col("gap_pips") >= 20, "wide").when(F.col("gap_pips") >= 5, "plain").alias("variant"))
    s = _swings(spark, sf_dir)
    more = s.where("session = 'lokz'").select(name("swing", F.col("ts_ny"), F.col("side")).alias("detection_id"), F.lit("swing").alias("primitive"), kind.alias("label"), F.lit(None).cast("string").alias("variant"))
    every = labels.unionByName(more)
    out = E.label_scores(every.drop("variant"), every.where("variant is not null").select("detection_id", "variant"))
    return out.select("level", "primitive", "session", "variant", "label_count", "correct", "noise", "borderline", "missed", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "level_pool": level_pool,
    "level_breaches": level_breaches,
    "level_dwellings": level_dwellings,
    "liquidity_sweeps": liquidity_sweeps,
    "sweep_health": sweep_health,
    "delayed_sweeps": delayed_sweeps,
    "equal_pools": equal_pools,
    "gated_pools": gated_pools,
    "equal_matrix": equal_matrix,
    "nearest_candles": nearest_candles,
    "label_scores": label_scores,
}

_WEEKS = _BARS.replace("p AS (", "p0 AS (") + f""",
p AS (SELECT symbol || '|' || strftime(day, '%G-W%V') AS symbol, row_number() OVER (PARTITION BY symbol, strftime(day, '%G-W%V') ORDER BY ts_ny) - 1 AS i, ts_ny, ts, open, high, low, close, volume, day, session, {_GHOST} AS ghost FROM p0)"""
_POOL = f"""{_ATR.replace(_BARS, _WEEKS)},
sw AS ({BASE_SQL["swings"].replace(_BARS, _WEEKS)}),
dy AS (SELECT symbol, day, max(high) AS high, min(low) AS low FROM p GROUP BY ALL),
pd AS (SELECT symbol, day, lag(high) OVER w AS high, lag(low) OVER w AS low FROM dy WINDOW w AS (PARTITION BY symbol ORDER BY day)),
bx AS (SELECT symbol, day, session, max(high) AS high, min(low) AS low, max(ts_ny) AS till FROM p WHERE session IN ('asia', 'pre_london', 'pre_ny') GROUP BY ALL HAVING count(*) >= 3),
ss AS (SELECT symbol, day, session, max(high) AS high, min(low) AS low FROM p WHERE session IN ('asia', 'lokz') GROUP BY ALL),
wk AS (SELECT symbol, max(high) AS high, min(low) AS low, date_trunc('week', min(day))::TIMESTAMP - INTERVAL 7 HOUR AS since FROM dy GROUP BY symbol),
sd AS (SELECT unnest(['high', 'low']) AS side),
rw AS (SELECT symbol, side, CASE session WHEN 'asia' THEN 'ASIA_H_L' ELSE 'LONDON_H_L' END AS source, session || CASE side WHEN 'high' THEN '_H_' ELSE '_L_' END || strftime(day, '%Y-%m-%d') AS level_id, CASE side WHEN 'high' THEN high ELSE low END AS price,
    day::TIMESTAMP + CASE session WHEN 'lokz' THEN INTERVAL 5 HOUR ELSE INTERVAL 0 HOUR END AS valid_from, day, 1 AS grp, (session = 'lokz')::INT AS n1, CASE session WHEN 'asia' THEN 7 ELSE 6 END AS prio FROM ss, sd
  UNION ALL SELECT symbol, side, 'PDH_PDL', CASE side WHEN 'high' THEN 'PDH_' ELSE 'PDL_' END || strftime(day, '%Y-%m-%d'), CASE side WHEN 'high' THEN high ELSE low END, day::TIMESTAMP - INTERVAL 7 HOUR, day, 2, 0, 1 FROM pd, sd WHERE high IS NOT NULL
  UNION ALL SELECT symbol, side, 'LTF_BOX', CASE session WHEN 'asia' THEN 'ASIA_BOX_' WHEN 'pre_london' THEN 'PRE_LONDON_BOX_' ELSE 'PRE_NY_BOX_' END || strftime(day, '%Y-%m-%d') || CASE side WHEN 'high' THEN '_H' ELSE '_L' END, CASE side WHEN 'high' THEN high ELSE low END, till, day, 3,
    CASE session WHEN 'asia' THEN 0 WHEN 'pre_london' THEN 1 ELSE 2 END, 8 FROM bx, sd
  UNION ALL SELECT symbol, side, CASE side WHEN 'high' THEN 'PWH' ELSE 'PWL' END, CASE side WHEN 'high' THEN 'PWH' ELSE 'PWL' END, CASE side WHEN 'high' THEN high ELSE low END, since, NULL, 5, 0, CASE side WHEN 'high' THEN 2 ELSE 3 END FROM wk, sd),
dd AS (SELECT *, row_number() OVER (PARTITION BY symbol, side, day ORDER BY price, grp, n1, level_id) AS rn FROM (SELECT * FROM rw QUALIFY row_number() OVER (PARTITION BY symbol, source, side, round_even(price / 0.1, 0) ORDER BY grp, day, n1, level_id) = 1)),
mg(symbol, side, day, rn, anchor) AS (SELECT symbol, side, day, rn, price FROM dd WHERE rn = 1 UNION ALL SELECT dd.symbol, dd.side, dd.day, dd.rn, CASE WHEN dd.price - mg.anchor <= 1.0 THEN mg.anchor ELSE dd.price END FROM mg JOIN dd ON dd.symbol = mg.symbol AND dd.side = mg.side AND dd.day IS NOT DISTINCT FROM mg.day AND dd.rn = mg.rn + 1),
lv AS (SELECT dd.symbol, dd.side, first(level_id ORDER BY prio, dd.rn) AS level_id, first(source ORDER BY prio, dd.rn) AS source, first(price ORDER BY prio, dd.rn) AS price, first(valid_from ORDER BY prio, dd.rn) AS valid_from, dd.day, count(*) AS touches, string_agg(source, ',' ORDER BY prio, dd.rn) AS sources, 0::BIGINT AS at_bar
    FROM dd JOIN mg ON mg.symbol = dd.symbol AND mg.side = dd.side AND mg.day IS NOT DISTINCT FROM dd.day AND mg.rn = dd.rn GROUP BY dd.symbol, dd.side, dd.day, mg.anchor
  UNION ALL SELECT sw.symbol, sw.side, 'PS_' || bar_index || '_' || sw.side, 'PROMOTED_SWING', sw.price, p.ts_ny, p.day, 1, 'PROMOTED_SWING', bar_index FROM sw JOIN p ON p.symbol = sw.symbol AND p.i = sw.bar_index WHERE strength >= 10 AND height_pips >= 10)"""
#: Ghosts are no displacement, and no second bar of one.
_DISPLACED = _DISPLACEMENT.replace(_BARS, _WEEKS).replace("high > low AND i >= 1, FALSE", "high > low AND i >= 1 AND NOT ghost, FALSE").replace("lead(open) OVER w AS o1", "lead(ghost) OVER w AS g1, lead(open) OVER w AS o1").replace("coalesce(usable AND (c1", "coalesce(usable AND NOT g1 AND (c1")
#: Bars once for each side, mirrored for low levels, with the next five closes.
_SIDES = f"""{_POOL},
mb AS (SELECT p.symbol, side, p.i, ts_ny, day, ghost, atr, CASE side WHEN 'high' THEN open ELSE -open END AS o, CASE side WHEN 'high' THEN high ELSE -low END AS h, CASE side WHEN 'high' THEN low ELSE -high END AS l, CASE side WHEN 'high' THEN close ELSE -close END AS c0 FROM p LEFT JOIN a ON a.symbol = p.symbol AND a.i = p.i, sd),
m AS (SELECT *, lead(c0) OVER w AS c1, lead(c0, 2) OVER w AS c2, lead(c0, 3) OVER w AS c3, CASE WHEN h > l THEN (h - greatest(o, c0)) / (h - l) ELSE 0 END AS wick FROM mb WINDOW w AS (PARTITION BY symbol, side ORDER BY i)),
lm AS (SELECT *, CASE side WHEN 'high' THEN price ELSE -price END AS x FROM lv),
gt AS (SELECT lm.*, m.i, m.ts_ny, m.day AS bar_day, ghost, atr, o, h, l, c0, c1, c2, c3, wick, h - x AS breach FROM lm JOIN m ON m.symbol = lm.symbol AND m.side = lm.side AND h > x),
bk AS (SELECT *, CASE WHEN c0 < x THEN 0 WHEN c1 < x THEN 1 WHEN c2 < x THEN 2 WHEN c3 < x THEN 3 END AS back, CASE WHEN c0 < x THEN x - c0 WHEN c1 < x THEN x - c1 WHEN c2 < x THEN x - c2 WHEN c3 < x THEN x - c3 END AS reclaim FROM gt),
rj AS (SELECT *, coalesce(reclaim >= 1.0 AND CASE WHEN back = 0 THEN wick ELSE reclaim / nullif(breach + reclaim, 0) END >= 0.4, FALSE) AS swept FROM bk)"""

ORACLE_SQL: dict[str, str] = {
    "level_pool": f"WITH RECURSIVE {_POOL} SELECT regexp_extract(symbol, '^(.*)\\|', 1) AS symbol, regexp_extract(symbol, '\\|(.*)$', 1) AS chunk, side, level_id, source, price, strftime(valid_from, '%Y-%m-%d %H:%M:%S') AS valid_from, touches::INT AS touch_count, sources FROM lv",
    "level_breaches": f"""WITH RECURSIVE {_SIDES}, k AS (SELECT symbol, side, level_id, i, CASE WHEN swept THEN 'sweep' WHEN breach > 1.5 * atr THEN 'continuation' ELSE 'probe' END AS kind FROM rj
        WHERE NOT ghost AND atr IS NOT NULL AND breach >= 1.0 AND CASE source WHEN 'PROMOTED_SWING' THEN i > at_bar AND i - at_bar <= 20 AND day = bar_day ELSE ts_ny >= valid_from END)
        SELECT symbol, side, level_id, count(*) FILTER (kind = 'sweep') AS sweep, count(*) FILTER (kind = 'continuation') AS continuation, count(*) FILTER (kind = 'probe') AS probe, min(i)::INT AS first_bar, arg_min(kind, i) AS first_kind FROM k GROUP BY ALL""",
    "level_dwellings": f"""WITH RECURSIVE {_SIDES}, ds AS (SELECT symbol, bar_index AS i, CASE direction WHEN 'bearish' THEN 'high' ELSE 'low' END AS side FROM (WITH RECURSIVE {_DISPLACED} SELECT symbol, i AS bar_index, CASE WHEN up THEN 'bullish' ELSE 'bearish' END AS direction FROM f WHERE (am >= 1.5 AND bo >= 0.6) OR decisive)),
        k AS (SELECT rj.symbol, rj.side, level_id, i, breach FROM rj WHERE NOT ghost AND ts_ny >= valid_from AND breach >= 0.5 AND NOT swept AND c0 > x AND c1 > x AND NOT EXISTS (SELECT 1 FROM ds WHERE ds.symbol = rj.symbol AND ds.side = rj.side AND ds.i BETWEEN rj.i AND rj.i + 3))
        SELECT symbol, side, level_id, min(i)::INT AS bar_index FROM k GROUP BY ALL""",
    "delayed_sweeps": f"""WITH RECURSIVE {_SIDES}, own AS (SELECT DISTINCT symbol, side, level_id FROM rj WHERE swept AND back = 0 AND NOT ghost AND atr IS NOT NULL AND breach >= 1.0 AND CASE source WHEN 'PROMOTED_SWING' THEN i > at_bar AND i - at_bar <= 20 AND day = bar_day ELSE ts_ny >= valid_from END),
        z AS (SELECT symbol, side, i, lead(wick) OVER (PARTITION BY symbol, side ORDER BY i) AS wick1 FROM m),
        k AS (SELECT gt.*, x - c1 AS reclaim, greatest(gt.wick, wick1) AS rejection FROM gt JOIN z ON z.symbol = gt.symbol AND z.side = gt.side AND z.i = gt.i
        WHERE atr IS NOT NULL AND c0 >= x AND breach BETWEEN 1.0 AND 1.5 * atr AND c1 < x AND x - c1 >= 1.0 AND greatest(gt.wick, wick1) >= 0.3 AND CASE source WHEN 'PROMOTED_SWING' THEN gt.i > at_bar AND gt.i - at_bar <= 20 AND day = bar_day ELSE ts_ny >= valid_from END)
        SELECT symbol, side, level_id, source, price, i::INT AS bar_index, round(rejection, 3) AS rejection, CASE side WHEN 'high' THEN 'bearish' ELSE 'bullish' END AS direction FROM k ANTI JOIN own USING (symbol, side, level_id) QUALIFY row_number() OVER (PARTITION BY symbol, side, level_id ORDER BY i) = 1""",
    "equal_pools": f"""WITH RECURSIVE {_ATR.replace(_BARS, _WEEKS)}{_SWINGS[len(_BARS):]}, pv AS (SELECT s.symbol, s.i, s.side, s.price, coalesce(a.atr, 0) AS atr, greatest(5.0, 0.15 * coalesce(a.atr, 0)) AS tol, row_number() OVER (PARTITION BY s.symbol, s.side ORDER BY s.i) AS rn FROM s LEFT JOIN a ON a.symbol = s.symbol AND a.i = s.i){{0}}
        k AS (SELECT symbol, side, first, min(i) AS first_bar, max(i) AS last_bar, avg(price) AS level, count(*) AS touches, max(price) AS top, min(price) AS bottom, arg_min(atr, i) AS atr FROM cl GROUP BY ALL HAVING count(*) >= 2)
        SELECT k.symbol, k.side, first_bar::INT AS first_bar, last_bar::INT AS last_bar, round(level, 6) AS level, touches::INT AS touches, 'INTERNAL' AS role FROM k JOIN p ON p.symbol = k.symbol AND p.i > first_bar AND p.i < last_bar
        WHERE last_bar - first_bar >= 4 GROUP BY k.symbol, k.side, first_bar, last_bar, level, touches, top, bottom, k.atr HAVING max(CASE k.side WHEN 'high' THEN level - p.low ELSE p.high - level END) >= greatest(10.0, 0.3 * k.atr)""",
    "gated_pools": f"""WITH RECURSIVE {_ATR}, gb AS (SELECT p.*, atr, symbol || '|' || day || ':' || session AS ch FROM p LEFT JOIN a USING (symbol, i) WHERE session IN ('asia', 'pre_london', 'pre_ny')),
        wb AS (SELECT *, row_number() OVER (PARTITION BY ch ORDER BY i) - 1 AS k, count(*) OVER (PARTITION BY ch) AS n FROM gb),
        mk AS (SELECT *, max(high) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS hl, max(high) OVER (w ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS hr, min(low) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS ll, min(low) OVER (w ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS lr FROM wb WHERE n >= 5 WINDOW w AS (PARTITION BY ch ORDER BY k)),
        sd AS (SELECT ch AS symbol, k AS i, 'high' AS side, high AS price, atr FROM mk WHERE k >= 2 AND k < n - 2 AND high >= hl AND high > hr UNION ALL SELECT ch, k, 'low', low, atr FROM mk WHERE k >= 2 AND k < n - 2 AND low <= ll AND low < lr),
        pv AS (SELECT symbol, i, side, price, greatest(2.0, 0.1 * coalesce(atr, 3.0)) AS tol, row_number() OVER (PARTITION BY symbol, side ORDER BY i) AS rn FROM sd){{0}}
        k AS (SELECT symbol, side, first, min(i) AS first_bar, max(i) AS last_bar, avg(price) AS level, count(*) AS touches FROM cl GROUP BY ALL HAVING count(*) >= 2)
        SELECT split_part(symbol, '|', 1) AS symbol, side, first_bar::INT AS first_bar, last_bar::INT AS last_bar, round(level, 6) AS level, touches::INT AS touches, split_part(split_part(symbol, '|', 2), ':', 1) AS forex_day, split_part(symbol, ':', 2) AS "window" FROM k""",
    "equal_matrix": f"""WITH {_SWINGS}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY i) AS rk FROM s), d AS (SELECT x.symbol, x.side, round(abs(x.price - z.price), 2) AS pips FROM k x JOIN k z ON z.symbol = x.symbol AND z.side = x.side AND z.rk > x.rk AND z.rk < x.rk + 20 AND abs(x.price - z.price) <= 5)
        SELECT symbol, t::DOUBLE AS tolerance, count(*) FILTER (side = 'high') AS equal_highs, count(*) FILTER (side = 'low') AS equal_lows FROM d, (SELECT unnest([0.5, 1.0, 2.0, 5.0]) AS t) WHERE pips <= t GROUP BY ALL""",
    "nearest_candles": f"""WITH {_BARS}, c AS (SELECT symbol, date_trunc('hour', ts_ny) AS t FROM p GROUP BY ALL), e2 AS (SELECT event_type AS symbol, event_id, date_trunc('second', (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') AS moment FROM events),
        x AS (SELECT e2.*, b.t AS before, n.t AS after FROM e2 ASOF LEFT JOIN c b ON b.symbol = e2.symbol AND e2.moment >= b.t ASOF LEFT JOIN c n ON n.symbol = e2.symbol AND e2.moment <= n.t),
        y AS (SELECT *, date_diff('second', before, moment) AS db, date_diff('second', moment, after) AS da FROM x)
        SELECT symbol, event_id, CASE WHEN coalesce(db, 9999) <= 900 AND coalesce(db, 9999) <= coalesce(da, 9999) THEN strftime(before, '%Y-%m-%d %H:%M:%S') WHEN da <= 900 THEN strftime(after, '%Y-%m-%d %H:%M:%S') END AS nearest,
        CASE WHEN least(coalesce(db, 9999), coalesce(da, 9999)) <= 900 THEN least(coalesce(db, 9999), coalesce(da, 9999)) END AS seconds FROM y""",
    "label_scores": f"""WITH {_GAPS}{_SWINGS[len(_BARS):]}, lb AS (SELECT 'fvg' AS primitive, i, CASE WHEN hour(t2) >= 19 THEN 'asia' WHEN hour(t2) BETWEEN 2 AND 4 THEN 'lokz' WHEN hour(t2) BETWEEN 7 AND 9 THEN 'nyokz' ELSE 'other' END AS session, CASE WHEN round(top - bottom, 2) >= 20 THEN 'wide' WHEN round(top - bottom, 2) >= 5 THEN 'plain' END AS variant FROM g
          UNION ALL SELECT 'swing', s.i, 'lokz', NULL FROM s JOIN p ON p.symbol = s.symbol AND p.i = s.i WHERE p.session = 'lokz'),
        q AS (SELECT *, ['CORRECT', 'NOISE', 'MISSED', 'BORDERLINE', 'CORRECT'][i % 5 + 1] AS label FROM lb),
        c AS (SELECT CASE WHEN grouping(session) = 0 THEN 'session' WHEN grouping(variant) = 0 THEN 'variant' WHEN grouping(primitive) = 0 THEN 'primitive' ELSE 'aggregate' END AS level, primitive, session, variant, count(*) AS n, count(*) FILTER (label = 'CORRECT') AS correct, count(*) FILTER (label = 'NOISE') AS noise,
          count(*) FILTER (label = 'BORDERLINE') AS borderline, count(*) FILTER (label = 'MISSED') AS missed FROM q GROUP BY GROUPING SETS ((), (primitive), (primitive, session), (primitive, variant))),
        sp AS (SELECT 'session' AS level, primitive, unnest(['asia', 'lokz', 'nyokz', 'other']) AS session, NULL::VARCHAR AS variant FROM c WHERE level = 'primitive'),
        z AS (SELECT * FROM c WHERE level <> 'session' AND NOT (level = 'variant' AND variant IS NULL) UNION ALL SELECT sp.*, coalesce(n, 0), coalesce(correct, 0), coalesce(noise, 0), coalesce(borderline, 0), coalesce(missed, 0) FROM sp LEFT JOIN c ON c.level = 'session' AND c.primitive = sp.primitive AND c.session = sp.session),
        r AS (SELECT *, correct::DOUBLE / nullif(correct + noise, 0) AS pr, correct::DOUBLE / nullif(correct + missed, 0) AS re FROM z)
        SELECT level, primitive, session, variant, n AS label_count, correct, noise, borderline, missed, round(pr, 6) AS precision, round(re, 6) AS recall, round(2 * pr * re / nullif(pr + re, 0), 6) AS f1 FROM r""",
}
#: Pivots in order, each to the first leader that has it within its tolerance; leaders are kept as a list.
_CLUSTERS = """,
fo(symbol, side, rn, leaders, first) AS (SELECT symbol, side, rn, [{'i': i, 'price': price, 'tol': tol}], i FROM pv WHERE rn = 1 UNION ALL
  SELECT symbol, side, rn, CASE WHEN len(hit) > 0 THEN leaders ELSE list_append(leaders, {'i': i, 'price': price, 'tol': tol}) END, CASE WHEN len(hit) > 0 THEN hit[1].i ELSE i END
  FROM (SELECT pv.*, leaders, list_filter(leaders, lambda x: abs(pv.price - x.price) <= x.tol) AS hit FROM fo JOIN pv ON pv.symbol = fo.symbol AND pv.side = fo.side AND pv.rn = fo.rn + 1)),
cl AS (SELECT pv.*, fo.first FROM pv JOIN fo ON fo.symbol = pv.symbol AND fo.side = pv.side AND fo.rn = pv.rn),"""
for _name in ("equal_pools", "gated_pools"):
    ORACLE_SQL[_name] = ORACLE_SQL[_name].replace("{0}", _CLUSTERS)
