"""The registered queries on daily bars of several years: symbol = return flag, day = ship date, price = price of a piece in lineitem."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import with_tags
from ..operators import bars as B
from ..operators.displacement import displacements
from . import evaluation as E
from .queries import _BARS, _DISPLACEMENT, PIP


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    price = F.col("l_extendedprice").cast("double") / F.col("l_quantity").cast("double")
    t = item.select(F.col("l_returnflag").alias("symbol"), F.col("l_shipdate").cast("timestamp_ntz").alias("ts"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), price.alias("price"))
    order = F.struct("seq", "price")
    b = t.groupBy("symbol", "ts").agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count("*").cast("double").alias("volume"))
    return with_tags(b.select("symbol", F.lit("1D").alias("tf"), "ts", F.col("ts").alias("ts_ny"), "open", "high", "low", "close", "volume", F.lit(False).alias("is_ghost")))


def _strong(bars: DataFrame) -> DataFrame:
    return displacements(B.with_atr(bars), PIP).where("(atr_exact >= 1.5 AND body_exact >= 0.6) OR decisive")


def walk_forward_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Displacements of three months against those of the month after, month by month, each part run afresh."""
    b = daily(spark, sf_dir)
    return E.fresh_walk_forward(b, E.month_windows(b.select("forex_day"), 3, 1, 1), _strong, 15.0)


def walk_forward_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of the mean displacement's size by window."""
    b = daily(spark, sf_dir)
    found = E.fresh_walk_forward(b, E.month_windows(b.select("forex_day"), 3, 1, 1), _strong, 15.0, metric=F.avg("atr_multiple"))
    return E.walk_forward_summary(found, "symbol")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"walk_forward_months": walk_forward_months, "walk_forward_verdict": walk_forward_verdict}

_WINDOWS = """li AS (SELECT l_returnflag AS symbol, l_shipdate AS ts_ny, l_extendedprice::DOUBLE / l_quantity::DOUBLE AS price, l_orderkey * 10 + l_linenumber AS seq FROM lineitem),
dl AS (SELECT symbol, ts_ny, arg_min(price, {'s': seq, 'p': price}) AS open, max(price) AS high, min(price) AS low, arg_max(price, {'s': seq, 'p': price}) AS close FROM li GROUP BY ALL),
mo AS (SELECT date_trunc('month', min(ts_ny)) AS a, date_trunc('month', max(ts_ny)) AS z FROM dl),
wi AS (SELECT k, a + to_months(k::INT) AS s, a + to_months(k::INT + 3) AS m, a + to_months(k::INT + 4) AS e FROM (SELECT a, unnest(range(0, date_diff('month', a, z) - 2)) AS k FROM mo)),
pp AS (SELECT dl.*, k, CASE WHEN ts_ny < m THEN 'train' ELSE 'test' END AS part FROM dl JOIN wi ON ts_ny >= s AND ts_ny < e),
p AS (SELECT symbol || '|' || k || ':' || part AS symbol, row_number() OVER (PARTITION BY symbol, k, part ORDER BY ts_ny) - 1 AS i, open, high, low, close FROM pp)"""
_FRESH = _DISPLACEMENT.replace(_BARS, _WINDOWS)
_METRIC = """, k1 AS (SELECT symbol, {0} AS m FROM f WHERE (am >= 1.5 AND bo >= 0.6) OR decisive GROUP BY symbol),
k2 AS (SELECT split_part(c.symbol, '|', 1) AS symbol, split_part(split_part(c.symbol, '|', 2), ':', 1)::INT AS window_index, split_part(c.symbol, ':', 2) AS part, coalesce(m, 0)::DOUBLE AS m FROM (SELECT DISTINCT symbol FROM p) c LEFT JOIN k1 ON k1.symbol = c.symbol),
k3 AS (SELECT symbol, window_index, max(m) FILTER (part = 'train') AS train_metric, max(m) FILTER (part = 'test') AS test_metric FROM k2 GROUP BY ALL),
k4 AS (SELECT *, test_metric - train_metric AS delta, CASE WHEN train_metric <> 0 THEN round((test_metric - train_metric) * 100.0::DOUBLE / train_metric, 2) END AS delta_pct FROM k3 WHERE train_metric IS NOT NULL AND test_metric IS NOT NULL),
rs AS (SELECT *, coalesce(abs(delta_pct) <= 15, TRUE) AS passed FROM k4)"""

ORACLE_SQL: dict[str, str] = {
    "walk_forward_months": f"WITH RECURSIVE {_FRESH}{_METRIC.format('count(*)')} SELECT symbol, window_index, train_metric, test_metric, delta, delta_pct, passed FROM rs",
    "walk_forward_verdict": f"""WITH RECURSIVE {_FRESH}{_METRIC.format('avg(round(am, 4))')} SELECT symbol, count(*) AS windows, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, round(avg(test_metric), 6) AS mean_test_metric,
        round(stddev_pop(test_metric), 6) AS std_test_metric, round(avg(delta), 6) AS mean_delta, arg_min(window_index, {{'m': test_metric, 'w': window_index}}) AS worst_window,
        CASE WHEN count(*) FILTER (NOT passed) = 0 THEN 'STABLE' WHEN count(*) FILTER (passed) > count(*) FILTER (NOT passed) THEN 'CONDITIONALLY_STABLE' ELSE 'UNSTABLE' END AS verdict FROM rs GROUP BY symbol""",
}
