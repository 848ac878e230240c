"""Each registered evaluation and report against its SQL in DuckDB, at the smallest scale, and what the tables don't reach on small ones."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from test_queries import SF, _rows, db  # noqa: F401

from barspark.operators import equal_levels, levels, pivots, sweeps
from barspark.operators.displacement import displacements
from barspark.operators.search import first_later
from barspark.plans import evaluation as E
from barspark.plans import detect, sweeping
from barspark.plans.studies import ORACLE_SQL, QUERIES


def test_all_have_sql():
    # The grouping of pools is greedy in time; see test_pools.py. Sweeps, which detect_weekly holds, are in test_sweeps.py.
    assert set(QUERIES) - set(ORACLE_SQL) == {"level_pools", "detect_weekly"}


def test_all_detectors_hold_the_sweeps(spark):
    """What the run over all detectors gives equals the sweeps by themselves."""
    b = sweeping.weekly(spark, SF, ghosts=False)
    found = detect.detect_all(b.select("symbol", "ts", "ts_ny", "open", "high", "low", "close", "volume", "is_ghost"), ("15m",), 1.0, primitives=("equal_level", "sweep"))
    n = {r.primitive: r.n for r in found.groupBy("primitive").agg(F.count("*").alias("n")).collect()}
    d = displacements(b, 1.0).where("(atr_exact >= 1.5 AND body_exact >= 0.6) OR decisive")
    pool = levels.level_pool(levels.gathered(b, pivots.swings(b, 2, 20, 1.0), 1.0), 1.0, "15m")
    assert n == {"sweep": sweeps.liquidity_sweeps(b, pool, d, "15m", 1.0).count(), "equal_level": equal_levels.equal_pools(b, "15m", 1.0).count()}
    with pytest.raises(ValueError, match="no variant"):
        detect.detect(b, "15m", 1.0, variants={"mss": "other"})


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_study_matches_sql(spark, db, name):  # noqa: F811
    df = QUERIES[name](spark, SF)
    result = db.execute(ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    found = _rows(df.collect(), df.columns)
    assert found and found == _rows(result.fetchall(), columns)


@pytest.mark.parametrize("strict", [True, False])
def test_first_later_against_a_loop(spark, strict):
    rng = random.Random(3)
    rows = [("X", "1m", "bullish", k, float(rng.randint(0, 400))) for k in range(700)]
    values = spark.createDataFrame(rows, "symbol string, tf string, side string, bar_index int, v double")
    events = [(k, "X", "1m", "bullish", rng.randint(-1, 699), float(rng.randint(-1, 40))) for k in range(200)]
    asked = spark.createDataFrame(events, "event int, symbol string, tf string, side string, at int, x double").withColumn("strict", F.lit(strict))
    expect = {}
    for e, _, _, _, at, x in events:
        hits = [r[3] for r in rows if r[3] > at and (r[4] < x if strict else r[4] <= x)]
        if hits:
            expect[e] = hits[0]
    for width in (4, 64):
        assert {r.event: r.found for r in first_later(asked, values, width).collect()} == {e[0]: expect.get(e[0]) for e in events}


def test_month_windows(spark):
    days = spark.createDataFrame([(dt.date(2024, 1, 10),), (dt.date(2024, 5, 2),)], "forex_day date")
    w = E.month_windows(days, 2, 1, 1).orderBy("window_index").collect()
    assert [(r.train_start, r.train_end, r.test_start, r.test_end) for r in w][0] == (dt.date(2024, 1, 1), dt.date(2024, 2, 29), dt.date(2024, 3, 1), dt.date(2024, 3, 31))
    assert len(w) == 3 and w[-1].test_end == dt.date(2024, 5, 31)
    assert not E.month_windows(days.limit(1), 1, 1, 1).collect() and not E.month_windows(days.where("false"), 1, 1, 1).collect()


def test_expected_sparse_is_not_flagged(spark):
    stats = spark.createDataFrame([("mss", "4H", 0.9, 7), ("mss", "5m", 0.9, 0), ("fvg", "4H", 0.1, 5), ("fvg", "5m", 0.1, 1)], "primitive string, tf string, cv double, zero_weeks long")
    weeks = spark.createDataFrame([], "primitive string, tf string")
    flags = {(r.primitive, r.tf): r.flagged for r in E.stability(stats, weeks, "primitive", "tf").collect()}
    assert flags == {("mss", "4H"): False, ("mss", "5m"): True, ("fvg", "4H"): False, ("fvg", "5m"): True}


def test_completion_without_references(spark):
    dets = spark.createDataFrame([("X", "a", ["u1"]), ("X", "b", ["u1", "u2"]), ("X", "c", []), ("Y", "d", [])], "symbol string, id string, upstream_refs array<string>")
    up = spark.createDataFrame([("X", "u1")], "symbol string, id string")
    assert sorted(map(tuple, E.completion(dets, up, up, "symbol").collect())) == [("X", 3, 2, 1), ("Y", 1, 0, 1)]


def test_unstable_candidates_go_last(spark):
    c = spark.createDataFrame([("a", 9.0, 1), ("b", 8.0, 2), ("c", 7.0, 3), ("d", 7.0, 4)], "run_id string, score double, rank int").withColumn("g", F.lit(0))
    v = spark.createDataFrame([("a", "UNSTABLE", 0), ("b", "CONDITIONALLY_STABLE", 0)], "run_id string, verdict string, g int")
    assert [r.run_id for r in E.reranked(c, v, "g").orderBy("new_rank").collect()] == ["b", "c", "d", "a"]
