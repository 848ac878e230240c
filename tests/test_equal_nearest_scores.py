"""Equal-level pools against a loop, nearest candles, scores of labels at all levels, walk-forward with fresh runs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from test_operators import make

from barspark.operators import bars as B
from barspark.operators import equal_levels, pivots
from barspark.operators.displacement import displacements
from barspark.operators.search import nearest_bars
from barspark.plans import evaluation as E


def test_equal_pools(spark):
    rng, rows, p = random.Random(3), [], 100.0
    for _ in range(400):
        o, p = p, p + rng.gauss(0, 1.5) - 0.05 * (p - 100)
        rows.append((o, max(o, p) + rng.random(), min(o, p) - rng.random(), p))
    b = B.with_atr(make(spark, rows, 15)).cache()
    bars, pip, want = b.orderBy("bar_index").collect(), 0.1, set()
    for side in ("high", "low"):
        points = [r for r in pivots.swings(b, 2, 1, pip).orderBy("bar_index").collect() if r.side == side]
        groups = []
        for x in points:
            tol = max(0.5, 0.15 * (bars[x.bar_index].atr or 0))
            home = next((g for g in groups if abs(x.price - g[0].price) <= g[1]), None)
            if home:
                home[2].append(x)
            else:
                groups.append((x, tol, [x]))
        for lead, _, of in groups:
            a, z, level = of[0].bar_index, of[-1].bar_index, sum(x.price for x in of) / len(of)
            away = [level - r.low if side == "high" else r.high - level for r in bars[a + 1 : z]]
            if len(of) > 1 and z - a >= 4 and away and max(away) >= max(1.0, 0.3 * (bars[a].atr or 0)):
                want.add((side, a, z, len(of), round(level, 6)))
    got = {(r.side, r.first_bar, r.last_bar, r.touches, round(r.level, 6)) for r in equal_levels.equal_pools(b.withColumn("tf", F.lit("15m")), "15m", pip).collect()}
    assert got == want and len(got) > 5


def test_nearest_bars(spark):
    t0 = dt.datetime(2024, 1, 8)
    bars = spark.createDataFrame([("A", "1H", t0 + dt.timedelta(seconds=s)) for s in (0, 1800, 3600, 9000)], "symbol string, tf string, ts_ny timestamp_ntz")
    asked = {0: 0, 899: 0, 900: 0, 901: 1800, 2700: 1800, 4500: 3600, 4501: None, 8100: 9000, 8099: None, -900: 0, 9900: 9000}
    events = spark.createDataFrame([("A", "1H", t0 + dt.timedelta(seconds=s), s) for s in asked] + [("A", "1H", t0, 0), ("B", "1H", t0, 7)], "symbol string, tf string, time timestamp_ntz, n int")
    got = nearest_bars(events, bars).collect()
    assert len(got) == len(asked) + 2 and sum(r.n == 0 for r in got) == 2
    for r in got:
        best = asked[r.n] if r.symbol == "A" else None
        assert (r.nearest, r.seconds) == ((None, None) if best is None else (t0 + dt.timedelta(seconds=best), abs(r.n - best)))


def test_label_scores(spark):
    id_ = "fvg_15m_2024-01-08T{}:00:00_bull"
    labels = [(id_.format("03"), "fvg", "correct"), (id_.format("03"), "fvg", "MISSED"), (id_.format("20"), "fvg", "NOISE"), (id_.format("12"), "swing", "BORDERLINE")]
    got = {(r.level, r.primitive, r.session, r.variant): (r.label_count, r.precision, r.recall) for r in E.label_scores(spark.createDataFrame(labels, "detection_id string, primitive string, label string"), spark.createDataFrame([(id_.format("20"), "v2")], "detection_id string, variant string")).collect()}
    assert got["aggregate", None, None, None] == (4, 0.5, 0.5) and got["variant", "fvg", None, "v2"] == (1, 0.0, None)
    assert [got["session", "fvg", s, None][0] for s in E.SESSIONS] == [1, 2, 0, 0] and got["session", "swing", "lokz", None] == (0, None, None)
    assert len(got) == 1 + 2 + 8 + 1


@pytest.mark.parametrize("floor", [0.0, 1e9])
def test_fresh_walk_forward(spark, floor):
    """Each part is what a run over its own bars alone gives; months without bars are skipped, months without detections are not."""
    rng, rows, p = random.Random(6), [], 100.0
    for _ in range(160):
        o, p = p, p + rng.gauss(0, 3)
        rows.append((o, max(o, p) + rng.random(), min(o, p) - rng.random(), p))
    b = make(spark, rows, 1440).drop("bar_index").where("month(forex_day) <> 4").cache()

    def detect(x):
        return displacements(B.with_atr(x), 1.0).where(F.col("range_pips") >= floor)

    got = {r.window_index: (r.train_metric, r.test_metric, r.passed) for r in E.fresh_walk_forward(b, E.month_windows(b.select("forex_day"), 1, 1, 1), detect, 15.0).collect()}
    n = lambda m: float(detect(B.with_bar_index(b.where(f"month(forex_day) = {m}"))).count())
    want = {k: (n(k + 1), n(k + 2)) for k in (0, 1, 4) if k + 2 <= 6}
    assert {k: v[:2] for k, v in got.items()} == want
    assert all(v[2] for v in got.values()) if floor else any(v[0] > 0 for v in got.values())
