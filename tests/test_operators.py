"""Hand-made bars: ghosts, equal highs, day boundaries, daylight saving, empty tables."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from barspark.functions import calendar as cal
from barspark.functions import measures
from barspark.operators import bars as B
from barspark.operators import gaps, pivots, structure
from barspark.operators.displacement import displacements
from barspark.plans import evaluation as E
from barspark.sources import bars as S

START = dt.datetime(2024, 1, 8, 14, 0)  # 09:00 in New York
SCHEMA = "symbol string, tf string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def make(spark, rows, step=1, start=START):
    data = [("X", "1m", start + dt.timedelta(minutes=step * k), *map(float, r[:4]), float(r[4]) if len(r) > 4 else 100.0) for k, r in enumerate(rows)]
    df = spark.createDataFrame(data, SCHEMA)
    return B.prepared(df.withColumn("ts_ny", cal.ny_time(F.col("ts"))).withColumn("is_ghost", F.col("volume") == 0))


def test_gap_and_ghost(spark):
    rows = [(1, 2, 1, 2), (2, 4, 2, 4), (4, 6, 3, 5), (5, 5, 2.4, 2.5), (2, 2, 1, 1.5)]
    g = gaps.fair_value_gaps(make(spark, rows), "1m", 1.0).collect()
    bull = [r for r in g if r.direction == "bullish"]
    assert [(r.bar_index, r.bottom, r.top, r.ce_touched_bar, r.boundary_closed_bar) for r in bull] == [(2, 2.0, 3.0, 3, 4)]
    rows[1] = (*rows[1], 0)
    assert not [r for r in gaps.fair_value_gaps(make(spark, rows), "1m", 1.0).collect() if r.bar_index == 2]


def test_equal_highs_take_the_last(spark):
    rows = [(1, h, h - 1, h) for h in (1, 2, 3, 3, 2, 1, 1)]
    p = pivots.swings(make(spark, rows), 2, 20, 1.0).where("side = 'high'").collect()
    assert [(r.bar_index, r.price, r.height_pips) for r in p] == [(3, 3.0, 999.0)]


def test_atr_is_wilders(spark):
    import random

    random.seed(1)
    rows, c = [], 100.0
    for _ in range(700):
        o, c = c, c + random.gauss(0, 1)
        rows.append((o, max(o, c) + random.random(), min(o, c) - random.random(), c))
    got = {r.bar_index: r.atr for r in B.with_atr(make(spark, rows), 14, block=64).collect()}
    tr = [max(h - lo, *( [abs(h - rows[k - 1][3]), abs(lo - rows[k - 1][3])] if k else [0])) for k, (o, h, lo, c) in enumerate(rows)]
    want = sum(tr[:14]) / 14
    assert got[12] is None and got[13] == pytest.approx(want, rel=1e-12)
    for k in range(14, 700):
        want = (want * 13 + tr[k]) / 14
        assert got[k] == pytest.approx(want, rel=1e-11)


def test_forex_day_and_daylight_saving(spark):
    times = ["2024-01-08 21:59:00", "2024-01-08 22:00:00", "2024-03-10 06:59:00", "2024-03-10 07:00:00", "2024-03-11 21:00:00", "2024-11-03 05:30:00", "2024-11-03 06:30:00"]
    df = spark.createDataFrame([(dt.datetime.fromisoformat(t),) for t in times], "ts timestamp_ntz").withColumn("ny", cal.ny_time(F.col("ts")))
    got = [(str(r.ny), str(r.d)) for r in df.select("ny", cal.forex_day(F.col("ny")).alias("d")).collect()]
    assert got == [("2024-01-08 16:59:00", "2024-01-08"), ("2024-01-08 17:00:00", "2024-01-09"), ("2024-03-10 01:59:00", "2024-03-10"), ("2024-03-10 03:00:00", "2024-03-10"), ("2024-03-11 17:00:00", "2024-03-12"), ("2024-11-03 01:30:00", "2024-11-03"), ("2024-11-03 01:30:00", "2024-11-03")]


def test_boundaries(spark):
    rows = [("2024-01-08 04:00:00", "2024-01-08 09:00:00", 2), ("2024-01-08 05:00:00", "2024-01-08 08:00:00", 1), ("2024-01-08 18:00:00", "2024-01-09 18:00:00", 3)]
    df = spark.createDataFrame([(dt.datetime.fromisoformat(a), dt.datetime.fromisoformat(b), n) for a, b, n in rows], "a timestamp_ntz, b timestamp_ntz, n int")
    assert all(r.n == r.got for r in df.select("n", cal.boundaries_between(F.col("a"), F.col("b")).alias("got")).collect())


def test_empty(spark):
    empty = make(spark, [])
    assert gaps.fair_value_gaps(empty, "1m", 1.0).count() == 0
    assert pivots.swings(empty, 2, 20, 1.0).count() == 0
    assert displacements(B.with_atr(empty), 1.0).count() == 0
    assert structure.structure_breaks(empty, 5, "internal").count() == 0
    assert B.rollup(empty, "1H").count() == 0


def test_detection_ids_and_sessions(spark):
    df = spark.createDataFrame([("displacement_5m_2024-01-08T09:35:00_bear",), ("htf_liquidity_H1_2024-01-08T09:35:00_x",), (None,)], "id string")
    assert [r.s for r in df.select(measures.session_from_id(F.col("id")).alias("s")).collect()] == ["nyokz", "other", "other"]


def test_scores(spark):
    df = spark.createDataFrame([("a", "correct"), ("a", "NOISE"), ("a", "MISSED"), ("b", "BORDERLINE")], "primitive string, label string")
    got = {r.primitive: (r.precision, r.recall, r.f1) for r in E.scores(df, "primitive").collect()}
    assert got == {"a": (0.5, 0.5, 0.5), "b": (None, None, None)}


def test_sources(spark, tmp_path):
    (tmp_path / "bars.csv").write_text("timestamp,open,high,low,close,volume\n2024-01-08T00:01:00,1,2,1,2,0\n2024-01-08T00:00:00,1,2,1,2,5\n")
    bars = S.read_bars_csv(spark, str(tmp_path / "bars.csv"), "X")
    assert [(r.bar_count, r.ghost_count, r.gap_count) for r in S.integrity(bars).collect()] == [(2, 1, 1438)]
    (tmp_path / "bad.csv").write_text("timestamp,open\n2024-01-08T00:01:00,1\n")
    with pytest.raises(ValueError):
        S.read_bars_csv(spark, str(tmp_path / "bad.csv"), "X")
    (tmp_path / "l").mkdir()
    row = {"detection_id": "d", "primitive": "fvg", "timeframe": "5m", "label": "correct"}
    (tmp_path / "l/a.json").write_text(json.dumps([row, {"primitive": "fvg"}]))
    (tmp_path / "l/b.json").write_text("{nonsense")
    one = S.read_labels(spark, str(tmp_path / "l"), "validate")
    two = one.withColumn("label", F.lit("NOISE")).withColumn("labelled_by", F.lit("compare"))
    assert [(r.label, r.labelled_by) for r in S.merged_labels(one, two).collect()] == [("CORRECT", "validate")]


def test_streaming_bars_equal_batch(spark, tmp_path):
    from barspark.streaming.bars import streaming_bars

    rows = [("X", START + dt.timedelta(seconds=17 * k), k, float(k % 7)) for k in range(200)]
    ticks = spark.createDataFrame(rows, "symbol string, ts timestamp, seq long, price double")
    ticks.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "in"))
    q = streaming_bars(stream, 5).writeStream.format("memory").queryName("bars_out").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.open, r.high, r.low, r.close, r.volume) for r in spark.sql("SELECT * FROM bars_out").collect())
    batch = B.ticks_to_bars(ticks.withColumn("ts", F.col("ts").cast("timestamp_ntz")), "5m")
    assert got == sorted((r.open, r.high, r.low, r.close, r.volume) for r in batch.collect())
