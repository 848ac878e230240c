"""Level pools and sweeps against plain loops over random bars with ghosts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from test_operators import make

from barspark.operators import bars as B
from barspark.operators import levels as L
from barspark.operators import pivots, sweeps
from barspark.sources.store import stored

DAY0 = dt.date(1970, 1, 1)


def walk(seed, n, step, ghosts=0.04, size=1.0):
    rng, rows, p = random.Random(seed), [], 100.0
    for _ in range(n):
        o, c = p, p + rng.gauss(0, size)
        if rng.random() < 0.03:
            c += rng.choice([-4, 4]) * size
        h, low = max(o, c) + abs(rng.gauss(0, size * 0.7)), min(o, c) - abs(rng.gauss(0, size * 0.7))
        rows.append(tuple(round(x, 1) for x in (o, h, low, c)) + (0 if rng.random() < ghosts else 100,))
        p = c - 0.02 * (p - 100)
    return rows


def hours_between(a, b):
    n, day = 0, a.date()
    while day <= b.date():
        n += sum(a < dt.datetime.combine(day, dt.time(h)) <= b for h in (5, 8, 17))
        day += dt.timedelta(days=1)
    return n


def side_of(bar, side):
    """o, h, l, c with the level's side up."""
    o, h, low, c = bar.open, bar.high, bar.low, bar.close
    return (o, h, low, c) if side == "high" else (-o, -low, -h, -c)


def loop(bars, levels, displaced, tf, pip):
    """Bars in order, levels in order, state by level."""
    floor, window, dwell = {"1m": 0.5, "5m": 0.5, "15m": 1.0}.get(tf, 0.5) * pip, {"1m": 2, "5m": 3, "15m": 4}.get(tf, 3), {"1m": 3, "5m": 3, "15m": 2}.get(tf, 2)
    levels, gone, counts, out = [dict(x) for x in levels], set(), {}, []

    def closes_back(i, side, p, n):
        return next((j for j in range(i, min(i + n, len(bars))) if side_of(bars[j], side)[3] < p), None)

    def rejects(i, j, side, p):
        o, h, low, c = side_of(bars[i], side)
        if i == j:
            return (h - max(o, c)) / (h - low) if h > low else 0.0
        back = p - side_of(bars[j], side)[3]
        return back / (h - p + back) if h - p + back > 0 else 0.0

    for i, bar in enumerate(bars):
        if bar.is_ghost or bar.atr is None:
            continue
        for lv in list(levels):
            key, side, p = (lv["id"], lv["side"]), lv["side"], lv["p"]
            if key in gone:
                continue
            if lv["source"] == "PROMOTED_SWING":
                if not (0 < i - lv["bar"] <= 20) or lv["day"] != bar.forex_day:
                    continue
            elif lv["source"] == "SWEEP_EVENT":
                if bar.ts_ny <= lv["from"] or hours_between(lv["from"], bar.ts_ny) > 3:
                    continue
            elif lv["from"] is not None and bar.ts_ny < lv["from"]:
                continue
            h, low = side_of(bar, side)[1], side_of(bar, side)[2]
            if not h > p or h - p < floor:
                continue
            j = closes_back(i, side, p, window)
            kind = None
            if j is not None and p - side_of(bars[j], side)[3] >= floor and rejects(i, j, side, p) >= 0.4:
                kind = "sweep"
            elif h - p > 1.5 * bar.atr:
                kind = "sweep_continuation"
            if kind:
                gone.add(key)
                out.append((kind, None, side, lv["id"], j if kind == "sweep" else i))
                for other in levels:
                    k = (other["id"], other["side"])
                    if other["side"] == side and k not in gone and (other["from"] is None or bar.ts_ny >= other["from"]) and abs(other["p"] - p) >= 1e-10 and low < other["p"] < h:
                        gone.add(k)
                        out.append(("sweep_consumed", "pass_through", side, other["id"], i))
                if kind == "sweep" and lv["depth"] < 2:
                    levels.append({"id": f"{lv['id']}>{i}", "side": side, "p": h, "source": "SWEEP_EVENT", "bar": j, "from": bars[j].ts_ny, "day": bar.forex_day, "depth": lv["depth"] + 1})
            else:
                last, n = counts.get(key, (-9, 0))
                counts[key] = (i, n + 1 if i - last < 3 else 1)
                if counts[key][1] >= 5:
                    gone.add(key)
                    out.append(("sweep_consumed", "probes", side, lv["id"], i))
    dwelt = {}
    for lv in levels:
        side, p = lv["side"], lv["p"]
        for i, bar in enumerate(bars):
            if bar.is_ghost or (lv["from"] is not None and bar.ts_ny < lv["from"]) or side_of(bar, side)[1] - p < 0.5 * pip or i + dwell > len(bars):
                continue
            j = closes_back(i, side, p, dwell + 2)
            if j is not None and p - side_of(bars[j], side)[3] >= floor and rejects(i, j, side, p) >= 0.4:
                continue
            if any(side_of(bars[k], side)[3] <= p for k in range(i, i + dwell)):
                continue
            if any((k, "bearish" if side == "high" else "bullish") in displaced for k in range(i, min(i + dwell + 2, len(bars)))):
                continue
            dwelt[lv["id"], side] = i
            break
    out = [x for x in out if x[0] != "sweep" or (x[3], x[2]) not in dwelt or x[4] <= dwelt[x[3], x[2]]]
    return sorted(map(str, out + [("sweep_consumed", "dwell", s, id_, i) for (id_, s), i in dwelt.items()]))


@pytest.mark.parametrize(("seed", "tf", "step"), [(1, "15m", 15), (3, "5m", 5)])
def test_sweeps(spark, seed, tf, step):
    b = B.with_atr(make(spark, walk(seed, 480, step), step).withColumn("tf", F.lit(tf))).cache()
    pool = stored(L.level_pool(L.gathered(b, pivots.swings(b, 2, 20, 1.0), 0.3), 0.3, tf), "pool")
    rng = random.Random(seed)
    displaced = {(k, d) for k in range(480) for d in ("bullish", "bearish") if rng.random() < 0.05}
    table = spark.createDataFrame([("X", tf, k, d) for k, d in displaced], "symbol string, tf string, bar_index int, direction string")
    got = sweeps.liquidity_sweeps(b, pool, table, tf, 0.3).collect()
    sign = {"high": 1, "low": -1}
    levels = [{"id": r.level_id, "side": r.side, "p": sign[r.side] * r.price, "source": r.source, "bar": r.level_bar, "from": r.valid_from, "day": r.forex_day, "depth": 0} for r in pool.orderBy("place").collect()]
    want = loop(b.orderBy("bar_index").collect(), levels, displaced, tf, 0.3)
    assert sorted(str((r.type, r.reason, r.side, r.level_id, r.bar_index)) for r in got) == want
    kinds = {(r.type, r.reason) for r in got}
    assert len(want) > 20 and len(kinds) >= (4 if tf == "15m" else 3) and any(">" in r.level_id for r in got)


def test_level_pool(spark):
    b = B.with_atr(make(spark, walk(7, 700, 15), 15).withColumn("tf", F.lit("15m"))).cache()
    levels = L.gathered(b, pivots.swings(b, 2, 20, 1.0), 1.0).cache()
    rows = [r for r in levels.orderBy("raw", "level_id").collect() if r.source != "PROMOTED_SWING"]
    seen, kept = set(), []
    for r in rows:
        key = (r.source, r.side, round(r.price / 0.1))
        if key not in seen:
            seen.add(key)
            kept.append(r)
    want, priority = set(), {s: k for k, s in enumerate(L.SOURCES)}
    for part in {(r.side, r.forex_day) for r in kept}:
        pools = []
        for r in sorted((r for r in kept if (r.side, r.forex_day) == part), key=lambda r: r.price):
            if pools and abs(r.price - pools[-1][0].price) <= 1.0:
                pools[-1].append(r)
            else:
                pools.append([r])
        want |= {(min(p, key=lambda r: priority[r.source]).level_id, part[0], len(p)) for p in pools}
    got = {(r.level_id, r.side, r.touch_count) for r in L.level_pool(levels, 1.0, "15m").where("source <> 'PROMOTED_SWING'").collect()}
    assert got == want and max(x[2] for x in got) > 1
    assert not L.level_pool(levels, 1.0, "5m").where("source = 'PROMOTED_SWING'").count()


def test_delayed_sweeps(spark):
    b = B.with_atr(make(spark, walk(9, 480, 15, 0), 15).withColumn("tf", F.lit("15m"))).cache()
    pool = stored(L.level_pool(L.gathered(b, pivots.swings(b, 2, 20, 1.0), 0.3), 0.3, "15m"), "pool")
    bars, done = b.orderBy("bar_index").collect(), pool.where("place % 5 = 0").cache()
    skip, want = {(r.level_id, r.side) for r in done.collect()}, {}
    for i in range(len(bars) - 1):
        for lv in pool.collect():
            key, p, x, y = (lv.level_id, lv.side), (lv.price if lv.side == "high" else -lv.price), side_of(bars[i], lv.side), side_of(bars[i + 1], lv.side)
            wick = max((z[1] - max(z[0], z[3])) / (z[1] - z[2]) if z[1] > z[2] else 0 for z in (x, y))
            if bars[i].atr is None or key in skip or key in want:
                continue
            if lv.source == "PROMOTED_SWING":
                if not 0 < i - lv.level_bar <= 20 or lv.forex_day != bars[i].forex_day:
                    continue
            elif bars[i].ts_ny < lv.valid_from:
                continue
            if x[1] > p and x[3] >= p and 0.3 <= x[1] - p <= 1.5 * bars[i].atr and y[3] < p and p - y[3] >= 0.3 and wick >= 0.3:
                want[key] = i
    got = {(r.level_id, r.side): r.bar_index for r in sweeps.delayed_sweeps(b, pool, done, "15m", 0.3).collect()}
    assert got == want and len(got) > 3


def test_chunks_start_afresh(spark):
    b = make(spark, walk(5, 300, 60, 0), 60).drop("bar_index")
    chunked = sweeps.in_chunks(b, F.date_format("forex_day", "yyyy-MM-dd"))
    with_atr = sweeps.of_chunks(B.with_atr(chunked))
    assert with_atr.where("bar_index < 13 and atr is not null").count() == 0
    assert with_atr.select("symbol").distinct().collect()[0].symbol == "X" and with_atr.select("chunk").distinct().count() > 5


def test_health(spark):
    rows = [("A", "PWH", "sweep", None), ("A", "PWH", "sweep_continuation", None), ("A", "PWL", "sweep_consumed", "pass_through"), ("B", "PWL", "sweep_consumed", "dwell")]
    got = {r.symbol: r for r in sweeps.sweep_health(spark.createDataFrame(rows, "symbol string, source string, type string, reason string"), "symbol").collect()}
    assert (got["A"].total_events, got["A"].sweep_count, got["A"].pass_through_count, got["A"].cont_sweep_ratio, got["A"].pool_sources) == (3, 1, 1, 1.0, {"PWH": 2, "PWL": 1})
    assert got["B"].cont_sweep_ratio is None and got["B"].consumed_count == 1
