"""Pools of long timeframes against a plain loop over random bars."""

import datetime as dt
import random

import pytest
from test_operators import make

from barspark.operators import bars as B
from barspark.operators.pools import POOLS, level_pools


def loop(bars, tf):
    tol, between, least, back = POOLS[tf]
    out, n = [], len(bars)
    for side in ("high", "low"):
        hi, pools = side == "high", []
        for i in range(max(2, n - 1 - back), n - 2):
            p = bars[i][side]
            near, far = [bars[i - 1][side], bars[i - 2][side]], [bars[i + 1][side], bars[i + 2][side]]
            if not (all(p >= x for x in near) and all(p > x for x in far) if hi else all(p <= x for x in near) and all(p < x for x in far)):
                continue
            joined = None
            for pool in sorted([q for q in pools if q["live"] and abs(q["price"] - p) <= tol], key=lambda q: abs(q["price"] - p)):
                a = pool["touches"][-1]
                if (bars[a].session == bars[i].session == "asia" and bars[a].forex_day == bars[i].forex_day) or i - a < between:
                    continue
                mid = bars[a + 1 : i]
                if mid:
                    if max(pool["price"] - x.low if hi else x.high - pool["price"] for x in mid) < max(least, 0.25 * (bars[i].atr or 0)):
                        continue
                    if any(x.high > pool["price"] + tol if hi else x.low < pool["price"] - tol for x in mid):
                        pool["live"] = False
                        continue
                pool["touches"].append(i)
                pool["price"] = sorted(bars[k][side] for k in pool["touches"])[len(pool["touches"]) // 2]
                joined = pool
                break
            if joined is None:
                pools.append({"price": p, "touches": [i], "live": True})
        merged = []
        for q in sorted([q for q in pools if q["live"] and len(q["touches"]) >= 2], key=lambda q: q["price"]):
            if merged and abs(q["price"] - merged[-1]["price"]) <= 1.5 * tol:
                both = sorted(merged[-1]["touches"] + q["touches"])
                merged[-1] = {"touches": both, "price": sorted(bars[k][side] for k in both)[len(both) // 2]}
            else:
                merged.append(q)
        for q in merged:
            taken = next((k for k in range(q["touches"][-1] + 1, n) if (bars[k].high > q["price"] if hi else bars[k].low < q["price"])), None)
            out.append((side, q["price"], len(q["touches"]), q["touches"][0], q["touches"][-1], taken))
    return sorted(out)


@pytest.mark.parametrize("tf,seed", [("1H", 1), ("1H", 2), ("4H", 3)])
def test_pools_against_a_loop(spark, tf, seed):
    rng, rows, price = random.Random(seed), [], 100.0
    for _ in range(1400 if tf == "1H" else 2400):
        close = max(60.0, min(140.0, price + rng.randint(-6, 6)))
        rows.append((price, max(price, close) + rng.randint(0, 3), min(price, close) - rng.randint(0, 3), close))
        price = close
    bars = make(spark, rows, step=30 if tf == "1H" else 60, start=dt.datetime(2024, 1, 8, 14, 0))
    rolled = B.with_atr(B.prepared(B.rollup(bars, tf))).orderBy("bar_index").collect()
    found = sorted((r.side, r.price, r.touches, r.first_bar, r.last_bar, r.taken_bar) for r in level_pools(bars, tf, 1.0).collect())
    assert found and found == loop(rolled, tf)
    assert any(r[2] > 2 for r in found)


def test_few_bars_have_no_pools(spark):
    assert level_pools(make(spark, [(1, 2, 1, 2)] * 4, step=60), "1H", 1.0).collect() == []
