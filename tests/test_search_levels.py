"""The unbounded forward search over several levels of blocks, in many tasks, against a plain search."""

import random

import pytest

from barspark.operators.search import first_later


@pytest.mark.parametrize(("width", "n"), [(4, 3000), (64, 3000), (64, 50)])
def test_first_later(spark, width, n):
    rng = random.Random(n + width)
    walks = {"A": [], "B": []}
    for w in walks.values():
        p = 0.0
        for _ in range(n):
            p += rng.choice([-1, 0, 1]) + 0.02
            w.append(p)
    values = spark.createDataFrame([(s, "1m", "low", k, v) for s, w in walks.items() for k, v in enumerate(w) if k % 17], "symbol string, tf string, side string, bar_index int, v double").repartition(12)
    rows = [(f"{s}{e}", s, "1m", "low", at, round(walks[s][at] + rng.randrange(-30, 3), 2) if e % 3 else walks[s][at], e % 2 == 0, e) for s in walks for e in range(150) for at in [rng.randrange(n)]]
    rows.append(("none", "C", "1m", "low", 3, 1e9, False, 0))
    events = spark.createDataFrame(rows, "event string, symbol string, tf string, side string, at int, x double, strict boolean, more int")
    got = {r.event: (r.found, r.more) for r in first_later(events, values, width).collect()}
    assert len(got) == len(rows)
    for event, s, _, _, at, x, strict, more in rows:
        want = next((k for k in range(at + 1, n) if k % 17 and (walks[s][k] < x or (walks[s][k] == x and not strict))), None) if s in walks else None
        assert got[event] == (want, more), event
