"""Structure shifts against a plain loop over random bars."""

import random

import pytest
from test_operators import make

from barspark.operators import bars as B
from barspark.operators import pivots
from barspark.operators.displacement import displacements
from barspark.operators.gaps import fair_value_gaps
from barspark.operators.shift import structure_shifts


def loop(bars, swings, disp, window, pullback, factor):
    at = {}
    for d in disp:
        at.setdefault(d.bar_index, d)
    for d in disp:
        at.setdefault(d.bar_index_end, d)
    out, used, quiet = [], set(), None
    for i, b in enumerate(bars):
        if b.is_ghost or i == 0:
            continue
        if quiet:
            if i <= quiet["until"]:
                continue
            up = quiet["direction"] == "bullish"
            back = quiet["extreme"] - b.low if up else b.high - quiet["extreme"]
            over = back >= max(pullback, factor * (b.atr or 0)) or (i in at and at[i].direction != quiet["direction"]) or b.forex_day != quiet["day"]
            quiet["extreme"] = max(quiet["extreme"], b.high) if up else min(quiet["extreme"], b.low)
            if not over:
                continue
            quiet = None
        for direction, side in (("bullish", "high"), ("bearish", "low")):
            before = [s for s in swings if s.side == side and s.bar_index < i]
            if not before or (side, before[-1].bar_index) in used or not (b.close > before[-1].price if side == "high" else b.close < before[-1].price):
                continue
            used.add((side, before[-1].bar_index))
            found = next((at[k] for k in range(max(0, i - 1), i + window + 1) if k in at and at[k].direction == direction and (at[k].bar_index_end >= i or k >= i)), None)
            if found:
                trend = before[:-1]
                others = [s for s in swings if s.side != side and s.bar_index < before[-1].bar_index]
                turned = len(trend) >= 2 and len(others) >= 2 and (trend[-1].price < trend[-2].price if side == "high" else trend[-1].price > trend[-2].price)
                out.append((i, direction, "REVERSAL" if turned else "CONTINUATION", before[-1].bar_index, found.bar_index))
                until = max(i, found.bar_index_end)
                span = bars[i : until + 1]
                quiet = {"direction": direction, "until": until, "day": b.forex_day, "extreme": max(x.high for x in span) if side == "high" else min(x.low for x in span)}
                break
    return out


def random_bars(spark, seed, n, step):
    rng, rows, c = random.Random(seed), [], 100.0
    for k in range(n):
        o, c = c, c + rng.gauss(0, 1.5)
        rows.append((o, max(o, c) + rng.random() / 2, min(o, c) - rng.random() / 2, c, 0 if k % 50 == 7 or rng.random() < 0.02 else 10))
    return B.with_atr(make(spark, rows, step)).cache()


@pytest.mark.parametrize(("seed", "n", "step", "window"), [(9, 1500, 1, 3), (10, 600, 60, 1), (11, 900, 240, 3)])
def test_structure_shifts(spark, seed, n, step, window):
    """Days of 1,440, 24 and 6 bars, so that suppression and used pivots often go on into the next day."""
    bars = random_bars(spark, seed, n, step)
    swings, disp = pivots.swings(bars, 2, 20, 1.0), displacements(bars, 1.0).where("(atr_exact >= 1.5 AND body_exact >= 0.6) OR decisive")
    gaps = fair_value_gaps(bars, "1m", 1.0, states=False)
    found = structure_shifts(bars, swings, disp, 1.0, window, gaps=gaps).orderBy("bar_index").collect()
    got = [(r.bar_index, r.direction, r.break_type, r.pivot_bar, r.displacement_bar) for r in found]
    want = loop(bars.orderBy("bar_index").collect(), swings.orderBy("bar_index", "side").collect(), disp.orderBy("bar_index").collect(), window, 5.0, 0.25)
    assert len(want) > 20 and got == want
    ends, made = {r.bar_index: r.bar_index_end for r in disp.collect()}, {r.bar_index - 1 for r in gaps.where("gap_pips >= 0.5").collect()}
    assert [r.fvg_created for r in found] == [any(k in made for k in range(r.displacement_bar, ends[r.displacement_bar] + 1)) for r in found]
    assert len({r.fvg_created for r in found}) == 2
