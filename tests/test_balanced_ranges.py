"""The registered query against a plain loop over all gaps of the table, whatever their day."""

import datetime as dt
from collections import defaultdict

import pytest

from barspark.operators import gaps
from barspark.plans import queries

SF = "/root/testdata/sf0.001"


def test_balanced_ranges_of_all_days(spark):
    found = gaps.fair_value_gaps(queries.prepared(spark, SF), queries.TF, queries.PIP, states=False).collect()
    want, late = defaultdict(list), 0
    for u in found:
        for d in found:
            top, bottom = min(u.top, d.top), max(u.bottom, d.bottom)
            if (u.symbol, u.direction, d.direction) == (d.symbol, "bullish", "bearish") and top > bottom:
                want[u.symbol, u.bar_index].append(top - bottom)
                late += max(u.forex_day, d.forex_day) >= dt.date(2024, 1, 4)
    got = {(r.symbol, r.bull_bar): (r.n, r.overlap) for r in queries.balanced_ranges(spark, SF).collect()}
    assert late and got.keys() == want.keys()
    assert all(got[k][0] == len(v) and got[k][1] == pytest.approx(sum(v), abs=1e-3) for k, v in want.items())
