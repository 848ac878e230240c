"""Order blocks before structure shifts against a plain loop; bars from a folder that isn't there."""

from collections import defaultdict

from barspark.plans import queries
from barspark.sources.bars import read_bars

SF = "/root/testdata/sf0.01"


def test_shift_blocks(spark):
    bars = defaultdict(dict)
    for r in queries.prepared(spark, SF).collect():
        bars[r.symbol][r.bar_index] = r
    want = set()
    for s in queries.structure_shifts(spark, SF).collect():
        own, up = bars[s.symbol], s.direction == "bullish"
        for j in range(s.bar_index - 1, max(s.bar_index - 4, -1), -1):
            b = own[j]
            if (b.close < b.open if up else b.close > b.open) and b.high > b.low and abs(b.close - b.open) / (b.high - b.low) >= 0.1:
                top, bottom = max(b.open, b.close), min(b.open, b.close)
                again = [k for k in range(j + 1, min(j + 30, len(own))) if (own[k].low <= top if up else own[k].high >= bottom)]
                want.add((s.symbol, s.bar_index, s.direction, j, top, bottom, b.high, b.low, len(again), ",".join(map(str, again))))
                break
    got = {tuple(r) for r in queries.shift_blocks(spark, SF).collect()}
    assert got == want and len(got) > 5


def test_no_folder_gives_an_empty_table(spark):
    bars = read_bars(spark, "/tmp/there-is-no-such-folder", ["A"], "2024-01-01", "2024-01-02")
    assert bars.count() == 0 and "is_ghost" in bars.columns
