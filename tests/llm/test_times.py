"""Texts with a word more often than two bytes can say."""

import math

import pytest

from barspark.llm import topk_search


def test_times_above_two_bytes(spark):
    # As long as each other; only the true times of x tell them apart.
    rows = [(1, 70_000, 60_000), (2, 130_000, 0), (3, 65_536, 64_464), (4, 65_535, 64_465)]
    docs = spark.createDataFrame([(i, "x " * a + "y " * b) for i, a, b in rows] + [(5, "z " * 100)], "doc_id long, text string").coalesce(1)
    asked = spark.createDataFrame([(1, "x")], "query_id long, text string")
    got = {r.doc_id: r.score for r in topk_search.top_k(docs, asked, 5).collect()}
    mean = (4 * 130_000 + 100) / 5
    idf = math.log(1 + (5 - 4 + 0.5) / (4 + 0.5))
    want = {i: idf * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * 130_000 / mean)) for i, a, _ in rows}
    assert got == pytest.approx(want, rel=1e-12)
    assert len(set(got.values())) == 4
