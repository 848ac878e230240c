"""Top-k search where several shares of the queries meet several groups of shards."""

from collections import defaultdict

import pytest
from test_topk_shards import SF, brute

from barspark.llm import topk_search


def test_equal_to_brute_force_over_tasks(spark, monkeypatch):
    for name, value in {"SHARD_DOCS": 60, "LEAST_DOCS": 100, "TASK_QUERIES": 12}.items():
        monkeypatch.setattr(topk_search, name, value)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs += [(1000 + k, docs[k % 7][1]) for k in range(60)]
    queries = [(i, t) for i, t in docs[::9]] + [(7, "the of and"), (9, "nosuchword")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got, want = defaultdict(list), defaultdict(list)
    for q, r, i, s in topk_search.top_k(df, spark.createDataFrame(queries, "query_id long, text string").repartition(4), 10).collect():
        got[q].append((r, i, s))
    for q, r, i, s in brute(docs, queries, 10):
        want[q].append((r, i, s))
    assert got.keys() == want.keys()
    for q, rows in want.items():
        rows, found = sorted(rows), sorted(got[q])
        assert [x[:2] for x in found] == [x[:2] for x in rows], q
        assert [x[2] for x in found] == pytest.approx([x[2] for x in rows], abs=1e-8), q
