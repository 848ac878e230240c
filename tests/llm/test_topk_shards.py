"""Top-k search over several shards, with ties, repeated ids and common terms, down to the order of the documents."""

import math
from collections import Counter, defaultdict

import pytest
from test_operators_llm import words

from barspark.llm import topk_search

SF = "/root/testdata/sf0.001"


def brute(docs, queries, k):
    rows = [(i, Counter(words(t))) for i, t in docs if i is not None]
    mean = sum(sum(c.values()) for _, c in rows) / len(rows)
    freq = Counter(x for _, c in rows for x in c)
    out = []
    for q, text in queries:
        scores = []
        for i, c in rows:
            n = sum(c.values())
            s = math.fsum(math.log(1 + (len(rows) - freq[x] + 0.5) / (freq[x] + 0.5)) * c[x] * 2.2 / (c[x] + 1.2 * (0.25 + 0.75 * n / mean)) for x in set(words(text)) if c[x])
            if s:
                scores.append((-round(s, 9), i))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return out


@pytest.mark.parametrize("shard", [40, 100_000])
def test_equal_to_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(topk_search, "SHARD_DOCS", shard)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs += [(1000 + k, docs[k % 7][1]) for k in range(60)] + [(3, docs[5][1]), (None, docs[5][1]), (2000, None), (2001, ""), (2002, "the the the")]
    queries = [(i, t) for i, t in docs[::9] if i is not None] + [(7, "the of and"), (7, "the of and"), (7, "moron"), (8, None), (9, "nosuchword"), (None, "the")]
    # Differently split tables, so that copies lie in different shards.
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(9)
    got = topk_search.top_k(df, spark.createDataFrame(queries, "query_id long, text string"), 10).collect()
    want = brute(docs, [q for q in queries if q[0] is not None], 10)
    groups, wanted = defaultdict(list), defaultdict(list)
    for table, rows in ((groups, got), (wanted, want)):
        for q, r, i, s in rows:
            table[q].append((r, i, round(s, 6)))
    assert {q: sorted(x) for q, x in groups.items()} == {q: sorted(x) for q, x in wanted.items()}
