"""Top-k search: what is left out because it can't be among the best, and what stays exact."""

import os

import numpy as np
import pytest
from test_topk_memory import pieces_of, terms_of

from barspark.llm import topk_search


def tongues(docs, seed):
    """Texts in three vocabularies, of one to 400 words; some hold words of two of them."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(docs):
        words = [f"{'abc'[i % 3]}{x}" for x in rng.zipf(1.3, int(rng.exponential(120)) + 1) % 50_000]
        if i % 50 == 0:
            words += [f"{'abc'[(i + 1) % 3]}{x}" for x in rng.zipf(1.3, 40) % 50_000]
        rows.append(" ".join(words))
    return rows


def searched(rows, some, k=10, known=None):
    docs = terms_of(rows)
    mean = sum(n for _, _, n in docs) / len(docs)
    vocabulary, frequency = np.unique(np.concatenate([t for t, _, _ in docs]), return_counts=True)
    weights = np.log(1 + (len(docs) - frequency + 0.5) / (frequency + 0.5))
    shard = topk_search.Shard(pieces_of(rows), mean, topk_search._common(vocabulary, frequency, len(rows)))
    cells, scored, room, exact = [], [], shard._room, shard._exact
    shard._room = lambda name, *shape, **x: (cells.append(shape[0]) if name == "product" else None, room(name, *shape, **x))[1]
    shard._exact = lambda terms, weights, docs: (scored.append(len(docs)), exact(terms, weights, docs))[1]
    of = [np.searchsorted(vocabulary, t) for t, _, _ in docs]
    got = {some[i]: (ids, scores) for i, ids, scores in shard.search(vocabulary, weights, [of[i] for i in some], k, known)}
    want = {}
    for i in some:
        wanted = np.zeros(len(vocabulary))
        wanted[of[i]] = weights[of[i]]
        scores = np.array([(wanted[t] * times * 2.2 / (times + 1.2 * (0.25 + 0.75 * n / mean))).sum() for t, (_, times, n) in zip(of, docs, strict=True)])
        best = np.lexsort((np.arange(len(rows)), -scores.round(9)))[:k]
        want[i] = best[scores[best] > 0], scores[best[scores[best] > 0]]
    return got, want, sum(cells) / (len(some) * shard.blocks), sum(scored) / len(some)


@pytest.mark.parametrize("common", [24, 400])
def test_exact_and_few_are_scored(monkeypatch, common):
    monkeypatch.setattr(topk_search, "COMMON", common)
    rows = tongues(6000, 1)
    rows += rows[:40] + ["a1 b1 c1 " + "a2 " * 70_000, "", "a1"]
    got, want, blocks, scored = searched(rows, [*range(0, len(rows), 61), *range(len(rows) - 3, len(rows))])
    for i, (ids, scores) in want.items():
        assert (got[i][0].tolist() if i in got else []) == ids.tolist(), i
        assert i not in got or got[i][1] == pytest.approx(scores, rel=1e-12)
    assert blocks < 0.75  # most blocks of other vocabularies are passed over
    assert scored < 40


def test_what_other_shards_have_leaves_less_to_score():
    rows = tongues(4000, 2)
    some = [i for i in range(0, len(rows), 51) if len(set(rows[i].split())) > 10]
    _, want, _, first = searched(rows, some)
    known = np.stack([np.full(10, want[i][1][4] * (1 - 1e-9)) for i in some])
    got, _, _, scored = searched(rows, some, known=known)
    assert scored < 0.7 * first
    for i in some:
        assert got[i][0][:5].tolist() == want[i][0][:5].tolist()


def test_more_documents_than_sixteen_bits():
    rng = np.random.default_rng(3)
    rows = [f"x{a} y{b} z" for a, b in zip(rng.integers(0, 3000, 66_000), rng.integers(0, 20, 66_000), strict=True)]
    got, want, _, _ = searched(rows, [0, 65_535, 65_536, 65_999])
    for i, (ids, scores) in want.items():
        assert got[i][0].tolist() == ids.tolist()
        assert got[i][1] == pytest.approx(scores, rel=1e-12)


def test_shuffles_go_after_each_share(spark, monkeypatch):
    """The documents are dealt out once for each share of the queries; what was dealt out for the one before goes first."""
    for name, value in {"SHARD_DOCS": 60, "LEAST_DOCS": 100, "TASK_QUERIES": 8}.items():
        monkeypatch.setattr(topk_search, name, value)
    places = [str(x) for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for d in places for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}
    seen, before, written = [], files(), topk_search.written

    def spied(df, name, *x):
        out = written(df, name, *x)
        seen.append((name, len(files() - before)))
        return out

    monkeypatch.setattr(topk_search, "written", spied)
    df = spark.createDataFrame([(i, f"the w{i % 7} w{i % 11} w{i}") for i in range(400)], "doc_id long, text string").repartition(5).localCheckpoint()
    before |= files()
    out = topk_search.top_k(df, df.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id"), 10)
    assert [name for name, _ in seen].count("found") >= 3
    assert max(n for name, n in seen if name == "found") == 0
    assert spark.conf.get(topk_search._CLEANUP, "false") == "false"
    assert out.count() == 200
