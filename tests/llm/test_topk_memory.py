"""Shards of the top-k index: memory, results where terms are common and blocks are skipped, and what tasks return."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from barspark.llm import topk_search


def texts(docs, words, copies):
    rng = np.random.default_rng(5)
    rows = [" ".join(f"w{x}" for x in rng.zipf(1.25, rng.integers(words // 2, words * 2)) % 200_000) for _ in range(docs)]
    return rows + [rows[i % 9] for i in range(copies)]


def pieces_of(rows):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(rows)], names=["doc_id", "text"])
    packed = list(topk_search._pieces(iter([batch])))
    return [{name: p.column(p.schema.get_field_index(name))[0].as_py() for name in topk_search._PIECE} for p in packed]


def terms_of(rows):
    out = []
    for first, last, row, term, times, sizes in topk_search._terms(pa.array(rows)):
        edges = np.searchsorted(row, np.arange(last - first + 1))
        out += [(term[a:b], times[a:b], int(n)) for a, b, n in zip(edges[:-1], edges[1:], sizes, strict=True)]
    return out


def test_memory_of_a_shard():
    rows = texts(4000, 400, 0)
    docs = terms_of(rows)
    postings = sum(len(t) for t, _, _ in docs)
    common = topk_search._common(*np.unique(np.concatenate([t for t, _, _ in docs]), return_counts=True), len(rows))
    pieces = pieces_of(rows)
    packed = sum(len(x) for p in pieces for x in p.values())
    tracemalloc.start()
    shard = topk_search.Shard(pieces, 500.0, common)
    most = tracemalloc.get_traced_memory()[1] + packed
    tracemalloc.stop()
    assert len(shard.ids) == len(rows)
    assert most / postings < 62  # bytes, pieces included; 76 when they came with 8 bytes a term and were sorted at once


@pytest.mark.parametrize("most_common", [1024, 20])
def test_blocks_and_common_terms(monkeypatch, most_common):
    monkeypatch.setattr(topk_search, "MOST_COMMON", most_common)
    rows = texts(5000, 60, 40) + ["w1 w2", "w1", "", "nosuch", "w1 w2"]
    docs = terms_of(rows)
    mean = sum(n for _, _, n in docs) / len(docs)
    vocabulary, frequency = np.unique(np.concatenate([t for t, _, _ in docs]), return_counts=True)
    weights = np.log(1 + (len(docs) - frequency + 0.5) / (frequency + 0.5))
    shard = topk_search.Shard(pieces_of(rows), mean, topk_search._common(vocabulary, frequency, len(rows)))
    assert shard.dense.shape[1] == min(most_common, int((frequency * topk_search.COMMON >= len(docs)).sum()))
    asked = np.append(vocabulary, np.uint64(2**64 - 1))  # a term of another shard, too
    some = [*range(0, len(rows), 40), *range(len(rows) - 12, len(rows))]
    queries = [np.append(np.searchsorted(vocabulary, docs[i][0]), len(vocabulary)) for i in some]
    got = {some[i]: (ids, scores) for i, ids, scores in shard.search(asked, np.append(weights, 1.0), queries, 10)}
    of = [np.searchsorted(vocabulary, t) for t, _, _ in docs]
    for i in some:
        wanted = np.zeros(len(vocabulary))
        wanted[of[i]] = weights[of[i]]
        scores = np.array([(wanted[t] * times * 2.2 / (times + 1.2 * (0.25 + 0.75 * n / mean))).sum() for t, (_, times, n) in zip(of, docs, strict=True)])
        best = np.lexsort((np.arange(len(rows)), -scores.round(9)))[:10]
        best = best[scores[best] > 0]
        if not len(best):
            assert i not in got
            continue
        assert got[i][0].tolist() == best.tolist(), i
        assert got[i][1] == pytest.approx(scores[best], rel=1e-12)


def test_a_task_keeps_the_best_of_its_shards():
    """However many shards stream by, a query gets k rows from a task, those of one shard of all documents."""
    rows = texts(1500, 60, 40)
    docs = terms_of(rows)
    mean = sum(n for _, _, n in docs) / len(docs)
    vocabulary, frequency = np.unique(np.concatenate([t for t, _, _ in docs]), return_counts=True)
    some = range(0, len(rows), 20)
    asked = pa.RecordBatch.from_arrays(
        [pa.array(some, pa.int64()), pa.array([docs[i][0].view(np.int64) for i in some], pa.list_(pa.int64())), pa.array([frequency[np.searchsorted(vocabulary, docs[i][0])] for i in some], pa.list_(pa.int64()))], names=["q", "term", "n"]
    )
    chunks = [{name: c.column(c.schema.get_field_index(name))[0].as_py() for name in topk_search._CHUNK} for c in topk_search._chunks(iter([asked]))]
    pieces = pieces_of(rows)
    assert len(pieces) > 3

    def found(shards):
        every = [{"task": 0, "shard": None} | c for c in chunks] + sorted(({"task": 0, "shard": k % shards} | p for k, p in enumerate(pieces)), key=lambda x: x["shard"])
        kinds = pa.schema([("task", pa.int32()), ("shard", pa.int32())] + [(name, pa.binary()) for name in (*topk_search._PIECE, *topk_search._CHUNK)])
        out = pa.Table.from_batches(list(topk_search._search(10, len(rows), mean)(iter(pa.Table.from_pylist(every, kinds).to_batches(max_chunksize=3)))))
        return sorted(zip(*(out.column(c).to_pylist() for c in ("q", "score", "doc_id")), strict=True))

    one = found(1)
    assert len(one) == 10 * len(some)
    assert found(3) == one
