"""Exact top-k search by BM25: an inverted index with block maxima, searched shard by shard, merged exactly.

Documents are packed where they are read, in pieces of at most PIECE_DOCS; pieces are dealt to shards of about SHARD_DOCS
documents or SHARD_WORDS words. Document frequencies, the number of documents and their mean length are those of the whole
table, so scores of different shards compare, and the k best of each shard hold the k best of all.

Queries are packed by CHUNK_QUERIES, with each different term once, and dealt to shares of about TASK_QUERIES (or TASK_BYTES).
Share by share, each task gets all of the share and some of the shards, at most TASK_SHARDS. The packed queries come first and
stay, then the shards stream by, one after the other. A task keeps the k best of each query so far, whose last one is a
threshold for the next shard. So memory holds one shard and one share of the queries, whatever the number of either, and the
disk one copy of the packed documents and one that is dealt to tasks.

Queries are searched by block-max WAND, BATCH of them at a time, over whole lists instead of one cursor step at a time. The
gains from rare terms are added up first, from lists of postings. Terms that many documents have are dense rows. A block of
documents is skipped by a query if its best gain so far and the bounds of its common terms stay below the threshold: the
maxima of the query's terms in the block, by groups of terms at most what any document there has of the group, and all
groups together at most what any document has. Blocks hold documents of a kind, by like common terms, in the order of their
lengths. For the other blocks the queries' common terms are summed up as a product of matrices. All this is rounded up;
documents that still reach the threshold are scored exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written
from .words import hashed_words

PIECE_DOCS, PIECE_WORDS = 512, 1 << 19
SHARD_DOCS, SHARD_WORDS = 32768, 3 << 23
LEAST_DOCS, TASK_SHARDS = 2048, 8  # a task's documents at least, if the table has them, and its shards at most
TASK_QUERIES, TASK_BYTES = 24576, 1 << 26
CHUNK_QUERIES, CHUNK_TERMS = 384, 3 << 16
BATCH = 192
LANES, FIELDS, BITS = 320, 3, 17  # so many numbers of so many bits lie in one float of 64 bits
BLOCK = LANES * FIELDS
WIDTH = 8  # postings a row
IMPACTS, PARTS = 1 << 14, 1 << 10  # of 1, to which the impacts and the gains of postings are rounded up
COMMON, MOST_COMMON = 24, 1024  # a term is common if it is in at least one of so many documents of the table; so many of them at most
KINDS, KIND_DOCS = 16, 1024
SLACK = 1 - 1e-5  # for sums of floats of 32 bits
K1, B = 1.2, 0.75
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _terms(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row after the last, row, term, times of the distinct terms by row and term, words of each row)."""
    for first, last, words, rows in hashed_words(texts):
        row = np.repeat(np.arange(last - first), np.diff(rows))
        for r in range(last - first):
            words[rows[r] : rows[r + 1]].sort()
        fresh = np.ones(len(words), bool)
        fresh[1:] = (words[1:] != words[:-1]) | (row[1:] != row[:-1])
        at = np.flatnonzero(fresh)
        yield first, last, row[at], words[at], np.diff(np.concatenate([at, [len(words)]])), np.diff(rows)


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All of first[0] and the n[0] - 1 numbers behind it, then first[1] and so on."""
    ends = np.cumsum(n, dtype=np.int64)
    steps = np.repeat(first - ends + n, n)
    steps += np.arange(len(steps))
    return steps


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values of sorted `x` begin, and their lengths."""
    at = np.flatnonzero(np.append(True, x[1:] != x[:-1])[: len(x)])
    return at, np.diff(np.append(at, len(x)))


def _bytes(names: tuple[str, ...], *columns: np.ndarray) -> pa.RecordBatch:
    """One row of binary columns. The first one is of 64 bits; numbers of others take as few bytes as the largest of them needs."""
    narrow = [columns[0], *(c.astype(np.min_scalar_type(c.max(initial=0))) for c in columns[1:])]
    return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in narrow], names=list(names))


def _numbers(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // n}" if n else np.uint8)


_PIECE = ("ids", "sizes", "terms", "counts", "docs", "times")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents packed and inverted: their ids and numbers of words; the terms, with their numbers of documents; by term, the documents' numbers within the piece and the times."""
    held: list[tuple[np.ndarray, ...]] = []
    docs = words = 0

    def packed() -> pa.RecordBatch:
        ids, sizes, doc, term, times = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(term, kind="stable")
        at, n = _runs(term := term[order])
        return _bytes(_PIECE, ids, sizes, term[at], n, doc[order], times[order])

    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for first, last, row, term, times, sizes in _terms(batch.column(1)):
            edges = np.searchsorted(row, np.arange(last - first + 1))
            for a in range(0, last - first, PIECE_DOCS):
                b = min(last - first, a + PIECE_DOCS)
                some = slice(edges[a], edges[b])
                if held and (docs + b - a > PIECE_DOCS or words + edges[b] - edges[a] > PIECE_WORDS):
                    yield packed()
                    held, docs, words = [], 0, 0
                held.append((ids[first + a : first + b], sizes[a:b], row[some] - a + docs, term[some], times[some]))
                docs, words = docs + b - a, words + int(edges[b] - edges[a])
    if held:
        yield packed()


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pieces: terms and in how many documents they are; as totals 0 and 1, the numbers of documents and of words."""
    for batch in batches:
        rows = batch.to_pylist()
        terms = np.frombuffer(b"".join(r["terms"] for r in rows), np.int64)
        counts = np.concatenate([_numbers(r["counts"], len(r["terms"]) // 8) for r in rows])
        t, at = np.unique(terms, return_inverse=True)
        extra = [sum(len(r["ids"]) // 8 for r in rows), sum(int(_numbers(r["sizes"], len(r["ids"]) // 8).sum()) for r in rows)]
        n = np.concatenate([np.bincount(at, counts, len(t)), extra]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([t, [0, 1]])), pa.array(n), pa.array([False] * len(t) + [True] * 2)], names=["term", "n", "total"])


_CHUNK = ("qs", "lengths", "asked", "n", "places")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Queries (number, terms, their document frequencies) packed: their numbers and lengths; the different terms with their frequencies; by query, the places of its terms among these, ascending."""
    for batch in batches:
        qs, starts = batch.column(0).to_numpy(), batch.column(1).offsets.to_numpy().astype(np.int64)
        terms, n = batch.column(1).values.to_numpy().view(np.uint64), batch.column(2).values.to_numpy()
        a = 0
        while a < len(qs):
            b = max(a + 1, min(a + CHUNK_QUERIES, int(np.searchsorted(starts, starts[a] + CHUNK_TERMS, "right")) - 1))
            some = slice(starts[a], starts[b])
            asked, at, place = np.unique(terms[some], return_index=True, return_inverse=True)
            lengths = np.diff(starts[a : b + 1])
            place = place[np.lexsort((place, np.repeat(np.arange(b - a), lengths)))]
            yield _bytes(_CHUNK, qs[a:b], lengths, asked, n[some][at], place)
            a = b


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    keep = np.lexsort((ids, -scores))[:k]
    return ids[keep], scores[keep]


def _common(terms: np.ndarray, n: np.ndarray, n_docs: int) -> np.ndarray:
    """The most common of the terms with document frequencies `n`, ascending."""
    terms, at = np.unique(terms[n * COMMON >= n_docs], return_index=True)
    n = n[n * COMMON >= n_docs][at]
    return np.sort(terms[np.lexsort((terms, -n))[:MOST_COMMON]])


def _weights(n: np.ndarray, n_docs: int) -> np.ndarray:
    return np.log(1 + (n_docs - n + 0.5) / (n + 0.5))


class Chunk:
    """Packed queries and the best of each so far."""

    def __init__(self, row: dict[str, bytes], n_docs: int):
        self.qs, self.asked = np.frombuffer(row["qs"], np.int64), np.frombuffer(row["asked"], np.uint64)
        lengths, n = _numbers(row["lengths"], len(self.qs)), _numbers(row["n"], len(self.asked)).astype(float)
        often = n * COMMON >= n_docs
        self.often = self.asked[often], n[often]
        self.weights = _weights(n, n_docs)
        self.queries = np.split(_numbers(row["places"], int(lengths.sum())), np.cumsum(lengths)[:-1])
        self.found = [(np.zeros(0, np.int64), np.zeros(0))] * len(self.qs)

    def search(self, shard: Shard, k: int) -> None:
        best = np.zeros((len(self.qs), k))
        for i, (_, scores) in enumerate(self.found):
            best[i, : len(scores)] = scores
        for i, ids, scores in shard.search(self.asked, self.weights, self.queries, k, best):
            self.found[i] = _best(np.concatenate([self.found[i][0], ids]), np.concatenate([self.found[i][1], scores]), k)

    def results(self) -> pa.RecordBatch:
        ids, scores = (np.concatenate(x) for x in zip(*self.found, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.qs, [len(x) for x, _ in self.found])), pa.array(ids), pa.array(scores)], names=["q", "doc_id", "score"])


class Shard:
    def __init__(self, pieces: list[dict[str, bytes]], mean: float, common: np.ndarray):
        """Takes the pieces out of the list one by one, so that they go as the index grows. `common` terms are ascending."""
        ids = np.concatenate([np.frombuffer(p["ids"], np.int64) for p in pieces])
        sizes = np.concatenate([_numbers(p["sizes"], len(p["ids"]) // 8) for p in pieces])
        edges = np.cumsum([0] + [len(p["terms"]) // 8 for p in pieces])
        self.terms, term = np.unique(np.frombuffer(b"".join(p["terms"] for p in pieces), np.uint64), return_inverse=True)
        term = term.astype(np.int32)
        held = [(term[a:b], _numbers(p["counts"], b - a)) for p, a, b in zip(pieces, edges[:-1], edges[1:], strict=True)]
        n = np.zeros(len(self.terms), np.int64)
        for some, counts in held:
            n[some] += counts
        common = np.flatnonzero(np.isin(self.terms, common))
        self.row = np.full(len(n), -1, np.int16)
        self.row[common] = np.arange(len(common))
        # Documents of a block have like terms and lengths, hence like impacts.
        kinds, self.group = self._kinds(pieces, held, len(ids))
        order = np.lexsort((sizes, kinds))
        number = np.empty(len(ids), np.int32)
        number[order] = np.arange(len(ids))
        self.ids, self.norms = ids[order], K1 * (1 - B + B * sizes[order] / max(mean, 1e-9))
        # By document, its terms, ascending, and their times, for exact scores.
        docs = [_numbers(p["docs"], int(counts.sum())) for p, (_, counts) in zip(pieces, held, strict=True)]
        lengths = np.concatenate([np.bincount(d, minlength=len(p["ids"]) // 8) for p, d in zip(pieces, docs, strict=True)])
        self.fore_starts = np.concatenate([[0], np.cumsum(lengths[order])])
        self.fore_term = np.empty(self.fore_starts[-1], np.int32)
        self.fore_times = np.empty(len(self.fore_term), np.result_type(*(_numbers(p["times"], len(d)) for p, d in zip(pieces, docs, strict=True))))
        # Rare terms' lists are postings by term, in rows of WIDTH: document and impact; from the first query that brings the term, gain, rounded up to PARTS of 1.
        n[common] = 0
        self.n = -(-n // WIDTH)
        self.starts = np.cumsum(self.n) - self.n
        kind = np.uint16 if len(ids) <= 1 << 16 else np.uint32
        self.lists = np.zeros((self.n.sum() * WIDTH, 2), kind)
        fill, before = self.starts * WIDTH, 0
        while pieces:
            p, (term, counts), doc = pieces.pop(0), held.pop(0), docs.pop(0)
            times, place = _numbers(p["times"], len(doc)), number[before : before + len(p["ids"]) // 8]
            at, each = np.argsort(doc, kind="stable"), _ranges(self.fore_starts[place], lengths[before : before + len(place)])
            self.fore_term[each], self.fore_times[each] = np.repeat(term, counts)[at], times[at]
            rare = self.row[term] < 0
            each = np.repeat(rare, counts)
            doc, times, counts, term = place[doc[each]], times[each], counts[rare].astype(np.int64), term[rare]
            at = _ranges(fill[term], counts)
            self.lists[at, 0], self.lists[at, 1] = doc, np.ceil(times * (K1 + 1) / (times + self.norms[doc]) * IMPACTS)
            fill[term] += counts
            before += len(place)
        self.lists = self.lists.reshape(-1, 2 * WIDTH)
        # Those of common terms are dense: the gain in each document of each block, rounded up to a multiple of the document's unit.
        self.blocks = -(-len(ids) // BLOCK)
        self.dense = np.zeros((self.blocks, len(common), LANES))
        self.units = np.zeros((self.blocks, BLOCK), np.float32)
        # The most that common terms give to a document of a block: each, each group, all.
        self.term_most = np.zeros((len(common), self.blocks), np.float32)
        self.group_most = np.zeros((int(self.group.max(initial=0)) + 1, self.blocks), np.float32)
        self.block_most = np.zeros(self.blocks, np.float32)
        self.common_weights, self.weighted = np.zeros(len(common)), np.zeros(len(self.terms), bool)
        self.asked, self.wanted = np.zeros(len(self.terms), bool), np.zeros(len(self.terms))
        self.rooms: dict[str, np.ndarray] = {}

    def _kinds(self, pieces: list[dict[str, bytes]], held: list[tuple[np.ndarray, np.ndarray]], n_docs: int) -> tuple[np.ndarray, np.ndarray]:
        """Kinds of documents by their common terms, as those of one language, and groups of common terms that mostly stand in one kind. Only speed depends on them."""
        docs, rows, before = [], [], 0
        for p, (term, counts) in zip(pieces, held, strict=True):
            row = np.repeat(self.row[term], counts)
            docs.append(_numbers(p["docs"], len(row))[row >= 0] + np.int32(before))
            rows.append(row[row >= 0])
            before += len(p["ids"]) // 8
        doc, row = np.concatenate(docs), np.concatenate(rows)
        del docs, rows
        some, terms = np.flatnonzero(np.bincount(doc, minlength=n_docs)), int(self.row.max(initial=-1)) + 1
        if len(some) < KINDS:
            return np.zeros(n_docs, np.int64), np.zeros(terms, np.int64)
        some = some[np.linspace(0, len(some) - 1, min(len(some), KIND_DOCS)).astype(np.int64)]
        at = np.full(n_docs, -1, np.int32)
        at[some] = np.arange(len(some))
        seen = at[doc] >= 0
        x = np.zeros((len(some), terms), np.float32)
        x[at[doc[seen]], row[seen]] = 1
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        middles = x[:: len(x) // KINDS][:KINDS]
        for _ in range(5):
            own = (x @ middles.T).argmax(1)
            middles = np.stack([x[own == k].mean(0) if (own == k).any() else middles[k] for k in range(KINDS)])
            middles /= np.linalg.norm(middles, axis=1, keepdims=True)
        same = np.unique((middles @ middles.T >= 0.5).argmax(0), return_inverse=True)[1].astype(np.int8)
        group, n_groups = same[middles.argmax(0)], int(same.max()) + 1
        n = np.stack([np.bincount(doc[group[row] == g], minlength=n_docs) for g in range(n_groups)], axis=1)
        # Documents with many terms of other groups are apart.
        return n.argmax(1) + n_groups * (n.sum(1) - n.max(1) > 8 + n.sum(1) // 8), group

    def find(self, asked: np.ndarray) -> np.ndarray:
        """Places of terms in the index; -1 for those that it doesn't have."""
        at = np.searchsorted(self.terms, asked)
        at[at == len(self.terms)] = 0
        at[self.terms[at] != asked if len(self.terms) else slice(None)] = -1
        return at

    def weigh(self, terms: np.ndarray, weights: np.ndarray) -> None:
        """Makes the lists ready when queries first bring some of the terms (places in the index)."""
        fresh = ~self.weighted[terms]
        terms, weights = terms[fresh], weights[fresh]
        self.weighted[terms] = True
        for a in range(0, len(terms), 1024):
            n = self.n[terms[a : a + 1024]]
            rows = _ranges(self.starts[terms[a : a + 1024]], n)
            self.lists[rows, 1::2] = np.ceil(self.lists[rows, 1::2] * (np.repeat(weights[a : a + 1024], n)[:, None] * (PARTS / IMPACTS)))
        row, weights = self.row[terms][self.row[terms] >= 0], weights[self.row[terms] >= 0]
        if not len(row):
            return
        self.common_weights[row] = weights
        groups = len(self.group_most)
        for b in range(self.blocks):
            starts = self.fore_starts[b * BLOCK : (b + 1) * BLOCK + 1]
            doc, row = np.repeat(np.arange(len(starts) - 1), np.diff(starts)), self.row[self.fore_term[starts[0] : starts[-1]]]
            at = np.flatnonzero(row >= 0)
            doc, row, times = doc[at], row[at], self.fore_times[starts[0] : starts[-1]][at]
            gain = times * (K1 + 1) / (times + self.norms[b * BLOCK + doc]) * self.common_weights[row]
            # A document's unit is so large that its gains from all common terms fit into its bits.
            units = np.maximum(np.bincount(doc, gain, BLOCK), 1e-30) / (2**BITS - 1 - np.bincount(doc, minlength=BLOCK))
            gain = np.ceil(gain / units[doc])
            self.units[b] = units
            self.dense[b] = 0
            for j in range(FIELDS):
                here = doc // LANES == j
                self.dense[b, row[here], doc[here] % LANES] += gain[here] * 2.0 ** (BITS * j)
            gain *= units[doc]
            by_group = np.bincount(doc * groups + self.group[row], gain, BLOCK * groups).reshape(BLOCK, groups)
            self.group_most[:, b], self.block_most[b] = by_group.max(0), by_group.sum(1).max()
            self.term_most[:, b] = 0
            np.maximum.at(self.term_most[:, b], row, gain.astype(np.float32))

    def search(self, asked: np.ndarray, weights: np.ndarray, queries: list[np.ndarray], k: int, best: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of the query, ids, scores) of the k best documents that share a term with each query.

        The queries have places of terms in `asked`, ascending. `best` has the k best scores of each so far; documents that don't get among them may be left out.
        """
        at = self.find(asked)
        self.weigh(at[at >= 0], weights[at >= 0])
        held = [(i, at[there], weights[there]) for i, places in enumerate(queries) if len(there := places[at[places] >= 0])]
        for a in range(0, len(held), BATCH):
            some = held[a : a + BATCH]
            yield from self._batch(some, np.zeros((len(some), k)) if best is None else best[[i for i, _, _ in some]])

    def _exact(self, terms: np.ndarray, weights: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Scores of documents. Parts are summed up in the order of the terms, so that equal texts have equal scores wherever they are."""
        starts, ends = self.fore_starts[docs], self.fore_starts[docs + 1]
        fore = np.concatenate([self.fore_term[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        self.asked[terms], self.wanted[terms] = True, weights
        at = np.flatnonzero(self.asked.take(fore))
        self.asked[terms] = False
        ends = np.cumsum(ends - starts)
        number = np.searchsorted(ends, at, "right")
        times = self.fore_times[at + (self.fore_starts[docs + 1] - ends)[number]]
        return np.bincount(number, times * (K1 + 1) / (times + self.norms[docs[number]]) * self.wanted[fore[at]], len(docs))

    def _room(self, name: str, *shape: int, kind: type = float) -> np.ndarray:
        """Memory used again and again: with new pages for each query, more time would go into them than into the sums."""
        size = math.prod(shape)
        if name not in self.rooms or len(self.rooms[name]) < size:
            self.rooms[name] = np.empty(size, kind)
        return self.rooms[name][:size].reshape(shape)

    def _batch(self, held: list[tuple[int, np.ndarray, np.ndarray]], best: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        size, k = self.blocks * BLOCK, best.shape[1]
        gained = self._room("gained", self.blocks, len(held), BLOCK, kind=np.float32)
        asked, over = np.zeros((len(held), len(self.common_weights))), np.empty(len(held))
        for i, (_, term, weight) in enumerate(held):
            row = self.row[term]
            asked[i, row[row >= 0]] = 1
            over[i] = (1 / PARTS + weight[row < 0] / IMPACTS).sum()
            # What documents gain from rare terms.
            rows = _ranges(self.starts[term], self.n[term])
            found = self.lists.take(rows, 0, self._room("found", len(rows), 2 * WIDTH, kind=self.lists.dtype), "clip")
            doc, gain = self._room("doc", len(rows) * WIDTH, kind=np.intp), self._room("gain", len(rows) * WIDTH)
            doc[:], gain[:] = found.reshape(-1, 2).T
            np.multiply(np.bincount(doc, gain, size).reshape(self.blocks, BLOCK), 1 / PARTS, out=gained[:, i], casting="same_kind")
        # Blocks may pass the threshold by the bounds of their documents, and of common terms, group by group.
        least = np.maximum(best[:, -1] * SLACK, 1e-30).astype(np.float32)
        bound = np.zeros((len(held), self.blocks))
        for g, most in enumerate(self.group_most):
            some = self.group == g
            bound += np.minimum(asked[:, some] @ self.term_most[some], most)
        bound = gained.max(2).T + np.minimum(bound, self.block_most) / SLACK
        has, rows = asked > 0, asked.sum(1)
        hits: list[tuple[np.ndarray, ...]] = []
        for b in np.argsort(-bound.sum(0)):
            alive = np.flatnonzero(bound[:, b] >= least)
            if not len(alive):
                continue
            some = np.flatnonzero(has[alive].any(0) & (self.term_most[:, b] > 0))
            dense = self.dense[b].take(some, 0, self._room("dense", len(some), LANES), "clip")
            sums, part = self._room("sums", len(alive), LANES, kind=np.int64), self._room("part", len(alive), LANES, kind=np.int64)
            sums[:] = np.matmul(asked[alive[:, None], some], dense, out=self._room("product", len(alive), LANES))
            now, more = gained[b].take(alive, 0, self._room("now", len(alive), BLOCK, kind=np.float32), "clip"), self._room("more", len(alive), LANES, kind=np.float32)
            for j in range(FIELDS):
                lane = slice(j * LANES, (j + 1) * LANES)
                np.bitwise_and(np.right_shift(sums, BITS * j, out=part), 2**BITS - 1, out=part)
                now[:, lane] += np.multiply(part, self.units[b, lane], out=more, casting="same_kind")
            some = np.flatnonzero(now.max(1) >= least[alive])
            # Scores are too high by a unit a common term and `over` at most, so the k-th best of a block is a threshold, too.
            for j in some[np.count_nonzero(now[some] >= least[alive[some], None], axis=1) >= k]:
                sure = now[j] - self.units[b] * rows[alive[j]] - over[alive[j]]
                least[alive[j]] = max(least[alive[j]], np.partition(sure, BLOCK - k)[BLOCK - k] * SLACK)
            q, doc = np.nonzero(now[some] >= least[alive[some], None])
            hits.append((alive[some[q]], b * BLOCK + doc, now[some[q], doc], self.units[b, doc] * rows[alive[some[q]]] + over[alive[some[q]]]))
        if not hits:
            return
        q, doc, score, error = (np.concatenate(x) for x in zip(*hits, strict=True))
        order = np.argsort(q, kind="stable")
        starts, n = _runs(q[order])
        for a, b in zip(starts, starts + n, strict=True):
            some, (i, term, weight) = order[a:b], held[q[order[a]]]
            sure = np.append(score[some] - error[some], best[q[some[0]]])
            some = some[score[some] >= max(least[q[some[0]]], np.partition(sure, len(sure) - k)[len(sure) - k] * SLACK)]
            yield i, *_best(self.ids[doc[some]], self._exact(term, weight, doc[some]), k)


def _search(k: int, n_docs: int, mean: float):
    """Chunks of queries and pieces of documents by task; a task's queries (shard null) come first, then its shards, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, pieces, chunks = None, None, [], []

        def searched() -> None:
            if pieces and chunks:
                often, n = (np.concatenate(x) for x in zip(*(chunk.often for chunk in chunks), strict=True))
                shard = Shard(pieces, mean, _common(often, n, n_docs))
                often, at = np.unique(often, return_index=True)
                place = shard.find(often)
                shard.weigh(place[place >= 0], _weights(n[at], n_docs)[place >= 0])
                for chunk in chunks:
                    chunk.search(shard, k)
            pieces.clear()

        for batch in batches:
            for r, (t, s) in enumerate(zip(batch.column("task").to_pylist(), batch.column("shard").to_pylist(), strict=True)):
                if (t, s) != (task, number):
                    searched()
                if t != task:
                    yield from (chunk.results() for chunk in chunks)
                    chunks = []
                task, number = t, s
                of = {name: batch.column(name)[r].as_py() for name in (_CHUNK if s is None else _PIECE)}
                if s is None:
                    chunks.append(Chunk(of, n_docs))
                else:
                    pieces.append(of)
        searched()
        yield from (chunk.results() for chunk in chunks)

    return run


def _distinct_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, row, term, _, _ in _terms(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first).take(pa.array(row)), pa.array(term.view(np.int64))], names=["q", "term"])


def top_k(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, doc_id, score): for each row of `queries` (query_id, text) the k rows of `docs` (doc_id, text) with the highest BM25 scores.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; each different word of a query counts once. Equal scores go by
    doc_id. Documents that share no word with a query have score 0 and are not listed, so a null or empty query has no
    rows, nor has any query of an empty table. Rows with a null id are left out; rows that repeat a doc_id are documents
    of their own, and rows that repeat a query_id are queries of their own, with k rows each. Other columns are not read.
    """
    spark = docs.sparkSession
    before = {name: spark.conf.get(name, None) for name in (_ROWS, _CLEANUP)}
    spark.conf.set(_CLEANUP, "true")  # each shuffle below is read by one query
    try:
        return _top_k(docs, queries, k)
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _top_k(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    spark = docs.sparkSession
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = written(texts.mapInArrow(_pieces, ", ".join(f"{name} binary" for name in _PIECE)).withColumn("row", F.monotonically_increasing_id()), "pieces")
    rows = spark.conf.get(_ROWS)
    spark.conf.set(_ROWS, 8)  # pieces and chunks have about a MB each
    counts = written(pieces.select(*_PIECE).mapInArrow(_frequencies, "term long, n long, total boolean").groupBy("term", "total").agg(F.sum("n").alias("n")), "frequencies")
    totals = dict(counts.where("total").select("term", "n").collect())
    n_docs, n_words = totals.get(0, 0), totals.get(1, 0)
    asked = queries.where("query_id is not null").select(F.col("query_id").cast("long").alias("query_id"), F.col("text").cast("string").alias("text"))
    asked = written(asked.withColumn("q", F.monotonically_increasing_id()), "asked")
    spark.conf.set(_ROWS, rows)
    terms = asked.select("q", "text").mapInArrow(_distinct_terms, "q long, term long").join(counts.where("not total").hint("merge"), "term").groupBy("q").agg(F.collect_list(F.struct("term", "n")).alias("t"))
    chunks = terms.select("q", "t.term", "t.n").mapInArrow(_chunks, ", ".join(f"{name} binary" for name in _CHUNK))
    chunks = written(chunks.withColumn("row", F.monotonically_increasing_id()), "queries")

    # Share by share, the queries meet each group of shards in a task.
    n_asked, n_bytes = chunks.agg(F.sum(F.length("qs") / 8), F.sum(sum(F.length(name) for name in _CHUNK))).first()
    shares = max(1, math.ceil((n_asked or 0) / TASK_QUERIES), math.ceil((n_bytes or 0) / TASK_BYTES))
    shards, cores = max(n_docs / SHARD_DOCS, n_words / SHARD_WORDS), spark.sparkContext.defaultParallelism
    groups = max(1, min(cores, -(-n_docs // LEAST_DOCS)))
    if shards > groups * TASK_SHARDS:
        groups = cores * math.ceil(shards / TASK_SHARDS / cores)
    n_shards = groups * max(1, math.ceil(shards / groups))

    # A task's pieces go round the shards, from one that its number gives.
    shard = F.pmod(F.xxhash64(F.shiftright("row", 33)) % n_shards + F.col("row").bitwiseAND((1 << 33) - 1), F.lit(n_shards)).cast("int")
    pieces = pieces.withColumn("shard", shard).select((F.col("shard") % groups).alias("task"), "shard", *_PIECE, *[F.lit(None).cast("binary").alias(name) for name in _CHUNK])
    share = F.pmod(F.col("row").bitwiseAND((1 << 33) - 1) + F.shiftright("row", 33), F.lit(shares))
    each = chunks.select(share.alias("share"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("task"), F.lit(None).cast("int").alias("shard"), *[F.lit(None).cast("binary").alias(name) for name in _PIECE], *_CHUNK)
    spark.conf.set(_ROWS, 4)
    parts = []
    for number in range(shares):
        met = pieces.unionByName(each.where(F.col("share") == number).drop("share")).repartitionById(groups, "task").sortWithinPartitions("task", F.asc_nulls_first("shard"))
        parts.append(written(met.mapInArrow(_search(k, n_docs, n_words / max(1, n_docs)), "q long, doc_id long, score double"), "found"))
    found = reduce(DataFrame.unionByName, parts)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "doc_id"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.join(asked.select("q", "query_id").hint("merge"), "q").select("query_id", "rank", "doc_id", "score")
