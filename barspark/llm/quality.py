"""Quality classifier from weak labels.

Overlapping heuristic labellers look at each whole text and vote good, bad or nothing. How often each is right is
estimated by expectation-maximisation over all texts: what counts is how often each pattern of votes occurs, and there
are at most 3^labellers patterns. The posterior labels train a hashed linear scorer, on byte 3-grams and on the
measures' buckets, for a sample of at most SAMPLE texts, the first in the order of a hash of their doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import LOWER, chunks, mix, word_bounds, word_hashes

SAMPLE = 4000
BITS = 12
ROUNDS = 100
# Each labeller: measure, bad at or below, good from, good to, bad at or above; in between it doesn't vote.
LABELLERS = (
    ("distinct words", 0.25, 0.5, 1.0, 1.1),
    ("repeated words", -1.0, 0.0, 0.05, 0.1),
    ("capitals", -1.0, 0.0, 0.1, 0.3),
    ("punctuation", -1.0, 0.002, 0.055, 0.085),
    ("marks per word", -1.0, 0.0, 0.05, 0.2),
    ("most frequent word", -1.0, 0.0, 0.16, 0.25),
    ("sentence ends per word", 0.004, 0.02, 0.4, 0.7),
    ("mean word length", 3.3, 4.2, 6.4, 7.4),
)
BUCKETS = 24
_UPPER = np.array([65 <= b < 91 for b in range(256)])
_PUNCTUATION = np.array([33 <= b < 48 or 58 <= b < 65 or 91 <= b < 97 or 123 <= b < 127 for b in range(256)])
_MARKS = np.isin(np.arange(256), [ord(c) for c in "|#%&*$!@~^<>{}[]\\_="])
_ENDS = np.isin(np.arange(256), [ord(c) for c in ".!?"])
_GRAMS = mix(np.arange(768, dtype=np.uint64) + np.uint64(31)).reshape(3, 256)


def _measures(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row for each text, one column for each of LABELLERS."""
    starts, ends, rows = word_bounds(raw, offsets)
    n = np.diff(rows)
    many, length = np.maximum(n, 1), np.maximum(np.diff(offsets), 1)

    def share(table: np.ndarray, of: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(table[raw])])
        return (sums[offsets[1:]] - sums[offsets[:-1]]) / of

    words = word_hashes(raw, starts, ends)
    row = np.repeat(np.arange(len(n)), n)
    again = np.bincount(row[1:], (words[1:] == words[:-1]) & (row[1:] == row[:-1]), len(n)) if len(words) > 1 else np.zeros(len(n))
    for r in np.flatnonzero(n > 1):
        words[rows[r] : rows[r + 1]].sort()
    fresh = np.ones(len(words), bool)
    fresh[1:] = (words[1:] != words[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(fresh)
    times = np.diff(np.concatenate([at, [len(words)]]))
    top = np.zeros(len(n))
    np.maximum.at(top, row[at], times)
    top = np.where(n >= 20, top, 0)
    letters = np.bincount(row, ends - starts, len(n))
    return np.column_stack([np.where(n >= 20, np.bincount(row[at], minlength=len(n)) / many, 0.6), again / many, share(_UPPER, length), share(_PUNCTUATION, length), share(_MARKS, many), top / many, share(_ENDS, many), letters / many])


def _votes(measures: np.ndarray) -> np.ndarray:
    """2 good, 1 bad, 0 nothing; texts without words are bad to every labeller that votes."""
    low, start, end, high = np.array([x[1:] for x in LABELLERS]).T
    return np.where((measures <= low) | (measures >= high), 1, np.where((measures >= start) & (measures <= end), 2, 0))


def _patterns(votes: np.ndarray) -> np.ndarray:
    return votes @ 3 ** np.arange(votes.shape[1])


def _grams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte 3-grams, and the row of each."""
    n = max(0, len(raw) - 2)
    low = LOWER[raw]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    parts = [(_GRAMS[k] >> np.uint64(64 - BITS)).astype(np.int32)[low[k : n + k]] for k in range(3)]
    same = row[:n] == row[2 : n + 2]
    return (parts[0] ^ parts[1] ^ parts[2])[same], row[:n][same]


def _buckets(measures: np.ndarray) -> np.ndarray:
    """The bucket of each measure, each measure with buckets of its own, behind the 3-grams' places."""
    top = np.array([max(x[4] if x[4] < 1.1 else 1.0, x[3]) * 1.2 for x in LABELLERS])
    at = np.minimum(BUCKETS - 1, (np.sqrt(np.maximum(measures, 0) / top) * (BUCKETS - 1)).astype(np.int64))
    return (1 << BITS) + np.arange(measures.shape[1]) * BUCKETS + at


WIDTH = (1 << BITS) + len(LABELLERS) * BUCKETS


def posteriors(counts: dict[int, int]) -> tuple[dict[int, float], np.ndarray]:
    """P(good) of each pattern of votes, and each labeller's accuracy where it votes, by expectation-maximisation."""
    patterns = np.array(sorted(counts))
    n = np.array([counts[p] for p in patterns.tolist()], float)
    votes = patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    good = ((votes == 2).sum(1) + 0.5) / ((votes > 0).sum(1) + 1)
    good = np.where((votes == 1).sum(1) >= 2, np.minimum(good, 0.3), good)
    for _ in range(ROUNDS):
        prior = (n @ good + 1) / (n.sum() + 2)
        tables = [np.stack([((n * w)[:, None] * (votes == v)).sum(0) + 1 for v in range(3)]) for w in (good, 1 - good)]
        logs = [np.log(t / t.sum(0)) for t in tables]
        each = [np.log(p) + x[votes, np.arange(votes.shape[1])].sum(1) for p, x in zip((prior, 1 - prior), logs, strict=True)]
        good = 1 / (1 + np.exp(np.clip(each[1] - each[0], -500, 500)))
    right = ((n * good)[:, None] * (votes == 2)).sum(0) + ((n * (1 - good))[:, None] * (votes == 1)).sum(0)
    cast = (n[:, None] * (votes > 0)).sum(0)
    return dict(zip(patterns.tolist(), good.tolist(), strict=True)), right / np.maximum(cast, 1)


@dataclass
class Model:
    posterior: dict[int, float]
    accuracy: np.ndarray
    weights: np.ndarray

    def apply(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Posterior of the votes and score of each text."""
        posterior, score = np.full(len(texts), 0.5), np.zeros(len(texts))
        for first, last, raw, offsets in chunks(texts):
            measures = _measures(raw, offsets)
            posterior[first:last] = [self.posterior.get(p, 0.5) for p in _patterns(_votes(measures)).tolist()]
            grams, row = _grams(raw, offsets)
            many = np.maximum(np.bincount(row, minlength=last - first), 1)
            value = np.bincount(row, self.weights[grams], last - first) / many + self.weights[_buckets(measures)].sum(1) + self.weights[-1]
            score[first:last] = 1 / (1 + np.exp(-np.clip(value, -50, 50)))
        return posterior, score


def _pattern_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, raw, offsets in chunks(batch.column(0)):
            pattern, n = np.unique(_patterns(_votes(_measures(raw, offsets))), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pattern.astype(np.int64)), pa.array(n.astype(np.int64))], names=["pattern", "n"])


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, raw, offsets in chunks(batch.column(0)):
            measures = _measures(raw, offsets)
            grams, row = _grams(raw, offsets)
            many = np.maximum(np.bincount(row, minlength=last - first), 1)
            vectors = []
            for r, (a, b) in enumerate(zip(*(np.searchsorted(row, np.arange(last - first), side) for side in ("left", "right")), strict=True)):
                x = np.zeros(WIDTH, np.float32)
                x[: 1 << BITS] = np.bincount(grams[a:b], minlength=1 << BITS) / many[r]
                x[_buckets(measures[r : r + 1])[0]] = 1
                vectors.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(_patterns(_votes(measures)).astype(np.int64)), pa.array(vectors, pa.binary())], names=["pattern", "x"])


def fit(docs: DataFrame) -> Model:
    """The model out of `docs` (doc_id, text), without any labels. Without rows, or without a doc_id: one that scores everything 0.5."""
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    counts = dict(texts.select("text").mapInArrow(_pattern_rows, "pattern long, n long").groupBy("pattern").agg(F.sum("n")).collect())
    if not counts:
        return Model({}, np.zeros(len(LABELLERS)), np.zeros(WIDTH + 1))
    posterior, accuracy = posteriors(counts)
    sample = _sample(texts)
    rows = sample.select("text").mapInArrow(_feature_rows, "pattern long, x binary").collect()
    if not rows:
        return Model(posterior, accuracy, np.zeros(WIDTH + 1))
    x = np.stack([np.frombuffer(r.x, np.float32) for r in rows])
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    y = np.array([posterior.get(r.pattern, 0.5) for r in rows], np.float32)
    scale = np.ones(x.shape[1], np.float32)
    scale[: 1 << BITS] = 10.0
    x *= scale
    w, speed = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32)
    for turn in range(400):  # logistic loss on the posteriors, gradient descent with momentum
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        speed = 0.9 * speed - (0.5 if turn < 300 else 0.1) * (x.T @ (p - y) / len(y) + 1e-5 * w)
        w += speed
    return Model(posterior, accuracy, (w * scale).astype(np.float64))


def _sample(texts: DataFrame) -> DataFrame:
    """At most SAMPLE rows. Their ids are picked first, so that only their texts move."""
    ids = texts.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    return texts.join(F.broadcast(ids), "doc_id").limit(SAMPLE)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, posterior, score, keep) for each row of `docs` (doc_id, text): P(good) by the votes, and by the scorer.

    keep is score >= 0.5. Null and empty texts have no words; they are voted and scored like any others. Rows that repeat
    a doc_id each give a row; an empty table gives an empty table; other columns are not read.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            posterior, score = known.value.apply(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(posterior), pa.array(score), pa.array(score >= 0.5)], names=["doc_id", "posterior", "score", "keep"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, posterior double, score double, keep boolean")
