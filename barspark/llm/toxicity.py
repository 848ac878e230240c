"""Toxicity: a support vector machine on a subsequence string kernel, with Nystroem landmarks.

The kernel compares two words by their common subsequences of three characters within six places; each counts less the
more it is stretched, so characters put into an insult, or left out of it, weaken a match without ending it. Words are
taken without punctuation, single letters in a row as one word, and words of more than WINDOW letters by every window.

A text is as toxic as its worst sentence, and a sentence as its worst word. Training is multi-instance, as labels are
known for whole texts only: all sentences of a text that isn't toxic are negative, and of a toxic text at least one is
positive. The first machine is a least-squares one on labelled sentences, where each word bears its sentence's label. In
each round that follows it picks every text's worst sentence, by its worst word; those of toxic texts are the positive
examples of the next machine, and those of the other texts join its negative ones. Landmarks are words of the labelled
sentences. As the kernel has an explicit map onto (hashed) subsequences, landmarks and machine fold into one weight for
each subsequence, and scoring is a sum over a text's bytes.

What is fitted is fitted on a sample: at most MOST_TOXIC and MOST_OTHER labelled training texts, the first in the order
of a hash of their doc_id, and for the first machine at most MOST_SENTENCES of their sentences of either label.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written
from .words import LOWER, SPACES, chunks, mix

MOST_TOXIC, MOST_OTHER, MOST_SENTENCES = 6000, 9000, 8000
SENTENCE_WORDS = 64  # longer ones are taken in parts
LANDMARKS_TOXIC, LANDMARKS_OTHER = 192, 64
STANDING = 8000  # words of other texts that are negative examples in every round, the first in the order of a hash
ROUNDS = 4
PENALTY = 0.1
WINDOW = 17  # with the mark
MARK = 1  # stands before each word
DECAY = 0.7
BITS = 15
STEPS = [(a, b) for b in range(2, 6) for a in range(1, b)]  # second and third character of a subsequence, after the first
_LETTER = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
_ENDS = np.isin(np.arange(256), [ord(c) for c in ".!?"])
_CODES = mix(np.arange(768, dtype=np.uint64) + np.uint64(77)).reshape(3, 256)
_PARTS = (_CODES >> np.uint64(64 - BITS)).astype(np.int32)
_NORMS = np.sqrt(np.array([1e-9] + [max(1e-9, sum(max(0, n - b) * DECAY ** (2 * (b + 1)) for _, b in STEPS)) for n in range(1, WINDOW + 1)]))


def _letters(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased letters of the rows without anything else, the unit (word or run of single letters) of each, and the row and sentence of each unit.

    A sentence ends with a line, or with one of .!? before white space.
    """
    space = SPACES[raw]
    ended = space & (raw == 10)
    ended[1:] |= space[1:] & _ENDS[raw[:-1]]
    keep = np.flatnonzero(_LETTER[raw])
    letters = LOWER[raw[keep]]
    token = np.cumsum(space, dtype=np.int32)[keep]
    row = (np.searchsorted(offsets, keep, "right") - 1).astype(np.int32)
    fresh = np.ones(len(letters), bool)
    fresh[1:] = (token[1:] != token[:-1]) | (row[1:] != row[:-1])
    starts = np.flatnonzero(fresh)
    alone = np.diff(np.concatenate([starts, [len(letters)]])) == 1
    joined = np.zeros(len(starts), bool)
    joined[1:] = alone[1:] & alone[:-1] & (row[starts[1:]] == row[starts[:-1]])
    fresh[starts[joined]] = False
    starts = np.flatnonzero(fresh)
    unit = np.cumsum(fresh, dtype=np.int32) - 1
    sentence = np.cumsum(ended, dtype=np.int32)[keep[starts]]
    return np.insert(letters, starts, MARK), np.insert(unit, starts, unit[starts]), row[starts], sentence


def _windows(unit: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and unit of the stretches of at most WINDOW letters: a unit's first one, and every `step` letters a later one, the last flush with its end."""
    starts = np.searchsorted(unit, np.arange(unit[-1] + 1))
    ends = np.concatenate([starts[1:], [len(unit)]])
    long = np.flatnonzero(ends - starts > WINDOW)
    many = -(-(ends[long] - starts[long] - WINDOW) // step)
    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + 1
    more = np.minimum(np.repeat(starts[long], many) + nth * step, np.repeat(ends[long], many) - WINDOW)
    shorter = np.minimum(ends, starts + WINDOW)
    return np.concatenate([starts, more]), np.concatenate([shorter, more + WINDOW]), np.concatenate([np.arange(len(starts)), np.repeat(long, many)])


def _joined(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(words), np.uint8), np.repeat(np.arange(len(words)), [len(w) for w in words])


def _norms(words: list[bytes]) -> np.ndarray:
    return _NORMS[np.array([len(w) for w in words], np.int64)]


def _subsequences(letters: np.ndarray, unit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(place of the first letter, hashed subsequence, weight) for each kind of STEPS."""
    parts = [_PARTS[k][letters] for k in range(3)]
    for a, b in STEPS:
        n = len(letters) - b
        if n > 0:
            at = np.flatnonzero(unit[:n] == unit[b:])
            yield at, parts[0][at] ^ parts[1][at + a] ^ parts[2][at + b], DECAY ** (b + 1)


def _products(words: list[bytes], table: np.ndarray) -> np.ndarray:
    """Normalised subsequence vectors of the words, times a table with a row for each subsequence."""
    out = np.zeros((len(words), table.shape[1]), np.float32)
    letters, unit = _joined(words)
    for at, sub, weight in _subsequences(letters, unit):
        if len(at):
            own = unit[at]
            starts = np.flatnonzero(np.diff(own, prepend=-1))
            out[own[starts]] += np.add.reduceat(table[sub], starts, axis=0) * np.float32(weight)
    return out / _norms(words)[:, None].astype(np.float32)


def _vectors(words: list[bytes]) -> np.ndarray:
    out = np.zeros((1 << BITS, len(words)), np.float32)
    letters, unit = _joined(words)
    for at, sub, weight in _subsequences(letters, unit):
        np.add.at(out, (sub, unit[at]), weight)
    return out / _norms(words)[None, :].astype(np.float32)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def worst(self, texts: pa.Array, witness: bool = False) -> tuple[np.ndarray, list[bytes]]:
        """The highest decision value among the words of each text, -2 if it has none; with `witness` that word, too, its mark in front unless it is an inner part of one."""
        out, words = np.full(len(texts), -2.0), [b""] * (len(texts) if witness else 0)
        weights = self.weights.astype(np.float32)
        for first, last, raw, offsets in chunks(texts):
            letters, unit, row, _ = _letters(raw, offsets)
            if not len(letters):
                continue
            each = np.zeros(len(letters), np.float32)
            parts = [_PARTS[k][letters] for k in range(3)]
            for b in range(2, 6):
                n = len(letters) - b
                if n > 0:
                    same = (unit[:n] == unit[b:]) * np.float32(DECAY ** (b + 1))
                    ends_with = parts[0][:n] ^ parts[2][b:]
                    for a in range(1, b):
                        each[:n] += weights[ends_with ^ parts[1][a : n + a]] * same
            sums = np.concatenate([np.zeros(1), np.cumsum(each, dtype=np.float64)])
            begin, end, of = _windows(unit, 1)
            # Subsequences that begin in a window's last places reach beyond it; they belong to later windows.
            value = (sums[end] - sums[begin]) / _NORMS[end - begin] + self.bias
            np.maximum.at(out[first:last], row[of], value)
            if witness:
                order = np.lexsort((-value, row[of]))
                tops = order[np.flatnonzero(np.diff(row[of][order], prepend=-1))]
                for k in tops:
                    words[first + int(row[of[k]])] = letters[begin[k] : end[k]].tobytes()
        return out, words

    def score(self, worst: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * worst + self.shift, -50, 50)))


def _machine(features: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss, by Newton steps on the points inside the margin."""
    x = np.hstack([features, np.ones((len(features), 1), features.dtype)]).astype(np.float64)
    ridge = np.full(x.shape[1], PENALTY)
    ridge[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(40):
        inside = labels * (x @ w) < 1
        xi, wi = x[inside], weights[inside]
        new = np.linalg.solve((xi * wi[:, None]).T @ xi + np.diag(ridge), xi.T @ (wi * labels[inside]))
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w[:-1], float(w[-1])


def _sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sentences of the texts (toxic, text) with their label: words between spaces, each different word once."""
    for batch in batches:
        toxic = batch.column(0).to_numpy()
        for first, _, raw, offsets in chunks(batch.column(1)):
            letters, unit, row, sentence = _letters(raw, offsets)
            if not len(letters):
                continue
            begin, end, of = _windows(unit, WINDOW // 2)
            order = np.argsort(of, kind="stable")
            begin, end, of = begin[order], end[order], of[order]
            fresh = np.ones(len(of), bool)
            fresh[1:] = (row[of[1:]] != row[of[:-1]]) | (sentence[of[1:]] != sentence[of[:-1]])
            edges = np.append(np.flatnonzero(fresh), len(of))
            data, out, labels = letters.tobytes(), [], []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                for k in range(a, b, SENTENCE_WORDS):
                    words = {data[begin[j] : end[j]] for j in range(k, min(b, k + SENTENCE_WORDS)) if end[j] - begin[j] > 3}
                    if words:
                        out.append(b" ".join(sorted(words)))
                        labels.append(int(toxic[first + row[of[a]]]))
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(out, pa.binary())], names=["toxic", "words"])


def _worst(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value, words = model.worst(batch.column(1), witness=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value), pa.array(words, pa.binary())], names=["toxic", "worst", "word"])

    return run


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(toxic, text) of the labelled texts to learn from: at most MOST_TOXIC + MOST_OTHER, each different text once."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for k, most in ((1, MOST_TOXIC), (0, MOST_OTHER))]
    # At most MOST_TOXIC + MOST_OTHER rows of two numbers, hence the broadcast.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")
    return written(rows.groupBy("text").agg(F.max("toxic").alias("toxic")).select("toxic", "text"), "sample")


def _first_machine(words: list[bytes], n: np.ndarray, m: np.ndarray, base: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, float]:
    """Least squares on all words: +1 as often as in sentences of toxic texts (n), -1 as often as in others (m)."""
    size = root.shape[1] + 1
    a, b = np.diag(np.full(size, 1e-4)), np.zeros(size)
    p, q = n / max(1, n.sum()), m / max(1, m.sum())
    for k in range(0, len(words), 4000):
        x = np.hstack([_products(words[k : k + 4000], base) @ root, np.ones((len(words[k : k + 4000]), 1), np.float32)]).astype(np.float64)
        u, v = p[k : k + 4000], q[k : k + 4000]
        a += (x * (u + v)[:, None]).T @ x
        b += x.T @ (u - v)
    w = np.linalg.solve(a, b)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model out of `docs` (doc_id, text) and `labels` (doc_id, toxic); give only rows that may be learned from.

    None if there are no sentences of toxic texts, or none of others. Rows with a null doc_id or label count for nothing,
    nor do labels other than 0 and 1. A doc_id, or a text, with both labels is toxic; repeated texts count once. A
    sentence that occurs in both kinds of text is not toxic.
    """
    texts = _sample(docs, labels)
    sentences = texts.mapInArrow(_sentences, "toxic int, words binary").groupBy("words").agg(F.min("toxic").alias("toxic"))
    counts: tuple[Counter[bytes], Counter[bytes]] = (Counter(), Counter())
    for k in (0, 1):
        for r in sentences.where(F.col("toxic") == k).orderBy(F.xxhash64("words"), "words").limit(MOST_SENTENCES).collect():
            counts[k].update(bytes(r["words"]).split(b" "))
    if not counts[0] or not counts[1]:
        return None
    words = sorted(counts[0].keys() | counts[1].keys())
    n, m = (np.array([counts[k][w] for w in words], float) for k in (1, 0))
    more = np.lexsort((np.arange(len(words)), m / m.sum() - n / n.sum()))[:LANDMARKS_TOXIC]
    usual = [k for k in np.lexsort((np.arange(len(words)), -m)).tolist() if k not in set(more.tolist())][:LANDMARKS_OTHER]
    base = _vectors([words[k] for k in [*more.tolist(), *usual]])
    values, vectors = np.linalg.eigh(base.T.astype(np.float64) @ base)
    keep = values > 1e-3
    root = (vectors[:, keep] / np.sqrt(values[keep])).astype(np.float32)

    def model(w: np.ndarray, bias: float) -> Model:
        return Model((base @ (root @ w)).astype(np.float64), bias)

    now = model(*_first_machine(words, n, m, base, root))
    standing = sorted(counts[0], key=lambda w: (hash_of(w), w))[:STANDING]
    negative: Counter[bytes] = Counter(dict.fromkeys(standing, 1))
    features: dict[bytes, np.ndarray] = {}
    for turn in range(ROUNDS + 1):
        found = texts.mapInArrow(_worst(now), "toxic int, worst double, word binary").collect()  # a word of each text of the sample
        if turn == ROUNDS:
            break
        positive = Counter(bytes(r["word"]) for r in found if r["toxic"] and r["word"])
        for word, times in Counter(bytes(r["word"]) for r in found if not r["toxic"] and r["word"]).items():
            negative[word] = max(negative[word], times)
        new = sorted((positive.keys() | negative.keys()) - features.keys())
        for k in range(0, len(new), 4000):
            features.update(zip(new[k : k + 4000], _products(new[k : k + 4000], base) @ root, strict=True))
        rows = [(w, 1.0, c) for w, c in sorted(positive.items())] + [(w, -1.0, c) for w, c in sorted(negative.items())]
        if not rows:
            return None
        now = model(*_machine(np.stack([features[w] for w, _, _ in rows]), np.array([y for _, y, _ in rows]), np.array([float(c) for _, _, c in rows])))

    x, label = np.array([(r["worst"], 1.0) for r in found]), np.array([float(r["toxic"]) for r in found])
    beta = np.zeros(2)
    for _ in range(50):  # logistic regression on one number, with a small penalty
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(2), x.T @ (label - p) - 0.05 * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    now.slope, now.shift = map(float, beta)
    return now


def hash_of(word: bytes) -> int:
    """A number that doesn't depend on the process."""
    return int(mix(np.frombuffer(word.ljust(24, b"\0")[:24], np.uint64)).sum())


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score) for each row of `docs` (doc_id, text), score from 0 to 1.

    Null and empty texts, and texts without letters, get the lowest score of the model. Without a model every score is 0.
    Rows that repeat a doc_id each give a row; an empty table gives an empty table; other columns are not read.
    """
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    if model is None:
        return texts.select("doc_id", F.lit(0.0).alias("score"))
    known = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(known.value.score(known.value.worst(batch.column(1))[0]))], names=["doc_id", "score"])

    return texts.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def without_toxic(docs: DataFrame, model: Model | None, threshold: float = 0.7) -> DataFrame:
    """The rows of `docs` whose text scores below `threshold`, with their columns. Without a model all rows stay.

    Null and empty texts stay unless the model's lowest score is above `threshold`; rows that repeat a doc_id are judged
    each by its text; an empty table gives an empty table; other columns are passed on, whatever their names.
    """
    if model is None:
        return docs
    known = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(known.value.score(known.value.worst(batch.column(at))[0]) < threshold))

    return docs.mapInArrow(run, docs.schema)
