"""LM scoring with a log-frequency Bloom filter.

Training counts tokens (words with A-Z lower-cased, and one end for each text) and bigrams, over all training texts. Each
count is quantised on a log scale, and the filter holds it as the set of pairs (n-gram, 1), ..., (n-gram, q). A text's
probability interpolates the bigram's relative frequency, with counts read by probing for q = 1, 2, ... until a probe
fails, with the smoothed unigram. The weight of each side follows from how often the first word was seen.

The filter grows with the corpus: nothing is left out of it. It comes in slices by the n-gram's hash, of about
SLICE_TOKENS training tokens each, and a slice has as many bits as its entries need. As its whole size has no bound it
isn't broadcast whole; a task holds one slice at a time. To score, the different n-grams of each CHUNK_ROWS texts go to
their slices, packed, and the levels found come back to the chunk, one byte each. Slice and n-grams (and then texts and
levels) meet in a task sorted, so that what is asked streams past what is held. Within a slice an n-gram is known by 32
bits of its hash; that two share them is rarer than a false probe. Unigrams of the vocabulary (below) stand in the
broadcast counts already, and are quantised from there.

The base score, by exact counts, takes the vocabulary's part (tokens that make up at least one in VOCABULARY of all, so
VOCABULARY at most) from broadcast counts, and joins only the other tokens' rows with the table of counts; no row of a
frequent token is shuffled, so there are no hot keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written
from .words import hashed_words, mix

VOCABULARY = 500_000
SLICE_TOKENS = 1_000_000
GATHERED_TOKENS = 2_500_000
CHUNK_ROWS = 1024
PROBES = 8
STEPS = 2.0  # quantisation: steps for each doubling
DISCOUNT = 4.0
END, START = np.uint64(0x51ED270B9F652295), np.uint64(0x2545F4914F6CDD1D)
_UNIGRAM, _BIGRAM = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)


def _tokens(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, token hashes with each text's end, first token of each row)."""
    for first, last, words, rows in hashed_words(texts):
        ends = rows[1:]
        yield first, last, np.insert(words, ends, END), rows + np.arange(len(rows))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, tokens, _ in _tokens(batch.column(0)):
            token, n = np.unique(tokens, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n.astype(np.int64))], names=["token", "n"])


@dataclass
class Vocabulary:
    tokens: np.ndarray  # hashes, ascending
    counts: np.ndarray
    total: int
    distinct: int

    def ids(self, tokens: np.ndarray) -> np.ndarray:
        """Places in the vocabulary from 1; 0 for all other tokens."""
        if not len(self.tokens):
            return np.zeros(len(tokens), np.int64)
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        return np.where(self.tokens[at] == tokens, at + 1, 0)


def unigrams(tokens: np.ndarray) -> np.ndarray:
    return mix(tokens + _UNIGRAM)


def bigrams(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return mix(before * _BIGRAM + mix(tokens))


def _keys(tokens: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each token and of the bigram that ends with it; `firsts` are the places where texts begin."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[firsts] = START
    return unigrams(tokens), bigrams(before, tokens)


def _by_slice(keys: np.ndarray, slices: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The order of the keys by slice, their 32 bits in that order, the slices that occur, and where each begins (and the end)."""
    own = keys % np.uint64(slices)
    order = np.argsort(own, kind="stable")
    own = own[order]
    begin = np.flatnonzero(np.append(True, own[1:] != own[:-1])[: len(own)])
    return order, (keys >> np.uint64(32)).astype(np.uint32)[order], own[begin].astype(np.int32), np.append(begin, len(own))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[begin], np.add.reduceat(n, begin) if len(begin) else n


def _gathered(known: Broadcast, slices: int):
    """Counts of bigrams, and of unigrams outside the vocabulary, within a part of a task's texts, packed by slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> pa.RecordBatch:
            keys, n = _merged(held)
            order, keys, own, begin = _by_slice(keys, slices)
            n = n[order].astype(np.int32)
            cut = list(zip(begin[:-1], begin[1:], strict=True))
            return pa.RecordBatch.from_arrays([pa.array(own), *[pa.array([x[a:b].tobytes() for a, b in cut], pa.binary()) for x in (keys, n)]], names=["slice", "keys", "n"])

        for batch in batches:
            for _, _, tokens, rows in _tokens(batch.column(0)):
                single, pair = _keys(tokens, rows[:-1])
                held += [np.unique(keys, return_counts=True) for keys in (single[known.value.ids(tokens) == 0], pair)]
                size += len(tokens)
                if size >= GATHERED_TOKENS:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return run


def levels(n: np.ndarray) -> np.ndarray:
    return 1 + np.floor(STEPS * np.log2(np.maximum(n, 1))).astype(np.int64)


def middle(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the middle of those on it; 0 if there is none."""
    return np.where(level == 0, 0.0, 2.0 ** ((level - np.where(level < 3, 1.0, 0.5)) / STEPS))


@dataclass
class Slice:
    cells: int
    bits: np.ndarray  # eight cells in a byte

    def _place(self, keys: np.ndarray, level: int, probe: int) -> np.ndarray:
        return ((mix(mix(keys.astype(np.uint64)) + np.uint64(level * PROBES + probe)) >> np.uint64(32)) * np.uint64(self.cells) >> np.uint64(32)).astype(np.int64)

    @classmethod
    def of(cls, keys: np.ndarray, n: np.ndarray) -> Slice:
        height = levels(n)
        out = cls(max(64, int(height.sum() * PROBES / np.log(2))), np.zeros(0, np.uint8))
        full = np.zeros(out.cells, bool)
        for level in range(1, int(height.max(initial=0)) + 1):
            some = keys[height >= level]
            for probe in range(PROBES):
                full[out._place(some, level, probe)] = True
        out.bits = np.packbits(full)
        return out

    def read(self, keys: np.ndarray) -> np.ndarray:
        """The last level that is there, by repeated probes; 0 if none is."""
        found, left, level = np.zeros(len(keys), np.uint8), np.arange(len(keys)), 1
        while len(left) and level < 256:
            for probe in range(PROBES):
                cell = self._place(keys[left], level, probe)
                left = left[(self.bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1]
            found[left] = level
            level += 1
        return found


def _filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The filter's slices out of rows (slice, keys, n), which come slice by slice."""
    number, parts, size = None, [], 0

    def out() -> pa.RecordBatch:
        made = Slice.of(*_merged(parts))
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([made.cells], pa.int64()), pa.array([made.bits.tobytes()], pa.binary())], names=["slice", "cells", "bits"])

    for batch in batches:
        for r, s in enumerate(batch.column("slice").to_pylist()):
            if s != number and parts:
                yield out()
                parts, size = [], 0
            number = s
            parts.append((np.frombuffer(batch.column("keys")[r].as_py(), np.uint32), np.frombuffer(batch.column("n")[r].as_py(), np.int32).astype(np.int64)))
            size += len(parts[-1][0])
            if size > 4 * SLICE_TOKENS:  # one n-gram in very many tasks
                parts = [_merged(parts)]
                size = 0
    if parts:
        yield out()


@dataclass
class Model:
    vocabulary: Broadcast
    slices: int
    filter: DataFrame  # (slice, cells, bits)
    counts: DataFrame  # (token, n) of all training tokens


def train(docs: DataFrame) -> Model:
    """The model of all texts of `docs` (text); null texts are empty, and each text gives one end."""
    spark = docs.sparkSession
    texts = docs.select(F.col("text").cast("string").alias("text"))
    counts = written(texts.mapInArrow(_counts, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")), "tokens")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    frequent = counts.where(F.col("n") >= max(2, -(-total // VOCABULARY))).toPandas()  # VOCABULARY rows at most
    tokens, n = frequent["token"].to_numpy(np.int64).view(np.uint64), frequent["n"].to_numpy(np.int64)
    order = np.argsort(tokens)
    known = spark.sparkContext.broadcast(Vocabulary(tokens[order], n[order], total, distinct))
    slices = max(1, -(-total // SLICE_TOKENS))
    gathered = texts.mapInArrow(_gathered(known, slices), "slice int, keys binary, n binary").repartition(slices, "slice").sortWithinPartitions("slice")
    return Model(known, slices, written(gathered.mapInArrow(_filters, "slice int, cells long, bits binary"), "filter"), counts)


def _wanted(v: Vocabulary, tokens: np.ndarray, firsts: np.ndarray, slices: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the tokens of a chunk: their vocabulary ids; for each bigram, and then each token outside the vocabulary, the
    place of its level among those asked for; and what is asked: keys by slice, the slices, and where each begins."""
    ids = v.ids(tokens)
    single, pair = _keys(tokens, firsts)
    keys, where = np.unique(np.concatenate([pair, single[ids == 0]]), return_inverse=True)
    order, keys, own, begin = _by_slice(keys, slices)
    place = np.empty(len(keys), np.int64)
    place[order] = np.arange(len(keys))
    return ids, place[where], keys, own, begin


def _joined(parts: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of all texts, and the number of tokens of each."""
    found = [(tokens, np.diff(edges)) for part in parts for _, _, tokens, edges in _tokens(part)]
    return np.concatenate([t for t, _ in found]), np.concatenate([n for _, n in found])


def _runs(numbers: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.append(np.flatnonzero(np.append(True, numbers[1:] != numbers[:-1])[: len(numbers)]), len(numbers))
    yield from zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)


def _asks(known: Broadcast, slices: int):
    """The different n-grams that each chunk of the texts (chunk, text, row) asks each slice for.

    A chunk that is read in two tasks asks in two parts, known by their first rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, first, parts = None, 0, []

        def out() -> pa.RecordBatch:
            tokens, n = _joined(parts)
            _, _, keys, own, begin = _wanted(known.value, tokens, np.cumsum(n) - n, slices)
            asked = [keys[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([number] * len(own), pa.int64()), pa.array([first] * len(own), pa.int64()), pa.array(own), pa.array(asked, pa.binary())], names=["chunk", "row", "slice", "data"])

        for batch in batches:
            for a, b in _runs(batch.column(0).to_numpy()):
                c = batch.column(0)[a].as_py()
                if c != number and parts:
                    yield out()
                    parts = []
                if not parts:
                    number, first = c, batch.column(2)[a].as_py()
                parts.append(batch.column(1).slice(a, b - a))
        if parts:
            yield out()

    return run


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The levels of the n-grams asked for; a slice (with `cells`) comes before what asks it."""
    number, held = None, None
    for batch in batches:
        cells, out = batch.column("cells"), []
        for a, b in _runs(batch.column("slice").to_numpy()):
            s = batch.column("slice")[a].as_py()
            if cells[a].is_valid:
                number, held = s, Slice(cells[a].as_py(), np.frombuffer(batch.column("data")[a].as_py(), np.uint8))
                a += 1
            asked = [np.frombuffer(x, np.uint32) for x in batch.column("data").slice(a, b - a).to_pylist()]
            if asked:
                keys = np.concatenate(asked)
                # Without a slice of that number, training saw none of these.
                found = held.read(keys) if s == number else np.zeros(len(keys), np.uint8)
                out.append((a, b, [x.tobytes() for x in np.split(found, np.cumsum([len(x) for x in asked])[:-1])]))
        columns = [pa.concat_arrays([batch.column(name).slice(0, 0), *(batch.column(name).slice(a, b - a) for a, b, _ in out)]) for name in ("chunk", "row", "slice")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([x for _, _, data in out for x in data], pa.binary())], names=["chunk", "row", "slice", "data"])


def probability(pair: np.ndarray, context: np.ndarray, single: np.ndarray, size: int) -> np.ndarray:
    """Of a token: its bigram's share of the first word's count, interpolated with the smoothed unigram; `size` is N + V."""
    share = context / (context + DISCOUNT * np.sqrt(context + 1))
    return share * np.minimum(1.0, pair / np.maximum(context, 1)) + (1 - share) * (single + 1) / (size + 1)


def _combined(known: Broadcast, slices: int):
    """Scores of the texts of each chunk, which come before the chunk's levels (by slice, the texts with slice -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = known.value
        size = v.total + v.distinct
        logs = np.log10((np.concatenate([[0], v.counts]) + 1) / (size + 1))
        about = middle(np.concatenate([[0], levels(v.counts)]))
        number, held, found = None, [], {}

        def out() -> Iterator[pa.RecordBatch]:
            rows, texts, ids_of = (pa.concat_arrays(x) for x in zip(*held, strict=True))
            firsts = sorted(found)
            edges = np.append(np.searchsorted(rows.to_numpy(), firsts), len(rows))
            for first, a, b in zip(firsts, edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                yield part(texts.slice(a, b - a), ids_of.slice(a, b - a), b"".join(found[first]))

        def part(text: pa.Array, doc_id: pa.Array, read: bytes) -> pa.RecordBatch:
            tokens, n = _joined([text])
            ends = np.cumsum(n)
            ids, place, keys, _, _ = _wanted(v, tokens, ends - n, slices)
            read = middle(np.arange(256))[np.frombuffer(read, np.uint8)]
            if len(read) != len(keys):
                raise ValueError(f"{len(read)} levels for {len(keys)} n-grams")
            read = read[place]
            pair, single, rare = read[: len(tokens)], about[ids], ids == 0
            single[rare] = read[len(tokens) :]
            context = np.empty_like(single)
            context[1:] = single[:-1]
            context[ends - n] = single[ends - 1]  # a text begins as often as one ends
            row = np.repeat(np.arange(len(n)), n)
            score, base, seen = (np.bincount(row, w, len(n)) for w in (np.log10(probability(pair, context, single, size)), np.where(rare, 0.0, logs[ids]), ~rare))
            token, at = tokens[rare].view(np.int64), row[rare]
            order = np.lexsort((token, at))
            token, at = token[order], at[order]
            begin = np.flatnonzero(np.append(True, (token[1:] != token[:-1]) | (at[1:] != at[:-1]))[: len(token)])
            times = np.diff(np.append(begin, len(token)))
            lists = np.concatenate([[0], np.cumsum(np.bincount(at[begin], minlength=len(n)))]).astype(np.int32)
            entry = pa.StructArray.from_arrays([pa.array(token[begin]), pa.array(times.astype(np.int32))], names=["token", "times"])
            return pa.RecordBatch.from_arrays([doc_id, pa.array(n.astype(np.int64)), pa.array(seen.astype(np.int64)), pa.array(base), pa.array(score), pa.ListArray.from_arrays(pa.array(lists), entry)], names=["doc_id", "n_tokens", "n_known", "base", "score", "rare"])

        for batch in batches:
            slice_of = batch.column("slice").to_numpy()
            for a, b in _runs(batch.column("chunk").to_numpy()):
                c = batch.column("chunk")[a].as_py()
                if c != number and held:
                    yield from out()
                    held, found = [], {}
                number = c
                m = a + int((slice_of[a:b] < 0).sum())
                if m > a:
                    held.append(tuple(batch.column(name).slice(a, m - a) for name in ("row", "text", "doc_id")))
                for first, data in zip(batch.column("row").slice(m, b - m).to_pylist(), batch.column("data").slice(m, b - m).to_pylist(), strict=True):
                    found.setdefault(first, []).append(data)
        if held:
            yield from out()

    return run


def scored(docs: DataFrame, model: Model, stable: bool = False) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for each row of `docs` (doc_id, text).

    n_known counts the tokens that training saw. base_score adds log10((c+1)/(N+V+1)) over the tokens with exact counts,
    score is the model's log10 probability. A null or empty text has one token, its end. Rows that repeat a doc_id each
    give a row, as do rows with a null doc_id. An empty table gives an empty table; other columns are not read. `docs` is
    read twice; it is written first, unless it is `stable`: a scan of files, which gives the same order each time.
    """
    v: Vocabulary = model.vocabulary.value
    kind, row = docs.schema["doc_id"].dataType.simpleString(), F.monotonically_increasing_id()
    # Written, as chunks must be the same when they are read again.
    texts = docs.select(row.alias("row"), "doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("chunk", F.expr(f"row div {CHUNK_ROWS}"))
    texts = texts if stable else written(texts, "texts")
    none = F.lit(None).cast("long")
    asked = texts.select("chunk", "text", "row").mapInArrow(_asks(model.vocabulary, model.slices), "chunk long, row long, slice int, data binary")
    held = model.filter.select("slice", "cells", none.alias("chunk"), none.alias("row"), F.col("bits").alias("data"))
    met = held.unionByName(asked.withColumn("cells", none)).repartition(model.slices, "slice").sortWithinPartitions("slice", F.col("cells").isNull())
    answers = met.mapInArrow(_answered, "chunk long, row long, slice int, data binary")
    back = texts.select("chunk", F.lit(-1).alias("slice"), "row", "doc_id", "text", F.lit(None).cast("binary").alias("data")).unionByName(answers.withColumns({"doc_id": F.lit(None).cast(kind), "text": F.lit(None).cast("string")}))
    back = back.repartition("chunk").sortWithinPartitions("chunk", "slice", "row")
    parts = back.mapInArrow(_combined(model.vocabulary, model.slices), f"doc_id {kind}, n_tokens long, n_known long, base double, score double, rare array<struct<token:long,times:int>>")
    parts = written(parts.withColumn("row", F.monotonically_increasing_id()), "scores")

    zero = float(np.log10(1 / (v.total + v.distinct + 1)))
    rare = parts.select("row", F.explode("rare").alias("r")).select("row", "r.token", "r.times")
    found = rare.join(model.counts.hint("merge"), "token")
    more = found.groupBy("row").agg(F.sum("times").cast("long").alias("known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("gain"))
    total = F.aggregate("rare", F.lit(0), lambda s, x: s + x["times"])
    out = parts.select("row", "doc_id", "n_tokens", "n_known", "base", "score", total.alias("rare")).join(more.hint("merge"), "row", "left")
    # An unseen token counts log10(1/(N+V+1)); a seen one log10(c+1) more.
    base = F.col("base") + F.col("rare") * F.lit(zero) + F.coalesce("gain", F.lit(0.0))
    return out.select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
