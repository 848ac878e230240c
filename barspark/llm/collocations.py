"""Collocations: phrases of a few words that occur together far more often than apart, counted in FM-indexes.

The words of each language are dealt into shards of bounded size. The index of a shard is over word ids: the symbols
before the sorted suffixes of its text (the BWT), and the same of the text read backwards. Suffixes are sorted by their
first four words, which is as deep as phrases go. A phrase is a pair of intervals, one in either index; a word on its
left is found by the forward symbols of its interval, a word on its right by the backward ones, and either step narrows
both intervals. All intervals of a level are extended together, by array operations.

Counts are summed across shards. A word or phrase that is rare everywhere can't be part of a frequent phrase: rare words
are left out of the indexes, and a level goes on only from phrases in a bitmap of the frequent ones of the level before.
The bitmap has a fixed size and only false hits, which the sums sort out.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import written
from .words import LOWER, chunks, mix

LONGEST = 4
FACTOR = 2_000_000
SHARD_WORDS = 1 << 18
BITMAP_BITS = 1 << 26  # 8 MB
_INSIDE = np.ones(256, bool)
_INSIDE[[0x20, *range(0x09, 0x0E), *b".,;:!?"]] = False
_BREAK = np.zeros(256, np.int64)
_BREAK[[*range(0x0A, 0x0E), *b".,;:!?"]] = 1
_SHARDS = "shard long, lang string, words array<string>, counts array<long>, text binary"
_INDEX = "shard long, lang string, ids binary, forward binary, backward binary"


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def _few_rows(spark: SparkSession, n: int = 4) -> Iterator[None]:
    """While an index's rows, of some MB each, go to Python: few of them at a time."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, n)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


class _Shard:
    """Words of one language, until they are many enough."""

    def __init__(self):
        self.words: list[pa.Array] = []
        self.places: list[np.ndarray] = []
        self.size = self.end = 0

    def add(self, raw: np.ndarray, offsets: np.ndarray) -> None:
        inside = _INSIDE[raw]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        cuts = offsets[:-1][offsets[:-1] < len(raw)]
        first[cuts] = inside[cuts]
        begins = np.flatnonzero(first)
        kept = np.cumsum(inside)[begins] - 1 if len(begins) else begins
        data = LOWER[raw[inside]]
        self.words.append(pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(np.append(kept, len(data)).astype(np.int64)), pa.py_buffer(data)))
        # A word's place leaves a gap to the word before it in another piece or text.
        gaps = np.cumsum(_BREAK[raw])[begins] + np.searchsorted(offsets, begins, "right") if len(begins) else begins
        self.places.append(np.arange(len(begins)) + gaps + self.end)
        self.size += len(begins)
        self.end = int(self.places[-1][-1]) + 2 if len(begins) else self.end

    def row(self, shard: int, lang: str) -> dict:
        coded = pa.chunked_array(self.words).combine_chunks().dictionary_encode()
        ids = coded.indices.to_numpy().astype(np.int32) + 1
        places = np.concatenate(self.places)
        starts = np.diff(places, prepend=-2) > 1
        text = np.zeros(len(ids) + int(starts.sum()), "<i4")
        text[np.arange(len(ids)) + np.cumsum(starts)] = ids  # 0 before each piece
        return {"shard": shard, "lang": lang, "words": coded.dictionary.to_pylist(), "counts": np.bincount(ids, minlength=len(coded.dictionary) + 1)[1:], "text": text.tobytes()}


def shards(docs: DataFrame) -> DataFrame:
    """The words of each shard with their counts, and its text as places in that list, counted from 1, with 0 between pieces."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made, open_ = TaskContext.get().partitionId() << 32, 0, {}
        schema = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("text", pa.binary())])

        def closed(lang: str) -> pa.RecordBatch:
            nonlocal made
            made += 1
            return pa.RecordBatch.from_pylist([open_.pop(lang).row(first + made, lang)], schema)

        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                for _, _, raw, offsets in chunks(batch.column(1).filter(pa.array(langs.indices.to_numpy() == code)), 1 << 20):
                    open_.setdefault(lang, _Shard()).add(raw, offsets)
                    if open_[lang].size >= SHARD_WORDS:
                        yield closed(lang)
            while sum(s.size for s in open_.values()) >= SHARD_WORDS:  # many languages in one task
                yield closed(max(open_, key=lambda x: open_[x].size))
        for lang in list(open_):
            if open_[lang].size:
                yield closed(lang)

    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(deal, _SHARDS)


def _bwt(text: np.ndarray, n: int) -> np.ndarray:
    """The symbol before each suffix of `text` (symbols below n, 0 between pieces), in the order of the suffixes' first LONGEST symbols."""
    rank, width = text.astype(np.int64), 1
    while width < LONGEST:
        after = np.zeros_like(rank)
        after[:-width] = rank[width:]
        # Nothing behind the end of a piece counts.
        key = np.where(rank > 0, rank * (int(rank.max(initial=0)) + 1) + after, 0)
        if 2 * width >= LONGEST:
            order = np.argsort(key, kind="stable")
            break
        distinct, rank = np.unique(key, return_inverse=True)
        rank = rank if len(distinct) and distinct[0] == 0 else rank + 1
        width *= 2
    return np.roll(text, 1)[order].astype("<i4")


def indexed(shards: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """An FM-index for each shard, over the words in `vocabulary` (lang, word, id); others end a piece. Its own symbols are 1, 2, ... for the numbers in `ids`."""
    listed = shards.select("shard", "lang", F.posexplode("words").alias("k", "word"))
    # A word meets one row for each shard that has it.
    known = listed.join(vocabulary.select("lang", "word", "id").hint("merge"), ["lang", "word"]).groupBy("shard").agg(F.collect_list(F.struct("k", "id")).alias("known"))
    both = shards.select("shard", "lang", "text").join(known.hint("merge"), "shard")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                shard, lang, text, known = (batch.column(c)[r] for c in range(4))
                text = np.frombuffer(text.as_py(), "<i4")
                k, ids = (known.values.field(c).to_numpy() for c in ("k", "id"))
                order = np.argsort(ids)
                symbol = np.zeros(int(text.max(initial=0)) + 1, np.int32)
                symbol[k[order] + 1] = np.arange(1, len(ids) + 1)
                text = symbol[text]
                text = np.append(text[(text > 0) | (np.roll(text, 1) > 0)], np.int32(0))  # one 0 in a row is enough
                forward, backward = (_bwt(t, len(ids) + 1) for t in (text, text[::-1]))
                yield pa.RecordBatch.from_arrays([pa.array([shard.as_py()]), pa.array([lang.as_py()]), *[pa.array([x.tobytes()], pa.binary()) for x in (ids[order].astype("<i8"), forward, backward)]], names=["shard", "lang", "ids", "forward", "backward"])

    return both.mapInArrow(index, _INDEX)


class Intervals:
    """Phrases of one length in a shard: their words (one column each), and where they start in either index, and their counts. Phrases are in order of the forward index."""

    def __init__(self, words: np.ndarray, forward: np.ndarray, backward: np.ndarray, counts: np.ndarray):
        self.words, self.forward, self.backward, self.counts = words, forward, backward, counts


class FmIndex:
    def __init__(self, forward: np.ndarray, backward: np.ndarray, symbols: int):
        self.bwt = {"left": forward, "right": backward}
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(forward, minlength=symbols + 1))])
        # Where the suffix goes that starts one symbol earlier: the place of this symbol among equal ones.
        self.steps = {side: self._steps(x) for side, x in self.bwt.items()}

    @staticmethod
    def _steps(bwt: np.ndarray) -> np.ndarray:
        steps = np.empty(len(bwt), np.int64)
        steps[np.argsort(bwt, kind="stable")] = np.arange(len(bwt))
        return steps

    def singles(self) -> Intervals:
        counts = np.diff(self.starts)[1:]
        there = np.flatnonzero(counts)
        return Intervals(there[:, None] + 1, self.starts[1:-1][there], self.starts[1:-1][there], counts[there])

    def extended(self, phrases: Intervals, side: str) -> Intervals:
        """All phrases with one more word on their left or right."""
        own, other = (phrases.forward, phrases.backward) if side == "left" else (phrases.backward, phrases.forward)
        phrase = np.repeat(np.arange(len(own)), phrases.counts)
        rows = np.repeat(own - np.concatenate([[0], np.cumsum(phrases.counts)[:-1]]), phrases.counts) + np.arange(len(phrase))
        symbols = self.bwt[side][rows].astype(np.int64)
        key = phrase * len(self.starts) + symbols
        order = np.argsort(key, kind="stable")  # so that the first of a group has the least row
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        counts = np.diff(np.append(first, len(key)))
        phrase, symbols, rows = phrase[order][first], symbols[order][first], rows[order][first]
        # In the other index a phrase's interval is in the order of what extends it here.
        begun = np.zeros(len(own), np.int64)
        fresh = np.flatnonzero(np.diff(phrase, prepend=-1))
        begun[phrase[fresh]] = first[fresh]
        inner = other[phrase] + first - begun[phrase]
        outer = self.steps[side][rows]
        good = symbols > 0
        words = phrases.words[phrase]
        words = np.column_stack([symbols, words] if side == "left" else [words, symbols])[good]
        forward, backward = (outer, inner) if side == "left" else (inner, outer)
        return Intervals(words, forward[good], backward[good], counts[good])

    def only(self, phrases: Intervals, kept: np.ndarray) -> Intervals:
        return Intervals(phrases.words[kept], phrases.forward[kept], phrases.backward[kept], phrases.counts[kept])


def _packed(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A phrase's word ids, 32 bits each, as two numbers."""
    wide = np.zeros((len(ids), LONGEST), np.int64)
    wide[:, : ids.shape[1]] = ids
    return wide[:, 0] << 32 | wide[:, 1], wide[:, 2] << 32 | wide[:, 3]


def _bit(head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    return (mix(mix(head.astype(np.uint64)) + tail.astype(np.uint64)) & np.uint64(BITMAP_BITS - 1)).astype(np.int64)


def _frequent(index: DataFrame, length: int, least: int, bitmaps: list) -> DataFrame:
    """(head, tail, a): the phrases of `length` words that occur `least` times in all shards together."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids, forward, backward = (np.frombuffer(batch.column(c)[r].as_py(), t) for c, t in ((0, "<i8"), (1, "<i4"), (2, "<i4")))
                fm = FmIndex(forward, backward, len(ids))
                found = fm.extended(fm.singles(), "left")
                for k, shared in enumerate(bitmaps):
                    bits = np.frombuffer(shared.value, np.uint8)

                    def hit(words: np.ndarray, bits=bits) -> np.ndarray:
                        bit = _bit(*_packed(ids[words - 1]))
                        return (bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)

                    found = fm.only(found, hit(found.words))
                    found = fm.extended(found, "right" if k % 2 == 0 else "left")
                    found = fm.only(found, hit(found.words[:, 1:] if k % 2 == 0 else found.words[:, :-1]))
                head, tail = _packed(ids[found.words - 1])
                for k in range(0, len(head), 1 << 17):
                    yield pa.RecordBatch.from_arrays([pa.array(x[k : k + (1 << 17)].astype(np.int64)) for x in (head, tail, found.counts)], names=["head", "tail", "n"])

    counted = index.select("ids", "forward", "backward").mapInArrow(count, "head long, tail long, n long")
    return written(counted.groupBy("head", "tail").agg(F.sum("n").alias("a")).where(F.col("a") >= least), f"phrases{length}")


def _bitmap(phrases: DataFrame) -> bytes:
    """Bits of all phrases: 8 MB whatever the input; each task sends the driver's sum its own slices only."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_bit(*(batch.column(c).to_numpy() for c in range(2))) + 1)], names=["bit"])

    dealt = phrases.select("head", "tail").mapInArrow(bits, "bit long").withColumn("slice", F.bitmap_bucket_number("bit"))
    out = np.zeros(BITMAP_BITS >> 3, np.uint8)
    size = 32768 >> 3  # bytes of a row of bitmap_construct_agg; slices and numbers in them count from 1
    for r in dealt.groupBy("slice").agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).toLocalIterator():
        out[(r["slice"] - 1) * size : r["slice"] * size] = np.frombuffer(r["bits"], np.uint8)
    return out.tobytes()


def _parts(length: int) -> list[tuple[int, int, int, int]]:
    """(cut, side, first word, words) of all parts of a phrase."""
    return [part for k in range(1, length) for part in ((k, 0, 0, k), (k, 1, k, length - k))]


def _part(first: int, n: int) -> tuple[Column, Column]:
    """head and tail of the words first, ..., first + n - 1 of a phrase in the array `ids`."""
    at = lambda k: F.col("ids")[first + k] if k < n else F.lit(0).cast("long")
    return tuple(F.shiftleft(at(k), 32).bitwiseOR(at(k + 1)) for k in (0, 2))


def collocations(docs: DataFrame, least: int = 30, best: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `best` phrases of each language, see the module's docstring.

    `docs` needs text and lang; other columns aren't read. Null and empty texts have no words; a null lang counts as `und`.
    Repeated rows count each. Texts of any length are whole in one shard, and its rows have ids of at most 32 bits: there
    may be 2^31 distinct words that occur `least` times. Equal scores are in order of a, then of the phrase's bytes. An
    empty table, and a language without frequent phrases, give no rows.
    """
    spark = docs.sparkSession
    dealt = written(shards(docs), "shards")
    counts = dealt.select("lang", F.explode(F.arrays_zip(F.col("words").alias("word"), F.col("counts").alias("f"))).alias("w")).select("lang", "w.*")
    counts = written(counts.groupBy("lang", "word").agg(F.sum("f").alias("f")), "counts")
    sizes = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    numbered = written(counts.where(F.col("f") >= least).withColumn("id", F.monotonically_increasing_id()), "numbered")
    # Numbers within a partition, times the number of partitions: small numbers, none twice.
    parts = (numbered.agg(F.max(F.shiftright("id", 33))).first()[0] or 0) + 1
    small = F.col("id").bitwiseAND((1 << 33) - 1) * parts + F.shiftright("id", 33) + 1
    vocabulary = written(numbered.withColumn("id", F.when(small < 1 << 31, small).otherwise(F.raise_error(F.lit("too many words for ids of 32 bits")))), "vocabulary")
    bitmaps, levels = [], []
    with _few_rows(spark):
        index = written(indexed(dealt, vocabulary), "index")
    for length in range(2, LONGEST + 1):
        with _few_rows(spark):
            levels.append(_frequent(index, length, least, bitmaps))
        if length < LONGEST:
            bitmaps.append(spark.sparkContext.broadcast(_bitmap(levels[-1])))

    low = F.lit((1 << 32) - 1)
    split = lambda c: (F.shiftright(c, 32), F.col(c).bitwiseAND(low))
    found = [t.select("head", "tail", "a", F.slice(F.array(*split("head"), *split("tail")), 1, k + 2).alias("ids")) for k, t in enumerate(levels)]
    # Counts of all that a phrase can be cut into, and of what extends it by one word.
    smaller = vocabulary.select(F.shiftleft("id", 32).alias("head"), F.lit(0).cast("long").alias("tail"), F.col("f").alias("a"))
    for t in levels[:-1]:
        smaller = smaller.unionByName(t)
    longer = [t.select("a", F.explode(F.array(*[F.struct(*[c.alias(x) for c, x in zip(_part(first, k + 2), ("head", "tail"), strict=True)]) for first in (0, 1)])).alias("p")) for k, t in enumerate(found[1:])]
    longer = longer[0].unionByName(longer[1]).groupBy("p.head", "p.tail").agg(F.max("a").alias("longer"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    inside = F.lit(100).cast("decimal(3,0)") * wide("longer") >= F.lit(80).cast("decimal(3,0)") * wide("a")
    asked = []
    for k, t in enumerate(found):
        lone = t if k + 2 == LONGEST else t.join(longer.hint("merge"), ["head", "tail"], "left").where(F.coalesce(~inside, F.lit(True))).drop("longer")
        each = [F.struct(F.lit(cut).alias("cut"), F.lit(side).alias("side"), *[c.alias(x) for c, x in zip(_part(first, n), ("head", "tail"), strict=True)]) for cut, side, first, n in _parts(k + 2)]
        asked.append(lone.select(F.struct("head", "tail").alias("key"), "a", "ids", F.explode(F.array(*each)).alias("p")))
    asked = asked[0].unionByName(asked[1]).unionByName(asked[2]).select("key", "a", "ids", "p.*")
    met = asked.join(smaller.withColumnRenamed("a", "f").hint("merge"), ["head", "tail"])
    cuts = met.groupBy("key", "cut").agg(F.first("a").alias("a"), F.first("ids").alias("ids"), F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    score = F.expr(f"CAST({FACTOR} AS DECIMAL(7,0)) * CAST(a AS DECIMAL(20,0)) DIV (l + r)")
    scored = cuts.withColumn("score", score).groupBy("key").agg(F.first("a").alias("a"), F.first("ids").alias("ids"), F.min(F.struct("score", "cut", "l", "r")).alias("s"))
    words = scored.select("key", "a", "s", F.posexplode("ids").alias("k", "id")).join(vocabulary.select("id", "lang", "word").hint("merge"), "id")
    phrases = words.groupBy("key").agg(F.first("lang").alias("lang"), F.first("a").alias("a"), F.first("s").alias("s"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    order = [F.col("s.score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    # The best of each of many parts first, so that no task sees all phrases of a language.
    some = phrases.withColumn("deal", F.pmod(F.xxhash64("key"), F.lit(256))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "deal").orderBy(*order))).where(F.col("rank") <= best)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= best)
    return ranked.join(sizes.hint("merge"), "lang").select("lang", "rank", "phrase", "a", "s.l", "s.r", "n", "s.score")
