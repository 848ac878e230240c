"""Packing documents into sequences of bounded length: best fit over a histogram of lengths, then places by rank.

What fits where depends on lengths only, and there are no more lengths than a sequence has tokens. So the plan is made
for counts of equal pieces and equal sequences at once, from the longest length down; its size is bounded by the length
of a sequence, whatever the number of documents. Pieces are then numbered within their length and take the planned
place with their number.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written
from .words import SPACES, chunks

END = 1
CACHED = 600_000
CHUNK_BYTES = 1 << 22
RANKS = 4096  # of one length and block of the join with the plan
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, place long"
_MARK, _TOGETHER = "\ue000", 1024
_LATIN, _DOTTED = "\u024f", "\u0130"  # up to here letters are normalised already and have one lower form, but for the dotted capital
_APOSTROPHE, _LETTER, _OTHER, _FAR = 3, 1, 2, 4
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[128:] = _FAR
_KIND[39] = _APOSTROPHE
for _c in (*range(65, 91), *range(97, 123)):
    _KIND[_c] = _LETTER
_KIND[SPACES] = 0


class Encoder:
    """Ids of texts by a tokenizer that drops white space and never has one token over a letter and a mark: units are encoded once and kept.

    A text is cut at white space, after an ASCII letter that is followed by another ASCII character, and before an ASCII
    letter that follows another ASCII character but an apostrophe (which may start a contraction). A text with `<|`, with
    which special tokens begin, is encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.mark = self._ids(_MARK)
        # Byte-level models show printable bytes as they are, and the others by characters from 256 on, in order.
        bare = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
        self.shown = {b: 256 + k for k, b in enumerate(bare)}
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.starts, self.used = np.zeros(1 << 20, np.uint32), np.zeros(CACHED + 1, np.int64), 0

    def _keep(self, units: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        n = len(self.known)
        while n + len(units) >= len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.starts[n + 1 : n + 1 + len(units)] = self.used + np.cumsum(sizes)
        self.used += len(ids)
        assert len(sizes) == len(units), "the vocabulary doesn't mark the ends of words"
        self.known.update(zip(units, range(n, n + len(units))))

    def _learn(self, units: list[str]) -> None:
        # A plain word is a run of letters that normalising only lowers, so it is one word of the model, which takes its bytes as characters.
        plain = [u for u in units if u.isalpha() and (u.isascii() or (max(u) <= _LATIN and _DOTTED not in u))]
        tokenize = self.tokenizer.model.tokenize
        found = [[t.id for t in tokenize(u if u.isascii() else u.lower().encode().decode("latin-1").translate(self.shown))] for u in plain]
        self._keep(plain, np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64))
        # Of the others many are encoded as one text, with a mark between them.
        plain = set(plain)
        rest = [u for u in units if u not in plain and _MARK not in u]
        for part in (rest[k : k + _TOGETHER] for k in range(0, len(rest), _TOGETHER)):
            ids = self._ids(f" {_MARK} ".join(part) + f" {_MARK}")
            n = len(self.mark)
            marks = np.flatnonzero(ids == self.mark[-1])
            marks = marks[marks >= n - 1]
            marks = marks[np.all([ids[marks - k] == self.mark[-1 - k] for k in range(n)], axis=0)]
            marks = marks[(marks < n) | self.last[ids[marks - n]]]
            within = np.ones(len(ids), bool)
            within[(marks[:, None] - np.arange(n)).ravel()] = False
            self._keep(part, ids[within], np.diff(marks, prepend=-1) - n)
        for u in units:
            if _MARK in u:
                ids = self._ids(u)
                self._keep([u], ids, np.array([len(ids)]))

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def texts(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text; none for null."""
        for _, _, raw, offsets in chunks(texts, CHUNK_BYTES):
            kind = _KIND[raw]
            before = np.zeros_like(kind)
            before[1:] = kind[:-1]
            before[offsets[:-1][offsets[:-1] < len(raw)]] = 0
            first = (kind > 0) & ((before == 0) | ((before == _LETTER) & ((kind == _OTHER) | (kind == _APOSTROPHE))) | ((before == _OTHER) & (kind == _LETTER)))
            inside = kind > 0
            lower = raw[inside]
            capital = (lower >= 65) & (lower <= 90)
            lower = lower + (capital * np.uint8(32))
            begins = np.flatnonzero(first[inside])
            units = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(np.append(begins, len(lower)).astype(np.int64)), pa.py_buffer(lower)).dictionary_encode()
            rows = np.searchsorted(np.flatnonzero(first), offsets)
            names = units.dictionary.to_numpy(zero_copy_only=False).tolist()
            if len(self.known) + len(names) > CACHED:
                self._clear()
            found = list(map(self.known.get, names))
            fresh = [k for k, f in enumerate(found) if f is None]
            self._learn([names[k] for k in fresh])
            for k in fresh:
                found[k] = self.known[names[k]]
            place = np.array(found, np.int64)[units.indices.to_numpy()]
            sizes = self.starts[place + 1] - self.starts[place]
            ends = np.concatenate([[0], np.cumsum(sizes)])
            ids = self.flat[np.repeat(self.starts[place] - ends[:-1], sizes) + np.arange(ends[-1])]
            pipe = np.flatnonzero((raw[:-1] == 60) & (raw[1:] == 124))
            whole = set(np.searchsorted(offsets, pipe, "right") - 1) if len(pipe) else ()
            for r in range(len(offsets) - 1):
                if r in whole:
                    yield self._ids(raw[offsets[r] : offsets[r + 1]].tobytes().decode())
                else:
                    yield ids[ends[rows[r]] : ends[rows[r + 1]]]


_encoders: dict[str, Encoder] = {}


def pieces(docs: DataFrame, tokenizer: str, most: int = 4096) -> DataFrame:
    """One row for each piece of each row of `docs` (doc_id, text): doc_id, piece, start, length, ids_crc32, and task and place, which number the pieces of a length within a task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(tokenizer) or _encoders.setdefault(tokenizer, Encoder(tokenizer))
        task, seen = TaskContext.get().partitionId(), np.zeros(most + 1, np.int64)
        end = np.array([END], "<u4")
        for batch in batches:
            out: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.texts(batch.column(1)), strict=True):
                ids = np.concatenate([ids.astype("<u4"), end])
                for piece, start in enumerate(range(0, len(ids), most)):
                    part = ids[start : start + most]
                    out.append((doc, piece, start, len(part), zlib.crc32(part.tobytes()), task, int(seen[len(part)])))
                    seen[len(part)] += 1
            types = (pa.int64(), pa.int32(), *[pa.int64()] * 5)
            columns = list(zip(*out)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[c.split()[0] for c in _PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, _PIECES)


def best_fit(counts: dict[int, int], most: int) -> list[tuple[int, int, int, int, int, int]]:
    """The plan: (length, first rank, places, first sequence, pieces in a sequence, offset in it).

    Lengths are taken from the longest down, and a piece goes to the sequence with the least room that it fits in. As
    sequences with the same content stay together, a step fills all of them or cuts their run in two or three, so that
    there are fewer runs than three times the number of lengths.
    """
    runs: list[list] = []  # sequences of equal content: [number of them, [(length, pieces, offset)], first rank of each content]
    rooms: list[tuple[int, int]] = []  # (room left, run) of those that have room, ascending

    def grow(run: int, length: int, each: int, room: int) -> None:
        runs[run][1].append((length, each, most - room))
        if room > each * length:
            insort(rooms, (room - each * length, run))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, (length, -1))
            if at < len(rooms):
                room, run = rooms.pop(at)
            else:
                room, run = most, len(runs)
                runs.append([-(-left // (most // length)), []])
            each = room // length
            full = min(left // each, runs[run][0])
            over = runs[run][0] - full
            content = list(runs[run][1])
            if full:
                runs[run][0] = full
                left -= full * each
                grow(run, length, each, room)
                run = len(runs)
                if over:
                    runs.append([over, list(content)])
            if over:
                if left:  # fewer than would fill one more
                    runs[run][0] = 1
                    rest = left
                    left = 0
                    grow(run, length, rest, room)
                    if over > 1:
                        runs.append([over - 1, list(content)])
                        insort(rooms, (room, len(runs) - 1))
                else:
                    insort(rooms, (room, run))
    plan, rank, sequence = [], dict.fromkeys(counts, 0), 0
    for number, content in runs:
        for length, each, offset in content:
            plan.append((length, rank[length], number * each, sequence, each, offset))
            rank[length] += number * each
        sequence += number
    return plan


def packed(docs: DataFrame, tokenizer: str, most: int = 4096) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    `docs` needs doc_id and text; other columns aren't read. A document is its ids and one END; only those longer than
    `most` are cut. Null and empty texts have the END alone. A null doc_id stays null; rows that repeat a doc_id are packed
    each. An empty table gives an empty table. Which of the pieces of one length takes which of the places planned for
    this length is arbitrary. The histogram, of at most `most` rows, is all that reaches the driver.
    """
    spark = docs.sparkSession
    rows = written(pieces(docs, tokenizer, most), "pieces")
    parts = written(rows.groupBy("task", "length").agg(F.count("*").alias("n")), "parts")
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.createDataFrame(best_fit(histogram, most), "length long, first long, places long, sequence long, each long, offset long")
    # A rank is the number of a piece in its task after all of the tasks before: a running sum of a row for each task and length.
    before = parts.select("task", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    ranked = rows.join(before.hint("merge"), ["task", "length"]).withColumn("rank", F.col("before") + F.col("place")).withColumn("block", F.floor(F.col("rank") / RANKS))
    # Runs of places are cut by blocks of ranks, so that no key of the join has more than RANKS pieces.
    block = lambda c: F.floor(c / RANKS)
    last = F.col("first") + F.col("places") - 1
    spans = written(plan.withColumn("block", F.explode(F.sequence(block(F.col("first")), block(last)))).select("length", "block", "first", last.alias("last"), "sequence", "each", "offset"), "spans")
    met = ranked.join(spans.withColumnsRenamed({"offset": "base"}).hint("merge"), ["length", "block"]).where(F.col("rank").between(F.col("first"), F.col("last")))
    slot = F.col("rank") - F.col("first")
    return met.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.floor(slot / F.col("each"))).alias("sequence_id"), (F.col("base") + slot % F.col("each") * F.col("length")).alias("offset"))
