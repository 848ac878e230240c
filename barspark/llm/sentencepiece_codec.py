"""SentencePiece encoding and decoding by a Viterbi pass that shares prefixes.

The distinct marked words of a batch, a word being its leading spaces with what follows up to the next space, are sorted,
so that they come in the order of a depth-first walk of their trie. The forward states of a word's characters stay on a
stack, and the next word goes on from the prefix that both share.

The public model is of the BPE kind: its scores are merge ranks, not log-probabilities, and a maximum over their sums
isn't what the model encodes. So the lattice has 0 for two neighbouring pieces that byte-pair merging leaves standing
side by side and minus infinity for any others. Exactly one path is left to each position, and its pieces are the
model's own: the ids equal those of the SentencePiece library, except that a literal U+2581 is kept apart from a space.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_CHARS = 1 << 21
CACHED_WORDS = 200_000
_NEVER = float("inf")
_MARKED = re.compile(" +[^ ]*")


@dataclass
class Vocabulary:
    """Pieces with a space for the mark, the rank at which each is merged (-1: a single character), and byte pieces."""

    ids: dict[str, int]
    ranks: dict[str, float]
    byte_ids: list[int]
    texts: list[bytes]
    longest: int
    halves: dict[str, tuple[str, str]] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids, ranks, byte_ids, texts = {}, {}, [0] * 256, []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[3:-1], 16)] = i
                texts.append(bytes([int(piece[3:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                texts.append(b"")
            else:
                piece = piece.replace("▁", " ")
                ids[piece] = i
                ranks[piece] = -1 if len(piece) == 1 else -model.get_score(i)
                texts.append(piece.encode())
        out = cls(ids, ranks, byte_ids, texts, max(map(len, ids)))
        for piece in [p for p in ids if len(p) > 1]:
            merged, last = out.merge(piece)
            if len(merged) == 1:
                out.halves[piece] = last
            else:  # merging never makes it
                del out.ids[piece]
        return out

    def merge(self, text: str) -> tuple[list[str], tuple[str, str]]:
        """Plain byte-pair merging of a short string, and the last pair merged."""
        parts, last = list(text), ("", "")
        while True:
            found = [(self.ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.ranks]
            if not found:
                return parts, last
            k = min(found)[1]
            last = (parts[k], parts[k + 1])
            parts[k : k + 2] = ["".join(last)]

    def spine(self, piece: str, side: int) -> list[tuple[str, float, float]]:
        """(part, rank at which it appears, rank at which it is merged away) along the piece's right (1) or left (0) edge."""
        out, gone = [], _NEVER
        while True:
            out.append((piece, self.ranks.get(piece, -1), gone))
            if piece not in self.halves:
                return out
            gone = self.ranks[piece]
            piece = self.halves[piece][side]


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.unknown = len(vocabulary.texts)  # stands for any character that is no piece
        self.pieces = {i: p for p, i in vocabulary.ids.items()}
        self.ends: dict[str, int] = {}  # all that pieces end with: the piece's id, or -1 if it is none itself
        for piece in vocabulary.ids:
            for k in range(1, len(piece)):
                self.ends.setdefault(piece[k:], -1)
        self.ends.update(vocabulary.ids)
        self.rights: dict[str, list] = {}
        self.lefts: dict[str, list] = {}
        self.stands: dict[int, bool] = {}
        self.cache: dict[str, np.ndarray] = {}

    def _stand(self, a: int, b: int) -> bool:
        """Whether merging leaves a and b side by side: no part at the end of a merges with a part at the start of b before either is merged away. Of equal ranks the left one goes first."""
        ranks, first, second = self.v.ranks, self.pieces.get(a), self.pieces.get(b)
        if first is None or second is None:
            return True
        right = self.rights.get(first) or self.rights.setdefault(first, self.v.spine(first, 1))
        left = self.lefts.get(second) or self.lefts.setdefault(second, self.v.spine(second, 0))
        for x, since, until in right:
            for y, begun, ended in left:
                rank = ranks.get(x + y)
                if rank is not None and rank < until and rank <= ended and since <= ended and begun < until:
                    return False
        return True

    def _ids(self, piece: str) -> list[int]:
        i = self.v.ids.get(piece)
        return [i] if i is not None else [self.v.byte_ids[b] for b in piece.encode()]

    def words(self, words: list[str]) -> list[np.ndarray]:
        """Piece ids of distinct words, in the given order."""
        ends, stands, unknown, byte_ids = self.ends.get, self.stands, self.unknown, self.v.byte_ids
        last, begins = [unknown], [0]  # of the encoding of each prefix: its last piece, and where that begins
        before, done = "", {}
        for word in sorted(words):
            if word.startswith("  "):  # runs of spaces have pieces of equal rank
                done[word] = self._spaces(word)
                continue
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :], begins[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                start, piece = end - 1, unknown
                while start >= 0:
                    found = ends(word[start:end])
                    if found is None:
                        break
                    if found >= 0:
                        if not start:
                            piece = found
                            break
                        pair = last[start] << 20 | found
                        good = stands.get(pair)
                        if good is None:
                            good = stands[pair] = self._stand(last[start], found)
                        if good:
                            piece = found
                            break
                    start -= 1
                last.append(piece)
                begins.append(end - 1 if piece == unknown else start)
            before = word
            pieces, end = [], len(word)
            while end:
                piece = last[end]
                pieces += [piece] if piece != unknown else [byte_ids[b] for b in reversed(word[end - 1].encode())]
                end = begins[end]
            pieces.reverse()
            done[word] = np.array(pieces, np.int32)
        if len(stands) > 1_000_000:
            stands.clear()
        return [done[w] for w in words]

    def _spaces(self, word: str) -> np.ndarray:
        """A word after two spaces or more. Runs of spaces merge last and from the left, so the rest goes first and keeps the last space if a piece holds it."""
        spaces = len(word) - len(word.lstrip(" "))
        rest = self.words([word[spaces - 1 :]])[0]
        alone = rest[0] == self.v.ids[" "]
        spaces -= not alone
        runs = max(0, spaces // self.v.longest - 1)
        full, part = (self.v.merge(" " * n)[0] for n in (self.v.longest, spaces - runs * self.v.longest))
        ids = [i for p in full for i in self._ids(p)] * runs + [i for p in part for i in self._ids(p)]
        return np.concatenate([np.array(ids, np.int32), rest[int(alone) :]])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the first of each (one more entry than texts)."""
        parts = [_MARKED.findall(" " + t) if t else [] for t in texts]
        flat = [w for p in parts for w in p]
        index = {w: k for k, w in enumerate(dict.fromkeys(flat))}
        new = [w for w in index if w not in self.cache]
        coded = dict(zip(new, self.words(new), strict=True))
        table = [coded[w] if w in coded else self.cache[w] for w in index]
        if len(self.cache) < CACHED_WORDS:
            self.cache.update((w, x) for w, x in coded.items() if len(w) <= 16)
        sizes = np.fromiter(map(len, table), np.int64, len(table))
        pool = np.concatenate(table) if table else np.zeros(0, np.int32)
        codes = np.fromiter(map(index.__getitem__, flat), np.int64, len(flat))
        return gather(pool, sizes, codes, np.cumsum([0, *map(len, parts)]))


def gather(pool: np.ndarray, sizes: np.ndarray, codes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Puts the pool's entry `code` (its `sizes[code]` items) for each code one after the other; and where each row begins."""
    starts = np.cumsum(sizes) - sizes
    own = sizes[codes]
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(own)])
    at = np.repeat(starts[codes] - ends[:-1], own) + np.arange(ends[-1])
    return pool[at], ends[rows]


def _batches(column: pa.Array) -> Iterator[list[str]]:
    """The texts in lists of about CHUNK_CHARS; nulls as empty."""
    part, size = [], 0
    for text in column:
        text = text.as_py() or ""
        part.append(text)
        size += len(text)
        if size >= CHUNK_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def encoded(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """`docs` with the column `ids`: array of piece ids of `text`.

    A space is put before the text, as the model does; characters that are no piece become their UTF-8 bytes. Null and
    empty texts have no ids. Rows that repeat give the same ids each; an empty table gives an empty table; other columns
    stay, and one that is named like `ids` is replaced.
    """
    known = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model_path))  # as large as the model's file, whatever the input
    kept = docs.select(*[docs[c] for c in docs.columns if c != ids])
    columns, source = kept.columns, kept.columns.index(text)
    out_schema = T.StructType([*kept.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(known.value)
        for batch in batches:
            row = 0
            for texts in _batches(batch.column(source)):
                flat, offsets = encoder.encode(texts)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
                part = batch.slice(row, len(texts))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(columns))), lists], names=[*columns, ids])
                row += len(texts)

    return kept.mapInArrow(run, out_schema)


def decoded(docs: DataFrame, model_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """`docs` with the column `text`: what the piece ids stand for, without the space put before it.

    Null and empty arrays give an empty text; a null id, and one that the model doesn't have, gives nothing; bytes that
    are no UTF-8 are replaced by U+FFFD. A column that is named like `text` is replaced.
    """
    spark = docs.sparkSession
    vocabulary = Vocabulary.load(model_path)
    known = spark.sparkContext.broadcast([*vocabulary.texts, b""])
    kept = docs.drop(text)
    columns, at = kept.columns, kept.columns.index(ids)
    out_schema = T.StructType([*kept.schema.fields, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = known.value
        pool = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        none = len(pieces) - 1
        for whole in batches:
            for row in range(0, whole.num_rows, 256):
                batch = whole.slice(row, 256)
                lists = batch.column(at)
                codes = lists.flatten().fill_null(none).to_numpy(zero_copy_only=False).astype(np.int64)
                codes[(codes < 0) | (codes > none)] = none
                counts = np.asarray([0 if n is None else n for n in pa.compute.list_value_length(lists).to_pylist()], np.int64)
                flat, offsets = gather(pool, sizes, codes, np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)]))
                raw = flat.tobytes()
                texts = [raw[a + (raw[a : a + 1] == b" ") : b].decode(errors="replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*columns, text])

    return kept.mapInArrow(run, out_schema)
