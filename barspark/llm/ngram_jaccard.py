"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Two documents link when their sets of word shingles have a Jaccard similarity of at least `percent`/100. The result
has one row per document with its class; links between different sets are all found, none is sampled or capped.

1. One pass hashes each text's shingles and keeps the set's size and a 128-bit sum of it. Documents with the same set
   are one row of the matrix from here on, so copies are never compared with one another.
2. The same pass counts n-grams in a sketch of fixed size. It only fixes a global order of the n-grams, common ones
   last; any order gives the same links.
3. A pair above the bound shares an n-gram among the first n - ceil(t n) + 1 of either set in that order. Only these
   columns of the matrix are multiplied. A column (block) with few documents gives all its pairs with their positions.
   A hot column isn't squared: its documents are counted exactly against one leader. Two that are both linked with the
   leader are in one class already. Otherwise one of them, y, is not; then |x & y| <= |y & leader| + (n-grams that x and
   y share outside of the leader's set), so either |y & leader| alone reaches the overlap that the sizes of x and y
   demand, or x and y share an n-gram that the leader doesn't have, and then one among the first n - ceil(t n) + 1 of these
   in the global order. Both are joined for, and little is left of either.
4. Overlaps are added up per pair; a pair whose count plus all that can still follow is below the overlap that the two
   sizes demand is discarded. The rest are counted exactly from the sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import written
from .words import hashed_words, mix, shingles

SKETCH_BITS = 21
CHUNK_BITS = 12
HOT = 32


def _chunk_sets(texts: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for first, last, words, rows in hashed_words(texts):
        yield first, last, *shingles(words, rows, width)


def _digests(grams: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for the set of each text."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(grams)])
    others = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(grams ^ np.uint64(0x5DEECE66D)))])
    return tuple((x[rows[1:]] - x[rows[:-1]]).view(np.int64) for x in (sums, others))


def _summary(width: int):
    """Per text: set size and 128 bits of the set; per task: how often each cell of the sketch was met."""
    cells, chunk = 1 << SKETCH_BITS, 1 << CHUNK_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(cells, np.uint32)
        for batch in batches:
            for first, last, grams, rows in _chunk_sets(batch.column(1), width):
                np.add.at(counts, grams >> np.uint64(64 - SKETCH_BITS), np.uint32(1))
                s1, s2 = _digests(grams, rows)
                n = last - first
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, n),
                        pa.array(np.diff(rows).astype(np.int64)),
                        pa.array(s1),
                        pa.array(s2),
                        pa.nulls(n, pa.int32()),
                        pa.nulls(n, pa.binary()),
                        pa.nulls(n, pa.binary()),
                    ],
                    names=["doc_id", "n", "s1", "s2", "chunk", "cells", "counts"],
                )
        parts = counts.reshape(-1, chunk)
        full = np.flatnonzero(parts.any(axis=1))
        for at in range(0, len(full), 64):
            some = full[at : at + 64]
            where = [np.flatnonzero(parts[k]).astype(np.uint16) for k in some]
            empty = pa.nulls(len(some), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [empty, empty, empty, empty, pa.array(some.astype(np.int32)), pa.array([w.tobytes() for w in where], pa.binary()), pa.array([parts[k][w].tobytes() for k, w in zip(some, where, strict=True)], pa.binary())],
                names=["doc_id", "n", "s1", "s2", "chunk", "cells", "counts"],
            )

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the tasks' sketches of each chunk as they stream by; one byte a cell is kept, four steps per doubling."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, cells, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            sums.setdefault(k, np.zeros(1 << CHUNK_BITS, np.int64))[np.frombuffer(cells, np.uint16)] += np.frombuffer(counts, np.uint32)
    levels = [np.minimum(255, np.log2(np.maximum(v, 1)) * 4).astype(np.uint8).tobytes() for v in sums.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(levels, pa.binary())], names=["chunk", "levels"])


def _prefixes(width: int, percent: int, levels: np.ndarray):
    """The first n - ceil(t n) + 1 n-grams of each set in the global order, with their positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int, int]] = set()  # copies within a task give their n-grams once
        for batch in batches:
            for _, _, grams, rows in _chunk_sets(batch.column(0), width):
                order = _order(grams, levels)
                parts, sizes = [], np.diff(rows)
                kept = np.where(sizes > 0, sizes - (percent * sizes + 99) // 100 + 1, 0)
                s1, s2 = _digests(grams, rows)
                for r in np.flatnonzero(kept):
                    same = (int(sizes[r]), int(s1[r]), int(s2[r]))
                    if same in seen:
                        kept[r] = 0
                        continue
                    seen.add(same)
                    span = order[rows[r] : rows[r + 1]]
                    parts.append(rows[r] + np.argsort(span, kind="stable")[: kept[r]])
                pick = np.concatenate(parts) if parts else np.zeros(0, np.int64)
                row = np.repeat(np.arange(len(kept)), kept)
                starts = np.cumsum(kept) - kept
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams[pick].view(np.int64)), pa.array(s1[row]), pa.array(s2[row]), pa.array(sizes[row].astype(np.int32)), pa.array((np.arange(len(row)) - starts[row]).astype(np.int32))],
                    names=["gram", "s1", "s2", "n", "pos"],
                )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, grams, rows in _chunk_sets(batch.column(0), width):
                sets = [grams[a:b].tobytes() for a, b in zip(rows[:-1], rows[1:], strict=True)]
                s1, s2 = _digests(grams, rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.diff(rows).astype(np.int64)), pa.array(s1), pa.array(s2), pa.array(sets, pa.binary())], names=["n", "s1", "s2", "grams"])

    return run


def _order(grams: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The global order of n-grams, rare ones first as far as the sketch knows."""
    return (levels[grams >> np.uint64(64 - SKETCH_BITS)].astype(np.uint64) << np.uint64(56)) | (grams >> np.uint64(8))


def _overlaps(rest_of: tuple[int, Broadcast] | None):
    """Overlap and sizes of each pair; with `rest_of` (percent, levels), the n-grams of b that a doesn't have, in the global order, as many as decide whether b links with another that isn't near a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (batch.column(k) for k in range(4))
            sets = zip(x.to_pylist(), y.to_pylist(), strict=True)
            pairs = [(np.frombuffer(u, np.uint64), np.frombuffer(v, np.uint64)) for u, v in sets]
            rest = [v[~np.isin(v, u)] for u, v in pairs]
            n, m = (np.array([len(p[k]) for p in pairs], np.int64) for k in (0, 1))
            both = m - np.array([len(r) for r in rest], np.int64)
            if rest_of is None:
                rest = [r[:0] for r in rest]
            else:
                percent, levels = rest_of[0], rest_of[1].value
                rest = [r[np.argsort(_order(r, levels), kind="stable")[: k - (percent * k + 99) // 100 + 1]] for r, k in zip(rest, m.tolist(), strict=True)]
            ends = np.cumsum([0, *map(len, rest)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *rest]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([a, b, pa.array(both), pa.array(n), pa.array(m), lists], names=["a", "b", "both", "n", "m", "rest"])

    return run


def _counted(pairs: DataFrame, texts: DataFrame, one: DataFrame, width: int, rest_of: tuple[int, Broadcast] | None = None) -> DataFrame:
    """Exact overlaps of distinct pairs (a, b) of sets; only texts with the doc_id of a set in a pair are read for it."""
    pairs = written(pairs, "pairs")
    keys = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    asked = written(one.join(keys.hint("shuffle_hash"), "key", "left_semi"), "asked")
    needed = texts.join(asked.select("id").distinct().hint("shuffle_hash"), "id", "left_semi").select("text").mapInArrow(_sets(width), "n long, s1 long, s2 long, grams binary")
    # A doc_id may stand for other texts, too; only the sets asked for stay, each once.
    sets = written(needed.join(asked.drop("id").hint("shuffle_hash"), ["n", "s1", "s2"]).select("key", "grams").dropDuplicates(["key"]), "sets")
    left = sets.select(F.col("key").alias("a"), F.col("grams").alias("x")).hint("merge")
    right = sets.select(F.col("key").alias("b"), F.col("grams").alias("y")).hint("merge")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_overlaps(rest_of), "a long, b long, both long, n long, m long, rest array<long>")


def _sizes_fit(n: Column, m: Column, percent: int) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _reaches(both: Column, sizes: Column, percent: int) -> Column:
    """Whether an overlap is enough for two sets of that size together."""
    return both * (100 + percent) >= sizes * percent


def _column_pairs(postings: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of the columns that aren't hot, as far as the bounds allow.

    After the shared n-grams counted, at most what follows the last of them in either set can be shared as well.
    """
    listed = F.sort_array(F.collect_list(F.struct("id", "n", "pos"))).alias("of")
    first = postings.where(F.col("docs") <= HOT).groupBy("gram").agg(listed).select(F.posexplode("of").alias("k", "p"), "of")
    pairs = first.select("p", F.explode(F.expr("slice(of, k + 2, size(of))")).alias("q")).where(_sizes_fit(F.col("p.n"), F.col("q.n"), percent))
    n, m, i, j = (F.first("p.n"), F.first("q.n"), F.max("p.pos"), F.max("q.pos"))
    most = F.count("*") + F.least(n - i, m - j) - 1
    return pairs.groupBy(F.col("p.id").alias("a"), F.col("q.id").alias("b")).agg(_reaches(most, n + m, percent).alias("may")).where("may").select("a", "b")


def _hot_pairs(star: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of documents compared with one leader, of which not both are linked with it, that may still link."""
    # Sizes that fit differ by at most 100 / percent, so by one band at most; the slack is for rounding.
    band = F.floor(F.log(100 / min(percent, 99) + 1e-6, F.col("m").cast("double"))).cast("int")
    far = ~_reaches(F.col("both"), F.col("n") + F.col("m"), percent)
    star = star.select(F.col("a").alias("leader"), F.col("b").alias("id"), "both", "m", "rest", far.alias("far"), band.alias("band"))
    fields = F.struct("id", "both", "m", "far")
    one = star.where("far").select("leader", fields.alias("p"), "rest", "band")
    two = star.select("leader", fields.alias("q"), "rest", "band")
    sizes = F.col("p.m") + F.col("q.m")
    once = (F.col("p.id") != F.col("q.id")) & (~F.col("q.far") | (F.col("p.id") < F.col("q.id")))
    fit = once & _sizes_fit(F.col("p.m"), F.col("q.m"), percent)
    inside = fit & _reaches(F.least("p.both", "q.both"), sizes, percent)
    near = one.select("leader", "p", F.explode(F.array(*[F.col("band") + k for k in (-1, 0, 1)])).alias("band"))
    by_leader = near.join(two.drop("rest").hint("merge"), ["leader", "band"]).where(inside).select("p", "q")
    ones, twos = (t.select("leader", c, F.explode("rest").alias("gram")) for t, c in ((one, "p"), (two, "q")))
    outside = ones.join(twos.hint("merge"), ["leader", "gram"]).where(fit).select("p", "q")
    return by_leader.unionByName(outside).select(F.least("p.id", "q.id").alias("a"), F.greatest("p.id", "q.id").alias("b"))


def jaccard_classes(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_shingles, component_id, set_id.

    component_id is the smallest doc_id reachable by links, the document's own included; set_id is the smallest doc_id
    with the same set. Words are
    `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; a text with fewer words than `width` has its whole sequence as its one
    shingle. Null and empty texts, and texts of white space, have no shingle: n_shingles 0, component_id their own
    doc_id, as set_id, no links. Rows that repeat a doc_id each give a row, with the class of their own text. A row with a null doc_id gets its set's class, if the
    set has a doc_id at all. An empty table gives an empty table; other columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    summary = written(texts.mapInArrow(_summary(width), "doc_id long, n long, s1 long, s2 long, chunk int, cells binary, counts binary"), "summary")
    sketch = summary.where("chunk is not null").select("chunk", "cells", "counts")
    rows = sketch.repartition(64, "chunk").mapInArrow(_added, "chunk int, levels binary").collect()  # at most 2^SKETCH_BITS bytes
    levels = np.zeros((1 << (SKETCH_BITS - CHUNK_BITS), 1 << CHUNK_BITS), np.uint8)
    for k, part in rows:
        levels[k] = np.frombuffer(part, np.uint8)
    known = spark.sparkContext.broadcast(levels.reshape(-1))

    own = summary.where("chunk is null").select("doc_id", "n", "s1", "s2")
    # A set goes by a number of its own, as its smallest doc_id may be that of other sets, too. Numbers follow the order of
    # doc_ids, so that a column's leader, its least number, is the earliest text, of which the others are likely copies.
    one = own.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("id")).where("id is not null")
    one = written(one.orderBy("id", "n", "s1", "s2").withColumn("key", F.monotonically_increasing_id()), "representatives")

    def prefixes(batches, known=known):
        return _prefixes(width, percent, known.value)(batches)

    # Rows without an id stand for no set; of copies in a task, only the first gives its n-grams.
    found = written(texts.where("id is not null").select("text").mapInArrow(prefixes, "gram long, s1 long, s2 long, n int, pos int"), "prefixes")
    shared = found.groupBy("gram").agg(F.count("*").alias("docs")).where("docs > 1").select("gram")
    rows = found.join(shared.hint("merge"), "gram").join(one.drop("id").hint("merge"), ["n", "s1", "s2"])
    rows = written(rows.select("gram", F.col("key").alias("id"), "n", "pos").distinct(), "shared")
    columns = rows.groupBy("gram").agg(F.count("*").alias("docs"), F.min("id").alias("leader")).where("docs > 1")
    postings = written(rows.join(columns.hint("merge"), "gram"), "postings")
    hot = postings.where(F.col("docs") > HOT)
    star = written(_counted(hot.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct(), texts, one, width, (percent, known)), "star")
    linked = _reaches(F.col("both"), F.col("n") + F.col("m"), percent)
    pairs = _column_pairs(postings, percent).unionByName(_hot_pairs(star, percent)).distinct()
    links = _counted(pairs, texts, one, width).where(linked).select("a", "b").unionByName(star.where(linked).select("a", "b"))
    classes = components(written(links.distinct(), "links")).withColumnRenamed("id", "key")
    named = written(one.join(classes.hint("merge"), "key", "left").select("n", "s1", "s2", "id", F.coalesce("component", "key").alias("component")), "classes")
    least = written(named.groupBy("component").agg(F.min("id").alias("component_id")), "components")
    per_set = written(named.join(least.hint("merge"), "component").select("n", "s1", "s2", F.col("id").alias("set_id"), "component_id"), "sets")
    return own.join(per_set.hint("merge"), ["n", "s1", "s2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("set_id", "doc_id").alias("set_id"))
