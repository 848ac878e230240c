"""Line dedup by a deletion-neighbourhood join, with DataFrame functions only.

Two lines within one edit (a character inserted, deleted or substituted) become equal when at most one character is
deleted from either. Every variant is emitted as a hashed key, equal keys meet, the edit distance is verified, and the
earliest line stays.

* Equal lines are one line first, known by a 128-bit hash and its earliest place (doc_id, line number).
* Of two lines within one edit, cut into four pieces, all pieces but one agree (but for three bytes). A first, coarse
  deletion neighbourhood leaves out a piece at a time; lines that share no such key with another line of nearly the
  same length can't have a partner and emit no variants. Those left go through this once more, in 32 pieces. This loses
  nothing.
* A variant is hashed in three parts: what stands before a piece of about sqrt(length) characters, the piece without
  one of its characters, and what stands after. So a line of n characters costs about n sqrt(n), not n squared.
* Lines that differ by a substitution lose the same place, so all lines with an equal key and place are one edit
  apart, and each only has to meet the earliest of them. A line that lost a character meets the one line that is equal
  to the rest. So no pairs are formed within a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import unused, written

LEAST_CHARS = 16
GRID, PIECES, FINE_PIECES = 8, 4, 32
_WHITE = " \t\n\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(_WHITE))


def _without_piece(line: Column, m: Column, i: Column, pieces: int) -> Column:
    """Hash of the line without its piece `i`, for a shorter line of `m` bytes.

    An edit that begins in the bytes from m i / pieces to m (i + 1) / pieces leaves those before alone, and ends within
    four bytes of these, as a character has at most four, so that it leaves the last m - m (i + 1) / pieces - 3 alone, too.
    """
    raw, before, after = line.cast("binary"), F.floor(m * i / pieces).cast("int"), F.floor(m * (i + 1) / pieces).cast("int")
    rest = F.greatest(m - after - 3, F.lit(0))
    return F.xxhash64(m, i, F.substring(raw, F.lit(1), before), F.substring(raw, F.octet_length(line) - rest + 1, rest))


def _grid(line: Column, least: int) -> list[tuple[Column, Column]]:
    """The lengths in bytes, rounded down to the grid, that the shorter of two near lines can have, and whether it can."""
    n = F.octet_length(line)
    floor = n - n % GRID
    return [(floor, n >= least), (floor - GRID, (n % GRID < 4) & (floor - GRID > least - GRID))]


def _coarse_keys(line: Column, least: int) -> Column:
    return F.array_compact(F.array(*[F.when(may, _without_piece(line, m, F.lit(i), PIECES)) for m, may in _grid(line, least) for i in range(PIECES)]))


def _fine_keys(line: Column, least: int) -> Column:
    """The same with smaller pieces, and for each number of characters that the shorter line can have."""
    pieces = F.sequence(F.lit(0), F.lit(FINE_PIECES - 1))

    def keys(m: Column, chars: Column) -> Column:
        return F.transform(pieces, lambda i: F.xxhash64(chars, _without_piece(line, m, i, FINE_PIECES)))

    n = F.length(line)
    return F.flatten(F.array_compact(F.array(*[F.when(may, keys(m, chars)) for m, may in _grid(line, least) for chars in (n, n - 1)])))


def _alike(keys: DataFrame) -> DataFrame:
    """The lines (first) that share a key with another line."""
    twice = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    return keys.join(twice.hint("merge"), "key", "left_semi").select("first").distinct()


def _variants(lines: DataFrame) -> DataFrame:
    """(key, place, first): each line with one character less, and the whole line with place -1."""
    n = F.length("line")
    whole = F.explode(F.array(F.lit(True), F.lit(False))).alias("whole")
    rows = lines.select("first", "line", n.alias("n"), whole).withColumn("m", F.col("n") - F.when(F.col("whole"), 0).otherwise(1))
    rows = rows.withColumn("b", F.greatest(F.lit(32), F.ceil(F.sqrt("m")).cast("int")))
    last = F.greatest(F.ceil(F.col("m") / F.col("b")).cast("int") - 1, F.lit(0))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), last)).alias("p"))
    skip = F.when(F.col("whole"), 0).otherwise(1)
    start = F.col("p") * F.col("b")
    before = F.xxhash64(F.substring("line", F.lit(1), start))
    after = F.xxhash64(F.substring(F.col("line"), start + F.col("b") + skip + 1, F.col("n")))
    rows = rows.select("first", "whole", "m", "p", F.substring(F.col("line"), start + 1, F.col("b") + skip).alias("piece"), before.alias("before"), after.alias("after"))
    places = F.when(F.col("whole"), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.length("piece") - 1))
    rows = rows.select("*", F.explode(places).alias("place"))
    left = F.when(F.col("whole"), F.col("piece")).otherwise(F.concat(F.substring(F.col("piece"), F.lit(1), F.col("place")), F.substring(F.col("piece"), F.col("place") + 2, F.length("piece"))))
    return rows.select(F.xxhash64("m", "p", "before", left, "after").alias("key"), "place", "first")


def _partners(variants: DataFrame) -> DataFrame:
    """(first, earlier): lines whose keys are equal, with the earliest such line."""
    same, key = Window.partitionBy("key", "place"), Window.partitionBy("key")
    whole = F.col("place") == -1
    met = variants.select(
        "first",
        F.when(~whole, F.min("first").over(same)).alias("substituted"),
        F.when(~whole, F.min(F.when(whole, F.col("first"))).over(key)).alias("shorter"),
        F.when(whole, F.min(F.when(~whole, F.col("first"))).over(key)).alias("longer"),
    )
    return met.select("first", F.explode(F.array_compact(F.array("substituted", "shorter", "longer"))).alias("earlier")).where(F.col("earlier") < F.col("first")).distinct()


def dedup_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """`docs` without repeated lines, and with the struct column `lines` (total, dropped).

    Lines are the parts of the text between newlines, compared without the white space around them. Earlier means a
    smaller (doc_id, line number). A line is dropped if an equal line stands earlier, or if both have at least
    `least_chars` characters and a line within one edit stands earlier, whether or not that one is itself dropped.
    Blank lines always stay. A document whose lines are all dropped stays with an empty text. A null text becomes empty.
    A row with a null doc_id keeps all its lines, and these count for no other. Rows that repeat a doc_id are treated
    alike. An empty table gives an empty table. The columns of `docs` stay; one that is named `lines` is replaced.
    """
    texts = docs.where("doc_id is not null").select("doc_id", F.posexplode(_lines(F.col("text"))).alias("line_no", "raw"))
    every = texts.select("doc_id", "line_no", _trimmed(F.col("raw")).alias("line")).where("line <> ''").withColumn("h1", F.xxhash64("line"))
    seen = written(every.select("doc_id", "line_no", "h1", F.xxhash64(F.lit("second"), "line").alias("h2"), _coarse_keys(F.col("line"), least_chars).alias("coarse")), "lines")
    place = F.struct("doc_id", "line_no", "h1")
    distinct = written(seen.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n"), F.first("coarse").alias("coarse")), "distinct")

    alike = written(_alike(distinct.select("first", F.explode("coarse").alias("key"))).select("first.*"), "alike")
    near_docs = docs.select("doc_id", "text").join(alike.select("doc_id").distinct().hint("shuffle_hash"), "doc_id", "left_semi")
    near_lines = near_docs.select("doc_id", F.posexplode(_lines(F.col("text"))).alias("line_no", "raw")).select("doc_id", "line_no", _trimmed(F.col("raw")).alias("line")).where("line <> ''").withColumn("h1", F.xxhash64("line"))
    some = written(near_lines.join(alike.hint("merge"), ["doc_id", "line_no", "h1"]).where(F.length("line") >= least_chars).distinct().select(place.alias("first"), "line"), "near")
    # A line has each of its keys once.
    still = _alike(some.select("first", F.explode(F.array_distinct(_fine_keys(F.col("line"), least_chars))).alias("key")))
    some = written(some.join(still.hint("merge"), "first", "left_semi"), "nearer")
    pairs = written(_partners(_variants(some)), "pairs")
    checked = pairs.join(some.hint("merge"), "first").join(some.select(F.col("first").alias("earlier"), F.col("line").alias("other")).hint("merge"), "earlier")
    near = checked.where(F.levenshtein("line", "other", 1) >= 0).select("first").distinct()

    gone = distinct.join(near.withColumn("near", F.lit(True)).hint("merge"), "first", "left").where("near or n > 1")
    gone = written(gone.select("h1", "h2", F.when(F.col("near").isNull(), F.col("first")).alias("stays")), "gone")
    doc, gone_in = unused(docs, "doc"), unused(docs, "drops")
    drops = seen.join(gone.hint("merge"), ["h1", "h2"]).where(F.col("stays").isNull() | (F.col("stays") != place))
    drops = written(drops.groupBy(F.col("doc_id").alias(doc)).agg(F.collect_set(F.struct("line_no", "h1")).alias(gone_in)), "drops")
    joined = docs.join(drops.hint("shuffle_hash"), docs["doc_id"] == F.col(doc), "left")
    lines = _lines(docs["text"])

    def remaining(x: Column) -> Column:
        """The lines but for those dropped, each looked up once, so that the cost grows with the lines alone."""
        at = lambda k: F.get(x["lines"], k)
        # The hash tells apart rows that repeat a doc_id with another text.
        there = F.filter(x["drops"], lambda d: F.xxhash64(_trimmed(at(d["line_no"]))).eqNullSafe(d["h1"]))
        left = F.array_except(F.sequence(F.lit(0), F.size(x["lines"]) - 1), F.transform(there, lambda d: d["line_no"]))
        return F.transform(left, at)

    # Bound to a name, as an expression inside of a lambda is computed for each element.
    kept = F.when(F.col(gone_in).isNull(), lines).otherwise(F.transform(F.array(F.struct(lines.alias("lines"), F.col(gone_in).alias("drops"))), remaining)[0])
    out = [F.array_join(kept, "\n").alias("text") if c == "text" else docs[c] for c in docs.columns if c != "lines"]
    return joined.select(*out, F.struct(F.size(lines).alias("total"), (F.size(lines) - F.size(kept)).alias("dropped")).alias("lines"))
