"""Interaction of quality filters: what each removes in every order of them, from counts per combination of failures.

A document is reduced to a mask of the filters that it fails; what any order of the filters does to it follows from the
mask alone. So documents are counted per part and mask, and only these cells, 32 for each part at most, are folded over
the orders: one `transform` over the orders, in it one `aggregate` over an order's steps, both in SQL. The orders are a
literal array of 120 strings, which goes to the workers with the plan. Each cell gives one struct for each order and
step, weighted with the cell's counts, and the cells of a part are merged by elementwise sums.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
WHITE = r"[\x20\x09-\x0D]+"
_STEP = "struct<filter_order:string,step:int,kept:bigint,removed:bigint,redundant:bigint,unique_fails:bigint,good_lost:bigint,toxic_lost:bigint>"
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def _text_mask(text: Column) -> Column:
    """The failures that a text shows by itself, as bits: A 1, B 2, C 4, D 8."""
    words = F.array_remove(F.split(text, WHITE), "")
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    capitals = F.regexp_count(text, F.lit("[A-Z]")).cast("long")
    fails = (n < 100, 100 * distinct < 80 * n, 100 * capitals > 10 * F.length(text).cast("long"), text.rlike(r"[#$%&*|]"))
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): the documents of each part by the filters they fail, and how many of them the labels call good and toxic.

    Filter E looks for the same text at a smaller doc_id anywhere. Copies share all other failures, so they are added up
    per text and part before they meet, and only the counts of the rows with the smallest doc_id are kept apart.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), _text_mask(text).alias("mask"), F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)).alias("sha"))
    rows = rows.groupBy("id", "part", "mask", "sha").agg(F.count("*").alias("n"))
    # Rows without an id have no label; they are dealt by their text, so that they aren't one key.
    salt = F.when(F.col("id").isNull(), F.pmod(F.xxhash64("sha"), F.lit(1 << 20)) + 1).otherwise(0)
    rows = rows.withColumns({"key": F.coalesce("id", F.lit(0).cast("long")), "salt": salt.cast("long")})
    flag = lambda c: F.max((F.col(c) == 1).cast("long"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("key")).agg(flag("quality").alias("good"), flag("toxic").alias("bad")).withColumn("salt", F.lit(0).cast("long"))
    rows = rows.join(marks.hint("merge"), ["key", "salt"], "left")
    good, bad = (F.col("n") * F.coalesce(c, F.lit(0).cast("long")) for c in ("good", "bad"))
    rows = rows.select("sha", "part", "mask", F.struct(F.col("id").isNull().alias("last"), "id", "n", good.alias("good"), bad.alias("bad")).alias("row"))
    texts = rows.groupBy("sha", "part", "mask").agg(F.min("row").alias("first"), *[F.sum(f"row.{c}").alias(c) for c in ("n", "good", "bad")])
    # At most one row for each part here, however many copies there are.
    least = F.min(F.struct("first.last", "first.id")).over(Window.partitionBy("sha"))
    texts = texts.withColumn("fresh", F.struct("first.last", "first.id") == least)
    of = lambda c: F.when(F.col("fresh"), F.col(f"first.{c}")).otherwise(0).cast("long")
    both = F.array(
        F.struct(F.col("mask"), *[of(c).alias(c) for c in ("n", "good", "bad")]),
        F.struct((F.col("mask") + 16).alias("mask"), *[(F.col(c) - of(c)).alias(c) for c in ("n", "good", "bad")]),
    )
    counted = texts.select("part", F.explode(both).alias("c")).where("c.n > 0").groupBy("part", "c.mask").agg(*[F.sum(f"c.{c}").alias(c) for c in ("n", "good", "bad")])
    return counted.withColumnRenamed("bad", "toxic")


def _folded(cell: str) -> str:
    """SQL: the structs of all orders and steps, in turn, for the struct `cell` (mask, n, good, toxic)."""
    bit = "shiftleft(1, ascii(substring(o, k, 1)) - ascii('A'))"
    fails = f"({cell}.mask & {bit}) != 0"
    here = f"(NOT s.gone AND {fails})"
    step = f"""named_struct('filter_order', o, 'step', k,
        'kept', if(s.gone OR {fails}, 0L, {cell}.n), 'removed', if({here}, {cell}.n, 0L), 'redundant', if(s.gone AND {fails}, {cell}.n, 0L),
        'unique_fails', if({cell}.mask = {bit}, {cell}.n, 0L), 'good_lost', if({here}, {cell}.good, 0L), 'toxic_lost', if({here}, {cell}.toxic, 0L))"""
    orders = "array(" + ", ".join(f"'{o}'" for o in ORDERS) + ")"
    return f"""flatten(transform({orders}, o -> aggregate(array(1, 2, 3, 4, 5), named_struct('gone', false, 'steps', cast(array() AS array<{_STEP}>)),
        (s, k) -> named_struct('gone', s.gone OR {fails}, 'steps', concat(s.steps, array({step}))), s -> s.steps)))"""


def filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, and the counts kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley: 600 rows for each part.

    `docs` needs doc_id, text and lang, `labels` doc_id, quality and toxic; other columns aren't read. A null text counts
    as empty (it fails A only, and E if an empty text has a smaller doc_id), a null lang as the part ''. A null doc_id is
    larger than all others and has no label; rows that repeat a doc_id and text count each, and none is a copy of the
    other. A document is good (toxic) if any of its labels says so. An empty table gives an empty table.
    """
    grouped = cells(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    zero = _folded("named_struct('mask', 0, 'n', 0L, 'good', 0L, 'toxic', 0L)")
    added = ", ".join(f"'{m}', x.{m} + y.{m}" for m in MEASURES)
    merged = f"aggregate(cells, {zero}, (done, c) -> zip_with(done, {_folded('c')}, (x, y) -> named_struct('filter_order', x.filter_order, 'step', x.step, {added})))"
    rows = grouped.select("part", F.explode(F.expr(merged)).alias("r")).select("part", "r.*")
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    return rows.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", letter)))
