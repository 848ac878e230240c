"""Mixing sources to target weights, with DataFrame functions only.

Tokens are added up per source, target tokens follow from the weights, and their quotient is the source's repetition
rate. A document is emitted floor(rate) times, and once more with the probability of the rate's fraction, decided by a
hash of the seed and its doc_id, so that reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import unused, written

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
BROADCAST_SOURCES = 100_000


def words_in(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in the text, 0 for null: places where a word starts."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def source_rates(sized: DataFrame) -> DataFrame:
    """(source, source_size, target, rate) out of (source, size): one row per source.

    The sources in order of code points, null last, have the weights WEIGHTS over and over. They share SHARE of all
    sizes by weight, but none more than MOST of its own: target = min(MOST size, level weight), where the level makes
    the targets add up. Sources in the order of MOST size / weight fill up one after the other, so the level follows from
    running sums. The windows run over one row per source, after the documents have been added up.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("most", F.lit(MOST) * F.col("source_size"))
    fill = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    below = fill.rowsBetween(Window.unboundedPreceding, -1)
    above = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.lit(SHARE) * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(below), F.lit(0.0))) / F.sum("weight").over(above)
    per = per.withColumn("level", level)
    # The first source that the level doesn't fill sets it for those that follow.
    per = per.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") < F.col("most"), F.struct((F.col("most") / F.col("weight")).alias("at"), F.col("level").alias("level")))).over(everything)["level"])
    target = F.least(F.col("most"), F.coalesce(F.col("level") * F.col("weight"), F.col("most")))
    per = per.withColumn("target", target)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return per.select("source", "source_size", "target", rate.alias("rate"))


def uniform(seed: str, key: Column) -> Column:
    """A number in [0, 1) with 52 bits of the md5 of the seed and the key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def mix_plan(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """`docs` with the struct column `mix`: size, source_size, target, rate, copies.

    `docs` needs doc_id, text and source; its columns stay as they are, whatever their names, unless one is named `mix`,
    which is replaced. Null and empty texts have size 0 (their copies follow the rate like any others); a null source is
    a source of its own, the last. Rows that repeat a doc_id are drawn alike. An empty table gives an empty table.
    """
    sized = docs.select(F.col("source").cast("string").alias("source"), words_in(F.col("text")).alias("size"))
    rates, rate = written(source_rates(sized), "rates"), unused(docs, "rate")
    few = rates.count() <= BROADCAST_SOURCES
    rates = rates.select(F.struct("source", "source_size", "target", "rate").alias(rate))
    rates = F.broadcast(rates) if few else rates.hint("merge")
    joined = docs.join(rates, docs["source"].cast("string").eqNullSafe(F.col(f"{rate}.source")), "left")
    whole = F.floor(f"{rate}.rate")
    extra = (uniform(seed, docs["doc_id"]) < F.col(f"{rate}.rate") - whole).cast("int")
    columns = [docs[c] for c in docs.columns if c != "mix"]
    fields = F.struct(words_in(docs["text"]).alias("size"), F.col(f"{rate}.source_size").alias("source_size"), F.col(f"{rate}.target").alias("target"), F.col(f"{rate}.rate").alias("rate"), (whole + extra).cast("int").alias("copies"))
    return joined.select(*columns, fields.alias("mix"))


def mixed(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The mix itself: the rows of `docs`, each as often as it is taken; its columns only. See mix_plan for the cases."""
    plan = mix_plan(docs, seed)
    return plan.withColumn("mix", F.explode(F.array_repeat(F.lit(0), F.col("mix.copies")))).drop("mix")
