"""Forward searches: the first later bar that meets an event's condition, without a join of all with all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import stored
from .bars import KEY


def forward(events: DataFrame, bars: DataFrame, lookahead: int, at: str, keep: dict[str, Column], condition: Column) -> DataFrame:
    """Events (with a unique `event`), joined to the bars from `at` + 1 to `at` + lookahead that meet the condition, and aggregated.

    The bars' columns are prefixed with b_. Both sides are dealt by series and bucket of `lookahead` bars; an event asks
    in its own bucket and the next, so the join is an equi-join and a series is split over many tasks.
    """
    bucket = F.floor(F.col("bar_index") / lookahead)
    later = bars.select(*KEY, bucket.alias("_bucket"), *[F.col(c).alias(f"b_{c}") for c in ("bar_index", "ts_ny", "open", "high", "low", "close", "is_ghost")])
    own = F.floor(F.col(at) / lookahead)
    asked = events.withColumn("_bucket", F.explode(F.array(own, own + 1)))
    # Asked comes from explode, so its size is not known: no broadcast.
    joined = asked.join(later.hint("merge"), [*KEY, "_bucket"]).where((F.col("b_bar_index") > F.col(at)) & (F.col("b_bar_index") <= F.col(at) + lookahead) & condition)
    return joined.groupBy("event").agg(*[c.alias(k) for k, c in keep.items()])


def first_later(events: DataFrame, values: DataFrame, width: int = 64) -> DataFrame:
    """Events (unique event, symbol, tf, side, at, x, strict, and any other columns) with `found`: the first bar after `at` whose v is at most x, or below it where `strict`; null without one.

    `values` holds symbol, tf, side, bar_index and v. However far off that bar is, an event meets few rows: bars are
    gathered in blocks of `width`, blocks in blocks of blocks, each with its least v, as many levels as it takes until a
    series has no more than `width` of the topmost. An event asks the rest of its own block, then the rest of its block of
    blocks, and so on, and goes down again from the first block that holds a hit. Every step is an equi-join on series,
    level and block with one table of blocks, so that an event meets at most `width` rows of each level; only its name, x and strict go along.
    """
    # Both are used once for each level.
    events, values = stored(events, "events"), stored(values.select(*KEY, "side", "bar_index", "v"), "values")
    largest, levels = values.agg(F.max("bar_index")).first()[0] or 0, 1
    while width ** (levels + 1) <= largest:
        levels += 1
    up = lambda place, level: F.floor(place / width) if level < levels else F.lit(0).cast("long")
    block = lambda column, level: F.floor(F.col(column) / width**level)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("n_level"), block("bar_index", k).alias("n_node"), up(block("bar_index", k), k).alias("n_parent")) for k in range(levels + 1)])).alias("n")
    names = [f"n_{c}" for c in (*KEY, "side")]
    nodes = values.select(*[F.col(c).alias(f"n_{c}") for c in (*KEY, "side")], "v", each).select(*names, "v", "n.*").groupBy(*names, "n_level", "n_parent", "n_node").agg(F.min("v").alias("v"))
    nodes = stored(nodes, "nodes").hint("merge")
    same = lambda level, parent: [F.col(c) == F.col(f"n_{c}") for c in (*KEY, "side")] + [level == F.col("n_level"), parent == F.col("n_parent"), (F.col("v") < F.col("x")) | ((F.col("v") == F.col("x")) & ~F.col("strict"))]
    own = ["event", *KEY, "side", "x", "strict"]
    asks = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), block("at", k).alias("own"), up(block("at", k), k).alias("parent")) for k in range(levels + 1)])).alias("a")
    asked = events.select(*own, asks).select(*own, "a.*")
    met = asked.join(nodes, [*same(F.col("level"), F.col("parent")), F.col("n_node") > F.col("own")])
    near = met.groupBy(*own).agg(F.min(F.struct("level", F.col("n_node").alias("found"))).alias("near")).select(*own, "near.*")
    for level in range(levels, 0, -1):
        # Events that are on a lower level already are done with this step.
        there, here = near.where(F.col("level") < level), near.where(F.col("level") == level)
        step = here.withColumn("ask", F.lit(level - 1))
        down = step.join(nodes, same(F.col("ask"), F.col("found"))).groupBy(*own).agg(F.min("n_node").alias("found")).withColumn("level", F.lit(level - 1))
        near = stored(there.unionByName(down.select(there.columns)), "near")
    return events.join(near.select("event", F.col("found").cast("int").alias("found")).hint("merge"), "event", "left").select(*events.columns, "found")


def nearest_bars(events: DataFrame, bars: DataFrame, time: str = "time", most: int = 900) -> DataFrame:
    """Adds to events (symbol, tf and a time) nearest, the ts_ny of the nearest bar of their series at most `most` seconds off, the earlier one of two, and seconds; both null without one.

    Times meet in buckets of `most` seconds, an event in its own and the two beside it, so that a series is split over many tasks. Each row of events is one of the result, repeated ones too.
    """
    seconds = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    rows = events.withColumn("_event", F.struct(*events.columns)).groupBy("_event").agg(F.count("*").alias("_copies"))
    asked = rows.select("_event", "_copies", *[F.col(f"_event.{c}").alias(c) for c in KEY], seconds(f"_event.{time}").alias("_at"))
    asked = asked.withColumn("_bucket", F.explode(F.array(*[F.floor(F.col("_at") / most) + k for k in (-1, 0, 1)])))
    there = bars.select(*KEY, F.col("ts_ny").alias("_bar"), F.floor(seconds("ts_ny") / most).alias("_bucket")).hint("merge")
    off = F.abs(seconds("_bar") - F.col("_at"))
    met = asked.join(there, [*KEY, "_bucket"], "left")
    best = met.groupBy("_event", "_copies").agg(F.min(F.when(off <= most, F.struct(off.alias("off"), "_bar"))).alias("_best"))
    out = best.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies")))
    return out.select("_event.*", F.col("_best._bar").alias("nearest"), F.col("_best.off").alias("seconds"))
