"""Evaluation of detections (primitive, symbol, tf, id, direction, session, forex_day): counts, comparisons, funnels, scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import iso_week
from ..functions.measures import f1, percent, precision, recall, session_from_id
from ..operators.sweeps import in_chunks, of_chunks
from ..sources.store import stored

SESSIONS = ("asia", "lokz", "nyokz", "other")
# Composites that are expected to be rare on long timeframes, and which primitive builds on which.
EXPECTED_SPARSE = ("mss", "order_block", "ote")
EDGES = (("mss", "displacement"), ("mss", "swing"), ("order_block", "mss"), ("ote", "mss"), ("sweep", "level"))


def counts(dets: DataFrame, *by: str) -> DataFrame:
    return dets.groupBy(*by).agg(F.count("*").alias("n"))


def per_day_stats(dets: DataFrame, *by: str) -> DataFrame:
    """Mean and population deviation of the detections on days that have some."""
    days = dets.groupBy(*by, "forex_day").agg(F.count("*").alias("n"))
    return days.groupBy(*by).agg(F.count("*").alias("days"), F.round(F.avg("n"), 2).alias("mean_per_day"), F.round(F.stddev_pop("n"), 2).alias("std_per_day"))


def session_distribution(dets: DataFrame, *by: str) -> DataFrame:
    """Count and percentage of the four sessions; what rounding leaves goes to the largest, the first in order on ties."""
    spark = dets.sparkSession
    four = spark.createDataFrame(list(enumerate(SESSIONS)), "place int, session string")
    have = dets.groupBy(*by, "session").agg(F.count("*").alias("n"))
    spine = have.select(*by).distinct().join(F.broadcast(four), F.lit(True))
    all_ = spine.join(have, [*by, "session"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return _shares(all_, "place", *by).select(*by, "session", "n", "pct")


def direction_distribution(dets: DataFrame, *by: str) -> DataFrame:
    """Count and percentage of bullish and bearish, present or not, and of the other directions that occur, in order of name; rounding as in session_distribution."""
    two = dets.sparkSession.createDataFrame([(0, "bullish"), (1, "bearish")], "place int, direction string")
    have = dets.groupBy(*by, "direction").agg(F.count("*").alias("n"))
    spine = have.select(*by).distinct().join(F.broadcast(two), F.lit(True))
    all_ = spine.join(have, [*by, "direction"], "full_outer").withColumns({"n": F.coalesce("n", F.lit(0)), "place": F.struct(F.coalesce("place", F.lit(2)), "direction")})
    return _shares(all_, "place", *by).select(*by, "direction", "n", "pct")


def _shares(counted: DataFrame, place: str, *by: str) -> DataFrame:
    """Adds pct, the share of n; what rounding leaves goes to the largest, the first by `place` on ties."""
    w = Window.partitionBy(*by)
    out = counted.withColumn("pct", percent(F.col("n"), F.sum("n").over(w)))
    rest = F.round(100.0 - F.sum("pct").over(w), 1)
    first = F.row_number().over(w.orderBy(F.desc("n"), place))
    fixed = F.when((first == 1) & (F.abs(rest) >= 0.01), F.round(F.col("pct") + rest, 1)).otherwise(F.col("pct"))
    return out.withColumn("_fixed", fixed).drop("pct").withColumnRenamed("_fixed", "pct")


def weekly_stats(dets: DataFrame, *by: str) -> DataFrame:
    """Counts by week over all weeks of the data, missing ones as 0: mean, sample deviation, extremes, variation, zero weeks."""
    week = dets.withColumn("week", F.to_date(F.date_trunc("week", "forex_day")))
    have = week.groupBy(*by, "week").agg(F.count("*").alias("n"))
    spine = have.select(*by).distinct().join(F.broadcast(week.select("week").distinct()), F.lit(True))
    all_ = spine.join(have, [*by, "week"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    out = all_.groupBy(*by).agg(F.count("*").alias("weeks"), F.avg("n").alias("mean"), F.stddev_samp("n").alias("std"), F.min("n").alias("least"), F.max("n").alias("most"), F.min_by("week", F.struct("n", "week")).alias("least_week"), F.count_if(F.col("n") == 0).alias("zero_weeks"))
    return out.withColumns({"cv": F.when(F.col("mean") > 0, F.round(F.col("std") / F.col("mean"), 4)), "mean": F.round("mean", 4), "std": F.round("std", 4)})


def compared(a: DataFrame, b: DataFrame, *by: str) -> DataFrame:
    """Agreement of two runs on detection ids: rows of each, and distinct ids in both, only A and only B."""
    rows = [x.groupBy(*by).agg(F.count("*").alias(n)) for x, n in ((a, "rows_a"), (b, "rows_b"))]
    ids = [x.select(*by, "id").distinct().withColumn(n, F.lit(True)) for x, n in ((a, "in_a"), (b, "in_b"))]
    both = ids[0].join(ids[1], [*by, "id"], "full_outer").groupBy(*by).agg(F.count_if(F.col("in_a") & F.col("in_b")).alias("agreed"), F.count_if(F.col("in_b").isNull()).alias("only_a"), F.count_if(F.col("in_a").isNull()).alias("only_b"))
    out = both.join(rows[0], [*by], "left").join(rows[1], [*by], "left")
    total = F.col("agreed") + F.col("only_a") + F.col("only_b")
    return out.select(*by, F.coalesce("rows_a", F.lit(0)).alias("rows_a"), F.coalesce("rows_b", F.lit(0)).alias("rows_b"), "agreed", "only_a", "only_b", F.when(total == 0, 1.0).otherwise(F.round(F.col("agreed") / total, 4)).alias("agreement"))


def funnel(dets: DataFrame) -> DataFrame:
    """Detections of each primitive against those of the primitives it builds on; without any of these the rate is 0."""
    spark = dets.sparkSession
    n = dets.groupBy("symbol", "tf", "primitive").agg(F.count("*").alias("n"))
    edges = F.broadcast(spark.createDataFrame(list(EDGES), "primitive string, upstream string"))
    up = n.select("symbol", "tf", F.col("primitive").alias("upstream"), F.col("n").alias("n_upstream"))
    return n.join(edges, "primitive").join(up.hint("merge"), ["symbol", "tf", "upstream"], "left").select("symbol", "tf", "primitive", "upstream", "n", F.coalesce("n_upstream", F.lit(0)).alias("n_upstream"), F.coalesce(F.round(F.col("n") / F.col("n_upstream"), 4), F.lit(0.0)).alias("rate"))


def scores(labels: DataFrame, *by: str) -> DataFrame:
    """Precision, recall and F1 of labels (label: CORRECT, NOISE, BORDERLINE, MISSED)."""
    n: dict[str, Column] = {k: F.count_if(F.upper("label") == k) for k in ("CORRECT", "NOISE", "BORDERLINE", "MISSED")}
    out = labels.groupBy(*by).agg(*[v.alias(k.lower()) for k, v in n.items()])
    out = out.withColumns({"precision": precision(F.col("correct"), F.col("noise")), "recall": recall(F.col("correct"), F.col("missed"))})
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def label_scores(labels: DataFrame, variants: DataFrame | None = None, *by: str) -> DataFrame:
    """Scores of labels (detection_id, primitive, label) at four levels: over all, by primitive, by primitive and session
    (from the id's time; all of SESSIONS, those without labels with count 0), and by primitive and variant.

    `variants` (detection_id, variant) gives the variant of a detection; labels without one count at the other levels only.
    All levels come from one pass of grouping sets.
    """
    named = labels.withColumn("session", session_from_id(F.col("detection_id")))
    if variants is None:
        named = named.withColumn("variant", F.lit(None).cast("string"))
    else:
        one = variants.groupBy("detection_id").agg(F.min("variant").alias("variant"))
        named = named.join(one.hint("merge"), "detection_id", "left")
    key = [F.col(c) for c in by]
    sets = [key, [*key, F.col("primitive")], [*key, F.col("primitive"), F.col("session")], [*key, F.col("primitive"), F.col("variant")]]
    columns = [*key, F.col("primitive"), F.col("session"), F.col("variant")]
    kinds = [F.count_if(F.upper("label") == k).alias(k.lower()) for k in ("CORRECT", "NOISE", "BORDERLINE", "MISSED")]
    has = lambda c: F.grouping(c) == 0
    level = F.when(has("session"), "session").when(has("variant"), "variant").when(has("primitive"), "primitive").otherwise("aggregate")
    out = named.groupingSets(sets, *columns).agg(F.count("*").alias("label_count"), *kinds, level.alias("level")).where("level <> 'variant' or variant is not null")
    empty = out.where("level = 'primitive'").select(*by, "primitive", F.explode(F.array(*map(F.lit, SESSIONS))).alias("session")).withColumn("level", F.lit("session"))
    join = [*by, "primitive", "session", "level"]
    spine = empty.join(out.where("level = 'session'").drop("variant").hint("merge"), join, "left").withColumn("variant", F.lit(None).cast("string"))
    out = out.where("level <> 'session'").unionByName(spine).fillna(0, ["label_count", "correct", "noise", "borderline", "missed"])
    out = out.withColumns({"precision": precision(F.col("correct"), F.col("noise")), "recall": recall(F.col("correct"), F.col("missed"))})
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def outliers(weekly: DataFrame, stats: DataFrame, *by: str, deviations: float = 2.0) -> DataFrame:
    """Weeks more than so many deviations from the mean."""
    return weekly.join(stats, [*by]).where(F.abs(F.col("n") - F.col("mean")) > deviations * F.col("std"))


def gap_matrix(gaps: DataFrame, thresholds: tuple[float, ...], *by: str) -> DataFrame:
    """Per threshold: gaps at least that large, of either direction, and the upper median of their sizes."""
    each = gaps.select(*by, "direction", "gap_pips", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")).where("gap_pips >= threshold")
    sizes = F.sort_array(F.collect_list("gap_pips"))
    return each.groupBy(*by, "threshold").agg(F.count("*").alias("n"), F.count_if(F.col("direction") == "bullish").alias("bull"), F.count_if(F.col("direction") == "bearish").alias("bear"), F.element_at(sizes, (F.floor(F.count("*") / 2) + 1).cast("int")).alias("median"))


def swing_matrix(swings: DataFrame, thresholds: tuple[int, ...], *by: str) -> DataFrame:
    """Per least strength: pivots, highs, lows and mean strength."""
    each = swings.select(*by, "side", "strength", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")).where("strength >= threshold")
    return each.groupBy(*by, "threshold").agg(F.count("*").alias("n"), F.count_if(F.col("side") == "high").alias("highs"), F.count_if(F.col("side") == "low").alias("lows"), F.round(F.avg("strength"), 4).alias("mean_strength"))


def walk_forward(dets: DataFrame, windows: DataFrame, most_pct: float, *by: str) -> DataFrame:
    """Detections of each window's train and test days (window_index, train_start, train_end, test_start, test_end; ends included).

    Days are counted first, so the join with the windows sees one row for each day. Windows without detections in either
    part are left out; the change is null where the train part has none, which passes.
    """
    days = dets.groupBy(*by, "forex_day").agg(F.count("*").alias("n"))
    met = days.join(F.broadcast(windows), F.col("forex_day").between(F.col("train_start"), F.col("test_end")))
    inside = lambda part: F.coalesce(F.sum(F.when(F.col("forex_day").between(F.col(f"{part}_start"), F.col(f"{part}_end")), F.col("n"))), F.lit(0))
    out = met.groupBy(*by, "window_index").agg(inside("train").alias("train_metric"), inside("test").alias("test_metric"))
    change = F.when(F.col("train_metric") != 0, F.round((F.col("test_metric") - F.col("train_metric")) * 100.0 / F.nullif("train_metric", F.lit(0)), 2))
    return out.withColumns({"delta": F.col("test_metric") - F.col("train_metric"), "delta_pct": change}).withColumn("passed", F.coalesce(F.abs("delta_pct") <= most_pct, F.lit(True)))


def fresh_walk_forward(bars: DataFrame, windows: DataFrame, detect: Callable[[DataFrame], DataFrame], most_pct: float, metric: Column | None = None) -> DataFrame:
    """Walk-forward with a run of its own for each window's train and test part, so that ATR, pivots and states start anew at their edges.

    `windows` as for walk_forward; `detect` takes bars (symbol, tf, ts_ny, tags, prices) and gives detections with symbol;
    `metric` is an aggregate over these, their number if it is None. A window counts for the symbols that have bars in both
    parts; without detections its metric is 0. The change is null where the train part has 0, which passes. Bars meet
    windows day by day, so that a window's length doesn't matter, and a bar is copied once for each window that it lies in.
    """
    days = [windows.select("window_index", F.lit(n).alias("part"), F.explode(F.sequence(f"{n}_start", f"{n}_end")).alias("forex_day")) for n in ("train", "test")]
    # Days come from explode, so their number is not known: no broadcast.
    met = bars.join(days[0].unionByName(days[1]).hint("merge"), "forex_day")
    chunked = stored(in_chunks(met, F.concat_ws(":", F.col("window_index").cast("string"), "part")).drop("window_index", "part"), "windows")
    there = chunked.select("symbol").distinct()
    found = detect(chunked).groupBy("symbol").agg((F.count("*") if metric is None else metric).cast("double").alias("m"))
    each = of_chunks(there.join(found.hint("merge"), "symbol", "left"))
    each = each.withColumns({"window_index": F.split_part("chunk", F.lit(":"), F.lit(1)).cast("int"), "part": F.split_part("chunk", F.lit(":"), F.lit(2)), "m": F.coalesce("m", F.lit(0.0))})
    of = lambda name: F.max(F.when(F.col("part") == name, F.col("m")))
    out = each.groupBy("symbol", "window_index").agg(of("train").alias("train_metric"), of("test").alias("test_metric")).where("train_metric is not null and test_metric is not null")
    delta = F.col("test_metric") - F.col("train_metric")
    change = F.when(F.col("train_metric") != 0, F.round(delta * 100.0 / F.nullif("train_metric", F.lit(0.0)), 2))
    return out.withColumns({"delta": delta, "delta_pct": change}).withColumn("passed", F.coalesce(F.abs("delta_pct") <= most_pct, F.lit(True)))


def rolling_windows(days: DataFrame, train: int, test: int, step: int) -> DataFrame:
    """Windows of `train` and then `test` days, every `step` days, over the range of `days` (forex_day); one row for each window."""
    ends = days.agg(F.min("forex_day").alias("a"), F.max("forex_day").alias("b"))
    start = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.datediff("b", "a") - train - test + 1), F.lit(step))).alias("k")
    w = ends.where("a is not null").select("a", start)
    day = lambda n: F.date_add("a", F.col("k") + n)
    return w.select((F.col("k") / step).cast("int").alias("window_index"), day(0).alias("train_start"), day(train - 1).alias("train_end"), day(train).alias("test_start"), day(train + test - 1).alias("test_end"))


def month_windows(days: DataFrame, train: int, test: int, step: int) -> DataFrame:
    """Windows of `train` and then `test` calendar months, every `step` months from the first month of `days` (forex_day); a test part never ends after the last month."""
    ends = days.agg(F.trunc(F.min("forex_day"), "month").alias("a"), F.trunc(F.max("forex_day"), "month").alias("b")).where("a is not null")
    room = F.months_between("b", "a").cast("int") + 1 - train - test
    w = ends.where(room >= 0).select("a", F.explode(F.sequence(F.lit(0), room, F.lit(step))).alias("k"))
    month = lambda n: F.add_months("a", F.col("k") + n)
    return w.select((F.col("k") / step).cast("int").alias("window_index"), month(0).alias("train_start"), F.date_sub(month(train), 1).alias("train_end"), month(train).alias("test_start"), F.date_sub(month(train + test), 1).alias("test_end"))


def walk_forward_summary(results: DataFrame, *by: str) -> DataFrame:
    """Windows, passed and failed ones, mean and population deviation of the test metric, mean change, the window with the least test metric, and the verdict."""
    out = results.groupBy(*by).agg(
        F.count("*").alias("windows"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.round(F.avg("test_metric"), 6).alias("mean_test_metric"),
        F.round(F.stddev_pop("test_metric"), 6).alias("std_test_metric"), F.round(F.avg("delta"), 6).alias("mean_delta"), F.min_by("window_index", F.struct("test_metric", "window_index")).alias("worst_window"),
    )
    return out.withColumn("verdict", F.when(F.col("failed") == 0, "STABLE").when(F.col("passed") > F.col("failed"), "CONDITIONALLY_STABLE").otherwise("UNSTABLE"))


def divergence(a: DataFrame, b: DataFrame, *by: str) -> DataFrame:
    """Each detection id of two runs once: Both, A only or B only."""
    both = a.select(*by, "id", F.lit(1).alias("run")).unionByName(b.select(*by, "id", F.lit(2).alias("run")))
    runs = both.groupBy(*by, "id").agg(F.min("run").alias("least"), F.max("run").alias("most"))
    return runs.select(*by, "id", F.when(F.col("least") != F.col("most"), "Both").when(F.col("least") == 1, "A only").otherwise("B only").alias("status"))


def compared_all(runs: DataFrame, *by: str) -> DataFrame:
    """Agreement of all pairs of runs (run_id, id): ids are first counted by the set of runs that have them, so that pairs are made of such sets, not of detections."""
    sets = runs.groupBy(*by, "id").agg(F.array_sort(F.collect_set("run_id")).alias("runs")).groupBy(*by, "runs").agg(F.count("*").alias("n"))
    one = sets.select(*by, "n", F.explode("runs").alias("run_id")).groupBy(*by, "run_id").agg(F.sum("n").alias("ids"))
    pair = F.explode(F.flatten(F.transform("runs", lambda x: F.transform(F.filter("runs", lambda y: y > x), lambda y: F.struct(x.alias("run_a"), y.alias("run_b")))))).alias("p")
    agreed = sets.select(*by, "n", pair).groupBy(*by, "p.run_a", "p.run_b").agg(F.sum("n").alias("agreed"))
    names = runs.select("run_id").distinct()
    # Runs are few, as each is one set of parameters; where one has no detection its count is 0.
    every = one.select(*by).distinct().join(names.select(F.col("run_id").alias("run_a")).hint("broadcast"), F.lit(True)).join(names.select(F.col("run_id").alias("run_b")).hint("broadcast"), F.col("run_a") < F.col("run_b"))
    out = every.join(one.select(*by, F.col("run_id").alias("run_a"), F.col("ids").alias("ids_a")), [*by, "run_a"], "left").join(one.select(*by, F.col("run_id").alias("run_b"), F.col("ids").alias("ids_b")), [*by, "run_b"], "left").join(agreed.hint("merge"), [*by, "run_a", "run_b"], "left")
    n = {c: F.coalesce(c, F.lit(0)) for c in ("ids_a", "ids_b", "agreed")}
    out = out.withColumns(n)
    total = F.col("ids_a") + F.col("ids_b") - F.col("agreed")
    return out.select(*by, "run_a", "run_b", "agreed", (F.col("ids_a") - F.col("agreed")).alias("only_a"), (F.col("ids_b") - F.col("agreed")).alias("only_b"), F.when(total == 0, 1.0).otherwise(F.round(F.col("agreed") / total, 4)).alias("agreement"))


def stability(stats: DataFrame, outlier_weeks: DataFrame, *by: str) -> DataFrame:
    """Flags of weekly_stats: variation above 0.5, weeks without detections, more than three outlier weeks. Rows that EXPECTED_SPARSE names are never flagged. `by` holds primitive and tf."""
    many = outlier_weeks.groupBy(*by).agg(F.count("*").alias("outlier_weeks"))
    out = stats.join(many, [*by], "left").withColumn("outlier_weeks", F.coalesce("outlier_weeks", F.lit(0)))
    zero = (F.col("zero_weeks") > 0) & ((F.col("tf") != "4H") | (F.col("zero_weeks") > 5))
    reasons = F.array_compact(F.array(F.when(F.col("cv") > 0.5, "variation"), F.when(zero, "zero weeks"), F.when(F.col("outlier_weeks") > 3, "outliers")))
    sparse = F.col("primitive").isin(*EXPECTED_SPARSE) & F.col("tf").isin("1H", "4H")
    return out.select(*by, "cv", "zero_weeks", "outlier_weeks", F.array_join(reasons, ", ").alias("reasons"), ((F.size(reasons) > 0) & ~sparse).alias("flagged"))


def stability_verdict(flags: DataFrame) -> DataFrame:
    """One row: PASS without flags, CONDITIONAL_PASS with up to 15 % of the rows flagged, else FAIL."""
    out = flags.agg(F.count("*").alias("total"), F.count_if("flagged").alias("flagged"), F.min("cv").alias("least_cv"), F.max("cv").alias("most_cv"))
    return out.withColumn("status", F.when(F.col("flagged") == 0, "PASS").when(F.col("flagged") <= F.col("total") * 0.15, "CONDITIONAL_PASS").otherwise("FAIL"))


def outlier_causes(outlier_weeks: DataFrame, known: dict[str, str], deviations: float = 2.0) -> DataFrame:
    """Adds the cause of outlier weeks (week, n, mean, std): a known event of that ISO week, else whether it has none, more or fewer than expected."""
    events = F.create_map(*[F.lit(x) for kv in known.items() for x in kv]) if known else F.create_map().cast("map<string,string>")
    high, low = F.col("mean") + deviations * F.col("std"), F.col("mean") - deviations * F.col("std")
    plain = F.when(F.col("n") == 0, "no detections").when(F.col("n") > high, "more than expected").when(F.col("n") < low, "fewer than expected").otherwise("within the expected range")
    return outlier_weeks.withColumn("iso_week", iso_week(F.col("week"))).withColumn("cause", F.coalesce(F.try_element_at(events, F.col("iso_week")), plain))


def label_summary(labels: DataFrame, *by: str) -> DataFrame:
    """Labels in all and of each kind."""
    return labels.groupBy(*by).agg(F.count("*").alias("total"), *[F.count_if(F.col("label") == k).alias(k.lower()) for k in ("CORRECT", "NOISE", "BORDERLINE")])


def config_scores(labels: DataFrame, dets_a: DataFrame, dets_b: DataFrame, *by: str) -> DataFrame:
    """Scores of the labels that each run detected, and how far B's lie above A's; null where either has none."""
    parts = []
    for name, dets in (("a", dets_a), ("b", dets_b)):
        seen = labels.join(dets.select("symbol", "id").distinct().hint("merge"), ["symbol", "id"], "left_semi")
        parts.append(scores(seen, *by).select(*by, *[F.col(c).alias(f"{c}_{name}") for c in ("precision", "recall", "f1")]))
    both = parts[0].join(parts[1], [*by], "full_outer")
    return both.select("*", *[(F.col(f"{c}_b") - F.col(f"{c}_a")).alias(f"delta_{c}") for c in ("precision", "recall", "f1")])


def completion(dets: DataFrame, upstream: DataFrame, primitive_has_upstream: DataFrame, *by: str) -> DataFrame:
    """Detections (id, upstream_refs) of a composite: complete if all they refer to exist in `upstream` (id) or, without references, if `primitive_has_upstream` has a row for the series."""
    refs = dets.select(*by, "id", F.explode("upstream_refs").alias("ref")).distinct()
    missing = refs.join(upstream.select(F.col("id").alias("ref")).distinct().hint("merge"), "ref", "left_anti").select(*by, "id").distinct().withColumn("_missing", F.lit(True))
    have = primitive_has_upstream.select(*by).distinct().withColumn("_have", F.lit(True))
    out = dets.join(missing.hint("merge"), [*by, "id"], "left").join(have, [*by], "left")
    done = F.when(F.size("upstream_refs") > 0, F.col("_missing").isNull()).otherwise(F.col("_have").isNotNull())
    return out.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(done).alias("complete"), F.count_if(~done).alias("incomplete"))


def reranked(candidates: DataFrame, verdicts: DataFrame, *by: str) -> DataFrame:
    """Candidates (run_id, score, rank) in a new order: checked and not UNSTABLE, then unchecked, then UNSTABLE; by falling score, ties by the old rank."""
    out = candidates.join(verdicts.select(*by, "run_id", "verdict"), [*by, "run_id"], "left")
    group = F.when(F.col("verdict").isNull(), 1).when(F.col("verdict") == "UNSTABLE", 2).otherwise(0)
    return out.withColumn("new_rank", F.row_number().over(Window.partitionBy(*by).orderBy(group, F.desc("score"), "rank")))
