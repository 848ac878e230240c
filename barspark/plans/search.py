"""Parameter sweeps and searches: sets of parameters as a table, applied to detections in one plan."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.measures import fitness, precision, recall


def combinations(spark: SparkSession, ranges: dict[str, list[float]]) -> DataFrame:
    """All combinations of the values, by paths in sorted order, with run_id, the hash of the set. As large as the product of the ranges' lengths."""
    tables = [spark.createDataFrame([(float(v),) for v in ranges[k]], f"`{k}` double") for k in sorted(ranges)]
    out = reduce(lambda a, b: a.join(F.broadcast(b), F.lit(True)), tables)
    return out.select(F.md5(F.to_json(F.struct(*out.columns))).alias("run_id"), *out.columns)


def _uniform(seed: int, iteration: Column, path: Column, k: int) -> Column:
    """A number in [0, 1) with 52 bits of an md5, the same on every run."""
    text = F.concat_ws(":", F.lit(str(seed)), iteration.cast("string"), path, F.lit(str(k)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def perturbed(spark: SparkSession, space: dict[str, dict], n: int, seed: int) -> DataFrame:
    """n sets of parameters (iteration, path, value, choice), a row for each parameter; iteration 0 has the bases.

    `space` names each parameter's type and base. numeric: moves by 10 to 20 % of its base up or down, is clamped to min and
    max, and snapped to the grid of `step` from min, if there is one; whole if base, min, max and step are. categorical: one of
    `options`. boolean: 1 or 0. Each move is decided by a hash of seed, iteration and path.
    """
    fields = ("type", "base", "min", "max", "step", "options")
    rows = []
    for path, d in sorted(space.items()):
        numeric = d["type"] == "numeric"
        base = float(d["base"]) if numeric or d["type"] == "boolean" else None
        rows.append((path, d["type"], base, float(d.get("min", base * 0.5)) if numeric else None, float(d.get("max", base * 2)) if numeric else None, float(d["step"]) if d.get("step") else None, list(d.get("options", [])), d.get("base") if d["type"] == "categorical" else None))
    literal = F.from_json(F.lit(json.dumps([dict(zip(("path", *fields, "first"), r, strict=True)) for r in rows])), "array<struct<path:string,type:string,base:double,min:double,max:double,step:double,options:array<string>,first:string>>")
    each = spark.range(n).select(F.col("id").cast("int").alias("iteration"), F.explode(literal).alias("p")).select("iteration", "p.*")
    u = [_uniform(seed, F.col("iteration"), F.col("path"), k) for k in range(2)]
    clamp = lambda v: F.greatest("min", F.least("max", v))
    moved = clamp(F.col("base") * (1.0 + F.when(u[1] < 0.5, -1.0).otherwise(1.0) * (0.10 + 0.10 * u[0])))
    snapped = F.when(F.col("step") > 0, clamp(F.col("min") + F.bround((moved - F.col("min")) / F.col("step")) * F.col("step"))).otherwise(moved)
    whole = (F.col("step") > 0) & (F.col("base") % 1 == 0) & (F.col("min") % 1 == 0) & (F.col("max") % 1 == 0) & (F.col("step") % 1 == 0)
    first = F.col("iteration") == 0
    value = F.when(first, F.col("base")).when(F.col("type") == "numeric", F.when(whole, F.bround(snapped)).otherwise(snapped)).when(F.col("type") == "boolean", F.when(u[0] < 0.5, 1.0).otherwise(0.0))
    choice = F.when(first, F.col("first")).when(F.size("options") > 0, F.get("options", F.floor(u[0] * F.size("options")).cast("int")))
    return each.select("iteration", "path", value.alias("value"), choice.alias("choice"))


def searched(labels: DataFrame, sets: DataFrame, *by: str) -> DataFrame:
    """Each iteration's fitness over the labels that it detects, its gain on iteration 0, whether it is kept, and its rank.

    `labels` have atr_exact, body_exact, decisive, direction and label; `sets` (iteration, atr, body, override, toward) are as
    many as iterations were asked for, and go along as a literal. A label is detected if it passes both thresholds, or is
    decisive and `override` is 1, and if it points `toward` (or that is `both`). Labels are counted by the cells between the
    sets' thresholds first, so that sets meet cells.
    """
    rows = sets.orderBy("iteration").collect()
    bounds = {k: sorted({float(r[k]) for r in rows}) for k in ("atr", "body")}
    place = lambda k, c: F.size(F.filter(F.array(*map(F.lit, bounds[k])), lambda v: v <= F.col(c))).alias(k)
    cells = labels.groupBy(*by, "direction", "decisive", F.upper("label").alias("label"), place("atr", "atr_exact"), place("body", "body_exact")).agg(F.count("*").alias("n"))
    table = F.from_json(F.lit(json.dumps([{"iteration": r["iteration"], "atr": bounds["atr"].index(r["atr"]) + 1, "body": bounds["body"].index(r["body"]) + 1, "override": r["override"] == 1, "toward": r["toward"]} for r in rows])), "array<struct<iteration:int,atr:int,body:int,override:boolean,toward:string>>")
    met = lambda x: (((F.col("atr") >= x["atr"]) & (F.col("body") >= x["body"])) | (F.col("decisive") & x["override"])) & ((x["toward"] == "both") | (x["toward"] == F.col("direction")))
    kinds = ("correct", "noise", "missed")
    counts = [F.coalesce(F.sum(F.when(F.col("hit") & (F.col("label") == k.upper()), F.col("n"))), F.lit(0)).alias(k) for k in kinds]
    # Cells without a hit count, too, so that iterations that detect nothing stay.
    each = cells.select(*by, "label", "n", F.explode(F.transform(table, lambda x: F.struct(x["iteration"].alias("iteration"), met(x).alias("hit")))).alias("x")).select(*by, "label", "n", "x.*")
    out = each.groupBy(*by, "iteration").agg(*counts).withColumn("score", fitness(precision(F.col("correct"), F.col("noise")), recall(F.col("correct"), F.col("missed"))))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    base = F.max(F.when(F.col("iteration") == 0, F.col("score"))).over(w)
    return out.withColumns({"gain": F.col("score") - base, "rank": F.row_number().over(w.orderBy(F.desc("score"), "iteration"))}).withColumn("kept", F.col("gain") > 0)


def swept(dets: DataFrame, sets: DataFrame, atr: str, body: str, *by: str) -> DataFrame:
    """Displacements that each set of parameters keeps. Detections are first counted by the cells between the sets' thresholds, so that the sets meet cells, not detections."""
    bounds = sets.agg(F.array_sort(F.collect_set(atr)).alias("a"), F.array_sort(F.collect_set(body)).alias("b"))
    place = lambda values, x: F.size(F.filter(values, lambda v: v <= F.col(x)))
    cells = dets.join(F.broadcast(bounds), F.lit(True)).groupBy(*by, place(F.col("a"), "atr_exact").alias("i"), place(F.col("b"), "body_exact").alias("j"), "decisive").agg(F.count("*").alias("n"))
    ranked = sets.withColumns({"ri": F.dense_rank().over(Window.orderBy(atr)), "rj": F.dense_rank().over(Window.orderBy(body))})
    kept = ((F.col("i") >= F.col("ri")) & (F.col("j") >= F.col("rj"))) | F.col("decisive")
    return cells.join(F.broadcast(ranked), F.lit(True)).groupBy(*by, "run_id", atr, body).agg(F.coalesce(F.sum(F.when(kept, F.col("n"))), F.lit(0)).alias("detections"))


def summary(results: DataFrame, metric: str) -> DataFrame:
    """Sets by falling metric, ties by run_id, and what each gains on the first set tried (iteration 0)."""
    w = Window.orderBy(F.desc(metric), "run_id")
    base = results.where("iteration = 0").select(F.col(metric).alias("_base"))
    return results.join(F.broadcast(base), F.lit(True)).withColumn("rank", F.row_number().over(w)).withColumn("gain", F.col(metric) - F.col("_base")).withColumn("kept", F.col("gain") > 0).drop("_base")


def scored(labels: DataFrame, sets: DataFrame, detected: Column, paths: list[str], *by: str) -> DataFrame:
    """Sets of parameters ranked by the fitness of the labels that each detects, ties by the sets' values.

    Labels are first counted by what `detected` reads of them, so sets meet counts; a set without labels has the score 0.
    """
    values = [c for c in labels.columns if c not in {*by, "id", "direction", "label"}]
    kinds = {k: F.count_if(F.col("label") == k.upper()).alias(k) for k in ("correct", "noise", "missed")}
    cells = labels.groupBy(*by, *values).agg(*kinds.values())
    n = [F.coalesce(F.sum(F.when(detected, F.col(k))), F.lit(0)).alias(k) for k in kinds]
    # The sets are a literal of the caller's, as large as the product of the ranges' lengths.
    out = cells.join(sets.hint("broadcast"), F.lit(True)).groupBy(*by, "run_id", *paths).agg(*n)
    out = out.withColumn("score", fitness(precision(F.col("correct"), F.col("noise")), recall(F.col("correct"), F.col("missed"))))
    return out.withColumn("rank", F.row_number().over((Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(F.desc("score"), *paths)))
