"""Tables for reports: candles, session bands, week manifests, the common columns of detections, and one row for each run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import with_iso_week, with_tags
from ..functions.measures import null_nonfinite
from ..operators import bars as B
from .evaluation import direction_distribution, session_distribution

# The bands of a forex day with the hours of New York they start and end at; the first starts the evening before.
BANDS = (("asia", 19, 0), ("lokz", 2, 5), ("nyokz", 7, 10), ("ny_a", 8, 9), ("ny_b", 10, 11))


def candles(bars: DataFrame, tfs: tuple[str, ...]) -> DataFrame:
    """Bars of all the timeframes as one table, with their forex day."""
    out = None
    for tf in tfs:
        part = with_tags(B.rollup(bars, tf)).select("symbol", "tf", "forex_day", "ts_ny", "open", "high", "low", "close", "volume", "is_ghost")
        out = part if out is None else out.unionByName(part)
    return out


def write_candles(table: DataFrame, path: str) -> None:
    """Replaces only the days that `table` has, in files by forex day and timeframe."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("forex_day", "tf").parquet(path)


def session_bands(bars: DataFrame) -> DataFrame:
    """Start and end of each band of each forex day that has bars in it."""
    inside = F.array_compact(F.array(F.when(F.col("session").isin("asia", "lokz", "nyokz"), F.col("session")), F.concat(F.lit("ny_"), F.col("ny_window"))))
    seen = bars.select("symbol", "forex_day", F.explode(inside).alias("band")).distinct()
    starts = F.create_map(*[F.lit(x) for name, a, _ in BANDS for x in (name, a)])
    ends = F.create_map(*[F.lit(x) for name, _, b in BANDS for x in (name, b)])
    at = lambda day, hours: day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.element_at(hours, F.col("band")))
    first = F.when(F.col("band") == "asia", F.date_sub("forex_day", 1)).otherwise(F.col("forex_day"))
    return seen.select("symbol", "forex_day", "band", at(first, starts).alias("start_time"), at(F.col("forex_day"), ends).alias("end_time"))


def week_manifest(bars: DataFrame, dets: DataFrame) -> DataFrame:
    """For each symbol and ISO week: bars of each timeframe, forex days with bars, detections; Saturdays and Sundays left out."""
    by = ["symbol", "week", "monday", "friday"]
    per = with_iso_week(bars).groupBy(*by, "tf").agg(F.count("*").alias("bars"), F.collect_set("forex_day").alias("days"))
    weeks = per.groupBy(*by).agg(F.sum("bars").alias("bars"), F.size(F.array_distinct(F.flatten(F.collect_list("days")))).alias("forex_days"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "tf", F.col("bars").cast("string")))), ",").alias("bars_by_tf"))
    found = with_iso_week(dets).groupBy("symbol", "week").agg(F.count("*").alias("detections"))
    return weeks.join(found, ["symbol", "week"], "left").withColumn("detections", F.coalesce("detections", F.lit(0)))


def slim(dets: DataFrame, *properties: str) -> DataFrame:
    """The common columns of detections and the properties named, null where a detection has none; properties are JSON."""
    common = [c for c in ("symbol", "tf", "primitive", "run_id", "id", "time", "direction", "price", "session", "forex_day") if c in dets.columns]
    return dets.select(*common, *[F.get_json_object("properties", f"$.{p}").alias(p) for p in properties])


def config_report(dets: DataFrame, *by: str) -> DataFrame:
    """One row for each of `by`: detections, days, mean and deviation by day, and the shares of sessions and directions as arrays. The detections themselves stay a table: they don't go into a row."""
    days = dets.groupBy(*by, "forex_day").agg(F.count("*").alias("n")).groupBy(*by).agg(F.sum("n").alias("detections"), F.count("*").alias("days"), F.round(F.avg("n"), 2).alias("mean_per_day"), F.round(F.stddev_pop("n"), 2).alias("std_per_day"))
    out = days
    for name, shares in (("session", session_distribution(dets, *by)), ("direction", direction_distribution(dets, *by))):
        each = shares.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(name, "n", "pct"))).alias(f"by_{name}"))
        out = out.join(each, [*by])
    return out


def as_json(report: DataFrame, *by: str) -> DataFrame:
    """Each row of a report as one JSON text, NaN and infinity as null."""
    return null_nonfinite(report).select(*by, F.to_json(F.struct(*[c for c in report.columns if c not in by])).alias("report"))


def run_report(run_id: str, **parts: DataFrame) -> DataFrame:
    """The parts of a run's report (configs, pairs, grid, walk_forward, scores, ...) as rows (run_id, part, row): each part's rows as JSON."""
    out = None
    for name, part in parts.items():
        rows = as_json(part).select(F.lit(run_id).alias("run_id"), F.lit(name).alias("part"), F.col("report").alias("row"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("a report needs at least one part")
    return out
