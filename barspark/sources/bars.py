"""Bars and labels from files, and detections to files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.calendar import ny_time, utc_time

RAW = T.StructType([T.StructField("timestamp", T.TimestampNTZType())] + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")])
LABELS = T.StructType([T.StructField(c, T.StringType()) for c in ("detection_id", "primitive", "timeframe", "label", "direction", "forex_day", "labeled_at", "labelled_date")])


def _bars(raw: DataFrame, symbol: str | None, tf: str = "1m") -> DataFrame:
    named = raw.withColumn("symbol", F.lit(symbol)) if symbol is not None else raw
    return named.select("symbol", F.lit(tf).alias("tf"), F.col("timestamp").alias("ts"), ny_time(F.col("timestamp")).alias("ts_ny"), "open", "high", "low", "close", "volume", (F.col("volume") == 0).alias("is_ghost"))


def read_bars_csv(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """1-minute bars of a CSV file with the columns of RAW; a missing column raises."""
    head = spark.read.option("header", True).csv(path).columns
    if missing := [f.name for f in RAW.fields if f.name not in head]:
        raise ValueError(f"missing columns: {missing}")
    text = spark.read.option("header", True).csv(path)
    typed = text.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RAW.fields])
    return _bars(typed.dropDuplicates(["timestamp"]), symbol)


def read_bars(spark: SparkSession, root: str, symbols: list[str], start: str, end: str, zone: str = "UTC") -> DataFrame:
    """1-minute bars below root/symbol=.../date=..., only the partitions asked for, the first of equal timestamps. No such files: an empty table."""
    schema = T.StructType([*RAW.fields, T.StructField("symbol", T.StringType()), T.StructField("date", T.DateType())])
    try:
        files = spark.read.schema(schema).parquet(root)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        files = spark.createDataFrame([], schema)
    raw = files.where(F.col("symbol").isin(symbols) & F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    raw = raw.withColumn("timestamp", utc_time(F.col("timestamp"), zone)).groupBy("symbol", "timestamp").agg(*[F.min_by(c, "date").alias(c) for c in ("open", "high", "low", "close", "volume")])
    return _bars(raw, None)


def available_range(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.min(F.to_date("ts")).alias("first_date"), F.max(F.to_date("ts")).alias("last_date"))


def integrity(bars: DataFrame) -> DataFrame:
    """Bars, ghosts, and minutes missing on the days that have data."""
    days = F.count_distinct(F.to_date("ts"))
    return bars.groupBy("symbol").agg(F.count("*").alias("bar_count"), F.count_if("is_ghost").alias("ghost_count"), F.greatest(F.lit(0), days * 1440 - F.count("*")).alias("gap_count"))


def read_labels(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Labels of JSON arrays; files that are none and rows without the four required fields are skipped."""
    raw = spark.read.schema(LABELS).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    need = ["detection_id", "primitive", "timeframe", "label"]
    return raw.dropna(subset=need).select(*need[:3], F.upper("label").alias("label"), F.lit(source).alias("labelled_by"))


def merged_labels(validate: DataFrame, compare: DataFrame) -> DataFrame:
    """One label for each detection: those of validate first."""
    both = validate.withColumn("place", F.lit(0)).unionByName(compare.withColumn("place", F.lit(1)))
    return both.groupBy("detection_id").agg(*[F.min_by(c, "place").alias(c) for c in ("primitive", "timeframe", "label", "labelled_by")])


def write_detections(dets: DataFrame, path: str, fmt: str = "parquet") -> None:
    dets.write.mode("overwrite").partitionBy("primitive", "tf").format(fmt).save(path)


def append_period(dets: DataFrame, path: str) -> None:
    """Adds a period's detections to those that are there."""
    dets.write.mode("append").partitionBy("primitive", "tf").parquet(path)
