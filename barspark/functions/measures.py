"""Measures of bars, detections and evaluations as column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Thresholds of the qualification grid and of the quality grades.
ATR_MULTIPLES = (1.0, 1.25, 1.5, 2.0)
BODY_RATIOS = (0.55, 0.60, 0.65, 0.70)
GRADES = (("STRONG", 2.0), ("VALID", 1.5), ("WEAK", 1.25))


def close_near_extreme(high: Column, low: Column, close: Column, direction: Column, most: float) -> Column:
    """Whether the close is within `most` of the range from the directional extreme."""
    gap = F.when(direction == "bullish", high - close).otherwise(close - low)
    return (high > low) & (F.try_divide(gap, high - low) <= most)


def grade(atr_multiple: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, least in GRADES:
        out = out.when(atr_multiple >= least, name)
    return out


def grid(atr_multiple: Column, body_ratio: Column, close_ok: Column, override: Column) -> Column:
    """Array of one struct for each pair of thresholds."""

    def cell(a: float, b: float) -> Column:
        atr, body = atr_multiple >= a, body_ratio >= b
        both = (atr & body) | override
        return F.struct(F.lit(a).alias("atr"), F.lit(b).alias("br"), both.alias("and"), (atr | body | override).alias("or"), atr.alias("atr_only"), body.alias("body_only"), (both & close_ok).alias("and_close"), override.alias("override"))

    return F.array(*[cell(a, b) for a in ATR_MULTIPLES for b in BODY_RATIOS])


def percent(part: Column, whole: Column) -> Column:
    """Percentage with one decimal, 0 where the whole is 0."""
    return F.when(whole == 0, 0.0).otherwise(F.round(part / whole * 100, 1))


def precision(correct: Column, noise: Column) -> Column:
    return F.when(correct + noise > 0, correct / (correct + noise))


def recall(correct: Column, missed: Column) -> Column:
    return F.when(correct + missed > 0, correct / (correct + missed))


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r))


def fitness(p: Column, r: Column) -> Column:
    return F.coalesce(p, F.lit(0.0)) + F.coalesce(r, F.lit(0.0))


def config_id(*params: Column) -> Column:
    """Hash of the parameters by name."""
    return F.md5(F.to_json(F.struct(*params)))


def detection_id(primitive: str, tf: Column, time: Column, direction: Column) -> Column:
    short = F.when(direction == "bullish", "bull").when(direction == "bearish", "bear").otherwise(direction)
    return F.concat_ws("_", F.lit(primitive), tf, F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss"), short)


def session_from_id(id: Column) -> Column:
    """Session of the hour in a detection id; ids of another form are 'other'."""
    hour = F.regexp_extract(id, r"^[a-z_]+_\d+[mHD]_\d{4}-\d{2}-\d{2}T(\d{2}):", 1)
    h = F.when(hour != "", hour.cast("int"))
    return F.when(h >= 19, "asia").when((h >= 2) & (h < 5), "lokz").when((h >= 7) & (h < 10), "nyokz").otherwise("other")


def null_nonfinite(df: DataFrame) -> DataFrame:
    """NaN and infinite doubles as null."""
    doubles = {f.name: F.col(f.name) for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns({k: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c) for k, c in doubles.items()}) if doubles else df
