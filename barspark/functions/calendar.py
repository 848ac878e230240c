"""Trading calendar on New York wall-clock time (TIMESTAMP_NTZ), independent of the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NY = "America/New_York"
# Minutes of a bar by timeframe.
MINUTES = {"1m": 1, "5m": 5, "15m": 15, "1H": 60, "4H": 240}


def ny_time(ts: Column, zone: str = "UTC") -> Column:
    """Wall-clock time in New York of a wall-clock time in `zone`."""
    return F.convert_timezone(F.lit(zone), F.lit(NY), ts.cast("timestamp_ntz"))


def utc_time(ts: Column, zone: str) -> Column:
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), ts.cast("timestamp_ntz"))


def session(ny: Column) -> Column:
    """Session by the hour: six values."""
    h = F.hour(ny)
    return F.when(h >= 19, "asia").when(h < 2, "pre_london").when(h < 5, "lokz").when(h < 7, "pre_ny").when(h < 10, "nyokz").otherwise("other")


def kill_zone(session: Column) -> Column:
    return F.when(session.isin("lokz", "nyokz"), session)


def ny_window(ny: Column) -> Column:
    h = F.hour(ny)
    return F.when(h == 8, "a").when(h == 10, "b")


def forex_day(ny: Column) -> Column:
    """The day that ends at 17:00 New York: from then on, the next date."""
    return F.to_date(ny + F.expr("INTERVAL 7 HOURS"))


def map_session(session: Column) -> Column:
    """Six sessions to the four that detections use."""
    return F.when(session.isin("asia", "lokz", "nyokz"), session).otherwise("other")


def bar_time(ny: Column, minutes: int) -> Column:
    """The wall-clock time floored to the bar's length within its day."""
    minute = F.floor((F.hour(ny) * 60 + F.minute(ny)) / minutes).cast("int") * minutes
    return F.to_date(ny).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), minute, F.lit(0))


def forex_bar_time(ny: Column, minutes: int) -> Column:
    """The start of the bar when bars are aligned with 17:00."""
    since = (F.hour(ny) * 60 + F.minute(ny) - 1020 + 1440) % 1440
    start = F.floor(since / minutes).cast("int") * minutes
    return (forex_day(ny) - F.expr("INTERVAL 1 DAY")).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(17), start, F.lit(0))


def iso_week(day: Column) -> Column:
    """Year and week, such as 2024-W05."""
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), day).cast("int"), F.weekofyear(day))


def with_iso_week(df: DataFrame, day: str = "forex_day") -> DataFrame:
    """Adds week with its Monday and Friday; Saturdays and Sundays go."""
    monday = F.to_date(F.date_trunc("week", day))
    return df.where(F.dayofweek(day).between(2, 6)).withColumns({"week": iso_week(F.col(day)), "monday": monday, "friday": F.date_add(monday, 4)})


def with_tags(bars: DataFrame) -> DataFrame:
    """Adds session, kill_zone, ny_window and forex_day of ts_ny."""
    ny = F.col("ts_ny")
    return bars.withColumn("session", session(ny)).withColumns({"kill_zone": kill_zone(F.col("session")), "ny_window": ny_window(ny), "forex_day": forex_day(ny)})


def between_dates(df: DataFrame, start: str | None, end: str | None, ny: str = "ts_ny") -> DataFrame:
    """Rows whose New York date is from start to end, both included; None leaves a side open. Plain comparisons, so that they reach the scan."""
    if start is not None:
        df = df.where(F.col(ny) >= F.lit(start).cast("date").cast("timestamp_ntz"))
    if end is not None:
        df = df.where(F.col(ny) < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz"))
    return df


def boundaries_between(start: Column, end: Column) -> Column:
    """Session boundaries (5, 8 and 17 h New York) after start, up to and with end."""
    shifted = lambda t, h: F.to_date(t - F.expr(f"INTERVAL {h} HOURS"))
    return sum((F.datediff(shifted(end, h), shifted(start, h)) for h in (5, 8, 17)), F.lit(0))


def period_label(start: Column, end: Column) -> Column:
    """'Jan 2024', or 'Jan-Mar 2024'."""
    one, two = F.date_format(start, "MMM"), F.date_format(end, "MMM yyyy")
    return F.when(F.trunc(start, "month") == F.trunc(end, "month"), two).otherwise(F.concat(one, F.lit("-"), two))
