"""Trading calendars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def build_calendar(spark: SparkSession, start: str, end: str, *, closed: list[str] = (), unknown: list[str] = ()) -> DataFrame:
    """One row per day with its status; weekends are closed, years without a configuration are given as unknown days."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("trade_date"))
    among = lambda x: F.col("trade_date").isin([F.lit(y).cast("date") for y in x]) if x else F.lit(False)
    status = F.when(among(unknown), "unknown").when(among(closed) | (F.weekday("trade_date") > 4), "closed").otherwise("open")
    return days.withColumn("status", status)


def compose_calendar(bundled: DataFrame, promoted: DataFrame, start: str, end: str) -> DataFrame:
    """One row per day with its status from yearly configurations (year, closed: array of dates); a promoted year replaces the bundled one.

    Weekends and closed dates are closed; days of a year without a configuration are unknown.
    """
    own = promoted.select("year", "closed").unionByName(bundled.select("year", "closed").join(promoted.select("year"), "year", "left_anti"))
    days = bundled.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("trade_date"))
    days = days.withColumn("year", F.year("trade_date")).join(F.broadcast(own), "year", "left")  # a row a year
    shut = (F.weekday("trade_date") > 4) | F.array_contains("closed", F.col("trade_date"))
    return days.select("trade_date", F.when(F.col("closed").isNull(), "unknown").when(shut, "closed").otherwise("open").alias("status"))


#: Local times at which trading opens, closes, and a session's data are there.
OPENS, CLOSES, AVAILABLE = "09:30:00", "15:00:00", "16:00:00"


def market_clock(df: DataFrame, at: str, calendar: DataFrame, zone: str = "Asia/Shanghai") -> DataFrame:
    """``df`` with ``expected``, the latest session whose data should be there at a UTC time, and the market's ``phase``.

    Without a status of the day, or with an unknown day before a session is found, nothing is expected.
    """
    local = F.from_utc_timestamp(at, zone)
    w = Window.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, -1)  # a row a day
    told = calendar.select("trade_date", "status", *[F.max(F.when(F.col("status") == s, F.col("trade_date"))).over(w).alias(n) for s, n in (("open", "_opened"), ("unknown", "_lost"))])
    own = df.withColumns({"trade_date": F.to_date(local), "_at": F.date_format(local, "HH:mm:ss")}).join(F.broadcast(told), "trade_date", "left")
    known = F.col("status").isin("open", "closed")
    before = F.when(F.col("_lost").isNull() | (F.col("_opened") > F.col("_lost")), F.col("_opened"))
    expected = F.when(known, F.when((F.col("status") == "open") & (F.col("_at") >= AVAILABLE), F.col("trade_date")).otherwise(before))
    phase = F.when(~F.coalesce(known, F.lit(False)), "calendar_unavailable").when(F.col("status") == "closed", "closed").when(F.col("_at") < OPENS, "pre_market").when(F.col("_at") < CLOSES, "market_open").otherwise("after_close_waiting")
    return own.withColumns({"expected": expected, "phase": phase}).drop("_at", "_opened", "_lost", "status", "trade_date")


def previous_session(calendar: DataFrame, days: DataFrame) -> DataFrame:
    """The last open session before each day."""
    open_ = calendar.where("status = 'open'").select(F.col("trade_date").alias("session"))
    return days.join(F.broadcast(open_), F.col("session") < F.col("trade_date"), "left").groupBy(*days.columns).agg(F.max("session").alias("session"))
