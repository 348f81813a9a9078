"""Fund flows (A33-A35, W22, W23, S19): sums, persistence, quality, staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col
BY = ("scope_name",)


def load_flows(raw: DataFrame, through: Column, numbers: list[str]) -> tuple[DataFrame, DataFrame]:
    """Text rows as flows up to a date, and the rejected ones: a number that is infinite or not one, or no date. NaN becomes null."""
    cast = {n: F.nanvl(F.expr(f"try_cast({n} AS double)"), F.lit(None).cast("double")) for n in numbers}
    own = raw.withColumn("trade_date", F.try_to_date("trade_date", "yyyy-MM-dd"))
    bad = c("trade_date").isNull()
    for n in numbers:
        bad = bad | (c(n).isNotNull() & F.expr(f"try_cast({n} AS double)").isNull()) | F.coalesce(F.abs(F.expr(f"try_cast({n} AS double)")) == float("inf"), F.lit(False))
    return own.where(~bad & (c("trade_date") <= through)).withColumns(cast), own.where(bad)


def with_ordinals(flows: DataFrame, calendar: DataFrame) -> DataFrame:
    """``flows`` of open sessions with ``_o``, the session's number in the calendar's open sessions; days without a status, closed and unknown days go."""
    open_ = calendar.where("status = 'open'").select("trade_date").distinct().withColumn("_o", F.row_number().over(Window.orderBy("trade_date")))
    return flows.join(F.broadcast(open_), "trade_date")  # a row a day


def flow_metrics(flows: DataFrame, calendar: DataFrame, n: int = 20) -> DataFrame:
    """Per scope and open session the sums of 1, 5 and ``n`` sessions, share of inflows, z-score, weight of large orders and continuity.

    A window is full where the calendar's open sessions follow one another, whatever closed days lie between; until then its
    measures are null. ``continuity`` is the share of the last ``n`` open sessions that are there, 0 until there are as many.
    """
    by = Window.partitionBy(*BY).orderBy("_o")
    x = c("main_net")

    def full(k: int, value: Column) -> Column:
        w = by.rowsBetween(1 - k, 0)
        return F.when((F.count(F.lit(1)).over(w) == k) & (c("_o") - F.min("_o").over(w) == k - 1), value.over(w))

    mean, dev = full(n, F.avg(x)), full(n, F.stddev_pop(x))
    there = F.count(F.lit(1)).over(by.rangeBetween(1 - n, 0)) / n
    return with_ordinals(flows, calendar).select(
        "scope_name",
        "trade_date",
        x.alias("sum1"),
        full(5, F.sum(x)).alias("sum5"),
        full(n, F.sum(x)).alias("sum20"),
        full(n, F.avg((x > 0).cast("double"))).alias("positive"),
        F.when(dev > 0, (x - mean) / dev).when(dev == 0, 0.0).alias("z"),
        (full(n, F.sum(F.abs("super_net"))) / full(n, F.sum(F.abs(x)))).alias("large_share"),
        F.when(c("_o") >= n, there).otherwise(0.0).alias("continuity"),
    )


def flow_quality(flows: DataFrame, calendar: DataFrame, as_of: Column | None = None) -> DataFrame:
    """First blocking fault of each scope, null without one.

    In this order: a number that is missing, NaN or infinite; a repeated date; more than one ``source``, where flows have that
    column; a day that the calendar does not know; a closed day; with ``as_of``, an ``observed_on`` after it; an open
    session missing between the scope's first and last.
    """
    has = lambda name: c(name) if name in flows.columns else F.lit(None)
    late = has("observed_on") > as_of if as_of is not None else F.lit(False)
    days = calendar.select("trade_date", "status").distinct()
    days = days.withColumn("_o", F.count_if(c("status") == "open").over(Window.orderBy("trade_date")))
    told = flows.join(F.broadcast(days), "trade_date", "left")  # a row a day
    own = told.groupBy("scope_name").agg(
        F.bool_or(c("main_net").isNull() | F.isnan("main_net") | (F.abs("main_net") == float("inf"))).alias("_bad"),
        (F.count("*") > F.count_distinct("trade_date")).alias("_twice"),
        (F.count_distinct(has("source")) > 1).alias("_mixed"),
        F.bool_or(F.coalesce(c("status"), F.lit("unknown")) == "unknown").alias("_unknown"),
        F.bool_or(c("status") == "closed").alias("_closed"),
        F.bool_or(F.coalesce(late, F.lit(False))).alias("_late"),
        (F.count_distinct("_o") < F.max("_o") - F.min("_o") + 1).alias("_gap"),
    )
    faults = {"_bad": "not_finite", "_twice": "duplicate", "_mixed": "mixed_source", "_unknown": "calendar_unverifiable", "_closed": "closed_session", "_late": "late_observation", "_gap": "gap"}
    return own.select("scope_name", F.coalesce(*[F.when(c(k), name) for k, name in faults.items()]).alias("fault"))


#: Shares of sessions with an inflow from which on, and up to which, a flow persists.
PERSISTENT_IN, PERSISTENT_OUT = 0.65, 0.35


def direction() -> Column:
    """Persistent inflow, outflow or mixed; null until a full window."""
    into, out = (c("sum20") > 0) & (c("positive") >= PERSISTENT_IN), (c("sum20") < 0) & (c("positive") <= PERSISTENT_OUT)
    return F.when(c("sum20").isNotNull() & c("positive").isNotNull(), F.when(into, "persistent_reported_inflow").when(out, "persistent_reported_outflow").otherwise("mixed_reported_flow"))


def flow_direction(metrics: DataFrame) -> DataFrame:
    return metrics.select("scope_name", "trade_date", direction().alias("direction"))


def flow_report(metrics: DataFrame, stale: DataFrame, trusted: Column) -> DataFrame:
    """Availability and direction of the last date of each scope: ready, stale or insufficient_history.

    ``stale`` (scope_name, last, stale) comes from ``staleness``, ``trusted`` tells whether the source may be published.
    A direction is published only where the window is full, no session is missing since and the source is trusted.
    """
    last = metrics.join(stale.withColumnRenamed("last", "trade_date"), ["scope_name", "trade_date"])
    full = c("sum20").isNotNull() & c("positive").isNotNull()
    ready = full & c("stale").eqNullSafe(F.lit(0)) & F.coalesce(trusted, F.lit(False))
    state = F.when(ready, "ready").when(full & (c("stale") > 0), "stale").otherwise("insufficient_history")
    return last.select("scope_name", "trade_date", "stale", state.alias("availability"), F.when(ready, direction()).alias("direction"))


def expected_sessions(calendar: DataFrame, end: Column, n: int) -> DataFrame:
    """The ``n`` open sessions that end at a date."""
    return calendar.where((c("status") == "open") & (c("trade_date") <= end)).orderBy(F.desc("trade_date")).limit(n).select("trade_date")


def staleness(flows: DataFrame, calendar: DataFrame, as_of: Column) -> DataFrame:
    """Open sessions between a scope's last date and ``as_of``; null if a day between is unknown."""
    last = flows.groupBy("scope_name").agg(F.max("trade_date").alias("last"))
    own = last.join(F.broadcast(calendar), (calendar["trade_date"] > c("last")) & (calendar["trade_date"] <= as_of), "left")
    return own.groupBy("scope_name", "last").agg(F.when(~F.coalesce(F.bool_or(c("status") == "unknown"), F.lit(False)), F.count_if(c("status") == "open")).alias("stale"))
