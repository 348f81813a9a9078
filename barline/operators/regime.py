"""The market's state through time (A26-A32): trend, breadth, liquidity and risk of every session in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.predicates import usable_for_regime
from barline.functions.scalars import clamp, low_is_good, scaled_score, share_score
from barline.operators import windows as W
from barline.operators.sector import weighted_total

c = F.col
#: Weights of the components. Leadership has no input here, so its weight is never in use.
WEIGHTS = {"trend": 0.30, "breadth": 0.25, "liquidity": 0.15, "risk": 0.20, "leadership": 0.10}
#: Totals from which on a state holds; its negative is the other end.
STRATEGIC, TACTICAL = 25.0, 10.0
#: Fixed values, for daily sessions: where volatility, drawdown and dispersion score 100 and -100.
RISK_BOUNDS = ((0.01, 0.03), (0.05, 0.20), (0.015, 0.04))


def trend(index_bars: DataFrame) -> DataFrame:
    """Mean of four signs per index, averaged over the indexes of a session, times 100; an index needs 125 sessions."""
    m = {n: W.sma(n) for n in (20, 60, 120)}
    own = index_bars.withColumns({f"m{n}": x for n, x in m.items()} | {"_k": F.row_number().over(W.by())})
    own = own.withColumn("_slope", c("m20") - F.lag("m20", 5).over(W.by()))
    signs = [F.signum(c("close") - c(f"m{n}")) for n in (20, 60, 120)] + [F.signum("_slope")]
    own = own.withColumn("_s", F.when(c("_k") >= 125, sum(signs[1:], signs[0]) / 4))
    return own.groupBy("trade_date").agg((F.avg("_s") * 100).alias("trend"))


def breadth(bars: DataFrame) -> DataFrame:
    """Mean of four scores: share advancing, above the 20 and the 60 mean, and 60-session highs less lows, on prices adjusted point in time."""
    x = "scaled_close"
    own = bars.where(usable_for_regime()).withColumn(x, W.scaled()).withColumns({"ret1": W.daily_return(), "ma20": W.sma(20, x), "ma60": W.sma(60, x), "hi": W.new_high(60, x), "lo": W.new_low(60, x)})
    share = lambda x: F.avg(x.cast("double"))
    m = own.groupBy("trade_date").agg(share(c("ret1") > 0).alias("a"), share(c(x) > c("ma20")).alias("b"), share(c(x) > c("ma60")).alias("d"), (share(c("hi")) - share(c("lo"))).alias("e"))
    scores = {"s1": share_score(c("a")), "s2": share_score(c("b")), "s3": share_score(c("d")), "s4": scaled_score(c("e"), 500)}
    return m.withColumns(scores).select("trade_date", weighted_total(dict.fromkeys(scores, 0.25)).alias("breadth"))


def liquidity(bars: DataFrame) -> DataFrame:
    """Amount of a session over the mean of the five before, as a change."""
    total = bars.where(usable_for_regime()).groupBy("trade_date").agg(F.sum(c("amount").cast("decimal(18,2)")).cast("double").alias("t"))
    w = Window.orderBy("trade_date").rowsBetween(-5, -1)  # a row for each session
    before = F.when(F.count("*").over(w) == 5, F.avg("t").over(w))
    return total.select("trade_date", scaled_score(c("t") / before - 1, 100).alias("liquidity"))


def risk(bars: DataFrame, index_bars: DataFrame, bounds: tuple = RISK_BOUNDS) -> DataFrame:
    """Mean of three low-is-good scores: volatility and worst drawdown of the indexes, dispersion of the stocks. Sessions of another length than a day want ``bounds`` of their own."""
    idx = index_bars.withColumn("ret", W.period_return(1)).withColumns({"vol": W.volatility(20), "dd": W.worst_drawdown(60)})
    idx = idx.groupBy("trade_date").agg(F.avg("vol").alias("vol"), F.min("dd").alias("dd"))
    own = bars.where(usable_for_regime()).withColumn("ret1", W.daily_return()).groupBy("trade_date").agg(F.when(F.count("ret1") >= 2, F.stddev_pop("ret1")).alias("disp"))
    m = idx.join(own, "trade_date", "full_outer")
    scores = {"s1": low_is_good(c("vol"), *bounds[0]), "s2": low_is_good(-c("dd"), *bounds[1]), "s3": low_is_good(c("disp"), *bounds[2])}
    scores = {n: F.when(x.isNotNull(), s) for (n, s), x in zip(scores.items(), (c("vol"), c("dd"), c("disp")), strict=True)}
    return m.withColumns(scores).select("trade_date", weighted_total(dict.fromkeys(scores, 1 / 3)).alias("risk"))


def score(components: DataFrame) -> DataFrame:
    """Renormalised total, and strategic and tactical states; thresholds are inclusive. Without any component they are range and neutral."""
    own = components if "leadership" in components.columns else components.withColumn("leadership", F.lit(None).cast("double"))
    own = own.withColumn("total", clamp(weighted_total(WEIGHTS)))
    t = c("total")
    strategic = F.when(t >= STRATEGIC, "bull").when(t <= -STRATEGIC, "bear").otherwise("range")
    tactical = F.when(t >= TACTICAL, "risk_on").when(t <= -TACTICAL, "risk_off").otherwise("neutral")
    return own.withColumns({"strategic": strategic, "tactical": tactical, "confidence": F.lit(0.0)})


def history(bars: DataFrame, index_bars: DataFrame, bounds: tuple = RISK_BOUNDS) -> DataFrame:
    """The scored components of every session."""
    own = breadth(bars).join(liquidity(bars), "trade_date", "full_outer").join(trend(index_bars), "trade_date", "full_outer").join(risk(bars, index_bars, bounds), "trade_date", "full_outer")
    return score(own).drop("leadership")


def replay_audit(saved: DataFrame, again: DataFrame, value: str = "total", latest_input: str | None = None) -> DataFrame:
    """How many saved sessions a recomputation confirms, changes or lacks; with ``latest_input``, also how many saved ones read a later date than their own (``future``)."""
    if latest_input:
        late = saved.agg(F.count_if(c(latest_input) > c("trade_date")).alias("future"))
        return replay_audit(saved, again, value).crossJoin(late)  # a row each
    a, b = saved.select("trade_date", c(value).alias("_a"), F.lit(1).alias("_x")), again.select("trade_date", c(value).alias("_b"), F.lit(1).alias("_y"))
    both = c("_x").isNotNull() & c("_y").isNotNull()
    return a.join(b, "trade_date", "full_outer").agg(F.count_if(both & c("_a").eqNullSafe(c("_b"))).alias("same"), F.count_if(both & ~c("_a").eqNullSafe(c("_b"))).alias("changed"), F.count_if(~both).alias("unmatched"))
