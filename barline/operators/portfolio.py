"""Portfolios (A36-A42): totals, exposure, concentration, risk budget, limits, target bands."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.scalars import money, ratio

c = F.col
#: Limits on a portfolio's largest weight, largest sector, ATR over NAV and drawdown, inclusive.
LIMITS = {"largest": 0.20, "sector_largest": 0.35, "atr_ratio": 0.06, "drawdown": 0.15}
#: Share of positions with a sector from which on concentration is complete, and by how much a doubtful band widens.
MAPPED, WIDENING = 0.95, 0.10
#: Allowed exposure by strategic and tactical state.
BANDS = {
    ("bull", "risk_on"): (0.60, 0.85), ("bull", "neutral"): (0.50, 0.75), ("bull", "risk_off"): (0.35, 0.60),
    ("range", "risk_on"): (0.45, 0.70), ("range", "neutral"): (0.35, 0.60), ("range", "risk_off"): (0.20, 0.45),
    ("bear", "risk_on"): (0.25, 0.50), ("bear", "neutral"): (0.15, 0.40), ("bear", "risk_off"): (0.05, 0.25),
}


def totals(valued: DataFrame) -> DataFrame:
    """Value, cost, profit of the valued positions, and the share of positions that have a value."""
    has = c("value").isNotNull()
    own = valued.groupBy("portfolio").agg(money(F.sum("value")).alias("value"), money(F.sum(F.when(has, c("cost")))).alias("cost"), (F.count_if(has) / F.count("*")).alias("coverage"))
    return own.withColumn("profit", c("value") - c("cost"))


def exposure(valued: DataFrame, ledger: DataFrame) -> DataFrame:
    """NAV (as stated, else cash and positions; positive or none), what it rests on, gross ratio and largest weight.

    Ratios are there only where every position has a value; a portfolio without positions has none of them at risk.
    """
    own = valued.groupBy("portfolio").agg(F.sum("value").alias("gross_value"), F.max("value").alias("largest_value"), F.bool_and(c("value").isNotNull()).alias("complete"))
    own = ledger.select("portfolio", "cash", "manual_nav").join(own, "portfolio", "left").withColumn("complete", F.coalesce("complete", F.lit(True)))
    zero = F.lit(0).cast("decimal(18,2)")
    own = own.withColumns({x: F.when(c("complete"), F.coalesce(c(x), zero)) for x in ("gross_value", "largest_value")})
    own = own.withColumn("_nav", money(F.coalesce(c("manual_nav"), c("cash") + c("gross_value")))).withColumn("nav", F.when(c("_nav") > 0, c("_nav")))
    basis = F.when(c("nav").isNull(), "unavailable").when(c("manual_nav").isNotNull(), "manual_nav").otherwise("derived_nav")
    return own.select("portfolio", "nav", basis.alias("basis"), ratio(c("gross_value"), c("nav")).alias("gross"), ratio(c("largest_value"), c("nav")).alias("largest"), "complete")


def sector_largest(valued: DataFrame, members: DataFrame, exposures: DataFrame) -> DataFrame:
    """Per portfolio the share of positions with a sector, and the weight of its largest sector where that share is MAPPED at least and all else is there; positions without one form a sector of their own."""
    own = valued.join(members.select(c("security_id").alias("symbol"), "sector_id"), "symbol", "left")
    s = own.groupBy("portfolio", "sector_id").agg(F.sum("value").alias("v"), F.count("*").alias("n"))
    t = s.groupBy("portfolio").agg(F.max("v").alias("m"), (F.sum(F.when(c("sector_id").isNotNull(), c("n")).otherwise(0)) / F.sum("n")).alias("mapping_ratio"))
    own = exposures.join(t, "portfolio", "left").withColumn("mapping_ratio", F.coalesce("mapping_ratio", F.lit(1.0)))
    weight = F.when(c("complete") & (c("mapping_ratio") >= MAPPED), ratio(F.coalesce(c("m"), F.lit(0).cast("decimal(18,2)")), c("nav")))
    return own.select("portfolio", "mapping_ratio", weight.alias("sector_largest"))


def drawdown(navs: DataFrame) -> DataFrame:
    """Per portfolio over its days (portfolio, as_of, nav; null where unknown): days with and without a NAV, the last and the worst fall from the peak so far."""
    w = Window.partitionBy("portfolio").orderBy("as_of").rowsBetween(Window.unboundedPreceding, 0)
    own = navs.withColumn("nav", F.when(c("nav") > 0, c("nav").cast("double"))).withColumn("_d", c("nav") / F.max("nav").over(w) - 1)
    return own.groupBy("portfolio").agg(F.count("nav").alias("observations"), F.count_if(c("nav").isNull()).alias("unavailable"), F.max_by("_d", F.when(c("_d").isNotNull(), c("as_of"))).alias("current_drawdown"), F.min("_d").alias("max_drawdown"))


def portfolio_risk(valued: DataFrame, ledger: DataFrame, members: DataFrame, atr: DataFrame, navs: DataFrame, state: DataFrame) -> DataFrame:
    """One row for each portfolio of ``ledger``: exposure, sectors, ATR over NAV, drawdown, the state of each limit, and the target band."""
    own = exposure(valued, ledger)
    budget = atr_budget(valued, atr, own).withColumnRenamed("budget", "atr_ratio")
    fall = drawdown(navs).withColumn("drawdown", F.when(c("unavailable") == 0, -c("max_drawdown")))
    own = own.join(sector_largest(valued, members, own), "portfolio").join(budget, "portfolio", "left").join(fall, "portfolio", "left")
    own = own.withColumns({f"{n}_state": limit_state(c(n), limit) for n, limit in LIMITS.items()})
    return target_band(own, state)


def limit_state(value: Column, limit) -> Column:
    """Pass, breach or unavailable; at the limit it passes."""
    return F.when(value.isNull(), "unavailable").when(value <= limit, "pass").otherwise("breach")


def sector_concentration(valued: DataFrame, members: DataFrame) -> DataFrame:
    """Value of each sector in a portfolio, its weight, and the largest; positions without a sector are kept apart."""
    own = valued.join(members.select(c("security_id").alias("symbol"), "sector_id"), "symbol", "left").where("value is not null")
    s = own.groupBy("portfolio", "sector_id").agg(F.sum("value").alias("v"))
    t = s.groupBy("portfolio").agg(F.sum("v").alias("t"), F.max("v").alias("m"), F.count_if(c("sector_id").isNull()).alias("unmapped"))
    return s.join(t, "portfolio").select("portfolio", "sector_id", money(c("v")).alias("value"), ratio(c("v"), c("t")).alias("weight"), (c("v") == c("m")).alias("is_largest"))


def atr_budget(positions: DataFrame, atr: DataFrame, nav: DataFrame) -> DataFrame:
    """Quantity times ATR over NAV; null if any position has none."""
    own = positions.join(atr.select("symbol", "atr"), "symbol", "left").groupBy("portfolio").agg(F.sum(c("quantity").cast("double") * c("atr")).alias("b"), F.bool_and(c("atr").isNotNull()).alias("ok"))
    return own.join(nav.select("portfolio", "nav"), "portfolio", "left").select("portfolio", F.when(c("ok") & (c("nav") > 0), c("b") / c("nav").cast("double")).alias("budget"))


def guardrails(measures: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """Pass, breach or unavailable per limit; at the limit it passes."""
    limits = limits or {k: v for k, v in LIMITS.items() if k in measures.columns}
    own = measures.unpivot("portfolio", list(limits), "measure", "value")
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]), c("measure"))
    return own.withColumn("state", limit_state(c("value"), limit))


def target_band(exposures: DataFrame, state: DataFrame, on: str | None = None) -> DataFrame:
    """The band of exposure that the market's state (one row or none; with ``on``, one a date of that column) allows, and whether each portfolio's gross ratio lies in it.

    ``state`` has strategic and tactical, and may have degraded, confidence and full_scope; a degraded state, a confidence
    below 0.5 and a narrow scope each widen the band and are told in ``reasons``, sorted. With ``on``, degraded and full_scope
    are kept.
    """
    has = lambda name, default: c(name) if name in state.columns else F.lit(default)
    one = state.select(*([on] if on else []), "strategic", "tactical", has("degraded", False).alias("_degraded"), has("confidence", 1.0).alias("_confidence"), has("full_scope", True).alias("_full"))
    own = exposures.join(F.broadcast(one), on, "left") if on else exposures.join(F.broadcast(one.limit(1)), F.lit(True), "left")
    key = F.concat_ws(" ", "strategic", "tactical")
    base = [F.element_at(F.create_map(*[F.lit(x) for k, v in BANDS.items() for x in (" ".join(k), v[i])]), key) for i in (0, 1)]
    known = c("strategic").isNotNull()
    doubts = {"degraded_market_regime_band_widened": c("_degraded"), "low_regime_confidence_band_widened": c("_confidence") < 0.5, "narrow_market_scope_band_widened": ~c("_full")}
    wide = reduce(operator.or_, doubts.values())
    slack = F.when(wide, F.lit(WIDENING)).otherwise(0.0)
    reasons = F.array(F.concat(F.lit("market_regime:"), "strategic"), F.concat(F.lit("tactical_state:"), "tactical"), *[F.when(x, n) for n, x in doubts.items()])
    own = own.withColumns({"base_lower": F.when(known, base[0]), "base_upper": F.when(known, base[1])})
    own = own.withColumns({"lower": F.greatest(F.round(c("base_lower") - slack, 6), F.lit(0.0)), "upper": F.least(F.round(c("base_upper") + slack, 6), F.lit(1.0))})
    own = own.withColumns({x: F.when(known, c(x)) for x in ("lower", "upper")})
    own = own.withColumns({
        "band_status": F.when(~known, "unavailable").when(wide, "degraded").otherwise("ready"), "within_band": (c("gross") >= c("lower")) & (c("gross") <= c("upper")),
        "reasons": F.when(known, F.array_sort(F.array_compact(reasons))).otherwise(F.array(F.lit("market_regime_unavailable"))),
    })
    if on:
        own = own.withColumns({"degraded": c("_degraded"), "full_scope": c("_full")})
    return own.drop("_degraded", "_confidence", "_full")
