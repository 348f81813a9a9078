"""Portfolios through time (A42): what a ledger with revisions holds on every session, valued, measured and held to limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.predicates import risk_price_valid
from barline.functions.scalars import ratio
from barline.operators import windows as W
from barline.operators.portfolio import LIMITS, MAPPED, limit_state, target_band

c = F.col
#: Fixed value: how far a stated NAV may lie from cash and positions.
NAV_TOLERANCE = 0.01
#: What a session's snapshot is told by.
SNAPSHOT = ("portfolio", "as_of", "revision")
#: What prices times quantities come to, and what two of them are added as, so that no place is lost.
VALUE, TERM = "decimal(38,9)", "decimal(37,9)"


def in_force(rows: DataFrame, by: Column, order: list[str], since: Column) -> DataFrame:
    """The rows that are ever in force, with the days [``since``, ``until``) on which they are; ``until`` is null for the last.

    A row counts from ``since`` on, and of those that count the one with the greatest ``order`` is in force; of rows equal in
    both, the greatest in the other columns. Rows without ``since`` never count. One running maximum per key, in one order.
    """
    whole = F.struct(*order, *[x for x in rows.columns if x not in order])
    own = rows.select(by.alias("_by"), since.alias("since"), whole.alias("_row")).where("since is not null")
    own = own.groupBy("_by", "since").agg(F.max("_row").alias("_row"))
    w = Window.partitionBy("_by").orderBy("since")
    own = own.withColumn("_row", F.max("_row").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = own.withColumn("_before", F.lag("_row").over(w)).where(~c("_row").eqNullSafe(c("_before")))
    return own.withColumn("until", F.lead("since").over(w)).select("_row.*", "since", "until")


def on_sessions(intervals: DataFrame, sessions: DataFrame) -> DataFrame:
    """A row for each interval and session inside it; ``sessions`` (trade_date and what else there is) has a row a day at most and is sent to all.

    Both meet on the year, so an interval lists its years only and meets no session of another one.
    """
    last = sessions.agg(F.max("trade_date").alias("_last"))  # one row
    own = intervals.join(F.broadcast(last), F.lit(True)).where("since <= _last")
    own = own.withColumn("_year", F.explode(F.sequence(F.year("since"), F.year(F.coalesce(F.date_sub("until", 1), "_last")))))
    days = sessions.withColumn("_year", F.year("trade_date"))
    own = own.join(F.broadcast(days), "_year").where("trade_date >= since and (until is null or trade_date < until)")
    return own.drop("_year", "_last", "since", "until")


def quotes(bars: DataFrame, members: DataFrame, sessions: DataFrame, delay: int) -> DataFrame:
    """Price (a double yet), ATR and sector of each symbol and session: a row where there is a bar or a member.

    A bar that came later than ``delay`` days after its session takes part in nothing, nor in later ATRs. The sector is that of the
    generation visible at the session's cutoff; of a security's rows in it that hold on the day, the greatest sector.
    """
    known = bars.where(c("ingested_at") <= F.date_add("trade_date", delay))
    price = F.when(risk_price_valid(), c("close"))
    prices = known.select("symbol", "trade_date", price.alias("price"))
    ranges = W.atr(W.effective_bars(known)).select("symbol", "trade_date", "atr")
    seen = members.where("promoted and snapshot_date is not null and observed_on is not null").select("snapshot_date", "observed_on", "generation").distinct()
    visible = in_force(seen, F.lit(0), ["snapshot_date", "observed_on", "generation"], F.greatest("snapshot_date", F.date_sub("observed_on", delay)))
    days = on_sessions(visible.select("generation", "since", "until"), sessions.select("trade_date"))
    held = members.where("sector_id is not null").join(F.broadcast(days), "generation")  # a row a session
    held = held.where("(list_date is null or list_date <= trade_date) and (delist_date is null or trade_date <= delist_date)")
    sectors = held.select(c("security_id").alias("symbol"), "trade_date", "sector_id")
    own = prices.unionByName(ranges, allowMissingColumns=True).unionByName(sectors, allowMissingColumns=True)
    return own.groupBy("symbol", "trade_date").agg(*[F.max(x).alias(x) for x in ("price", "atr", "sector_id")])


def positions_through_time(ledger: DataFrame, holdings: DataFrame, bars: DataFrame, members: DataFrame, delay: int = 0) -> DataFrame:
    """The positions of every portfolio on every session of ``bars`` from its first snapshot on, with price, value, ATR and sector.

    ``ledger``: portfolio, as_of, revision, recorded_on, cash, manual_nav; ``holdings``: the positions of each (portfolio, as_of,
    revision). On a session the snapshot of the latest day up to it is in force, in its highest revision recorded by ``delay`` days
    after the session. One without positions has one row without a symbol; one without as_of or recorded_on never counts.
    """
    sessions = bars.select("trade_date").distinct()
    snapshots = ledger.select(*SNAPSHOT, "recorded_on", "cash", "manual_nav").where("as_of is not null and recorded_on is not null")
    held = in_force(snapshots, c("portfolio"), ["as_of", "revision"], F.greatest("as_of", F.date_sub("recorded_on", delay)))
    own = on_sessions(held.drop("recorded_on").join(holdings.select(*SNAPSHOT, "symbol", "quantity"), list(SNAPSHOT), "left"), sessions)
    own = own.join(quotes(bars, members, sessions, delay), ["symbol", "trade_date"], "left").withColumn("price", c("price").cast("decimal(24,12)"))
    return own.withColumn("value", c("price") * c("quantity"))


def session_totals(positions: DataFrame) -> DataFrame:
    """Per portfolio and session: value, largest position and sector, risk, and how many positions have a price, an ATR and a sector. Both groupings share one layout."""
    has = c("symbol").isNotNull()
    keys = ["portfolio", "trade_date", "as_of", "revision", "cash", "manual_nav"]
    own = positions.repartition("portfolio", "trade_date").groupBy(*keys, "sector_id").agg(
        F.sum("value").alias("v"), F.max("value").alias("top"), F.count("symbol").alias("n"), F.count("value").alias("valued"),
        F.count_if(has & c("atr").isNotNull()).alias("ranged"), F.sum(c("quantity").cast("double") * c("atr")).alias("risk"),
    )
    return own.groupBy(*keys).agg(
        F.sum("n").alias("positions"), (F.sum("n") - F.sum("valued")).alias("unpriced"), (F.sum("n") - F.sum("ranged")).alias("unranged"),
        F.sum(F.when(c("sector_id").isNotNull(), c("n")).otherwise(0)).alias("mapped"),
        F.sum("v").alias("gross_value"), F.max("top").alias("largest_value"), F.max("v").alias("sector_value"), F.coalesce(F.sum("risk"), F.lit(0.0)).alias("risk"),
    )


def _spans(ledger: DataFrame, holdings: DataFrame, bars: DataFrame, members: DataFrame, delay: int) -> DataFrame:
    """A row for each snapshot in force and year of sessions: its sessions (``_days``) and positions (``_rows``, by sector, with prices and ATRs listed in the order of the sessions).

    A position meets its symbol's quotes by years and takes those of its sessions along, so what moves is a row for each position,
    snapshot and year, once, to its portfolio. One whose sector changes within the year comes once for each, with the others' sessions blank.
    """
    sessions = bars.select("trade_date").where("trade_date is not null").distinct()
    days = sessions.groupBy(F.year("trade_date").alias("_year")).agg(F.sort_array(F.collect_list("trade_date")).alias("_all"))  # a row a year
    snapshots = ledger.select(*SNAPSHOT, "recorded_on", "cash", "manual_nav").where("as_of is not null and recorded_on is not null")
    held = in_force(snapshots, c("portfolio"), ["as_of", "revision"], F.greatest("as_of", F.date_sub("recorded_on", delay))).drop("recorded_on")
    last = sessions.agg(F.max("trade_date").alias("_last"))  # one row
    held = held.join(F.broadcast(last), F.lit(True)).where("since <= _last").withColumn("until", F.coalesce("until", F.date_add("_last", 1))).drop("_last")
    heads = held.withColumn("_year", F.explode(F.sequence(F.year("since"), F.year(F.date_sub("until", 1))))).join(F.broadcast(days), "_year")
    heads = heads.withColumn("_days", F.filter("_all", lambda day: (day >= c("since")) & (day < c("until")))).where(F.size("_days") > 0)
    spans = heads.select(*SNAPSHOT, "since", "_year", F.array_position("_all", c("_days")[0]).alias("_from"), F.size("_days").alias("_n"))
    told = quotes(bars, members, sessions, delay).where("trade_date is not null").groupBy("symbol", F.year("trade_date").alias("_year"))
    told = told.agg(F.collect_list("trade_date").alias("_on"), F.collect_list(F.struct("price", "atr", "sector_id")).alias("_q")).join(F.broadcast(days), "_year")
    told = told.withColumn("_q", F.transform("_all", lambda day: F.get("_q", (F.array_position("_on", day) - 1).cast("int")))).select("symbol", "_year", *[c(f"_q.{x}").alias(x) for x in ("price", "atr", "sector_id")])
    own = spans.join(holdings.select(*SNAPSHOT, "symbol", "quantity").where("symbol is not null"), list(SNAPSHOT)).join(told, ["symbol", "_year"], "left")
    own = own.withColumns({x: F.slice(x, c("_from"), c("_n")) for x in ("price", "atr", "sector_id")})
    nowhere = F.array(F.lit(None).cast(told.schema["sector_id"].dataType.elementType))
    own = own.withColumn("_sectors", F.array_distinct(F.coalesce("sector_id", nowhere)))
    own = own.select("portfolio", "since", "_year", "quantity", "price", "atr", "sector_id", F.size("_sectors").alias("_k"), F.posexplode("_sectors").alias("_nth", "_sector"))
    here = F.when(c("_k") > 1, F.transform("sector_id", lambda x: x.eqNullSafe(c("_sector"))))
    blank = lambda x: F.when(c("_here").isNull(), c(x)).otherwise(F.zip_with(x, "_here", lambda v, there: F.when(there, v)))
    own = own.withColumn("_here", here).withColumns({x: blank(x) for x in ("price", "atr")})
    own = own.select("portfolio", "since", "_year", "_nth", "_sector", "quantity", "price", "atr", "_here")
    both = own.unionByName(heads.select("portfolio", "since", "_year", F.struct("as_of", "revision", "cash", "manual_nav", "_days").alias("_head")), allowMissingColumns=True).repartition("portfolio")
    row = F.struct(c("_sector").alias("sector"), c("_nth").alias("nth"), "quantity", "price", "atr", c("_here").alias("here"))
    own = both.withColumn("_row", F.when(c("_head").isNull(), row)).groupBy("portfolio", "since", "_year")
    own = own.agg(F.first("_head", True).alias("_head"), F.sort_array(F.collect_list("_row")).alias("_rows"), F.count_if(c("_nth") == 0).alias("positions"))
    return own.select("portfolio", "since", "_year", "_head.*", "_rows", "positions")


def _nav(x: dict[str, Column]) -> dict[str, Column]:
    """NAV as derived from cash and positions, as stated or derived, and where it is positive; ``x`` has complete, cash, manual_nav and gross_value."""
    derived = x["cash"] + F.when(x["complete"], F.coalesce(x["gross_value"], F.lit(0).cast(VALUE)))
    either = F.coalesce(x["manual_nav"], derived)
    return {"derived_nav": derived, "_nav": either, "nav": F.when(either > 0, either)}


def _valued(spans: DataFrame) -> DataFrame:
    """The spans with how many of their positions have a value, an ATR and a sector on each session, what they come to on those where all have a value, and NAVs; nothing is moved or sorted.

    Positions are counted a whole list at a time; only the sessions on which every one has a value are gone through position by position, and so by sector.
    """
    kind = spans.schema["_rows"].dataType.elementType
    null = lambda kind: F.lit(None).cast(kind)
    plus = lambda a, b: F.coalesce((a + b).cast(TERM), a, b)
    none = F.transform("_days", lambda _: F.lit(0))
    # Lists may be null, where a symbol has no quotes in the year; those count as empty ones, which zip_with fills with nulls.
    counted = lambda x, has: F.aggregate("_rows", none, lambda acc, r: F.when(has(r), F.zip_with(acc, r[x], lambda k, v: k + F.when(v.isNull(), 0).otherwise(1))).otherwise(acc))
    priced = lambda r: r["price"].isNotNull() & r["quantity"].isNotNull()
    mapped = F.size(F.filter("_rows", lambda r: r["sector"].isNotNull() & r["here"].isNull()))
    part = F.aggregate("_rows", none, lambda acc, r: F.when(r["sector"].isNotNull() & r["here"].isNotNull(), F.zip_with(acc, r["here"], lambda k, x: k + F.when(x, 1).otherwise(0))).otherwise(acc))
    own = spans.withColumns({"_valued": counted("price", priced), "_ranged": counted("atr", lambda r: r["atr"].isNotNull()), "_mapped": mapped, "_part": part})
    start = F.struct(null(kind["sector"].dataType).alias("sector"), *[null(TERM).alias(x) for x in ("own", "best", "all", "top")], F.lit(0.0).alias("risk"))

    def step(acc: Column, r: Column) -> Column:
        same, v = acc["sector"].eqNullSafe(r["sector"]), r["value"]
        own, best = F.when(same, plus(acc["own"], v)).otherwise(v), F.when(same, acc["best"]).otherwise(F.greatest(acc["best"], acc["own"]))
        risk = acc["risk"] + F.coalesce(r["risk"], F.lit(0.0))
        return F.struct(r["sector"].alias("sector"), own.alias("own"), best.alias("best"), plus(acc["all"], v).alias("all"), F.greatest(acc["top"], v).alias("top"), risk.alias("risk"))

    def done(acc: Column) -> Column:
        best = F.greatest(acc["best"], acc["own"])
        return F.struct(*[x.cast(VALUE).alias(n) for n, x in (("gross_value", acc["all"]), ("largest_value", acc["top"]), ("sector_value", best))], acc["risk"].alias("risk"))

    def session(n: Column, i: Column) -> Column:
        at = lambda r, x: F.get(r[x], i)
        one = lambda r: F.struct(r["sector"].alias("sector"), (at(r, "price").cast("decimal(24,12)") * r["quantity"]).cast(TERM).alias("value"), (r["quantity"].cast("double") * at(r, "atr")).alias("risk"))
        return F.when(n == c("positions"), F.aggregate(F.transform("_rows", one), start, step, done))

    own = own.withColumn("_totals", F.transform("_valued", session)).drop("_rows")
    # A session without all of its values has no totals, and a derived NAV neither; one without positions has all of none.
    nav = lambda a, n: _nav({"complete": n == c("positions"), "cash": c("cash"), "manual_nav": c("manual_nav"), "gross_value": a["gross_value"]})["nav"].cast("double")
    return own.withColumn("_navs", F.zip_with("_totals", "_valued", nav))


def _fallen(spans: DataFrame) -> DataFrame:
    """The valued spans with, for each of their sessions, the fall from the peak of all sessions so far (``_falls``), the last one there is (``_last``) and the NAVs seen (``_seen``), the latter two within the span, and with what earlier spans bring along."""
    w = Window.partitionBy("portfolio").orderBy("since", "_year").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    own = spans.withColumn("_n", F.size(F.filter("_navs", lambda x: x.isNotNull())).cast("bigint")).withColumn("_top", F.array_max("_navs"))
    own = own.withColumns({"_peak": F.max("_top").over(w), "_seen_before": F.coalesce(F.sum("_n").over(w), zero), "_before": F.coalesce(F.sum(F.size("_days")).over(w), zero)})
    own = own.withColumn("_falls", F.transform("_navs", lambda x, i: x / F.greatest(c("_peak"), F.array_max(F.slice("_navs", F.lit(1), i + 1))) - 1))
    end = lambda x: F.get(x, F.size(x) - 1)
    own = own.withColumns({
        "_last": F.aggregate("_falls", F.array().cast("array<double>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(x, end(acc))))),
        "_seen": F.aggregate("_navs", F.array().cast("array<bigint>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(end(acc), zero) + F.when(x.isNull(), 0).otherwise(1)))),
        "_worst": F.array_min("_falls"),
    })
    own = own.withColumn("_end", end(c("_last")))
    return own.withColumns({"_last_before": F.last("_end", True).over(w), "_worst_before": F.min("_worst").over(w)}).drop("_n", "_top", "_peak", "_end", "_worst", "_navs")


def _by_session(spans: DataFrame, falls: bool) -> DataFrame:
    """A row for each session of the valued spans."""
    own = spans.select("*", F.posexplode("_days").alias("_i", "trade_date"))
    at = lambda x: c(x)[c("_i")]
    columns = {x: at("_totals")[x] for x in ("gross_value", "largest_value", "sector_value")} | {"risk": F.coalesce(at("_totals")["risk"], F.lit(0.0)), "mapped": (c("_mapped") + at("_part")).cast("bigint")}
    columns |= {"unpriced": c("positions") - at("_valued"), "unranged": c("positions") - at("_ranged")}
    if falls:
        seen = c("_seen_before") + at("_seen")
        columns |= {
            "observations": seen, "unavailable": c("_before") + c("_i") + 1 - seen, "current_drawdown": F.coalesce(at("_last"), "_last_before"),
            "max_drawdown": F.least("_worst_before", F.array_min(F.slice("_falls", F.lit(1), c("_i") + 1))),
        }
    return own.select("portfolio", "trade_date", "as_of", "revision", "cash", "manual_nav", "positions", *[x.alias(n) for n, x in columns.items()])


def totals_through_time(ledger: DataFrame, holdings: DataFrame, bars: DataFrame, members: DataFrame, delay: int = 0) -> DataFrame:
    """As ``session_totals`` of ``positions_through_time`` without a row for each position and session: those of a snapshot and year are summed in its own row, which then is told by sessions.

    Values and risk are there where every position has a value; else values are null and the risk is 0, as nothing rests on them.
    """
    return _by_session(_valued(_spans(ledger, holdings, bars, members, delay)), False)


def measures(totals: DataFrame) -> DataFrame:
    """NAV (as stated, else cash and positions; positive or none) and what it rests on, weights and risk over it; each only where all of its inputs are there."""
    complete = c("unpriced") == 0
    own = totals.withColumns({x: F.when(complete, F.coalesce(c(x), F.lit(0).cast(totals.schema[x].dataType))) for x in ("gross_value", "largest_value", "sector_value")})
    own = own.withColumns(_nav({x: c(x) for x in ("cash", "manual_nav", "gross_value")} | {"complete": complete}))
    over_nav = lambda x: ratio(c(x).cast("double"), c("nav").cast("double"))
    mapping = F.when(c("positions") > 0, c("mapped") / c("positions")).otherwise(1.0)
    basis = F.when(c("nav").isNull(), "unavailable").when(c("manual_nav").isNotNull(), "manual_nav").otherwise("derived_nav")
    risk = F.when(complete & (c("unranged") == 0) & c("nav").isNotNull(), c("risk") / c("nav").cast("double"))
    return own.withColumns({
        "basis": basis, "mapping_ratio": mapping, "gross": over_nav("gross_value"), "largest": over_nav("largest_value"),
        "sector_largest": F.when(mapping >= MAPPED, over_nav("sector_value")), "atr_ratio": risk,
    })


def with_drawdown(own: DataFrame) -> DataFrame:
    """Adds, from each portfolio's NAVs up to the session as they were known then: sessions with and without one, the fall from the peak at the last, the worst, and the fall that a limit may be held to (null where any NAV is missing)."""
    w = Window.partitionBy("portfolio").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    fall = c("nav").cast("double") / F.max(c("nav").cast("double")).over(w) - 1
    own = own.withColumn("_fall", fall)
    missing = F.count_if(c("nav").isNull()).over(w)
    worst = F.min("_fall").over(w)
    return own.withColumns({
        "observations": F.count("nav").over(w), "unavailable": missing, "current_drawdown": F.last("_fall", True).over(w), "max_drawdown": worst,
        "drawdown": F.when(missing == 0, -worst),
    }).drop("_fall")


def _told(codes: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(x, name) for name, x in sorted(codes.items())]))


def portfolio_risk_history(ledger: DataFrame, holdings: DataFrame, bars: DataFrame, members: DataFrame, states: DataFrame, delay: int = 0) -> DataFrame:
    """The risk of every portfolio on every session from its first snapshot on: a row each.

    NAV and exposure, concentration, ATR over NAV, drawdown, the state of each limit, the band of exposure that the market's state
    of the session allows (``states``: a row a session), and what is missing or doubtful. A session's row uses only what was dated by it
    and known ``delay`` days after it. Empty tables give no rows; of repeated ledger rows one counts, repeated holdings each count.
    """
    own = measures(_by_session(_fallen(_valued(_spans(ledger, holdings, bars, members, delay))), True))
    own = own.withColumn("drawdown", F.when(c("unavailable") == 0, -c("max_drawdown")))
    own = own.withColumns({f"{n}_state": limit_state(c(n), limit) for n, limit in LIMITS.items()})
    own = target_band(own, states, "trade_date")
    stated = c("manual_nav").isNotNull()
    known = c("band_status") != "unavailable"
    own = own.withColumns({
        "missing": _told({
            "portfolio.cash": c("cash").isNull(), "portfolio.nav": ~stated & c("derived_nav").isNull(), "portfolio.positive_nav": c("_nav") <= 0,
            "classification.coverage_95_percent": (c("positions") > 0) & (c("mapping_ratio") < MAPPED), "market.regime": ~known,
        }),
        "issues": _told({
            "portfolio_snapshot_stale_for_requested_as_of": c("as_of") < c("trade_date"), "manual_nav_cannot_be_reconciled": stated & c("derived_nav").isNull(),
            "manual_nav_differs_from_derived_nav": stated & (F.abs(c("manual_nav") - c("derived_nav")) > NAV_TOLERANCE), "daily_nav_history_incomplete": c("unavailable") > 0,
            "market_regime_degraded": known & c("degraded"), "market_regime_narrow_scope_not_full_a_share": known & ~c("full_scope"),
        }),
    })
    whole = (F.size("missing") == 0) & (F.size("issues") == 0) & (c("unpriced") == 0) & (c("unranged") == 0)
    return own.withColumn("status", F.when(whole, "ready").otherwise("degraded")).drop("_nav", "risk", "mapped", "degraded", "full_scope", "base_lower", "base_upper")
