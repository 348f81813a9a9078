"""Joins of market tables (J1-J17): as-of, bitemporal, interval, reconciling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.scalars import cents

c = F.col


def asof_join(left: DataFrame, right: DataFrame, by: str, left_on: str, right_on: str, cols: list[str]) -> DataFrame:
    """``left`` with ``cols`` of the latest ``right`` row of its key at or before its date; null where there is none.

    Both sides are laid out in one order per key and the last right row is carried forward: one shuffle, no range join.
    A key's rows on the left keep their number; of right rows of one date the one with the greatest ``cols`` counts.
    """
    kept = left.select(F.struct(*left.columns).alias("_l"), c(by).alias("_by"), c(left_on).alias("_on"), F.lit(1).alias("_side"), F.lit(None).cast(right.select(F.struct(*cols)).schema[0].dataType).alias("_r"))
    told = right.select(F.lit(None).cast(kept.schema["_l"].dataType).alias("_l"), c(by).alias("_by"), c(right_on).alias("_on"), F.lit(0).alias("_side"), F.struct(*cols).alias("_r"))
    w = Window.partitionBy("_by").orderBy("_on", "_side", "_r").rowsBetween(Window.unboundedPreceding, 0)
    both = kept.unionByName(told).withColumn("_r", F.last("_r", True).over(w)).where("_side = 1")
    return both.select("_l.*", *[c(f"_r.{x}").alias(x) for x in cols])


def resolve_factors(baseline: DataFrame, events: DataFrame, sessions: DataFrame) -> DataFrame:
    """Factor of each (symbol, trade_date): the latest baseline at or before it, overridden by the latest event after the baseline that was in force and observed.

    ``kind``: exact (a baseline of that date), daily_event or daily_carry; null factor and kind without a baseline.
    """
    base = asof_join(sessions.select("symbol", "trade_date"), baseline.select("symbol", "snapshot_date", "factor"), "symbol", "trade_date", "snapshot_date", ["snapshot_date", "factor"])
    # An event counts from the later of its two dates on; of those that count by a session, the greatest is kept along.
    e = events.where(c("symbol").isNotNull() & c("effective_date").isNotNull() & c("observed_on").isNotNull())
    e = e.select("symbol", F.greatest("effective_date", "observed_on").alias("trade_date"), F.struct(c("effective_date").alias("_eff"), c("observed_on").alias("_obs"), c("back_factor").alias("_f")).alias("_e"), F.lit(0).alias("_side"))
    both = base.withColumn("_side", F.lit(1)).unionByName(e, allowMissingColumns=True)
    w = Window.partitionBy("symbol").orderBy("trade_date", "_side").rowsBetween(Window.unboundedPreceding, 0)
    own = both.withColumn("_e", F.max("_e").over(w)).where("_side = 1").withColumn("_e", F.when(c("_e._eff") > c("snapshot_date"), c("_e")))
    kind = F.when(c("snapshot_date").isNull(), None).when(c("_e").isNotNull(), "daily_event").when(c("snapshot_date") == c("trade_date"), "exact").otherwise("daily_carry")
    return own.select("symbol", "trade_date", F.coalesce("_e._f", "factor").alias("factor"), kind.alias("kind"))


def bootstrap_factors(universe: DataFrame, history: DataFrame, day: Column) -> DataFrame:
    """Latest event of each symbol up to a day; symbols without one get 1.0 and a marker."""
    last = history.where(c("effective_date") <= day).groupBy("symbol").agg(F.max(F.struct("effective_date", "back_factor")).alias("_e"))
    return universe.join(last, "symbol", "left").select("symbol", F.coalesce("_e.back_factor", F.lit(1.0)).alias("factor"), c("_e").isNull().alias("assumed"))


def pit_generation(generations: DataFrame, as_of: Column, known_at: Column) -> DataFrame:
    """The one promoted generation visible at the cutoff."""
    seen = generations.select("generation", "snapshot_date", "observed_on", "promoted").distinct().where(c("promoted") & (c("snapshot_date") <= as_of) & (c("observed_on") <= known_at))
    return seen.orderBy(F.desc("snapshot_date"), F.desc("observed_on"), F.desc("generation")).limit(1)


def pit_records(rows: DataFrame, as_of: Column, known_at: Column) -> DataFrame:
    """Rows of the visible generation in force at ``as_of`` on the latest snapshot date that has any; both ends count, null ones are open."""
    own = rows.join(F.broadcast(pit_generation(rows, as_of, known_at).select("generation")), "generation", "left_semi")
    own = own.where((c("snapshot_date") <= as_of) & (c("observed_on") <= known_at))
    own = own.where((c("list_date").isNull() | (c("list_date") <= as_of)) & (c("delist_date").isNull() | (as_of <= c("delist_date"))))
    latest = own.agg(F.max("snapshot_date").alias("snapshot_date"))  # one row
    return own.join(F.broadcast(latest), "snapshot_date", "left_semi")


def interval_join(facts: DataFrame, dims: DataFrame) -> DataFrame:
    """Facts with the dimension rows in force on their date (``valid_from`` to ``valid_to``, both included, nulls open), by symbol."""
    return facts.join(dims, "symbol").where((c("valid_from").isNull() | (c("valid_from") <= c("trade_date"))) & (c("valid_to").isNull() | (c("trade_date") <= c("valid_to"))))


def members_with_prices(members: DataFrame, bars: DataFrame, day: Column) -> DataFrame:
    """Members with their row of a day, if any."""
    today = bars.where(c("trade_date") == day).withColumnRenamed("symbol", "security_id")
    return members.join(today, "security_id", "left")


def value_positions(positions: DataFrame, bars: DataFrame, day: Column) -> DataFrame:
    """Positions with the close of a day and their value, or the reason why there is none."""
    today = bars.where(c("trade_date") == day).select("symbol", "close", "is_suspended", "quality_status", F.lit(True).alias("_has"))
    why = F.when(c("_has").isNull(), "missing").when(c("is_suspended"), "suspended").when(c("quality_status") != "ready", "bad_quality")
    own = positions.join(today, "symbol", "left").withColumn("reason", why)
    price = F.when(c("reason").isNull(), cents(c("close")))
    return own.select("portfolio", "symbol", "quantity", "cost", price.alias("close"), (price * c("quantity")).cast("decimal(38,4)").alias("value"), "reason")


def latest_revision(ledger: DataFrame, known_on: Column) -> DataFrame:
    """Per portfolio and day the highest revision recorded by the cutoff."""
    w = Window.partitionBy("portfolio", "as_of").orderBy(F.desc("revision"))
    return ledger.where(c("recorded_on") <= known_on).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


_PRICES = ("open", "high", "low", "close", "preclose")
_COMPARED = ("symbol", "trade_date", *_PRICES, "volume", "amount", "is_suspended", "adjust_factor")


def reconcile(left: DataFrame, right: DataFrame, *, tick: float = 0.011, relative: float = 0.001, points: float = 5.0, volume_unit: float = 100, amount_unit: float = 1000) -> DataFrame:
    """Per session how two sets of bars differ, by count of each check, and the verdict.

    Counts: rows on one side only; common rows without a factor of the session or of the symbol's session before (a first
    session has none), which are compared no further; of the others those whose suspension differs, of whose five prices one
    differs beyond ``tick``, whose volume or amount differs beyond the ``relative`` error, and whose adjusted return differs by
    more than ``points`` basis points. The second set counts volume and amount in units. ``verdict``: unavailable without
    common rows, with rows on one side only or without a factor; failed where a suspension, price or return or more than 0.1
    percent of volumes or amounts differ; else passed.
    """
    units = {"volume": c("volume") * volume_unit, "amount": c("amount") * amount_unit}
    both = [df.select(*_COMPARED, F.lit(n).alias("side")) for n, df in enumerate((left, right.withColumns(units)))]
    return reconcile_sides(both[0].unionByName(both[1]).repartition("symbol"), tick=tick, relative=relative, points=points)


def reconcile_sides(rows: DataFrame, *, tick: float = 0.011, relative: float = 0.001, points: float = 5.0) -> DataFrame:
    """As ``reconcile`` for rows of both sets in one frame, in the same units: ``side`` is 0 for those of the first, 1 for those of the second.

    A set has one row of a symbol and session. Rows that are laid out by symbol stay where they are and are sorted once: a row
    of the second set follows its counterpart, if there is one, and nothing is joined.
    """
    by = Window.partitionBy("symbol").orderBy("trade_date", "side")
    # What comes before is asked for at a row of the second set whose counterpart is the row before it.
    ago = lambda n, to: F.last(F.when(c("side") == n, F.struct("adjust_factor")), True).over(by.rowsBetween(Window.unboundedPreceding, to))["adjust_factor"]
    rows = rows.sortWithinPartitions("symbol", "trade_date", "side")  # before the structs below are made, so that they are not sorted along
    own = rows.withColumns({"a": F.lag(F.struct(*_COMPARED[1:], "side")).over(by), "a_before": ago(0, -2), "b_before": ago(1, -1)})
    at = lambda n, x: c(f"{n}_before") if x == "before" else c(f"a.{x}") if n == "a" else c(x)
    err = lambda x: F.abs(at("a", x) - at("b", x)) / F.greatest(F.abs(at("a", x)), F.abs(at("b", x)), F.lit(1.0))
    earned = lambda n: at(n, "close") * at(n, "adjust_factor") / (at(n, "preclose") * at(n, "before")) - 1
    common = c("symbol").isNotNull() & (c("side") == 1) & (at("a", "side") == 0) & (at("a", "trade_date") == c("trade_date"))
    known = F.forall(F.array(*[at(n, x).isNotNull() for n in "ab" for x in ("adjust_factor", "before")]), lambda x: x)
    count = lambda x, name: F.count_if(common & known & x).alias(name)
    own = own.groupBy("trade_date").agg(
        F.count_if(common).alias("common"),
        (F.count_if(c("side") == 0) - F.count_if(common)).alias("only_left"),
        (F.count_if(c("side") == 1) - F.count_if(common)).alias("only_right"),
        F.count_if(common & ~known).alias("no_factor"),
        count(at("a", "is_suspended") != at("b", "is_suspended"), "suspension_off"),
        count(F.exists(F.array(*[F.abs(at("a", x) - at("b", x)) > tick + 1e-12 for x in _PRICES]), lambda x: x), "ohlc_off"),
        count(err("volume") > relative, "volume_off"),
        count(err("amount") > relative, "amount_off"),
        count(F.when((at("a", "preclose") > 0) & (at("b", "preclose") > 0), F.abs(earned("a") - earned("b")) * 10000 > points).otherwise(False), "return_off"),
    )
    many = lambda x: c(x) > 0.001 * c("common")
    lacking = (c("common") == 0) | (c("only_left") + c("only_right") + c("no_factor") > 0)
    verdict = F.when(lacking, "unavailable").when((c("suspension_off") + c("ohlc_off") + c("return_off") > 0) | many("volume_off") | many("amount_off"), "failed").otherwise("passed")
    return own.withColumn("verdict", verdict)


def calendar_gaps(calendar: DataFrame, present: DataFrame) -> DataFrame:
    """Open sessions without data."""
    return calendar.where("status = 'open'").join(present.select("trade_date").distinct(), "trade_date", "left_anti").select("trade_date")


def calendar_conflicts(official: DataFrame, observed: DataFrame) -> DataFrame:
    """Days on which two calendars disagree; days that one doesn't know are told apart."""
    a, b = official.select("trade_date", c("status").alias("a")), observed.select("trade_date", c("status").alias("b"))
    own = a.join(b, "trade_date", "full_outer").select("trade_date", F.coalesce("a", F.lit("unknown")).alias("a"), F.coalesce("b", F.lit("unknown")).alias("b"))
    return own.where("a <> b").withColumn("kind", F.when((c("a") == "unknown") | (c("b") == "unknown"), "unknown").otherwise("conflict"))


def benchmark_spread(returns: DataFrame, value: str = "ret") -> DataFrame:
    """Each return less the mean of its date."""
    mean = returns.groupBy("trade_date").agg(F.avg(value).alias("benchmark"))
    return returns.join(mean, "trade_date").withColumn("spread", c(value) - c("benchmark"))


def rule_targets(watchlists: DataFrame, signals: DataFrame) -> DataFrame:
    """Signals of the symbols that a portfolio watches."""
    return watchlists.join(signals, "symbol")


#: Signals, and followers, that meet as one row in ``list_targets`` before their pairs come out.
TOLD, TOLD_TO = 504, 32


def list_targets(followers: DataFrame, lists: DataFrame, signals: DataFrame) -> DataFrame:
    """As ``rule_targets`` where portfolios watch whole lists: ``followers`` has portfolio and list, ``lists`` list and symbol.

    Signals meet their lists first, a row each, and are put into short arrays, as are followers. A list's followers are dealt by
    portfolio to as many deals as there are partitions, and each deal gets the list's arrays, so that no list is one task's and no
    side is held whole. The pairs that come out are the answer itself: as many as its rows. Of a few followers and an array they come
    follower by follower, so that files tell a follower once an array and find its symbols again soon before, however long the list is.
    """
    n = int(followers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = ["list", "_deal"]
    told = lists.join(signals, "symbol")
    told = told.groupBy("list", F.pmod(F.hash("symbol"), F.lit(16))).agg(F.collect_list(F.struct(*[x for x in told.columns if x != "list"])).alias("_all"))
    short = lambda n: F.explode(F.transform(F.sequence(F.lit(1), F.size("_all"), F.lit(n)), lambda i: F.slice("_all", i, n)))
    told = told.select("list", short(TOLD).alias("_told")).withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).repartition(n, *by)
    own = followers.select("portfolio", "list", F.pmod(F.hash("portfolio"), F.lit(n)).alias("_deal")).repartition(n, *by)
    own = own.groupBy(*by).agg(F.collect_list(F.struct("portfolio")).alias("_all")).select(*by, short(TOLD_TO).alias("_followers"))
    return own.join(told.hint("merge"), by).select(F.explode("_followers").alias("_f"), "_told").select("_f.portfolio", F.inline("_told"))


def conflicting_history(a: DataFrame, b: DataFrame, key: list[str], cols: list[str]) -> DataFrame:
    """Keys that both frames have with different contents."""
    digest = lambda df, n: df.select(*key, F.sha2(F.to_json(F.struct(*cols)), 256).alias(n))
    return digest(a, "_a").join(digest(b, "_b"), key).where("_a <> _b").select(*key)


def orphan_members(members: DataFrame, master: DataFrame) -> DataFrame:
    return members.join(master, "security_id", "left_anti")


def reconcile_ohlc(left: DataFrame, right: DataFrame, tolerance: str = "0.01") -> DataFrame:
    """Per price of the common rows the largest decimal difference and how many exceed the tolerance; and rows on one side only."""
    names = ("open", "high", "low", "close")
    dec = lambda x: x.cast("decimal(20,6)")
    a = left.select("symbol", "trade_date", *[dec(c(n)).alias(f"a_{n}") for n in names])
    b = right.select("symbol", "trade_date", *[dec(c(n)).alias(f"b_{n}") for n in names])
    own = a.join(b, ["symbol", "trade_date"], "full_outer")
    both = c("a_close").isNotNull() & c("b_close").isNotNull()
    gap = {n: F.abs(c(f"a_{n}") - c(f"b_{n}")) for n in names}
    limit = F.lit(tolerance).cast("decimal(20,6)")
    return own.agg(F.count_if(both).alias("common"), F.count_if(~both).alias("one_sided"), *[F.max(g).cast("double").alias(f"max_{n}") for n, g in gap.items()], *[F.count_if(g > limit).alias(f"off_{n}") for n, g in gap.items()])
