"""Completeness, publication gates, digests and set comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.predicates import publication_issue

c = F.col
#: Boards whose stocks are in scope.
BOARDS = ("chinext", "main", "star")


def breadth(bars: DataFrame) -> DataFrame:
    """Per session; a row without a percent counts as eligible only."""
    live = c("is_trading") & (c("quality_status") == "ready")
    n = lambda x: F.count_if(live & x)
    return bars.groupBy("trade_date").agg(
        n(c("pct_change") > 0).alias("advancing"), n(c("pct_change") < 0).alias("declining"), n(c("pct_change") == 0).alias("unchanged"), F.count_if("is_suspended").alias("suspended"), F.count_if(live).alias("eligible")
    )


def turnover(bars: DataFrame) -> DataFrame:
    """Amount of trading rows per session and how many they are; null without any."""
    return bars.groupBy("trade_date").agg(F.sum(F.when(c("is_trading"), c("amount").cast("decimal(18,2)"))).cast("double").alias("amount"), F.count_if("is_trading").alias("rows"))


def market_summary(bars: DataFrame, refreshes: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """What each refresh (trade_date, status, requested, loaded, failed) says of its session: completeness, freshness, breadth, turnover, indexes.

    ``expected`` (trade_date, expected_on) names the session that should have been there when the refresh was looked at; where there is
    none, freshness is not evaluated and a ready refresh counts as partial. A failed refresh (status error) tells nothing of its bars.
    Breadth and turnover are those of stocks that are not suspended; a stock without a percent is eligible only. ``indexes`` are the
    session's index rows by symbol (a market has a bounded number of them). Nulls in counts count as 0; of repeated refreshes each has a row.
    """
    live, stock = ~c("is_suspended"), c("security_type") == "stock"
    n = lambda x: F.count_if(stock & x)
    point = F.struct("symbol", "close", "pct_change", "is_suspended")
    own = bars.groupBy("trade_date").agg(
        n(live & (c("pct_change") > 0)).alias("advancing"), n(live & (c("pct_change") < 0)).alias("declining"), n(live & (c("pct_change") == 0)).alias("unchanged"),
        n(c("is_suspended")).alias("suspended"), n(live).alias("eligible"), F.sum(F.when(stock & live, c("amount").cast("decimal(18,2)"))).cast("double").alias("amount"),
        F.array_sort(F.collect_list(F.when(c("security_type") == "index", point))).alias("indexes"),
    )
    error = c("refresh_status") == "error"
    out = refreshes.select("trade_date", c("status").alias("refresh_status"), *[F.coalesce(x, F.lit(0)).alias(x) for x in ("requested", "loaded", "failed")]).join(own, "trade_date", "left")
    out = out.join(expected.select("trade_date", "expected_on"), "trade_date", "left") if expected is not None else out.withColumn("expected_on", F.lit(None).cast("date"))
    counts = ("advancing", "declining", "unchanged", "suspended", "eligible")
    out = out.withColumns({x: F.when(error, 0).otherwise(F.coalesce(c(x), F.lit(0))) for x in counts} | {"loaded": F.when(error, 0).otherwise(c("loaded"))})
    none = F.array().cast(own.schema["indexes"].dataType)
    out = out.withColumns({"amount": F.when(~error, c("amount")), "indexes": F.when(error | c("indexes").isNull(), none).otherwise(c("indexes")), "expected_on": F.when(~error, c("expected_on"))})
    lag = F.when(c("expected_on").isNotNull(), F.greatest(F.datediff("expected_on", "trade_date"), F.lit(0)))
    out = out.withColumns({"coverage": F.coalesce(F.try_divide(c("loaded").cast("double"), c("requested").cast("double")), F.lit(0.0)), "lag_days": lag, "is_fresh": c("trade_date") >= c("expected_on")})
    known = c("expected_on").isNotNull()
    status = F.when(error, "error").when(known & ~c("is_fresh"), "stale").when(~known & (c("refresh_status") == "ready"), "partial").otherwise(c("refresh_status"))
    told = F.when(error, F.array(F.lit("refresh_error"))).otherwise(F.array_compact(F.array(
        F.when(~known, "freshness_not_evaluated"), F.when(~known, "calendar_unavailable"), F.when(~c("is_fresh"), "data_older_than_expected"), F.when(c("failed") > 0, "incomplete_symbol_coverage"))))
    return out.withColumns({"is_complete": (c("coverage") >= 1) & (c("failed") == 0) & ~error, "status": status, "issues": told}).drop("refresh_status")


def coverage(expected: DataFrame, loaded: DataFrame) -> DataFrame:
    """Per session: expected and loaded symbols, their ratio, and the symbols that are missing (sorted; of a universe's size at most)."""
    universe = expected.select("symbol").distinct()
    have = loaded.select("trade_date", "symbol").join(universe.withColumn("_in", F.lit(True)), "symbol", "left")
    own = have.groupBy("trade_date").agg(F.collect_set(F.when(c("_in"), c("symbol"))).alias("_have"))
    whole = universe.agg(F.collect_set("symbol").alias("_all"))
    own = own.crossJoin(F.broadcast(whole))  # one row
    own = own.select("trade_date", F.size("_all").cast("long").alias("expected"), F.size("_have").cast("long").alias("loaded"), F.array_sort(F.array_except("_all", "_have")).alias("failed"))
    return own.withColumn("ratio", c("loaded") / c("expected"))


def publication_issues(bars: DataFrame, expected: DataFrame, day: Column, indexes: DataFrame | None = None, users: DataFrame | None = None) -> DataFrame:
    """(kind, symbol, detail) of everything that keeps a session from being published, each once.

    Symbols of ``expected``, ``indexes`` and ``users`` that have no bar on the day; stocks that trade without a factor; rows whose
    quality forbids it, with the reason as ``detail``. Null symbols are asked for by nobody.
    """
    today = bars.where(c("trade_date") == day)
    lacks = lambda kind, asked: asked.select("symbol").where("symbol is not null").join(today.select("symbol"), "symbol", "left_anti").select(F.lit(kind).alias("kind"), "symbol", F.lit(None).cast("string").alias("detail"))
    asked = {"missing_symbol": expected, "required_index_missing": indexes, "required_symbol_missing": users}
    kinds = [lacks(kind, x) for kind, x in asked.items() if x is not None]
    bare = (c("security_type") == "stock") & ~c("is_suspended") & c("adjust_factor").isNull()
    kinds.append(today.where(bare).select(F.lit("missing_adjust_factor").alias("kind"), "symbol", F.lit(None).cast("string").alias("detail")))
    kinds.append(today.select(F.lit("invalid_publication_bar_quality").alias("kind"), "symbol", publication_issue().alias("detail")).where("detail is not null"))
    out = kinds[0]
    for x in kinds[1:]:
        out = out.unionByName(x)
    return out.distinct()


def session_gates(bars: DataFrame, least: int) -> DataFrame:
    """Pass or fail of each gate of each session, as rows."""
    own = bars.groupBy("trade_date").agg(
        (F.count("*") >= least).alias("universe"), (F.count("*") == F.count_distinct("symbol")).alias("unique"), F.bool_and(c("close") > 0).alias("prices"), F.bool_and(c("adjust_factor").isNotNull()).alias("factors"), (F.count_if("is_suspended") * 4 <= F.count("*")).alias("suspension")
    )
    return own.unpivot("trade_date", ["universe", "unique", "prices", "factors", "suspension"], "gate", "passed")


def universe_counts(members: DataFrame, days: DataFrame, state: Column) -> DataFrame:
    """Members by listing state on each of a few days."""
    own = members.crossJoin(F.broadcast(days)).withColumn("state", state)
    n = [F.count_if(c("state") == s).alias(s) for s in ("listed", "not_listed", "delisted", "unknown")]
    return own.groupBy("day").agg(F.count("*").alias("total"), *n)


def classification_coverage(members: DataFrame, traded: DataFrame) -> DataFrame:
    """Per generation: members, those that ever traded, their ratio and whether it reaches 0.95."""
    own = members.join(traded.select(c("symbol").alias("security_id")).distinct().withColumn("_has", F.lit(1)), "security_id", "left")
    out = own.groupBy("generation").agg(F.count("*").alias("eligible"), F.count("_has").alias("mapped"))
    return out.withColumn("ratio", c("mapped") / c("eligible")).withColumn("status", F.when(c("ratio") >= 0.95, "ok").otherwise("degraded"))


def market_scope(bars: DataFrame, indexes: list) -> DataFrame:
    """Per session: exchanges and boards that its stocks cover, boards and index series (``indexes``) that are expected but missing, stocks, and how far their prices are audited.

    ``price_status`` is over stocks of the boards in scope: not_audited where the quality of one is not ready, partial where one does
    not trade, else verified. Lists are sorted; they hold boards and expected series only, so their sizes are bounded.
    """
    stock = c("security_type") == "stock"
    scope = stock & c("exchange").isin("sh", "sz") & c("board").isin(*BOARDS)
    audited = c("quality_status") == "ready"
    seen = lambda x: F.array_sort(F.collect_set(x))
    own = bars.groupBy("trade_date").agg(
        seen(F.when(stock, c("exchange"))).alias("exchanges"), seen(F.when(stock, c("board"))).alias("boards"), F.count_distinct(F.when(stock, c("symbol"))).alias("universe"),
        seen(F.when(c("symbol").isin(*indexes) & (c("security_type") == "index"), c("symbol"))).alias("indexes"),
        F.coalesce(F.bool_or(F.when(scope, ~F.coalesce(audited, F.lit(False)))), F.lit(False)).alias("_open"), F.coalesce(F.bool_or(F.when(scope, ~c("is_trading"))), F.lit(False)).alias("_shut"),
    )
    lists = {"missing_boards": F.array_except(F.array(*map(F.lit, BOARDS)), "boards"), "missing_indexes": F.array_sort(F.array_except(F.array(*map(F.lit, indexes)).cast(own.schema["indexes"].dataType), "indexes"))}
    status = F.when(c("_open"), "not_audited").when(c("_shut"), "partial").otherwise("verified")
    return own.withColumns(lists | {"index_ratio": F.size("indexes") / len(indexes), "price_status": status}).drop("_open", "_shut")


def content_digest(df: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    """A digest of each group's rows that doesn't depend on their order: row digests, sorted within fixed slices, then the slices."""
    row = F.sha2(F.to_json(F.struct(*cols)), 256)
    slices = df.select(*by, row.alias("_h")).withColumn("_s", F.substring("_h", 1, 2)).groupBy(*by, "_s").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("_h")), ""), 256).alias("_d"), F.count("*").alias("_n"))
    return slices.groupBy(*by).agg(F.sum("_n").alias("rows"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_s", "_d"))), lambda x: x["_d"]), ""), 256).alias("digest"))


def build_manifest(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per source and session: rows and digest."""
    return content_digest(df, cols, ["source", "trade_date"])


def diff_manifests(left: DataFrame, right: DataFrame) -> DataFrame:
    """How many sessions only one side has or both have with other contents, and what that makes of the two."""
    a, b = (m.select("source", "trade_date", c("digest").alias(n)) for m, n in ((left, "_a"), (right, "_b")))
    n = a.join(b, ["source", "trade_date"], "full_outer").agg(
        F.count_if(c("_b").isNull()).alias("only_left"), F.count_if(c("_a").isNull()).alias("only_right"), F.count_if(c("_a") != c("_b")).alias("changed")
    )
    verdict = F.when((c("changed") > 0) | (c("only_left") > 0) & (c("only_right") > 0), "conflict").when(c("only_left") > 0, "left_newer").when(c("only_right") > 0, "right_newer").otherwise("same")
    return n.withColumn("verdict", verdict)


def lineage(df: DataFrame) -> DataFrame:
    return df.groupBy("source").agg(F.min("trade_date").alias("first"), F.max("trade_date").alias("last"), F.count("*").alias("rows"))


def latest_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is greatest by ``order``."""
    rest = [x for x in df.columns if x not in (*key, *order)]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*order, *rest), F.struct(*order)).alias("_r"))
    return best.select(*key, "_r.*")


def upsert(target: DataFrame, incoming: DataFrame, key: list[str], order: list[str] | None = None) -> DataFrame:
    """Last write wins: rows of ``incoming`` replace those of ``target`` with their key.

    Of several rows of one side and key the greatest by ``order`` stays, by default the greatest by all other columns.
    """
    last = [F.desc_nulls_last(x) for x in order or [x for x in target.columns if x not in key]]
    both = target.withColumn("_batch", F.lit(0)).unionByName(incoming.withColumn("_batch", F.lit(1)))
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("_batch"), *last))).where("_n = 1").drop("_n", "_batch")


def audit_partition(df: DataFrame, schema, source: str) -> DataFrame:
    """One pass over a partition: rows, wrong sources, missing prices, distinct identities, last date, and whether the schema fits."""
    fits = [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in schema]
    return df.agg(F.count("*").alias("rows"), F.count_if(~c("source").eqNullSafe(F.lit(source))).alias("wrong_source"), F.count_if(c("close").isNull()).alias("missing"), F.count_distinct("symbol", "trade_date").alias("identities"), F.max("trade_date").alias("last")).withColumn("schema_ok", F.lit(fits))


def required_symbols(positions: DataFrame, watchlists: DataFrame) -> DataFrame:
    """Held and watched symbols with their roles."""
    both = positions.select("symbol", F.lit("held").alias("role")).unionByName(watchlists.select("symbol", F.lit("watched").alias("role")))
    return both.groupBy("symbol").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))


def universe_diff(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Per session of ``observed``, how many expected symbols it lacks and how many it has beyond them or twice."""
    n = expected.select("symbol").distinct()
    known = observed.join(n.withColumn("_e", F.lit(1)), "symbol", "left")
    own = known.groupBy("trade_date").agg(F.count_distinct(F.when(c("_e") == 1, c("symbol"))).alias("present"), F.count_if(c("_e").isNull()).alias("extra"), (F.count("*") - F.count_distinct("symbol")).alias("repeated"))
    return own.crossJoin(n.agg(F.count("*").alias("_all"))).select("trade_date", (c("_all") - c("present")).alias("missing"), "extra", "repeated")


def common_dates(df: DataFrame) -> DataFrame:
    """Dates that every symbol of the frame has."""
    n = df.agg(F.count_distinct("symbol").alias("_n"))
    return df.groupBy("trade_date").agg(F.count_distinct("symbol").alias("_k")).crossJoin(n).where("_k = _n").select("trade_date")


def legal_missing(expected: DataFrame, observed: DataFrame, excused: DataFrame) -> DataFrame:
    """Missing symbols that nothing excuses, and excused ones that are there after all."""
    missing = expected.join(observed, "symbol", "left_anti").select("symbol", F.lit(1).alias("_m"))
    both = missing.join(excused.select("symbol", F.lit(1).alias("_x")), "symbol", "full_outer")
    return both.where("_m is null or _x is null").select("symbol", F.when(c("_x").isNull(), "unexcused").otherwise("present").alias("kind"))


def dedupe_exact(df: DataFrame, key: list[str]) -> DataFrame:
    """Per key how often it repeats and whether the payloads differ."""
    rest = [x for x in df.columns if x not in key]
    return df.groupBy(*key).agg(F.count("*").alias("rows"), (F.count_distinct(F.sha2(F.to_json(F.struct(*rest)), 256)) > 1).alias("conflict"))


def expected_universe(members: DataFrame, required: DataFrame, indexes: DataFrame, listed: Column) -> DataFrame:
    """Listed main-board symbols, then required ones and indexes beyond them, each with its layer."""
    main = members.where(listed).select(c("security_id").alias("symbol")).distinct()
    extra = required.select("symbol").distinct().join(main, "symbol", "left_anti")
    return main.withColumn("layer", F.lit("main")).unionByName(extra.withColumn("layer", F.lit("required"))).unionByName(indexes.select((-c("symbol") - 1).cast("bigint").alias("symbol")).distinct().withColumn("layer", F.lit("index")))


def qualification_window(days: DataFrame, calendar: DataFrame | None = None, n: int = 20) -> DataFrame:
    """Whether a source qualifies at each expected session: the ``n`` expected sessions up to it all observed, passed, and under one version.

    ``days`` has trade_date, verdict and, where versions count, version; expected are the open sessions of ``calendar``, by
    default the observed ones. ``reason`` is the first that holds: incomplete (a session was not observed), rejected (one did
    not pass), order (a day that is no expected session was observed between them), version; null and ``consecutive`` = n
    where the source qualifies, else 0.
    """
    sessions = (calendar.where(c("status") == "open") if calendar is not None else days).select("trade_date").distinct().withColumn("_open", F.lit(True))
    version = c("version").cast("string") if "version" in days.columns else F.lit("")
    seen = days.select("trade_date", "verdict", version.alias("_version"), F.lit(True).alias("_seen"))
    by = Window.orderBy("trade_date")  # a row for each day
    own = sessions.join(seen, "trade_date", "full_outer").withColumn("_k", F.count("_open").over(by))
    own = own.withColumn("_o", F.when(c("_open"), 2 * c("_k")).otherwise(2 * c("_k") + 1))  # odd: a day between two sessions
    w = Window.orderBy("_o").rangeBetween(2 - 2 * n, 0)
    on = c("_open") & c("_seen")
    reason = (
        F.when(F.count_if(on).over(w) < n, "incomplete")
        .when(F.count_if(on & ~F.coalesce(c("verdict") == "passed", F.lit(False))).over(w) > 0, "rejected")
        .when(F.count_if(c("_open").isNull()).over(w) > 0, "order")
        .when(F.min(F.when(on, c("_version"))).over(w) != F.max(F.when(on, c("_version"))).over(w), "version")
    )
    own = own.withColumn("reason", reason).where("_open")
    return own.select("trade_date", c("reason").isNull().alias("qualified"), "reason", F.when(c("reason").isNull(), n).otherwise(0).alias("consecutive"))


def reliability_window(audits: DataFrame, n: int = 20) -> DataFrame:
    """Share of sessions that loaded nine tenths, and the worst coverage, over the last ``n``."""
    w = Window.orderBy("trade_date").rowsBetween(1 - n, 0)
    share = c("loaded") / c("requested")
    own = audits.withColumn("_s", share)
    return own.select("trade_date", F.avg((c("_s") >= 0.9).cast("double")).over(w).alias("on_time"), F.min("_s").over(w).alias("worst"))


def session_quality(bars: DataFrame, other: DataFrame) -> DataFrame:
    """Per session the first reason to reject a second source: missing symbols, symbols beyond, suspensions or factors that differ; null if it may be used."""
    a = bars.select("symbol", "trade_date", c("is_suspended").alias("s1"), c("adjust_factor").alias("f1"), F.lit(1).alias("_a"))
    b = other.select("symbol", "trade_date", c("is_suspended").alias("s2"), c("adjust_factor").alias("f2"), F.lit(1).alias("_b"))
    own = a.join(b, ["symbol", "trade_date"], "full_outer").groupBy("trade_date").agg(
        F.bool_or(c("_b").isNull()).alias("missing"), F.bool_or(c("_a").isNull()).alias("extra"), F.bool_or(c("s1") != c("s2")).alias("suspension"), F.bool_or(~c("f1").eqNullSafe(c("f2"))).alias("factor")
    )
    return own.select("trade_date", F.when(c("missing"), "missing").when(c("extra"), "extra").when(c("suspension"), "suspension").when(c("factor"), "factor").alias("reason"))
