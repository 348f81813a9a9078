"""What is published of a session: summary, issues, scope, and the alerts' summary."""

import datetime as dt

from pyspark.sql import functions as F

from barline.operators import quality as Q
from barline.streaming import streams as T
from tests.test_operators import START, bars

REFRESH = "trade_date date, status string, requested bigint, loaded bigint, failed bigint"


def session(spark):
    """One session of three stocks, one suspended and one without a percent, and an index."""
    own = bars(spark, [10.0], symbol=1, pct_change=lambda i: 2.0)
    own = own.unionByName(bars(spark, [10.0], symbol=2, is_suspended=lambda i: True, is_trading=lambda i: False, pct_change=lambda i: -1.0, volume=lambda i: 0.0))
    own = own.unionByName(bars(spark, [10.0], symbol=3, pct_change=lambda i: None, board=lambda i: "star"))
    return own.unionByName(bars(spark, [99.0], symbol=-1, security_type=lambda i: "index", exchange=lambda i: None, board=lambda i: None))


def summary(spark, status, loaded, failed, expected=None, requested=3):
    refreshes = spark.createDataFrame([(START, status, requested, loaded, failed)], REFRESH)
    days = spark.createDataFrame([(START, expected)], "trade_date date, expected_on date") if expected else None
    return Q.market_summary(session(spark), refreshes, days).first()


def test_summary_tells_breadth_of_stocks_and_the_indexes(spark):
    r = summary(spark, "ready", 3, 0, START)
    assert (r.status, r.is_complete, r.coverage, r.is_fresh, r.lag_days, r.issues) == ("ready", True, 1.0, True, 0, [])
    assert (r.advancing, r.declining, r.unchanged, r.suspended, r.eligible, r.amount) == (1, 0, 0, 1, 2, 2000.0)
    assert [(x.symbol, x.close) for x in r.indexes] == [(-1, 99.0)]


def test_summary_is_stale_partial_or_failed(spark):
    r = summary(spark, "ready", 2, 1, START + dt.timedelta(days=4))
    assert (r.status, r.lag_days, r.is_complete, r.issues) == ("stale", 4, False, ["data_older_than_expected", "incomplete_symbol_coverage"])
    r = summary(spark, "ready", 3, 0)
    assert (r.status, r.is_fresh, r.lag_days, r.issues) == ("partial", None, None, ["freshness_not_evaluated", "calendar_unavailable"])
    r = summary(spark, "error", 3, 2, START)
    assert (r.status, r.loaded, r.coverage, r.eligible, r.amount, r.indexes, r.issues, r.is_complete) == ("error", 0, 0.0, 0, None, [], ["refresh_error"], False)
    assert summary(spark, "partial", 0, None, START, 0).coverage == 0.0
    later = spark.createDataFrame([(START + dt.timedelta(days=1), "ready", 1, 0, 0)], REFRESH)  # a refresh without a bar
    r = Q.market_summary(session(spark), later).first()
    assert (r.eligible, r.amount, r.indexes) == (0, None, [])
    assert Q.market_summary(session(spark), later.limit(0)).count() == 0


def test_publication_issues_of_every_kind(spark):
    day = F.lit(START)
    own = session(spark).withColumn("adjust_factor", F.when(F.col("symbol") == 1, None).otherwise(F.col("adjust_factor")))
    of = lambda *x: spark.createDataFrame([(i,) for i in x], "symbol bigint")
    got = {tuple(r) for r in Q.publication_issues(own, of(1, 7, 7, None), day, of(-1, -2), of(3, 8)).collect()}
    assert got == {("missing_symbol", 7, None), ("required_index_missing", -2, None), ("required_symbol_missing", 8, None), ("missing_adjust_factor", 1, None), ("invalid_publication_bar_quality", 1, "missing_factor")}
    assert {r.kind for r in Q.publication_issues(own.limit(0), of(1), day).collect()} == {"missing_symbol"}


def test_scope_names_what_is_missing(spark):
    r = Q.market_scope(session(spark), [-1, -2]).first()
    assert (r.boards, r.missing_boards, r.indexes, r.missing_indexes, r.index_ratio, r.universe) == (["main", "star"], ["chinext"], [-1], [-2], 0.5, 3)
    assert r.exchanges == ["sh"] and r.price_status == "partial"
    assert Q.market_scope(session(spark).where("symbol = 1"), [-1]).first().price_status == "verified"
    assert Q.market_scope(session(spark).withColumn("quality_status", F.lit("partial")), [-1]).first().price_status == "not_audited"


def test_alerts_are_summed_up(spark):
    kind = "alert_id bigint, seq bigint, state string, issues array<string>"
    moves = [(1, 1, "triggered", ["old"]), (1, 2, "acknowledged", None), (2, 1, "triggered", None), (3, 1, "suppressed", ["b", "a"]), (4, 1, "error", ["a"]), (5, 1, "suppressed", ["gone"]), (5, 2, "eligible", ["fine"])]
    r = T.alert_summary(spark.createDataFrame(moves, kind)).first()
    assert (r.status, r.unacknowledged, r.alerts, r.issues) == ("partial", 1, 5, ["a", "b"])
    assert T.alert_summary(spark.createDataFrame(moves[:3], kind).drop("issues")).first().status == "ready"
    r = T.alert_summary(spark.createDataFrame([], kind)).first()
    assert (r.status, r.unacknowledged, r.issues) == ("empty", 0, [])
