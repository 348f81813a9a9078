"""Operators on hand-made rows: edges, nulls, ties, and results that later rows must not change."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.functions import predicates as P
from barline.functions import scalars as X
from barline.operators import flows, joins, portfolio, quality, recursive, rules, sector
from barline.operators import windows as W

START = dt.date(1998, 1, 5)
BAR = "symbol bigint, trade_date date, open double, high double, low double, close double, preclose double, volume double, amount double, pct_change double, adjust_factor double, is_trading boolean, is_suspended boolean, quality_status string, security_type string, board string, exchange string, source string"


def bars(spark, closes, symbol=1, **change):
    rows = []
    for i, x in enumerate(closes):
        row = dict(symbol=symbol, trade_date=START + dt.timedelta(days=7 * i), open=x, high=x + 1, low=x - 1, close=x, preclose=closes[i - 1] if i else x, volume=100.0 + i, amount=1000.0 + i, pct_change=0.0, adjust_factor=1.0, is_trading=True, is_suspended=False, quality_status="ready", security_type="stock", board="main", exchange="sh", source="a")
        row.update({k: v(i) for k, v in change.items()})
        rows.append(tuple(row.values()))
    return spark.createDataFrame(rows, BAR)


def values(df, column):
    return [r[column] for r in df.orderBy("symbol", "trade_date").collect()]


def test_means_equal_plain_trailing_means_and_are_null_in_warm_up(spark):
    closes = [10 + (7 * i % 13) / 4 for i in range(80)]
    for n in (5, 20):
        got = values(bars(spark, closes).withColumn("m", W.sma(n)), "m")
        assert got[: n - 1] == [None] * (n - 1) and all(math.isclose(got[i], sum(closes[i - n + 1 : i + 1]) / n) for i in range(n - 1, 80))


def test_suspended_rows_are_no_sessions(spark):
    df = bars(spark, [1.0, 2.0, 100.0, 3.0], is_suspended=lambda i: i == 2)
    assert values(W.effective_bars(df).withColumn("m", W.sma(3)), "m") == [None, None, 2.0]


def test_rsi_is_50_when_flat_and_100_without_a_loss(spark):
    rsi = lambda x: values(W.with_change(bars(spark, x)).withColumn("r", W.rsi_simple(3)), "r")
    assert rsi([5.0] * 5) == [None, None, None, 50.0, 50.0] and rsi([1.0, 2.0, 3.0, 4.0])[-1] == 100.0


def test_volume_ratio_leaves_today_out_and_needs_a_positive_mean(spark):
    df = bars(spark, [1.0] * 7, volume=lambda i: 0.0 if i < 6 else 10.0)
    assert values(df.withColumn("v", W.volume_ratio(5)), "v") == [None] * 7
    df = bars(spark, [1.0] * 6, volume=lambda i: 10.0 if i < 5 else 30.0)
    assert values(df.withColumn("v", W.volume_ratio(5)), "v")[-1] == 3.0


def test_streaks_drawdowns_and_crosses(spark):
    df = bars(spark, [1.0, 2.0, 3.0, 2.0, 1.0, 1.0]).withColumn("ret", W.period_return(1))
    assert values(W.with_streak(df, "ret", W.by()), "streak") == [None, 1.0, 2.0, -1.0, -2.0, 0.0]
    assert values(df.withColumn("d", W.drawdown()), "d")[-1] == pytest.approx(1 / 3 - 1)
    assert values(df.withColumn("d", W.worst_drawdown(3)), "d")[-1] == pytest.approx(-0.5)
    crossed = df.withColumns({"a": F.col("close"), "b": F.lit(2.0)}).withColumn("x", W.crosses_above(F.col("a"), F.col("b")))
    assert values(crossed, "x") == [False, False, True, False, False, False]


@pytest.mark.parametrize("name,column", [("sma", lambda: W.sma(5)), ("ratio", lambda: W.volume_ratio(5)), ("high", lambda: W.new_high(10)), ("drawdown", lambda: W.drawdown())])
def test_later_rows_change_nothing(spark, name, column):
    closes = [10 + (7 * i % 13) / 4 for i in range(40)]
    whole, part = (values(bars(spark, closes[:n]).withColumn("x", column()), "x") for n in (40, 25))
    assert whole[:25] == part


def test_macd_and_rsi_start_where_they_should():
    line, signal, hist = recursive.macd(np.arange(1.0, 61.0))
    assert np.isnan(line[:33]).all() and not np.isnan(line[33:]).any() and np.allclose(line[33:], 7) and np.allclose(hist[33:], 0)
    rsi = recursive.rsi_wilder(np.array([1.0] * 20))
    assert np.isnan(rsi[:14]).all() and (rsi[14:] == 0).all() and recursive.rsi_wilder(np.arange(30.0))[-1] == 100
    assert np.isnan(recursive.ema(np.arange(5.0), 12)).all() and recursive.ema(np.arange(12.0), 12)[-1] == 5.5


def test_user_indicator_runs_per_symbol(spark):
    recursive.register_indicator("twice", lambda x: (2 * x,), ("twice",), 1)
    df = bars(spark, [1.0, 2.0]).unionByName(bars(spark, [5.0], symbol=2))
    assert values(recursive.apply_indicators(df, ["twice"]), "twice") == [None, 4.0, None]


def test_rule_outcomes_and_gates(spark):
    closes = [10.0] * 25 + [20.0]
    df = bars(spark, closes, volume=lambda i: 10.0 if i < 25 else 50.0).unionByName(bars(spark, closes, symbol=2, is_suspended=lambda i: i == 25)).unionByName(bars(spark, closes[:5], symbol=3))
    day = F.lit(START + dt.timedelta(days=7 * 25))
    got = {r.symbol: (r.gate, r.outcome) for r in rules.screen(df, rules.ACCEPTANCE, day).collect()}
    assert got == {1: ("ok", "matched"), 2: ("suspended", "excluded"), 3: ("missing", "excluded")}
    rule = {"any": [{"not": {"op": "<=", "left": {"field": "close"}, "right": 15}}, {"op": "crosses_below", "left": {"sma": 2}, "right": 1}]}
    assert values(rules.screen_history(df.where("symbol = 1"), rule), "outcome")[-1] == "matched"
    with pytest.raises(ValueError):
        rules.screen_history(df, {"op": ">", "left": {"nothing": 1}, "right": 1})


def test_asof_join_keeps_every_left_row(spark):
    left = spark.createDataFrame([(1, 5, "a"), (1, 1, "b"), (2, 9, "c"), (1, 5, "a")], "k int, t int, x string")
    right = spark.createDataFrame([(1, 2, 10), (1, 5, 20), (1, 6, 30), (3, 1, 40)], "k int, eff int, f int")
    got = sorted(tuple(r) for r in joins.asof_join(left, right, "k", "t", "eff", ["eff", "f"]).collect() if r.f)
    assert got == [(1, 5, "a", 5, 20)] * 2
    assert joins.asof_join(left, right, "k", "t", "eff", ["f"]).count() == 4


def test_factor_events_need_to_be_observed(spark):
    d = lambda x: dt.date(1998, 1, x)
    base = spark.createDataFrame([(1, d(1), 1.0)], "symbol int, snapshot_date date, factor double")
    events = spark.createDataFrame([(1, d(3), d(5), 2.0)], "symbol int, effective_date date, observed_on date, back_factor double")
    sessions = spark.createDataFrame([(1, d(1)), (1, d(4)), (1, d(6)), (2, d(4))], "symbol int, trade_date date")
    got = sorted(((r.symbol, r.trade_date.day, r.factor, r.kind) for r in joins.resolve_factors(base, events, sessions).collect()), key=str)
    assert got == [(1, 1, 1.0, "exact"), (1, 4, 1.0, "daily_carry"), (1, 6, 2.0, "daily_event"), (2, 4, None, None)]


def test_totals_renormalise_over_what_is_there(spark):
    df = spark.createDataFrame([(1, 100.0, None), (2, None, None), (3, 100.0, 0.0)], "id int, a double, b double")
    got = {r.id: r.t for r in df.withColumn("t", sector.weighted_total({"a": 0.3, "b": 0.1})).collect()}
    assert got == {1: pytest.approx(100.0), 2: None, 3: pytest.approx(75.0)}
    ranked = sector.rank_by(df, "a", "id").collect()
    assert {r.id: r["rank"] for r in ranked} == {1: 1, 3: 2, 2: 3}


def test_digest_ignores_order_and_partitions(spark):
    df = bars(spark, [float(i) for i in range(20)])
    a, b = (quality.content_digest(x, ["symbol", "close"], ["source"]).collect() for x in (df, df.repartition(5).orderBy(F.desc("close"))))
    assert a == b and a[0]["rows"] == 20
    assert quality.content_digest(df.where("close < 19"), ["symbol", "close"], ["source"]).collect() != a
    manifest = quality.build_manifest(df, ["symbol", "close"])
    assert quality.diff_manifests(manifest, manifest).collect()[0].verdict == "same"
    changed = quality.build_manifest(df.withColumn("close", F.col("close") + (F.col("close") == 3).cast("int")), ["symbol", "close"])
    assert quality.diff_manifests(manifest, changed).collect()[0].verdict == "conflict"


def test_breadth_counts_a_missing_percent_as_eligible_only(spark):
    df = bars(spark, [1.0], pct_change=lambda i: None).unionByName(bars(spark, [1.0], symbol=2, pct_change=lambda i: 1.0))
    r = quality.breadth(df).collect()[0]
    assert (r.advancing, r.declining, r.unchanged, r.eligible) == (1, 0, 0, 2)


def test_scalars(spark):
    df = spark.createDataFrame([(1.005, 0.125, "19980102", float("nan"))], "x double, y double, d string, n double")
    r = df.select(
        X.money(F.lit("1.005").cast("decimal(10,3)")).alias("money"), X.ratio(F.lit("0.0000005").cast("decimal(20,10)"), F.lit(1).cast("decimal(10,0)")).alias("ratio"), X.ratio(F.lit(1), F.lit(0)).alias("none"),
        X.clamp(F.lit(500.0)).alias("clamp"), X.share_score(F.lit(0.75)).alias("share"), X.low_is_good(F.lit(0.3), 0.1, 0.5).alias("low"), X.level(F.lit(0.9)).alias("level"), X.parse_date(F.col("d")).alias("date"),
        X.number_text(F.lit("1.500").cast("decimal(10,3)")).alias("text"), X.number_text(F.lit("-0.00").cast("decimal(10,2)")).alias("zero"), X.safe_ratio(F.lit(1.0), F.lit(0.0)).alias("safe"), X.relative_error(F.lit(0.5), F.lit(0.25)).alias("err"),
        P.is_finite(F.col("n")).alias("finite"), X.market_date(F.lit("2024-01-01 18:00:00").cast("timestamp")).alias("local"), X.stable_id("s", F.lit(1)).alias("id"), X.quality_from_json(X.quality_to_json(F.array(F.lit("a")))).alias("json"),
    ).collect()[0]
    assert (str(r.money), r.ratio, r.none, r.clamp, r.share, r.level) == ("1.01", 0.0, None, 100.0, 50.0, "high")
    assert abs(r.low) < 1e-9 and r.date == dt.date(1998, 1, 2) and (r.text, r.zero, r.safe, r.err, r.finite) == ("1.5", "0", None, 0.25, False)
    assert r.local == dt.date(2024, 1, 2) and len(r.id) == 26 and r.json == ["a"]


def test_symbols(spark):
    df = spark.createDataFrame([(" 600001.SH ",), ("sz.1",), ("sz000002",), (None,)], "s string")
    assert [r[0] for r in df.select(P.normalize_symbol(F.col("s"))).collect()] == ["sh.600001", "sz.000001", None, None]


def test_flow_windows_need_every_open_session(spark):
    rows = [("all", dt.date(2024, 1, 1) + dt.timedelta(days=i), 1.0, 0.5) for i in range(25) if i != 10]
    df = spark.createDataFrame(rows, "scope_name string, trade_date date, main_net double, super_net double")
    days = spark.sql("SELECT explode(sequence(DATE '2024-01-01', DATE '2024-02-20')) AS trade_date")
    open_ = days.withColumn("status", F.lit("open"))
    got = [r for r in flows.flow_metrics(df, open_).orderBy("trade_date").collect()]
    assert [r.sum5 for r in got[3:6]] == [None, 5.0, 5.0] and got[10].sum5 is None and all(r.sum20 is None for r in got)
    assert got[-1].continuity == 0.95 and got[5].continuity == 0
    weeks = days.withColumn("status", F.when(F.weekday("trade_date") > 4, "closed").when(F.col("trade_date") == F.lit("2024-01-11").cast("date"), "closed").otherwise("open"))
    got = [r for r in flows.flow_metrics(df, weeks, 10).orderBy("trade_date").collect()]
    assert [r.sum5 for r in got] == [None] * 4 + [5.0] * (len(got) - 4) and len(got) == 18  # a closed day breaks no window
    assert got[-1].sum20 == 10.0 and got[-1].continuity == 1.0
    assert flows.flow_metrics(df.limit(0), open_).count() == 0


def test_flow_faults_in_order(spark):
    days = spark.sql("SELECT explode(sequence(DATE '2024-01-01', DATE '2024-01-20')) AS trade_date")
    calendar = days.withColumn("status", F.when(F.weekday("trade_date") > 4, "closed").when(F.col("trade_date") == F.lit("2024-01-19").cast("date"), "unknown").otherwise("open"))
    at = lambda k: dt.date(2024, 1, k)
    rows = []
    for scope, change in {"fine": {}, "inf": {4: (at(4), float("inf"), "a", at(4))}, "nan": {4: (at(4), float("nan"), "a", at(4))}, "null": {4: (at(4), None, "a", at(4))}, "twice": {3: (at(2), 1.0, "b", at(3))}, "mixed": {3: (at(3), 1.0, "b", at(30))}, "unknown": {5: (at(19), 1.0, "a", at(19))}, "unlisted": {5: (at(30), 1.0, "a", at(19))}, "closed": {5: (at(6), 1.0, "a", at(30))}, "late": {5: (at(5), 1.0, "a", at(30))}, "gap": {4: (at(8), 1.0, "a", at(8))}}.items():
        rows += [(scope, *change.get(k, (at(k), 1.0, "a", at(k)))) for k in (2, 3, 4, 5)]
    df = spark.createDataFrame(rows, "scope_name string, trade_date date, main_net double, source string, observed_on date")
    got = {r.scope_name: r.fault for r in flows.flow_quality(df, calendar, F.lit("2024-01-20").cast("date")).collect()}
    assert got == {"fine": None, "inf": "not_finite", "nan": "not_finite", "null": "not_finite", "twice": "duplicate", "mixed": "mixed_source", "unknown": "calendar_unverifiable", "unlisted": "calendar_unverifiable", "closed": "closed_session", "late": "late_observation", "gap": "gap"}
    plain = {r.scope_name: r.fault for r in flows.flow_quality(df.drop("source", "observed_on"), calendar).collect()}
    assert plain["mixed"] is None and plain["late"] is None and plain["closed"] == "closed_session"


def test_rows_of_flows_are_rejected(spark):
    raw = spark.createDataFrame([("2024-01-01", "1.5"), ("2024-01-02", "x"), ("2024-01-02", "Infinity"), ("2024-01-02", "NaN"), ("2025-01-02", "1")], "trade_date string, main_net string")
    good, bad = flows.load_flows(raw, F.lit("2024-12-31").cast("date"), ["main_net"])
    assert [r.main_net for r in good.orderBy("trade_date").collect()] == [1.5, None] and bad.count() == 2


def test_limits_pass_at_the_limit(spark):
    df = spark.createDataFrame([(1, 0.2, 0.36, 0.06), (2, None, 0.35, 0.07)], "portfolio int, largest double, sector_largest double, atr_ratio double")
    got = {(r.portfolio, r.measure): r.state for r in portfolio.guardrails(df).collect()}
    assert got == {(1, "largest"): "pass", (1, "sector_largest"): "breach", (1, "atr_ratio"): "pass", (2, "largest"): "unavailable", (2, "sector_largest"): "pass", (2, "atr_ratio"): "breach"}


def test_target_band_widens_with_each_doubt_and_needs_a_state(spark):
    df = spark.createDataFrame([(1, 0.60), (2, 0.86), (3, None)], "portfolio int, gross double")
    state = spark.createDataFrame([("bull", "risk_on", 0.9)], "strategic string, tactical string, confidence double")
    got = {r.portfolio: r for r in portfolio.target_band(df, state).collect()}
    assert (got[1].lower, got[1].upper, got[1].band_status) == (0.6, 0.85, "ready") and [got[k].within_band for k in (1, 2, 3)] == [True, False, None]
    wide = portfolio.target_band(df, state.withColumn("confidence", F.lit(0.4))).where("portfolio = 2").first()
    assert (wide.lower, wide.upper, wide.band_status, wide.within_band) == (0.5, 0.95, "degraded", True) and "low_regime_confidence_band_widened" in wide.reasons
    none = portfolio.target_band(df, state.limit(0)).where("portfolio = 1").first()
    assert none.band_status == "unavailable" and none.lower is None and none.reasons == ["market_regime_unavailable"]


def test_drawdown_follows_the_peak_and_counts_unknown_days(spark):
    df = spark.createDataFrame([(1, 1, 100.0), (1, 2, 120.0), (1, 3, None), (1, 4, 90.0), (1, 5, 108.0), (2, 1, 0.0)], "portfolio int, as_of int, nav double")
    got = {r.portfolio: r for r in portfolio.drawdown(df).collect()}
    assert (got[1].observations, got[1].unavailable) == (4, 1) and abs(got[1].max_drawdown + 0.25) < 1e-12 and abs(got[1].current_drawdown + 0.1) < 1e-12
    assert got[2].observations == 0 and got[2].max_drawdown is None
