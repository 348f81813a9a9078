"""Prices adjusted point in time: a factor that doubles between two equal closes counts everywhere; recurrences; common sessions."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.operators import recursive, regime, rules, sector
from barline.operators import windows as W
from tests.test_operators import START, bars, values


def doubled(spark, n, at, **change):
    """Equal closes whose factor doubles at row ``at``: those before count as half."""
    return bars(spark, [10.0] * n, adjust_factor=lambda i: 2.0 if i >= at else 1.0, **change)


def last(df, rule):
    return values(rules.screen_history(df, rule), "outcome")[-1]


def test_rules_see_earlier_prices_in_terms_of_the_signal_day(spark):
    df = doubled(spark, 2, 1)
    below = lambda x: {"op": "<", "left": {"sma": 2}, "right": x}
    assert last(df, below(8)) == "matched" and last(df, below(7.5)) == "not_matched"  # the mean is 7.5
    assert last(df, {"op": "==", "left": {"sma": 2, "field": "volume"}, "right": 100.5}) == "matched"
    for x in W.PRICES:
        start = {"high": 11.0, "low": 9.0}.get(x, 10.0)
        assert last(df, {"op": "==", "left": {"sma": 2, "field": x}, "right": 0.75 * start}) == "matched"
        assert last(df, {"op": "==", "left": {"field": x}, "right": start}) == "matched"
    assert last(df, {"op": "crosses_above", "left": {"field": "close"}, "right": 8}) == "matched"  # 5 in terms of today
    assert last(df, {"op": "crosses_above", "left": {"field": "volume"}, "right": 100.5}) == "matched"
    assert values(rules.screen_history(df, below(8)), "outcome")[0] == "insufficient"
    rsi = {"op": "==", "left": {"rsi": 2}, "right": 100}
    assert last(doubled(spark, 4, 3), rsi) == "matched" and last(bars(spark, [10.0] * 4), rsi) == "not_matched"


def test_rules_compute_emas_of_any_field(spark):
    closes = [10 + (7 * i % 13) / 4 for i in range(60)]
    df = bars(spark, closes, adjust_factor=lambda i: 1.0 + (i // 20))
    scaled = np.array([x * (1 + i // 20) for i, x in enumerate(closes)])
    expected = recursive.ema(scaled, 5)[-1] / 3
    for shift, outcome in ((-1e-6, "matched"), (1e-6, "not_matched")):
        assert last(df, {"op": ">", "left": {"ema": 5}, "right": float(expected + shift)}) == outcome


def test_atr_is_of_adjusted_prices_and_needs_every_factor(spark):
    got = values(W.atr(doubled(spark, 16, 8), 14), "atr")
    # Rows 2-7 have half the prices and range 1, row 8 rises from 5 to 11, rows 9-15 have range 2.
    assert got[:14] == [None] * 14 and got[15] == pytest.approx((6 * 1 + 6 + 7 * 2) / 14)
    gap = bars(spark, [10.0] * 16, adjust_factor=lambda i: 0.0 if i == 5 else 1.0)
    assert values(W.atr(gap, 14), "atr")[15] is None


def test_sector_and_breadth_measures_are_of_adjusted_prices(spark):
    df = doubled(spark, 61, 60).unionByName(bars(spark, [10.0] * 61, symbol=2))
    members = spark.createDataFrame([(1, 7), (2, 7)], "security_id bigint, sector_id int")
    own = sector.member_bars(df, members)
    got = {r.symbol: r for r in own.where(F.col("trade_date") == START + dt.timedelta(days=7 * 60)).collect()}
    assert got[1].ret20 == pytest.approx(1.0) and got[2].ret20 == 0 and got[1].ret1 == got[2].ret1 == 0  # the provider's previous close
    m = sector.metrics(own).where(F.col("trade_date") == START + dt.timedelta(days=7 * 60)).first()
    assert m.above20_share == 0.5
    led = {r.symbol: r for r in sector.leaders(own).where(F.col("trade_date") == START + dt.timedelta(days=7 * 60)).collect()}
    assert led[1].excess20 == pytest.approx(0.5) and led[1].trend_quality == 100 and led[2].trend_quality == -100
    flat = regime.breadth(bars(spark, [10.0] * 61)).orderBy(F.desc("trade_date")).first().breadth
    assert regime.breadth(doubled(spark, 61, 60)).orderBy(F.desc("trade_date")).first().breadth > flat


@pytest.mark.parametrize("powers", [800, 40])
def test_recurrences_equal_the_loop(spark, monkeypatch, powers):
    monkeypatch.setattr(recursive, "POWERS", powers)  # 40: several blocks
    rng = random.Random(4)
    closes = [10 + rng.random() * (1 + i % 7) for i in range(300)]
    df = bars(spark, closes)
    x = np.array(closes)
    close = 1e-9
    line, signal, hist = recursive.macd(x)
    pairs = [(recursive.with_emas(df, {"y": ("close", 12)}), {"y": recursive.ema(x, 12)}), (recursive.with_wilder(df), {"rsi14": recursive.rsi_wilder(x)}), (recursive.with_macd(df), {"macd": line, "macd_signal": signal, "macd_hist": hist})]
    for got, expected in pairs:
        for name, want in expected.items():
            own = values(got, name)
            assert all((a is None and math.isnan(b)) or (a is not None and abs(a - b) <= close * max(1, abs(b))) for a, b in zip(own, want, strict=True)), name
    assert values(recursive.with_emas(df, {"y": ("close", 1)}), "y") == closes


def test_panel_shuffles_once_and_runs_no_python(spark):
    plan = recursive.indicator_panel(bars(spark, [1.0 + i % 5 for i in range(40)]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan and "Pandas" not in plan


def by_definition(rows, n, horizon):
    """Members, sessions and amounts looked at one sector and date at a time."""
    days = sorted({d for _, _, d, _ in rows})
    out = {}
    for s in {s for _, s, *_ in rows}:
        for i, day in enumerate(days):
            seen = days[max(0, i - horizon + 1) : i + 1]
            own = {}
            for m, sec, d, x in rows:
                if sec == s and d in seen:
                    own.setdefault(m, {})[d] = x
            own_today = {m: v for m, v in own.items() if day in v}
            if not own_today:
                continue
            comparable = {m: v for m, v in own_today.items() if len(v) > n}
            common = sorted(set.intersection(*map(set, comparable.values()))) if comparable else []
            change = None
            if len(common) > n:
                totals = [sum(v[d] for v in comparable.values()) for d in common[-n - 1 :]]
                change = totals[-1] / (sum(totals[:-1]) / n) - 1
            out[day, s] = (len(comparable), change)
    return out


@pytest.mark.parametrize(("n", "horizon"), [(3, 7), (5, 80), (2, 45)])
def test_turnover_changes_on_common_sessions(spark, n, horizon):
    rng = random.Random(n)
    start = {m: rng.choice([0, 0, 30]) for m in range(12)}
    rows = [(m, m % 3, START + dt.timedelta(days=d), float(rng.randint(1, 99))) for m in range(12) for d in range(100) if d >= start[m] and rng.random() < 0.9]
    own = spark.createDataFrame(rows, "symbol bigint, sector_id int, trade_date date, amount double")
    got = {(r.trade_date, r.sector_id): (r[f"comparable{n}"], r[f"turnover_change{n}"]) for r in sector.turnover_changes(own, (n,), horizon).collect()}
    want = by_definition(rows, n, horizon)
    assert got.keys() == want.keys() and any(x[1] is not None for x in want.values()) and any(x[1] is None for x in want.values())
    for key, (k, change) in want.items():
        assert got[key][0] == k and (change is None) == (got[key][1] is None) and (change is None or got[key][1] == pytest.approx(change)), key
