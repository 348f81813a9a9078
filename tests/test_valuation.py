"""Portfolios through time against loops over portfolios and sessions."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from barline.operators import valuation as V
from tests.test_operators import START, bars

DAY = dt.timedelta(days=1)
LEDGER = "portfolio bigint, as_of date, revision int, recorded_on date, cash decimal(18,2), manual_nav decimal(18,2)"
HOLDINGS = "portfolio bigint, as_of date, revision int, symbol bigint, quantity decimal(18,2)"
MEMBERS = "generation int, snapshot_date date, observed_on date, promoted boolean, security_id bigint, list_date date, delist_date date, sector_id int"
STATES = "trade_date date, strategic string, tactical string, degraded boolean, full_scope boolean"


def market(spark, n=40, symbols=(1, 2, 3)):
    """Weekly bars of a few symbols, some suspended, all known on their day."""
    own = None
    for s in symbols:
        one = bars(spark, [10.0 + s + (i * s % 7) / 4 for i in range(n)], symbol=s, is_suspended=lambda i, s=s: i % 11 == s, is_trading=lambda i, s=s: i % 11 != s)
        own = one if own is None else own.unionByName(one)
    return own.withColumn("ingested_at", F.col("trade_date"))


def risk(spark, ledger, holdings, own, members=(), states=(), delay=0):
    made = (spark.createDataFrame(list(x), kind) for x, kind in ((ledger, LEDGER), (holdings, HOLDINGS), (members, MEMBERS), (states, STATES)))
    ledger, holdings, members, states = made
    got = V.portfolio_risk_history(ledger, holdings, own, members, states, delay)
    return {(r.portfolio, r.trade_date): r for r in got.collect()}


@pytest.mark.parametrize("delay", [0, 10])
def test_snapshots_in_force_and_navs_equal_a_loop(spark, delay):
    rng = random.Random(delay)
    own = market(spark)
    price = {(r.symbol, r.trade_date): r.close for r in own.collect() if not r.is_suspended}
    sessions = sorted({r.trade_date for r in own.select("trade_date").distinct().collect()})
    ledger, holdings = [], []
    for p in range(6):
        for _ in range(6):
            day = START + rng.randint(-20, 250) * DAY
            if any(x[:2] == (p, day) for x in ledger):
                continue
            for revision in range(1, rng.randint(1, 3) + 1):
                cash = rng.choice([None, Decimal(rng.randint(-400, 999))])
                ledger.append((p, day, revision, day + rng.randint(-3, 40) * DAY, cash, rng.choice([None, None, Decimal(rng.randint(1, 999))])))
                holdings += [(p, day, revision, s, Decimal(rng.randint(1, 20))) for s in rng.sample([1, 2, 3], rng.randint(0, 3))]
    got = risk(spark, ledger, holdings, own, delay=delay)
    want = {}
    for p in range(6):
        navs = []
        for s in sessions:
            known = [x for x in ledger if x[0] == p and x[1] <= s and x[3] <= s + delay * DAY]
            if not known:
                continue
            _, day, revision, _, cash, stated = max(known, key=lambda x: x[1:3])
            held = [x for x in holdings if x[:3] == (p, day, revision)]
            values = [float(x[4]) * price[x[3], s] for x in held if (x[3], s) in price]
            derived = float(cash) + sum(values) if cash is not None and len(values) == len(held) else None
            nav = float(stated) if stated is not None else derived
            nav = nav if nav is not None and nav > 0 else None
            navs.append(nav)
            have = [x for x in navs if x is not None]
            falls = [x / max(have[: i + 1]) - 1 for i, x in enumerate(have)]
            want[p, s] = (day, revision, nav, len(have), len(navs) - len(have), falls[-1] if falls else None, min(falls, default=None), max(values, default=0) / nav if nav and len(values) == len(held) else None)
    assert got.keys() == want.keys() and len({x[1] for x in want.values()}) > 1
    for key, x in want.items():
        r = got[key]
        mine = (r.as_of, r.revision, r.nav, r.observations, r.unavailable, r.current_drawdown, r.max_drawdown, r.largest)
        for a, b in zip(mine, x, strict=True):
            assert (a is None) == (b is None) and (a is None or (float(a) == pytest.approx(b, abs=2e-6) if isinstance(b, float) else a == b)), (key, mine, x)


def test_a_later_revision_changes_no_earlier_session(spark):
    own = market(spark, 6, (5,))
    first = [(1, START, 1, START, Decimal(100), None)]
    late = [(1, START, 2, START + 21 * DAY, Decimal(50), None)]
    got = risk(spark, first + late, [(1, START, 1, 5, Decimal(2))], own)
    assert [got[1, START + 7 * i * DAY].revision for i in range(6)] == [1, 1, 1, 2, 2, 2]
    assert got[1, START + 21 * DAY].nav == 50 and got[1, START + 21 * DAY].max_drawdown < -0.5  # the fall is from NAVs as they were known
    assert got[1, START].gross > 0 and got[1, START + 35 * DAY].gross == 0 and got[1, START + 35 * DAY].atr_ratio == 0  # no position, no risk
    assert "portfolio_snapshot_stale_for_requested_as_of" in got[1, START + 7 * DAY].issues and got[1, START].issues == []


def test_sectors_follow_the_generation_visible_at_the_session(spark):
    own = market(spark, 4, (5, 6))
    day = lambda i: START + 7 * i * DAY
    members = [(1, day(0), day(0), True, s, None, None, 1) for s in (5, 6)] + [(2, day(1), day(2), True, s, day(0), None, s) for s in (5, 6)]
    members += [(3, day(1), day(1), False, s, None, None, 9) for s in (5, 6)]  # never promoted
    held = [(1, day(0), 1, s, Decimal(1)) for s in (5, 6)]
    got = risk(spark, [(1, day(0), 1, day(0), Decimal(0), None)], held, own, members)
    assert [got[1, day(i)].sector_largest == 1 for i in range(4)] == [True, True, False, False] and 0.5 < got[1, day(2)].sector_largest < 0.6
    assert got[1, day(0)].sector_largest_state == "breach" and got[1, day(0)].mapping_ratio == 1
    gone = [(1, day(0), day(0), True, 5, None, day(1), 1), (1, day(0), day(0), True, 6, None, None, 1)]
    got = risk(spark, [(1, day(0), 1, day(0), Decimal(0), None)], held, own, gone)
    assert got[1, day(1)].mapping_ratio == 1 and got[1, day(2)].mapping_ratio == 0.5 and got[1, day(2)].sector_largest is None
    assert "classification.coverage_95_percent" in got[1, day(2)].missing and "market.regime" in got[1, day(2)].missing


def test_bands_follow_the_state_of_the_session_and_late_bars_have_no_price(spark):
    own = market(spark, 3, (5,))
    day = lambda i: START + 7 * i * DAY
    states = [(day(0), "bull", "risk_on", False, True), (day(1), "bear", "risk_off", True, True)]
    ledger, held = [(1, day(0), 1, day(0), Decimal(5), None)], [(1, day(0), 1, 5, Decimal(1))]
    got = risk(spark, ledger, held, own, (), states)
    assert (got[1, day(0)].lower, got[1, day(0)].upper, got[1, day(0)].band_status, got[1, day(0)].within_band) == (0.6, 0.85, "ready", True)
    assert (got[1, day(1)].lower, got[1, day(1)].upper, got[1, day(1)].band_status) == (0.0, 0.35, "degraded") and "market_regime_degraded" in got[1, day(1)].issues
    assert got[1, day(2)].lower is None and got[1, day(2)].band_status == "unavailable"
    late = own.withColumn("ingested_at", F.date_add("trade_date", 3))
    got = risk(spark, ledger, held, late, (), states, 2)
    assert got[1, day(0)].unpriced == 1 and got[1, day(0)].nav is None and got[1, day(0)].drawdown_state == "unavailable"
    assert risk(spark, ledger, held, late, (), states, 3)[1, day(0)].unpriced == 0


def test_nulls_repeats_and_empty_tables(spark):
    own = market(spark, 3, (5,))
    assert risk(spark, [], [], own) == {} and risk(spark, [(1, START, 1, START, None, None)], [], own.limit(0)) == {}
    row = (1, START, 1, START, Decimal(7), None)
    got = risk(spark, [row, row, (1, None, 1, START, Decimal(1), None), (1, START, 2, None, Decimal(1), None), (2, START, 1, START, Decimal(7), Decimal(9))], [], own)
    assert {(k[0], r.revision, r.nav) for k, r in got.items()} == {(1, 1, 7), (2, 1, 9)} and len(got) == 6
    assert "manual_nav_differs_from_derived_nav" in got[2, START].issues and got[2, START].basis == "manual_nav"


def test_spans_come_to_what_positions_come_to_session_by_session(spark):
    own = market(spark, 70, (1, 2, 3, 4))
    day = lambda i: START + 7 * i * DAY
    # Sectors come, change with a generation inside a year and end; symbol 9 has no quotes at all, 4 has no sector.
    members = [(1, day(0), day(0), True, s, day(2 * s), day(40) if s == 2 else None, 1 + s % 2) for s in (1, 2, 3)] + [(2, day(25), day(30), True, s, None, None, 1) for s in (1, 2, 3)]
    rng = random.Random(7)
    ledger, held = [], []
    for p in range(8):
        for i in range(0, 70, 9 + p):
            ledger.append((p, day(i), 1, day(i), Decimal(rng.randint(-50, 500)), rng.choice([None, None, Decimal(300)])))
            held += [(p, day(i), 1, s, Decimal(rng.randint(1, 30)) * rng.choice([1, 1, -1])) for s in rng.choice([[1], [1, 2], [1, 2, 3], [3, 3, 1], [1, 2, 3, 4], [2, 9], []])]
    ledger, held, members = (spark.createDataFrame(x, k) for x, k in ((ledger, LEDGER), (held, HOLDINGS), (members, MEMBERS)))
    names = ("positions", "unpriced", "unranged", "nav", "basis", "gross", "largest", "sector_largest", "mapping_ratio", "atr_ratio")
    tables = (ledger, held, own, members, 0)
    read = lambda df: {(r.portfolio, r.trade_date): [round(float(r[x]), 6) if isinstance(r[x], (float, Decimal)) else r[x] for x in names] for r in df.collect()}
    got, want = read(V.measures(V.totals_through_time(*tables))), read(V.measures(V.session_totals(V.positions_through_time(*tables))))
    assert got == want and len(want) == 8 * 70
    for x in ("sector_largest", "atr_ratio"):
        assert len({r[names.index(x)] for r in want.values()}) > 20
    assert {r[names.index("mapping_ratio")] for r in want.values()} >= {0.0, 0.5, 1.0}
    states = spark.createDataFrame([], STATES)
    plan = V.portfolio_risk_history(*tables[:4], states)._jdf.queryExecution().executedPlan().toString()
    # No session is a row before its values are there: none is summed, sorted or kept in a window.
    after = plan.split("Exchange hashpartitioning(portfolio")[0]
    assert "Window" in after and not any("trade_date" in line for line in after.splitlines() if any(x in line for x in ("Aggregate(", "Sort [", "Window [")))
