"""Provider rows, session rows, records, calendars and flows on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barline.functions.predicates import board_of, classify_session_rows
from barline.operators import flows
from barline.operators.joins import pit_records
from barline.operators.regime import replay_audit
from barline.sources import bars as SB
from barline.sources.calendar import compose_calendar, market_clock

DAY = dt.date(2024, 1, 5)


def test_boards_follow_exchange_and_three_digits(spark):
    rows = [("600001", "sh", "main"), ("603001", "sh", "main"), ("602001", "sh", "other"), ("689001", "sh", "star"), ("301001", "sz", "chinext"), ("302001", "sz", "other"), ("003001", "sz", "main"), ("900001", "sh", "b_share"), ("430001", "bj", "bse"), ("600001", "sz", "other"), (None, None, "other")]
    got = spark.createDataFrame(rows, "code string, ex string, board string").select("board", board_of(F.col("code"), F.col("ex")).alias("got")).collect()
    assert all(r.board == r.got for r in got)


def test_session_rows_are_eligible_excluded_or_breaches(spark):
    at = dt.datetime(2024, 1, 5, 18)
    base = lambda symbol, **x: {"trade_date": DAY, "symbol": symbol, "exchange": symbol[:2], "security_type": "stock", "is_trading": True, "is_suspended": False, "source": "a", "ingested_at": at, "quality_status": "ready", "quality_issues": None} | x
    out = {"is_trading": False, "is_suspended": True}
    rows = [
        (base("sh.600001"), "eligible", None), (base("sh.600002", ingested_at=at), "eligible", None), (base("sh.600002", ingested_at=at + dt.timedelta(1)), "contract", "duplicate"),
        (base("sh.000001", security_type="index"), "excluded", "security_type_index"), (base("sh.000002", security_type="index", quality_status="partial"), "contract", "quality"),
        (base("sz.000001", **out), "excluded", "canonical_nontrading"), (base("sz.000002", **out, quality_status="partial", quality_issues=["suspended_placeholder", "missing_adjust_factor"]), "excluded", "canonical_nontrading"),
        (base("sz.000003", **out, quality_status="partial", quality_issues=["suspended_placeholder"]), "contract", "quality"), (base("sz.000004", is_suspended=True), "contract", "flags"), (base("sz.000005", is_trading=None), "contract", "flags"),
        (base("sz.000006", exchange="sh"), "contract", "symbol"), (base("bad"), "contract", "symbol"), (base("sz.000007", security_type="etf"), "contract", "security_type"), (base("sz.000008", trade_date=None), "contract", "date"),
    ]
    schema = "trade_date date, symbol string, exchange string, security_type string, is_trading boolean, is_suspended boolean, source string, ingested_at timestamp, quality_status string, quality_issues array<string>"
    got = classify_session_rows(spark.createDataFrame([r for r, _, _ in rows], schema)).select("symbol", "verdict", "reason").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((r["symbol"], v, w)) for r, v, w in rows)


RAW = "date string, code string, adjustflag string, tradestatus string, open string, high string, low string, close string, preclose string, volume string, amount string, turn string, pctChg string, isST string"
FACTORS = "symbol string, effective_date date, back_factor double"


def test_provider_rows_become_bars(spark):
    row = lambda code, status="1", volume="10", flag="3": ("2024-01-05", code, flag, status, "1", "2", "1", "2", "1", volume, volume, "", "", "1")
    factors = spark.createDataFrame([("sh.600001", DAY, 2.0), ("sh.600001", dt.date(2024, 2, 1), 3.0), ("sh.000001", DAY, 9.0)], FACTORS)
    own = SB.provider_bars(spark.createDataFrame([row("SH.600001"), row("sz.300001", "0", ""), row("sz.000002"), row("sh.000001")], RAW), factors, ["sh.000001"])
    got = {r.symbol: r for r in own.collect()}
    a, b, c, i = (got[x] for x in ("sh.600001", "sz.300001", "sz.000002", "sh.000001"))
    assert (a.adjust_factor, a.quality_status, a.board, a.is_st, a.pct_change) == (2.0, "ready", "main", True, None)
    assert (b.volume, b.amount, b.is_trading, b.quality_issues, b.board) == (0.0, 0.0, False, ["suspended_placeholder"], "chinext")
    assert (c.quality_issues, c.quality_status) == (["missing_adjust_factor"], "partial")
    assert (i.security_type, i.board, i.adjust_factor, i.quality_issues) == ("index", "index", None, [])
    for bad in (row("sh.600001", volume=""), row("sh.600001", flag="2")):
        with pytest.raises(Exception, match="no volume|unadjusted"):
            SB.provider_bars(spark.createDataFrame([bad], RAW), factors, []).collect()


def test_records_of_securities_and_components(spark):
    listing = spark.createDataFrame([("sh.600001", "A", "1"), ("sz.399001", "I", "1"), ("sz.000009", "B", "0")], "code string, name string, trade_status string")
    basic = spark.createDataFrame([("sh.600001", "1", DAY, None, "1"), ("sz.399001", "2", DAY, None, "1")], "code string, type string, list_date date, delist_date date, status string")
    got = {r.name: r for r in SB.security_records(listing, basic, F.lit(DAY)).collect()}
    assert [(got[x].board, got[x].security_type, got[x].is_tradable) for x in "AIB"] == [("main", "stock", True), ("index", "index", True), ("other", "other", False)]
    assert got["A"].record_id == "security:2024-01-05:sh.600001" and len({r.lineage_hash for r in got.values()}) == 3
    parts = SB.component_records(spark.createDataFrame([("x", "sh.600001", DAY), ("x", "sh.600002", None)], "index_id string, code string, updated_on date")).collect()
    assert [r.record_id for r in parts] == ["index:x:2024-01-05:sh.600001"]


def test_secondary_status_and_pairs(spark):
    key = "trade_date date, symbol string"
    universe = spark.createDataFrame([(DAY, s, x) for s, x in (("a", "L"), ("b", None), ("c", "d"), ("d", "p"), ("e", "D"), ("f", "L"))], key + ", list_status string")
    daily, out = (spark.createDataFrame([(DAY, s) for s in x], key) for x in ("afe", "bf"))
    assert {r.symbol: r.status for r in SB.secondary_status(universe, daily, out).collect()} == {"a": "traded", "b": "suspended", "c": "not_listed", "d": "missing", "e": "contradiction", "f": "contradiction"}
    factors = spark.createDataFrame([(DAY, "a", 2.0, 1.0), (DAY, "f", 2.0, -1.0)], key + ", adj_factor double, prev_adj_factor double")
    assert {r.symbol: r.proven for r in SB.factor_pairs(daily, factors).collect()} == {"a": True, "f": False, "e": False}


def test_calendar_years_and_the_clock(spark):
    years = lambda *x: spark.createDataFrame(list(x), "year int, closed array<date>")
    days = compose_calendar(years((2023, []), (2024, [dt.date(2024, 1, 1)])), years((2024, [dt.date(2024, 1, 2)])), "2023-12-29", "2025-01-01")
    status = {r.trade_date: r.status for r in days.collect()}
    assert [status[dt.date(*x)] for x in ((2023, 12, 29), (2023, 12, 30), (2024, 1, 1), (2024, 1, 2), (2025, 1, 1))] == ["open", "closed", "open", "closed", "unknown"]
    utc = lambda *x: dt.datetime(*x, tzinfo=dt.UTC)
    times = [utc(2024, 1, 1, 1, 29, 59), utc(2024, 1, 1, 1, 30), utc(2024, 1, 1, 7), utc(2024, 1, 1, 8), utc(2024, 1, 2, 3), utc(2025, 1, 1, 3), utc(2030, 1, 1)]
    got = market_clock(spark.createDataFrame(list(enumerate(times)), "i int, ts timestamp"), "ts", days).orderBy("i").collect()
    friday, monday = dt.date(2023, 12, 29), dt.date(2024, 1, 1)
    assert [r.phase for r in got] == ["pre_market", "market_open", "after_close_waiting", "after_close_waiting", "closed", "calendar_unavailable", "calendar_unavailable"]
    assert [r.expected for r in got] == [friday, friday, friday, monday, monday, None, None]


def test_directions_are_published_only_when_ready(spark):
    metrics = spark.createDataFrame([("a", DAY, 5.0, 0.65), ("b", DAY, -5.0, 0.35), ("c", DAY, 5.0, 0.64), ("d", DAY, None, None), ("e", DAY, 5.0, 0.9)], "scope_name string, trade_date date, sum20 double, positive double")
    stale = spark.createDataFrame([(s, DAY, n) for s, n in (("a", 0), ("b", 0), ("c", 0), ("d", 0), ("e", 2))], "scope_name string, last date, stale bigint")
    got = {r.scope_name: (r.availability, r.direction) for r in flows.flow_report(metrics, stale, F.lit(True)).collect()}
    assert got == {"a": ("ready", "persistent_reported_inflow"), "b": ("ready", "persistent_reported_outflow"), "c": ("ready", "mixed_reported_flow"), "d": ("insufficient_history", None), "e": ("stale", None)}
    assert all(r.direction is None for r in flows.flow_report(metrics, stale, F.lit(False)).collect())


def test_records_of_the_latest_snapshot_and_future_inputs(spark):
    d = lambda n: dt.date(2024, 1, n)
    rows = [(1, d(1), d(1), True, 1, None, None), (1, d(2), d(2), True, 2, None, d(5)), (1, d(2), d(2), True, 3, d(1), d(4)), (1, d(9), d(9), True, 4, None, None)]
    own = spark.createDataFrame(rows, "generation int, snapshot_date date, observed_on date, promoted boolean, security_id int, list_date date, delist_date date")
    assert [r.security_id for r in pit_records(own, F.lit(DAY), F.lit(DAY)).collect()] == [2]
    saved = spark.createDataFrame([(d(1), 1.0, d(1)), (d(2), 2.0, d(3)), (d(3), 3.0, None)], "trade_date date, total double, used date")
    again = spark.createDataFrame([(d(1), 1.0), (d(2), 9.0)], "trade_date date, total double")
    assert tuple(replay_audit(saved, again, latest_input="used").first()) == (1, 1, 1, 1)
