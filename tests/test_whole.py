"""The queries over whole tables: every row that is there is answered for, in agreement with plain loops."""

import datetime as dt

from pyspark.sql import functions as F

import pytest

import __spark_entry__
from barline.fixtures import table

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def market(spark):
    return {n: [r.asDict() for r in table(spark, SMALL, n).collect()] for n in ("bars", "factors", "supplier")}


def rows(spark, name):
    return sorted((tuple(r) for r in __spark_entry__.queries()[name](spark, SMALL).collect()), key=str)


def factor_of(symbol, day, factors):
    own = [f for f in factors if f["symbol"] == symbol and f["effective_date"] <= day]
    base = max((f["effective_date"] for f in own if f["effective_date"].month in (1, 7)), default=None)
    if base is None:
        return None, None
    later = [(f["effective_date"], f["observed_on"], f["back_factor"]) for f in own if f["effective_date"] > base and f["observed_on"] <= day]
    if later:
        return max(later)[2], "daily_event"
    return next(f["back_factor"] for f in own if f["effective_date"] == base), "exact" if base == day else "daily_carry"


def test_factors_of_every_session_of_every_year(spark, market):
    expected = sorted(((b["symbol"], b["trade_date"], *factor_of(b["symbol"], b["trade_date"], market["factors"])) for b in market["bars"]), key=str)
    assert rows(spark, "j2_resolve_factors") == expected and len({x[1].year for x in expected}) == 7


def test_gaps_trusted_sessions_points_and_members_of_all_symbols(spark, market):
    bars, day = market["bars"], dt.date(1998, 6, 1)
    weeks = {dt.date(1994, 12, 5) + dt.timedelta(days=7 * i) for i in range(369)}
    assert rows(spark, "j12_calendar_gaps") == sorted([(x,) for x in weeks - {b["trade_date"] for b in bars}], key=str)
    trusted = {b["trade_date"] for b in bars if b["trade_date"] <= day and b["is_trading"] and b["quality_status"] == "ready" and b["adjust_factor"] is not None and b["board"] == "main"}
    last = sorted(trusted)[-10:]
    assert rows(spark, "s4_last_trusted_sessions") == sorted([(b["symbol"], b["trade_date"]) for b in bars if b["trade_date"] in last], key=str)
    assert rows(spark, "s8_present_points") == sorted([(b["trade_date"], b["symbol"]) for b in bars], key=str)
    assert [x[0] for x in rows(spark, "s21_load_memberships")] == sorted(f"{s['s_suppkey']:06d}" for s in market["supplier"])


def test_sector_measures_need_80_percent_of_the_members(spark):
    from barline.operators import sector

    day = dt.date(1998, 1, 5)
    kind = "trade_date date, sector_id int, symbol bigint, close double, amount double, ret1 double, ret5 double, ret20 double, ret60 double, ma20 double, ma60 double, before5 double"
    days = [day - dt.timedelta(days=k) for k in range(6)]  # the sessions that turnover is compared with
    own = spark.createDataFrame([(x, k, s, 2.0, 10.0, 0.1, 0.1, 0.1, 0.1, 1.0, 1.0, 5.0) for x in days for k, n in ((1, 3), (2, 4)) for s in range(n)], kind)
    target = sector.targets(spark.createDataFrame([(k, s) for k in (1, 2) for s in range(5)], "sector_id int, security_id bigint"))
    got = {r.sector_id: r for r in sector.metrics(own, target).where(F.col("trade_date") == day).collect()}
    assert [got[1][x] for x in ("excess5", "advancing_share", "turnover_change5", "top3_share")] == [None] * 4
    assert None not in tuple(got[2]) and got[2].advancing_share == 1
    led = {(r.sector_id, r.symbol): r for r in sector.leaders(own, target).where(F.col("trade_date") == day).collect()}
    assert led[1, 0].coverage == 0.6 and led[2, 0].coverage == 0.8
    for r in led.values():
        assert sorted(r.passed + r.failed) == sorted(sector.QUALIFIES) and r.qualified == (not r.failed)
