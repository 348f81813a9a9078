"""Rows that only larger tables have, and steps whose cost must not outgrow their input."""

import datetime as dt
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from barline import fixtures as X
from barline.operators import joins as J
from barline.operators import recursive as R
from barline.operators import sector as S
from barline.operators import valuation as V
from barline.operators import windows as W
from barline.plans import flowing, joined, market

DAY = dt.date(1998, 6, 1)


def test_closes_next_to_half_a_cent_are_rounded_as_doubles(spark):
    closes = [(1, 2332.055), (2, 1323.505), (3, 0.125), (4, 1.005), (5, 10.0)]
    bars = spark.createDataFrame([(s, DAY, x, False, "ready") for s, x in closes], "symbol long, trade_date date, close double, is_suspended boolean, quality_status string")
    held = spark.createDataFrame([(1, s, Decimal(10), Decimal(1)) for s, _ in closes], "portfolio long, symbol long, quantity decimal(18,2), cost decimal(18,2)")
    own = {r["symbol"]: (r["close"], r["value"]) for r in J.value_positions(held, bars, F.lit(DAY)).collect()}
    # 2332.055 * 100 is just below a half, 1323.505 * 100 is one.
    assert [str(own[s][0]) for s, _ in closes] == ["2332.05", "1323.51", "0.13", "1.00", "10.00"] and own[1][1] == Decimal("23320.5")


SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bars_are_those_of_their_sql_from_one_layout(spark):
    own = X.table(spark, SMALL, "bars")
    told = spark.sql(X.SQL["bars"], factors=X.table(spark, SMALL, "factors"), lineitem=X.table(spark, SMALL, "lineitem"))
    assert own.columns == told.columns and [f.dataType for f in own.schema] == [f.dataType for f in told.schema]
    assert sorted(map(str, own.collect())) == sorted(map(str, told.collect()))
    once = plan(own.select("symbol", "trade_date", "close"))
    assert once.count("FileScan") == 1 and once.count("Exchange") == 1


def test_long_frames_are_put_together_from_short_ones(spark):
    values = [float((7 * i) % 11) if i % 5 else None for i in range(200)]
    own = spark.createDataFrame([(1, DAY + dt.timedelta(days=i), x) for i, x in enumerate(values)], "symbol long, trade_date date, close double")
    tests = {f"{f.__name__}{n}_{-last}": (f, n, last) for f in (W.full_mean, W.full_max, W.full_min) for n in (1, 5, 7, 14, 20, 59, 60, 120) for last in (0, -1)}
    got = own.select("trade_date", *[f(n, "close", last).alias(k) for k, (f, n, last) in tests.items()])
    assert max(int(x) for x in re.findall(r"RowFrame, -(\d+), currentrow", plan(got))) <= 5
    rows = [r.asDict() for r in got.orderBy("trade_date").collect()]
    for k, (f, n, last) in tests.items():
        value = {"full_mean": lambda v: sum(v) / len(v), "full_max": max, "full_min": min}[f.__name__]
        for i, r in enumerate(rows):
            part = values[max(i + last - n + 1, 0) : i + last + 1]
            part = [x for x in part if x is not None] if len(part) == n else []
            assert r[k] == (pytest.approx(value(part)) if part else None), (k, i)


def test_the_state_of_the_market_reads_bars_that_are_made_once(spark):
    assert "lineitem" not in plan(market.history(spark, SMALL)) and "lineitem" not in plan(market.a32_replay_regime(spark, SMALL))


def test_measures_of_sectors_keep_their_members_and_move_no_row_of_a_past_session(spark):
    own = market.members(spark, SMALL)
    for df in (S.metrics(own), S.ranking(own, market.targets(spark, SMALL), minimum=0.5).select("members"), S.leaders(own)):
        assert "lineitem" not in plan(df) and "LeftSemi" not in plan(df)


def test_members_without_a_sector_are_one(spark):
    rows = [(s, DAY + dt.timedelta(days=7 * i), None if s < 4 else 1, 100.0 + s, 10.0 + s, 0.01 * s, None, None, None, None, None, None) for s in range(1, 7) for i in range(9)]
    own = spark.createDataFrame(rows, "symbol long, trade_date date, sector_id int, amount double, scaled_close double, ret1 double, ret5 double, ret20 double, ret60 double, ma20 double, ma60 double, before20 double")
    assert {(r["sector_id"], r["members"], round(r["top3_share"], 6)) for r in S.metrics(own).collect()} == {(None, 3, 1.0), (1, 3, 1.0)}
    assert {(r["sector_id"], round(r["deviation"], 6)) for r in S.leaders(own).where("symbol in (1, 4)").collect()} == {(None, 0.01), (1, 0.01)}


def test_watched_symbols_and_targets_do_not_pair_customers_with_suppliers_first(spark):
    pairs = X.table(spark, SMALL, "watchlists")
    followers, lists = joined.watchlists(spark, SMALL)
    assert sorted(followers.join(lists, "list").select("portfolio", "symbol").collect()) == sorted(pairs.select("portfolio", "symbol").collect())
    assert {r[0] for r in joined.watched(spark, SMALL).collect()} == {r[0] for r in pairs.select("symbol").distinct().collect()}
    assert "customer" in plan(joined.watched(spark, SMALL)) and "LeftSemi" in plan(joined.e1_required_symbols(spark, SMALL))
    signals = spark.createDataFrame([(s, DAY, "matched") for s in range(0, 10, 2)], "symbol long, trade_date date, outcome string")
    assert sorted(J.list_targets(followers, lists, signals).select("portfolio", "symbol").collect()) == sorted(J.rule_targets(pairs, signals).select("portfolio", "symbol").collect())


def test_positions_through_time_move_by_portfolio_only(spark):
    bars = X.table(spark, SMALL, "bars")
    own = V.measures(V.totals_through_time(X.table(spark, SMALL, "ledger"), X.table(spark, SMALL, "holdings"), bars, X.table(spark, SMALL, "memberships"), 7))
    assert not re.search(r"hashpartitioning\(portfolio#\w+, trade_date", plan(V.with_drawdown(own)))


def test_bars_with_factors_are_laid_out_and_sorted_once(spark):
    own = plan(X.table(spark, SMALL, "bars").select("symbol", "trade_date", "pct_change", "adjust_factor"))
    # Lines and factors move by symbol together; the other exchange is that of the few lines which bring factors.
    assert own.count("Exchange") == 2 and own.count(" Sort ") == 1 and own.count("hashpartitioning(symbol") == 0


def test_rows_of_a_stream_are_made_once_and_filed_twice(spark, tmp_path):
    made = spark.range(20).withColumn("x", F.expr("uuid()"))
    own = flowing._stream_of(spark, made, str(tmp_path / "in"))
    assert own.isStreaming and own.columns == made.columns
    filed = spark.read.schema(made.schema).parquet(str(tmp_path / "in"))
    assert filed.count() == 40 and filed.distinct().count() == 20


def test_what_replaces_a_year_is_made_of_its_files(spark, monkeypatch):
    made = []
    monkeypatch.setattr(flowing, "table", lambda s, d, name, **k: made.append(name) or X.table(s, d, name, **k))
    got = sorted(flowing.s14_replace_partitions(spark, SMALL).collect())
    assert made == ["bars"]
    bars = X.table(spark, SMALL, "bars")
    told = bars.where("year(trade_date) <> 1998").select("symbol", "trade_date", "close").union(bars.where("year(trade_date) = 1998 and not is_suspended").selectExpr("symbol", "trade_date", "-close"))
    assert got == sorted(told.collect())


def test_both_sources_are_made_of_each_bar_once_and_reconciled_without_a_join(spark):
    bars = X.table(spark, SMALL, "bars")
    rows = bars.select(*X.BOTH).collect()
    # Symbols of every edit, and rows that hold nulls.
    rows = [tuple(r) for r in rows] + [(s, *r[1:]) for s in (29, 31, 203, 217) for r in rows if r[0] == 7] + [(62, dt.date(1999, 2, 1), *[None] * 7, None, None)]
    bars = spark.createDataFrame(rows, bars.select(*X.BOTH).schema).cache()
    own = X.both_sources(bars)
    alt = spark.sql(X.SQL["bars_alt"], bars=bars)
    key = lambda r: (str(r["symbol"]), str(r["trade_date"]), str(r))
    assert sorted(own.where("side = 0").select(*X.BOTH).collect(), key=key) == sorted(bars.collect(), key=key)
    assert sorted(own.where("side = 1").select(*alt.columns).collect(), key=key) == sorted(alt.collect(), key=key)
    in_units = own.withColumns({"volume": F.expr("if(side = 1, volume * 100, volume)"), "amount": F.expr("if(side = 1, amount * 1000, amount)")})
    got = {r["trade_date"]: r for r in J.reconcile_sides(in_units).collect()}
    assert got == {r["trade_date"]: r for r in J.reconcile(bars, alt).collect()}
    left, right = ({(r[0], r[1]) for r in df.select("symbol", "trade_date").collect()} for df in (bars, alt))
    for day, r in got.items():
        a, b = ({k for k in keys if k[1] == day} for keys in (left, right))
        assert (r["common"], r["only_left"], r["only_right"]) == (len(a & b), len(a - b), len(b - a))
    once = plan(joined.j10_reconcile(spark, SMALL))
    # One scan for the bars and one for the lines that bring factors; lines move by symbol once, counts by session.
    assert "Join" not in once and once.count("FileScan") == 2 and once.count("hashpartitioning") == 3


def test_rows_of_one_set_only_and_gaps_are_reconciled_as_by_a_join(spark):
    bar = lambda s, week, close=10.0, factor=1.0: (s, DAY + dt.timedelta(days=7 * week), 10.0, 11.0, 9.0, close, 10.0, 100.0, 1000.0, False, factor)
    kinds = "symbol long, trade_date date, open double, high double, low double, close double, preclose double, volume double, amount double, is_suspended boolean, adjust_factor double"
    left = [bar(1, 0), bar(1, 1), bar(1, 3), bar(2, 1, factor=None), bar(2, 2), bar(2, 3), bar(None, 2), bar(4, 3)]
    right = [bar(1, 0), bar(1, 2, factor=2.0), bar(1, 3, 12.0), bar(2, 0), bar(2, 1), bar(2, 2), bar(2, 3), bar(None, 2), bar(3, 1)]
    own = J.reconcile(*[spark.createDataFrame(x, kinds) for x in (left, right)], volume_unit=1, amount_unit=1).orderBy("trade_date")
    got = [tuple(r)[1:5] + (r["ohlc_off"], r["return_off"], r["verdict"]) for r in own.collect()]
    # Week 1: symbol 2 lacks a factor. Week 2: a null symbol meets none; 2 lacks the one before. Week 3: 1 differs by price and return, the latter against each set's own session before.
    assert got == [(1, 0, 1, 1, 0, 0, "unavailable"), (1, 1, 1, 1, 0, 0, "unavailable"), (1, 1, 2, 1, 0, 0, "unavailable"), (2, 1, 0, 0, 1, 1, "unavailable")]


def test_means_that_share_sums_are_those_made_alone(spark):
    values = [1000 / (1 + (7 * i) % 11) if i % 5 else None for i in range(300)] + [None] * 8
    own = spark.createDataFrame([(1, DAY + dt.timedelta(days=i), x) for i, x in enumerate(values)], "symbol long, trade_date date, close double")
    sizes = (1, 5, 6, 7, 10, 14, 20, 59, 60, 120, 250)
    got = W.with_means(own, {f"m{n}": n for n in sizes})
    assert got.columns == [*own.columns, *[f"m{n}" for n in sizes]]
    assert got.drop("close").orderBy("trade_date").collect() == own.select("symbol", "trade_date", *[W.full_mean(n, "close").alias(f"m{n}") for n in sizes]).orderBy("trade_date").collect()


def test_the_panel_sorts_its_bars_once_for_means_and_once_for_all_that_recurs(spark):
    own = plan(R.indicator_panel(spark.createDataFrame([(1, DAY, 1.0)], "symbol long, trade_date date, close double")))
    # Sums of 2 to 5 rows, then those put together from them; sums in blocks and what came before, for the first means and for the signal.
    assert own.count(" Sort [") == 2 and own.count("Exchange") == 1 and own.count(" Window [") <= 9
    assert max(int(x) for x in re.findall(r"RowFrame, -(\d+), currentrow", own)) <= 5


def _looped(values, n, start):
    seen = [x for x in values[max(start - n + 1, 0) : start + 1] if x is not None]
    y, out = sum(seen) / len(seen), [None] * start
    for i in range(start, len(values)):
        y = y if i == start else y * (1 - 2 / (n + 1)) + (values[i] or 0.0) * 2 / (n + 1)
        out.append(y)
    return out


@pytest.mark.parametrize("powers", [800, 40])
def test_seeds_may_lie_in_any_block_and_slow_means_outlast_blocks_of_fast_ones(spark, monkeypatch, powers):
    monkeypatch.setattr(R, "POWERS", powers)  # 40: blocks of 165 rows for 12, 25 for 2, 3465 for 250
    values = [None if i in (3, 175) else 10.0 + (7 * i) % 13 for i in range(320)]
    own = spark.createDataFrame([(1, DAY + dt.timedelta(days=i), x) for i, x in enumerate(values)], "symbol long, trade_date date, close double")
    wanted = {"a": (12, 11), "b": (12, 170), "c": (2, 1), "d": (250, 249), "e": (1, 0)}
    got = R.with_recurrences(own, {k: R.ema_of("close", *x) for k, x in wanted.items()})
    assert got.columns == [*own.columns, *got.columns[3:]] and set(got.columns[3:]) == set(wanted)
    rows = got.orderBy("trade_date").collect()
    for k, x in wanted.items():
        assert [r[k] for r in rows] == [w if w is None else pytest.approx(w, abs=1e-9) for w in _looped(values, *x)], k


def test_targets_of_long_lists_come_follower_by_follower_and_hold_no_side_whole(spark, monkeypatch):
    monkeypatch.setattr(J, "TOLD", 3, raising=False)
    monkeypatch.setattr(J, "TOLD_TO", 2, raising=False)
    followers = spark.createDataFrame([(p, p % 3 if p % 7 else None) for p in range(60)] + [(5, 2), (None, 1)], "portfolio long, list int")
    lists = spark.createDataFrame([(s % 3, s) for s in range(40)] + [(None, 3), (0, 4)], "list int, symbol long")
    signals = spark.createDataFrame([(s, DAY, "matched" if s % 5 else None) for s in range(0, 40, 2)] + [(6, DAY, "again")], "symbol long, trade_date date, outcome string")
    own = J.list_targets(followers, lists, signals)
    assert "Broadcast" not in plan(own).split("SortMergeJoin [list")[0] and "SortMergeJoin [list" in plan(own)
    told = J.rule_targets(followers.join(lists, "list").drop("list"), signals).select("portfolio", "symbol", "trade_date", "outcome")
    assert own.columns == told.columns and sorted(map(str, own.collect())) == sorted(map(str, told.collect()))
    monkeypatch.undo()
    many, one = (spark.range(k).selectExpr("1 AS list", f"id AS {x}") for k, x in ((320, "symbol"), (20, "portfolio")))
    rows = J.list_targets(one, many, many.select("symbol", F.lit("matched").alias("outcome"))).collect()
    # A follower goes on for an array of about 20 symbols; signal by signal, every row has another.
    assert len(rows) == 6400 and sum(a["portfolio"] != b["portfolio"] for a, b in zip(rows, rows[1:], strict=False)) < 640
