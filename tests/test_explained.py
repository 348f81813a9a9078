"""Explanation trees, reconciliation and coverage on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barline.operators import joins, quality, rules
from tests.test_operators import START, bars

DAY = dt.timedelta(days=7)


def test_a_tree_has_a_node_for_each_part_of_a_rule(spark):
    df = bars(spark, [10.0, 10.0, 12.0], adjust_factor=lambda i: 2.0 if i == 2 else 1.0)
    rule = {"any": [{"not": {"op": ">", "left": {"sma": 2}, "right": 5}}, {"all": [{"op": "crosses_above", "left": {"field": "close"}, "right": {"ema": 2}}, {"op": ">", "left": {"volume_ratio": 5}, "right": 1}]}]}
    first, second, third = (r.tree for r in rules.explain(df, rule).orderBy("trade_date").collect())
    assert (third.op, third.node1.op, third.node2.op, third.node2.node1.op) == ("any", "not", "all", "crosses_above")
    compared = third.node1.node1
    assert compared.left.asDict() == {"operand": "sma2", "value": (5 + 12) / 2, "start": START + DAY, "end": START + 2 * DAY} and compared.matched and not third.node1.matched
    assert compared.right.asDict() == {"operand": "c5", "value": 5.0}
    cross = third.node2.node1
    assert cross.left.value == 12 and cross.left.previous.value == 5 and cross.left.previous.end == START + DAY
    assert cross.right.previous.value == 5 and cross.right.start == START and cross.right.value == pytest.approx(5 / 3 + 8) and cross.matched
    assert third.node2.node2.left.value is None and third.node2.node2.left.start is None and third.node2.node2.matched is None and third.matched is None
    assert first.node1.node1.left.value is None and first.node1.node1.left.start is None
    assert second.node1.node1.left.start == START
    told = rules.explain(df, rule).select(F.to_json("tree").alias("j")).first().j
    assert '"operand":"volume_ratio5"' in told


def test_each_check_of_a_reconciliation(spark):
    left = bars(spark, [10.0] * 4).unionByName(bars(spark, [10.0] * 4, symbol=2))

    def verdict(right, week=2):
        own = right.withColumns({"volume": F.col("volume") / 100, "amount": F.col("amount") / 1000})
        r = joins.reconcile(left, own).where(F.col("trade_date") == START + week * DAY).first().asDict()
        return {k: v for k, v in r.items() if k not in ("trade_date", "common", "verdict") and v}, r["verdict"]

    at = (F.col("symbol") == 2) & (F.col("trade_date") == START + 2 * DAY)
    put = lambda name, value: left.withColumn(name, F.when(at, value).otherwise(F.col(name)))
    assert verdict(left) == ({}, "passed")
    assert verdict(left, 0) == ({"no_factor": 2}, "unavailable")
    for x in ("open", "high", "low"):
        assert verdict(put(x, F.col(x) + 0.02)) == ({"ohlc_off": 1}, "failed") and verdict(put(x, F.col(x) + 0.01)) == ({}, "passed")
    assert verdict(put("close", F.lit(10.01))) == ({"return_off": 1}, "failed")  # ten basis points, within a tick
    assert verdict(put("volume", F.col("volume") * 1.01)) == ({"volume_off": 1}, "failed")
    assert verdict(put("amount", F.col("amount") * 1.01)) == ({"amount_off": 1}, "failed")
    assert verdict(put("is_suspended", F.lit(True))) == ({"suspension_off": 1}, "failed")
    assert verdict(put("adjust_factor", F.lit(1.001))) == ({"return_off": 1}, "failed")
    assert verdict(put("adjust_factor", F.lit(None).cast("double"))) == ({"no_factor": 1}, "unavailable")
    assert verdict(left.where(~at)) == ({"only_left": 1}, "unavailable")
    assert joins.reconcile(left.limit(0), left.limit(0)).count() == 0


def test_coverage_lists_what_a_session_lacks(spark):
    loaded = spark.createDataFrame([(1, START), (1, START), (3, START), (9, START), (9, START + DAY)], "symbol int, trade_date date")
    got = {r.trade_date: (r.expected, r.loaded, r.failed, r.ratio) for r in quality.coverage(spark.createDataFrame([(1,), (2,), (3,), (3,)], "symbol int"), loaded).collect()}
    assert got == {START: (3, 2, [2], pytest.approx(2 / 3)), START + DAY: (3, 0, [1, 2, 3], 0)}


def test_a_source_qualifies_over_expected_sessions(spark):
    at = lambda k: START + dt.timedelta(days=k)
    calendar = spark.createDataFrame([(at(k), "closed" if k in (2, 9) else "open") for k in range(24)], "trade_date date, status string")
    rows = [(at(k), "failed" if k == 12 else "passed", 1 if k < 18 else 2) for k in range(24) if k not in (2, 5)]  # 9 is observed, though closed
    got = {(r.trade_date - START).days: r.reason for r in quality.qualification_window(spark.createDataFrame(rows, "trade_date date, verdict string, version int"), calendar, 3).collect()}
    expected = {0: "incomplete", 1: "incomplete", 3: None, 4: None, 5: "incomplete", 6: "incomplete", 7: "incomplete", 8: None, 10: "order", 11: "order", 12: "rejected", 13: "rejected", 14: "rejected", 15: None, 16: None, 17: None, 18: "version", 19: "version", 20: None, 21: None, 22: None, 23: None}
    assert got == expected
    plain = quality.qualification_window(spark.createDataFrame([r[:2] for r in rows], "trade_date date, verdict string"), n=3).where("qualified")
    assert {r.consecutive for r in plain.collect()} == {3}
    assert quality.qualification_window(spark.createDataFrame([], "trade_date date, verdict string")).count() == 0


def test_the_last_of_a_batch_wins(spark):
    kind = "k int, at int, v string"
    target, new = spark.createDataFrame([(1, 9, "old"), (2, 9, "kept")], kind), spark.createDataFrame([(1, 1, "b"), (1, 2, "a"), (1, 2, None)], kind)
    assert sorted(map(tuple, quality.upsert(target, new, ["k"], ["at", "v"]).collect())) == [(1, 2, "a"), (2, 9, "kept")]
    assert sorted(map(tuple, quality.upsert(target, new, ["k"]).collect())) == [(1, 2, "a"), (2, 9, "kept")]
