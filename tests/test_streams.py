"""Sources, sinks and streams on small files."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barline.sources import bars as SB
from barline.streaming import streams as T
from tests.test_operators import bars


def run(df, path, **how):
    q = df.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}/ckpt")
    q = q.foreachBatch(how["each"]) if "each" in how else q.format("parquet").option("path", f"{path}/out").outputMode("append")
    q.start().awaitTermination()


def test_bars_of_closed_days(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1 + i // 4, i % 4), i % 2, float(i)) for i in range(40)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, value double").write.parquet(f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    run(T.stream_bars(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")), tmp_path)
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    batch = sorted(tuple(r) for r in T.stream_bars(spark.read.parquet(f"{tmp_path}/in")).collect())
    assert got and got == [r for r in batch if r[0] <= got[-1][0]] and len(got) >= 10


def test_states_on_a_stream_equal_one_pass(spark, tmp_path):
    rows = [(a, s, t) for a in (1, 2) for s, t in enumerate(["eligible", "triggered", "eligible", "resolved", "suppressed"])]
    spark.createDataFrame(rows, "alert_id bigint, seq bigint, to_state string").coalesce(1).write.parquet(f"{tmp_path}/in")
    table = spark.read.parquet(f"{tmp_path}/in")
    run(T.alert_state(spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in")), tmp_path)
    got, one = (sorted(tuple(r) for r in x.collect()) for x in (spark.read.parquet(f"{tmp_path}/out"), T.alert_state(table)))
    assert got == one and [r[4] for r in one[:5]] == [True, True, False, True, False]


def test_endpoint_opens_at_three_failures_and_closes_on_success(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [(1, i, at(10 * i), f) for i, f in enumerate([True, True, True, True, False, True])]
    got = T.failure_state(spark.createDataFrame(rows, "endpoint bigint, event_id bigint, ts timestamp, failed boolean")).orderBy("ts").collect()
    assert [r.state for r in got] == ["closed", "closed", "open", "open", "closed", "closed"] and [r.failures for r in got] == [1, 2, 3, 4, 0, 1]


def test_states_of_one_alert_with_many_rows_and_of_nulls(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # an alert goes on over batches
    try:
        cycle = ["eligible", "suppressed", None, "resolved"]
        rows = [(a, s, cycle[s % 4]) for a in (1, None) for s in range(100)] + [(2, 0, "error"), (2, 0, "error")]
        df = spark.createDataFrame([(*r, 0) for r in rows], "alert_id bigint, seq bigint, to_state string, state int")
        got = sorted(map(tuple, T.alert_state(df).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    expected, now = [], {}
    for a, s, to in rows:
        ok = to in T.MOVES[now.get(a, "pending")]
        now[a] = to if ok else now.get(a, "pending")
        expected.append((a, s, to, now[a], ok))
    assert got == sorted(expected, key=str)
    assert T.alert_state(df.limit(0)).collect() == []


def test_health_of_equal_times_nulls_and_nothing(spark):
    at = dt.datetime(2024, 1, 1)
    kind = "endpoint bigint, event_id bigint, ts timestamp, failed boolean, state int"
    df = spark.createDataFrame([(e, i, at, f, 0) for e in (1, None) for i, f in enumerate([True, True, True, None, True])], kind)
    got = [(r.endpoint, r.event_id, r.failures, r.state) for r in T.failure_state(df).collect()]
    assert sorted(got, key=str) == sorted([(e, i, n, "open" if n == 3 else "closed") for e in (1, None) for i, n in enumerate([1, 2, 3, 0, 1])], key=str)
    assert T.failure_state(df.limit(0)).collect() == []


def test_endpoint_states_on_a_stream_equal_windows(spark, tmp_path):
    rows = [(e, i, dt.datetime(2024, 1, 1, i), (i * e) % 5 != 0) for e in (1, 2, 3) for i in range(20)]
    spark.createDataFrame(rows, "endpoint bigint, event_id bigint, ts timestamp, failed boolean").coalesce(1).write.parquet(f"{tmp_path}/in")
    table = spark.read.parquet(f"{tmp_path}/in")
    run(T.failure_state(spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in")), tmp_path)
    got, one = (sorted(tuple(r) for r in x.collect()) for x in (spark.read.parquet(f"{tmp_path}/out"), T.failure_state(table)))
    assert got == one and {r[4] for r in one} == {"open", "closed"}


EVENTS = "pool string, endpoint bigint, event_id bigint, ts timestamp, kind string, failed boolean, owner string"


def health(spark, events, **policy):
    """States after events given as (seconds, endpoint, kind, failed, owner), all of one pool."""
    rows = [("p", e, i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s), k, f, o) for i, (s, e, k, f, o) in enumerate(events)]
    return [(r.failures, r.state, r.applied) for r in T.failure_state(spark.createDataFrame(rows, EVENTS), **policy).orderBy("event_id").collect()]


def test_probes_half_open_one_endpoint_of_a_pool(spark):
    policy = {"least": 1, "cool": 60, "lease": 10}
    events = [
        (0, 1, "outcome", True, ""), (0, 2, "outcome", True, ""), (59, 1, "acquire", None, "a"), (60, 1, "acquire", None, "a"), (61, 2, "acquire", None, "b"), (62, 1, "outcome", False, ""), (71, 1, "acquire", None, "b"),
        (72, 1, "probe", False, "a"), (73, 1, "probe", False, "b"), (74, 1, "outcome", True, ""), (134, 1, "acquire", None, "c"), (135, 1, "probe", True, "c"), (194, 1, "acquire", None, "d"), (195, 1, "acquire", None, "d"), (206, 1, "probe", False, "d"), (206, 2, "acquire", None, "e"),
    ]
    assert health(spark, events, **policy) == [
        (1, "open", True), (1, "open", True), (1, "open", False), (1, "half_open", True), (1, "open", False), (1, "half_open", False), (1, "half_open", True),
        (1, "half_open", False), (0, "closed", True), (1, "open", True), (1, "half_open", True), (2, "open", True), (2, "open", False), (2, "half_open", True), (2, "open", False), (1, "half_open", True),
    ]
    late = {**policy, "cool": 61}
    assert health(spark, events[:4], **late)[3] == (1, "open", False)


def test_endpoint_states_on_a_stream_equal_the_table(spark, tmp_path):
    rng = random.Random(1)
    kinds = ["outcome", "outcome", "outcome", "acquire", "probe", None]
    rows = [(f"p{e % 2}", e, i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), rng.choice(kinds), rng.random() < 0.7, rng.choice(["a", "b"])) for i in range(400) for e in [rng.randint(1, 5)]]
    for k in range(4):  # a batch for each file
        spark.createDataFrame(rows[100 * k : 100 * k + 100], EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    table = spark.read.parquet(f"{tmp_path}/in")
    policy = {"cool": 1200.0, "lease": 900.0}
    run(T.failure_state(spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), **policy), tmp_path)
    got, one = (sorted(tuple(r) for r in x.collect()) for x in (spark.read.parquet(f"{tmp_path}/out"), T.failure_state(table, **policy)))
    assert got == one and {r[4] for r in one} == {"open", "closed", "half_open"}
    assert sorted(map(tuple, T.failure_state(table, cool=60.0, lease=900.0).collect())) != one


def test_alerts_and_sessions_happen_once(spark, tmp_path):
    df = spark.createDataFrame([("r", 1, dt.date(2024, 1, 1), 5)] * 2, "rule string, symbol int, trade_date date, v int")
    sink = T.once_per_key(f"{tmp_path}/alerts", ["rule", "symbol", "trade_date"])
    sink(df, 0)
    sink(df, 0)
    assert spark.read.parquet(f"{tmp_path}/alerts").count() == 1

    def broken(_):
        raise RuntimeError("no")

    each = T.on_new_session({"bad": broken, "good": lambda x: x.select("symbol")}, f"{tmp_path}/results", f"{tmp_path}/log")
    each(df, 0)
    each(df, 0)
    log = {(r.task, r.state): r["count"] for r in spark.read.parquet(f"{tmp_path}/log").groupBy("task", "state").count().collect()}
    assert log == {("bad", "failed"): 2, ("good", "done"): 1} and spark.read.parquet(f"{tmp_path}/results/good").count() == 2


def test_factors_move_forward_only(spark, tmp_path):
    kind = "symbol int, effective_date date, back_factor double"
    write = T.forward_factors(f"{tmp_path}/f", f"{tmp_path}/through")
    write(spark.createDataFrame([(1, dt.date(2024, 1, 5), 1.1)], kind), 0)
    write(spark.createDataFrame([(1, dt.date(2024, 1, 2), 1.2), (1, dt.date(2024, 1, 5), 9.9)], kind), 1)
    assert spark.read.parquet(f"{tmp_path}/through").collect()[0][0] == dt.date(2024, 1, 5)
    assert sorted(r.back_factor for r in spark.read.parquet(f"{tmp_path}/f").collect()) == [1.1, 1.2]


def test_sinks_read_the_months_of_their_batch_and_no_others(spark, tmp_path):
    kind = "symbol int, effective_date date, back_factor double"
    day = dt.date
    path, journal = f"{tmp_path}/f", f"{tmp_path}/journal"
    batch = lambda *x: spark.createDataFrame(list(x), kind)
    held = lambda: sorted(tuple(r) for r in spark.read.schema(kind).parquet(path).select("symbol", "effective_date", "back_factor").collect())
    sink = T.once_per_key(path, ["symbol", "effective_date"], "effective_date", journal)
    first = [(1, day(2024, 1, 5), 1.1), (1, day(2024, 2, 5), 1.2)]
    sink(batch(*first), 0)
    (tmp_path / "journal" / "0").unlink()  # killed between its rows and its number
    sink(batch(*first), 0)
    assert held() == first and (tmp_path / "journal" / "0").exists()
    for f in (tmp_path / "f" / "month_of=202401").glob("*.parquet"):  # a batch that read January would fail
        f.write_bytes(b"no parquet")
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    sink(batch((1, day(2024, 2, 5), 9.9), (2, day(2024, 2, 5), 1.3), (1, day(2024, 3, 1), 1.4)), 1)
    sink(batch((1, day(2024, 1, 5), 9.9)), 1)  # a number that is done reads nothing
    with pytest.raises(Exception, match="(?i)parquet"):
        sink(batch((1, day(2024, 1, 5), 9.9)), 2)
    own = spark.read.schema(kind).parquet(path).where("month_of > 202401").select("symbol", "back_factor").collect()
    assert sorted(map(tuple, own)) == [(1, 1.2), (1, 1.4), (2, 1.3)]
    with pytest.raises(ValueError, match="part of the key"):
        T.once_per_key(path, ["symbol"], "effective_date")


def test_through_dates_outlive_a_lost_file(spark, tmp_path):
    kind = "symbol int, effective_date date, back_factor double"
    write = T.forward_factors(f"{tmp_path}/f", f"{tmp_path}/through")
    last = lambda: spark.read.parquet(f"{tmp_path}/through").collect()[0][0]
    write(spark.createDataFrame([], kind), 0)
    assert last() is None
    write(spark.createDataFrame([(1, dt.date(2024, 3, 5), 1.1)], kind), 1)
    (tmp_path / "through" / "_SUCCESS").unlink()  # an overwrite that did not end
    write(spark.createDataFrame([(1, dt.date(2024, 1, 2), 1.2)], kind), 2)
    assert last() == dt.date(2024, 3, 5)


def test_partitions_are_replaced_and_manifests_name_files(spark, tmp_path):
    df = bars(spark, [1.0, 2.0, 3.0, 4.0, 5.0])  # January and February
    SB.write_bars(df, f"{tmp_path}/bars")
    SB.write_bars(df.where("month(trade_date) = 2").withColumn("close", F.lit(9.0)), f"{tmp_path}/bars")
    got = spark.read.schema(df.schema).parquet(f"{tmp_path}/bars")
    assert sorted(r.close for r in got.collect()) == [1.0, 2.0, 3.0, 4.0, 9.0]
    files = [x for x in got.inputFiles()]
    spark.createDataFrame([(f, START_OF[i], "a", 1) for i, f in enumerate(files[:1])], SB.MANIFEST).write.json(f"{tmp_path}/manifest")
    some = SB.read_manifest_bars(spark, f"{tmp_path}/manifest", df.schema)
    assert 0 < some.count() < 5 and SB.manifest_dates(spark, f"{tmp_path}/manifest").count() == 1
    assert SB.read_manifest_bars(spark, f"{tmp_path}/manifest", df.schema, F.lit("2030-01-01").cast("date"), F.lit("2031-01-01").cast("date")).count() == 0


START_OF = [dt.date(1998, 1, 5)]


def test_filters_reach_the_scan(spark, tmp_path):
    bars(spark, [1.0, 2.0]).write.parquet(f"{tmp_path}/b")
    df = SB.read_bars(spark.read.parquet(f"{tmp_path}/b"), F.lit("1998-01-01").cast("date"), F.lit("1998-01-09").cast("date"), [1]).select("symbol", "close")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(trade_date)" in plan and "ReadSchema: struct<symbol:bigint,trade_date:date,close:double>" in plan
