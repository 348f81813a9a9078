"""Streams (T1-T6): bars from events, forward-only factors, alerts that fire once, states of alerts and endpoints, new sessions."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

c = F.col


def stream_bars(events: DataFrame, *, lateness: str = "2 days", key: str = "user_id") -> DataFrame:
    """Daily bars per key of an event stream, each once its day is closed; later rows are dropped by the watermark and counted in the query's progress.

    ``ts`` is cast to a timestamp with zone first, which watermarks need; run under a UTC session.
    """
    own = events.withColumn("ts", c("ts").cast("timestamp")).withWatermark("ts", lateness)
    first, last = F.min_by("value", F.struct("ts", "event_id")), F.max_by("value", F.struct("ts", "event_id"))
    bars = own.groupBy(F.window("ts", "1 day"), c(key)).agg(first.alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), last.alias("close"), F.count("*").alias("volume"), F.sum(c("value").cast("decimal(18,2)")).cast("double").alias("amount"))
    return bars.select(F.to_date("window.start").alias("trade_date"), key, "open", "high", "low", "close", "volume", "amount")


def stream_alerts(signals: DataFrame, *, lateness: str = "3 days") -> DataFrame:
    """One alert per (rule, symbol, date), however often it is replayed within the watermark."""
    own = signals.withColumn("ts", c("ts").cast("timestamp")).withWatermark("ts", lateness)
    return own.dropDuplicatesWithinWatermark(["rule", "symbol", "trade_date"])


def _there(spark: SparkSession, path: str) -> bool:
    """Whether a path holds what a finished job wrote."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(own)


def _mark(spark: SparkSession, path: str) -> None:
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(own, True).close()


def _months(df: DataFrame, day: str) -> list[int]:
    """The months (199801 and the like) that a batch has rows of, which the calendar bounds; null days are of month 0."""
    return [r[0] for r in df.select(_month(day).alias("m")).distinct().collect()]


def _month(day: str) -> Column:
    return F.coalesce(F.year(day) * 100 + F.month(day), F.lit(0))


def _of_months(spark: SparkSession, path: str, kind: T.StructType, months: list[int]) -> DataFrame:
    """The rows of some months only; a folder that only empty batches wrote has none."""
    return spark.read.schema(T.StructType([*kind.fields, T.StructField("month_of", T.IntegerType())])).parquet(path).where(c("month_of").isin(months))


def once_per_key(path: str, key: list[str], day: str | None = None, journal: str | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that appends only rows whose key the sink doesn't hold yet; a batch that runs again adds nothing.

    ``day`` names a date column of the key: the sink is laid out by its month (column ``month_of``), and a batch reads the months that it
    has rows of and no other. ``journal`` is a folder of this query's own (as its checkpoint is) that keeps the numbers of finished batches,
    so that one which is sent again reads nothing. A batch that was killed between its rows and its number is checked by keys again.
    Of rows of one key in a batch any one is kept; keys with nulls are never held, so they are appended each time.
    """
    if day is not None and day not in key:
        raise ValueError(f"{day} must be part of the key: a key whose rows lie in two months would be held twice")

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        if journal is not None and _there(spark, f"{journal}/{n}"):
            return
        fresh = batch.dropDuplicates(key)
        if _there(spark, path):
            held = spark.read.schema(batch.schema).parquet(path) if day is None else _of_months(spark, path, batch.schema, _months(batch, day))
            fresh = fresh.join(held.select(*key), key, "left_anti").select(*batch.columns)
        if day is None:
            fresh.write.mode("append").parquet(path)
        else:
            fresh.withColumn("month_of", _month(day)).write.mode("append").partitionBy("month_of").parquet(path)
        if journal is not None:
            _mark(spark, f"{journal}/{n}")

    return write


#: Where an alert may go from each of its states.
MOVES = {
    "pending": ("eligible", "suppressed", "error"), "eligible": ("triggered", "resolved", "suppressed", "error"), "triggered": ("acknowledged", "suppressed", "resolved"),
    "acknowledged": ("suppressed", "resolved"), "suppressed": ("eligible",), "resolved": (), "error": (),
}
_MOVED = T.StructType([T.StructField("alert_id", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("to_state", T.StringType()), T.StructField("state", T.StringType()), T.StructField("accepted", T.BooleanType())])


def _moves(key, rows: pd.DataFrame, state: str) -> tuple[pd.DataFrame, str]:
    out = []
    for seq, to in rows.sort_values(["seq", "to_state"])[["seq", "to_state"]].itertuples(index=False):
        ok = to in MOVES[state]
        state = to if ok else state
        out.append((key, seq, to, state, ok))
    return pd.DataFrame(out, columns=[f.name for f in _MOVED]), state


def alert_state(transitions: DataFrame) -> DataFrame:
    """Each requested move of (alert_id, seq, to_state), whether the machine takes it, and the state after it. Alerts start as pending.

    On a stream the state is kept between batches and rows of a batch are put in order. On a table each partition is read in
    order, a batch at a time, and holds one alert's state: an alert may have any number of rows. Moves to null are not taken.
    """
    if not transitions.isStreaming:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, now = object(), ""
            for b in batches:
                states, taken = [], []
                for key, to in zip(b.column("alert_id").to_pylist(), b.column("to_state").to_pylist(), strict=True):
                    if key != last:
                        last, now = key, "pending"
                    ok = to in MOVES[now]
                    now = to if ok else now
                    states.append(now)
                    taken.append(ok)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(states, pa.string()), pa.array(taken, pa.bool_())], _MOVED.names)

        own = transitions.select(c("alert_id").cast("long").alias("alert_id"), c("seq").cast("long").alias("seq"), c("to_state").cast("string").alias("to_state"))
        return own.repartition("alert_id").sortWithinPartitions("alert_id", "seq", "to_state").mapInArrow(run, _MOVED)

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else "pending"
        out, now = _moves(key[0], pd.concat(list(batches)), now)
        state.update((now,))
        yield out

    return transitions.groupBy("alert_id").applyInPandasWithState(step, _MOVED, "state string", "append", GroupStateTimeout.NoTimeout)


_HEALTH = T.StructType(
    [T.StructField("endpoint", T.LongType()), T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("failures", T.LongType()), T.StructField("state", T.StringType()), T.StructField("applied", T.BooleanType())]
)


class Circuit(NamedTuple):
    """State of an endpoint; times in microseconds, ``owner`` holds the probe until ``until``."""

    state: str = "closed"
    failures: int = 0
    opened: int = 0
    until: int = 0
    owner: str = ""


class Circuits:
    """The circuits of a pool's endpoints that are not closed without a failure, and the policy that moves them."""

    def __init__(self, least: int, cool: float, lease: float, known: str = "{}"):
        self.least, self.cool, self.lease = least, round(cool * 1e6), round(lease * 1e6)
        self.known = {k: Circuit(*v) for k, v in json.loads(known).items()}

    def told(self) -> str:
        return json.dumps(self.known)

    def step(self, endpoint, ts: int, kind: str | None, failed: bool, owner: str) -> tuple[int, str, bool]:
        """Failures, state, and whether the event counted: probes whose lease has ended go back to open first."""
        for k, x in self.known.items():
            if x.state == "half_open" and x.until <= ts:
                self.known[k] = x._replace(state="open", until=0, owner="")
        key, now = str(endpoint), self.known.get(str(endpoint), Circuit())
        after = self._moved(now, ts, kind or "outcome", bool(failed), owner)
        if after == Circuit():
            self.known.pop(key, None)
        elif after is not None:
            self.known[key] = after
        shown = now if after is None else after
        return shown.failures, shown.state, after is not None

    def _moved(self, now: Circuit, ts: int, kind: str, failed: bool, owner: str) -> Circuit | None:
        if kind == "acquire":
            free = all(x.state != "half_open" for x in self.known.values())
            return now._replace(state="half_open", until=ts + self.lease, owner=owner) if free and now.state == "open" and now.opened + self.cool <= ts else None
        if kind == "probe":
            if now.state != "half_open" or now.owner != owner:
                return None
            return Circuit("open", max(now.failures + 1, self.least), ts) if failed else Circuit()
        if kind == "any" and now.state == "open":
            return now._replace(failures=now.failures + 1) if failed else Circuit()
        if kind not in ("outcome", "any") or now.state != "closed":
            return None  # an outcome that comes late does not pass by the probe
        if not failed:
            return Circuit()
        return Circuit("open", now.failures + 1, ts) if now.failures + 1 >= self.least else Circuit("closed", now.failures + 1)


def failure_state(outcomes: DataFrame, *, least: int = 3, cool: float = 900.0, lease: float = 120.0) -> DataFrame:
    """State of an endpoint after each of its events (endpoint, event_id, ts, failed): failures, state, and whether the event counted.

    ``kind`` tells outcomes, requests to probe (acquire) and outcomes of probes (probe) apart; null is an outcome. Without that
    column any event of an open endpoint counts as a probe's: a success closes it, a failure is added. A closed endpoint opens at ``least`` failures in a row and a success resets them. From ``cool``
    seconds after it opened on, a request makes it half_open, for ``lease`` seconds and for its ``owner`` (a column that may be
    missing), if no other endpoint of its ``pool`` (by default the endpoint alone) is half-open. The owner's probe closes it,
    or opens it anew; a lease that ends leaves it open. All other events change nothing: applied is false. Null ``failed``
    counts as a success.

    On a stream the state is kept between batches and rows of a batch are put in order of ts and event_id. On a table each
    partition is read in that order, a batch at a time, and holds the circuits of one pool.
    """
    has = lambda name, default: F.coalesce(c(name).cast("string"), F.lit(default)) if name in outcomes.columns else F.lit(default)
    own = outcomes.select(
        (c("pool") if "pool" in outcomes.columns else c("endpoint")).cast("string").alias("pool"),
        c("endpoint").cast("long").alias("endpoint"),
        c("event_id").cast("long").alias("event_id"),
        c("ts").cast("timestamp").alias("ts"),
        F.unix_micros(c("ts").cast("timestamp")).alias("at"),
        (has("kind", "outcome") if "kind" in outcomes.columns else F.lit("any")).alias("kind"),
        F.coalesce("failed", F.lit(False)).alias("failed"),
        has("owner", "").alias("owner"),
    )
    names = ["endpoint", "at", "kind", "failed", "owner"]
    if not outcomes.isStreaming:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, circuits = object(), None
            for b in batches:
                told = []
                for pool, *event in zip(b.column("pool").to_pylist(), *(b.column(n).to_pylist() for n in names), strict=True):
                    if pool != last:
                        last, circuits = pool, Circuits(least, cool, lease)
                    told.append(circuits.step(*event))
                states = [pa.array([x[i] for x in told], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("endpoint", "event_id", "ts")), *states], _HEALTH.names)

        return own.repartition("pool").sortWithinPartitions("pool", "at", "event_id").mapInArrow(run, _HEALTH)

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        circuits = Circuits(least, cool, lease, *(state.get if state.exists else ()))
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        told = [circuits.step(*event) for event in rows[names].itertuples(index=False)]
        state.update((circuits.told(),))
        out = rows[["endpoint", "event_id", "ts"]].reset_index(drop=True)
        out[["failures", "state", "applied"]] = pd.DataFrame(told, index=out.index)
        yield out

    return own.groupBy("pool").applyInPandasWithState(step, _HEALTH, "circuits string", "append", GroupStateTimeout.NoTimeout)


def forward_factors(target: str, through: str, journal: str | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink of factor events: appends new (symbol, effective_date) rows and moves the through-date forward only.

    The through-date is the later of its last value and the batch's; only where the last one is missing is the target read for it.
    """
    add = once_per_key(target, ["symbol", "effective_date"], "effective_date", journal)

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        last = batch.agg(F.max("effective_date").alias("through_date"))
        if _there(spark, f"{through}/_SUCCESS"):
            before = spark.read.schema(last.schema).parquet(through).first()
            before = before and before[0]
        else:
            before = spark.read.schema(batch.schema).parquet(target).agg(F.max("effective_date")).first()[0] if _there(spark, target) else None
        add(batch, n)
        day = last.first()[0]
        if before is None or (day is not None and day > before) or not _there(spark, f"{through}/_SUCCESS"):
            both = [x for x in (before, day) if x is not None]
            spark.createDataFrame([(max(both, default=None),)], last.schema).coalesce(1).write.mode("overwrite").parquet(through)

    return write


def on_new_session(tasks: dict[str, Callable[[DataFrame], DataFrame]], path: str, log: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` that runs each task once per session; one that fails is logged and doesn't stop the others.

    The log is laid out by month; a batch reads its own months of it, once for all tasks. Sessions without a date are left alone.
    """
    kind = T.StructType([T.StructField("task", T.StringType()), T.StructField("trade_date", T.DateType()), T.StructField("state", T.StringType())])

    def run(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        days = batch.where("trade_date is not null").select("trade_date").distinct()
        asked = {r[0] for r in days.collect()}  # a day each: bounded by the calendar
        done = set()
        if asked and _there(spark, log):
            own = _of_months(spark, log, kind, _months(days, "trade_date")).where("state = 'done'")
            done = {tuple(r) for r in own.join(F.broadcast(days), "trade_date", "left_semi").select("task", "trade_date").distinct().collect()}
        for name, task in tasks.items():
            open_ = sorted(x for x in asked if (name, x) not in done)
            if not open_:
                continue
            todo = spark.createDataFrame([(x,) for x in open_], "trade_date date")
            try:
                task(batch.join(F.broadcast(todo), "trade_date", "left_semi")).write.mode("append").parquet(f"{path}/{name}")
                state = "done"
            except Exception:  # noqa: BLE001 - the log tells; the other tasks go on
                state = "failed"
            told = todo.select(F.lit(name).alias("task"), "trade_date", F.lit(state).alias("state"), _month("trade_date").alias("month_of"))
            told.coalesce(1).write.mode("append").partitionBy("month_of").parquet(log)

    return run


def alert_summary(moves: DataFrame) -> DataFrame:
    """Alerts by their last state (A44): how many wait to be acknowledged, what is wrong with suppressed and failed ones, and the overall status.

    ``moves`` has alert_id, seq and state, and may have ``issues``, an array; the sorted distinct issues of the last move of each
    suppressed or failed alert are told. Empty without alerts, partial with a suppressed or failed one, else ready. One row always.
    """
    issues = c("issues") if "issues" in moves.columns else F.array().cast("array<string>")
    last = moves.groupBy("alert_id").agg(F.max(F.struct("seq", "state", issues.alias("issues"))).alias("_m")).select("_m.*")
    bad = c("state").isin("suppressed", "error")
    # A row each, so that no list of issues gathers more than the distinct ones.
    told = last.where(bad).select(F.explode("issues").alias("issue")).where("issue is not null").distinct().agg(F.array_sort(F.collect_list("issue")).alias("issues"))
    n = last.agg(F.count_if(c("state") == "triggered").alias("unacknowledged"), F.count_if(bad).alias("_bad"), F.count("*").alias("alerts"))
    status = F.when(c("alerts") == 0, "empty").when(c("_bad") > 0, "partial").otherwise("ready")
    return n.crossJoin(F.broadcast(told)).select(status.alias("status"), "unacknowledged", "alerts", "issues")  # a row each
