"""Queries of sources and of the batch forms of streams with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.fixtures import table
from barline.functions.predicates import usable_bar
from barline.operators import flows, recursive
from barline.operators import windows as W
from barline.plans import bars as B
from barline.plans.bars import DAY, query, r6
from barline.sources import bars as SB
from barline.sources.shared import fresh_path
from barline.streaming import streams as T

QUERIES, ORACLE_SQL = B.QUERIES, B.ORACLE_SQL
DAYC = lambda x=DAY: F.lit(x).cast("date")
D = f"DATE '{DAY}'"


@query("s1_read_bars", "SELECT symbol, trade_date, close FROM {bars} WHERE trade_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' AND symbol IN (1, 2, 3, 5, 8) AND source = 'a'")
def s1_read_bars(spark, d):
    return SB.read_bars(table(spark, d, "bars"), DAYC("1997-01-01"), DAYC("1997-12-31"), [1, 2, 3, 5, 8], "a").select("symbol", "trade_date", "close")


@query("s3_last_sessions", f"SELECT symbol, trade_date FROM {{bars}} WHERE trade_date IN (SELECT DISTINCT trade_date FROM {{bars}} WHERE trade_date <= {D} ORDER BY 1 DESC LIMIT 10)")
def s3_last_sessions(spark, d):
    return SB.last_sessions(table(spark, d, "bars"), DAYC(), 10).select("symbol", "trade_date")


@query("s4_last_trusted_sessions", f"SELECT symbol, trade_date FROM {{bars}} WHERE trade_date IN (SELECT DISTINCT trade_date FROM {{bars}} WHERE trade_date <= {D} AND is_trading AND quality_status = 'ready' AND adjust_factor IS NOT NULL AND board = 'main' ORDER BY 1 DESC LIMIT 10)")
def s4_last_trusted_sessions(spark, d):
    return SB.last_sessions(table(spark, d, "bars"), DAYC(), 10, usable_bar()).select("symbol", "trade_date")


@query("s5_available_dates", "SELECT DISTINCT trade_date FROM {bars} WHERE source = 'a'")
def s5_available_dates(spark, d):
    return SB.available_dates(table(spark, d, "bars"), "a")


@query("s7_session_rows", f"SELECT symbol, close, volume, pct_change FROM {{bars}} WHERE trade_date = {D}")
def s7_session_rows(spark, d):
    return table(spark, d, "bars").where(F.col("trade_date") == DAYC()).select("symbol", "close", "volume", "pct_change")


@query("s8_present_points", "SELECT DISTINCT trade_date, symbol FROM {bars}")
def s8_present_points(spark, d):
    own = table(spark, d, "bars")
    return SB.present_points(own, own.select("trade_date").distinct(), own.select("symbol").distinct())


_NUMBERS = ["open", "high", "low", "close", "preclose", "volume", "amount", "pct_change"]


@query("s9_normalize_bars", "SELECT symbol, trade_date, close, CASE WHEN is_suspended THEN 0 ELSE volume END AS volume, CASE WHEN pct_change IS NULL THEN 'no_percent' ELSE '' END AS reasons FROM {bars}")
def s9_normalize_bars(spark, d):
    own = table(spark, d, "bars")
    raw = own.select("symbol", *[F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x) for x in ("trade_date", *_NUMBERS, "is_suspended")])
    return SB.normalize_bars(raw, _NUMBERS).select("symbol", "trade_date", "close", "volume", "reasons")


@query("s10_normalize_secondary", "SELECT symbol, trade_date, round(volume * 100 + 1e-9, 6) AS volume, round(amount * 1000 + 1e-9, 6) AS amount, 'sh.' || lpad(CAST(symbol AS VARCHAR), 6, '0') AS code FROM {bars_alt}")
def s10_normalize_secondary(spark, d):
    own = SB.normalize_secondary(table(spark, d, "bars_alt").withColumn("code", F.concat(F.col("symbol").cast("string"), F.lit(".SH"))))
    return own.select("symbol", "trade_date", r6("volume").alias("volume"), r6("amount").alias("amount"), "code")


_CODE = "CASE symbol % 4 WHEN 0 THEN 'sh.600' WHEN 1 THEN 'sz.300' WHEN 2 THEN 'sz.002' ELSE 'sh.688' END || lpad(CAST(symbol % 1000 AS VARCHAR), 3, '0')"


@query("s9_provider_bars", f"""WITH b AS (SELECT *, symbol IN (7, 14, 21) AS idx FROM {{bars}}), o AS (SELECT b.*, f.back_factor AS f FROM b ASOF LEFT JOIN {{factors}} f ON b.symbol = f.symbol AND b.trade_date >= f.effective_date)
SELECT symbol AS id, trade_date, {_CODE} AS symbol, CASE WHEN idx THEN 'index' ELSE 'stock' END AS security_type, CASE WHEN idx THEN 'index' ELSE ['main', 'chinext', 'main', 'star'][symbol % 4 + 1] END AS board, close, CASE WHEN is_suspended THEN 0 ELSE volume END AS volume,
pct_change, CASE WHEN NOT idx THEN f END AS adjust_factor, is_suspended, CASE WHEN is_suspended THEN 'suspended_placeholder' WHEN NOT idx AND f IS NULL THEN 'missing_adjust_factor' ELSE '' END AS issues FROM o""")
def s9_provider_bars(spark, d):
    """Three symbols are indexes; a suspended row has no activity."""
    code = F.expr(_CODE.replace("VARCHAR", "STRING"))
    own = table(spark, d, "bars")
    text = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(""))
    raw = own.select(
        text("trade_date").alias("date"), F.upper(F.concat(code, F.lit("."), F.col("symbol").cast("string"))).alias("code"), F.lit("3").alias("adjustflag"), F.when(F.col("is_suspended"), "0").otherwise("1").alias("tradestatus"),
        *[text(x).alias(x) for x in ("open", "high", "low", "close", "preclose")], *[F.when(F.col("is_suspended"), "").otherwise(text(x)).alias(x) for x in ("volume", "amount")], F.lit("").alias("turn"), text("pct_change").alias("pctChg"), F.lit("0").alias("isST"),
    )
    # The supplier's number follows the code, so that symbols stay apart at every size of the tables.
    lower = F.lower(F.concat(code, F.lit("."), F.col("symbol").cast("string")))
    factors = table(spark, d, "factors").withColumn("symbol", lower).select("symbol", "effective_date", "back_factor")
    out = SB.provider_bars(raw, factors, ["sh.688007.7", "sz.002014.14", "sz.300021.21"])
    return out.select(F.split_part("symbol", F.lit("."), F.lit(3)).cast("bigint").alias("id"), "trade_date", F.substring("symbol", 1, 9).alias("symbol"), "security_type", "board", "close", "volume", "pct_change", "adjust_factor", "is_suspended", F.array_join("quality_issues", ",").alias("issues"))


@query("s10_secondary_status", """SELECT b.trade_date, b.symbol, CASE WHEN a.symbol IS NOT NULL AND (b.is_suspended OR b.symbol % 37 = 0) THEN 'contradiction' WHEN a.symbol IS NOT NULL THEN 'traded' WHEN b.symbol % 37 = 0 THEN 'not_listed' WHEN b.is_suspended THEN 'suspended' ELSE 'missing' END AS status
FROM {bars} b LEFT JOIN {bars_alt} a ON b.symbol = a.symbol AND b.trade_date = a.trade_date""")
def s10_secondary_status(spark, d):
    own = table(spark, d, "bars")
    universe = own.select("trade_date", "symbol", F.when(F.col("symbol") % 37 == 0, "D").alias("list_status"))
    return SB.secondary_status(universe, table(spark, d, "bars_alt"), own.where("is_suspended"))


@query("s10_factor_pairs", """WITH p AS (SELECT symbol, trade_date, adjust_factor AS f, lag(adjust_factor) OVER (PARTITION BY symbol ORDER BY trade_date) AS g FROM {bars})
SELECT a.symbol, a.trade_date, f AS factor, g AS factor_previous, f IS NOT NULL AND g IS NOT NULL AS proven FROM {bars_alt} a LEFT JOIN p ON a.symbol = p.symbol AND a.trade_date = p.trade_date""")
def s10_factor_pairs(spark, d):
    from pyspark.sql import Window

    before = F.lag("adjust_factor").over(Window.partitionBy("symbol").orderBy("trade_date"))
    factors = table(spark, d, "bars").select("trade_date", "symbol", F.col("adjust_factor").alias("adj_factor"), before.alias("prev_adj_factor"))
    return SB.factor_pairs(table(spark, d, "bars_alt").select("trade_date", "symbol"), factors)


@query("s20_industry_known", f"SELECT DISTINCT lpad(CAST(security_id AS VARCHAR), 6, '0') AS code, sector_id AS sector, list_date AS effective_from FROM {{memberships}} WHERE list_date <= {D} AND observed_on <= {D}")
def s20_industry_known(spark, d):
    raw = table(spark, d, "memberships").select(F.col("security_id").cast("string").alias("code"), F.col("sector_id").alias("sector"), F.col("list_date").alias("effective_from"), F.col("observed_on").alias("updated_on"))
    return SB.load_industry_history(raw, DAYC()).drop("updated_on").distinct()


@query("s21_security_records", f"""WITH s AS (SELECT s_suppkey AS symbol, s_name, s_suppkey % 9 = 0 AS bare, CASE WHEN s_suppkey % 9 = 0 THEN '' WHEN s_suppkey % 10 = 0 THEN '2' ELSE '1' END AS type FROM supplier), t AS (SELECT *, {_CODE} || '.' || symbol AS code FROM s)
SELECT 'security:1998-06-01:' || code AS record_id, s_name AS name, substr(code, 1, 2) AS exchange, CASE type WHEN '' THEN 'other' WHEN '2' THEN 'index' ELSE ['main', 'chinext', 'main', 'star'][symbol % 4 + 1] END AS board, symbol % 5 <> 0 AS is_tradable,
CASE WHEN NOT bare THEN DATE '1990-01-01' + CAST(symbol % 100 AS INTEGER) END AS effective_from, sha256(concat_ws('|', code, s_name, CASE WHEN symbol % 5 <> 0 THEN '1' ELSE '0' END, CASE WHEN bare THEN '' ELSE CAST(DATE '1990-01-01' + CAST(symbol % 100 AS INTEGER) AS VARCHAR) END, '', type, CASE WHEN bare THEN '' ELSE '1' END)) AS lineage_hash FROM t""")
def s21_security_records(spark, d):
    """Every ninth security has no basic row, every tenth other one is an index."""
    own = table(spark, d, "supplier").withColumn("symbol", F.col("s_suppkey"))
    own = own.withColumn("code", F.expr(_CODE.replace("VARCHAR", "STRING") + " || '.' || symbol"))
    listing = own.select("code", F.col("s_name").alias("name"), F.when(F.col("symbol") % 5 != 0, "1").otherwise("0").alias("trade_status"))
    basic = own.where("symbol % 9 <> 0").select("code", F.when(F.col("symbol") % 10 == 0, "2").otherwise("1").alias("type"), F.expr("date_add(DATE '1990-01-01', CAST(symbol % 100 AS INT))").alias("list_date"), F.lit(None).cast("date").alias("delist_date"), F.lit("1").alias("status"))
    return SB.security_records(listing, basic, DAYC()).select("record_id", "name", "exchange", "board", "is_tradable", "effective_from", "lineage_hash")


@query("s21_component_records", "SELECT 'index:' || n_regionkey || ':' || (DATE '1998-01-01' + CAST(s_suppkey % 30 AS INTEGER)) || ':' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS record_id, CAST(n_regionkey AS VARCHAR) AS index_id, DATE '1998-01-01' + CAST(s_suppkey % 30 AS INTEGER) AS effective_from FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 13 <> 0")
def s21_component_records(spark, d):
    """Rows of every thirteenth member have no update date."""
    own = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = own.select(F.col("n_regionkey").cast("string").alias("index_id"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0").alias("code"), F.expr("CASE WHEN s_suppkey % 13 <> 0 THEN date_add(DATE '1998-01-01', CAST(s_suppkey % 30 AS INT)) END").alias("updated_on"))
    return SB.component_records(rows).select("record_id", "index_id", "effective_from")


@query("s18_o3_latest_audits", "SELECT trade_date, requested, loaded FROM {audits} ORDER BY trade_date DESC, loaded DESC LIMIT 5")
def s18_o3_latest_audits(spark, d):
    return SB.latest_audit(table(spark, d, "audits"), 5).select("trade_date", "requested", "loaded")


@query("s20_industry_history", f"SELECT DISTINCT lpad(CAST(security_id AS VARCHAR), 6, '0') AS code, sector_id AS sector, snapshot_date AS effective_from FROM {{memberships}} WHERE snapshot_date <= {D}")
def s20_industry_history(spark, d):
    raw = table(spark, d, "memberships").select(F.col("security_id").cast("string").alias("code"), F.col("sector_id").alias("sector"), F.col("snapshot_date").alias("effective_from"))
    return SB.load_industry_history(raw, DAYC())


@query("s21_load_memberships", "SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code, s_nationkey AS sector, 'member-' || substr(sha256(lpad(CAST(s_suppkey AS VARCHAR), 6, '0') || '|' || s_nationkey), 1, 24) AS record_id FROM supplier")
def s21_load_memberships(spark, d):
    own = table(spark, d, "supplier").select(F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("code"), F.col("s_nationkey").alias("sector"))
    return SB.load_memberships(own.select("code"), own)[0].select("code", "sector", "record_id")


@query("t1_event_bars", "SELECT CAST(ts AS DATE) AS trade_date, user_id, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS amount FROM events GROUP BY ALL")
def t1_event_bars(spark, d):
    return T.stream_bars(table(spark, d, "events"))


_STATES = """WITH RECURSIVE e AS (SELECT user_id AS alert_id, event_id AS seq, ['eligible', 'triggered', 'acknowledged', 'suppressed', 'resolved', 'error'][event_id % 6 + 1] AS to_state, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
r AS (SELECT alert_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS seq, '' AS to_state, 'pending' AS state, false AS accepted FROM e WHERE k = 1
UNION ALL SELECT e.alert_id, e.k, e.seq, e.to_state, CASE WHEN (r.state || '>' || e.to_state) IN ('pending>eligible', 'pending>suppressed', 'pending>error', 'eligible>triggered', 'eligible>resolved', 'eligible>suppressed', 'eligible>error', 'triggered>acknowledged', 'triggered>suppressed', 'triggered>resolved', 'acknowledged>suppressed', 'acknowledged>resolved', 'suppressed>eligible') THEN e.to_state ELSE r.state END,
(r.state || '>' || e.to_state) IN ('pending>eligible', 'pending>suppressed', 'pending>error', 'eligible>triggered', 'eligible>resolved', 'eligible>suppressed', 'eligible>error', 'triggered>acknowledged', 'triggered>suppressed', 'triggered>resolved', 'acknowledged>suppressed', 'acknowledged>resolved', 'suppressed>eligible')
FROM r JOIN e ON e.alert_id = r.alert_id AND e.k = r.k + 1)"""


@query("t4_alert_state", f"{_STATES}\nSELECT alert_id, seq, to_state, state, accepted FROM r WHERE k > 0")
def t4_alert_state(spark, d):
    states = F.array(*map(F.lit, ["eligible", "triggered", "acknowledged", "suppressed", "resolved", "error"]))
    own = table(spark, d, "events").select(F.col("user_id").alias("alert_id"), F.col("event_id").alias("seq"), F.element_at(states, (F.col("event_id") % 6 + 1).cast("int")).alias("to_state"))
    return T.alert_state(own)


@query("a44_alert_summary", f"""{_STATES}, l AS (SELECT arg_max(state, seq) AS state, max(seq) AS seq FROM r WHERE k > 0 GROUP BY alert_id),
i AS (SELECT DISTINCT event_type FROM l JOIN events ON event_id = seq WHERE state IN ('suppressed', 'error'))
SELECT CASE WHEN count(*) = 0 THEN 'empty' WHEN count(*) FILTER (state IN ('suppressed', 'error')) > 0 THEN 'partial' ELSE 'ready' END AS status, count(*) FILTER (state = 'triggered') AS unacknowledged,
count(*) AS alerts, (SELECT coalesce(string_agg('after_' || event_type, ',' ORDER BY event_type), '') FROM i) AS issues FROM l""")
def a44_alert_summary(spark, d):
    """The issue of a move is named by its event's type."""
    why = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.array(F.concat(F.lit("after_"), "event_type")).alias("issues"))
    return T.alert_summary(t4_alert_state(spark, d).join(why, "seq", "left")).withColumn("issues", F.array_join("issues", ","))


_KINDS = "CASE event_type WHEN 'view' THEN 'acquire' WHEN 'purchase' THEN 'probe' WHEN 'signup' THEN 'probe' ELSE 'outcome' END"


def _outcomes(spark, d):
    """Errors and clicks as outcomes, views as requests to probe, purchases as probes that succeed and signups as such that fail."""
    return table(spark, d, "events").select(F.col("user_id").alias("endpoint"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.expr(_KINDS).alias("kind"), F.col("event_type").isin("error", "signup").alias("failed"))


@query("t5_failure_state", None)
def t5_failure_state(spark, d):
    """Events are hours apart, so the cool-down is 6 hours and a lease 24 here."""
    return T.failure_state(_outcomes(spark, d), cool=6 * 3600, lease=24 * 3600).select("endpoint", "event_id", "failures", "state", "applied")


ORACLE_SQL["t5_failure_state"] = f"""WITH RECURSIVE e AS (
  SELECT user_id AS endpoint, event_id, epoch_us(ts) AS t, {_KINDS} AS kind, event_type IN ('error', 'signup') AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
s AS (
  SELECT DISTINCT endpoint, 0::BIGINT AS k, NULL::BIGINT AS event_id, 'closed' AS state, 0::BIGINT AS failures, 0::BIGINT AS opened, 0::BIGINT AS until, false AS applied FROM e
  UNION ALL
  SELECT endpoint, k, event_id, CASE WHEN NOT move THEN was WHEN kind = 'acquire' THEN 'half_open' WHEN NOT failed THEN 'closed' WHEN kind = 'probe' OR failures >= 2 THEN 'open' ELSE 'closed' END,
    CASE WHEN NOT move OR kind = 'acquire' THEN failures WHEN NOT failed THEN 0 WHEN kind = 'probe' THEN greatest(failures + 1, 3) ELSE failures + 1 END,
    CASE WHEN move AND kind <> 'acquire' AND failed THEN t ELSE opened END, CASE WHEN move AND kind = 'acquire' THEN t + 86400000000 ELSE until END, move
  FROM (
    SELECT *, CASE kind WHEN 'acquire' THEN was = 'open' AND opened + 21600000000 <= t WHEN 'probe' THEN was = 'half_open' ELSE was = 'closed' END AS move
    FROM (SELECT e.*, CASE WHEN s.state = 'half_open' AND s.until <= e.t THEN 'open' ELSE s.state END AS was, s.failures, s.opened, s.until FROM s JOIN e ON e.endpoint = s.endpoint AND e.k = s.k + 1)))
SELECT endpoint, event_id, failures, state, applied FROM s WHERE k > 0"""


@query("u1_user_indicator", f"WITH {B.EFF}\nSELECT symbol, trade_date, round(CASE WHEN row_number() OVER ({B.OVER}) > 3 THEN close - lag(close, 3) OVER ({B.OVER}) END + 1e-9, 6) AS momentum FROM eff")
def u1_user_indicator(spark, d):
    import numpy as np

    recursive.register_indicator("momentum3", lambda x: (x - np.concatenate([np.full(min(3, len(x)), np.nan), x[:-3]]),), ("momentum",), 3)
    own = recursive.apply_indicators(W.effective_bars(table(spark, d, "bars")), ["momentum3"])
    return own.select("symbol", "trade_date", r6("momentum").alias("momentum"))


# --- files and streams: written to the shared folder, then read back ---


def _written(spark, d):
    """The bars as partitioned files, and the folder."""
    path = fresh_path(spark, "bars")
    own = table(spark, d, "bars")
    SB.write_bars(own, path)
    return own.schema, path


def _manifest(spark, d):
    """Files of the bars up to the year 2000 in a manifest, which is all that a reader of it may see."""
    schema, path = _written(spark, d)
    SB.file_manifest(spark.read.schema(schema).parquet(path)).where("year(trade_date) <= 2000").write.json(f"{path}-manifest")
    return schema, path, f"{path}-manifest"


@query("s2_read_manifest_bars", "SELECT symbol, trade_date, source, close FROM {bars} WHERE year(trade_date) <= 2000")
def s2_read_manifest_bars(spark, d):
    schema, path, manifest = _manifest(spark, d)
    return SB.read_manifest_bars(spark, manifest, schema, root=path).select("symbol", "trade_date", "source", "close")


@query("s6_manifest_dates", "SELECT DISTINCT trade_date FROM {bars} WHERE year(trade_date) <= 2000")
def s6_manifest_dates(spark, d):
    return SB.manifest_dates(spark, _manifest(spark, d)[2])


@query("s14_replace_partitions", "SELECT symbol, trade_date, close FROM {bars} WHERE year(trade_date) <> 1998\nUNION ALL SELECT symbol, trade_date, -close FROM {bars} WHERE year(trade_date) = 1998 AND NOT is_suspended")
def s14_replace_partitions(spark, d):
    """What replaces a year is made of the year's own files: whole partitions are exchanged when all of it is there."""
    schema, path = _written(spark, d)
    filed = spark.read.schema(f"{schema.toDDL()}, year int, month int").parquet(path)
    SB.write_bars(filed.where("year = 1998 and not is_suspended").withColumn("close", -F.col("close")), path)
    return spark.read.schema(schema).parquet(path).select("symbol", "trade_date", "close")


@query("s15_write_bars", "SELECT symbol, trade_date, source, close, volume, CAST(year(trade_date) AS INTEGER) AS year, CAST(month(trade_date) AS INTEGER) AS month FROM {bars}")
def s15_write_bars(spark, d):
    return spark.read.parquet(_written(spark, d)[1]).select("symbol", "trade_date", "source", "close", "volume", "year", "month")


@query("s19_load_flows", "SELECT trade_date, scope_name, CASE WHEN scope_name <> '2' THEN main_net END AS main_net FROM {flows} WHERE scope_name <> '1' AND trade_date <= DATE '2024-01-20'")
def s19_load_flows(spark, d):
    odd = F.when(F.col("scope_name") == "1", "Infinity").when(F.col("scope_name") == "2", "NaN").otherwise(F.col("main_net").cast("string"))
    raw = table(spark, d, "flows").select(F.col("trade_date").cast("string").alias("trade_date"), "scope_name", odd.alias("main_net"))
    return flows.load_flows(raw, DAYC("2024-01-20"), ["main_net"])[0]


def _run(stream, path, each=None):
    """One run of a stream over all files that are there."""
    q = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}-ckpt")
    q = q.foreachBatch(each) if each else q.format("parquet").option("path", path).outputMode("append")
    q.start().awaitTermination()


def _stream_of(spark, own, path):
    """Rows as a stream of files that hold each of them twice."""
    own.withColumn("_twice", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_twice").write.parquet(path)
    return spark.readStream.schema(own.schema).parquet(path)


@query("t2_stream_factors", "SELECT symbol, effective_date, back_factor FROM {factors}")
def t2_stream_factors(spark, d):
    path, own = fresh_path(spark, "factors"), table(spark, d, "factors").select("symbol", "effective_date", "back_factor")
    _run(_stream_of(spark, own, f"{path}-in"), path, T.forward_factors(path, f"{path}-through", f"{path}-journal"))
    return spark.read.schema(own.schema).parquet(path).select(*own.columns)


@query("t3_stream_alerts", "SELECT 'rise' AS rule, symbol, trade_date FROM {bars} WHERE pct_change > 5")
def t3_stream_alerts(spark, d):
    path = fresh_path(spark, "alerts")
    own = table(spark, d, "bars").where("pct_change > 5").select(F.lit("rise").alias("rule"), "symbol", "trade_date", F.col("trade_date").cast("timestamp").alias("ts"))
    alerts = T.stream_alerts(_stream_of(spark, own, f"{path}-in"))
    _run(alerts, path)
    return spark.read.schema(alerts.schema).parquet(path).select("rule", "symbol", "trade_date")


@query("t6_on_new_session", "SELECT symbol, trade_date, close FROM {bars} WHERE pct_change > 5")
def t6_on_new_session(spark, d):
    path, own = fresh_path(spark, "sessions"), table(spark, d, "bars").select("symbol", "trade_date", "close", "pct_change")
    own.write.parquet(f"{path}-in")
    each = T.on_new_session({"rise": lambda x: x.where("pct_change > 5").select("symbol", "trade_date", "close")}, path, f"{path}-log")

    def twice(batch, n):  # a batch that runs again does nothing
        each(batch, n)
        each(batch, n)

    _run(spark.readStream.schema(own.schema).parquet(f"{path}-in"), path, twice)
    return spark.read.schema("symbol bigint, trade_date date, close double").parquet(f"{path}/rise")
