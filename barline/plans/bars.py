"""Queries over bars with their SQL: sources, predicates, windows, rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barline.fixtures import duckdb, table
from barline.functions import predicates as P
from barline.operators import recursive, rules
from barline.operators import windows as W

QUERIES, ORACLE_SQL = {}, {}
DAY = "1998-06-01"
EFF = "eff AS (SELECT *, close * adjust_factor AS sc, high * adjust_factor AS sh, low * adjust_factor AS sl FROM {bars} WHERE NOT is_suspended AND adjust_factor IS NOT NULL AND quality_status = 'ready')"
OVER = "PARTITION BY symbol ORDER BY trade_date"


def query(name: str, sql: str | None):
    """Registers a function of (spark, sf_dir), and its SQL with fixtures in braces."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = duckdb(sql)
        return f

    return add


def r6(x) -> F.Column:
    """Six places; the small shift keeps halves, which engines round either way, on one side."""
    return F.round((F.col(x) if isinstance(x, str) else x) + 1e-9, 6)


def full_sql(n: int, agg: str, last: int = 0) -> str:
    rows = f"ROWS BETWEEN {n - 1 - last} PRECEDING AND {f'{-last} PRECEDING' if last else 'CURRENT ROW'}"
    return f"CASE WHEN count(*) OVER ({OVER} {rows}) = {n} THEN {agg} OVER ({OVER} {rows}) END"


def windowed(name: str, columns: dict, sql: dict[str, str], prepare=None, with_sql: str = ""):
    """A query of windowed columns over effective bars, rounded to six places."""

    def run(spark, sf_dir):
        own = W.effective_bars(table(spark, sf_dir, "bars"))
        own = prepare(own) if prepare else own
        return own.select("symbol", "trade_date", *[r6(c).alias(k) for k, c in columns().items()])

    source = "src" if with_sql else "eff"
    query(name, f"WITH {EFF}{', src AS (' + with_sql + ')' if with_sql else ''}\nSELECT symbol, trade_date, " + ", ".join(f"round(({s}) + 1e-9, 6) AS {k}" for k, s in sql.items()) + f" FROM {source}")(run)


windowed("w1_sma", lambda: {f"sma{n}": W.sma(n) for n in (5, 10, 20, 60, 120, 250)}, {f"sma{n}": full_sql(n, "avg(close)") for n in (5, 10, 20, 60, 120, 250)})
windowed("w5_volume_ratio", lambda: {"ratio": W.volume_ratio(5)}, {"ratio": f"volume / nullif({full_sql(5, 'avg(volume)', -1)}, 0)"})
_D = f"SELECT *, close - lag(close) OVER ({OVER}) AS d FROM eff"
_ROWS14 = f"OVER ({OVER} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)"
windowed(
    "w3_rsi_simple",
    lambda: {"rsi": W.rsi_simple(14)},
    {
        "rsi": f"CASE WHEN count(d) {_ROWS14} = 14 THEN CASE WHEN avg(greatest(d, 0)) {_ROWS14} = 0 AND avg(greatest(-d, 0)) {_ROWS14} = 0 THEN 50 WHEN avg(greatest(-d, 0)) {_ROWS14} = 0 THEN 100 "
        f"ELSE 100 - 100 / (1 + avg(greatest(d, 0)) {_ROWS14} / avg(greatest(-d, 0)) {_ROWS14}) END END"
    },
    W.with_change,
    _D,
)
windowed("w9_period_return", lambda: {f"ret{n}": W.period_return(n, "scaled_close") for n in (5, 20, 60)}, {f"ret{n}": f"sc / lag(sc, {n}) OVER ({OVER}) - 1" for n in (5, 20, 60)}, W.with_scaled)
windowed("w10_daily_return", lambda: {"ret": W.daily_return()}, {"ret": "coalesce(pct_change / 100, CASE WHEN preclose > 0 THEN close / preclose - 1 END)"})
windowed("w11_adjusted_prices", lambda: {x: W.adjusted(x) for x in ("open", "high", "low", "close")}, {x: f"{x} * adjust_factor / last(adjust_factor) OVER ({OVER} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)" for x in ("open", "high", "low", "close")})
_TR = f"SELECT *, CASE WHEN lag(sc) OVER ({OVER}) IS NOT NULL THEN greatest(sh - sl, abs(sh - lag(sc) OVER ({OVER})), abs(sl - lag(sc) OVER ({OVER}))) END AS tr FROM eff"
windowed("w12_atr", lambda: {"atr": "atr"}, {"atr": f"CASE WHEN count(tr) {_ROWS14} = 14 THEN avg(tr) {_ROWS14} END / adjust_factor"}, W.atr, _TR)
windowed("w13_drawdown", lambda: {"drawdown": W.drawdown(), "worst60": W.worst_drawdown(60)}, {
    "drawdown": f"close / max(close) OVER ({OVER} ROWS UNBOUNDED PRECEDING) - 1",
    "worst60": f"CASE WHEN count(*) OVER ({OVER} ROWS 59 PRECEDING) = 60 THEN list_min(list_transform(range(1, 61), lambda i: (list(close) OVER ({OVER} ROWS 59 PRECEDING))[i] / list_max((list(close) OVER ({OVER} ROWS 59 PRECEDING))[1:i]) - 1)) END"})
_RET = f"SELECT *, close / lag(close) OVER ({OVER}) - 1 AS ret FROM eff"
windowed("w14_volatility", lambda: {"vol": W.volatility(20)}, {"vol": f"CASE WHEN count(ret) OVER ({OVER} ROWS 19 PRECEDING) = 20 THEN stddev_pop(ret) OVER ({OVER} ROWS 19 PRECEDING) END"}, lambda b: b.withColumn("ret", W.period_return(1)), _RET)
windowed("w15_bollinger", lambda: dict(zip(("mid", "upper", "lower"), W.bollinger(), strict=True)), {"mid": full_sql(20, "avg(close)"), "upper": f"{full_sql(20, 'avg(close)')} + 2 * {full_sql(20, 'stddev_pop(close)')}", "lower": f"{full_sql(20, 'avg(close)')} - 2 * {full_sql(20, 'stddev_pop(close)')}"})
windowed("w16_zscore", lambda: {"z": W.zscore(20, "amount", W.by())}, {"z": f"CASE WHEN count(*) OVER ({OVER} ROWS 19 PRECEDING) = 20 THEN CASE WHEN stddev_pop(amount) OVER ({OVER} ROWS 19 PRECEDING) > 0 THEN (amount - avg(amount) OVER ({OVER} ROWS 19 PRECEDING)) / stddev_pop(amount) OVER ({OVER} ROWS 19 PRECEDING) ELSE 0 END END"})
windowed("w18_trend_quality", lambda: {"quality": W.ma_trend_quality()}, {"quality": f"list_avg(list_filter([CASE WHEN m20 IS NOT NULL THEN CASE WHEN close > m20 THEN 100 ELSE -100 END END, CASE WHEN m60 IS NOT NULL THEN CASE WHEN close > m60 THEN 100 ELSE -100 END END], lambda x: x IS NOT NULL))"}, None, f"SELECT *, {full_sql(20, 'avg(close)')} AS m20, {full_sql(60, 'avg(close)')} AS m60 FROM eff")

_M = f"SELECT *, {full_sql(5, 'avg(close)')} AS a, {full_sql(20, 'avg(close)')} AS b FROM eff"


@query("w7_crosses", f"WITH {EFF}, m AS ({_M}), c AS (SELECT *, lag(a) OVER ({OVER}) AS pa, lag(b) OVER ({OVER}) AS pb FROM m)\nSELECT symbol, trade_date, pa <= pb AND a > b AS above, pa >= pb AND a < b AS below FROM c WHERE pb IS NOT NULL")
def w7_crosses(spark, d):
    own = W.effective_bars(table(spark, d, "bars")).withColumns({"a": W.sma(5), "b": W.sma(20)})
    own = own.select("symbol", "trade_date", W.crosses_above(F.col("a"), F.col("b")).alias("above"), W.crosses_below(F.col("a"), F.col("b")).alias("below"), F.lag("b").over(W.by()).alias("_p"))
    return own.where("_p IS NOT NULL").drop("_p")


@query("w8_new_high_low", f"WITH {EFF}\nSELECT symbol, trade_date, close >= {full_sql(59, 'max(close)', -1)} AS high60, close <= {full_sql(59, 'min(close)', -1)} AS low60 FROM eff")
def w8_new_high_low(spark, d):
    return W.effective_bars(table(spark, d, "bars")).select("symbol", "trade_date", W.new_high().alias("high60"), W.new_low().alias("low60"))


@query("w17_signed_streak", f"""WITH {EFF}, r AS (SELECT *, sign(close / lag(close) OVER ({OVER}) - 1) AS s FROM eff),
n AS (SELECT *, row_number() OVER ({OVER}) AS k, coalesce(s, 9) <> coalesce(lag(s) OVER ({OVER}), 9) AS changed FROM r),
g AS (SELECT *, max(CASE WHEN changed THEN k END) OVER ({OVER} ROWS UNBOUNDED PRECEDING) AS st FROM n)
SELECT symbol, trade_date, CAST(least(k - st + 1, 20) * s AS DOUBLE) AS streak FROM g""")
def w17_signed_streak(spark, d):
    own = W.effective_bars(table(spark, d, "bars")).withColumn("ret", W.period_return(1))
    return W.with_streak(own, "ret", W.by()).select("symbol", "trade_date", "streak")



def _with_recursive(body: str) -> str:
    """SQL over effective bars numbered by k, with room for a recursive part."""
    numbered = f"eff AS (SELECT symbol, trade_date, close, row_number() OVER ({OVER}) AS k FROM {{bars}} WHERE NOT is_suspended AND adjust_factor IS NOT NULL AND quality_status = 'ready')"
    return duckdb(f"WITH {numbered}, {body}").replace("WITH ", "WITH RECURSIVE ", 1)


def w2_ema(spark, d):
    own = recursive.with_emas(W.effective_bars(table(spark, d, "bars")), {"ema12": ("close", 12)})
    return own.select("symbol", "trade_date", r6("ema12").alias("ema12"))


def w4_rsi_wilder(spark, d):
    own = recursive.with_wilder(W.effective_bars(table(spark, d, "bars")))
    return own.select("symbol", "trade_date", r6("rsi14").alias("rsi14"))


QUERIES |= {"w2_ema": w2_ema, "w4_rsi_wilder": w4_rsi_wilder}
ORACLE_SQL["w2_ema"] = _with_recursive("""e AS (
  SELECT symbol, k, avg(close) OVER (PARTITION BY symbol ORDER BY k ROWS 11 PRECEDING) AS v FROM eff QUALIFY k = 12
  UNION ALL SELECT x.symbol, x.k, e.v + 2.0 / 13 * (x.close - e.v) FROM e JOIN eff x ON x.symbol = e.symbol AND x.k = e.k + 1)
SELECT eff.symbol, trade_date, round(v + 1e-9, 6) AS ema12 FROM eff LEFT JOIN e ON eff.symbol = e.symbol AND eff.k = e.k""")
ORACLE_SQL["w4_rsi_wilder"] = _with_recursive("""d AS (SELECT symbol, k, trade_date, close - lag(close) OVER (PARTITION BY symbol ORDER BY k) AS d FROM eff),
e AS (
  SELECT symbol, k, avg(greatest(d, 0)) OVER w AS g, avg(greatest(-d, 0)) OVER w AS l FROM d WINDOW w AS (PARTITION BY symbol ORDER BY k ROWS 13 PRECEDING) QUALIFY k = 15
  UNION ALL SELECT d.symbol, d.k, (e.g * 13 + greatest(d.d, 0)) / 14, (e.l * 13 + greatest(-d.d, 0)) / 14 FROM e JOIN d ON d.symbol = e.symbol AND d.k = e.k + 1)
SELECT d.symbol, trade_date, round(CASE WHEN g + l > 0 THEN 100 * g / (g + l) WHEN g IS NOT NULL THEN 0 END + 1e-9, 6) AS rsi14 FROM d LEFT JOIN e ON d.symbol = e.symbol AND d.k = e.k""")


@query("w21_indicator_panel", None)
def w21_indicator_panel(spark, d):
    own = recursive.indicator_panel(W.effective_bars(table(spark, d, "bars")))
    return own.select("symbol", "trade_date", *[r6(c).alias(c) for c in own.columns[2:]])


@query("w6_macd", None)
def w6_macd(spark, d):
    own = recursive.with_macd(W.effective_bars(table(spark, d, "bars")))
    return own.select("symbol", "trade_date", *[r6(c).alias(c) for c in ("macd", "macd_signal", "macd_hist")])


ORACLE_SQL["w6_macd"] = _with_recursive("""f AS (
  SELECT symbol, k, avg(close) OVER (PARTITION BY symbol ORDER BY k ROWS 11 PRECEDING) AS a, avg(close) OVER (PARTITION BY symbol ORDER BY k ROWS 25 PRECEDING) AS b FROM eff QUALIFY k = 26
  UNION ALL SELECT x.symbol, x.k, f.a + 2.0 / 13 * (x.close - f.a), f.b + 2.0 / 27 * (x.close - f.b) FROM f JOIN eff x ON x.symbol = f.symbol AND x.k = f.k + 1),
g AS (SELECT symbol, k, a - b AS line FROM f),
e AS (
  SELECT symbol, k, avg(line) OVER (PARTITION BY symbol ORDER BY k ROWS 8 PRECEDING) AS v FROM g QUALIFY k = 34
  UNION ALL SELECT g.symbol, g.k, e.v + 2.0 / 10 * (g.line - e.v) FROM e JOIN g ON g.symbol = e.symbol AND g.k = e.k + 1)
SELECT eff.symbol, trade_date, round(CASE WHEN v IS NOT NULL THEN line END + 1e-9, 6) AS macd, round(v + 1e-9, 6) AS macd_signal, round(line - v + 1e-9, 6) AS macd_hist
FROM eff LEFT JOIN g ON eff.symbol = g.symbol AND eff.k = g.k LEFT JOIN e ON eff.symbol = e.symbol AND eff.k = e.k""")


def _panel() -> str:
    """The means beside the recursive parts of W4 and W6."""
    parts = {}
    for name, of in (("r", "w4_rsi_wilder"), ("m", "w6_macd")):
        parts[name] = ORACLE_SQL[of].replace("WITH RECURSIVE ", "WITH RECURSIVE ", 1)
    means = ", ".join(f"round({full_sql(n, 'avg(close)')} + 1e-9, 6) AS sma{n}" for n in (5, 10, 20, 60, 120, 250))
    joined = f"WITH {EFF}, r AS ({parts['r']}), m AS ({parts['m']})\nSELECT eff.symbol, eff.trade_date, {means}, macd, macd_signal, macd_hist, rsi14 FROM eff JOIN r USING (symbol, trade_date) JOIN m USING (symbol, trade_date)"
    return duckdb(joined.replace(f"OVER ({OVER} ", "OVER (PARTITION BY eff.symbol ORDER BY eff.trade_date "))


ORACLE_SQL["w21_indicator_panel"] = _panel()


_ACCEPT = f"""WITH {EFF}, m AS (SELECT *, {full_sql(5, 'avg(sc)')} AS a, {full_sql(20, 'avg(sc)')} AS b, volume / nullif({full_sql(5, 'avg(volume)', -1)}, 0) AS v FROM eff),
c AS (SELECT *, lag(a) OVER ({OVER}) AS pa, lag(b) OVER ({OVER}) AS pb FROM m),
o AS (SELECT symbol, trade_date, CASE WHEN v IS NULL OR pa IS NULL OR pb IS NULL OR a IS NULL OR b IS NULL THEN 'insufficient' WHEN v > 1 AND pa <= pb AND a > b THEN 'matched' ELSE 'not_matched' END AS outcome FROM c)
"""


@query("screen_acceptance", _ACCEPT + "SELECT symbol, trade_date, outcome FROM o")
def screen_acceptance(spark, d):
    return rules.screen_history(table(spark, d, "bars"), rules.ACCEPTANCE)


_GATE = f"g AS (SELECT a.symbol, CASE WHEN b.symbol IS NULL THEN 'missing' WHEN b.is_suspended THEN 'suspended' WHEN b.adjust_factor IS NULL THEN 'no_factor' WHEN b.quality_status <> 'ready' THEN 'not_ready' ELSE 'ok' END AS gate FROM (SELECT DISTINCT symbol FROM {{bars}}) a LEFT JOIN {{bars}} b ON a.symbol = b.symbol AND b.trade_date = DATE '{DAY}')"


@query("r1_screen", _ACCEPT.rstrip() + f", {_GATE}\nSELECT g.symbol, gate, CASE WHEN gate <> 'ok' THEN 'excluded' ELSE coalesce(outcome, 'insufficient') END AS outcome FROM g LEFT JOIN o ON g.symbol = o.symbol AND o.trade_date = DATE '{DAY}'")
def r1_screen(spark, d):
    return rules.screen(table(spark, d, "bars"), rules.ACCEPTANCE, F.lit(DAY).cast("date"))


@query("p18_signal_gate", f"WITH {_GATE}\nSELECT symbol, gate FROM g")
def p18_signal_gate(spark, d):
    return rules.signal_gate(table(spark, d, "bars"), F.lit(DAY).cast("date"))


@query("r4_scan_many", f"""WITH {EFF}, m AS (SELECT *, {full_sql(20, 'avg(sc)')} / adjust_factor AS b FROM eff)
SELECT 'above' AS rule, symbol, trade_date, CASE WHEN b IS NULL THEN 'insufficient' WHEN close > b THEN 'matched' ELSE 'not_matched' END AS outcome FROM m
UNION ALL SELECT 'not_cheap' AS rule, symbol, trade_date, CASE WHEN NOT close < 1500 THEN 'matched' ELSE 'not_matched' END AS outcome FROM m""")
def r4_scan_many(spark, d):
    own = {"above": {"op": ">", "left": {"field": "close"}, "right": {"sma": 20}}, "not_cheap": {"not": {"op": "<", "left": {"field": "close"}, "right": 1500}}}
    return rules.scan_many(table(spark, d, "bars"), own)


_FIRST = lambda n, last=0: f"first(trade_date) OVER ({OVER} ROWS BETWEEN {n - 1 - last} PRECEDING AND {-last} PRECEDING)" if last else f"first(trade_date) OVER ({OVER} ROWS {n - 1} PRECEDING)"


@query("r3_explain", f"""{_ACCEPT.split("o AS (SELECT")[0]}d AS (SELECT *, adjust_factor AS f, {_FIRST(6)} AS s6, {_FIRST(5)} AS s5, {_FIRST(20)} AS s20, {_FIRST(20, -1)} AS s20p, lag(trade_date) OVER ({OVER}) AS ended FROM c)
SELECT symbol, trade_date, round(v + 1e-9, 6) AS ratio, CASE WHEN v IS NOT NULL THEN s6 END AS ratio_start, v > 1 AS ratio_matched, round(a / f + 1e-9, 6) AS short, CASE WHEN a IS NOT NULL THEN s5 END AS short_start,
round(b / f + 1e-9, 6) AS long, CASE WHEN b IS NOT NULL THEN s20 END AS long_start, round(pb / f + 1e-9, 6) AS long_before, CASE WHEN pb IS NOT NULL THEN s20p END AS long_before_start, ended AS before_end,
pa <= pb AND a > b AS crossed, v > 1 AND pa <= pb AND a > b AS matched FROM d""")
def r3_explain(spark, d):
    t = F.col("tree")
    own = rules.explain(table(spark, d, "bars"), rules.ACCEPTANCE)
    ratio, cross = t.node1, t.node2
    return own.select(
        "symbol", "trade_date", r6(ratio.left.value).alias("ratio"), ratio.left.start.alias("ratio_start"), ratio.matched.alias("ratio_matched"), r6(cross.left.value).alias("short"), cross.left.start.alias("short_start"),
        r6(cross.right.value).alias("long"), cross.right.start.alias("long_start"), r6(cross.right.previous.value).alias("long_before"), cross.right.previous.start.alias("long_before_start"), cross.right.previous.end.alias("before_end"),
        cross.matched.alias("crossed"), t.matched.alias("matched"),
    )


@query("a43_scan_summary", _ACCEPT + "SELECT trade_date, count(*) FILTER (outcome = 'matched') AS matched, count(*) FILTER (outcome = 'not_matched') AS not_matched, count(*) FILTER (outcome = 'insufficient') AS insufficient, CASE WHEN count(*) FILTER (outcome = 'insufficient') = count(*) THEN 'error' WHEN count(*) FILTER (outcome = 'insufficient') > 0 THEN 'partial' ELSE 'completed' END AS state FROM o GROUP BY trade_date")
def a43_scan_summary(spark, d):
    return rules.scan_summary(rules.screen_history(table(spark, d, "bars"), rules.ACCEPTANCE))


# --- predicates ---

_FLAGS = {
    "finite": (lambda: P.is_finite(F.col("pct_change")), "pct_change IS NOT NULL AND isfinite(pct_change)"),
    "usable": (P.usable_bar, "is_trading AND quality_status = 'ready' AND close > 0 AND preclose > 0 AND adjust_factor IS NOT NULL AND amount >= 0 AND security_type = 'stock' AND board = 'main'"),
    "regime": (P.usable_for_regime, "is_trading AND quality_status = 'ready' AND close > 0 AND preclose > 0 AND adjust_factor IS NOT NULL AND amount >= 0"),
    "candidate": (P.return_candidate, "quality_status = 'ready' AND close > 0"),
    "risk_valid": (P.risk_price_valid, "is_trading AND quality_status = 'ready' AND close > 0 AND high >= low"),
    "sane": (P.ohlc_sane, "least(open, high, low, close) > 0 AND high >= greatest(open, high, low, close) AND low <= least(open, high, low, close)"),
}


@query("p1_p8_row_flags", "SELECT symbol, trade_date, " + ", ".join(f"{s} AS {k}" for k, (_, s) in _FLAGS.items()) + " FROM {bars}")
def p1_p8_row_flags(spark, d):
    return table(spark, d, "bars").select("symbol", "trade_date", *[f().alias(k) for k, (f, _) in _FLAGS.items()])


@query("p2_effective_bars", f"WITH {EFF}\nSELECT symbol, trade_date FROM eff WHERE trade_date <= DATE '{DAY}'")
def p2_effective_bars(spark, d):
    return W.effective_bars(table(spark, d, "bars"), F.lit(DAY).cast("date")).select("symbol", "trade_date")


@query("p6_validate_series", "WITH i AS (SELECT symbol, trade_date, CASE WHEN quality_status <> 'ready' THEN 'not_ready' WHEN least(open, high, low, close) <= 0 THEN 'price' WHEN volume < 0 OR amount < 0 THEN 'activity' WHEN adjust_factor IS NULL OR adjust_factor <= 0 THEN 'factor' END AS reason FROM {bars} WHERE NOT is_suspended)\nSELECT symbol, arg_min(reason, trade_date) AS reason, count(reason) AS bad_rows FROM i GROUP BY symbol")
def p6_validate_series(spark, d):
    own = table(spark, d, "bars").where("not is_suspended").withColumn("reason", P.series_issue())
    return own.groupBy("symbol").agg(F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("trade_date"))).alias("reason"), F.count("reason").alias("bad_rows"))


@query("p7_publication_issue", "SELECT symbol, trade_date, CASE WHEN quality_status <> 'ready' THEN 'quality' WHEN is_suspended AND volume > 0 THEN 'suspended_activity' WHEN adjust_factor IS NULL THEN 'missing_factor' WHEN NOT (high >= greatest(open, high, low, close) AND low <= least(open, high, low, close) AND least(open, high, low, close) > 0) THEN 'ohlc' END AS issue FROM {bars}")
def p7_publication_issue(spark, d):
    return table(spark, d, "bars").select("symbol", "trade_date", P.publication_issue().alias("issue"))


_CODES = "SELECT s_suppkey AS id, CASE s_suppkey % 6 WHEN 0 THEN '600' WHEN 1 THEN '000' WHEN 2 THEN '300' WHEN 3 THEN '688' WHEN 4 THEN '900' ELSE '200' END || lpad(CAST(s_suppkey % 1000 AS VARCHAR), 3, '0') AS code FROM supplier"


def _codes(spark, d):
    prefix = F.element_at(F.array(*map(F.lit, ("600", "000", "300", "688", "900", "200"))), (F.col("s_suppkey") % 6 + 1).cast("int"))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(prefix, F.lpad((F.col("s_suppkey") % 1000).cast("string"), 3, "0")).alias("code"))


@query("p9_identity", f"WITH c AS ({_CODES})\nSELECT id, code, CASE WHEN code[1:2] IN ('60', '68', '90') THEN 'sh' ELSE 'sz' END AS exchange, CASE WHEN code[1:2] = '68' THEN 'star' WHEN code[1:2] = '30' THEN 'chinext' WHEN code[1:2] IN ('60', '00') THEN 'main' ELSE 'b_share' END AS board FROM c")
def p9_identity(spark, d):
    return _codes(spark, d).select("id", "code", P.exchange_of(F.col("code")).alias("exchange"), P.board_of(F.col("code")).alias("board"))


@query("p10_normalize_symbol", f"WITH c AS ({_CODES})\nSELECT id, CASE WHEN id % 7 = 0 THEN NULL ELSE CASE WHEN code[1:2] IN ('60', '68', '90') THEN 'sh' ELSE 'sz' END || '.' || code END AS symbol FROM c")
def p10_normalize_symbol(spark, d):
    own = _codes(spark, d).withColumn("ex", P.exchange_of(F.col("code")))
    raw = F.when(F.col("id") % 7 == 0, F.concat(F.col("ex"), F.col("code"))).when(F.col("id") % 2 == 0, F.concat(F.lit(" "), "code", F.lit("."), F.upper("ex"))).otherwise(F.concat("ex", F.lit("."), F.ltrim(F.regexp_replace("code", "^0+", ""))))
    return own.select("id", P.normalize_symbol(raw).alias("symbol"))


@query("p14_session_rows", """WITH b AS (SELECT trade_date, symbol, CASE WHEN symbol % 50 = 0 THEN 'index' ELSE 'stock' END AS kind, is_suspended, quality_status, symbol % 10 = 9 AS again FROM {bars}),
n AS (SELECT *, 1 AS k FROM b UNION ALL SELECT *, 2 AS k FROM b WHERE again),
w AS (SELECT symbol, CASE WHEN k = 2 THEN 'contract:duplicate' WHEN kind = 'index' AND quality_status = 'ready' THEN 'excluded:security_type_index' WHEN kind = 'stock' AND is_suspended THEN 'excluded:canonical_nontrading' WHEN quality_status <> 'ready' THEN 'contract:quality' ELSE 'eligible:' END AS why FROM n)
SELECT symbol, split_part(why, ':', 1) AS verdict, nullif(split_part(why, ':', 2), '') AS reason, count(*) AS n FROM w GROUP BY ALL""")
def p14_session_rows(spark, d):
    """Every fiftieth symbol is an index, every tenth has each row twice; partial rows lack what a suspended row may lack."""
    own = table(spark, d, "bars").withColumn("id", F.col("symbol"))
    own = own.withColumns({"symbol": F.format_string("%s.%06d", "exchange", "symbol"), "security_type": F.when(F.col("id") % 50 == 0, "index").otherwise("stock")})
    own = own.withColumn("quality_issues", F.when(F.col("quality_status") == "partial", F.array(F.lit("suspended_placeholder"), F.lit("missing_adjust_factor"))))
    own = P.classify_session_rows(own.unionByName(own.where("id % 10 = 9")))
    return own.groupBy(F.col("id").alias("symbol"), "verdict", "reason").agg(F.count("*").alias("n"))


@query("p13_p14_classify_session_rows", f"SELECT symbol, exchange || '_main' = CASE WHEN board = 'main' THEN exchange || '_main' ELSE board END AS on_main, CASE WHEN board <> 'main' THEN 'excluded_board' WHEN is_suspended THEN 'excluded_suspended' WHEN adjust_factor IS NULL THEN 'contract_factor' WHEN quality_status <> 'ready' THEN 'contract_quality' ELSE 'eligible' END AS verdict, count(*) AS n FROM {{bars}} GROUP BY ALL")
def p13_p14_classify_session_rows(spark, d):
    own = table(spark, d, "bars").select("symbol", P.scope_board().endswith("_main").alias("on_main"), P.session_verdict().alias("verdict"))
    return own.groupBy("symbol", "on_main", "verdict").agg(F.count("*").alias("n"))
