"""Queries of sectors, the market's state, flows and portfolios with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from barline.fixtures import table
from barline.operators import flows as FL
from barline.operators import joins as J
from barline.operators import portfolio as PF
from barline.operators import quality as Q
from barline.operators import regime as R
from barline.operators import sector as S
from barline.operators import windows as W
from barline.plans import bars as B
from barline.plans.bars import DAY, OVER, full_sql, query, r6
from barline.sources.shared import written

QUERIES, ORACLE_SQL = B.QUERIES, B.ORACLE_SQL
DAYC = lambda: F.lit(DAY).cast("date")
D = f"DATE '{DAY}'"
ret = lambda n: f"close / lag(close, {n}) OVER ({OVER}) - 1"
sret = lambda n: f"sc / lag(sc, {n}) OVER ({OVER}) - 1"
MEMBERS = f"""{B.EFF}, mb AS (SELECT *, CASE WHEN preclose > 0 THEN close / preclose - 1 END AS ret1, {sret(5)} AS ret5, {sret(20)} AS ret20, {sret(60)} AS ret60,
{full_sql(20, 'avg(sc)')} AS ma20, {full_sql(60, 'avg(sc)')} AS ma60, {full_sql(20, 'avg(amount)', -1)} AS before20 FROM eff),
own AS (SELECT mb.*, sector_id FROM mb JOIN {{memberships}} ON symbol = security_id WHERE generation = 3)"""


def members(spark, d):
    return S.member_bars(table(spark, d, "bars"), table(spark, d, "memberships").where("generation = 3"))


def rounded(df, *keep):
    """Doubles to six places."""
    return df.select(*[r6(f.name).alias(f.name) if f.dataType.simpleString() == "double" and f.name not in keep else F.col(f.name) for f in df.schema])


def c6(x: str, name: str) -> str:
    return f"round({x} + 1e-9, 6) AS {name}"


@query("a11_sector_daily_returns", f"WITH {MEMBERS}\nSELECT trade_date, coalesce(sector_id, -1) AS sector_id, {c6('avg(ret1)', 'ret')}, count(ret1) AS members FROM own GROUP BY GROUPING SETS ((trade_date, sector_id), (trade_date))")
def a11_sector_daily_returns(spark, d):
    return rounded(S.daily_returns(members(spark, d))).withColumn("sector_id", F.coalesce("sector_id", F.lit(-1)))


@query("a18_dispersion", f"WITH {MEMBERS}\nSELECT trade_date, {c6('CASE WHEN count(ret1) >= 2 THEN stddev_pop(ret1) END', 'dispersion')} FROM own GROUP BY 1")
def a18_dispersion(spark, d):
    return rounded(S.dispersion(members(spark, d)))




def common_sql(*periods: int) -> str:
    """``tc<n>``: the comparable members of each sector and date, and their turnover against the sessions that all of them have."""
    parts = ["""od AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS o FROM (SELECT DISTINCT trade_date FROM own)),
ob AS (SELECT symbol, sector_id, own.trade_date, o, amount FROM own JOIN od USING (trade_date)),
hz AS (SELECT a.symbol, a.sector_id, a.trade_date, a.o, b.o AS past, b.amount, count(*) OVER (PARTITION BY a.symbol, a.sector_id, a.trade_date) AS sessions
FROM ob a JOIN ob b ON a.symbol = b.symbol AND a.sector_id = b.sector_id AND b.o BETWEEN a.o - 79 AND a.o)"""]
    for n in periods:
        parts.append(f"""nm{n} AS (SELECT sector_id, trade_date, count(DISTINCT symbol) AS comparable FROM hz WHERE sessions > {n} GROUP BY 1, 2),
ds{n} AS (SELECT sector_id, trade_date, o, past, sum(amount) AS t, count(*) AS k FROM hz WHERE sessions > {n} GROUP BY 1, 2, 3, 4),
cm{n} AS (SELECT ds{n}.*, row_number() OVER (PARTITION BY sector_id, trade_date ORDER BY past DESC) AS i FROM ds{n} JOIN nm{n} USING (sector_id, trade_date) WHERE k = comparable),
ch{n} AS (SELECT sector_id, trade_date, sum(t) FILTER (i = 1) / nullif(sum(t) FILTER (i > 1) / {n}, 0) - 1 AS change FROM cm{n} WHERE i <= {n + 1} GROUP BY 1, 2 HAVING count(*) = {n + 1}),
tc{n} AS (SELECT sector_id, trade_date, comparable AS comparable{n}, change AS change{n} FROM nm{n} LEFT JOIN ch{n} USING (sector_id, trade_date))""")
    return ",\n".join(parts)


_TWO = lambda x, n: f"CASE WHEN count({n}) >= 2 THEN {x} END"
METRICS = f"""{MEMBERS}, {common_sql(5)}, mk AS (SELECT trade_date, avg(ret5) AS m5, avg(ret20) AS m20, avg(ret60) AS m60 FROM own GROUP BY 1),
nn AS (SELECT *, row_number() OVER (PARTITION BY trade_date, sector_id ORDER BY amount DESC, symbol) AS n FROM own),
sm AS (SELECT trade_date, sector_id, count(*) AS members, {_TWO('avg(ret5)', 'ret5')} AS s5, {_TWO('avg(ret20)', 'ret20')} AS s20, {_TWO('avg(ret60)', 'ret60')} AS s60,
{_TWO('avg(CAST(ret1 > 0 AS DOUBLE))', 'ret1')} AS advancing_share, {_TWO('avg(CAST(sc > ma20 AS DOUBLE))', 'ma20')} AS above20_share, CASE WHEN count(*) >= 3 THEN sum(CASE WHEN n <= 3 THEN amount END) / sum(amount) END AS top3_share, 1 AS target FROM nn GROUP BY 1, 2),
mt AS (SELECT trade_date, sector_id, members, s5 - m5 AS excess5, s20 - m20 AS excess20, s60 - m60 AS excess60, advancing_share, above20_share, CASE WHEN comparable5 >= 2 THEN change5 END AS turnover_change5, top3_share
FROM sm JOIN mk USING (trade_date) LEFT JOIN tc5 USING (sector_id, trade_date))"""
_NAMES = ("excess5", "excess20", "excess60", "advancing_share", "above20_share", "turnover_change5", "top3_share")


@query("a12_a15_sector_metrics", f"WITH {METRICS}\nSELECT trade_date, sector_id, members, " + ", ".join(c6(n, n) for n in _NAMES) + " FROM mt")
def a12_a15_sector_metrics(spark, d):
    return rounded(S.metrics(members(spark, d)))


def clamped(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN greatest(least({x}, 100), -100) END"


def total(weights: dict[str, float]) -> str:
    used = " + ".join(f"CASE WHEN {n} IS NOT NULL THEN {w} ELSE 0 END" for n, w in weights.items())
    return f"CASE WHEN {used} > 0 THEN ({' + '.join(f'coalesce({n} * {w}, 0)' for n, w in weights.items())}) / CAST({used} AS DOUBLE) END"


_LEADER = {"tradability": 0.10, "relative_strength_5d": 0.10, "relative_strength_20d": 0.15, "relative_strength_60d": 0.15, "trading_activity_20d": 0.10, "trend_quality": 0.15, "sector_contribution_20d": 0.10, "persistence_days": 0.10, "dispersion_consistency": 0.05}
_SECTOR = {"relative_strength_5d": 0.08, "relative_strength_20d": 0.12, "relative_strength_60d": 0.12, "advancing_breadth": 0.08, "above_ma20_breadth": 0.08, "above_ma60_breadth": 0.08, "turnover_change_5d": 0.04, "turnover_change_20d": 0.04, "turnover_concentration_top3": 0.04, "persistence_days": 0.08, "cross_section_dispersion": 0.04, "leader_count": 0.05, "leader_diffusion": 0.10, "leader_persistence_days": 0.05}
_GOOD = lambda x, a, b: f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} <= {a} THEN 100.0 WHEN {x} >= {b} THEN -100.0 ELSE 100 - 200 * ({x} - {a}) / CAST({b} - {a} AS DOUBLE) END"


def streaks(name: str, source: str, by: str, x: str) -> str:
    """Tables that add ``streak``, the signed and capped run of the sign of ``x``, to ``source``."""
    w = f"PARTITION BY {by} ORDER BY trade_date"
    return f"""{name}1 AS (SELECT *, sign({x}) AS sg, row_number() OVER ({w}) AS k FROM {source}), {name}2 AS (SELECT *, coalesce(sg, 9) <> coalesce(lag(sg) OVER ({w}), 9) AS changed FROM {name}1),
{name}3 AS (SELECT *, max(CASE WHEN changed THEN k END) OVER ({w} ROWS UNBOUNDED PRECEDING) AS st FROM {name}2), {name} AS (SELECT *, CAST(least(k - st + 1, 20) * sg AS DOUBLE) AS streak FROM {name}3)"""


LED = f"""{MEMBERS}, lw AS (SELECT *, ret5 - avg(ret5) OVER d AS excess5, ret20 - avg(ret20) OVER d AS excess20, ret60 - avg(ret60) OVER d AS excess60, ret1 - avg(ret1) OVER s AS spread, ret20 / count(ret20) OVER s AS contribution,
CASE WHEN before20 > 0 THEN amount / before20 END AS activity FROM own WINDOW d AS (PARTITION BY trade_date), s AS (PARTITION BY trade_date, sector_id)),
{streaks('lk', 'lw', 'symbol', 'spread')},
ls AS (SELECT trade_date, sector_id, symbol, 100.0 AS tradability, {clamped('(excess5 * 1000)')} AS relative_strength_5d, {clamped('(excess20 * 1000)')} AS relative_strength_20d, {clamped('(excess60 * 1000)')} AS relative_strength_60d, {clamped('((activity - 1) * 100)')} AS trading_activity_20d,
list_avg(list_filter([CASE WHEN ma20 IS NOT NULL THEN CASE WHEN sc > ma20 THEN 100 ELSE -100 END END, CASE WHEN ma60 IS NOT NULL THEN CASE WHEN sc > ma60 THEN 100 ELSE -100 END END], lambda x: x IS NOT NULL)) AS trend_quality,
{clamped('(contribution * 1000)')} AS sector_contribution_20d, {clamped('(streak * 5)')} AS persistence_days, {_GOOD('abs(spread)', 0.015, 0.04)} AS dispersion_consistency, excess20, activity, contribution, streak AS persistence, abs(spread) AS deviation FROM lk),
lt AS (SELECT *, round({total(_LEADER)} + 1e-9, 6) AS total, [excess20 > 0, activity >= 1, trend_quality > 0, contribution > 0] AS tests FROM ls),
lq AS (SELECT *, list_count(list_filter(tests, lambda x: x)) = 4 AS qualified FROM lt),
ld AS (SELECT trade_date, sector_id, count(*) AS candidates, count(*) FILTER (qualified) AS leaders, avg(CAST(qualified AS DOUBLE)) AS share, avg(CASE WHEN qualified THEN persistence END) AS lead FROM lq GROUP BY 1, 2)"""


def ranked_sql(minimum: float) -> str:
    counts = ("ret1", "ret5", "ret20", "ret60", "ma20", "ma60")
    scores = {
        "relative_strength_5d": ("c_ret5", clamped("((s5 - m5) * 1000)")), "relative_strength_20d": ("c_ret20", clamped("((s20 - m20) * 1000)")), "relative_strength_60d": ("c_ret60", clamped("((s60 - m60) * 1000)")),
        "advancing_breadth": ("c_ret1", clamped("((adv - 0.5) * 200)")), "above_ma20_breadth": ("c_ma20", clamped("((above20 - 0.5) * 200)")), "above_ma60_breadth": ("c_ma60", clamped("((above60 - 0.5) * 200)")),
        "turnover_change_5d": ("comparable5", clamped("(change5 * 100)")), "turnover_change_20d": ("comparable20", clamped("(change20 * 100)")), "turnover_concentration_top3": ("members", clamped("((0.75 - top3) * 200)")),
        "persistence_days": ("c_ret1", clamped("(streak * 5)")), "cross_section_dispersion": ("c_ret1", _GOOD("disp", 0.015, 0.04)), "leader_count": ("candidates", clamped("((leaders - 1) * 50)")),
        "leader_diffusion": ("candidates", clamped("((share - 0.5) * 200)")), "leader_persistence_days": ("candidates", clamped("(lead * 5)")),
    }
    ok = lambda n: f"({n} >= 2 AND {n} / target >= CAST({minimum} AS DOUBLE))"
    every = " AND ".join(ok(n) for n in dict.fromkeys(n for n, _ in scores.values()))
    return f"""WITH {LED}, {common_sql(5, 20)}, nn AS (SELECT *, row_number() OVER (PARTITION BY trade_date, sector_id ORDER BY amount DESC, symbol) AS n FROM own),
sd AS (SELECT trade_date, sector_id, count(*) AS members, avg(ret1) AS s1, avg(ret5) AS s5, avg(ret20) AS s20, avg(ret60) AS s60, {', '.join(f'count({x}) AS c_{x}' for x in counts)}, avg(CAST(ret1 > 0 AS DOUBLE)) AS adv,
avg(CAST(sc > ma20 AS DOUBLE)) AS above20, avg(CAST(sc > ma60 AS DOUBLE)) AS above60, sum(CASE WHEN n <= 3 THEN amount END) / sum(amount) AS top3, CASE WHEN count(ret1) >= 2 THEN stddev_pop(ret1) END AS disp FROM nn GROUP BY 1, 2),
dm AS (SELECT trade_date, avg(ret1) AS m1, avg(ret5) AS m5, avg(ret20) AS m20, avg(ret60) AS m60 FROM own GROUP BY 1),
tg AS (SELECT sector_id, count(DISTINCT security_id) AS target FROM {{memberships}} WHERE generation = 3 GROUP BY 1),
sj AS (SELECT * EXCLUDE (comparable5, comparable20), coalesce(comparable5, 0) AS comparable5, coalesce(comparable20, 0) AS comparable20, s1 - m1 AS sector_spread
FROM sd JOIN dm USING (trade_date) JOIN ld USING (trade_date, sector_id) LEFT JOIN tc5 USING (trade_date, sector_id) LEFT JOIN tc20 USING (trade_date, sector_id) JOIN tg USING (sector_id)), {streaks('sk', 'sj', 'sector_id', 'sector_spread')},
sc AS (SELECT trade_date, sector_id, members, target, {every} AS horizon, {', '.join(f'CASE WHEN {ok(n)} THEN {x} END AS {k}' for k, (n, x) in scores.items())} FROM sk),
se AS (SELECT *, array_to_string(list_filter([CASE WHEN NOT {ok('members').split(' AND ')[1][:-1]} THEN 'insufficient_comparable_member_coverage' END, CASE WHEN NOT horizon THEN 'insufficient_horizon_member_coverage' END, CASE WHEN members < 2 THEN 'insufficient_priced_members' END], lambda x: x IS NOT NULL), ',') AS reasons FROM sc),
st AS (SELECT *, CASE WHEN reasons = '' THEN round({total(_SECTOR)} + 1e-9, 6) END AS total FROM se)
SELECT trade_date, sector_id, members, reasons, total, CAST(row_number() OVER (PARTITION BY trade_date ORDER BY total DESC NULLS LAST, sector_id) AS INTEGER) AS rank FROM st"""


def _ranked(spark, d, **policy):
    own = S.ranking(members(spark, d), targets(spark, d), **policy).withColumn("total", r6("total"))
    own = S.rank_by(own, "total", "sector_id", "trade_date")
    return own.select("trade_date", "sector_id", "members", F.array_join("reasons", ",").alias("reasons"), "total", "rank")


@query("a21_sector_ranking", ranked_sql(0.8))
def a21_sector_ranking(spark, d):
    return _ranked(spark, d)


_TESTS = ("positive_relative_strength_20d", "active_turnover_20d", "positive_trend_quality", "positive_sector_contribution_20d")
_NAMED = lambda keep: f"array_to_string(list_sort(list_filter([{', '.join(f'CASE WHEN coalesce(tests[{i}], false) = {keep} THEN {chr(39)}{n}{chr(39)} END' for i, n in enumerate(_TESTS, 1))}], lambda x: x IS NOT NULL)), ',')"


@query("a23_leader_ranking", f"WITH {LED}\nSELECT trade_date, sector_id, symbol, " + ", ".join(c6(n, n) for n in _LEADER) + f", total, qualified, {_NAMED('true')} AS passed, {_NAMED('false')} AS failed, CAST(row_number() OVER (PARTITION BY trade_date, sector_id ORDER BY total DESC NULLS LAST, symbol) AS INTEGER) AS rank FROM lq")
def a23_leader_ranking(spark, d):
    own = S.leaders(members(spark, d)).withColumn("total", r6("total"))
    own = S.rank_by(own, "total", "symbol", "trade_date", "sector_id").withColumns({k: F.array_join(k, ",") for k in ("passed", "failed")})
    return rounded(own.select("trade_date", "sector_id", "symbol", *_LEADER, "total", "qualified", "passed", "failed", "rank"), "total")


_COVERED = re.sub(r"count\(([\w*]+)\) >= ([23]) THEN", r"count(\1) >= \2 AND 5 * count(\1) >= 4 * max(target) THEN", METRICS).replace("1 AS target FROM nn", "max(target) AS target FROM nn").replace("comparable5 >= 2 THEN", "comparable5 >= 2 AND 5 * comparable5 >= 4 * target THEN").replace(
    "FROM nn GROUP BY", "FROM nn JOIN (SELECT sector_id, count(DISTINCT security_id) AS target FROM {memberships} WHERE generation = 3 GROUP BY 1) USING (sector_id) GROUP BY"
)


def targets(spark, d):
    return S.targets(table(spark, d, "memberships").where("generation = 3"))


@query("a20_covered_metrics", f"WITH {_COVERED}\nSELECT trade_date, sector_id, members, " + ", ".join(c6(n, n) for n in _NAMES) + " FROM mt")
def a20_covered_metrics(spark, d):
    return rounded(S.metrics(members(spark, d), targets(spark, d)))


@query("a20_covered_ranking", ranked_sql(0.5))
def a20_covered_ranking(spark, d):
    """The fixture's weeks often lack members, so that half of them is asked for here."""
    return _ranked(spark, d, minimum=0.5)


@query("a24_a25_covered_leaders", None)
def a24_a25_covered_leaders(spark, d):
    return rounded(S.leaders(members(spark, d), targets(spark, d)))


@query("a22_sector_leadership", f"WITH {LED}\nSELECT trade_date, sector_id, candidates, leaders, {c6('share', 'share')}, {c6('lead', 'streak')} FROM ld")
def a22_sector_leadership(spark, d):
    return rounded(S.leadership(S.leaders(members(spark, d))))


@query("w19_w20_contribution_deviation", f"WITH {MEMBERS}\nSELECT trade_date, symbol, {c6('ret20 / count(ret20) OVER (PARTITION BY trade_date, sector_id)', 'contribution')}, {c6('abs(ret1 - avg(ret1) OVER (PARTITION BY trade_date, sector_id))', 'deviation')} FROM own")
def w19_w20_contribution_deviation(spark, d):
    return rounded(S.leaders(members(spark, d)).select("trade_date", "symbol", "contribution", "deviation"))


@query("o1_o2_top_k", f"WITH {MEMBERS}, r AS (SELECT trade_date, sector_id, symbol, CAST(row_number() OVER (PARTITION BY trade_date, sector_id ORDER BY amount DESC NULLS LAST, symbol) AS INTEGER) AS rank FROM own)\nFROM r WHERE rank <= 3")
def o1_o2_top_k(spark, d):
    return S.top_k(members(spark, d), "amount", "symbol", 3, "trade_date", "sector_id").select("trade_date", "sector_id", "symbol", "rank")


@query("p17_exclusion_reasons", f"SELECT security_id, sector_id, array_to_string(list_sort(list_filter([CASE WHEN symbol IS NULL THEN 'no_price' END, CASE WHEN is_suspended THEN 'suspended' END, CASE WHEN board <> 'main' THEN 'board' END, CASE WHEN quality_status <> 'ready' THEN 'quality' END, CASE WHEN delist_date <= {D} THEN 'delisted' END], lambda x: x IS NOT NULL)), ',') AS reasons FROM {{memberships}} LEFT JOIN {{bars}} ON security_id = symbol AND trade_date = {D} WHERE generation = 3")
def p17_exclusion_reasons(spark, d):
    return S.exclusion_reasons(table(spark, d, "memberships").where("generation = 3"), table(spark, d, "bars"), DAYC())


@query("p15_expected_state", f"SELECT generation, security_id, CASE WHEN list_date IS NULL THEN 'unknown' WHEN {D} < list_date THEN 'not_listed' WHEN {D} >= delist_date THEN 'delisted' ELSE 'listed' END AS state FROM {{memberships}}")
def p15_expected_state(spark, d):
    return table(spark, d, "memberships").select("generation", "security_id", B.P.expected_state(DAYC()).alias("state"))


# --- the market's state ---

USABLE = "u AS (SELECT *, close * adjust_factor AS sc, coalesce(pct_change / 100, CASE WHEN preclose > 0 THEN close / preclose - 1 END) AS r1 FROM {bars} WHERE is_trading AND quality_status = 'ready' AND close > 0 AND preclose > 0 AND adjust_factor IS NOT NULL AND amount >= 0)"
_Q = dict.fromkeys(("s1", "s2", "s3", "s4"), 0.25)
_T = dict.fromkeys(("s1", "s2", "s3"), 1 / 3)
TREND = f"""im AS (SELECT *, {full_sql(20, 'avg(close)')} AS m20, {full_sql(60, 'avg(close)')} AS m60, {full_sql(120, 'avg(close)')} AS m120, row_number() OVER ({OVER}) AS k FROM {{index_bars}}),
il AS (SELECT *, m20 - lag(m20, 5) OVER ({OVER}) AS slope FROM im),
trend AS (SELECT trade_date, avg(CASE WHEN k >= 125 THEN (sign(close - m20) + sign(close - m60) + sign(close - m120) + sign(slope)) / 4.0 END) * 100 AS trend FROM il GROUP BY 1)"""
BREADTH = f"""ub AS (SELECT *, {full_sql(20, 'avg(sc)')} AS ma20, {full_sql(60, 'avg(sc)')} AS ma60, sc >= {full_sql(59, 'max(sc)', -1)} AS hi, sc <= {full_sql(59, 'min(sc)', -1)} AS lo FROM u),
b1 AS (SELECT trade_date, avg(CAST(r1 > 0 AS DOUBLE)) AS a, avg(CAST(sc > ma20 AS DOUBLE)) AS b, avg(CAST(sc > ma60 AS DOUBLE)) AS d, avg(CAST(hi AS DOUBLE)) - avg(CAST(lo AS DOUBLE)) AS e FROM ub GROUP BY 1),
b2 AS (SELECT trade_date, {clamped('((a - 0.5) * 200)')} AS s1, {clamped('((b - 0.5) * 200)')} AS s2, {clamped('((d - 0.5) * 200)')} AS s3, {clamped('(e * 500)')} AS s4 FROM b1),
breadth AS (SELECT trade_date, {total(_Q)} AS breadth FROM b2)"""
LIQUIDITY = f"""lt AS (SELECT trade_date, CAST(sum(CAST(amount AS DECIMAL(18, 2))) AS DOUBLE) AS t FROM u GROUP BY 1),
lb AS (SELECT trade_date, t, CASE WHEN count(*) OVER w = 5 THEN avg(t) OVER w END AS b FROM lt WINDOW w AS (ORDER BY trade_date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
liquidity AS (SELECT trade_date, {clamped('((t / b - 1) * 100)')} AS liquidity FROM lb)"""
RISK = f"""ir AS (SELECT *, {ret(1)} AS ret FROM {{index_bars}}),
iv AS (SELECT *, CASE WHEN count(ret) OVER ({OVER} ROWS 19 PRECEDING) = 20 THEN stddev_pop(ret) OVER ({OVER} ROWS 19 PRECEDING) END AS vol, CASE WHEN count(*) OVER ({OVER} ROWS 59 PRECEDING) = 60 THEN list(close) OVER ({OVER} ROWS 59 PRECEDING) END AS cs FROM ir),
ia AS (SELECT trade_date, avg(vol) AS vol, min(list_min(list_transform(range(1, 61), lambda i: cs[i] / list_max(cs[1:i]) - 1))) AS dd FROM iv GROUP BY 1),
ud AS (SELECT trade_date, CASE WHEN count(r1) >= 2 THEN stddev_pop(r1) END AS disp FROM u GROUP BY 1),
rs AS (SELECT trade_date, {_GOOD('vol', 0.01, 0.03)} AS s1, {_GOOD('(-dd)', 0.05, 0.20)} AS s2, {_GOOD('disp', 0.015, 0.04)} AS s3 FROM ia FULL JOIN ud USING (trade_date)),
risk AS (SELECT trade_date, {total(_T)} AS risk FROM rs)"""

#: The fixture's sessions are weeks, on which the bounds for days leave only 100 and -100.
WEEKLY = ((0.1, 0.5), (0.1, 0.6), (0.2, 2.0))
RISK_WEEKLY = re.sub(r"rs AS \(.*\n", lambda m: "rs AS (SELECT trade_date, " + f"{_GOOD('vol', 0.1, 0.5)} AS s1, {_GOOD('(-dd)', 0.1, 0.6)} AS s2, {_GOOD('disp', 0.2, 2.0)} AS s3 FROM ia FULL JOIN ud USING (trade_date)),\n", RISK)
_REGIME = {"trend": 0.30, "breadth": 0.25, "liquidity": 0.15, "risk": 0.20}


def regime_sql(risk: str) -> str:
    return f"WITH {USABLE}, {TREND}, {BREADTH}, {LIQUIDITY}, {risk}, al AS (SELECT * FROM breadth FULL JOIN liquidity USING (trade_date) FULL JOIN trend USING (trade_date) FULL JOIN risk USING (trade_date)), sc AS (SELECT *, {total(_REGIME)} AS total FROM al)\nSELECT trade_date, {c6('trend', 'trend')}, {c6('breadth', 'breadth')}, {c6('liquidity', 'liquidity')}, {c6('risk', 'risk')}, {c6('total', 'total')}, CASE WHEN total >= 25 THEN 'bull' WHEN total <= -25 THEN 'bear' ELSE 'range' END AS strategic, CASE WHEN total >= 10 THEN 'risk_on' WHEN total <= -10 THEN 'risk_off' ELSE 'neutral' END AS tactical, 0.0::DOUBLE AS confidence FROM sc"


@query("a26_regime_trend", f"WITH {TREND}\nSELECT trade_date, {c6('trend', 'trend')} FROM trend")
def a26_regime_trend(spark, d):
    return rounded(R.trend(table(spark, d, "index_bars")))


@query("a27_regime_breadth", f"WITH {USABLE}, {BREADTH}\nSELECT trade_date, {c6('breadth', 'breadth')} FROM breadth")
def a27_regime_breadth(spark, d):
    return rounded(R.breadth(table(spark, d, "bars")))


@query("a28_regime_liquidity", f"WITH {USABLE}, {LIQUIDITY}\nSELECT trade_date, {c6('liquidity', 'liquidity')} FROM liquidity")
def a28_regime_liquidity(spark, d):
    return rounded(R.liquidity(table(spark, d, "bars")))


def _risk(spark, d, *bounds):
    own = written(table(spark, d, "bars").select(*STATE))
    return R.risk(own, table(spark, d, "index_bars", bars=own), *bounds)


@query("a29_regime_risk", f"WITH {USABLE}, {RISK}\nSELECT trade_date, {c6('risk', 'risk')} FROM risk")
def a29_regime_risk(spark, d):
    return rounded(_risk(spark, d))


#: What the market's state reads of a bar.
STATE = ("symbol", "trade_date", "close", "preclose", "volume", "amount", "pct_change", "adjust_factor", "is_trading", "quality_status")


def history(spark, d, *bounds):
    """The state of every session; its bars, which it reads five times, are made once."""
    own = written(table(spark, d, "bars").select(*STATE))
    return R.history(own, written(table(spark, d, "index_bars", bars=own)), *bounds)  # a row a region and session


@query("a31_regime_history", regime_sql(RISK))
def a31_regime_history(spark, d):
    return rounded(history(spark, d), "confidence")


@query("a29_regime_risk_weekly", f"WITH {USABLE}, {RISK_WEEKLY}\nSELECT trade_date, {c6('risk', 'risk')} FROM risk")
def a29_regime_risk_weekly(spark, d):
    return rounded(_risk(spark, d, WEEKLY))


@query("a31_regime_history_weekly", regime_sql(RISK_WEEKLY))
def a31_regime_history_weekly(spark, d):
    return rounded(history(spark, d, WEEKLY), "confidence")


@query("a32_replay_audit", "SELECT count(*) FILTER (year(trade_date) < 2001) AS same, 0 AS changed, count(*) FILTER (year(trade_date) >= 2001) AS unmatched FROM (SELECT DISTINCT trade_date FROM {index_bars})")
def a32_replay_audit(spark, d):
    saved = R.trend(table(spark, d, "index_bars"))
    again = R.trend(table(spark, d, "index_bars").where("year(trade_date) < 2001"))  # later rows never change earlier ones
    return R.replay_audit(saved, again, "trend").select("same", F.col("changed").cast("int").alias("changed"), "unmatched")


@query("a32_replay_regime", f"""WITH {USABLE}, {BREADTH}, i AS (SELECT trade_date, breadth, trade_date + CAST(CASE WHEN month(trade_date) = 3 THEN 7 ELSE 0 END AS INTEGER) AS used FROM breadth)
SELECT count(*) FILTER (year(trade_date) < 2001 AND month(trade_date) <> 6) AS same, count(*) FILTER (year(trade_date) < 2001 AND month(trade_date) = 6 AND breadth IS NOT NULL) AS changed, count(*) FILTER (year(trade_date) >= 2001) AS unmatched, count(*) FILTER (used > trade_date) AS future FROM i""")
def a32_replay_regime(spark, d):
    """Saved breadth of Junes was altered, that of Marches has read a week ahead, that of 2001 cannot be made again."""
    own = written(R.breadth(table(spark, d, "bars")))  # a row a session
    saved = own.withColumns({"breadth": F.col("breadth") + F.when(F.month("trade_date") == 6, 1000.0).otherwise(0.0), "used": F.date_add("trade_date", F.when(F.month("trade_date") == 3, 7).otherwise(0))})
    return R.replay_audit(saved, own.where("year(trade_date) < 2001"), "breadth", "used")


# --- flows ---

CALENDAR = "cal AS (SELECT CAST(d AS DATE) AS trade_date, CASE WHEN d = DATE '2024-01-31' THEN 'unknown' WHEN d = DATE '2024-01-01' OR isodow(d) > 5 THEN 'closed' ELSE 'open' END AS status FROM range(DATE '2024-01-01', DATE '2024-02-01', INTERVAL 1 DAY) t(d))"


def calendar(spark):
    from barline.sources.calendar import build_calendar

    return build_calendar(spark, "2024-01-01", "2024-01-31", closed=["2024-01-01"], unknown=["2024-01-31"])


_FO = "PARTITION BY scope_name ORDER BY o"
_OK = lambda k: f"count(*) OVER ({_FO} ROWS {k - 1} PRECEDING) = {k} AND o - min(o) OVER ({_FO} ROWS {k - 1} PRECEDING) = {k - 1}"
_F20 = f"{_FO} ROWS 19 PRECEDING"
FLOWS = f"""{CALENDAR}, od AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS o FROM cal WHERE status = 'open'),
fm AS (SELECT scope_name, trade_date, main_net AS sum1, CASE WHEN {_OK(5)} THEN sum(main_net) OVER ({_FO} ROWS 4 PRECEDING) END AS sum5,
CASE WHEN {_OK(20)} THEN sum(main_net) OVER ({_F20}) END AS sum20, CASE WHEN {_OK(20)} THEN avg(CAST(main_net > 0 AS DOUBLE)) OVER ({_F20}) END AS positive,
CASE WHEN {_OK(20)} THEN CASE WHEN stddev_pop(main_net) OVER ({_F20}) > 0 THEN (main_net - avg(main_net) OVER ({_F20})) / stddev_pop(main_net) OVER ({_F20}) ELSE 0 END END AS z,
CASE WHEN {_OK(20)} THEN sum(abs(super_net)) OVER ({_F20}) / sum(abs(main_net)) OVER ({_F20}) END AS large_share,
CASE WHEN o >= 20 THEN count(*) OVER ({_FO} RANGE 19 PRECEDING) / 20.0 ELSE 0 END::DOUBLE AS continuity FROM {{flows}} JOIN od USING (trade_date))"""


@query("a33_flow_metrics", f"WITH {FLOWS}\nSELECT scope_name, trade_date, " + ", ".join(c6(n, n) for n in ("sum1", "sum5", "sum20", "positive", "z", "large_share", "continuity")) + " FROM fm")
def a33_flow_metrics(spark, d):
    return rounded(FL.flow_metrics(table(spark, d, "flows"), calendar(spark)))


_MARKED = """q AS (SELECT scope_name, trade_date, main_net, CASE WHEN scope_name = '2' AND trade_date > DATE '2024-01-15' THEN 'b' ELSE 'a' END AS source, CASE WHEN scope_name = '4' THEN DATE '2024-02-20' ELSE trade_date END AS observed_on
FROM {flows} WHERE trade_date < DATE '2024-01-31' AND (scope_name = '0' OR (weekday_of(trade_date) < 5 AND trade_date > DATE '2024-01-01' AND NOT (scope_name = '1' AND trade_date = DATE '2024-01-17'))))"""


@query("a34_flow_quality", f"""WITH {CALENDAR}, {_MARKED.replace('weekday_of(trade_date) < 5', 'isodow(trade_date) < 6')}, od AS (SELECT *, count(*) FILTER (status = 'open') OVER (ORDER BY trade_date) AS o FROM cal)
SELECT scope_name, CASE WHEN bool_or(main_net IS NULL) THEN 'not_finite' WHEN count(*) > count(DISTINCT trade_date) THEN 'duplicate' WHEN count(DISTINCT source) > 1 THEN 'mixed_source' WHEN bool_or(coalesce(status, 'unknown') = 'unknown') THEN 'calendar_unverifiable'
WHEN bool_or(status = 'closed') THEN 'closed_session' WHEN bool_or(observed_on > DATE '2024-01-31') THEN 'late_observation' WHEN count(DISTINCT o) < max(o) - min(o) + 1 THEN 'gap' END AS fault FROM q LEFT JOIN od USING (trade_date) GROUP BY 1""")
def a34_flow_quality(spark, d):
    """Scope 0 keeps closed days, 1 lacks a session, 2 has two sources, 4 was observed late."""
    own = spark.sql(f"WITH {_MARKED.replace('weekday_of(', 'weekday(')} FROM q", flows=table(spark, d, "flows"))
    return FL.flow_quality(own, calendar(spark), F.lit("2024-01-31").cast("date"))


WAY = "CASE WHEN sum20 IS NULL OR positive IS NULL THEN NULL WHEN sum20 > 0 AND positive >= 0.65 THEN 'persistent_reported_inflow' WHEN sum20 < 0 AND positive <= 0.35 THEN 'persistent_reported_outflow' ELSE 'mixed_reported_flow' END"


@query("a35_flow_direction", f"WITH {FLOWS}\nSELECT scope_name, trade_date, {WAY} AS direction FROM fm")
def a35_flow_direction(spark, d):
    return FL.flow_direction(FL.flow_metrics(table(spark, d, "flows"), calendar(spark)))


@query("s11_build_calendar", f"WITH {CALENDAR}\nSELECT c.trade_date, status, count(f.trade_date) AS scopes FROM cal c LEFT JOIN {{flows}} f USING (trade_date) GROUP BY ALL")
def s11_build_calendar(spark, d):
    return calendar(spark).join(table(spark, d, "flows").select("trade_date", "scope_name"), "trade_date", "left").groupBy("trade_date", "status").agg(F.count("scope_name").alias("scopes"))


@query("j12_calendar_gaps", "WITH w AS (SELECT CAST(d AS DATE) AS trade_date FROM range(DATE '1994-12-05', DATE '2001-12-30', INTERVAL 7 DAY) t(d))\nSELECT trade_date FROM w WHERE trade_date NOT IN (SELECT trade_date FROM {bars})")
def j12_calendar_gaps(spark, d):
    """The calendar starts before and ends after the bars."""
    weeks = spark.sql("SELECT explode(sequence(DATE '1994-12-05', DATE '2001-12-29', INTERVAL 7 DAYS)) AS trade_date, 'open' AS status")
    return J.calendar_gaps(weeks, table(spark, d, "bars"))


@query("j13_calendar_conflicts", f"WITH {CALENDAR}, o AS (SELECT DISTINCT trade_date, 'open' AS status FROM {{flows}})\nSELECT trade_date, coalesce(c.status, 'unknown') AS a, coalesce(o.status, 'unknown') AS b, CASE WHEN coalesce(c.status, 'unknown') = 'unknown' OR o.status IS NULL THEN 'unknown' ELSE 'conflict' END AS kind FROM cal c FULL JOIN o USING (trade_date) WHERE coalesce(c.status, 'unknown') <> coalesce(o.status, 'unknown')")
def j13_calendar_conflicts(spark, d):
    observed = table(spark, d, "flows").select("trade_date", F.lit("open").alias("status")).distinct()
    return J.calendar_conflicts(calendar(spark), observed)


@query("w22_w23_staleness", f"WITH {CALENDAR}, l AS (SELECT scope_name, max(trade_date) AS last FROM {{flows}} WHERE trade_date <= DATE '2024-01-15' OR scope_name = 'all' GROUP BY 1)\nSELECT scope_name, last, CASE WHEN NOT coalesce(bool_or(status = 'unknown'), false) THEN count(*) FILTER (status = 'open') END AS stale FROM l LEFT JOIN cal ON trade_date > last AND trade_date <= DATE '2024-01-30' GROUP BY ALL")
def w22_w23_staleness(spark, d):
    own = table(spark, d, "flows").where("trade_date <= DATE '2024-01-15' or scope_name = 'all'")
    return FL.staleness(own, calendar(spark), F.lit("2024-01-30").cast("date"))


_STALE = "st AS (SELECT scope_name, last, CASE WHEN NOT coalesce(bool_or(status = 'unknown'), false) THEN count(*) FILTER (status = 'open') END AS stale FROM (SELECT scope_name, max(trade_date) AS last FROM {flows} WHERE trade_date <= DATE '2024-01-24' OR scope_name <> '1' GROUP BY 1) LEFT JOIN cal ON trade_date > last AND trade_date <= DATE '2024-01-30' GROUP BY ALL)"


@query("a35_flow_report", f"WITH {FLOWS}, {_STALE}\nSELECT scope_name, trade_date, stale, CASE WHEN sum20 IS NOT NULL AND stale = 0 AND scope_name <> '3' THEN 'ready' WHEN sum20 IS NOT NULL AND stale > 0 THEN 'stale' ELSE 'insufficient_history' END AS availability, CASE WHEN stale = 0 AND scope_name <> '3' THEN {WAY} END AS direction FROM fm JOIN st USING (scope_name) WHERE trade_date = last")
def a35_flow_report(spark, d):
    """Scope 1 ends early, the source of scope 3 is not trusted."""
    own = table(spark, d, "flows")
    stale = FL.staleness(own.where("trade_date <= DATE '2024-01-24' or scope_name <> '1'"), calendar(spark), F.lit("2024-01-30").cast("date"))
    return FL.flow_report(FL.flow_metrics(own, calendar(spark)), stale, F.col("scope_name") != "3")


@query("f14_market_clock", """WITH own AS (SELECT event_id, CAST(ts AS TIMESTAMP) + INTERVAL 8 HOUR AS t FROM events), cal AS (SELECT CAST(d AS DATE) AS trade_date, CASE WHEN year(d) <> 2024 THEN 'unknown' WHEN d = DATE '2024-01-01' OR isodow(d) > 5 THEN 'closed' ELSE 'open' END AS status FROM range(DATE '2023-12-01', DATE '2025-01-11', INTERVAL 1 DAY) t(d)),
p AS (SELECT trade_date, status, max(CASE WHEN status = 'open' THEN trade_date END) OVER w AS opened, max(CASE WHEN status = 'unknown' THEN trade_date END) OVER w AS lost FROM cal WINDOW w AS (ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
j AS (SELECT event_id, CAST(t AS TIME) AS clock, p.trade_date, status, CASE WHEN lost IS NULL OR opened > lost THEN opened END AS previous FROM own LEFT JOIN p ON CAST(t AS DATE) = p.trade_date)
SELECT event_id, CASE WHEN status IS NULL OR status = 'unknown' THEN NULL WHEN status = 'open' AND clock >= TIME '16:00:00' THEN trade_date ELSE previous END AS expected,
CASE WHEN status IS NULL OR status = 'unknown' THEN 'calendar_unavailable' WHEN status = 'closed' THEN 'closed' WHEN clock < TIME '09:30:00' THEN 'pre_market' WHEN clock < TIME '15:00:00' THEN 'market_open' ELSE 'after_close_waiting' END AS phase FROM j""")
def f14_market_clock(spark, d):
    from barline.sources.calendar import compose_calendar, market_clock

    years = spark.sql("SELECT 2024 AS year, array(DATE '2024-01-01') AS closed")
    own = table(spark, d, "events").select("event_id", (F.col("ts").cast("timestamp")).alias("ts"))
    return market_clock(own, "ts", compose_calendar(years, years.limit(0), "2023-12-01", "2025-01-10")).select("event_id", "expected", "phase")


@query("s11_compose_calendar", "WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)\nSELECT d AS trade_date, CASE WHEN year(d) > 1997 THEN 'unknown' WHEN isodow(d) > 5 OR (year(d) <> 1996 AND month(d) = 1 AND day(d) = 1) OR (year(d) = 1996 AND month(d) = 7 AND day(d) = 4) THEN 'closed' ELSE 'open' END AS status FROM d")
def s11_compose_calendar(spark, d):
    """Years up to 1997 are configured; a promoted 1996 replaces the bundled one. Days are those that have orders."""
    from barline.sources.calendar import compose_calendar

    days = table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("trade_date")).distinct()
    years = days.select(F.year("trade_date").alias("year")).distinct().where("year <= 1997").select("year", F.array(F.make_date("year", F.lit(1), F.lit(1))).alias("closed"))
    promoted = years.where("year = 1996").select("year", F.array(F.make_date("year", F.lit(7), F.lit(4))).alias("closed"))
    return days.join(compose_calendar(years, promoted, "1980-01-01", "2030-12-31"), "trade_date")


# --- portfolios ---



def valued(spark, d):
    return J.value_positions(table(spark, d, "positions"), table(spark, d, "bars"), DAYC())


VALUED = f"v AS (SELECT portfolio, p.symbol, quantity, cost, CASE WHEN b.symbol IS NOT NULL AND NOT is_suspended AND quality_status = 'ready' THEN CAST(b.close AS DECIMAL(18, 2)) * quantity END AS value FROM {{positions}} p LEFT JOIN {{bars}} b ON p.symbol = b.symbol AND b.trade_date = {D})"


@query("a36_portfolio_totals", f"WITH {VALUED}\nSELECT portfolio, CAST(round(sum(value), 2) AS DOUBLE) AS value, CAST(round(sum(CASE WHEN value IS NOT NULL THEN cost END), 2) AS DOUBLE) AS cost, count(value) / count(*) AS coverage, CAST(round(sum(value), 2) - round(sum(CASE WHEN value IS NOT NULL THEN cost END), 2) AS DOUBLE) AS profit FROM v GROUP BY 1")
def a36_portfolio_totals(spark, d):
    own = PF.totals(valued(spark, d))
    return own.withColumns({x: F.col(x).cast("double") for x in ("value", "cost", "profit")})


LATEST = "l AS (SELECT portfolio, cash, manual_nav FROM (SELECT *, row_number() OVER (PARTITION BY portfolio ORDER BY as_of DESC, revision DESC) AS rn FROM {ledger} WHERE recorded_on <= DATE '2002-01-01') WHERE rn = 1)"
EXPOSURE = f"""{VALUED}, {LATEST}, g AS (SELECT portfolio, sum(value) AS gross_value, max(value) AS largest_value, bool_and(value IS NOT NULL) AS complete FROM v GROUP BY 1),
e0 AS (SELECT l.portfolio, cash, manual_nav, coalesce(complete, true) AS complete, CASE WHEN coalesce(complete, true) THEN coalesce(gross_value, 0) END AS gross_value, CASE WHEN coalesce(complete, true) THEN coalesce(largest_value, 0) END AS largest_value FROM l LEFT JOIN g USING (portfolio)),
e1 AS (SELECT *, coalesce(manual_nav, cash + gross_value) AS n FROM e0),
ex AS (SELECT portfolio, CASE WHEN n > 0 THEN CAST(n AS DOUBLE) END AS nav, CASE WHEN n IS NULL OR n <= 0 THEN 'unavailable' WHEN manual_nav IS NOT NULL THEN 'manual_nav' ELSE 'derived_nav' END AS basis,
CASE WHEN n > 0 THEN round_even(CAST(gross_value AS DOUBLE) / CAST(n AS DOUBLE), 6) END AS gross, CASE WHEN n > 0 THEN round_even(CAST(largest_value AS DOUBLE) / CAST(n AS DOUBLE), 6) END AS largest, complete FROM e1)"""


def latest(spark, d):
    return Q.latest_per_key(J.latest_revision(table(spark, d, "ledger"), F.lit("2002-01-01").cast("date")), ["portfolio"], ["as_of", "revision"])


def exposures(spark, d):
    return PF.exposure(valued(spark, d), latest(spark, d))


def state(spark, d):
    """The market's state of the day; here it always lacks a component and covers a part of the market."""
    own = history(spark, d).where(F.col("trade_date") == DAYC())
    return own.withColumns({"degraded": F.lit(True), "full_scope": F.lit(False)})


@query("a37_portfolio_exposure", f"WITH {EXPOSURE}\nSELECT portfolio, nav, basis, gross, largest, complete FROM ex")
def a37_portfolio_exposure(spark, d):
    return exposures(spark, d).withColumn("nav", F.col("nav").cast("double"))


@query("a38_sector_concentration", f"""WITH {VALUED}, s AS (SELECT portfolio, sector_id, sum(value) AS x FROM v LEFT JOIN (SELECT security_id, sector_id FROM {{memberships}} WHERE generation = 3) ON symbol = security_id WHERE value IS NOT NULL GROUP BY 1, 2),
t AS (SELECT portfolio, sum(x) AS t, max(x) AS m FROM s GROUP BY 1)
SELECT portfolio, sector_id, CAST(round(x, 2) AS DOUBLE) AS value, round_even(CAST(x AS DOUBLE) / CAST(t AS DOUBLE), 6) AS weight, x = m AS is_largest FROM s JOIN t USING (portfolio)""")
def a38_sector_concentration(spark, d):
    own = PF.sector_concentration(valued(spark, d), table(spark, d, "memberships").where("generation = 3"))
    return own.withColumn("value", F.col("value").cast("double"))


@query("a39_atr_budget", f"""WITH {EXPOSURE}, {B.EFF}, tr AS (SELECT symbol, trade_date, adjust_factor, CASE WHEN lag(sc) OVER o IS NOT NULL THEN greatest(sh - sl, abs(sh - lag(sc) OVER o), abs(sl - lag(sc) OVER o)) END AS tr FROM eff WINDOW o AS ({B.OVER})),
ranges AS (SELECT symbol, trade_date, CASE WHEN count(tr) OVER o = 14 THEN avg(tr) OVER o END / adjust_factor AS atr FROM tr WINDOW o AS ({B.OVER} ROWS 13 PRECEDING)),
risk AS (SELECT portfolio, sum(CAST(quantity AS DOUBLE) * atr) AS b, bool_and(atr IS NOT NULL) AS ok FROM {{positions}} p LEFT JOIN ranges r ON p.symbol = r.symbol AND r.trade_date = {D} GROUP BY 1)
SELECT risk.portfolio, round(CASE WHEN ok AND nav > 0 THEN b / nav END + 1e-9, 6) AS budget FROM risk LEFT JOIN ex ON ex.portfolio = risk.portfolio""")
def a39_atr_budget(spark, d):
    own = W.atr(W.effective_bars(table(spark, d, "bars"), DAYC())).where(F.col("trade_date") == DAYC())
    return rounded(PF.atr_budget(table(spark, d, "positions"), own, exposures(spark, d)))


@query("a40_guardrails", f"WITH {EXPOSURE}\nSELECT portfolio, 'largest' AS measure, largest AS value, CASE WHEN largest IS NULL THEN 'unavailable' WHEN largest <= 0.20 THEN 'pass' ELSE 'breach' END AS state FROM ex")
def a40_guardrails(spark, d):
    return PF.guardrails(exposures(spark, d))


BANDS = """bd(strategic, tactical, lo, hi) AS (VALUES ('bull', 'risk_on', 0.60, 0.85), ('bull', 'neutral', 0.50, 0.75), ('bull', 'risk_off', 0.35, 0.60), ('range', 'risk_on', 0.45, 0.70), ('range', 'neutral', 0.35, 0.60),
  ('range', 'risk_off', 0.20, 0.45), ('bear', 'risk_on', 0.25, 0.50), ('bear', 'neutral', 0.15, 0.40), ('bear', 'risk_off', 0.05, 0.25))"""


@query("a41_target_band", f"""WITH {EXPOSURE}, {BANDS}, rg AS ({regime_sql(RISK)}),
st AS (SELECT strategic, tactical, CAST(lo AS DOUBLE) AS base_lower, CAST(hi AS DOUBLE) AS base_upper, CAST(greatest(lo - 0.10, 0) AS DOUBLE) AS lower, CAST(least(hi + 0.10, 1) AS DOUBLE) AS upper
  FROM rg JOIN bd USING (strategic, tactical) WHERE trade_date = {D})
SELECT portfolio, nav, basis, gross, largest, complete, strategic, tactical, base_lower, base_upper, lower, upper, CASE WHEN strategic IS NULL THEN 'unavailable' ELSE 'degraded' END AS band_status, gross >= lower AND gross <= upper AS within_band,
CASE WHEN strategic IS NULL THEN 'market_regime_unavailable' ELSE 'degraded_market_regime_band_widened,low_regime_confidence_band_widened,market_regime:' || strategic || ',narrow_market_scope_band_widened,tactical_state:' || tactical END AS reasons
FROM ex LEFT JOIN st ON true""")
def a41_target_band(spark, d):
    own = PF.target_band(exposures(spark, d), state(spark, d))
    return own.withColumns({"nav": F.col("nav").cast("double"), "reasons": F.array_join("reasons", ",")})


@query("a42_portfolio_risk", None)
def a42_portfolio_risk(spark, d):
    """The latest snapshot of every portfolio; its daily NAVs are the stated ones of the ledger."""
    atr = W.atr(W.effective_bars(table(spark, d, "bars"), DAYC())).where(F.col("trade_date") == DAYC())
    navs = J.latest_revision(table(spark, d, "ledger"), F.lit("2002-01-01").cast("date")).select("portfolio", "as_of", F.col("manual_nav").alias("nav"))
    return PF.portfolio_risk(valued(spark, d), latest(spark, d), table(spark, d, "memberships").where("generation = 3"), atr, navs, state(spark, d))
