"""Queries of portfolios through time with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.fixtures import table
from barline.operators import regime as R
from barline.operators import valuation as V
from barline.plans import bars as B
from barline.plans.bars import query
from barline.plans.market import RISK, c6, regime_sql, rounded
from barline.sources.shared import written

QUERIES, ORACLE_SQL = B.QUERIES, B.ORACLE_SQL
#: The fixture's bars come up to seven days after their session.
DELAY = 7

#: ``hv``: the snapshot in force on each session, looked up among all of its portfolio; ``qt``: price and ATR; ``sg``: the sector.
HELD = f"""se AS (SELECT DISTINCT trade_date FROM {{bars}}),
hv AS (SELECT portfolio, trade_date, max(struct_pack(as_of := as_of, revision := revision, cash := cash, manual_nav := manual_nav)) AS k
  FROM {{ledger}} JOIN se ON as_of <= trade_date AND recorded_on <= trade_date + {DELAY} GROUP BY ALL),
kn AS (SELECT * FROM {{bars}} WHERE ingested_at <= trade_date + {DELAY}),
ke AS (SELECT symbol, trade_date, adjust_factor, close * adjust_factor AS sc, high * adjust_factor AS sh, low * adjust_factor AS sl
  FROM kn WHERE NOT is_suspended AND adjust_factor IS NOT NULL AND quality_status = 'ready'),
kt AS (SELECT *, CASE WHEN lag(sc) OVER o IS NOT NULL THEN greatest(sh - sl, abs(sh - lag(sc) OVER o), abs(sl - lag(sc) OVER o)) END AS tr
  FROM ke WINDOW o AS ({B.OVER})),
ka AS (SELECT symbol, trade_date, CASE WHEN count(tr) OVER o = 14 THEN avg(tr) OVER o END / adjust_factor AS atr FROM kt WINDOW o AS ({B.OVER} ROWS 13 PRECEDING)),
qt AS (SELECT kn.symbol, kn.trade_date, atr,
    CASE WHEN is_trading AND quality_status = 'ready' AND close > 0 AND high >= low THEN CAST(close AS DECIMAL(24, 12)) END AS price
  FROM kn LEFT JOIN ka ON kn.symbol = ka.symbol AND kn.trade_date = ka.trade_date),
ge AS (SELECT trade_date, max(struct_pack(s := snapshot_date, o := observed_on, g := generation)) AS g
  FROM (SELECT DISTINCT snapshot_date, observed_on, generation FROM {{memberships}} WHERE promoted) m
  JOIN se ON snapshot_date <= trade_date AND observed_on <= trade_date + {DELAY} GROUP BY 1),
sg AS (SELECT trade_date, security_id, max(sector_id) AS sector_id FROM ge JOIN {{memberships}} m ON m.generation = g.g
  WHERE list_date <= trade_date AND (delist_date IS NULL OR trade_date <= delist_date) GROUP BY 1, 2),
ps AS (SELECT hv.portfolio, hv.trade_date, k.as_of AS as_of, k.revision AS revision, k.cash AS cash, k.manual_nav AS manual_nav, h.symbol, quantity, atr, sector_id, price * CAST(quantity AS DECIMAL(12, 2)) AS value
  FROM hv LEFT JOIN {{holdings}} h ON h.portfolio = hv.portfolio AND h.as_of = k.as_of AND h.revision = k.revision
  LEFT JOIN qt ON qt.symbol = h.symbol AND qt.trade_date = hv.trade_date
  LEFT JOIN sg ON sg.security_id = h.symbol AND sg.trade_date = hv.trade_date)"""
TOTALS = """sv AS (SELECT portfolio, trade_date, sector_id, sum(value) AS v FROM ps GROUP BY ALL),
sm AS (SELECT portfolio, trade_date, max(v) AS sector_value FROM sv GROUP BY ALL),
pt AS (SELECT portfolio, trade_date, as_of, revision, cash, manual_nav, count(symbol) AS positions, count(symbol) - count(value) AS unpriced,
    count(symbol) - count(CASE WHEN symbol IS NOT NULL THEN atr END) AS unranged, count(CASE WHEN symbol IS NOT NULL THEN sector_id END) AS mapped,
    coalesce(sum(value), 0) AS gv, coalesce(max(value), 0) AS lv, coalesce(sum(CAST(quantity AS DOUBLE) * atr), 0) AS risk FROM ps GROUP BY ALL),
pn AS (SELECT pt.*, coalesce(sector_value, 0) AS sv, CASE WHEN unpriced = 0 THEN cash + gv END AS derived_nav, CASE WHEN positions > 0 THEN mapped / positions ELSE 1.0 END AS mapping_ratio
  FROM pt JOIN sm USING (portfolio, trade_date)),
pm AS (SELECT *, coalesce(manual_nav, derived_nav) AS n, CASE WHEN coalesce(manual_nav, derived_nav) > 0 THEN CAST(coalesce(manual_nav, derived_nav) AS DOUBLE) END AS nav FROM pn),
pd AS (SELECT *, nav / max(nav) OVER w - 1 AS fall FROM pm WINDOW w AS (PARTITION BY portfolio ORDER BY trade_date ROWS UNBOUNDED PRECEDING)),
pw AS (SELECT *, count(nav) OVER w AS observations, count(*) OVER w - count(nav) OVER w AS unavailable, last_value(fall IGNORE NULLS) OVER w AS current_drawdown,
    min(fall) OVER w AS max_drawdown FROM pd WINDOW w AS (PARTITION BY portfolio ORDER BY trade_date ROWS UNBOUNDED PRECEDING)),
px AS (SELECT *, CASE WHEN unpriced = 0 AND nav > 0 THEN round_even(CAST(gv AS DOUBLE) / nav, 6) END AS gross, CASE WHEN unpriced = 0 AND nav > 0 THEN round_even(CAST(lv AS DOUBLE) / nav, 6) END AS largest,
    CASE WHEN unpriced = 0 AND nav > 0 AND mapping_ratio >= 0.95 THEN round_even(CAST(sv AS DOUBLE) / nav, 6) END AS sector_largest,
    CASE WHEN unpriced = 0 AND unranged = 0 AND nav > 0 THEN risk / nav END AS atr_ratio, CASE WHEN unavailable = 0 THEN -max_drawdown END AS drawdown FROM pw)"""
#: The bands by states, wider by 0.10 as the state is always degraded here.
BAND = """bd(strategic, tactical, lower, upper) AS (VALUES ('bull', 'risk_on', 0.50, 0.95), ('bull', 'neutral', 0.40, 0.85), ('bull', 'risk_off', 0.25, 0.70),
  ('range', 'risk_on', 0.35, 0.80), ('range', 'neutral', 0.25, 0.70), ('range', 'risk_off', 0.10, 0.55), ('bear', 'risk_on', 0.15, 0.60), ('bear', 'neutral', 0.05, 0.50), ('bear', 'risk_off', 0.0, 0.35))"""


def limit_sql(x: str, limit: float) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'unavailable' WHEN {x} <= {limit} THEN 'pass' ELSE 'breach' END AS {x}_state"


def codes_sql(codes: dict[str, str]) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {x} THEN '{n}' END" for n, x in sorted(codes.items())) + ")"


_MISSING = codes_sql({
    "portfolio.cash": "cash IS NULL", "portfolio.nav": "manual_nav IS NULL AND derived_nav IS NULL", "portfolio.positive_nav": "n <= 0",
    "classification.coverage_95_percent": "positions > 0 AND mapping_ratio < 0.95", "market.regime": "px_strategic IS NULL",
})
_ISSUES = codes_sql({
    "portfolio_snapshot_stale_for_requested_as_of": "as_of < trade_date", "manual_nav_cannot_be_reconciled": "manual_nav IS NOT NULL AND derived_nav IS NULL",
    "manual_nav_differs_from_derived_nav": "manual_nav IS NOT NULL AND abs(manual_nav - derived_nav) > 0.01", "daily_nav_history_incomplete": "unavailable > 0",
    "market_regime_degraded": "px_strategic IS NOT NULL", "market_regime_narrow_scope_not_full_a_share": "px_strategic IS NOT NULL",
})
_ROUNDED = ", ".join(c6(x, x) for x in ("mapping_ratio", "atr_ratio", "current_drawdown", "max_drawdown"))
_LIMITS = ", ".join(limit_sql(x, n) for x, n in (("largest", 0.20), ("sector_largest", 0.35), ("atr_ratio", 0.06), ("drawdown", 0.15)))


@query("a42_portfolio_risk_history", f"""WITH {HELD}, {TOTALS}, {BAND}, rg AS ({regime_sql(RISK)}),
pf AS (SELECT px.*, rg.strategic AS px_strategic, rg.tactical AS px_tactical, CAST(lower AS DOUBLE) AS lower, CAST(upper AS DOUBLE) AS upper FROM px LEFT JOIN rg USING (trade_date)
  LEFT JOIN bd ON bd.strategic = rg.strategic AND bd.tactical = rg.tactical),
pg AS (SELECT *, {_MISSING} AS missing_codes, {_ISSUES} AS issue_codes FROM pf)
SELECT portfolio, trade_date, as_of, revision, positions, unpriced, unranged, round(CAST(n AS DOUBLE) + 1e-6) AS stated_nav,
CASE WHEN nav IS NULL THEN 'unavailable' WHEN manual_nav IS NOT NULL THEN 'manual_nav' ELSE 'derived_nav' END AS basis, gross, largest, sector_largest, {_ROUNDED},
observations, unavailable, {_LIMITS}, px_strategic AS strategic, px_tactical AS tactical, lower, upper, gross >= lower AND gross <= upper AS within_band,
missing_codes AS missing, issue_codes AS issues, CASE WHEN missing_codes = '' AND issue_codes = '' AND unpriced = 0 AND unranged = 0 THEN 'ready' ELSE 'degraded' END AS status FROM pg""")
def a42_portfolio_risk_history(spark, d):
    """Every portfolio of the ledger on every session."""
    bars = written(table(spark, d, "bars"))
    states = R.history(bars, written(table(spark, d, "index_bars", bars=bars))).withColumns({"degraded": F.lit(True), "full_scope": F.lit(False)})
    own = V.portfolio_risk_history(table(spark, d, "ledger"), table(spark, d, "holdings"), bars, table(spark, d, "memberships"), states, DELAY)
    own = own.withColumn("stated_nav", F.round(F.coalesce("manual_nav", "derived_nav").cast("double") + 1e-6))
    own = own.select(
        "portfolio", "trade_date", "as_of", "revision", "positions", "unpriced", "unranged", "stated_nav", "basis", "gross", "largest", "sector_largest", "mapping_ratio", "atr_ratio",
        "current_drawdown", "max_drawdown", "observations", "unavailable", "largest_state", "sector_largest_state", "atr_ratio_state", "drawdown_state", "strategic", "tactical", "lower", "upper",
        "within_band", F.array_join("missing", ",").alias("missing"), F.array_join("issues", ",").alias("issues"), "status",
    )
    return rounded(own, "stated_nav", "gross", "largest", "sector_largest", "lower", "upper")
