"""Row predicates and classifications as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def is_finite(x: Column) -> Column:
    """Neither null nor NaN nor infinite; never null itself."""
    return F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False))


def effective() -> Column:
    """A session that counts: not suspended, with a factor, ready."""
    return ~c("is_suspended") & c("adjust_factor").isNotNull() & (c("quality_status") == "ready")


def usable_for_regime() -> Column:
    return c("is_trading") & (c("quality_status") == "ready") & is_finite(c("close")) & (c("close") > 0) & is_finite(c("preclose")) & (c("preclose") > 0) & is_finite(c("adjust_factor")) & is_finite(c("amount")) & (c("amount") >= 0)


def usable_bar() -> Column:
    """As for the regime, and a main-board stock."""
    return usable_for_regime() & (c("security_type") == "stock") & (c("board") == "main")


def return_candidate() -> Column:
    return (c("quality_status") == "ready") & is_finite(c("close")) & (c("close") > 0)


def risk_price_valid(with_factor: bool = False) -> Column:
    ok = usable_for_regime() & (c("high") >= c("low")) if with_factor else c("is_trading") & (c("quality_status") == "ready") & (c("close") > 0) & (c("high") >= c("low"))
    return F.coalesce(ok, F.lit(False))


def ohlc_sane() -> Column:
    o = [c(x) for x in ("open", "high", "low", "close")]
    return (F.least(*o) > 0) & (c("high") >= F.greatest(*o)) & (c("low") <= F.least(*o))


def series_issue() -> Column:
    """Why an effective row may not be part of a price series; null if it may."""
    prices = [c(x) for x in ("open", "high", "low", "close")]
    return (
        F.when(c("quality_status") != "ready", "not_ready")
        .when(F.least(*prices) <= 0, "price")
        .when((c("volume") < 0) | (c("amount") < 0), "activity")
        .when(~is_finite(c("adjust_factor")) | (c("adjust_factor") <= 0), "factor")
    )


def publication_issue() -> Column:
    return (
        F.when(c("quality_status") != "ready", "quality")
        .when(c("is_suspended") & (c("volume") > 0), "suspended_activity")
        .when(c("adjust_factor").isNull(), "missing_factor")
        .when(~ohlc_sane(), "ohlc")
    )


def exchange_of(code: Column) -> Column:
    """Exchange by the first digits of a six-digit code."""
    return F.when(code.rlike("^(60|68|90)"), "sh").when(code.rlike("^(00|30|20)"), "sz").otherwise("unknown")


#: Boards by exchange and first three digits of a code.
BOARDS = (
    ("star", "sh", ("688", "689")),
    ("chinext", "sz", ("300", "301")),
    ("b_share", "sh", ("900",)),
    ("b_share", "sz", ("200",)),
    ("main", "sh", ("600", "601", "603", "605")),
    ("main", "sz", ("000", "001", "002", "003")),
)


def board_of(code: Column, exchange: Column | None = None, security_type: Column | None = None) -> Column:
    """Board of a six-digit code; the exchange follows from the code where it is not given, anything but a stock has its own."""
    exchange = exchange_of(code) if exchange is None else exchange
    board = F.when(exchange == "bj", "bse")
    for name, at, heads in BOARDS:
        board = board.when((exchange == at) & F.substring(code, 1, 3).isin(*heads), name)
    board = board.otherwise("other")
    return board if security_type is None else F.when(security_type == "index", "index").when(security_type == "stock", board).otherwise("other")


def normalize_symbol(text: Column) -> Column:
    """``ex.code`` in lower case, the code padded to six digits; ``code.ex`` is turned around, anything else is null."""
    t = F.lower(F.trim(text))
    ex = F.coalesce(F.nullif(F.regexp_extract(t, r"^(sh|sz)\.", 1), F.lit("")), F.nullif(F.regexp_extract(t, r"\.(sh|sz)$", 1), F.lit("")))
    code = F.regexp_extract(t, r"(\d{1,6})", 1)
    return F.when(t.rlike(r"^((sh|sz)\.\d{1,6}|\d{1,6}\.(sh|sz))$"), F.concat(ex, F.lit("."), F.lpad(code, 6, "0")))


def session_verdict() -> Column:
    """Eligible, or why a row of a session is left out."""
    return (
        F.when(c("board") != "main", "excluded_board").when(c("is_suspended"), "excluded_suspended").when(c("adjust_factor").isNull(), "contract_factor").when(c("quality_status") != "ready", "contract_quality").otherwise("eligible")
    )


#: What may be wrong with a suspended row that is left out without being a breach, and the form of a symbol.
SUSPENDED_ISSUES = ("missing_adjust_factor", "suspended_placeholder")
SYMBOL = r"^(sh|sz)\.\d{6}$"


def classify_session_rows(df: DataFrame) -> DataFrame:
    """``df`` with ``verdict`` (eligible, excluded, contract) and ``reason``; contract breaks make a session unusable.

    Of the rows that a symbol has in a session one is judged by itself, the others are duplicates. Indexes and
    suspended rows are excluded if their quality is as it may be; ``quality_issues`` is an array, null counts as empty.
    """
    w = Window.partitionBy("trade_date", "symbol").orderBy("ingested_at", "source", "quality_status")
    issues = F.array_sort(F.coalesce(c("quality_issues"), F.array().cast("array<string>")))
    clean = c("quality_status").eqNullSafe("ready") & (F.size(issues) == 0)
    suspended = c("is_suspended").eqNullSafe(True) & c("is_trading").eqNullSafe(False)
    legal = clean | (c("quality_status").eqNullSafe("partial") & (issues == F.array(*map(F.lit, SUSPENDED_ISSUES))))
    form = F.coalesce(c("symbol").rlike(SYMBOL) & (F.substring("symbol", 1, 2) == c("exchange")), F.lit(False))
    reason = (
        F.when(c("trade_date").isNull(), "contract:date")
        .when(~form, "contract:symbol")
        .when(c("_nth") > 1, "contract:duplicate")
        .when(~F.coalesce(c("security_type").isin("stock", "index"), F.lit(False)), "contract:security_type")
        .when(c("is_trading").isNull() | c("is_suspended").isNull(), "contract:flags")
        .when((c("security_type") == "index") & clean, "excluded:security_type_index")
        .when((c("security_type") == "stock") & suspended & legal, "excluded:canonical_nontrading")
        .when(~clean, "contract:quality")
        .when(~(c("is_trading") & ~c("is_suspended")), "contract:flags")
        .otherwise("eligible:")
    )
    own = df.withColumn("_nth", F.row_number().over(w)).withColumn("_why", F.split(reason, ":"))
    return own.withColumns({"verdict": c("_why")[0], "reason": F.nullif(c("_why")[1], F.lit(""))}).drop("_nth", "_why")


def scope_board() -> Column:
    return F.when(c("security_type") != "stock", "index").when(c("board") == "main", F.concat(c("exchange"), F.lit("_main"))).otherwise(c("board"))


def expected_state(day: Column) -> Column:
    """Listing state of a member at a day; delisting counts from its day on."""
    return F.when(c("list_date").isNull(), "unknown").when(day < c("list_date"), "not_listed").when(day >= c("delist_date"), "delisted").otherwise("listed")


def scope_mismatch() -> Column:
    """Why a price row and its master row (``m_exchange``, ``m_board``) disagree; null where they agree."""
    return F.when(c("m_exchange").isNull(), "no_master").when(c("exchange") != c("m_exchange"), "exchange").when(c("board") != c("m_board"), "board")


def eligibility_reason(day: Column) -> Column:
    """First reason why a security (security_type, exchange, board, list_date, delist_date) is out of the universe at a day; null if it is in."""
    return (
        F.when(~c("security_type").eqNullSafe("stock"), "non_stock")
        .when(~F.coalesce(c("exchange").isin("sh", "sz"), F.lit(False)), "unsupported_exchange")
        .when(~F.coalesce(c("board").isin("main", "chinext", "star"), F.lit(False)), "unsupported_board")
        .when(day < c("list_date"), "not_listed_yet")
        .when(day >= c("delist_date"), "delisted")
    )


def actionability_reasons() -> Column:
    """Reasons against acting on a security (is_tradable, price_available; null where its price is not audited)."""
    price = F.when(~c("price_available"), "no_price").when(c("price_available").isNull(), "price_not_audited")
    return F.array_compact(F.array(F.when(~c("is_tradable"), "suspended"), price))


def listed_main_board(day: Column, code: Column) -> Column:
    """Inside the listing window, and on the main board by the code."""
    return F.coalesce((c("list_date") <= day) & (c("delist_date").isNull() | (day < c("delist_date"))) & (board_of(code) == "main"), F.lit(False))
