"""Windowed measures over effective bars (W1-W20): each takes bars and returns bars with a column.

All windows are rows of one symbol in order of trade_date, so bars shuffle once for any number of measures. A measure is
null until its window is full; results up to a day never depend on later rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.predicates import effective

def by():
    """Rows of a symbol in order of session; made when needed, as a window wants a session."""
    return Window.partitionBy("symbol").orderBy("trade_date")


def effective_bars(bars: DataFrame, as_of=None) -> DataFrame:
    """Rows that count as sessions, up to ``as_of``."""
    own = bars.where(effective())
    return own.where(F.col("trade_date") <= F.lit(as_of)) if as_of is not None else own


def full(n: int, value: Column, last: int = 0) -> Column:
    """``value`` (an aggregate) over the ``n`` rows that end ``last`` rows from here; null if there are fewer."""
    return F.when(_there(n, last), value.over(by().rowsBetween(last - n + 1, last)))


def _there(n: int, last: int = 0) -> Column:
    """Whether a symbol has ``n`` rows up to ``last`` rows from here."""
    return F.row_number().over(by()) >= n - last


#: Frames of more rows are put together from shorter ones, so that no row is read as often as the frame is long.
_FRAME = 6


def _lagged(x: Column, n: int) -> Column:
    return F.lag(x, n).over(by()) if n else x


def _added(x: Column, n: int) -> Column:
    """Sum of ``x``, which has no nulls, over ``n`` rows up to here; any value where there are fewer."""
    if n <= _FRAME:
        return F.sum(x).over(by().rowsBetween(1 - n, 0))
    part = next((p for p in range(_FRAME, 1, -1) if n % p == 0), None)
    if part is None:
        return _added(x, n - 1) + _lagged(x, n - 1)
    whole = _added(x, n // part)
    return sum((_lagged(whole, i * (n // part)) for i in range(1, part)), whole)


def full_mean(n: int, x: str | Column, last: int = 0) -> Column:
    """As ``full`` of F.avg: the mean of the values among ``n`` rows; null without any."""
    x = F.col(x) if isinstance(x, str) else x
    # Counts are whole numbers, so theirs is what all rows up to here have less what those before the n have.
    all_ = F.count(x).over(by().rowsBetween(Window.unboundedPreceding, 0))
    own, k = _added(F.coalesce(x, F.lit(0.0)), n), all_ - F.coalesce(_lagged(all_, n), F.lit(0))
    return F.when(_there(n, last), _lagged(own / F.nullif(k, F.lit(0)), -last))


def with_means(df: DataFrame, wanted: dict[str, int], x: str = "close") -> DataFrame:
    """``df`` with ``full_mean`` of ``x`` for every name and number of rows, to the bit; sums that several are put together from are made once."""
    cut = lambda n: next((p for p in range(_FRAME, 1, -1) if n % p == 0), None)
    steps: dict[int, int] = {}

    def step(n: int) -> int:
        if n not in steps:
            steps[n] = 0 if n <= _FRAME else 1 + step(n // cut(n) if cut(n) else n - 1)
        return steps[n]

    def put(n: int) -> Column:
        if n <= _FRAME or not cut(n):
            return _added(F.coalesce(F.col(x), F.lit(0.0)), n) if n <= _FRAME else F.col(f"_s{n - 1}") + _lagged(F.coalesce(F.col(x), F.lit(0.0)), n - 1)
        whole = F.col(f"_s{n // cut(n)}")
        return sum((_lagged(whole, i * (n // cut(n))) for i in range(1, cut(n))), whole)

    last = max(map(step, wanted.values()))
    own = df.withColumns({"_n": F.row_number().over(by()), "_all": F.count(x).over(by().rowsBetween(Window.unboundedPreceding, 0))} | {f"_s{n}": put(n) for n, i in steps.items() if i == 0})
    counts = {f"_k{n}": F.col("_all") - F.coalesce(_lagged(F.col("_all"), n), F.lit(0)) for n in wanted.values()}
    for i in range(1, max(last, 1) + 1):
        own = own.withColumns({f"_s{n}": put(n) for n, j in steps.items() if i == j} | (counts if i == 1 else {}))
    means = {name: F.when(F.col("_n") >= n, F.col(f"_s{n}") / F.nullif(F.col(f"_k{n}"), F.lit(0))) for name, n in wanted.items()}
    return own.withColumns(means).drop("_n", "_all", *[f"_s{n}" for n in steps], *counts)


def _extreme(pick, value, x: Column, n: int) -> Column:
    if n <= _FRAME:
        return value(x).over(by().rowsBetween(1 - n, 0))
    half = -(-n // 2)
    own = _extreme(pick, value, x, half)
    return pick(own, _lagged(own, n - half))  # the halves may share rows


def full_max(n: int, x: str, last: int = 0) -> Column:
    """As ``full`` of F.max."""
    return F.when(_there(n, last), _lagged(_extreme(F.greatest, F.max, F.col(x), n), -last))


def full_min(n: int, x: str, last: int = 0) -> Column:
    """As ``full`` of F.min."""
    return F.when(_there(n, last), _lagged(_extreme(F.least, F.min, F.col(x), n), -last))


def sma(n: int, x: str = "close") -> Column:
    return full_mean(n, x)


def volume_ratio(n: int = 5, x: str = "volume") -> Column:
    """Today over the mean of the ``n`` sessions before; null where that mean is not positive."""
    before = full_mean(n, x, -1)
    return F.when(before > 0, F.col(x) / before)


def rsi_simple(n: int = 14, d: str = "_d") -> Column:
    """Needs the column ``d``, the change of a field: 50 when flat, 100 without a loss."""
    gain, loss = full(n, F.avg(F.greatest(F.col(d), F.lit(0.0)))), full(n, F.avg(F.greatest(-F.col(d), F.lit(0.0))))
    complete = F.count(d).over(by().rowsBetween(1 - n, 0)) == n
    return F.when(complete, F.when((gain == 0) & (loss == 0), 50.0).when(loss == 0, 100.0).otherwise(100 - 100 / (1 + gain / loss)))


def with_change(bars: DataFrame, x: str = "close") -> DataFrame:
    return bars.withColumn("_d", F.col(x) - F.lag(x).over(by()))


def crosses_above(a: Column, b: Column) -> Column:
    return (F.lag(a).over(by()) <= F.lag(b).over(by())) & (a > b)


def crosses_below(a: Column, b: Column) -> Column:
    return (F.lag(a).over(by()) >= F.lag(b).over(by())) & (a < b)


def new_high(n: int = 60, x: str = "close") -> Column:
    return F.col(x) >= full_max(n - 1, x, -1)


def new_low(n: int = 60, x: str = "close") -> Column:
    return F.col(x) <= full_min(n - 1, x, -1)


def period_return(n: int, x: str = "close") -> Column:
    return F.col(x) / F.lag(x, n).over(by()) - 1


def daily_return() -> Column:
    """The provider's percent, else close over previous close; null where neither is usable."""
    return F.coalesce(F.col("pct_change") / 100, F.when(F.col("preclose") > 0, F.col("close") / F.col("preclose") - 1))


#: Fields that an adjustment factor scales.
PRICES = ("open", "high", "low", "close", "preclose")


def scaled(x: str = "close") -> Column:
    """A price times its row's cumulative factor, which puts all rows of a symbol on one scale; other fields as they are.

    Ratios and comparisons of scaled prices are those of prices adjusted to any day, so one pass serves every day.
    """
    return F.when(F.col("adjust_factor") > 0, F.col(x) * F.col("adjust_factor")) if x in PRICES else F.col(x)


def at_own_day(value: Column) -> Column:
    """A value of scaled prices in the terms of its row's own day: rows before it count as adjusted to that day's factor."""
    return F.when(F.col("adjust_factor") > 0, value / F.col("adjust_factor"))


def with_scaled(bars: DataFrame) -> DataFrame:
    """Bars with ``scaled_<price>`` for every price."""
    return bars.withColumns({f"scaled_{x}": scaled(x) for x in PRICES})


def adjusted(x: str) -> Column:
    """Price times its factor over the factor of the symbol's last effective bar."""
    whole = by().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.col(x) * F.col("adjust_factor") / F.last("adjust_factor").over(whole)


def with_adjusted(bars: DataFrame) -> DataFrame:
    return bars.withColumns({f"adj_{x}": adjusted(x) for x in ("open", "high", "low", "close")})


def true_range(p: str = "scaled_") -> Column:
    before = F.lag(f"{p}close").over(by())
    return F.when(before.isNotNull(), F.greatest(F.col(f"{p}high") - F.col(f"{p}low"), F.abs(F.col(f"{p}high") - before), F.abs(F.col(f"{p}low") - before)))


def atr(bars: DataFrame, n: int = 14) -> DataFrame:
    """Mean of ``n`` true ranges on prices adjusted to each row's own day; null unless all ``n`` + 1 rows have a usable factor."""
    own = with_scaled(bars).withColumn("_tr", true_range())
    w = by().rowsBetween(1 - n, 0)
    mean = F.when(F.count("_tr").over(w) == n, F.avg("_tr").over(w))
    return own.withColumn("atr", at_own_day(mean)).drop("_tr", *[f"scaled_{x}" for x in PRICES])


def drawdown(x: str = "close") -> Column:
    return F.col(x) / F.max(x).over(by().rowsBetween(Window.unboundedPreceding, 0)) - 1


def worst_drawdown(n: int = 60, x: str = "close") -> Column:
    """The deepest fall from a running maximum inside the last ``n`` rows."""
    closes = full(n, F.collect_list(x))
    start = F.struct(F.lit(float("-inf")).alias("top"), F.lit(0.0).alias("worst"))
    fall = lambda s, v: F.struct(F.greatest(s.top, v).alias("top"), F.least(s.worst, v / F.greatest(s.top, v) - 1).alias("worst"))
    return F.when(closes.isNotNull(), F.aggregate(closes, start, fall, lambda s: s.worst))


def volatility(n: int = 20, x: str = "ret") -> Column:
    w = by().rowsBetween(1 - n, 0)
    return F.when(F.count(x).over(w) == n, F.stddev_pop(x).over(w))


def bollinger(n: int = 20, k: float = 2.0, x: str = "close") -> tuple[Column, Column, Column]:
    mean, dev = full(n, F.avg(x)), full(n, F.stddev_pop(x))
    return mean, mean + k * dev, mean - k * dev


def zscore(n: int, x: str, by) -> Column:
    w = by.rowsBetween(1 - n, 0)
    mean, dev = F.avg(x).over(w), F.stddev_pop(x).over(w)
    return F.when(F.count(x).over(w) == n, F.when(dev > 0, (F.col(x) - mean) / dev).otherwise(0.0))


def with_streak(df: DataFrame, x: str, by, out: str = "streak", cap: int = 20) -> DataFrame:
    """How many latest rows kept the sign of ``x``, signed and capped; 0 where flat, null where ``x`` is null."""
    sign = F.signum(x)
    changed = F.coalesce(sign, F.lit(9.0)) != F.coalesce(F.lag(sign).over(by), F.lit(9.0))
    own = df.withColumns({"_row": F.row_number().over(by), "_sign": sign}).withColumn("_start", F.when(changed, F.col("_row")))
    own = own.withColumn("_start", F.last("_start", True).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return own.withColumn(out, F.least(F.col("_row") - F.col("_start") + 1, F.lit(cap)) * F.col("_sign")).drop("_row", "_sign", "_start")


def trend_quality(close: Column, *means: Column) -> Column:
    """Mean of +-100 for a close above each of its means, of those that exist."""
    parts = [F.when(m.isNotNull(), F.when(close > m, 100.0).otherwise(-100.0)) for m in means]
    n = sum((F.when(p.isNotNull(), 1).otherwise(0) for p in parts), F.lit(0))
    return F.when(n > 0, sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0)) / n)


def ma_trend_quality(x: str = "close") -> Column:
    return trend_quality(F.col(x), sma(20, x), sma(60, x))
