"""Indicators that carry state from row to row (W2, W4, W6, W21) and user calculators.

A recurrence y = a * y + b is a chain of affine maps, and maps compose in any grouping. So the values of all rows follow from
running sums in blocks of a symbol's rows and the ends of the blocks before: windows over one shuffle, without a Python
worker. User calculators see one symbol's closes at a time.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Recurrence(NamedTuple):
    """y is the mean of the ``n`` rows of ``x`` that end at row ``start`` (from 0) of a symbol, ``keep`` * y + ``add`` at every later row, and null before; a null ``add`` adds nothing."""

    keep: float
    add: Column
    x: str
    n: int
    start: int


#: A block's powers stay below two to this one.
POWERS = 800


def _by():
    return Window.partitionBy("symbol").orderBy("trade_date")


def _blocks(*wanted: Recurrence) -> dict[float, int]:
    """Rows of a block by ``keep``: as many as the smallest one stands, shared by all of which no more than 2^-64 outlasts them."""
    out: dict[float, int] = {}
    rows = int(POWERS)  # of y = add alone
    for keep in sorted({r.keep for r in wanted}):
        if keep > 0 and (not any(out) or -math.log2(keep) * rows < 64):
            rows = int(POWERS / -math.log2(keep))
        out[keep] = rows
    return out


def _in_blocks(bars: DataFrame, rows: int) -> DataFrame:
    """``bars`` with the number of each row of its symbol, its block, and its place there."""
    own = bars if "_k" in bars.columns else bars.withColumn("_k", F.row_number().over(_by()) - 1)
    return own.withColumns({"_block": F.floor(F.col("_k") / rows), "_j": (F.col("_k") % rows).cast("double")})


def _run(own: DataFrame, rows: int, wanted: dict[str, Recurrence]) -> DataFrame:
    """``own``, numbered by blocks of ``rows``, with a column for each recurrence, all of them by the same two running windows.

    In a block of a symbol's rows the maps up to row j compose to keep^j times the sum of each row's term over keep^i. A block
    ends before those powers overflow, which is so far on that all before the block last ended weighs nothing in a double; so
    a row needs the sum of its own block, the value at which the block before ended, and the seed, which weighs keep^(k - start).
    Both windows want rows sorted by symbol, block and session, so recurrences upon recurrences need no other sort.
    """
    k, j = F.col("_k"), F.col("_j")
    term = {n: F.when(k > r.start, r.add).cast("double") for n, r in wanted.items()}
    keeps = {keep: f"_p_{i}" for i, keep in enumerate(dict.fromkeys(r.keep for r in wanted.values() if r.keep > 0))}
    own = own.withColumns({p: F.pow(F.lit(keep), j) for keep, p in keeps.items()})
    power = {n: F.col(keeps[r.keep]) if r.keep > 0 else F.lit(1.0) for n, r in wanted.items()}
    own = own.withColumns({f"_t_{n}": t / power[n] for n, t in term.items()})
    inside = Window.partitionBy("symbol", "_block").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumns({f"_y_{n}": F.sum(f"_t_{n}").over(inside) * power[n] if r.keep > 0 else F.col(f"_t_{n}") for n, r in wanted.items()})
    by = Window.partitionBy("symbol").orderBy("_block", "trade_date")
    ended = {n: F.last(F.when(j == rows - 1, F.col(f"_y_{n}")), True).over(by.rowsBetween(Window.unboundedPreceding, -1)) for n in wanted}
    seed = {n: F.avg(F.when((k > r.start - r.n) & (k <= r.start), F.col(r.x))).over(by.rowsBetween(Window.unboundedPreceding, 0)) for n, r in wanted.items()}
    or0 = lambda x: F.coalesce(x, F.lit(0.0))
    whole = {n: F.when(k >= r.start, or0(F.col(f"_y_{n}")) + or0(seed[n]) * F.pow(F.lit(r.keep), k - r.start) + r.keep * power[n] * or0(ended[n])) for n, r in wanted.items()}
    return own.withColumns(whole).drop(*keeps.values(), *[f"{p}{n}" for n in wanted for p in ("_t_", "_y_")])


def _run_all(own: DataFrame, rows_of: dict[float, int], wanted: dict[str, Recurrence], now: int | None = None) -> tuple[DataFrame, int | None]:
    """``own`` with all recurrences, in as many passes as there are lengths of blocks, and the length by which its rows are numbered, ``now`` at first."""
    for rows in sorted({rows_of[r.keep] for r in wanted.values()}, key=lambda x: x != now):
        own = own if rows == now else _in_blocks(own, rows)
        own, now = _run(own, rows, {n: r for n, r in wanted.items() if rows_of[r.keep] == rows}), rows
    return own, now


def with_recurrences(bars: DataFrame, wanted: dict[str, Recurrence]) -> DataFrame:
    """``bars`` with a column for each recurrence."""
    return _run_all(bars, _blocks(*wanted.values()), wanted)[0].drop("_k", "_block", "_j")


def ema_of(x: str, n: int, start: int | None = None) -> Recurrence:
    """Seeded with the mean of ``n`` rows at row ``start`` (their last at the earliest), then alpha = 2 / (n + 1)."""
    alpha = 2 / (n + 1)
    return Recurrence(1 - alpha, alpha * F.col(x), x, n, n - 1 if start is None else start)


def with_emas(bars: DataFrame, wanted: dict[str, tuple[str, int]]) -> DataFrame:
    """``bars`` with columns name -> (field, n)."""
    return with_recurrences(bars, {name: ema_of(x, n) for name, (x, n) in wanted.items()})


def _changes(x: str) -> dict[str, Column]:
    change = F.col(x) - F.lag(x).over(_by())
    return {"_up": F.greatest(change, F.lit(0.0)), "_down": F.greatest(-change, F.lit(0.0))}


def _wilder(n: int) -> dict[str, Recurrence]:
    return {y: Recurrence((n - 1) / n, F.col(s) / n, s, n, n) for y, s in (("_g", "_up"), ("_l", "_down"))}


def _rsi(own: DataFrame, out: str) -> DataFrame:
    total = F.col("_g") + F.col("_l")
    return own.withColumn(out, F.when(total > 0, 100 * F.col("_g") / total).when(total == 0, 0.0)).drop("_up", "_down", "_g", "_l")


def with_wilder(bars: DataFrame, x: str = "close", n: int = 14, out: str = "rsi14") -> DataFrame:
    """Wilder's RSI, first value at row ``n``; 0 when flat."""
    return _rsi(with_recurrences(bars.withColumns(_changes(x)), _wilder(n)), out)


def _macd_means(x: str, fast: int, slow: int) -> dict[str, Recurrence]:
    return {"_fast": ema_of(x, fast, slow - 1), "_slow": ema_of(x, slow)}


def _macd(bars: DataFrame, x: str, fast: int, slow: int, signal: int, beside: dict[str, Recurrence]) -> DataFrame:
    """Also the recurrences ``beside``, by the windows of the fast and the slow mean."""
    first, last = _macd_means(x, fast, slow) | beside, {"macd_signal": ema_of("_line", signal, slow + signal - 2)}
    rows_of = _blocks(*first.values(), *last.values())
    own, now = _run_all(bars, rows_of, first)
    own, _ = _run_all(own.withColumn("_line", F.col("_fast") - F.col("_slow")), rows_of, last, now)
    line = F.when(F.col("macd_signal").isNotNull(), F.col("_line"))
    return own.withColumns({"macd": line, "macd_hist": line - F.col("macd_signal")}).drop("_fast", "_slow", "_line", "_k", "_block", "_j")


def with_macd(bars: DataFrame, x: str = "close", fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """``macd``, ``macd_signal`` and ``macd_hist``: both means start at row ``slow`` - 1; all are null before the signal starts."""
    return _macd(bars, x, fast, slow, signal, {})


def ema(x: np.ndarray, n: int) -> np.ndarray:
    """Seeded with the mean of the first ``n`` values, then alpha = 2 / (n + 1)."""
    out = np.full(len(x), np.nan)
    if len(x) >= n:
        now = out[n - 1] = x[:n].mean()
        for i in range(n, len(x)):
            now = out[i] = now + 2 / (n + 1) * (x[i] - now)
    return out


def rsi_wilder(x: np.ndarray, n: int = 14) -> np.ndarray:
    """Wilder-smoothed, first value at row ``n``; 0 when flat."""
    out, d = np.full(len(x), np.nan), np.diff(x)
    if len(x) > n:
        gain, loss = np.maximum(d[:n], 0).mean(), np.maximum(-d[:n], 0).mean()
        for i in range(n, len(x)):
            if i > n:
                gain, loss = (gain * (n - 1) + max(d[i - 1], 0)) / n, (loss * (n - 1) + max(-d[i - 1], 0)) / n
            out[i] = 100 * gain / (gain + loss) if gain + loss > 0 else 0.0
    return out


def macd(x: np.ndarray, fast: int = 12, slow: int = 26, signal: int = 9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line, signal and histogram; the fast mean is seeded so that both start together, all are null before the signal starts."""
    line = np.full(len(x), np.nan)
    if len(x) >= slow:
        line[slow - fast :] = ema(x[slow - fast :], fast)
        line -= ema(x, slow)
    own = np.full(len(x), np.nan)
    own[slow - 1 :] = ema(line[slow - 1 :], signal) if len(x) >= slow else own[slow - 1 :]
    line[np.isnan(own)] = np.nan
    return line, own, line - own


#: Calculators by name: function of the closes, names of its outputs, rows before the first value.
INDICATORS: dict[str, tuple[Callable, tuple[str, ...], int]] = {
    "ema12": (lambda x: (ema(x, 12),), ("ema12",), 11),
    "rsi14": (lambda x: (rsi_wilder(x),), ("rsi14",), 14),
    "macd": (macd, ("macd", "macd_signal", "macd_hist"), 33),
}


def register_indicator(name: str, fn: Callable, outputs: tuple[str, ...], warmup: int) -> None:
    """Adds a calculator: closes of one symbol in order to one array per output; values before ``warmup`` rows are nulled."""
    INDICATORS[name] = (fn, tuple(outputs), warmup)


def apply_indicators(bars: DataFrame, names: list[str], *, by: str = "symbol", on: str = "trade_date", x: str = "close") -> DataFrame:
    """``by``, ``on``, ``x`` and the outputs of the named calculators for every row; NaN becomes null.

    Python sees one symbol's closes at a time; a symbol has one row per session, so a group stays small however many
    symbols there are.
    """
    chosen = [INDICATORS[n] for n in names]
    some = bars.select(by, on, x)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(on, ignore_index=True)
        values = rows[x].to_numpy(float)
        for fn, outputs, warmup in chosen:
            for name, out in zip(outputs, fn(values), strict=True):
                out = np.where(np.isfinite(out), out, np.nan)
                out[:warmup] = np.nan
                rows[name] = pd.Series(out).astype(object).where(~np.isnan(out), None)
        return rows

    outputs = ", ".join(f"{o} double" for _, names_, _ in chosen for o in names_)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in some.schema)
    return some.groupBy(by).applyInPandas(run, f"{kinds}, {outputs}")


def indicator_panel(bars: DataFrame) -> DataFrame:
    """Means over 5 to 250 sessions, MACD and RSI of every symbol and session: one shuffle, one sort for the means and one for all that recurs."""
    from barline.operators import windows as W

    means = {f"sma{n}": n for n in (5, 10, 20, 60, 120, 250)}
    own = bars.select("symbol", "trade_date", "close").withColumns({"_k": F.row_number().over(_by()) - 1} | _changes("close"))
    own = W.with_means(own, means)
    own = _rsi(_macd(own, "close", 12, 26, 9, _wilder(14)), "rsi14")
    return own.select("symbol", "trade_date", *means, "macd", "macd_signal", "macd_hist", "rsi14")
