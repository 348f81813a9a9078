"""Scalar functions (F1-F18) as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float = -100.0, high: float = 100.0) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def share_score(x: Column) -> Column:
    return clamp((x - 0.5) * 200)


def scaled_score(x: Column, by: float) -> Column:
    """Strength x 1000, change x 100, spread x 500, streak x 5, leaders x 50: a clamped multiple."""
    return clamp(x * by)


def concentration_score(x: Column) -> Column:
    return clamp((0.75 - x) * 200)


def low_is_good(x: Column, good: float, bad: float) -> Column:
    """100 at ``good`` or below, -100 at ``bad`` or above, a line between."""
    return F.when(x <= good, 100.0).when(x >= bad, -100.0).otherwise(100 - 200 * (x - good) / (bad - good))


def level(x: Column) -> Column:
    return F.when(x >= 0.9, "high").when(x >= 0.5, "medium").when(x.isNotNull(), "low")


def money(x: Column) -> Column:
    """Two decimals, half up."""
    return F.round(x.cast("decimal(38,6)"), 2).cast("decimal(20,2)")


def cents(x: Column) -> Column:
    """A double as decimal(18,2): a hundred times the double, rounded half up; the digits it prints may lie on the other side of a half."""
    return (F.round(x * 100).cast("decimal(18,0)") * F.lit("0.01").cast("decimal(2,2)")).cast("decimal(18,2)")


def ratio(a: Column, b: Column) -> Column:
    """Six decimals, half even; null unless the denominator is positive."""
    return F.when(b > 0, F.bround((a / b).cast("decimal(38,12)"), 6).cast("double"))


def safe_ratio(a: Column, b: Column) -> Column:
    x = F.try_divide(a.cast("double"), b.cast("double"))
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def relative_error(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1.0))


def parse_date(text: Column) -> Column:
    return F.coalesce(F.try_to_date(text, "yyyy-MM-dd"), F.try_to_date(text, "yyyyMMdd"))


def stable_id(prefix: str, *columns: Column) -> Column:
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(F.to_json(F.struct(*columns)), 256), 1, 24))


def number_text(x: Column) -> Column:
    """A decimal without exponent, trailing zeros or minus zero."""
    t = F.regexp_replace(F.regexp_replace(x.cast("decimal(38,12)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(t == "-0", "0").otherwise(t)


def quality_to_json(x: Column) -> Column:
    return F.to_json(x)


def quality_from_json(x: Column) -> Column:
    return F.from_json(x, "array<string>")


def market_date(ts: Column, zone: str = "Asia/Shanghai") -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))
