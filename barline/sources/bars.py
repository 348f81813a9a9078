"""Reading, normalising and writing daily bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.functions.predicates import board_of, normalize_symbol
from barline.functions.scalars import parse_date
from barline.operators.joins import asof_join

c = F.col
MANIFEST = T.StructType([T.StructField("path", T.StringType()), T.StructField("trade_date", T.DateType()), T.StructField("source", T.StringType()), T.StructField("row_count", T.LongType())])


def read_bars(bars: DataFrame, start: Column, end: Column, symbols: list | None = None, source: str | None = None) -> DataFrame:
    """Rows of a range of dates, some symbols and a source; on Parquet the filters reach the scan."""
    own = bars.where(c("trade_date").between(start, end))
    own = own.where(c("symbol").isin(symbols)) if symbols is not None else own
    return own.where(c("source") == source) if source else own


def read_manifest_bars(spark: SparkSession, manifest: str, schema: T.StructType, start: Column | None = None, end: Column | None = None, root: str | None = None) -> DataFrame:
    """Only the files that a manifest names for the dates; never a glob. The list of paths is all that comes to the driver.

    ``root`` is the folder of partitioned files, whose names give the columns of the partitions.
    """
    files = spark.read.schema(MANIFEST).json(manifest)
    if start is not None:
        files = files.where(c("trade_date").between(start, end))
    paths = [r["path"] for r in files.select("path").distinct().orderBy("path").collect()]
    reader = spark.read.option("basePath", root) if root else spark.read
    return reader.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def manifest_dates(spark: SparkSession, manifest: str) -> DataFrame:
    """Sessions from the manifest alone."""
    return spark.read.schema(MANIFEST).json(manifest).select("trade_date").distinct()


def last_sessions(bars: DataFrame, as_of: Column, n: int, trusted: Column | None = None) -> DataFrame:
    """Rows of the last ``n`` sessions up to a date; with ``trusted``, of sessions with at least one such row."""
    own = bars.where(c("trade_date") <= as_of)
    days = (own.where(trusted) if trusted is not None else own).select("trade_date").distinct().orderBy(F.desc("trade_date")).limit(n)
    return own.join(F.broadcast(days), "trade_date", "left_semi")  # n rows


def available_dates(bars: DataFrame, source: str) -> DataFrame:
    return bars.where(c("source") == source).select("trade_date").distinct()


def present_points(bars: DataFrame, dates: DataFrame, symbols: DataFrame) -> DataFrame:
    """Which of the requested pairs exist, each once: the bars are filtered by both requests, no pair is made."""
    return bars.select("trade_date", "symbol").join(dates, "trade_date", "left_semi").join(symbols, "symbol", "left_semi").select("trade_date", "symbol").distinct()


def normalize_bars(raw: DataFrame, numbers: list[str]) -> DataFrame:
    """All-text rows as typed bars: empty numbers are null, suspended rows have no activity, reasons tell what is wrong."""
    own = raw.withColumns({n: F.expr(f"try_cast(nullif(trim({n}), '') AS double)") for n in numbers})
    own = own.withColumn("trade_date", parse_date(c("trade_date"))).withColumn("is_suspended", c("is_suspended") == "true")
    own = own.withColumns({n: F.when(c("is_suspended"), 0.0).otherwise(c(n)) for n in ("volume", "amount")})
    why = F.array_compact(F.array(F.when(c("close").isNull(), "no_close"), F.when(c("preclose").isNull(), "no_preclose"), F.when(c("pct_change").isNull(), "no_percent")))
    return own.withColumn("reasons", F.array_join(why, ","))


def provider_bars(raw: DataFrame, factors: DataFrame, indexes: list[str]) -> DataFrame:
    """All-text provider rows (date, code, adjustflag, tradestatus, prices, volume, amount, turn, pctChg, isST) as bars.

    The factor is the latest of ``factors`` (symbol, effective_date, back_factor) in force; indexes have none. A suspended row
    and a stock without a factor are partial. Adjusted prices (another flag than 3) and a trading row without activity end the job.
    """
    number = lambda n: F.expr(f"try_cast(nullif(trim({n}), '') AS double)")
    symbol, suspended = F.lower("code"), ~c("tradestatus").eqNullSafe("1")
    kind = F.when(symbol.isin(indexes), "index").otherwise("stock")
    active = lambda n: F.when(number(n).isNotNull(), number(n)).when(suspended, 0.0).otherwise(F.raise_error(F.lit(f"a trading row has no {n}")).cast("double"))
    date = F.when(c("adjustflag").eqNullSafe("3"), parse_date(c("date"))).otherwise(F.raise_error(F.lit("bars need unadjusted prices")).cast("date"))
    own = raw.select(
        date.alias("trade_date"), symbol.alias("symbol"), kind.alias("security_type"), F.substring(symbol, 1, 2).alias("exchange"), board_of(F.substring(symbol, 4, 6), F.substring(symbol, 1, 2), kind).alias("board"),
        *[number(n).alias(n) for n in ("open", "high", "low", "close", "preclose")], *[active(n).alias(n) for n in ("volume", "amount")],
        number("turn").alias("turnover_rate"), number("pctChg").alias("pct_change"), (~suspended).alias("is_trading"), suspended.alias("is_suspended"), c("isST").eqNullSafe("1").alias("is_st"),
    )
    own = asof_join(own, factors, "symbol", "trade_date", "effective_date", ["effective_date", "back_factor"]).drop("effective_date")
    own = own.withColumn("adjust_factor", F.when(c("security_type") == "stock", c("back_factor"))).drop("back_factor")
    issue = F.when(c("is_suspended"), "suspended_placeholder").when((c("security_type") == "stock") & c("adjust_factor").isNull(), "missing_adjust_factor")
    return own.withColumns({"quality_issues": F.array_compact(F.array(issue)), "quality_status": F.when(issue.isNull(), "ready").otherwise("partial")})


#: Listing states in which a security is listed.
LISTED = ("L", "P", "G")


def secondary_status(universe: DataFrame, daily: DataFrame, suspensions: DataFrame) -> DataFrame:
    """Status of each (trade_date, symbol) of ``universe`` (and list_status, null as L): traded, suspended, not_listed, missing; contradiction where a row meets evidence against it."""
    key = ["trade_date", "symbol"]
    own = universe.select(*key, F.upper(F.coalesce("list_status", F.lit("L"))).isin(*LISTED).alias("_listed")).join(daily.select(*key).distinct().withColumn("_row", F.lit(True)), key, "left")
    own = own.join(suspensions.select(*key).distinct().withColumn("_out", F.lit(True)), key, "left")
    has, out = c("_row").isNotNull(), c("_out").isNotNull()
    status = F.when(has & (out | ~c("_listed")), "contradiction").when(has, "traded").when(~c("_listed"), "not_listed").when(out, "suspended").otherwise("missing")
    return own.select(*key, status.alias("status"))


def factor_pairs(daily: DataFrame, factors: DataFrame) -> DataFrame:
    """``daily`` with the day's ``factor`` and the previous one; a pair that lacks one is not ``proven``.

    ``factors`` has one row per trade_date and symbol (adj_factor, prev_adj_factor); values that are not above 0 count as missing.
    """
    good = lambda n: F.when((c(n) > 0) & (c(n) < float("inf")), c(n))
    own = factors.select("trade_date", "symbol", good("adj_factor").alias("factor"), good("prev_adj_factor").alias("factor_previous"))
    return daily.join(own, ["trade_date", "symbol"], "left").withColumn("proven", c("factor").isNotNull() & c("factor_previous").isNotNull())


def normalize_secondary(raw: DataFrame, *, volume_unit: float = 100, amount_unit: float = 1000) -> DataFrame:
    """The second provider's rows in the first one's units, with canonical symbols."""
    return raw.withColumns({"volume": c("volume") * volume_unit, "amount": c("amount") * amount_unit, "code": normalize_symbol(c("code"))})


def write_bars(df: DataFrame, path: str) -> None:
    """Partitioned by source, year and month, compressed, sorted by symbol; whole partitions are replaced."""
    own = df.withColumns({"year": F.year("trade_date"), "month": F.month("trade_date")}).repartition("source", "year", "month").sortWithinPartitions("symbol", "trade_date")
    own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source", "year", "month").option("compression", "zstd").parquet(path)


def latest_audit(runs: DataFrame, n: int = 1) -> DataFrame:
    """The newest audits, ties by the greater count."""
    return runs.orderBy(F.desc("trade_date"), F.desc("loaded")).limit(n)


def published_audit(runs: DataFrame, pointer: DataFrame) -> DataFrame:
    """The audit behind the published pointer (one row)."""
    return runs.join(F.broadcast(pointer), "trade_date")


def load_industry_history(raw: DataFrame, through: Column) -> DataFrame:
    """Membership history in force and, where ``updated_on`` tells, known up to a date; codes padded to six digits, other codes are dropped."""
    raw = raw.where(c("updated_on") <= through) if "updated_on" in raw.columns else raw
    return raw.where(c("effective_from") <= through).withColumn("code", F.lpad(c("code"), 6, "0")).where(c("code").rlike(r"^\d{6}$"))


def load_memberships(basic: DataFrame, industry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sector records of known securities, with stable ids, and the codes that nothing is known of."""
    own = industry.join(basic, "code").withColumn("record_id", F.concat(F.lit("member-"), F.substring(F.sha2(F.concat_ws("|", "code", "sector"), 256), 1, 24)))
    return own, industry.join(basic, "code", "left_anti").select("code").distinct()


def security_records(listing: DataFrame, basic: DataFrame, day: Column) -> DataFrame:
    """Master records of the securities listed at a day (code ``ex.digits``, name, trade_status), with what ``basic`` (code, type, list_date, delist_date, status) knows.

    Type 1 is a stock, 2 an index; without a basic row the type is other and the window open.
    """
    own = listing.join(basic, "code", "left")
    kind = F.when(c("type") == "1", "stock").when(c("type") == "2", "index").otherwise("other")
    ex = F.lower(F.split_part("code", F.lit("."), F.lit(1)))
    fields = ["code", "name", "trade_status", "list_date", "delist_date", "type", "status"]
    return own.select(
        F.concat(F.lit("security:"), day.cast("string"), F.lit(":"), "code").alias("record_id"), c("code").alias("symbol"), "name", ex.alias("exchange"), board_of(F.split_part("code", F.lit("."), F.lit(2)), ex, kind).alias("board"), kind.alias("security_type"),
        c("trade_status").eqNullSafe("1").alias("is_tradable"), c("status").alias("listing_status"), c("list_date").alias("effective_from"), c("delist_date").alias("effective_to"),
        F.sha2(F.concat_ws("|", *[F.coalesce(c(x).cast("string"), F.lit("")) for x in fields]), 256).alias("lineage_hash"),
    )


def component_records(rows: DataFrame) -> DataFrame:
    """Index component records (index_id, code, updated_on), in force from their update on; rows without one are no records."""
    own = rows.where(c("updated_on").isNotNull())
    return own.select(F.concat_ws(":", F.lit("index"), "index_id", c("updated_on").cast("string"), "code").alias("record_id"), "index_id", c("code").alias("symbol"), c("updated_on").alias("effective_from"), F.lit(None).cast("date").alias("effective_to"))


def latest_effective(history: DataFrame) -> DataFrame:
    """The last record of each code; ties go to the greater sector."""
    w = Window.partitionBy("code").orderBy(F.desc("effective_from"), F.desc("sector"))
    return history.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def file_manifest(bars: DataFrame) -> DataFrame:
    """Rows of each file and session of frames read from files, as a manifest names them."""
    return bars.groupBy(F.input_file_name().alias("path"), "trade_date", c("source").cast("string").alias("source")).agg(F.count("*").alias("row_count"))
