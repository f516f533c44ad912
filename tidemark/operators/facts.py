"""Facts and dimensions of the gold layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import date_key, iso_weekday, ratio, surrogate_key
from tidemark.operators.dedup import latest_by_key


def dim_date(spark: SparkSession, first: Column, last: Column, bounds: DataFrame | None = None) -> DataFrame:
    """One row a day from first to last; bounds is a one-row DataFrame that the two may refer to."""
    base = bounds if bounds is not None else spark.range(1)
    days = base.select(F.explode(F.sequence(first, last)).alias("calendar_date"))
    d = F.col("calendar_date")
    return days.select(
        date_key(d).alias("date_key"), "calendar_date", iso_weekday(d).alias("day_of_week"), F.month(d).alias("month"), F.quarter(d).alias("quarter"), F.year(d).alias("year"), (iso_weekday(d) >= 6).alias("is_weekend")
    )


def date_bounds(*columns: DataFrame) -> DataFrame:
    """(first_date, last_date) over one-column DataFrames of dates."""
    both = columns[0].toDF("d")
    for c in columns[1:]:
        both = both.union(c.toDF("d"))
    return both.agg(F.min("d").alias("first_date"), F.max("d").alias("last_date"))


def price_facts(prices: DataFrame, threshold: float = 0.07) -> DataFrame:
    """Prices (ticker, trading_date, close_price, volume) with keys, daily return and volatility signal; a missing return is no signal."""
    before = F.lag("close_price").over(Window.partitionBy("ticker").orderBy("trading_date"))
    p = prices.withColumn("__before", before).withColumn("daily_return", F.when(F.col("__before") != 0, (F.col("close_price") - F.col("__before")) / F.col("__before")))
    p = p.withColumn("volatility_signal", F.coalesce(F.abs("daily_return") > threshold, F.lit(False)))
    return p.withColumn("company_key", surrogate_key(F.col("ticker"))).withColumn("date_key", date_key(F.col("trading_date"))).drop("__before")


def reference_date(release: Column, event: Column, year: Column) -> Column:
    """The release date, else the event's, else the first day of the fiscal year."""
    return F.coalesce(F.to_date(release), F.to_date(event), F.make_date(year, F.lit(1), F.lit(1)))


def event_facts(events: DataFrame, id: str, ts: str, ticker: str) -> DataFrame:
    """Events once each (the latest), with company_key and date_key."""
    rest = [F.col(c).desc() for c in events.columns if c not in (id, ts)]
    once = latest_by_key(events, [id], [F.col(ts).desc_nulls_last(), *rest])
    return once.withColumn("company_key", surrogate_key(F.col(ticker))).withColumn("date_key", date_key(F.to_date(ts)))


def ratios(f: DataFrame) -> DataFrame:
    """The six ratios of a statement; null where an input is or the denominator is not positive."""
    c = F.col
    return f.withColumns(
        {
            "current_ratio": ratio(c("current_assets"), c("current_liabilities")),
            "debt_to_asset": ratio(c("total_liabilities"), c("total_assets")),
            "debt_to_equity": ratio(c("total_liabilities"), c("equity")),
            "return_on_assets": ratio(c("net_income"), c("total_assets")),
            "return_on_equity": ratio(c("net_income"), c("equity")),
            "interest_coverage": ratio(c("ebit"), c("interest_expense")),
        }
    )
