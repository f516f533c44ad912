"""Deterministic synthetic inputs from spark.range: skewed companies, statements, event streams with disorder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def unit(seed: int, *columns: Column) -> Column:
    """A number in [0, 1) that depends on seed and columns only: the first 8 hexadecimal digits of a SHA-256, which SQL has too."""
    text = F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in columns])
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double") / float(1 << 32)


def with_duplicates(df: DataFrame, id: str, rate: float, seed: int = 1) -> DataFrame:
    """df with copies such that about `rate` of all rows are copies; `is_injected_duplicate` marks them."""
    copies = df.filter(unit(seed, F.col(id)) < rate / (1 - rate))
    return df.withColumn("is_injected_duplicate", F.lit(False)).unionByName(copies.withColumn("is_injected_duplicate", F.lit(True)))


def _created(id: Column) -> Column:
    """A second after the one before, from 2026 on."""
    return F.timestamp_seconds(F.lit(1767225600) + id)


def _ticker(id: Column) -> Column:
    return F.format_string("G%07d", id)


def companies(spark: SparkSession, n: int, seed: int = 7, hot_share: float = 0.6, duplicates: float = 0.02, ids: int = 1000) -> DataFrame:
    """n companies, one sector with hot_share of them, and copies a minute younger; entity_id has `ids` values."""
    i = F.col("id")
    sectors = F.array(*map(F.lit, ("Technology", "Retail", "Energy", "Healthcare")))
    base = spark.range(n).select(
        _ticker(i).alias("ticker"),
        F.format_string("Generated Company %07d", i).alias("company_name"),
        F.when(i < int(n * 0.7), "HOSE").when(i % 2 == 0, "HNX").otherwise("UPCOM").alias("exchange"),
        F.when(i < int(n * hot_share), F.lit("Manufacturing")).otherwise(F.get(sectors, (i % 4).cast("int"))).alias("sector"),
        _created(i).alias("created_ts"),
        F.format_string("entity-%06d", i % ids).alias("entity_id"),
    )
    both = with_duplicates(base, "ticker", duplicates, seed)
    return both.withColumn("created_ts", F.when(F.col("is_injected_duplicate"), F.col("created_ts") + F.expr("interval 1 minute")).otherwise(F.col("created_ts")))


def statements(spark: SparkSession, n: int, quarters: int, first_year: int = 2020, seed: int = 7, change: int = 5) -> DataFrame:
    """One statement a company and quarter. From quarter `change` on they are of schema version 2; before, the two new columns are null."""
    q, i = F.col("q"), F.col("id")
    base = spark.range(n).select("id", F.explode(F.sequence(F.lit(0), F.lit(quarters - 1))).alias("q"))
    assets = F.lit(1_000_000) + i * 100 + q * 1000
    liabilities = F.floor(assets * (F.lit(0.45) + unit(seed, i, q) * 0.25))
    version = F.when(q < change - 1, 1).otherwise(2)
    part = lambda share: F.floor(F.col("total_assets") * share)
    v = base.select(
        _ticker(i).alias("ticker"), F.concat((F.lit(first_year) + F.floor(q / 4)).cast("string"), F.lit("Q"), (q % 4 + 1).cast("string")).alias("report_period"),
        assets.cast("long").alias("total_assets"), liabilities.cast("long").alias("total_liabilities"), version.alias("schema_version"), (_created(i) + F.make_dt_interval(q)).alias("created_ts"),
    )
    new = lambda share: F.when(F.col("schema_version") == 2, part(share))
    return v.withColumns({"net_income": part(0.025), "operating_cash_flow": new(0.03), "retained_earnings": new(0.08), "statement_type": F.when(F.col("schema_version") == 2, F.lit("consolidated"))})


def prices(spark: SparkSession, n: int, seed: int = 7) -> DataFrame:
    """One price a company on 2026-01-02."""
    i = F.col("id")
    return spark.range(n).select(_ticker(i).alias("ticker"), F.lit("2026-01-02").cast("date").alias("trading_date"), F.round(F.lit(10) + unit(seed + 1, i) * 90, 2).alias("close_price"), (F.lit(1000) + i).alias("volume"), _created(i).alias("created_ts"))


def aligned_versions(statements: DataFrame, new: dict[str, str]) -> DataFrame:
    """Statements of both schema versions as one table: version 1 with nulls for the new columns, whatever it holds there."""
    old = statements.filter("schema_version = 1").withColumns({c: F.lit(None).cast(kind) for c, kind in new.items()})
    second = statements.filter("schema_version = 2")
    return old.select(*second.columns).union(second)


def burst(events: DataFrame, seconds: int, records: int, start: int | None = None) -> DataFrame:
    """`records` price events spread evenly over `seconds`, from `start` (epoch seconds) or the newest of events (ticker,
    event_second); of the first event's ticker, or AAA."""
    if seconds <= 0 or records <= 0:
        raise ValueError("a burst needs a time and records")
    first = events.agg(F.min_by("ticker", "event_second").alias("t"), F.max("event_second").alias("last"))
    base = events.sparkSession.range(records).join(first)
    at = (F.lit(start) if start is not None else F.coalesce("last", F.lit(0))) + F.col("id") * (seconds / max(records - 1, 1))
    return base.select(F.concat(F.lit("burst-"), F.col("id").cast("string")).alias("event_id"), F.coalesce("t", F.lit("AAA")).alias("ticker"), at.alias("event_second"), (F.lit(10.0) + F.col("id") * 0.01).alias("price"), (F.lit(100) + F.col("id")).alias("volume"))


def late(events: DataFrame, lag: int, seed: int = 0) -> DataFrame:
    """Events (event_id, event_second) with event times up to `lag` seconds before; what they arrive at stays."""
    if lag <= 0:
        raise ValueError("late events need a lag")
    return events.withColumn("event_second", F.col("event_second") - F.ceil(unit(seed, F.col("event_id")) * lag))


def repeated(events: DataFrame, rate: float, seed: int = 0) -> DataFrame:
    """Events with a share `rate` of them sent twice."""
    if not 0 <= rate <= 1:
        raise ValueError("a rate is from 0 to 1")
    return events.unionByName(events.filter(unit(seed, F.col("event_id")) < rate))


def stream(spark: SparkSession, n: int, seed: int = 7, late: float = 0.03, disorder: float = 0.05, duplicates: float = 0.015, burst_every: int = 600, burst: int = 60) -> DataFrame:
    """n events a second apart, those in bursts ten a second; late and disordered ones carry earlier event times than their arrival."""
    i = F.col("id")
    in_burst = (i % burst_every) < burst
    arrival = F.when(in_burst, i - i % burst_every + F.floor(i % burst_every / 10)).otherwise(i)
    base = spark.range(n).select("id", in_burst.alias("is_burst"), arrival.cast("long").alias("ingest_second"), (unit(seed, i) < late).alias("is_late"), (unit(seed + 1, i) < disorder).alias("is_out"))
    shift = F.when(F.col("is_late"), 120 + F.floor(unit(seed + 2, i) * 180)).when(F.col("is_out"), F.floor(unit(seed + 3, i) * 30)).otherwise(0)
    events = base.select(
        F.concat(F.lit("e"), i.cast("string")).alias("event_id"),
        F.format_string("T%06d", F.floor(unit(seed + 4, i) * 100)).alias("ticker"),
        (F.col("ingest_second") - shift).cast("long").alias("event_second"),
        "ingest_second",
        "is_burst",
        "is_late",
        (F.col("is_out") & ~F.col("is_late")).alias("is_out_of_order"),
    )
    return with_duplicates(events, "event_id", duplicates, seed + 5)
