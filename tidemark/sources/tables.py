"""Reading tables, and the domain's inputs as views over the star-schema tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.layout import Store


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def optional(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The table, or an empty one if the path is missing. Any other error is raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def partitioned_glob(spark: SparkSession, base: str, pattern: str) -> DataFrame:
    """Files that match a pattern below base, with the partition columns of their paths."""
    return spark.read.option("basePath", base).parquet(f"{base}/{pattern}")


def cached(df: DataFrame) -> DataFrame:
    """df read once and kept by executors, spilling to disk; what an executor loses with it is read again."""
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    kept.count()
    return kept


def of_run(df: DataFrame, run_id: str, column: str = "evidence_run_id") -> DataFrame:
    """Rows of one run if the table says which run a row is of."""
    return df.filter(F.col(column) == run_id) if column in df.columns else df


def decode_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    """The fields of JSON text; null fields for text that is not of the schema."""
    return df.withColumn("__json", F.from_json(F.col(column).cast("string"), schema)).select(*df.columns, "__json.*")


def below_prefix(spark: SparkSession, prefix: str) -> DataFrame:
    """All rows of the Parquet files below a prefix, found by listing it; an error if there are none."""
    names = [n for n, _ in Store(spark, prefix).files(prefix) if n.endswith(".parquet")]
    if not names:
        raise FileNotFoundError(f"no Parquet files below {prefix}")
    return spark.read.parquet(*[f"{prefix.rstrip('/')}/{n}" for n in names])


def collected(rows: DataFrame, dataset: str, source_system: str, key: Sequence[str], path: str) -> DataFrame:
    """Write what a source gave, with where it comes from and a hash of each row, and return its line of the source manifest:
    (dataset_name, source_system, row_count, keys, first_key, last_key)."""
    names = rows.columns
    kept = rows.withColumns({"source_system": F.lit(source_system), "source_record_id": F.concat_ws("|", F.lit(dataset), *[F.col(k).cast("string") for k in key]), "payload_hash": F.sha2(F.to_json(F.struct(*sorted(names)), {"ignoreNullFields": "false"}), 256)})
    kept.write.mode("overwrite").parquet(path)
    back = rows.sparkSession.read.parquet(path)
    return back.agg(F.lit(dataset).alias("dataset_name"), F.lit(source_system).alias("source_system"), F.count("*").alias("row_count"), F.countDistinct("source_record_id").alias("keys"), F.min("source_record_id").alias("first_key"), F.max("source_record_id").alias("last_key"))


def manifest(spark: SparkSession, sources: Sequence[dict], name: str) -> DataFrame | None:
    """The table of a declared source, its columns renamed by field_map; None if it is missing or disabled."""
    for s in sources:
        if s["name"] == name and s.get("enabled", True):
            return spark.read.format(s.get("format", "parquet")).load(s["path"]).withColumnsRenamed(s.get("field_map", {}))
    return None


def register_views(spark: SparkSession, tables: dict[str, DataFrame], prefixes: Sequence[str] = ("dim_", "fact_", "obt_", "feat_")) -> list[str]:
    """Temporary views gold_<name>; a name must start as its kind of table does."""
    out = []
    for name, df in tables.items():
        if not name.startswith(tuple(prefixes)):
            raise ValueError(f"{name} must start with one of {', '.join(prefixes)}")
        df.createOrReplaceTempView(f"gold_{name}")
        out.append(f"gold_{name}")
    return out


def contract_functions(spark: SparkSession, prefixes: Sequence[str] = ("dim_", "fact_", "obt_", "feat_")) -> None:
    """SQL functions of the naming contract: gold_bad_names(names) are those that no kind of table has, gold_checked(names) the
    names, or an error that lists the bad ones."""
    rule = "^gold_(" + "|".join(prefixes) + ").+"
    spark.sql(f"create or replace temporary function gold_bad_names(names array<string>) returns array<string> return filter(names, n -> n is null or not n rlike '{rule}')")
    spark.sql(
        "create or replace temporary function gold_checked(names array<string>) returns array<string> return "
        "if(size(gold_bad_names(names)) = 0, names, raise_error(concat('not a gold name: ', array_join(gold_bad_names(names), ', ', '?'))))"
    )


def written_views(spark: SparkSession, tables: dict[str, DataFrame], root: str) -> list[str]:
    """Write Gold tables below a folder and register a view over each one's files; the views' names, after the contract's check."""
    names = register_views(spark, tables)
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")
    register_views(spark, {name: spark.read.schema(df.schema).parquet(f"{root}/{name}") for name, df in tables.items()})
    contract_functions(spark)
    return spark.sql("select gold_checked(:names) as names", args={"names": spark_array(names)}).first()["names"]


def spark_array(values: Sequence[str]):
    return F.array(*map(F.lit, values))


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as companies: ticker, company_name, exchange, sector (region)."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    exchange = F.element_at(F.array(*map(F.lit, ("HOSE", "HNX", "UPCOM", "OTHER"))), (F.col("s_nationkey") % 4 + 1).cast("int"))
    return joined.select(F.col("s_suppkey").alias("supplier"), F.col("s_name").alias("ticker"), F.col("s_name").alias("company_name"), exchange.alias("exchange"), F.col("r_name").alias("sector"))


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by supplier and quarter as financial statements; sums are exact decimals, given as double."""
    x = table(spark, sf_dir, "lineitem")
    money, rate = "decimal(18,2)", "decimal(4,2)"
    p, d, t = F.col("l_extendedprice").cast(money), F.col("l_discount").cast(rate), F.col("l_tax").cast(rate)
    year, quarter = F.year("l_shipdate"), F.quarter("l_shipdate")
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    grouped = x.groupBy(F.col("l_suppkey").alias("supplier"), year.alias("fiscal_year"), quarter.alias("fiscal_quarter")).agg(
        F.sum(p).alias("ta"),
        F.coalesce(F.sum(F.when(flag != "A", p)), F.lit(0).cast(money)).alias("tl"),
        F.coalesce(F.sum(F.when(status == "O", p)), F.lit(0).cast(money)).alias("ca"),
        F.coalesce(F.sum(F.when(flag == "R", p)), F.lit(0).cast(money)).alias("cl"),
        F.coalesce(F.sum(F.when((flag == "N") & (status == "O"), p)), F.lit(0).cast(money)).alias("no"),
        F.sum(p * (d - F.lit("0.04").cast(rate))).alias("ebit"),
        F.sum(p * t).alias("interest"),
        F.sum(p * (d - F.lit("0.05").cast(rate))).alias("ni"),
        F.sum(p * (t - F.lit("0.03").cast(rate))).alias("re"),
    )
    dbl = lambda c: F.col(c).cast("double")
    name = F.concat(F.lit("Supplier#"), F.lpad(F.col("supplier").cast("string"), 9, "0"))
    return grouped.select(
        "supplier",
        name.alias("ticker"),
        F.concat(F.col("fiscal_year").cast("string"), F.lit("Q"), F.col("fiscal_quarter").cast("string")).alias("report_period"),
        "fiscal_year",
        "fiscal_quarter",
        dbl("ta").alias("total_assets"),
        dbl("tl").alias("total_liabilities"),
        dbl("ca").alias("current_assets"),
        dbl("cl").alias("current_liabilities"),
        (F.col("ta") - F.col("tl") - F.col("no")).cast("double").alias("equity"),
        dbl("ebit").alias("ebit"),
        dbl("interest").alias("interest_expense"),
        dbl("ni").alias("net_income"),
        dbl("re").alias("retained_earnings"),
    )


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by user and day as daily prices: the last value (the largest id on ties), and the number of events."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("ticker"), F.to_date("ts").alias("trading_date")).agg(
        F.max_by("value", F.struct("ts", "event_id")).alias("close_price"), F.count("*").alias("volume")
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as snapshots of customers: what an order says of status, priority and segment at its date."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = o.join(c, o["o_custkey"] == c["c_custkey"])
    return joined.select(F.col("c_name").alias("ticker"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("c_mktsegment").alias("segment"), F.col("o_orderdate").alias("created_ts"), F.col("o_orderkey").alias("seq"))


def price_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ticks in order of arrival, with late ones, repeated ids and invalid ones by rule of the id."""
    e = table(spark, sf_dir, "events")
    late = F.when(F.col("event_id") % 7 == 0, F.col("event_id") * 997 % 20000).otherwise(0)
    ts = F.unix_timestamp(F.col("ts").cast("timestamp")) - late
    base = e.select(F.col("event_id").alias("id"), (F.col("event_id") * 2).alias("seq"), ts.cast("long").alias("ts"), F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("ticker"), F.when(F.col("event_id") % 101 != 0, F.col("value")).alias("price"), F.lit(1).cast("long").alias("volume"))
    return base.unionByName(base.filter("id % 66 = 0").withColumn("seq", F.col("seq") + 1))
