"""Exact percentiles without sorting a group in one task, and column profiles as sketches that are kept by day and merged."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact_percentile(df: DataFrame, keys: Sequence[str], value: str, q: float, where: str, cells: int = 1024) -> DataFrame:
    """(keys, percentile) of each group, interpolated as Spark's percentile() is; nulls do not count, groups of nulls only are left out.

    The two values about the place are looked for in passes. A pass counts a group's rows by `cells` cells of the range in
    which a value is known to lie, combined before the shuffle, and the cell that holds its rank is the next range, by its
    own extremes; so a group is some 2 * cells rows at most, whatever its size. A pass leaves the least and the greatest
    value in different cells, so it ends; what is left between passes is written below `where`, two rows a group.
    """
    spark = df.sparkSession
    names = [f"__k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(value).cast("double").alias("__v")).filter("__v is not null")
    ends = rows.groupBy(*names).agg(F.count("*").alias("__n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
    place = F.lit(float(q)) * (F.col("__n") - 1)
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.floor(place).alias("rank")), F.struct(F.lit(1).alias("side"), F.ceil(place).alias("rank")))).alias("x")
    # without keys the one group has a count of 0 for no rows
    state = ends.filter("__n > 0").select(*names, (place - F.floor(place)).alias("share"), "lo", "hi", sides).select(*names, "share", "lo", "hi", "x.side", "x.rank")
    schema, kept = state.schema, None
    while True:
        path = f"{where.rstrip('/')}/percentile-{uuid.uuid4().hex}"
        state.write.parquet(path)
        kept = spark.read.schema(schema).parquet(path)
        open_ = kept.filter("lo < hi")
        if open_.isEmpty():
            break
        same = F.lit(True)
        for n in names:
            same = same & F.col(f"r.{n}").eqNullSafe(F.col(f"s.{n}"))
        inside = rows.alias("r").join(open_.alias("s"), same & F.col("__v").between(F.col("lo"), F.col("hi")))
        cell = F.least(F.floor((F.col("__v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * cells), F.lit(cells - 1))
        cell = F.when(F.col("__v") == F.col("hi"), F.lit(cells - 1)).otherwise(cell).alias("cell")
        own = [*[F.col(f"s.{n}").alias(n) for n in names], "share", "side", "rank"]
        counted = inside.groupBy(*own, cell).agg(F.count("*").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy(*names, "side").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        found = counted.withColumn("before", before).filter((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n")))
        narrowed = found.select(*names, "share", "lo", "hi", "side", (F.col("rank") - F.col("before")).alias("rank"))
        state = kept.filter("lo = hi").unionByName(narrowed)
    two = kept.groupBy(*names).agg(F.max("share").alias("share"), F.max(F.when(F.col("side") == 0, F.col("lo"))).alias("low"), F.max(F.when(F.col("side") == 1, F.col("lo"))).alias("high"))
    between = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("low") * (1 - F.col("share")) + F.col("high") * F.col("share"))
    return two.filter("low is not null").select(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)], between.alias("percentile"))


_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "date", "timestamp")


def daily(df: DataFrame, day: str, columns: Sequence[str], top: int = 20) -> DataFrame:
    """(day, column_name, row_count, null_count, distinct_sketch, value_sketch, top_sketch): each column's values of a day, in one pass.

    Distinct values as a HyperLogLog sketch, the order of numbers (and times, as seconds) as a KLL sketch, null for other
    types, and frequent values as a sketch that counts up to 10,000 at once.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def number(c: str):
        return F.unix_timestamp(F.col(c).cast("timestamp")).cast("double") if kinds[c].startswith(("date", "timestamp")) else F.col(c).cast("double")

    each = []
    for c in columns:
        text = F.col(c).cast("string")
        sketch = F.kll_sketch_agg_double(number(c)) if kinds[c].startswith(_NUMBERS) else F.lit(None).cast("binary")
        top_ = F.call_function("approx_top_k_accumulate", text, F.lit(10_000))
        each.append(F.struct(F.lit(c).alias("column_name"), F.count("*").alias("row_count"), F.count_if(F.col(c).isNull()).alias("null_count"), F.hll_sketch_agg(text, 14).alias("distinct_sketch"), sketch.alias("value_sketch"), top_.alias("top_sketch")))
    return df.groupBy(F.to_date(day).alias("day")).agg(F.array(*each).alias("x")).select("day", F.explode("x").alias("x")).select("day", "x.*")


def merged(sketches: DataFrame, top: int = 5) -> DataFrame:
    """(column_name, row_count, null_count, distinct_values, median, frequent) over the days of daily()."""
    both = sketches.groupBy("column_name").agg(
        F.sum("row_count").alias("row_count"),
        F.sum("null_count").alias("null_count"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("distinct_values"),
        F.count("value_sketch").alias("ordered"),
        F.kll_merge_agg_double("value_sketch").alias("values"),
        F.call_function("approx_top_k_estimate", F.call_function("approx_top_k_combine", F.col("top_sketch"), F.lit(10_000)), F.lit(top)).alias("frequent"),
    )
    return both.withColumn("median", F.when(F.col("ordered") > 0, F.kll_sketch_get_quantile_double("values", F.lit(0.5)))).drop("values", "ordered")
