"""Substring search by a trigram index, and pages by a rank index over sorted blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def grams(text: Column) -> Column:
    """The distinct trigrams of a lower-cased text. Its characters are an array first, so that a long text is gone through once."""
    places = lambda cs: F.when(F.size(cs) >= 3, F.sequence(F.lit(0), F.size(cs) - 3)).otherwise(F.array().cast("array<int>"))
    of = lambda cs: F.transform(places(cs), lambda k: F.concat(F.get(cs, k), F.get(cs, k + 1), F.get(cs, k + 2)))
    # bound as a variable: an expression inside a lambda is worked out for every element
    return F.array_distinct(F.flatten(F.transform(F.array(F.split(F.lower(text), "")), of)))


def write_trigrams(df: DataFrame, id: str, text: str, path: str, tasks: int) -> None:
    """An inverted index: (gram, id) sorted by gram over files, and how many rows have each gram."""
    postings = df.select(F.explode(grams(F.col(text))).alias("gram"), F.col(id).alias("id"))
    # by gram and id, so that a gram that is everywhere is cut over files too
    postings.repartitionByRange(tasks, "gram", "id").sortWithinPartitions("gram", "id").write.mode("overwrite").parquet(f"{path}/postings")
    df.sparkSession.read.parquet(f"{path}/postings").groupBy("gram").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/frequency")


def candidates(terms: DataFrame, path: str, rarest: int = 4) -> DataFrame:
    """(term, id): rows that have the term's `rarest` trigrams of the index; terms(term), each of three characters or more."""
    spark = terms.sparkSession
    own = terms.select("term").distinct().select("term", F.explode(grams(F.col("term"))).alias("gram"))
    known = own.join(spark.read.parquet(f"{path}/frequency"), "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    order = Window.partitionBy("term").orderBy("n", "gram")  # a term's grams: as many as it has characters
    few = known.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= rarest)
    asked = few.withColumn("asked", F.count("*").over(Window.partitionBy("term"))).select("term", "gram", "asked")
    met = asked.join(spark.read.parquet(f"{path}/postings"), "gram")
    return met.groupBy("term", "id").agg(F.count("*").alias("got"), F.max("asked").alias("asked")).filter("got = asked").select("term", "id")


def containing(df: DataFrame, id: str, text: str, terms: DataFrame, path: str, rarest: int = 4) -> DataFrame:
    """(term, id) of the rows whose text contains the term, whatever the case: the index' candidates, each verified. Shorter terms are scanned for."""
    long = terms.filter(F.length("term") >= 3)
    rows = df.select(F.col(id).alias("id"), F.col(text).alias("__text"))
    found = candidates(long, path, rarest).join(rows, "id").filter(F.lower("__text").contains(F.lower("term"))).select("term", "id")
    short = [r.term for r in terms.filter(F.length("term") < 3).select("term").distinct().collect()]
    for t in short:
        found = found.unionByName(rows.filter(F.lower("__text").contains(t.lower())).select(F.lit(t).alias("term"), "id"))
    return found


def write_blocks(df: DataFrame, order: Sequence[str], path: str, block_rows: int, tasks: int) -> None:
    """A table sorted over files of at most block_rows rows, and an index with each file's first rank and greatest key. `order` must be unique and not null."""
    spark = df.sparkSession
    df.repartitionByRange(tasks, *order).sortWithinPartitions(*order).write.mode("overwrite").option("maxRecordsPerFile", block_rows).parquet(f"{path}/rows")
    key = F.struct(*order)
    # one row a file from here on
    ends = spark.read.parquet(f"{path}/rows").groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n"), F.min(key).alias("least"), F.max(key).alias("greatest"))
    before = F.sum("n").over(Window.orderBy("least").rowsBetween(Window.unboundedPreceding, -1))
    ends.withColumn("first_rank", F.coalesce(before, F.lit(0))).coalesce(1).write.mode("overwrite").parquet(f"{path}/blocks")


def _ranked(spark: SparkSession, path: str, order: Sequence[str], some: DataFrame) -> DataFrame:
    """Rows of some blocks that follow one another, with their ranks."""
    files = some.orderBy("first_rank").collect()
    if not files:
        return spark.read.parquet(f"{path}/rows").filter(F.lit(False)).withColumn("__rank", F.lit(0))
    rows = spark.read.parquet(*[r.file for r in files])
    return rows.withColumn("__rank", F.row_number().over(Window.orderBy(*order)) - 1 + files[0].first_rank)  # a page's blocks only


def page(spark: SparkSession, path: str, order: Sequence[str], offset: int, limit: int) -> DataFrame:
    """Rows offset to offset + limit of the order, from the blocks that hold them."""
    hit = spark.read.parquet(f"{path}/blocks").filter((F.col("first_rank") < offset + limit) & (F.col("first_rank") + F.col("n") > offset))
    return _ranked(spark, path, order, hit).filter(F.col("__rank").between(offset, offset + limit - 1)).drop("__rank")


def page_after(spark: SparkSession, path: str, order: Sequence[str], key: Sequence, limit: int) -> DataFrame:
    """The `limit` rows behind a key: keyset continuation, which needs no offset."""
    blocks = spark.read.parquet(f"{path}/blocks")
    mark = F.struct(*[F.lit(k).cast(blocks.schema["least"].dataType[n].dataType).alias(n) for k, n in zip(key, order, strict=True)])
    behind = blocks.filter(F.col("greatest") > mark)
    # the first of them may hold up to all but one row before the key
    first = behind.agg(F.min("first_rank").alias("r"), F.min_by("n", "first_rank").alias("n")).first()
    hit = behind.filter(F.col("first_rank") < (first.r or 0) + (first.n or 0) + limit)
    return _ranked(spark, path, order, hit).filter(F.struct(*order) > mark).orderBy(*order).limit(limit).drop("__rank")
