"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

A budget of words is shared out over sources by weight. No source may be repeated more than max_epochs times,
so its target stops at max_epochs * size and the excess goes to the others by weight, until none is above. That
fixed point is taken in closed form: with sources ordered by cap / weight, the first k are clamped and the rest
share what is left. One row a source takes part, so the ordering costs nothing next to the documents.

A source whose target is e epochs takes each document floor(e) times, and once more those documents that a
seeded order puts first, up to the words still missing. The order is a hash of seed, id and text. To find the
place in the order without sorting a source in one task, sources are cut into hash ranges whose sums are ordered
first; only within a range are documents ordered. A hot source spreads over all ranges.

Null sources form a group of their own, ordered last; null texts have size 0. A document of size 0 is never
taken. Equal rows stand at one place in the order, so all or none of them are taken once more; each counts. An empty table gives an empty result. A source of size 0 gets the target 0, and when every source is clamped
the mix is as large as the caps allow. Other columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import WORD, cut

#: Documents for which there is a hash range in each source, beyond the first 1024.
PER_RANGE = 100_000


def water_fill(sizes: DataFrame, share: float, max_epochs: float, weights: tuple[float, ...]) -> DataFrame:
    """(source, source_size) -> + weight, target. Weights repeat over the sources by code point, null last.

    The windows have no partition key: they order one row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    cap = F.col("source_size") * F.lit(float(max_epochs))
    s = sizes.withColumn("weight", F.get(cycle, (F.row_number().over(by_name) - 1) % len(weights)))
    s = s.withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    s = s.withColumn("left", F.greatest(total - F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.lit(0.0)))
    s = s.withColumn("open", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", F.col("left") / F.col("open"))
    # the first source in order whose ratio reaches the level of what is left there ends the clamping
    s = s.withColumn("stop", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", F.col("level").alias("at")))).over(everything))
    target = F.when(F.col("stop").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("stop.at") * F.col("weight")))
    return s.select("source", "source_size", "weight", target.alias("target"))


def mix(
    df: DataFrame,
    *,
    id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    share: float = 1.5,
    max_epochs: float = 2.0,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    seed: int = 42,
    ranges: int | None = None,
) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, epochs, copies (how often the mix takes it), place (its hash).

    Texts are read once: sizes and places are a checkpoint, and no text is shuffled. The number of ranges grows with the table.
    """
    size = F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long")
    place = _place(seed, id, text)
    sized = cut(df.select(F.col(f"`{id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), size.alias("size"), place.alias("place")))
    ranges = ranges or max(1024, sized.count() // PER_RANGE)
    sized = sized.withColumn("range", F.pmod("place", F.lit(ranges)))
    slots = sized.groupBy("source", "range").agg(F.sum("size").alias("slot_size"))
    up_to = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    targets = water_fill(slots.groupBy("source").agg(F.sum("slot_size").alias("source_size")), share, max_epochs, weights)
    slots = slots.withColumn("slot_start", F.coalesce(F.sum("slot_size").over(up_to), F.lit(0)))
    slots = _same(slots, targets, ["source"])
    whole = F.floor("epochs")
    slots = slots.withColumn("epochs", F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0)))
    slots = slots.withColumn("whole", whole.cast("long")).withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size"))
    # a range that lies wholly inside or outside the extra words needs no order among its documents
    full = F.col("slot_start") + F.col("slot_size") <= F.col("extra")
    none = F.col("slot_start") >= F.col("extra")
    slots = slots.withColumn("edge", ~(full | none)).withColumn("more", F.when(full, 1).otherwise(0))
    columns = ["source_size", "target", "epochs", "whole", "extra", "slot_start", "edge", "more"]
    joined = _same(sized, slots.select("source", "range", *columns), ["source", "range"])
    inside = joined.filter(~F.col("edge")).withColumn("copies", F.col("whole") + F.col("more"))
    edge = joined.filter(F.col("edge"))
    # equal rows stand at one place and share their fate
    up_to_here = F.sum("size").over(Window.partitionBy("source", "range").orderBy("place", "doc_id"))
    equals = F.sum("size").over(Window.partitionBy("source", "range", "place", "doc_id"))
    edge = edge.withColumn("equals", equals).withColumn("start", F.col("slot_start") + up_to_here - F.col("equals"))
    # the document on the border is taken when more than half of it is still missing
    edge = edge.withColumn("copies", F.col("whole") + F.when(F.col("start") + F.col("equals") / 2 < F.col("extra"), 1).otherwise(0))
    out = ["doc_id", "source", "size", "source_size", "target", "epochs", "copies", "place"]
    return inside.select(out).unionByName(edge.select(out))


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which null keys meet; the keys come from the left. Spark compares the sizes and picks the way."""
    on: Column = F.lit(True)
    for k in keys:
        on = on & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    others = [F.col(f"r.{c}") for c in right.columns if c not in keys]
    return left.alias("l").join(right.alias("r"), on).select(*[F.col(f"l.{c}") for c in left.columns], *others)


def _place(seed: int, id: str, text: str) -> Column:
    return F.xxhash64(F.lit(seed), F.col(f"`{id}`"), F.col(f"`{text}`"))


def repeated(df: DataFrame, *, id: str = "doc_id", source: str = "source", text: str = "text", seed: int = 42, **options) -> DataFrame:
    """The mix itself: each document as often as mix() says, with df's own columns. A text that is in two sources under one id, or
    under none, is taken from each as often as that source takes it."""
    taken = mix(df, id=id, source=source, text=text, seed=seed, **options).filter("copies > 0").select("doc_id", "source", "place", "copies").distinct()
    own = [F.col(f"`{id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), _place(seed, id, text).alias("place")]
    joined = _same(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *own), taken, ["doc_id", "source", "place"])
    return joined.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies").cast("long"))).alias("copy")).select("row.*")
