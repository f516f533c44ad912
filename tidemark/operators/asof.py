"""Point-in-time (as-of) joins."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_in_one(left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str, tie: Sequence[str] = (), prefix: str = "feature_") -> DataFrame:
    """What asof_join gives, with each key's rows sorted by one task: for keys that are known to be small.

    Both sides go through one shuffle by key, sorted by time with right rows first, and the last right row so far
    is carried on: linear in both sides, where a range join is quadratic in a key's rows. Right columns get the
    prefix; they are null where no right row is early enough, or a key or time is null.
    """
    payload = F.struct(*[F.col(f"`{c}`").alias(prefix + c) for c in right.columns if c not in keys])
    own = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    names = [f"__k{i}" for i in range(len(keys))]
    r = right.filter(F.col(right_ts).isNotNull()).select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(right_ts).alias("__ts"), F.lit(0).alias("__side"), F.struct(*[F.col(t) for t in tie] or [F.lit(0)]).alias("__tie"), payload.alias("__right"))
    x = left.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(left_ts).alias("__ts"), F.lit(1).alias("__side"), own.alias("__left"))
    both = r.unionByName(x, allowMissingColumns=True)
    order = Window.partitionBy(*names).orderBy("__ts", "__side", "__tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    usable = F.col("__ts").isNotNull()
    for n in names:
        usable = usable & F.col(n).isNotNull()
    found = both.withColumn("__found", F.when(usable, F.last("__right", ignorenulls=True).over(order))).filter("__side = 1")
    return found.select("__left.*", "__found.*")


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str, tie: Sequence[str] = (), prefix: str = "feature_", slot: Callable[[Column], Column] = F.to_date) -> DataFrame:
    """Each left row with the last right row of its keys at or before its time; ties by `tie`, the largest wins.

    For keys of any size: rows are sorted by key and slot of time (a day, if not told otherwise), and row_number picks the last
    right row of each earlier slot, one row a slot, for the left rows that have none in their own. slot must not decrease with
    time. Right columns get the prefix; they are null where no right row is early enough, or a key or time is null.
    """
    order = F.struct(right_ts, *tie)
    inside = asof_in_one(left.withColumn("__slot", slot(F.col(left_ts))), right.withColumn("__slot", slot(F.col(right_ts))), [*keys, "__slot"], left_ts, right_ts, tie, prefix)
    # the last right row of each key and slot, then of all slots before one that has left rows
    newest = F.row_number().over(Window.partitionBy(*keys, "__slot").orderBy(order.desc()))
    ends = right.filter(F.col(right_ts).isNotNull()).withColumn("__slot", slot(F.col(right_ts))).withColumn("__rank", newest).filter("__rank = 1")
    payload = F.struct(*[F.col(f"`{c}`").alias(prefix + c) for c in right.columns if c not in keys])
    ends = ends.select(*keys, "__slot", payload.alias("__end"))
    asked = left.select(*keys, slot(F.col(left_ts)).alias("__slot")).distinct()
    both = ends.unionByName(asked, allowMissingColumns=True).groupBy(*keys, "__slot").agg(F.first("__end", ignorenulls=True).alias("__end"))
    before = Window.partitionBy(*keys).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    names = [f"__k{i}" for i in range(len(keys))]
    carried = both.withColumn("__before", F.last("__end", ignorenulls=True).over(before))
    carried = carried.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col("__slot").alias("__at"), "__before")
    on = F.col("__slot") == F.col("__at")
    for k, n in zip(keys, names, strict=True):
        on = on & (F.col(k) == F.col(n))
    found = [c for c in right.columns if c not in keys]
    joined = inside.join(carried, on, "left")
    own = F.col(prefix + right_ts).isNotNull()
    return joined.select(*[F.col(f"`{c}`") for c in left.columns], *[F.when(own, F.col(prefix + c)).otherwise(F.col(f"__before.{prefix}{c}")).alias(prefix + c) for c in found])
