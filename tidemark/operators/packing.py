"""Compaction by bin packing inside partition folders, and zone maps from Parquet footers."""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Iterator, Sequence

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.layout import Store, files

register_pickle_by_value(sys.modules[__name__])


def bins(sizes: Sequence[int], target: int) -> list[list[int]]:
    """Places of sizes, packed first fit by falling size into bins of at most `target`; what is larger stands alone."""
    out: list[list[int]] = []
    room: list[int] = []
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        fits = next((b for b, r in enumerate(room) if sizes[k] <= r), None)
        if fits is None:
            out.append([])
            room.append(target)
            fits = len(out) - 1
        out[fits].append(k)
        room[fits] -= sizes[k]
    return out


def plan(listed: Sequence[tuple[str, int]], target: int, small: float = 0.75) -> list[tuple[str, list[str]]]:
    """(folder, names) of the groups of files that gain by becoming one: files under `small` of the target, two or more, of one folder."""
    folders: dict[str, list[tuple[str, int]]] = {}
    for name, size in listed:
        if name.endswith(".parquet") and size < small * target and not any(part.startswith(("_", ".")) for part in name.split("/")):
            folders.setdefault(name.rpartition("/")[0], []).append((name, size))
    groups = []
    for folder, own in sorted(folders.items()):
        groups += [(folder, [own[k][0] for k in b]) for b in bins([s for _, s in own], target) if len(b) > 1]
    return groups


def recover(spark: SparkSession, path: str) -> int:
    """End what compactions of a table that stopped on the way had begun to put in place; how many those were."""
    store = Store(spark, path)
    begun = [n for n, _ in store.files(f"{path}/_compaction") if n.endswith("journal.json")]
    for name in begun:
        _put(store, path, json.loads(store.read(f"{path}/_compaction/{name}")), f"{path}/_compaction/{name.rsplit('/', 1)[0]}")
    store.delete(f"{path}/_compaction")
    return len(begun)


def _put(store: Store, path: str, journal: dict, staged: str) -> None:
    for source, target in journal["add"]:
        if store.exists(f"{staged}/{source}"):
            store.rename(f"{staged}/{source}", f"{path}/{target}")
    for name in journal["remove"]:
        store.delete(f"{path}/{name}")
    store.delete(staged)


def compact(spark: SparkSession, path: str, target: int = 128 << 20, small: float = 0.75) -> dict[str, int]:
    """Rewrite a table's small files in place, folder by folder; files_before, files_after, rewritten.

    One job rewrites all groups, a group a file of about `target` bytes; other files are not touched, nor read. A journal
    names what comes and goes before anything does: a compaction that stops before it changes nothing, and one that
    stops after it is ended by recover(), with which the next one begins. Until then readers may see a group twice, so
    readers must not run beside a compaction; tables with readers are published by versions.
    """
    recover(spark, path)
    store = Store(spark, path)
    listed = store.files(path)
    before = sum(n.endswith(".parquet") for n, _ in listed)
    groups = plan(listed, target, small)
    if not groups:
        return {"files_before": before, "files_after": before, "rewritten": 0}
    staged = f"{path}/_compaction/{uuid.uuid4().hex}"
    base = store.fs.makeQualified(store.path(path)).toString().rstrip("/")
    named = spark.createDataFrame([(f"{base}/{n}", k) for k, (_, names) in enumerate(groups) for n in names], "file string, bin int")
    rows = spark.read.parquet(*[f"{base}/{n}" for _, names in groups for n in names])
    # a path as the listing has it: percent signs of the URL decoded, plus signs kept
    own = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")
    dealt = rows.select("*", own.alias("__file")).join(named.withColumnsRenamed({"bin": "__bin"}), F.col("__file") == F.regexp_replace("file", "^file:/+", "file:/")).select(*rows.columns, "__bin")
    dealt.repartition(len(groups), "__bin").write.partitionBy("__bin").parquet(f"{staged}/files")
    made = {int(n.split("/")[0].split("=")[1]): n for n, _ in store.files(f"{staged}/files") if n.endswith(".parquet")}
    add = [(f"files/{made[k]}", f"{folder}/compacted-{uuid.uuid4().hex}.parquet".lstrip("/")) for k, (folder, _) in enumerate(groups) if k in made]
    journal = {"add": add, "remove": [n for _, names in groups for n in names]}
    store.write(f"{staged}/journal.json", json.dumps(journal).encode())
    _put(store, path, journal, staged)
    store.delete(f"{path}/_compaction")
    return {"files_before": before, "files_after": before - len(journal["remove"]) + len(add), "rewritten": len(journal["remove"])}


def zones(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """(file, row_group, row_count, least_<c>, greatest_<c> of each column) from the footers of a table's files, read by tasks; rows are not.

    Null where a footer has no statistics of a column or all of it is null.
    """
    kinds = {f.name: f.dataType.simpleString() for f in spark.read.parquet(path).schema}
    out = ["file string", "row_group int", "row_count long", *[f"{end}_{c} {kinds[c]}" for c in columns for end in ("least", "greatest")]]

    def run(batches: Iterator) -> Iterator:
        import pandas as pd
        import pyarrow.parquet as pq
        from pyarrow import fs

        for batch in batches:
            found = []
            for file in batch["path"]:
                where, name = fs.FileSystem.from_uri(file.replace("file:/", "file:///", 1) if file.startswith("file:/") and not file.startswith("file://") else file)
                with where.open_input_file(name) as f:
                    meta = pq.ParquetFile(f).metadata
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    ends = {group.column(k).path_in_schema: group.column(k).statistics for k in range(group.num_columns)}
                    row = [file, g, group.num_rows]
                    for c in columns:
                        s = ends.get(c)
                        row += [s.min, s.max] if s is not None and s.has_min_max else [None, None]
                    found.append(row)
            yield pd.DataFrame(found, columns=[c.split()[0] for c in out]).astype(object)

    listed = files(spark, path).select("path")
    return listed.repartition(max(1, min(listed.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))).mapInPandas(run, ", ".join(out))


def write_zones(spark: SparkSession, path: str, columns: Sequence[str]) -> None:
    """Keep a table's zones beside its files, in a folder that readers of the table pass over."""
    zones(spark, path, columns).write.mode("overwrite").parquet(f"{path}/_zones")


def pick(spark: SparkSession, path: str, ranges: dict[str, tuple]) -> tuple[list[str], int]:
    """(files that may hold rows in all ranges, number of files) by the kept zones; ranges are column -> (least, greatest), None for open."""
    kept = spark.read.parquet(f"{path}/_zones")
    may = F.lit(True)
    for c, (low, high) in ranges.items():
        unknown = F.col(f"least_{c}").isNull()
        may = may & (unknown | ((F.lit(True) if high is None else F.col(f"least_{c}") <= F.lit(high)) & (F.lit(True) if low is None else F.col(f"greatest_{c}") >= F.lit(low))))
    return [r.file for r in kept.filter(may).select("file").distinct().orderBy("file").collect()], kept.select("file").distinct().count()


def between(spark: SparkSession, path: str, ranges: dict[str, tuple]) -> DataFrame:
    """The rows of a table in all ranges; only the files that zones leave are listed and opened."""
    picked, _ = pick(spark, path, ranges)
    inside = F.lit(True)
    for c, (low, high) in ranges.items():
        inside = inside & (F.lit(True) if low is None else F.col(c) >= F.lit(low)) & (F.lit(True) if high is None else F.col(c) <= F.lit(high))
    if not picked:
        return spark.read.parquet(path).filter(F.lit(False))
    return spark.read.option("basePath", path).parquet(*picked).filter(inside)
