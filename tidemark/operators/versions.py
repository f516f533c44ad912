"""Publication by numbered manifests: data folders that never change, and manifests that are created once.

<root>/data/<dataset>/<run>-<unique>/ holds what a run wrote of a dataset; <root>/manifests/<number>.json names the folders
of every dataset. A manifest is made by one step that fails if its number is taken, so a reader sees one
version or the next, of all datasets together, and of two writers one takes the number and the other tries the next one
on top of it. What a run leaves that ends on the way is not named by any manifest; vacuum() deletes it.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.layout import Store


def _numbers(store: Store, root: str) -> list[int]:
    if not store.exists(f"{root}/manifests"):
        return []
    # one listing: files that other writers are still naming may go while it is made
    names = [s.getPath().getName() for s in store.fs.listStatus(store.path(f"{root}/manifests"))]
    return sorted(int(n[: -len(".json")]) for n in names if n.endswith(".json"))


def manifest(spark: SparkSession, root: str, number: int | None = None) -> dict:
    """A version's manifest, the newest if not told otherwise: number, run_id, datasets (name -> folders). Number 0 is nothing yet."""
    store = Store(spark, root)
    number = max(_numbers(store, root), default=0) if number is None else number
    return json.loads(store.read(f"{root}/manifests/{number:012d}.json")) if number else {"number": 0, "run_id": None, "datasets": {}}


def read(spark: SparkSession, root: str, dataset: str, number: int | None = None) -> DataFrame:
    """A dataset as a version has it; folders that a later version leaves out stay readable until they are vacuumed."""
    folders = manifest(spark, root, number)["datasets"].get(dataset)
    if not folders:
        raise FileNotFoundError(f"no version of {dataset} below {root}")
    return spark.read.option("mergeSchema", "true").parquet(*[f"{root}/{f}" for f in folders])


def publish(datasets: dict[str, DataFrame], root: str, run_id: str, validate: Callable[[str, DataFrame], object] | None = None, append: bool = False) -> int:
    """Write datasets, check what was written (not empty, and `validate` says nothing false), and publish them in one version, whose number is returned.

    Datasets that are not given stay as they are. append adds to what a dataset has. On any failure the newest version
    stays what it was.
    """
    if not run_id.strip():
        raise ValueError("run_id must not be empty")
    spark = next(iter(datasets.values())).sparkSession
    store, written = Store(spark, root), {}
    try:
        for name, df in datasets.items():
            written[name] = f"data/{name}/{run_id}-{uuid.uuid4().hex}"
            df.write.parquet(f"{root}/{written[name]}")
            back = spark.read.schema(df.schema).parquet(f"{root}/{written[name]}")
            if back.isEmpty():
                raise ValueError(f"nothing to publish of {name}")
            if validate and validate(name, back) is False:
                raise ValueError(f"validation of {name} said no")
        return _commit(store, root, run_id, lambda old: {n: [*(old.get(n, []) if append else []), f] for n, f in written.items()})
    except Exception:
        for folder in written.values():
            store.delete(f"{root}/{folder}")
        raise


def _commit(store: Store, root: str, run_id: str, change: Callable[[dict], dict]) -> int:
    """Make the next manifest of the newest one; again if another writer was first."""
    store.fs.mkdirs(store.path(f"{root}/manifests"))
    while True:
        old = manifest(store.spark, root)
        new = {"number": old["number"] + 1, "run_id": run_id, "published_at": time.time(), "datasets": old["datasets"] | change(old["datasets"])}
        if store.create(f"{root}/manifests/{new['number']:012d}.json", json.dumps(new).encode()):
            return new["number"]


def roll_back(spark: SparkSession, root: str, number: int, run_id: str) -> int:
    """Publish an older version's datasets again, as a version of its own."""
    old = manifest(spark, root, number)["datasets"]
    return _commit(Store(spark, root), root, run_id, lambda _: old)


def vacuum(spark: SparkSession, root: str, keep: int = 2, older_than: float = 86_400.0) -> int:
    """Delete data folders that none of the newest `keep` manifests names, and the manifests before these; folders deleted.

    A folder younger than older_than seconds may be of a run that has yet to publish it and stays.
    """
    store = Store(spark, root)
    numbers = _numbers(store, root)
    named = {f for n in numbers[-keep:] for folders in manifest(spark, root, n)["datasets"].values() for f in folders}
    gone = 0
    for s in store.fs.globStatus(store.path(f"{root}/data/*/*")) or []:
        folder = "/".join(s.getPath().toString().rsplit("/", 3)[1:])
        if folder not in named and s.getModificationTime() / 1000 < time.time() - older_than:
            store.fs.delete(s.getPath(), True)
            gone += 1
    for n in numbers[:-keep]:
        store.delete(f"{root}/manifests/{n:012d}.json")
    return gone
