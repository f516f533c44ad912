"""Declared schema contracts: normalise, align, validate, quarantine, keep the latest."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import CASTS, blank_to_null, typed
from tidemark.operators.dedup import latest_by_key


@dataclass(frozen=True)
class Contract:
    """Columns of a dataset: which are required, their types, and allowed values."""

    dataset: str
    required: tuple[str, ...]
    nullable: tuple[str, ...] = ()
    types: dict[str, str] = field(default_factory=dict)
    enums: dict[str, tuple] = field(default_factory=dict)
    blank_as_null: bool = True

    @property
    def columns(self) -> tuple[str, ...]:
        return self.required + self.nullable


def normalize_columns(df: DataFrame) -> DataFrame:
    """Names trimmed and in lower case, in one projection."""
    return df.toDF(*[c.strip().lower() for c in df.columns])


def align(df: DataFrame, contract: Contract) -> DataFrame:
    """The contract's columns in its order: unknown ones dropped, missing ones null."""
    have = set(df.columns)
    return df.select(*[F.col(f"`{c}`") if c in have else F.lit(None).cast("string").alias(c) for c in contract.columns])


def _problem(c: str, contract: Contract) -> Column:
    """What is wrong with a column's value, null if nothing; each test is total, so no row falls between."""
    raw = blank_to_null(F.col(c)) if contract.blank_as_null else F.col(c)
    kind = contract.types.get(c, "string")
    out = F.when(F.lit(c in contract.required) & raw.isNull(), F.lit(f"{c}: required"))
    if kind != "string":
        out = out.when(raw.isNotNull() & typed(raw, kind).isNull(), F.lit(f"{c}: not {kind}"))
    if c in contract.enums:
        out = out.when(raw.isNotNull() & ~F.coalesce(typed(raw, kind).isin(*contract.enums[c]), F.lit(False)), F.lit(f"{c}: not allowed"))
    return out


def validate(df: DataFrame, contract: Contract) -> tuple[DataFrame, DataFrame]:
    """(valid rows in the contract's types, failed rows with failure_reason and raw_payload). Both come from one plan; together they are all rows."""
    rows = align(normalize_columns(df), contract)
    reason = F.array_join(F.array_compact(F.array(*[_problem(c, contract) for c in contract.columns])), "; ")
    judged = rows.withColumn("failure_reason", reason)
    clean = [typed(blank_to_null(F.col(c)) if contract.blank_as_null else F.col(c), contract.types.get(c, "string")).alias(c) for c in contract.columns]
    valid = judged.filter("failure_reason = ''").select(*clean)
    failed = judged.filter("failure_reason <> ''").select("failure_reason", F.to_json(F.struct(*contract.columns)).alias("raw_payload"))
    return valid, failed


def silver(df: DataFrame, contract: Contract, keys: Sequence[str], newest: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """validate(), then the newest valid row of each key."""
    valid, failed = validate(df, contract)
    return latest_by_key(valid, keys, newest), failed


def differences(df: DataFrame, contract: Contract) -> DataFrame:
    """(column_name, problem): missing, extra and incompatible columns of a table against its contract."""
    have = dict(df.dtypes)
    rows = [(c, "missing") for c in contract.columns if c not in have]
    rows += [(c, "extra") for c in have if c not in contract.columns]
    rows += [(c, "incompatible") for c in contract.columns if c in have and c in contract.types and have[c] not in (CASTS.get(contract.types[c], "boolean"), contract.types[c])]
    return df.sparkSession.createDataFrame(sorted(rows), "column_name string, problem string")
