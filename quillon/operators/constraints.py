"""Checks of rows, as DataFrames of violations: empty if all is well."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.spec import CollectionSpec, foreign_key


def normalize(unique: Sequence) -> list[tuple[str, ...]]:
    return [(u,) if isinstance(u, str) else tuple(u) for u in unique]


def unique_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys and n of keys that several rows have; rows with a null in a key are exempt."""
    present = df
    for k in keys:
        present = present.where(F.col(k).isNotNull())
    return present.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def taken(new: DataFrame, stored: DataFrame, keys: Sequence[str], id_field: str = "id") -> DataFrame:
    """Rows of new whose key another stored row has."""
    other = stored.select(F.col(id_field).alias("_other"), *[F.col(k).alias(f"_{k}") for k in keys])
    same = F.col(id_field) != F.col("_other")
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    return new.join(other, same, "left_semi")


def fk_violations(df: DataFrame, key: str, target: DataFrame, target_id: str = "id") -> DataFrame:
    """Rows whose key isn't null and has no target."""
    ids = target.select(F.col(target_id).alias("_id"))
    return df.where(F.col(key).isNotNull()).join(ids, F.col(key) == F.col("_id"), "left_anti")


def restrict_violations(gone: DataFrame, referrers: DataFrame, key: str, id_field: str = "id") -> DataFrame:
    """Rows of gone that are still referred to."""
    keys = referrers.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"))
    return gone.join(keys, F.col(id_field) == F.col("_key"), "left_semi")


def refs(specs: Mapping[str, CollectionSpec], name: str) -> list[tuple[str, str, str]]:
    """(relation, key, target) of the refs of a collection."""
    return [(r, foreign_key(specs, name, r), rel.target) for r, rel in specs[name].relationships.items() if rel.kind == "ref"]


def referrers(specs: Mapping[str, CollectionSpec], target: str) -> list[tuple[str, str]]:
    """(collection, key) of the refs to a collection."""
    return [(c, key) for c in specs for _, key, t in refs(specs, c) if t == target]


def audit(specs: Mapping[str, CollectionSpec], frames: Mapping[str, DataFrame]) -> DataFrame | None:
    """collection, id, field, value and target of all keys without target."""
    out = None
    for c in specs:
        for _, key, target in refs(specs, c):
            if key in frames[c].columns and target in frames:
                bad = fk_violations(frames[c], key, frames[target], specs[target].id_field)
                bad = bad.select(F.lit(c).alias("collection"), F.col(specs[c].id_field).cast("string").alias("id"), F.lit(key).alias("field"), F.col(key).cast("string").alias("value"), F.lit(target).alias("target"))
                out = bad if out is None else out.unionByName(bad)
    return out


def issues(df: DataFrame, spec: CollectionSpec) -> Column:
    """Names of columns that are null but must not be."""
    needed = [f.name for f in spec.schema if not f.nullable and f.name in df.columns]
    return F.array_compact(F.array(*[F.when(F.col(f"`{c}`").isNull(), F.lit(c)) for c in needed])) if needed else F.array().cast("array<string>")
