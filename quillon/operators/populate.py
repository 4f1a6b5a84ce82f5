"""Relationships as joins: populate, and predicates over related rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.errors import CollectionNotFoundError, DanglingReferenceError
from quillon.operators import predicate, projection
from quillon.spec import CollectionSpec, foreign_key

MOST_LEVELS = 5


def _target(specs: Mapping[str, CollectionSpec], frames: Mapping[str, DataFrame], name: str) -> DataFrame:
    if name not in frames:
        raise CollectionNotFoundError(f"no collection {name}", collection=name)
    return frames[name]


def populate(df: DataFrame, source: str, wanted: Mapping, specs: Mapping[str, CollectionSpec], frames: Mapping[str, DataFrame], on_dangling: str = "error", level: int = 1) -> DataFrame:
    """Adds a struct for each ref and an array of structs, by id, for each inverse relation that is wanted.

    Values of ``wanted`` are true or nested objects; these may have ``select``. An inverse relation is aggregated by its
    key before the join, with only the columns that are wanted. on_dangling "error" looks for keys without target first
    (one anti join that stops at the first); "null" leaves them null.
    """
    for name, below in (wanted or {}).items():
        rel = specs[source].relationships.get(name)
        if rel is None or not below or rel.target not in frames:
            continue
        key, target = foreign_key(specs, source, name), _target(specs, frames, rel.target)
        ident, own = specs[rel.target].id_field, specs[source].id_field
        chosen = below.get("select") if isinstance(below, Mapping) else None
        deeper = (below.get("populate", {k: v for k, v in below.items() if k != "select"})) if isinstance(below, Mapping) else {}
        if deeper and level < MOST_LEVELS:
            target = populate(target, rel.target, deeper, specs, frames, on_dangling, level + 1)
        if rel.kind == "ref":
            if key not in df.columns:
                df = df.withColumn(name, F.lit(None))
                continue
            if on_dangling == "error":
                lost = df.where(F.col(key).isNotNull()).join(target.select(F.col(ident).alias("_id")), F.col(key) == F.col("_id"), "left_anti").select(key).first()
                if lost is not None:
                    raise DanglingReferenceError(f"{source}.{key} = {lost[0]!r} has no row in {rel.target}", collection=source, field=key, value=lost[0])
            packed = target.select(F.col(ident).alias("_id"), F.struct("*").alias(name))
            if chosen:
                kept = projection.select(target, chosen)
                packed = target.select(F.col(ident).alias("_id"), F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias(name))
            df = df.drop(name).join(packed, F.col(key) == F.col("_id"), "left").drop("_id")
        else:
            columns = projection.select(target, chosen).columns if chosen else target.columns
            item = F.struct(F.col(ident).alias("_order"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"))
            many = target.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_id")).agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["_row"]).alias(name))
            empty = F.array().cast(many.schema[name].dataType)
            df = df.drop(name).join(many, F.col(own) == F.col("_id"), "left").withColumn(name, F.coalesce(F.col(name), empty)).drop("_id")
    return df


def where(df: DataFrame, source: str, condition: Mapping | None, specs: Mapping[str, CollectionSpec], frames: Mapping[str, DataFrame], custom=None) -> DataFrame:
    """Filters rows; conditions on relations at the top level or in ``$and`` are semi and anti joins, in ``$or`` and ``$not``
    flags that such joins make."""
    plain, related = {}, []
    for k, v in (condition or {}).items():
        if k in specs[source].relationships and k not in df.columns and isinstance(v, Mapping):
            related.append((k, v))
        elif k == "$and" and isinstance(v, (list, tuple)) and any(_relational(x, source, specs, df) for x in v):
            for x in v:
                df = where(df, source, x, specs, frames, custom)
        elif k in ("$or", "$not") and _relational({k: v}, source, specs, df):
            df = _flagged(df, source, k, v, specs, frames, custom)
        else:
            plain[k] = v
    df = df.where(predicate.where(df.schema, plain, custom)) if plain else df
    for name, v in related:
        df = _related(df, source, name, v, specs, frames, custom)
    return df


def _relational(condition, source: str, specs, df: DataFrame) -> bool:
    if isinstance(condition, (list, tuple)):
        return any(_relational(x, source, specs, df) for x in condition)
    if not isinstance(condition, Mapping):
        return False
    return any((k in specs[source].relationships and k not in df.columns) or (k in ("$or", "$and", "$not") and _relational(v, source, specs, df)) for k, v in condition.items())


def _flagged(df: DataFrame, source: str, key: str, value, specs, frames, custom) -> DataFrame:
    ident, columns = specs[source].id_field, df.columns
    members = list(value) if key == "$or" else [value]
    flags = []
    for i, member in enumerate(members):
        if _relational(member, source, specs, df):
            held = where(df.select(*columns), source, member, specs, frames, custom).select(F.col(ident).alias(f"_i{i}")).distinct()
            df = df.join(held, F.col(ident) == F.col(f"_i{i}"), "left")
            flags.append(F.col(f"_i{i}").isNotNull())
        else:
            flags.append(predicate.where(df.schema, member, custom))
    test = F.lit(False)
    for f in flags:
        test = test | f
    return df.where(test if key == "$or" else ~test).select(*columns)


def _related(df: DataFrame, source: str, name: str, value: Mapping, specs, frames, custom) -> DataFrame:
    rel, key = specs[source].relationships[name], foreign_key(specs, source, name)
    target, own = _target(specs, frames, rel.target), specs[source].id_field
    if rel.kind == "ref":
        if not value:
            return df
        held = where(target, rel.target, value, specs, frames, custom).select(F.col(specs[rel.target].id_field).alias("_id"))
        return df.join(held, F.col(key) == F.col("_id"), "left_semi")
    for op, condition in value.items():
        fits = where(target, rel.target, condition, specs, frames, custom)
        if op == "$every":  # no related row that doesn't fit
            ident = specs[rel.target].id_field
            fits = target.join(fits.select(F.col(ident).alias("_fit")), F.col(ident) == F.col("_fit"), "left_anti")
        keys = fits.where(F.col(key).isNotNull()).select(F.col(key).alias("_id")).distinct()
        df = df.join(keys, F.col(own) == F.col("_id"), "left_semi" if op == "$some" else "left_anti")
    return df
