"""Select and computed fields."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType


def select(df: DataFrame, wanted: Sequence[str] | Mapping | None) -> DataFrame:
    """A list keeps top-level columns; an object projects by shape, in structs and in arrays of structs. Empty keeps all."""
    if not wanted:
        return df
    if isinstance(wanted, Mapping):
        return df.select(*[_shape(F.col(f"`{c}`"), df.schema[c].dataType, w).alias(c) for c, w in wanted.items() if c in df.columns and _wants(w)])
    return df.select(*[F.col(f"`{c}`") for c in wanted if c in df.columns])


def _wants(w) -> bool:
    return w is True or isinstance(w, Mapping)


def _shape(col: Column, kind: DataType, wanted) -> Column:
    if wanted is True or not wanted:
        return col
    if isinstance(kind, StructType):
        parts = [_shape(col.getField(f), kind[f].dataType, w).alias(f) for f, w in wanted.items() if f in kind.names and _wants(w)]
        return F.when(col.isNotNull(), F.struct(*parts)) if parts else col
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
        return F.transform(F.filter(col, lambda x: x.isNotNull()), lambda x: _shape(x, kind.elementType, wanted))
    return col


def computed(df: DataFrame, fields: Mapping) -> DataFrame:
    """Adds computed fields, all at once: each sees the stored columns, none sees another one."""
    if not fields:
        return df
    return df.withColumns({name: f() if callable(f) else f for name, f in fields.items()})


def strip_computed(df: DataFrame, fields: Mapping) -> DataFrame:
    return df.drop(*fields)


def merge_selections(*wanted: Mapping) -> dict:
    """The union of object selections."""
    out: dict = {}
    for w in wanted:
        for k, v in w.items():
            both = isinstance(v, Mapping) and isinstance(out.get(k), Mapping)
            out[k] = merge_selections(out[k], v) if both else True if out.get(k) is True else v
    return out
