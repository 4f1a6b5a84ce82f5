"""Dot paths against a schema."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType


def resolve(schema: StructType, path: str) -> tuple[Column, DataType] | None:
    """The column at a path and its type, or None if the schema has none; numbers index arrays, names look maps up."""
    names = {f.name: f.dataType for f in schema}
    if path in names:
        return F.col(f"`{path}`"), names[path]
    head, *rest = path.split(".")
    if head not in names:
        return None
    col, kind = F.col(f"`{head}`"), names[head]
    for part in rest:
        if isinstance(kind, StructType) and part in kind.names:
            col, kind = col.getField(part), kind[part].dataType
        elif isinstance(kind, ArrayType) and part.isdigit():
            col, kind = F.get(col, F.lit(int(part))), kind.elementType
        elif isinstance(kind, MapType):
            col, kind = F.try_element_at(col, F.lit(part)), kind.valueType
        else:
            return None
    return col, kind


def string_paths(schema: StructType, prefix: str = "") -> Iterator[str]:
    """Paths of all string leaves outside arrays."""
    for f in schema:
        if isinstance(f.dataType, StringType):
            yield prefix + f.name
        elif isinstance(f.dataType, StructType):
            yield from string_paths(f.dataType, f"{prefix}{f.name}.")
