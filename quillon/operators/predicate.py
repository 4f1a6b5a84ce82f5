"""``where`` objects to column predicates, with two-valued logic.

Every leaf is true or false, never null. A column of the schema counts as present: its nulls are values, so ``$ne`` and
``$nin`` keep them. A path that the schema doesn't have makes its condition false. An operator that doesn't apply to the
column's type is ignored, but comparisons of what can't be ordered are false. All of this is settled from the schema while
the plan is built; Catalyst gets plain expressions that it can push down.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DateType, MapType, NumericType, StringType, StructType, TimestampNTZType, TimestampType

from quillon.errors import ValidationError
from quillon.functions import paths, search

COMPARE = {"$gt": Column.__gt__, "$gte": Column.__ge__, "$lt": Column.__lt__, "$lte": Column.__le__}
LOGIC = ("$or", "$and", "$not", "$search")
OPERATORS = {"$eq", "$ne", "$in", "$nin", "$startsWith", "$endsWith", "$contains", "$all", "$size", "$search", *COMPARE}
TRUE, FALSE = F.lit, F.lit

#: A custom operator: name -> (types it applies to, or None for all; (column, operand) -> Column)
Custom = Mapping[str, tuple[tuple[type[DataType], ...] | None, Callable[[Column, object], Column]]]


def where(schema: StructType, condition: Mapping | None, custom: Custom | None = None) -> Column:
    """The predicate of a ``where`` object over rows of the schema."""
    return _all([_entry(schema, k, v, custom or {}, None) for k, v in (condition or {}).items()])


def is_operator_object(value, custom: Custom | None = None) -> bool:
    return isinstance(value, Mapping) and any(k in OPERATORS or k in (custom or {}) for k in value)


def _all(parts: list[Column]) -> Column:
    return reduce(Column.__and__, parts) if parts else F.lit(True)


def _two_valued(p: Column) -> Column:
    return F.coalesce(p, F.lit(False))


def _entry(schema: StructType, key: str, value, custom: Custom, prefix: str | None) -> Column:
    """One key of a where object; prefix: the path of the struct that it mirrors."""
    if key in ("$or", "$and"):
        if not isinstance(value, (list, tuple)):
            return F.lit(False)
        parts = [_object(schema, v, custom, prefix) if isinstance(v, Mapping) else F.lit(False) for v in value]
        return _all(parts) if key == "$and" else reduce(Column.__or__, parts) if parts else F.lit(False)
    if key == "$not":
        return ~_object(schema, value, custom, prefix) if isinstance(value, Mapping) else F.lit(False)
    if key == "$search" and isinstance(value, Mapping):
        fields = list(value.get("fields") or paths.string_paths(schema))
        cols = [r[0] for f in fields if (r := paths.resolve(schema, f)) and isinstance(r[1], StringType)]
        return search.matches_any(cols, value.get("query", "")) if search.tokenize(value.get("query", "")) else F.lit(True)
    path = f"{prefix}.{key}" if prefix else key
    found = paths.resolve(schema, path)
    if found is None:
        return F.lit(False)
    return leaf(schema, path, *found, value, custom)


def _object(schema: StructType, condition: Mapping, custom: Custom, prefix: str | None) -> Column:
    return _all([_entry(schema, k, v, custom, prefix) for k, v in condition.items()])


def leaf(schema: StructType, path: str, col: Column, kind: DataType, value, custom: Custom) -> Column:
    if is_operator_object(value, custom):
        return _all([operator(col, kind, k, v, custom) for k, v in value.items() if k in OPERATORS or k in custom])
    if isinstance(value, Mapping):
        if isinstance(kind, (StructType, MapType)):  # mirrors the shape of the row
            return F.lit(True) if not value else col.isNotNull() & _object(schema, value, custom, path)
        return F.lit(False)
    return equals(col, kind, value)


def equals(col: Column, kind: DataType, value) -> Column:
    """Strict equality: values of another type, arrays and objects are never equal; null equals null."""
    if value is None:
        return col.isNull()
    return col.eqNullSafe(F.lit(value)) if _same_type(kind, value) else F.lit(False)


def _same_type(kind: DataType, value) -> bool:
    import datetime
    import decimal

    if isinstance(value, bool):
        return isinstance(kind, BooleanType)
    if isinstance(value, (int, float, decimal.Decimal)):
        return isinstance(kind, NumericType)
    if isinstance(value, str):
        return isinstance(kind, StringType)
    return isinstance(value, (datetime.date, datetime.datetime)) and isinstance(kind, (DateType, TimestampType, TimestampNTZType))


def _member(col: Column, kind: DataType, values) -> Column:
    if not isinstance(values, (list, tuple, set)):
        return F.lit(False)
    known = [v for v in values if v is not None and _same_type(kind, v)]
    found = _two_valued(col.isin(known)) if known else F.lit(False)
    return found | col.isNull() if None in values else found


def operator(col: Column, kind: DataType, name: str, value, custom: Custom) -> Column:
    if name in custom:
        types, build = custom[name]
        return _two_valued(build(col, value)) if types is None or isinstance(kind, types) else F.lit(True)
    text, array = isinstance(kind, StringType), isinstance(kind, ArrayType)
    if name == "$eq":
        return equals(col, kind, value)
    if name == "$ne":
        return ~equals(col, kind, value)
    if name == "$in":
        return _member(col, kind, value)
    if name == "$nin":
        return ~_member(col, kind, value) if isinstance(value, (list, tuple, set)) else F.lit(False)
    if name in COMPARE:
        if isinstance(kind, (NumericType, DateType, TimestampType, TimestampNTZType)) or text:
            # an operand of another type is ignored for values, and never holds for nulls
            return _two_valued(COMPARE[name](col, F.lit(value))) if _same_type(kind, value) else col.isNotNull()
        return F.lit(False)
    if name in ("$startsWith", "$endsWith") or (name == "$contains" and not array):
        if not text:
            return F.lit(True)
        if not isinstance(value, str):
            return F.lit(False)
        return _two_valued({"$startsWith": Column.startswith, "$endsWith": Column.endswith, "$contains": Column.contains}[name](col, F.lit(value)))
    if name == "$search":
        return search.matches(col, value) if text and isinstance(value, str) else F.lit(True)
    if not array:  # $all and $size
        return F.lit(True)
    if name == "$size":
        return _two_valued(F.size(col) == F.lit(value))
    wanted = [value] if name == "$contains" else value
    if not isinstance(wanted, (list, tuple)):
        return F.lit(False)
    has = [F.exists(col, lambda x: x.isNull()) if v is None else F.array_contains(col, F.lit(v)) if _same_type(kind.elementType, v) else F.lit(False) for v in wanted]
    return _all([col.isNotNull(), *map(_two_valued, has)])


def check(condition) -> None:
    if condition is not None and not isinstance(condition, Mapping):
        raise ValidationError("where must be an object", issues=[{"field": "where", "message": "not an object"}])
