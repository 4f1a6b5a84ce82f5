"""Update objects to column expressions: values, nested merges and update operators, by the type of the column."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, MapType, NumericType, StringType, StructType

from quillon.errors import ValidationError
from quillon.functions import paths

OPERATORS = ("$increment", "$decrement", "$multiply", "$append", "$prepend", "$remove", "$toggle", "$set")
IMMUTABLE = ("createdAt",)


def literal(value, kind: DataType) -> Column:
    """A Python value as a column of the type; dicts fill structs (missing fields are null) and maps."""
    if isinstance(value, Column):
        return value
    if value is None:
        return F.lit(None).cast(kind)
    if isinstance(kind, StructType) and isinstance(value, Mapping):
        return F.struct(*[literal(value.get(f.name), f.dataType).alias(f.name) for f in kind])
    if isinstance(kind, ArrayType):
        return F.array(*[literal(v, kind.elementType) for v in value]).cast(kind)
    if isinstance(kind, MapType):
        return F.create_map(*[x for k, v in value.items() for x in (literal(k, kind.keyType), literal(v, kind.valueType))]).cast(kind)
    return F.lit(value).cast(kind)


def apply(col: Column, kind: DataType, value) -> Column:
    """The column after an update. An operator on a column of another type changes nothing; objects merge into structs."""
    if not isinstance(value, Mapping):
        return literal(value, kind)
    op = next((o for o in OPERATORS if o in value), None)
    if op is None:
        if not isinstance(kind, StructType):
            return literal(value, kind)
        fields = [(apply(col.getField(f.name), f.dataType, value[f.name]) if f.name in value else col.getField(f.name)).alias(f.name) for f in kind]
        return F.struct(*fields)
    x = value[op]
    if isinstance(x, Column) and op in ("$append", "$prepend") and isinstance(kind, ArrayType):
        return F.concat(col, x) if op == "$append" else F.concat(x, col)
    if op == "$set":
        return literal(x, kind)
    if op == "$toggle":
        return ~col if isinstance(kind, BooleanType) else col
    if isinstance(kind, NumericType):
        if op in ("$increment", "$decrement", "$multiply"):
            return {"$increment": col + F.lit(x), "$decrement": col - F.lit(x), "$multiply": col * F.lit(x)}[op].cast(kind)
        return col
    if isinstance(kind, StringType) and op in ("$append", "$prepend"):
        return F.concat(col, F.lit(x)) if op == "$append" else F.concat(F.lit(x), col)
    if isinstance(kind, ArrayType):
        if op in ("$append", "$prepend"):
            more = literal(x if isinstance(x, (list, tuple)) else [x], kind)
            return F.concat(col, more) if op == "$append" else F.concat(more, col)
        if op == "$remove":
            return F.filter(col, lambda v: ~x(v)) if callable(x) else F.filter(col, lambda v: ~v.eqNullSafe(literal(x, kind.elementType)))
    return col


def form(schema: StructType, path: str, value) -> str:
    """How a value changes a field: "" sets it, an operator's name applies it to the field, and "=..." is a change that is the same
    for equal texts only (a merge of objects, or a function)."""
    if not isinstance(value, Mapping):
        return ""
    op = next((o for o in OPERATORS if o in value), None)
    if op is None or callable(value[op]) or path not in schema.names:
        return f"={value!r}"
    return op


def operand(value, op: str):
    """What an operator (or "") is applied with; of an array, the elements to add as a list."""
    if not op:
        return value
    x = value[op]
    return x


def operand_type(schema: StructType, path: str, op: str) -> DataType:
    if path not in schema.names:
        return StringType()
    kind = schema[path].dataType
    if isinstance(kind, ArrayType) and op == "$remove":
        return kind.elementType
    return BooleanType() if op == "$toggle" else kind


def expressions(schema: StructType, changes: Mapping, id_field: str = "id") -> dict[str, Column]:
    """New values by column, of the columns that the changes name and the schema has; a dot path names a field of a struct."""
    fixed = [c for c in (id_field, *IMMUTABLE) if c in changes]
    if fixed:
        raise ValidationError(f"{', '.join(fixed)} can't be changed", issues=[{"field": c, "message": "immutable"} for c in fixed])
    out = {}
    for path, value in changes.items():
        head, _, rest = path.partition(".")
        if path in schema.names:
            out[path] = apply(out.get(path, F.col(f"`{path}`")), schema[path].dataType, value)
        elif rest and head in schema.names:
            if (found := paths.resolve(schema, path)) is None or not isinstance(schema[head].dataType, StructType):
                raise ValidationError(f"no field {path}", issues=[{"field": path, "message": "unknown"}])
            out[head] = out.get(head, F.col(f"`{head}`")).withField(rest, apply(*found, value))
    if "updatedAt" in schema.names and "updatedAt" not in out:
        out["updatedAt"] = now().cast(schema["updatedAt"].dataType)
    return out


def now() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def changed_fields(before: Mapping[str, Column], after: Mapping[str, Column]) -> Column:
    """Names of the columns whose values differ."""
    return F.array_compact(F.array(*[F.when(~before[c].eqNullSafe(after[c]), F.lit(c)) for c in after]))
