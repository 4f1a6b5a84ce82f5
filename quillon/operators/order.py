"""Sort, offset, limit and cursor pages."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, FloatType, StringType

from quillon.errors import ValidationError
from quillon.functions import paths


def sort(df: DataFrame, order: Mapping[str, str] | None, collation: str | None = None, tie_break: str | None = None) -> DataFrame:
    """Keys in order of priority, nulls last either way. collation: of strings, such as "UNICODE"; binary by default.
    tie_break: a last key that makes the order total."""
    keys = []
    for path, direction in (order or {}).items():
        if (found := paths.resolve(df.schema, path)) is None:
            continue
        col = F.collate(found[0], collation) if collation and isinstance(found[1], StringType) else found[0]
        keys.append(col.desc_nulls_last() if direction == "desc" else col.asc_nulls_last())
    if tie_break and tie_break not in (order or {}) and tie_break in df.columns:
        keys.append(F.col(tie_break).asc_nulls_last())
    return df.orderBy(*keys) if order and keys else df


def paginate(df: DataFrame, offset: float | None = None, limit: float | None = None) -> DataFrame:
    if offset is not None and (n := max(0, math.floor(offset))):
        df = df.offset(n)
    return df if limit is None else df.limit(max(0, math.floor(limit)))


@dataclass(frozen=True)
class Page:
    items: DataFrame
    start_cursor: object
    end_cursor: object
    has_next_page: bool
    has_previous_page: bool


def as_text(col: Column, kind: DataType) -> Column:
    """How a value prints: whole numbers without a fraction."""
    if isinstance(kind, (DoubleType, FloatType)):
        whole = (col == F.floor(col)) & (F.abs(col) < 1e15)
        return F.when(whole, col.cast("bigint").cast("string")).otherwise(col.cast("string"))
    return col.cast("string")


def check_cursor(cursor: Mapping, order: Mapping[str, str] | None) -> dict[str, str]:
    """The order to sort by."""
    key, limit = cursor.get("key"), cursor.get("limit")
    issues = []
    if not isinstance(key, str) or not key:
        issues.append({"field": "cursor.key", "message": "a key is needed"})
    if not isinstance(limit, (int, float)) or limit <= 0:
        issues.append({"field": "cursor.limit", "message": "must be above 0"})
    if cursor.get("after") is not None and cursor.get("before") is not None:
        issues.append({"field": "cursor", "message": "after and before exclude each other"})
    if order and next(iter(order)) != key:
        issues.append({"field": "cursor.key", "message": "must be the first key of sort"})
    if issues:
        raise ValidationError("invalid cursor", issues=issues)
    return dict(order) if order else {key: "asc"}


def cursor_rows(df: DataFrame, cursor: Mapping, order: Mapping[str, str] | None = None, mode: str = "typed", tie_break: str | None = None) -> DataFrame:
    """The rows of a page and one more if there are more, in order. mode "typed" compares values, and follows the
    direction of the sort; "string" compares their texts, and rows after the cursor are the greater ones either way."""
    order = check_cursor(cursor, order)
    key, limit = cursor["key"], int(cursor["limit"])
    found = paths.resolve(df.schema, key)
    if found is None:
        raise ValidationError("invalid cursor", issues=[{"field": "cursor.key", "message": "no such column"}])
    col, kind = found
    text = mode == "string"
    value = as_text(col, kind) if text else col
    down = order[key] == "desc" and not text
    after, before = cursor.get("after"), cursor.get("before")
    edge = lambda v: F.lit(str(v)) if text else F.lit(v).cast(kind)
    if after is not None:
        df = df.where(value < edge(after) if down else value > edge(after))
    if before is not None:
        df = df.where(value > edge(before) if down else value < edge(before))
        # the last rows before the cursor: the first ones of the opposite order, put right again; nulls come last there too
        turned = {k: "asc" if d == "desc" else "desc" for k, d in order.items()}
        keys = [paths.resolve(df.schema, k)[0] for k in turned if paths.resolve(df.schema, k)]
        back = [c.asc_nulls_first() if d == "asc" else c.desc_nulls_first() for c, d in zip(keys, turned.values(), strict=False)]
        if tie_break and tie_break in df.columns and tie_break not in order:
            back.append(F.col(tie_break).desc())
        return sort(df.orderBy(*back).limit(limit + 1), order, tie_break=tie_break)
    return sort(df, order, tie_break=tie_break).limit(limit + 1)


def cursor_page(df: DataFrame, cursor: Mapping, order: Mapping[str, str] | None = None, mode: str = "typed", tie_break: str | None = None) -> Page:
    """A page of rows; collects the page (limit rows), nothing else."""
    found = cursor_rows(df, cursor, order, mode, tie_break)
    rows, limit = found.collect(), int(cursor["limit"])
    more = len(rows) > limit
    backward = cursor.get("before") is not None
    rows = (rows[1:] if backward else rows[:limit]) if more else rows
    items = df.sparkSession.createDataFrame(rows, df.schema)
    if not rows:
        return Page(items, None, None, False, False)

    def at(row):
        for part in [cursor["key"]] if cursor["key"] in df.columns else cursor["key"].split("."):
            row = row[part]
        if mode == "string" and isinstance(row, float) and row.is_integer():
            row = int(row)
        return str(row) if mode == "string" else row

    return Page(items, at(rows[0]), at(rows[-1]), True if backward else more, more if backward else cursor.get("after") is not None)
