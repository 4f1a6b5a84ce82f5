"""Scalar and grouped aggregates in one pass, with map-side partial sums by Catalyst."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType

from quillon.errors import ValidationError
from quillon.functions import paths

_INF = float("inf")


def _fields(value) -> list[str]:
    return [value] if isinstance(value, str) else list(value or ())


def _numbers(df: DataFrame, path: str) -> Column:
    """The finite numbers at a path; all else is null."""
    found = paths.resolve(df.schema, path)
    if found is None or not isinstance(found[1], NumericType):
        return F.lit(None).cast("double")
    col, kind = found
    return F.when(~F.isnan(col) & (F.abs(col) < _INF), col) if isinstance(kind, (DoubleType, FloatType)) else col


def _any(df: DataFrame, path: str) -> Column:
    found = paths.resolve(df.schema, path)
    return F.lit(None).cast("string") if found is None else found[0]


def expressions(df: DataFrame, spec: Mapping) -> list[Column]:
    out = [F.count(F.lit(1)).alias("count")] if spec.get("count") else []
    for f in _fields(spec.get("sum")):
        total = F.sum(_numbers(df, f))
        out.append(F.coalesce(total, F.lit(0).cast("double")).alias(f"sum_{f}"))
    out += [F.avg(_numbers(df, f)).alias(f"avg_{f}") for f in _fields(spec.get("avg"))]
    out += [F.min(_any(df, f)).alias(f"min_{f}") for f in _fields(spec.get("min"))]
    out += [F.max(_any(df, f)).alias(f"max_{f}") for f in _fields(spec.get("max"))]
    return out


def aggregate(df: DataFrame, spec: Mapping) -> DataFrame:
    """count, sum, avg, min, max and groupBy of a spec. Nulls form a group. ``preserveOrder`` sorts groups by first row, by
    the column ``_ord``, or, without one, in the order of the scan. Columns are named count, sum_<path>, ...; groups by their paths."""
    if "groupBy" not in spec or spec["groupBy"] is None:
        exprs = expressions(df, spec)
        if not exprs:
            raise ValidationError("an aggregate must ask for something", issues=[{"field": "aggregate", "message": "empty"}])
        return df.agg(*exprs)
    keys = [_any(df, f).alias(f) for f in _fields(spec["groupBy"])]
    exprs = expressions(df, spec)
    if spec.get("preserveOrder"):
        df = df if "_ord" in df.columns else df.withColumn("_ord", F.monotonically_increasing_id())
        return df.groupBy(*keys).agg(*exprs, F.min("_ord").alias("_ord")).orderBy("_ord").drop("_ord")
    if not keys:
        return df.groupBy(F.lit(0).alias("_all")).agg(*exprs).drop("_all")
    return df.groupBy(*keys).agg(*exprs) if exprs else df.select(*keys).distinct()


def nested(row: Mapping, spec: Mapping) -> dict:
    """A result row in nested form: {count, sum: {f: n}, ..., group: {f: v}}."""
    out: dict = {"group": {f: row[f] for f in _fields(spec["groupBy"])}} if spec.get("groupBy") is not None else {}
    if spec.get("count"):
        out["count"] = row["count"]
    for k in ("sum", "avg", "min", "max"):
        if spec.get(k):
            out[k] = {f: row[f"{k}_{f}"] for f in _fields(spec[k]) if k in ("sum", "avg") or row[f"{k}_{f}"] is not None}
    return out
