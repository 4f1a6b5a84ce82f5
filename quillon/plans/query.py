"""The pipeline of a query: scan, populate, computed, where, score, sort, page, select. One lazy plan; Catalyst pushes
filters and columns down through it, so the order here is that of meaning and not of execution."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillon.functions import search
from quillon.operators import order, populate, predicate, projection
from quillon.spec import CollectionSpec

SCORE = "_searchScore"


def wanted_relations(spec: CollectionSpec, query: Mapping) -> dict:
    """populate, and the relations that an object select names."""
    out = dict(query.get("populate") or {})
    chosen = query.get("select")
    if isinstance(chosen, Mapping):
        for k, v in chosen.items():
            if k in spec.relationships and k not in out and v:
                out[k] = {} if v is True else {n: w for n, w in v.items() if isinstance(w, Mapping)} or True
                out[k] = out[k] or True
    return out


def rows(name: str, query: Mapping, specs: Mapping[str, CollectionSpec], frames: Mapping[str, DataFrame], custom=None, on_dangling: str = "error", search_table=None) -> DataFrame:
    """The filtered and scored rows, before order, page and select."""
    spec, df = specs[name], frames[name]
    condition = query.get("where")
    predicate.check(condition)
    if search_table is not None and (asked := search.eligible(condition, spec.search_index)) and (table := search_table(name)) is not None:
        # rows that have the query's tokens in some indexed field; the condition itself still decides
        df = df.join(search.lookup(table, spec.id_field, asked[0]), spec.id_field, "left_semi").select(*df.columns)
    df = populate.populate(df, name, wanted_relations(spec, query), specs, frames, on_dangling)
    df = projection.computed(df, spec.computed)
    df = populate.where(df, name, condition, specs, frames, custom)
    wanted = (condition or {}).get("$search")
    if isinstance(wanted, Mapping) and search.tokenize(wanted.get("query", "")):
        fields = wanted.get("fields") or [f.name for f in frames[name].schema if isinstance(f.dataType, StringType)]
        total = F.lit(0.0)
        for f in fields:
            if f in df.columns and isinstance(df.schema[f].dataType, StringType):
                total = total + search.score(F.col(f"`{f}`"), wanted["query"])
        df = df.withColumn(SCORE, total)
    return df


def run(name: str, query: Mapping, specs: Mapping[str, CollectionSpec], frames: Mapping[str, DataFrame], custom=None, on_dangling: str = "error", search_table=None) -> DataFrame | order.Page:
    """A DataFrame, or a page if the query has a cursor."""
    df, ident = rows(name, query, specs, frames, custom, on_dangling, search_table), specs[name].id_field
    by = query.get("sort")
    if SCORE in df.columns and query.get("limit") is None and not query.get("cursor"):
        # a sort of all rows reads them twice, first for its ranges; of dealt rows it reads the shuffle, and none is scored again
        df = df.repartition(F.col(f"`{ident}`"), F.col(SCORE))
    if query.get("cursor"):
        page = order.cursor_page(df, query["cursor"], by, query.get("cursorMode", "typed"), ident)
        return order.Page(projection.select(page.items, query.get("select")), page.start_cursor, page.end_cursor, page.has_next_page, page.has_previous_page)
    if by:
        df = order.sort(df, by, query.get("collation"), tie_break=ident)
    elif SCORE in df.columns:
        df = df.orderBy(F.col(SCORE).desc(), F.col(ident))
    return projection.select(order.paginate(df, query.get("offset"), query.get("limit")), query.get("select"))
