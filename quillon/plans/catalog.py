"""Named queries over the driver's tables, one for each operator, with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillon.database import Database
from quillon.functions import search
from quillon.migrate import Migration
from quillon.migrate import run as migrate
from quillon.operators import aggregate, constraints, order, populate, predicate, updates
from quillon.plans import query as plans
from quillon.sources import files
from quillon.spec import CollectionSpec, Relationship
from quillon.store import work_dir
from quillon.streaming.watch import watch

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
IDS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": "l_orderkey", "events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id", "labels": "doc_id", "conversations": "conv_id"}
RELATIONS = {
    "nation": {"region": Relationship("ref", "region", "n_regionkey"), "customers": Relationship("inverse", "customer", "c_nationkey")},
    "customer": {"nation": Relationship("ref", "nation", "c_nationkey"), "orders": Relationship("inverse", "orders", "o_custkey")},
    "supplier": {"nation": Relationship("ref", "nation", "s_nationkey")},
    "orders": {"customer": Relationship("ref", "customer", "o_custkey"), "lines": Relationship("inverse", "lineitem", "l_orderkey")},
    "lineitem": {"order": Relationship("ref", "orders", "l_orderkey"), "part": Relationship("ref", "part", "l_partkey"), "supplier": Relationship("ref", "supplier", "l_suppkey")},
    "labels": {"document": Relationship("ref", "documents", "doc_id")},
}


class Tables(dict):
    """Tables of a folder by name, read when they are asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self[name]

    def __contains__(self, name) -> bool:
        return name in TABLES


def specs(frames: Tables, **computed) -> dict[str, CollectionSpec]:
    return {t: CollectionSpec(schema=None, relationships=RELATIONS.get(t, {}), computed=computed.get(t, {}), id_field=IDS[t]) for t in TABLES}


_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def _register(name: str, sql: str | None, build: Callable) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(Tables(spark, sf_dir))

    run.__name__ = name
    _QUERIES[name] = run
    if sql is not None:
        _SQL[name] = sql


def _query(name: str, table: str, sql: str, computed: dict | None = None, custom=None, prepare: Callable | None = None, then: Callable | None = None, on_dangling: str = "null", **query) -> None:
    def build(t: Tables) -> DataFrame:
        if prepare:
            t[table] = prepare(t[table])
        out = plans.run(table, query, specs(t, **{table: computed or {}}), t, custom, on_dangling)
        return then(out) if then else out

    _register(name, sql, build)


# predicates

ORDER = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]


def _filter(name: str, table: str, columns: list[str], where: dict, condition: str, **more) -> None:
    source = more.pop("source", table)
    _query(name, table, f"SELECT {', '.join(columns)} FROM {source} WHERE {condition}", where=where, select=columns, **more)


def _null_priority(df: DataFrame) -> DataFrame:
    return df.withColumn("o_orderpriority", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")))


_NULLED = "(SELECT * REPLACE (NULLIF(o_orderpriority, '5-LOW') AS o_orderpriority) FROM orders)"
_PRIO = ["o_orderkey", "o_orderpriority"]
_filter("filter_eq", "orders", ORDER, {"o_orderstatus": "F"}, "o_orderstatus = 'F'")
_filter("filter_eq_operator", "orders", ORDER, {"o_custkey": {"$eq": 7}}, "o_custkey = 7")
_filter("filter_eq_null", "orders", _PRIO, {"o_orderpriority": None}, "o_orderpriority IS NULL", source=_NULLED, prepare=_null_priority)
_filter("filter_ne_null", "orders", _PRIO, {"o_orderpriority": {"$ne": "1-URGENT"}}, "o_orderpriority IS DISTINCT FROM '1-URGENT'", source=_NULLED, prepare=_null_priority)
_filter("filter_in", "orders", ORDER, {"o_orderstatus": {"$in": ["F", "P"]}}, "o_orderstatus IN ('F', 'P')")
_filter("filter_in_null", "orders", _PRIO, {"o_orderpriority": {"$in": ["1-URGENT", None]}}, "o_orderpriority = '1-URGENT' OR o_orderpriority IS NULL", source=_NULLED, prepare=_null_priority)
_filter("filter_nin", "orders", _PRIO, {"o_orderpriority": {"$nin": ["1-URGENT", "2-HIGH"]}}, "o_orderpriority IS NULL OR o_orderpriority NOT IN ('1-URGENT', '2-HIGH')", source=_NULLED, prepare=_null_priority)
for _op, _sign in (("gt", ">"), ("gte", ">="), ("lt", "<"), ("lte", "<=")):
    _filter(f"filter_{_op}", "lineitem", ["l_orderkey", "l_linenumber", "l_quantity"], {"l_quantity": {f"${_op}": 25}}, f"l_quantity {_sign} 25")
_filter("filter_range", "orders", ORDER, {"o_totalprice": {"$gte": 1000, "$lt": 50000}}, "o_totalprice >= 1000 AND o_totalprice < 50000")
_filter("filter_string_cmp", "customer", ["c_custkey", "c_mktsegment"], {"c_mktsegment": {"$gt": "B", "$lte": "HOUSEHOLD"}}, "c_mktsegment > 'B' AND c_mktsegment <= 'HOUSEHOLD'")
_filter("filter_starts_with", "part", ["p_partkey", "p_type"], {"p_type": {"$startsWith": "S"}}, "starts_with(p_type, 'S')")
_filter("filter_ends_with", "part", ["p_partkey", "p_name"], {"p_name": {"$endsWith": "e"}}, "ends_with(p_name, 'e')")
_filter("filter_contains", "part", ["p_partkey", "p_name"], {"p_name": {"$contains": "re"}}, "contains(p_name, 're')")
_filter("filter_or", "orders", ORDER, {"$or": [{"o_orderstatus": "P"}, {"o_totalprice": {"$gt": 100000}}]}, "o_orderstatus = 'P' OR o_totalprice > 100000")
_filter("filter_and", "orders", ORDER, {"$and": [{"o_orderstatus": "F"}, {"o_totalprice": {"$gt": 50000}}, {"o_custkey": {"$lt": 500}}]}, "o_orderstatus = 'F' AND o_totalprice > 50000 AND o_custkey < 500")
_filter("filter_not", "orders", _PRIO, {"$not": {"o_orderpriority": {"$gt": "2"}}}, "NOT coalesce(o_orderpriority > '2', FALSE)", source=_NULLED, prepare=_null_priority)
_filter("filter_empty_or", "orders", ORDER, {"$or": []}, "FALSE")
_filter("filter_empty_and", "orders", ORDER, {"$and": []}, "TRUE")
_filter("filter_missing_path", "orders", ORDER, {"nowhere": {"$ne": 1}}, "FALSE")
_filter("filter_type_mismatch", "orders", ORDER, {"o_custkey": {"$startsWith": "1"}, "o_orderstatus": {"$size": 3, "$eq": "F"}}, "o_orderstatus = 'F'")
_filter("filter_array_equality", "embeddings", ["vec_id"], {"embedding": {"$ne": [1.0]}}, "TRUE")


def _props(df: DataFrame) -> DataFrame:
    return df.withColumn("meta", F.struct(F.get_json_object("props", "$.k").cast("double").alias("k"), F.struct(F.col("event_type").alias("kind")).alias("deep")))


_META = ["event_id", "event_type"]
_filter("filter_nested_path", "events", _META, {"meta.k": {"$gt": 50}}, "CAST(json_extract_string(props, '$.k') AS DOUBLE) > 50", prepare=_props)
_filter("filter_nested_shape", "events", _META, {"meta": {"k": {"$lte": 50}, "deep": {"kind": {"$ne": "click"}}}}, "CAST(json_extract_string(props, '$.k') AS DOUBLE) <= 50 AND event_type <> 'click'", prepare=_props)


def _words(df: DataFrame) -> DataFrame:
    return df.withColumn("tags", F.split("p_name", " "))


_filter("filter_array_contains", "part", ["p_partkey", "p_name"], {"tags": {"$contains": "red"}}, "list_contains(string_split(p_name, ' '), 'red')", prepare=_words)
_filter("filter_array_all", "part", ["p_partkey", "p_name"], {"tags": {"$all": ["red", "small"]}}, "list_has_all(string_split(p_name, ' '), ['red', 'small'])", prepare=_words)
_filter("filter_array_size", "part", ["p_partkey", "p_name"], {"tags": {"$size": 2}}, "len(string_split(p_name, ' ')) = 2", prepare=_words)
_filter("filter_custom_regex", "customer", ["c_custkey", "c_name"], {"c_name": {"$regex": "7[0-3]$"}}, "regexp_matches(c_name, '7[0-3]$')", custom={"$regex": ((StringType,), lambda col, x: col.rlike(x))})

# projection

_query("select_fields", "orders", "SELECT o_orderkey, o_orderdate FROM orders", select=["o_orderkey", "o_orderdate", "nowhere"])
_query("select_all", "region", "SELECT * FROM region", select=[])
_query("select_nested", "events", "SELECT event_id, event_type AS kind FROM events", prepare=_props, select={"event_id": True, "meta": {"deep": {"kind": True}}}, then=lambda df: df.select("event_id", F.col("meta.deep.kind").alias("kind")))
_COMPUTED = {"net": lambda: F.col("l_extendedprice") * (1 - F.col("l_discount")), "big": lambda: F.col("l_quantity") > 40}
_query("computed_fields", "lineitem", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice * (1 - l_discount) AS net, l_quantity > 40 AS big FROM lineitem", computed=_COMPUTED, select=["l_orderkey", "l_linenumber", "l_partkey", "net", "big"])
_query("computed_filter_sort", "orders", "SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders WHERE o_totalprice * 2 > 100000 ORDER BY twice DESC, o_orderkey LIMIT 50", computed={"twice": lambda: F.col("o_totalprice") * 2}, where={"twice": {"$gt": 100000}}, sort={"twice": "desc"}, limit=50, select=["o_orderkey", "twice"])

# joins

_query("populate_ref", "orders", "SELECT o.o_orderkey, c.c_name, c.c_mktsegment FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey", populate={"customer": True}, on_dangling="error", then=lambda df: df.select("o_orderkey", "customer.c_name", "customer.c_mktsegment"))
_query("populate_ref_nested", "orders", "SELECT o.o_orderkey, c.c_name, n.n_name, r.r_name FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey WHERE o.o_orderstatus = 'F'", populate={"customer": {"nation": {"region": True}}}, where={"o_orderstatus": "F"}, then=lambda df: df.select("o_orderkey", "customer.c_name", "customer.nation.n_name", "customer.nation.region.r_name"))
_query("populate_multiple_refs", "lineitem", "SELECT l_orderkey, l_linenumber, l_quantity, p_name, s_name FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity > 45", populate={"part": True, "supplier": True}, where={"l_quantity": {"$gt": 45}}, then=lambda df: df.select("l_orderkey", "l_linenumber", "l_quantity", "part.p_name", "supplier.s_name"))
_query("populate_filter_path", "orders", "SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'", populate={"customer": True}, where={"customer.c_mktsegment": "BUILDING"}, select=["o_orderkey"])
_query("populate_select_implies", "orders", "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey", select={"o_orderkey": True, "customer": {"c_name": True}}, then=lambda df: df.select("o_orderkey", "customer.c_name"))
_query("populate_inverse_flat", "customer", "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_acctbal > 5000", populate={"orders": {"select": ["o_orderkey"]}}, where={"c_acctbal": {"$gt": 5000}}, then=lambda df: df.select("c_custkey", F.explode("orders").alias("o")).select("c_custkey", "o.o_orderkey"))
_query("populate_inverse_count", "customer", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1", populate={"orders": {"select": ["o_orderkey"]}}, then=lambda df: df.select("c_custkey", F.size("orders").cast("bigint").alias("n")))
_query("rel_some", "customer", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)", where={"orders": {"$some": {"o_totalprice": {"$gt": 150000}}}}, select=["c_custkey"])
_query("rel_every", "customer", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND NOT o_totalprice > 20000)", where={"orders": {"$every": {"o_totalprice": {"$gt": 20000}}}}, select=["c_custkey"])
_query("rel_none", "customer", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')", where={"orders": {"$none": {"o_orderstatus": "P"}}}, select=["c_custkey"])
_query("rel_ref_predicate", "orders", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1)", where={"customer": {"nation": {"n_regionkey": 1}}}, select=["o_orderkey"])
_query("rel_or", "customer", "SELECT c_custkey FROM customer WHERE c_acctbal < 0 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)", where={"$or": [{"c_acctbal": {"$lt": 0}}, {"orders": {"$some": {"o_totalprice": {"$gt": 150000}}}}]}, select=["c_custkey"])
_register("dangling_refs", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)", lambda t: constraints.fk_violations(t["orders"], "o_custkey", t["customer"].where("c_custkey % 10 <> 0"), "c_custkey").select("o_orderkey", "o_custkey"))


def _dangling_null(t: Tables) -> DataFrame:
    t["customer"] = t["customer"].where("c_custkey % 10 <> 0")
    return populate.populate(t["orders"], "orders", {"customer": True}, specs(t), t, "null").select("o_orderkey", "customer.c_name")


_register("populate_dangling_null", "SELECT o_orderkey, c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 10 <> 0) ON o_custkey = c_custkey", _dangling_null)

# aggregates


def _agg(name: str, table: str, sql: str, where: dict | None = None, prepare: Callable | None = None, rounded: bool = True, **spec) -> None:
    def build(t: Tables) -> DataFrame:
        df = prepare(t[table]) if prepare else t[table]
        out = aggregate.aggregate(df.where(predicate.where(df.schema, where)) if where else df, spec)
        fix = lambda c: F.round(F.col(f"`{c}`"), 2) if c.startswith(("sum_", "avg_")) and rounded else F.col(f"`{c}`")
        return out.select(*[fix(c).alias(c.replace(".", "_")) for c in out.columns])

    _register(name, sql, build)


_agg("agg_count", "orders", "SELECT count(*) AS count FROM orders", count=True)
_agg("agg_count_where", "orders", "SELECT count(*) AS count FROM orders WHERE o_orderstatus = 'F'", {"o_orderstatus": "F"}, count=True)
_agg("agg_sum", "lineitem", "SELECT round(sum(l_quantity), 2) AS sum_l_quantity FROM lineitem", sum="l_quantity")
_agg("agg_avg", "lineitem", "SELECT round(avg(l_discount), 2) AS avg_l_discount FROM lineitem", avg="l_discount")
_agg("agg_min_max", "orders", "SELECT min(o_totalprice) AS min_o_totalprice, min(o_orderpriority) AS min_o_orderpriority, max(o_totalprice) AS max_o_totalprice FROM orders", min=["o_totalprice", "o_orderpriority"], max="o_totalprice")
_agg("agg_multi", "lineitem", "SELECT count(*) AS count, round(sum(l_quantity), 2) AS sum_l_quantity, round(sum(l_tax), 2) AS sum_l_tax, round(avg(l_quantity), 2) AS avg_l_quantity, min(l_shipdate) AS min_l_shipdate, max(l_shipdate) AS max_l_shipdate FROM lineitem", count=True, sum=["l_quantity", "l_tax"], avg="l_quantity", min="l_shipdate", max="l_shipdate")
_agg("agg_empty_sum", "orders", "SELECT CAST(0 AS DOUBLE) AS sum_o_totalprice, CAST(NULL AS DOUBLE) AS avg_o_totalprice FROM region WHERE r_regionkey = 0", {"o_orderkey": -1}, sum="o_totalprice", avg="o_totalprice")
_agg("group_single", "lineitem", "SELECT l_returnflag, count(*) AS count FROM lineitem GROUP BY 1", groupBy="l_returnflag", count=True)
_agg("group_multi", "lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS count, round(sum(l_extendedprice), 2) AS sum_l_extendedprice FROM lineitem GROUP BY 1, 2", groupBy=["l_returnflag", "l_linestatus"], count=True, sum="l_extendedprice")
_agg("group_where", "orders", "SELECT o_orderpriority, count(*) AS count FROM orders WHERE o_orderstatus = 'O' GROUP BY 1", {"o_orderstatus": "O"}, groupBy="o_orderpriority", count=True)
_agg("group_null_key", "orders", f"SELECT o_orderpriority, count(*) AS count FROM {_NULLED} GROUP BY 1", prepare=_null_priority, groupBy="o_orderpriority", count=True)
_agg("group_all_aggs", "events", "SELECT event_type, count(*) AS count, round(sum(value), 2) AS sum_value, round(avg(value), 2) AS avg_value, min(value) AS min_value, max(ts) AS max_ts FROM events GROUP BY 1", groupBy="event_type", count=True, sum="value", avg="value", min="value", max="ts")
_agg("group_nested_path", "events", "SELECT event_type AS meta_deep_kind, round(sum(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 2) AS sum_meta_k FROM events GROUP BY 1", prepare=_props, groupBy="meta.deep.kind", sum="meta.k")

# order and pages

_NOMINAL = ["o_orderkey", "o_orderpriority", "o_totalprice"]
_query("sort_multi", "orders", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 100", sort={"o_orderpriority": "asc", "o_totalprice": "desc"}, limit=100, select=_NOMINAL)
_query("sort_nulls_last", "orders", f"SELECT o_orderkey, o_orderpriority, o_totalprice FROM {_NULLED} ORDER BY o_orderpriority DESC NULLS LAST, o_orderkey OFFSET 11000 LIMIT 2000", prepare=_null_priority, sort={"o_orderpriority": "desc"}, offset=11000, limit=2000, select=_NOMINAL)
_query("limit_offset", "orders", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderkey OFFSET 20 LIMIT 30", sort={"o_orderkey": "asc"}, offset=20, limit=30.9, select=_NOMINAL)
_query("limit_zero", "orders", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders LIMIT 0", limit=-3, select=_NOMINAL)
_query("topk", "lineitem", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 20", sort={"l_extendedprice": "desc", "l_orderkey": "asc", "l_linenumber": "asc", "l_partkey": "asc"}, limit=20, select=["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"])


def _cursor(name: str, sql: str, cursor: dict, sort: dict | None = None, mode: str = "typed") -> None:
    def build(t: Tables) -> DataFrame:
        page = order.cursor_page(t["orders"].select(*_NOMINAL), cursor, sort, mode, "o_orderkey")
        return page.items.withColumns({"has_next": F.lit(page.has_next_page), "has_previous": F.lit(page.has_previous_page)})

    _register(name, sql, build)


_cursor("cursor_first", "SELECT o_orderkey, o_orderpriority, o_totalprice, TRUE AS has_next, FALSE AS has_previous FROM orders ORDER BY o_orderkey LIMIT 10", {"key": "o_orderkey", "limit": 10})
_cursor("cursor_after", "SELECT o_orderkey, o_orderpriority, o_totalprice, TRUE AS has_next, TRUE AS has_previous FROM orders WHERE o_totalprice < 90000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", {"key": "o_totalprice", "after": 90000.0, "limit": 10}, {"o_totalprice": "desc"})
_cursor("cursor_before", "SELECT * FROM (SELECT o_orderkey, o_orderpriority, o_totalprice, TRUE AS has_next, TRUE AS has_previous FROM orders WHERE o_orderkey < 100 ORDER BY o_orderkey DESC LIMIT 10)", {"key": "o_orderkey", "before": 100, "limit": 10})
_cursor("cursor_string_mode", "SELECT o_orderkey, o_orderpriority, o_totalprice, TRUE AS has_next, TRUE AS has_previous FROM orders WHERE CAST(o_orderkey AS VARCHAR) > '9' ORDER BY o_orderkey LIMIT 5", {"key": "o_orderkey", "after": "9", "limit": 5}, mode="string")

# search; the oracle's tokens: lower case, split at white space, outer marks off

_SPLIT = r"list_filter(list_transform(regexp_split_to_array(lower({}), '[\t\n\x0b\f\r \x{{00A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{FEFF}}]+'), lambda t: regexp_replace(t, '^[^A-Za-z0-9_]+|[^A-Za-z0-9_]+$', '', 'g')), lambda t: t <> '')"
_TOKENS = _SPLIT.format("text")


def _has(tokens: str, *query: str) -> str:
    return " AND ".join(f"len(list_filter({tokens}, lambda t: starts_with(t, '{q}'))) > 0" for q in query)


def _points(tokens: str, *query: str) -> str:
    one = lambda q, f: f"len(list_filter({tokens}, lambda t: {f.format(q)}))"
    hits = " + ".join(f"(CASE WHEN {one(q, "starts_with(t, '{}')")} > 0 THEN 1.0 ELSE 0.0 END)" for q in query)
    freq = " + ".join(f"({one(q, "t = '{}'")} + 0.5 * ({one(q, "starts_with(t, '{}')")} - {one(q, "t = '{}'")}))" for q in query)
    return f"CASE WHEN ({hits}) > 0 THEN ({hits}) / {len(query)} * (1.0 + ({freq}) / len({tokens})) / ln(1 + len({tokens})) ELSE 0.0 END"


_query("search_field", "documents", f"SELECT doc_id FROM documents WHERE {_has(_TOKENS, 'the', 'of')}", where={"text": {"$search": "The of,"}}, select=["doc_id"])
_query("search_prefix", "documents", f"SELECT doc_id FROM documents WHERE {_has(_TOKENS, 'anth')}", where={"text": {"$search": "anth"}}, select=["doc_id"])
_query("search_blank", "documents", "SELECT doc_id FROM documents", where={"text": {"$search": "  "}}, select=["doc_id"])
_MULTI = " AND ".join(f"(({_has(_TOKENS, q)}) OR ({_has(_SPLIT.format('role'), q)}))" for q in ("user", "the"))
_query("search_multi_field", "conversations", f"SELECT conv_id, turn FROM conversations WHERE {_MULTI}", where={"$search": {"query": "user the", "fields": ["text", "role"]}}, select=["conv_id", "turn"])
_query("search_scores", "documents", f"SELECT doc_id, round({_points(_TOKENS, 'the', 'th')}, 6) AS score FROM documents WHERE {_has(_TOKENS, 'the', 'th')}", where={"$search": {"query": "the th", "fields": ["text"]}}, then=lambda df: df.select("doc_id", F.round(plans.SCORE, 6).alias("score")))
_query("search_relevance_topk", "documents", f"SELECT doc_id, round({_points(_TOKENS, 'der')}, 6) AS score FROM documents WHERE {_has(_TOKENS, 'der')} ORDER BY {_points(_TOKENS, 'der')} DESC, doc_id LIMIT 10", where={"$search": {"query": "der", "fields": ["text"]}}, limit=10, then=lambda df: df.select("doc_id", F.round(plans.SCORE, 6).alias("score")))
_query("search_with_filter", "documents", f"SELECT doc_id, lang FROM documents WHERE lang = 'en' AND {_has(_TOKENS, 'with')}", where={"lang": "en", "text": {"$search": "with"}}, select=["doc_id", "lang"])
_register("search_token_index", f"SELECT doc_id FROM documents WHERE {_has(_TOKENS, 'the', 'wh')}", lambda t: search.lookup(search.token_table(t["documents"], "doc_id", ["text"]), "doc_id", "the wh"))
_register("search_stop_words", f"SELECT doc_id, CAST(len(list_filter({_TOKENS}, lambda t: t NOT IN ({', '.join(repr(w) for w in search.STOP_WORDS)}))) AS BIGINT) AS n FROM documents", lambda t: t["documents"].select("doc_id", F.size(search.tokens(F.col("text"), stop_words=True)).cast("bigint").alias("n")))

# changes: see also catalog_engine

_register("changed_fields", "SELECT c_custkey, c_acctbal < 0 AS acctbal, c_mktsegment <> 'BUILDING' AS segment FROM customer", lambda t: t["customer"].select("c_custkey", updates.changed_fields({"c_acctbal": F.col("c_acctbal"), "c_mktsegment": F.col("c_mktsegment")}, {"c_acctbal": F.greatest("c_acctbal", F.lit(0.0)), "c_mktsegment": F.lit("BUILDING")}).alias("f")).select("c_custkey", F.array_contains("f", "c_acctbal").alias("acctbal"), F.array_contains("f", "c_mktsegment").alias("segment")))

# constraints

_register("unique_violations", "SELECT p_name, count(*) AS n FROM part WHERE p_name IS NOT NULL GROUP BY 1 HAVING count(*) > 1", lambda t: constraints.unique_violations(t["part"], ["p_name"]))
_register("compound_unique", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1", lambda t: constraints.unique_violations(t["lineitem"], ["l_orderkey", "l_linenumber"]))
_register("fk_violations", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)", lambda t: constraints.fk_violations(t["lineitem"], "l_partkey", t["part"].where("p_size > 5"), "p_partkey").select("l_orderkey", "l_partkey"))
_register("restrict_check", "SELECT c_custkey FROM customer WHERE c_acctbal < 0 AND c_custkey IN (SELECT o_custkey FROM orders)", lambda t: constraints.restrict_violations(t["customer"].where("c_acctbal < 0"), t["orders"], "o_custkey", "c_custkey").select("c_custkey"))


# sources, migrations and live queries; through files and versions in the shared folder


def _through(table: str, ext: str, key: str, prepare: Callable | None = None) -> Callable:
    def build(t: Tables) -> DataFrame:
        df = prepare(t[table]) if prepare else t[table]
        path = f"{work_dir(t.spark, 'files')}/{table}.{ext}"
        files.save(df, path, CollectionSpec(df.schema, id_field=key))
        return files.load(t.spark, path, df.schema)

    return build


_register("jsonl_roundtrip", "SELECT * FROM customer", _through("customer", "jsonl", "c_custkey"))
_register("json_map_roundtrip", "SELECT * FROM nation", _through("nation", "json", "n_nationkey"))
_register("yaml_roundtrip", "SELECT * FROM region", _through("region", "yaml", "r_regionkey"))
_register("toml_null_strip", "SELECT n_nationkey, NULLIF(n_name, 'CHINA') AS n_name FROM nation", _through("nation", "toml", "n_nationkey", lambda df: df.select("n_nationkey", F.when(F.col("n_name") != "CHINA", F.col("n_name")).alias("n_name"))))


_CHAIN = (
    Migration(0, 1, lambda df: df.withColumn("rich", F.col("c_acctbal") > 5000)),
    Migration(1, 2, lambda df: df.withColumn("c_name", F.lower("c_name")).drop("c_mktsegment")),
)
_register("migrate_chain", "SELECT c_custkey, lower(c_name) AS c_name, c_nationkey, c_acctbal, c_acctbal > 5000 AS rich FROM customer", lambda t: migrate(t["customer"], _CHAIN, 0, 2))


def _watched(changed: bool) -> Callable:
    def build(t: Tables) -> DataFrame:
        spec = CollectionSpec(t["nation"].schema, id_field="n_nationkey")
        db, seen = Database(t.spark, {"nation": spec}, {"nation": t["nation"]}), []
        query = watch(db["nation"], seen.append, where={"n_regionkey": 1}, select=["n_nationkey", "n_name"])
        if changed:
            db["nation"].update_many({"n_nationkey": 1}, {"n_name": {"$append": "!"}})
            query.processAllAvailable()
        query.stop()
        return t.spark.createDataFrame(seen[-1], t["nation"].select("n_nationkey", "n_name").schema)

    return build


_register("watch_initial", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1", _watched(False))
_register("watch_after_change", "SELECT n_nationkey, CASE WHEN n_nationkey = 1 THEN n_name || '!' ELSE n_name END AS n_name FROM nation WHERE n_regionkey = 1", _watched(True))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large open orders with their customers, the dearest first."""
    t = Tables(spark, sf_dir)
    q = {"where": {"o_orderstatus": {"$in": ["F", "O"]}, "o_totalprice": {"$gte": 1000}}, "populate": {"customer": True}, "sort": {"o_totalprice": "desc"}, "limit": 100}
    return plans.run("orders", q, specs(t), t, on_dangling="null").select("o_orderkey", "o_totalprice", "customer.c_name", "customer.c_mktsegment")


_register("flagship", "SELECT o_orderkey, o_totalprice, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus IN ('F', 'O') AND o_totalprice >= 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 100", lambda t: flagship(t.spark, t.sf_dir))


from quillon.plans import catalog_engine as _engine  # noqa: E402, F401  registers its queries


def queries() -> dict[str, Callable]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
