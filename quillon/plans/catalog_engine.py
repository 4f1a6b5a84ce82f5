"""Named queries that run the engine itself over the driver's tables: changes, constraints, transactions, files, live queries,
plugins and front ends. Each builds a database of its own, and gives rows that its DuckDB counterpart gives too."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from quillon import errors as E
from quillon.database import Database
from quillon.frontends import cli, parsers, rest
from quillon.functions import ids, search
from quillon.migrate import Migration
from quillon.operators import aggregate, order, projection
from quillon.plans.catalog import IDS, RELATIONS, Tables, _register
from quillon.plugins import Plugin
from quillon.sources import files
from quillon.sources.codecs import Codec, Codecs
from quillon.sources.persist import FileWatcher
from quillon.spec import CollectionSpec, Relationship
from quillon.store import work_dir
from quillon.streaming.watch import watch, watch_by_id


def _schema(df: DataFrame, key: str) -> StructType:
    return StructType([type(f)(f.name, f.dataType, f.name != key) for f in df.schema])


def _db(t: Tables, *names: str, plugins=(), columns: Callable[[], dict] | None = None, **more) -> Database:
    """A database of these tables; columns: makes added ones by table; more: parts of the specs by table."""
    added = columns() if columns else {}
    frames = {n: t[n].withColumns(added[n]) if n in added else t[n] for n in names}
    specs = {}
    for n in names:
        own = dict(more.get(n, {}))
        relations = {k: r for k, r in RELATIONS.get(n, {}).items() if r.target in names}
        specs[n] = CollectionSpec(own.pop("schema", None) or _schema(frames[n], IDS[n]), own.pop("relationships", relations), id_field=IDS[n], **own)
    return Database(t.spark, specs, frames, plugins=plugins)


def _after(names: str, change: Callable[[Database], object], read: str | Callable, **more) -> Callable:
    """Changes a database of some tables, and gives one of them as it is then."""

    def build(t: Tables) -> DataFrame:
        db = _db(t, *names.split(), **more)
        change(db)
        return read(db) if callable(read) else db.frames[read]

    return build


def _rows(t: Tables, rows: list[tuple], schema: str) -> DataFrame:
    return t.spark.createDataFrame(rows, schema)


def _outcome(f: Callable) -> str:
    """The tag of the error that a call ends with, or ok."""
    try:
        f()
    except E.EngineError as e:
        return e.tag
    return "ok"


# scans

_register("find_by_id", "SELECT * FROM nation WHERE n_nationkey = 7", lambda t: t.spark.createDataFrame([_db(t, "nation")["nation"].find_by_id(7)], t["nation"].schema))
_register("find_by_id_missing", "SELECT 'NotFoundError' AS tag", lambda t: _rows(t, [(_outcome(lambda: _db(t, "nation")["nation"].find_by_id(-1)),)], "tag string"))


def _index_scan(t: Tables) -> DataFrame:
    """Versions of a collection have Bloom filters on its indexed columns, which scans for values use."""
    db = _db(t, "orders", orders={"indexes": ("o_orderpriority", ("o_custkey", "o_orderstatus"))})
    db["orders"].delete_many({"o_orderkey": 1})  # a change makes a version
    return db["orders"].query(where={"o_custkey": 7, "o_orderstatus": {"$in": ["F", "O"]}}, select=["o_orderkey", "o_totalprice"])


_register("index_equality_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7 AND o_orderstatus IN ('F', 'O') AND o_orderkey <> 1", _index_scan)


def _state(t: Tables) -> DataFrame:
    """Rows of a collection got, set, changed and removed by id; folders that no late commit names are deleted."""
    db = _db(t, "region")
    c = db["region"]
    c.create({"r_regionkey": 50, "r_name": "set"})
    c.update(50, {"r_name": {"$append": " again"}})
    got = c.find_by_id(50).r_name
    c.delete(50)
    gone = _outcome(lambda: c.find_by_id(50))
    return _rows(t, [(got, gone, c.query().count(), db.store.vacuum(keep=1))], "got string, gone string, n long, folders int")


_register("state_operations", "SELECT 'set again' AS got, 'NotFoundError' AS gone, CAST(count(*) AS BIGINT) AS n, 2 AS folders FROM region", _state)
_register("in_memory_source", "SELECT id, CAST(n AS DOUBLE) AS n FROM (VALUES ('a', 3.0), ('b', 2.0)) v(id, n)", lambda t: Database(t.spark, {"x": CollectionSpec(_parse_datatype_string("id string, n double"))}, {"x": [{"id": "a", "n": 1.0}, {"id": "b", "n": 2.0}, {"id": "a", "n": 3.0}]})["x"].query())


def _merged(t: Tables) -> DataFrame:
    path = f"{work_dir(t.spark, 'files')}/nation.json"
    spec = CollectionSpec(_schema(t["nation"], "n_nationkey"), id_field="n_nationkey", file=path)
    files.save(t["nation"].where("n_nationkey < 20"), path, spec)
    given = t["nation"].where("n_nationkey >= 15").withColumn("n_name", F.lower("n_name"))
    return Database(t.spark, {"nation": spec}, {"nation": given})["nation"].query()


_register("load_and_initial_data", "SELECT n_nationkey, CASE WHEN n_nationkey >= 15 THEN lower(n_name) ELSE n_name END AS n_name, n_regionkey FROM nation", _merged)


def _saved(t: Tables) -> DataFrame:
    """Changes reach the collection's file, and another database reads them there."""
    path = f"{work_dir(t.spark, 'files')}/nation.yaml"
    spec = CollectionSpec(_schema(t["nation"], "n_nationkey"), id_field="n_nationkey", file=path)
    db = Database(t.spark, {"nation": spec}, {"nation": t["nation"]}, save_after=0)
    db["nation"].update_many({"n_regionkey": 2}, {"n_name": {"$append": "!"}})
    return Database(t.spark, {"nation": spec})["nation"].query()


_register("file_save_after_change", "SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN n_name || '!' ELSE n_name END AS n_name, n_regionkey FROM nation", _saved)


def _debounced(t: Tables) -> DataFrame:
    path = f"{work_dir(t.spark, 'files')}/region.json"
    spec = CollectionSpec(_schema(t["region"], "r_regionkey"), id_field="r_regionkey", file=path)
    db = Database(t.spark, {"region": spec}, {"region": t["region"]}, save_after=60)
    for suffix in ("a", "b"):
        db["region"].update_many({}, {"r_name": {"$append": suffix}})
    waiting = files.stamp(t.spark, path) is None
    db.close()
    return files.load(t.spark, path, spec.schema).withColumn("waited", F.lit(waiting))


_register("debounced_writer", "SELECT r_regionkey, r_name || 'ab' AS r_name, TRUE AS waited FROM region", _debounced)


def _watched_file(t: Tables) -> DataFrame:
    path = f"{work_dir(t.spark, 'files')}/region.json"
    spec = CollectionSpec(_schema(t["region"], "r_regionkey"), id_field="r_regionkey", file=path)
    files.save(t["region"], path, spec)
    db = Database(t.spark, {"region": spec})
    files.save(t["region"].withColumn("r_name", F.concat("r_name", F.lit(" (new)"))), path, spec)
    found = FileWatcher(db).poll()
    return db["region"].query().withColumn("reloaded", F.lit(",".join(found)))


_register("file_watcher", "SELECT r_regionkey, r_name || ' (new)' AS r_name, 'region' AS reloaded FROM region", _watched_file)


def _many_files(t: Tables) -> DataFrame:
    path = f"{work_dir(t.spark, 'files')}/all.json"
    specs = {n: CollectionSpec(t[n].schema, id_field=IDS[n]) for n in ("region", "nation")}
    files.save_many({n: t[n] for n in specs}, path, specs)
    got = files.load_many(t.spark, path, {n: s.schema for n, s in specs.items()})
    return got["nation"].join(got["region"], F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")


_register("multi_collection_file", "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey", _many_files)


def _appended(t: Tables) -> DataFrame:
    path = f"{work_dir(t.spark, 'files')}/events.jsonl"
    frame = t["events"].select("event_id", "event_type", "value")
    spec = CollectionSpec(_schema(frame, "event_id"), id_field="event_id", file=path, append_only=True)
    db = Database(t.spark, {"events": spec})
    for rest in (0, 1):
        db["events"].create_many(frame.where(f"event_id % 10 = {rest}"))
    return files.load(t.spark, path, spec.schema)


_register("append_sink", "SELECT event_id, event_type, value FROM events WHERE event_id % 10 < 2", _appended)
_register("append_only_guard", "SELECT * FROM (VALUES ('create', 'ok'), ('update', 'OperationError'), ('delete', 'OperationError'), ('upsert', 'OperationError')) v(op, outcome)", lambda t: (lambda c: _rows(t, [("create", _outcome(lambda: c.create({"r_regionkey": 50, "r_name": "x"}))), ("update", _outcome(lambda: c.update(1, {"r_name": "x"}))), ("delete", _outcome(lambda: c.delete(1))), ("upsert", _outcome(lambda: c.upsert({"r_regionkey": 1}, {}, {"r_name": "x"})))], "op string, outcome string"))(_db(t, "region", region={"append_only": True})["region"]))


def _through(table: str, ext: str, **spec) -> Callable:
    def build(t: Tables) -> DataFrame:
        path = f"{work_dir(t.spark, 'files')}/{table}.{ext}"
        own = CollectionSpec(_schema(t[table], IDS[table]), id_field=IDS[table], file=path, **spec)
        db = Database(t.spark, {table: own}, {table: t[table]})
        db.flush()
        return Database(t.spark, {table: own})[table].query()

    return build


for _ext in ("json5", "jsonc", "hjson", "toon"):
    _register(f"{_ext}_roundtrip", "SELECT * FROM nation", _through("nation", _ext))
_register("prose_roundtrip", "SELECT n_nationkey, n_name, n_regionkey FROM nation", _through("nation", "prose", template='{n_nationkey}: "{n_name}"', overflow=("in region {n_regionkey}",)))


def _own_codec(t: Tables) -> DataFrame:
    """A plugin's codec reads and writes the files of its extension."""
    lines = Codec("lines", ("lines",), lambda value: "\n".join(json.dumps(r) for r in value.values()), lambda text: {str(i): json.loads(x) for i, x in enumerate(text.split("\n"))})
    path = f"{work_dir(t.spark, 'files')}/region.lines"
    spec = CollectionSpec(_schema(t["region"], "r_regionkey"), id_field="r_regionkey", file=path)
    Database(t.spark, {"region": spec}, {"region": t["region"]}, plugins=[Plugin("p", codecs=[lines])]).flush()
    return Database(t.spark, {"region": spec}, plugins=[Plugin("p", codecs=[lines])])["region"].query()


_register("plugin_codec", "SELECT * FROM region", _own_codec)
_register("codec_registry", "SELECT * FROM (VALUES ('yml', 'yaml'), ('ndjson', 'jsonl'), ('xml', 'UnsupportedFormatError')) v(ext, codec)", lambda t: _rows(t, [("yml", Codecs().of("a.yml").name), ("ndjson", Codecs().of("ndjson").name), ("xml", _outcome(lambda: Codecs().of("xml")))], "ext string, codec string"))
_register("csv_output", "SELECT string_agg(line, chr(10) ORDER BY k) AS csv FROM (SELECT -1 AS k, 'n_nationkey,n_name,n_regionkey' AS line UNION ALL SELECT n_nationkey, n_nationkey || ',' || n_name || ',' || n_regionkey FROM nation)", lambda t: _rows(t, [(files.to_csv([r.asDict() for r in t["nation"].orderBy("n_nationkey").collect()]),)], "csv string"))

# projection, joins, aggregates, pages

_register("select_cursor_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 15", lambda t: _db(t, "orders")["orders"].query(cursor={"key": "o_orderkey", "limit": 15}, select=["o_orderkey", "o_totalprice"]).items)
_register("select_merged", "SELECT event_id, event_type AS kind FROM events", lambda t: projection.select(t["events"].withColumn("meta", F.struct(F.struct(F.col("event_type").alias("kind"), F.col("value")).alias("deep"), F.col("ts"))), projection.merge_selections({"event_id": True, "meta": {"deep": {"kind": True}}}, {"meta": {"deep": {}}})).select("event_id", F.col("meta.deep.kind").alias("kind")))
_register("strip_computed", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 77, 'new'", _after("region", lambda db: db["region"].create({"r_regionkey": 77, "r_name": "new", "loud": "IGNORED"}), "region", region={"computed": {"loud": lambda: F.upper("r_name")}}))
_register("fk_inference", "SELECT child.id, parent.name AS parent_name FROM (SELECT n_nationkey AS id, n_regionkey AS regionId FROM nation) child LEFT JOIN (SELECT r_regionkey AS id, r_name AS name FROM region) parent ON parent.id = child.regionId", lambda t: _inferred(t)["nations"].query(populate={"region": True}).select("id", F.col("region.name").alias("parent_name")))
_register("fk_inference_inverse", "SELECT r_regionkey AS id, count(n_nationkey) AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1", lambda t: _inferred(t)["regions"].query(populate={"nations": True}).select("id", F.size("nations").cast("bigint").alias("n")))


def _inferred(t: Tables) -> Database:
    """Relations without a declared key: <relation>Id, and that of the ref back."""
    nations, regions = t["nation"].select(F.col("n_nationkey").alias("id"), "n_name", F.col("n_regionkey").alias("regionId")), t["region"].select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    return Database(t.spark, {"nations": CollectionSpec(nations.schema, {"region": Relationship("ref", "regions")}), "regions": CollectionSpec(regions.schema, {"nations": Relationship("inverse", "nations")})}, {"nations": nations, "regions": regions})


_register("populate_unknown_ignored", "SELECT r_regionkey, r_name FROM region", lambda t: _db(t, "region")["region"].query(populate={"nowhere": True}))
_register("rest_relation_routes", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = 1", lambda t: _rows(t, [tuple(r.values()) for r in _route(_related(t), "GET", "/region/:id/nations")({"id": "1"})[1]], "n_nationkey int, n_name string, n_regionkey int"))
_register("rest_ref_route", "SELECT r_regionkey, r_name FROM region JOIN nation ON n_regionkey = r_regionkey WHERE n_nationkey = 3", lambda t: _rows(t, [tuple(_route(_related(t), "GET", "/nation/:id/region")({"id": "3"})[1].values())], "r_regionkey int, r_name string"))


def _related(t: Tables) -> Database:
    return _db(t, "region", "nation", region={"relationships": {"nations": Relationship("inverse", "nation", "n_regionkey")}})


def _route(db: Database, method: str, path: str) -> Callable:
    return next(r.handle for r in rest.routes(db) if (r.method, r.path) == (method, path))


_register("group_first_order", "SELECT string_agg(o_orderpriority, ',' ORDER BY first) AS groups FROM (SELECT o_orderpriority, min(o_orderkey) AS first FROM orders GROUP BY 1)", lambda t: _rows(t, [(",".join(r.o_orderpriority for r in aggregate.aggregate(t["orders"].withColumn("_ord", F.col("o_orderkey")), {"groupBy": "o_orderpriority", "count": True, "preserveOrder": True}).collect()),)], "groups string"))
_register("aggregate_nested_result", "SELECT o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1", lambda t: (lambda spec: _rows(t, [(x["group"]["o_orderstatus"], x["count"], round(x["sum"]["o_totalprice"], 2)) for x in (aggregate.nested(r.asDict(), spec) for r in aggregate.aggregate(t["orders"], spec).collect())], "status string, n long, total double"))({"groupBy": "o_orderstatus", "count": True, "sum": "o_totalprice"}))
_register("cursor_errors", "SELECT * FROM (VALUES ('no key', 'ValidationError'), ('limit', 'ValidationError'), ('both', 'ValidationError'), ('sort', 'ValidationError'), ('column', 'ValidationError'), ('fine', 'ok')) v(what, outcome)", lambda t: _rows(t, [(what, _outcome(lambda c=c, s=s: order.cursor_rows(t["region"], c, s))) for what, c, s in (("no key", {"limit": 1}, None), ("limit", {"key": "r_name", "limit": 0}, None), ("both", {"key": "r_name", "limit": 1, "after": "a", "before": "b"}, None), ("sort", {"key": "r_name", "limit": 1}, {"r_regionkey": "asc"}), ("column", {"key": "zz", "limit": 1}, None), ("fine", {"key": "r_name", "limit": 1}, None))], "what string, outcome string"))
_register("cursor_empty_page", "SELECT CAST(0 AS BIGINT) AS n, FALSE AS has_next, FALSE AS has_previous, TRUE AS no_cursors", lambda t: (lambda p: _rows(t, [(p.items.count(), p.has_next_page, p.has_previous_page, p.start_cursor is None and p.end_cursor is None)], "n long, has_next boolean, has_previous boolean, no_cursors boolean"))(order.cursor_page(t["orders"].select("o_orderkey"), {"key": "o_orderkey", "after": 10**12, "limit": 5})))

# search by the index that the planner uses

_WORDS = r"list_transform(string_split(lower(text), ' '), lambda w: regexp_replace(w, '^[^a-z0-9_]+|[^a-z0-9_]+$', '', 'g'))"


def _indexed(t: Tables) -> Database:
    return _db(t, "benchmark", benchmark={"search_index": ("text",)})


_register("search_planned_index", f"SELECT item_id FROM benchmark WHERE len(list_filter({_WORDS}, lambda w: starts_with(w, 'th'))) > 0", lambda t: _indexed(t)["benchmark"].query(where={"text": {"$search": "th"}}, select=["item_id"]))


def _index_kept_up(t: Tables) -> DataFrame:
    db = _indexed(t)
    db["benchmark"].query(where={"text": {"$search": "zzqx"}}).count()  # makes the index
    db["benchmark"].create_many([{"item_id": 10**9, "text": "a zzqxword"}, {"item_id": 10**9 + 1, "text": "zzqx zzqx"}])
    db["benchmark"].update(10**9 + 1, {"text": "gone"})
    db["benchmark"].update_many({"item_id": 0}, {"text": {"$prepend": "zzqx "}})
    return db["benchmark"].query(where={"text": {"$search": "zzqx"}}, select=["item_id"])


_register("search_index_upkeep", "SELECT CAST(1000000000 AS BIGINT) AS item_id UNION ALL SELECT item_id FROM benchmark WHERE item_id = 0", _index_kept_up)
_register("search_index_eligibility", "SELECT * FROM (VALUES ('field', TRUE), ('fields', TRUE), ('another', FALSE), ('blank', FALSE), ('below or', FALSE)) v(what, eligible)", lambda t: _rows(t, [(what, search.eligible(where, ["text", "title"]) is not None) for what, where in (("field", {"text": {"$search": "a"}, "n": 1}), ("fields", {"$search": {"query": "a", "fields": ["text", "title"]}}), ("another", {"$search": {"query": "a", "fields": ["text", "body"]}}), ("blank", {"text": {"$search": " "}}), ("below or", {"$or": [{"text": {"$search": "a"}}]}))], "what string, eligible boolean"))

# changes

_register("dml_create", "SELECT * FROM region UNION ALL SELECT CAST(99 AS INTEGER), 'NOWHERE'", _after("region", lambda db: db["region"].create({"r_regionkey": 99, "r_name": "NOWHERE"}), "region"))
_register("dml_create_many", "SELECT * FROM region UNION ALL SELECT CAST(r_regionkey + 100 AS INTEGER), lower(r_name) FROM region", _after("region", lambda db: db["region"].create_many(db.frames["region"].select((F.col("r_regionkey") + 100).alias("r_regionkey"), F.lower("r_name").alias("r_name"))), "region"))
_register("dml_create_skip_duplicates", "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT c.k, c.n FROM (SELECT CAST(n_nationkey + 20 AS INTEGER) AS k, n_name AS n FROM nation) c WHERE c.k NOT IN (SELECT n_nationkey FROM nation)", _after("nation", lambda db: db["nation"].create_many(db.frames["nation"].withColumn("n_nationkey", F.col("n_nationkey") + 20), skip_duplicates=True), lambda db: db.frames["nation"].select("n_nationkey", "n_name")))
_register("dml_create_errors", "SELECT * FROM (VALUES ('duplicate', 'DuplicateKeyError'), ('unique', 'UniqueConstraintError'), ('foreign key', 'ForeignKeyError'), ('missing', 'ValidationError')) v(what, outcome)", lambda t: (lambda c: _rows(t, [(what, _outcome(lambda row=row: c.create(row))) for what, row in (("duplicate", {"n_nationkey": 1, "n_name": "x", "n_regionkey": 1}), ("unique", {"n_nationkey": 77, "n_name": t["nation"].where("n_nationkey = 3").first().n_name, "n_regionkey": 1}), ("foreign key", {"n_nationkey": 77, "n_name": "x", "n_regionkey": 99}), ("missing", {"n_name": "x"}))], "what string, outcome string"))(_db(t, "region", "nation", nation={"unique": ("n_name",)})["nation"]))
_register("dml_update", "SELECT n_nationkey, CASE WHEN n_nationkey = 4 THEN 'RENAMED' ELSE n_name END AS n_name FROM nation", _after("nation", lambda db: db["nation"].update(4, {"n_name": "RENAMED"}), lambda db: db.frames["nation"].select("n_nationkey", "n_name")))
_register("dml_update_ops", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_name || '!' ELSE c_name END AS c_name, c_nationkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer", _after("customer", lambda db: db["customer"].update_many({"c_mktsegment": "BUILDING"}, {"c_name": {"$append": "!"}, "c_acctbal": {"$multiply": 2}, "c_nationkey": {"$append": "x"}}), "customer"))
_register("dml_update_numbers", "SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN c_nationkey + 100 WHEN c_nationkey < 10 THEN c_nationkey - 3 ELSE c_nationkey END AS c_nationkey FROM customer", _after("customer", lambda db: [db["customer"].update_many(where, {"c_nationkey": change}) for where, change in (({"c_nationkey": {"$lt": 5}}, {"$increment": 100}), ({"c_nationkey": {"$gte": 5, "$lt": 10}}, {"$decrement": 3}))], lambda db: db.frames["customer"].select("c_custkey", "c_nationkey")))
_register("dml_update_many", "SELECT o_orderkey, CASE WHEN o_totalprice < 1000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders", _after("orders", lambda db: db["orders"].update_many({"o_totalprice": {"$lt": 1000}}, {"o_orderstatus": {"$set": "X"}}), lambda db: db.frames["orders"].select("o_orderkey", "o_orderstatus")))
_PART = lambda: {"part": {
    "tags": F.split("p_name", " "), "flag": F.col("p_size") > 20, "box": F.struct(F.col("p_size").alias("n"), F.col("p_brand").alias("brand")), "updatedAt": F.lit(None).cast("string"),
}}
_register("dml_array_ops", "SELECT p_partkey, array_to_string(CASE WHEN p_size > 20 THEN list_concat(['first'], list_concat(list_filter(string_split(p_name, ' '), lambda w: w <> 'red'), ['last', 'end'])) ELSE string_split(p_name, ' ') END, ' ') AS tags FROM part", _after("part", lambda db: [db["part"].update_many({"flag": True}, {"tags": x}) for x in ({"$remove": "red"}, {"$append": ["last", "end"]}, {"$prepend": "first"})], lambda db: db.frames["part"].select("p_partkey", F.array_join("tags", " ").alias("tags")), columns=_PART))
_register("dml_toggle", "SELECT p_partkey, CASE WHEN p_brand = 'Brand#11' THEN NOT (p_size > 20) ELSE p_size > 20 END AS flag FROM part", _after("part", lambda db: db["part"].update_many({"p_brand": "Brand#11"}, {"flag": {"$toggle": True}}), lambda db: db.frames["part"].select("p_partkey", "flag"), columns=_PART))
_register("dml_wrong_type", "SELECT p_partkey, p_size, p_name FROM part", _after("part", lambda db: db["part"].update_many({}, {"p_size": {"$append": "x"}, "p_name": {"$increment": 1}, "flag": {"$multiply": 2}, "tags": {"$toggle": True}}), lambda db: db.frames["part"].select("p_partkey", "p_size", "p_name"), columns=_PART))
_register("dml_deep_merge", "SELECT p_partkey, p_size * 2 AS n, 'new' AS brand FROM part WHERE p_size > 20 UNION ALL SELECT p_partkey, p_size, p_brand FROM part WHERE p_size <= 20", _after("part", lambda db: (db["part"].update_many({"flag": True}, {"box": {"brand": "new"}}), db["part"].update_many({"flag": True}, {"box.n": {"$multiply": 2}})), lambda db: db.frames["part"].select("p_partkey", "box.n", "box.brand"), columns=_PART))
_register("dml_updated_at", "SELECT p_partkey, p_size > 20 AS stamped FROM part", _after("part", lambda db: db["part"].update_many({"flag": True}, {"p_name": "x"}), lambda db: db.frames["part"].select("p_partkey", F.col("updatedAt").isNotNull().alias("stamped")), columns=_PART))
_register("dml_delete_one", "SELECT r_regionkey, r_name FROM region WHERE r_regionkey <> 2", _after("region", lambda db: db["region"].delete(2), "region"))
_register("dml_delete", "SELECT o_orderkey FROM orders WHERE NOT o_orderstatus = 'F'", _after("orders", lambda db: db["orders"].delete_many({"o_orderstatus": "F"}), lambda db: db.frames["orders"].select("o_orderkey")))
_register("dml_delete_restricted", "SELECT 'ForeignKeyError' AS outcome, CAST(count(*) AS BIGINT) AS n FROM region", lambda t: (lambda db: _rows(t, [(_outcome(lambda: db["region"].delete(1)), db.frames["region"].count())], "outcome string, n long"))(_db(t, "region", "nation")))
_SOFT = lambda: {"customer": {"deletedAt": F.lit(None).cast("string")}}
_register("dml_delete_soft", "SELECT c_custkey, c_acctbal < 0 AS deleted FROM customer", _after("customer", lambda db: db["customer"].delete_many({"c_acctbal": {"$lt": 0}}, soft=True), lambda db: db["customer"].query().select("c_custkey", F.col("deletedAt").isNotNull().alias("deleted")), columns=_SOFT))
_register("dml_delete_many_limit", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 100)", _after("orders", lambda db: db["orders"].delete_many({"o_orderstatus": "P"}, limit=100), lambda db: db.frames["orders"].select("o_orderkey")))


def _merge(t: Tables) -> DataFrame:
    db = _db(t, "nation")
    given = t["nation"].select((F.col("n_nationkey") + 15).alias("n_nationkey"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise("NEW").alias("n_name"))
    actions = db["nation"].merge(given, update=["n_name"])
    return db.frames["nation"].join(actions, "n_nationkey", "left").select("n_nationkey", "n_name", F.coalesce("action", F.lit("stored")).alias("action"))


_register("dml_upsert", "SELECT coalesce(s.n_nationkey, n.k) AS n_nationkey, coalesce(n.v, s.n_name) AS n_name, CASE WHEN n.v IS NULL THEN 'stored' WHEN s.n_name IS NULL THEN 'created' WHEN s.n_name = n.v THEN 'unchanged' ELSE 'updated' END AS action FROM nation s FULL JOIN (SELECT n_nationkey + 15 AS k, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'NEW' END AS v FROM nation) n ON s.n_nationkey = n.k", _merge)


def _upserts(t: Tables) -> DataFrame:
    db = _db(t, "nation", nation={"unique": ("n_name",)})
    name = t["nation"].where("n_nationkey = 5").first().n_name
    inputs = [
        {"where": {"n_nationkey": 3}, "create": {}, "update": {"n_regionkey": {"$increment": 1}}},
        {"where": {"n_name": name}, "create": {}, "update": {"n_regionkey": 0}},
        {"where": {"n_nationkey": 70}, "create": {"n_name": "SEVENTY", "n_regionkey": 1}, "update": {"n_name": "x"}},
        {"where": {"n_nationkey": 1}, "create": {}, "update": {"n_name": t["nation"].where("n_nationkey = 1").first().n_name}},
    ]
    got = db["nation"].upsert_many(inputs)
    return _rows(t, [(i, row["n_nationkey"], row["n_name"], row["n_regionkey"], action) for i, (row, action) in enumerate(got)], "i int, n_nationkey int, n_name string, n_regionkey int, action string")


_register("dml_upsert_many", "SELECT 0 AS i, n_nationkey, n_name, n_regionkey + 1 AS n_regionkey, 'updated' AS action FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 1, n_nationkey, n_name, 0, CASE WHEN n_regionkey = 0 THEN 'unchanged' ELSE 'updated' END FROM nation WHERE n_nationkey = 5 UNION ALL SELECT 2, 70, 'SEVENTY', 1, 'created' UNION ALL SELECT 3, n_nationkey, n_name, n_regionkey, 'unchanged' FROM nation WHERE n_nationkey = 1", _upserts)
_register("dml_cascade", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')", _after("orders lineitem", lambda db: db["orders"].delete_many_with_relationships({"o_orderstatus": "P"}, {"lines": "cascade"}), lambda db: db.frames["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey")))
_register("dml_set_null", "SELECT o_orderkey, CASE WHEN o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN o_custkey END AS o_custkey FROM orders", _after("customer orders", lambda db: db["customer"].delete_many_with_relationships({"c_acctbal": {"$lt": 0}}, {"orders": "set_null"}), lambda db: db.frames["orders"].select("o_orderkey", "o_custkey")))
_register("referential_audit", "SELECT 'nation' AS collection, CAST(n_nationkey AS VARCHAR) AS id, 'n_regionkey' AS field, CAST(n_regionkey AS VARCHAR) AS value, 'region' AS target FROM nation WHERE n_regionkey = 2", _after("region nation", lambda db: db["region"].delete_many({"r_regionkey": 2}, check_restrict=False), lambda db: db.audit()))


def _parent(t: Tables) -> Database:
    return _db(t, "region", "nation", region={"relationships": {"nations": Relationship("inverse", "nation", "n_regionkey")}})


_register("create_with_relationships", "SELECT n_nationkey, n_name, CASE WHEN n_nationkey IN (1, 2) THEN 50 ELSE n_regionkey END AS n_regionkey FROM nation UNION ALL SELECT 80, 'EIGHTY', 50", lambda t: (lambda db: (db["region"].create_with_relationships({"r_regionkey": 50, "r_name": "FIFTY", "nations": {"$create": {"n_nationkey": 80, "n_name": "EIGHTY"}, "$connect": [{"n_nationkey": 1}, {"n_nationkey": 2}]}}), db.frames["nation"])[1])(_parent(t)))
_register("update_with_relationships", "SELECT n_nationkey, CASE WHEN n_nationkey = 4 THEN 'FOUR' ELSE n_name END AS n_name, CASE WHEN n_nationkey = 4 THEN 3 ELSE n_regionkey END AS n_regionkey FROM nation", lambda t: (lambda db: (db["nation"].update_with_relationships(4, {"n_name": "FOUR", "region": {"$connect": {"r_regionkey": 3}}}), db.frames["nation"])[1])(_parent(t)))
_register("delete_with_relationships", "SELECT CAST(count(*) AS BIGINT) AS n, 'cascade' AS action, (SELECT CAST(count(*) AS BIGINT) FROM nation WHERE n_regionkey <> 1) AS left_over FROM nation WHERE n_regionkey = 1", lambda t: (lambda db: (lambda got: _rows(t, [(got["nations"]["count"], got["nations"]["action"], db.frames["nation"].count())], "n long, action string, left_over long"))(db["region"].delete_with_relationships(1, {"nations": "cascade"})[1]))(_parent(t)))


def _hooked(t: Tables) -> DataFrame:
    log: list[tuple] = []
    hooks = {"before_create": (lambda rows, name: rows.withColumn("r_name", F.upper("r_name")),), "after_create": (lambda rows, name: log.append(("after_create", name, rows.count())),), "before_update": (lambda rows, name: rows.withColumn("r_name", F.concat("r_name", F.lit("?"))),), "on_change": (lambda rows, name: log.append(("on_change", name, rows.count())),)}
    db = _db(t, "region", region={"hooks": hooks})
    db["region"].create({"r_regionkey": 60, "r_name": "sixty"})
    db["region"].update_many({"r_regionkey": {"$gte": 4}}, {"r_name": {"$append": "!"}})
    return db.frames["region"].where("r_regionkey >= 4").withColumn("seen", F.lit(", ".join(f"{a} {n}" for a, _, n in log)))


_register("dml_hooks", "SELECT r_regionkey, r_name || '!?' AS r_name, 'after_create 1, on_change 1, on_change ' || (SELECT count(*) + 1 FROM region WHERE r_regionkey >= 4) AS seen FROM (SELECT * FROM region UNION ALL SELECT 60, 'SIXTY') WHERE r_regionkey >= 4", _hooked)
_register("hook_rejects", "SELECT 'HookError' AS outcome, CAST(count(*) AS BIGINT) AS n FROM region", lambda t: (lambda db: _rows(t, [(_outcome(lambda: db["region"].create({"r_regionkey": 60, "r_name": "x"})), db.frames["region"].count())], "outcome string, n long"))(_db(t, "region", region={"hooks": {"before_create": (lambda rows, name: 1 / 0,)}})))
_register("id_generators", "SELECT * FROM (VALUES ('nano', TRUE), ('timestamp', TRUE), ('ulid', TRUE), ('uuid', TRUE), ('prefixed', TRUE), ('typed', TRUE)) v(kind, valid)", lambda t: _rows(t, [*[(k, ids.is_valid(f(), k)) for k, f in sorted(ids.GENERATORS.items())], ("prefixed", ids.extract_type(ids.prefixed("ab")) == "ab"), ("typed", ids.extract_timestamp(ids.typed("x")) is not None)], "kind string, valid boolean"))
_register("generated_ids", "SELECT CAST(count(*) AS BIGINT) AS n, TRUE AS valid FROM nation", lambda t: (lambda db: (db["x"].create_many([{"n": r.n_nationkey} for r in t["nation"].collect()]), db.frames["x"].agg(F.countDistinct("id").alias("n"), F.bool_and(F.length("id") == 26).alias("valid")))[1])(Database(t.spark, {"x": CollectionSpec(_parse_datatype_string("id string not null, n int"), id_generator="ulid")})))

# transactions


def _transactions(t: Tables) -> DataFrame:
    db = _db(t, "region", "nation")
    out = []
    try:
        with db.transaction() as tx:
            tx["region"].create({"r_regionkey": 90, "r_name": "x"})
            out.append(("seen inside", tx["region"].query().count() - t["region"].count()))
            out.append(("seen outside", db["region"].query().count() - t["region"].count()))
            raise ValueError
    except ValueError:
        out.append(("after rollback", db["region"].query().count() - t["region"].count()))
    with db.transaction() as tx:
        tx["region"].create({"r_regionkey": 90, "r_name": "x"})
        tx["nation"].update_many({"n_regionkey": 1}, {"n_regionkey": 90})
    out.append(("after commit", db["nation"].query(where={"n_regionkey": 90}).count()))
    tx = db.begin()
    tx["region"].create({"r_regionkey": 91, "r_name": "y"})
    tx.rollback()
    tx = db.begin()
    tx["region"].create({"r_regionkey": 92, "r_name": "y"})
    tx.commit()
    out.append(("begin and end", db["region"].query(where={"r_regionkey": {"$gte": 91}}).count()))
    return _rows(t, out, "what string, n long")


_register("tx_commit_rollback", "SELECT 'seen inside' AS what, CAST(1 AS BIGINT) AS n UNION ALL SELECT 'seen outside', 0 UNION ALL SELECT 'after rollback', 0 UNION ALL SELECT 'after commit', count(*) FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'begin and end', 1", _transactions)


def _tx_errors(t: Tables) -> DataFrame:
    db = _db(t, "region", "nation")
    with db.transaction() as tx:
        nested = _outcome(lambda: tx.transaction())
        second = _outcome(lambda: db.transaction().__enter__())
    closed = _outcome(lambda: tx["region"])
    db["region"].update(1, {"r_name": "first"})
    db["nation"].update(1, {"n_name": "first"})
    again = Database(t.spark, db.specs, root=db.store.root)

    def late():
        with db.transaction() as tx:
            tx["region"].update(1, {"r_name": "second"})
            tx["nation"].update(1, {"n_name": "second"})
            again["nation"].update(1, {"n_name": "other"})

    conflict = _outcome(late)
    kept = Database(t.spark, db.specs, root=db.store.root)
    return _rows(t, [("nested", nested), ("second", second), ("closed", closed), ("conflict", conflict), ("region", kept["region"].find_by_id(1).r_name), ("nation", kept["nation"].find_by_id(1).n_name)], "what string, outcome string")


_register("tx_errors", "SELECT * FROM (VALUES ('nested', 'TransactionError'), ('second', 'TransactionError'), ('closed', 'TransactionError'), ('conflict', 'ConcurrencyError'), ('region', 'first'), ('nation', 'other')) v(what, outcome)", _tx_errors)

# live queries


def _bus(t: Tables) -> DataFrame:
    """The change log: a row for each collection of a commit."""
    db = _db(t, "region", "nation")
    db["region"].create({"r_regionkey": 90, "r_name": "x"})
    with db.transaction() as tx:
        tx["nation"].update(1, {"n_name": "x"})
        tx["region"].delete(90)
    log = t.spark.read.schema("collection string, operation string, version long, at double").json(db.store.changes)
    return log.select("collection", "operation", "version")


_register("change_bus", "SELECT * FROM (VALUES ('region', 'create', CAST(1 AS BIGINT)), ('nation', 'update', 1), ('region', 'delete', 2)) v(collection, operation, version)", _bus)


def _watch_one(t: Tables) -> DataFrame:
    db, seen = _db(t, "region"), []
    query = watch_by_id(db["region"], 1, lambda row: seen.append(row.r_name if row else None))
    for change in (lambda: db["region"].update(1, {"r_name": "new"}), lambda: db["region"].update(2, {"r_name": "other"}), lambda: db["region"].delete(1)):
        change()
        query.processAllAvailable()
    query.stop()
    return _rows(t, list(enumerate(seen)), "i int, r_name string")


_register("watch_by_id", "SELECT 0 AS i, r_name FROM region WHERE r_regionkey = 1 UNION ALL SELECT 1, 'new' UNION ALL SELECT 2, NULL", _watch_one)
_register("rpc_stream", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 3", lambda t: _rows(t, [(r["n_nationkey"], r["n_name"]) for r in rest.procedures(_db(t, "nation"))["nation.queryStream"]({"where": {"n_regionkey": 3}})], "n_nationkey int, n_name string"))


def _procedures(t: Tables) -> DataFrame:
    call = rest.procedures(_db(t, "region"))
    out = [("create", call["region.create"]({"data": {"r_regionkey": 70, "r_name": "s"}})["r_name"])]
    out.append(("update", call["region.update"]({"id": 70, "updates": {"r_name": "t"}})["r_name"]))
    out.append(("findById", call["region.findById"]({"id": 70})["r_name"]))
    out.append(("upsert", call["region.upsert"]({"where": {"r_regionkey": 71}, "create": {"r_name": "u"}, "update": {}})["__action"]))
    out.append(("updateMany", str(call["region.updateMany"]({"where": {"r_regionkey": {"$gte": 70}}, "updates": {"r_name": "v"}})["count"])))
    out.append(("aggregate", str(call["region.aggregate"]({"count": True})[0]["count"])))
    out.append(("deleteMany", str(call["region.deleteMany"]({"where": {"r_regionkey": {"$gte": 70}}})["count"])))
    return _rows(t, out, "what string, got string")


_register("rpc_procedures", "SELECT * FROM (VALUES ('create', 's'), ('update', 't'), ('findById', 't'), ('upsert', 'created'), ('updateMany', '2'), ('deleteMany', '2')) v(what, got) UNION ALL SELECT 'aggregate', CAST(count(*) + 2 AS VARCHAR) FROM region", _procedures)

# plugins


def _plugged(t: Tables) -> DataFrame:
    log: list[str] = []
    plugin = Plugin("p", operators={"$near": (None, lambda c, x: F.abs(c - x[0]) <= x[1])}, generators={"mine": lambda: "made"}, hooks={"before_create": [lambda rows, name: rows.withColumn("name", F.upper("name"))]}, initialize=lambda: log.append("up"), shutdown=lambda: log.append("down"))
    db = Database(t.spark, {"x": CollectionSpec(_parse_datatype_string("id string not null, name string, n double"), id_generator="mine")}, plugins=[plugin])
    db["x"].create({"name": "a", "n": 4.0})
    found = db["x"].query(where={"n": {"$near": [5, 1]}}).collect()
    db.close()
    return _rows(t, [(r.id, r.name, ",".join(log)) for r in found], "id string, name string, log string")


_register("plugin_surfaces", "SELECT 'made' AS id, 'A' AS name, 'up,down' AS log", _plugged)
_register("plugin_validation", "SELECT * FROM (VALUES ('name', 'PluginError'), ('operator', 'PluginError'), ('taken', 'PluginError'), ('dependency', 'PluginError'), ('hook', 'PluginError'), ('codec', 'PluginError'), ('generator', 'PluginError')) v(what, outcome)", lambda t: _rows(t, [(what, _outcome(lambda p=p, s=s: Database(t.spark, {"x": CollectionSpec(_parse_datatype_string("id string"), id_generator=s)}, plugins=[p]))) for what, p, s in (("name", Plugin(""), None), ("operator", Plugin("p", operators={"even": (None, len)}), None), ("taken", Plugin("p", operators={"$eq": (None, len)}), None), ("dependency", Plugin("p", dependencies=["q"]), None), ("hook", Plugin("p", hooks={"x": []}), None), ("codec", Plugin("p", codecs=[object()]), None), ("generator", Plugin("p"), "unknown"))], "what string, outcome string"))

# front ends

_register("cli_filters", "SELECT o_orderkey FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 90000 AND o_orderpriority <> '5-LOW' AND starts_with(o_orderstatus, 'O')", lambda t: _db(t, "orders")["orders"].query(where=parsers.cli_filters(["o_totalprice >= 1000", "o_totalprice<90000", "o_orderpriority != '5-LOW'", "o_orderstatus startsWith O"]), select=["o_orderkey"]))
_register("cli_sets", "SELECT n_nationkey, CASE WHEN n_nationkey = 2 THEN 'x,y' ELSE n_name END AS n_name, CASE WHEN n_nationkey = 2 THEN 0 ELSE n_regionkey END AS n_regionkey FROM nation", _after("nation", lambda db: db["nation"].update(2, parsers.cli_sets("n_name='x,y',n_regionkey=0")), "nation"))


def _cli(t: Tables, *argv: str) -> str:
    import contextlib
    import io

    path = f"{work_dir(t.spark, 'files')}/nation.json"
    spec = CollectionSpec(_schema(t["nation"], "n_nationkey"), id_field="n_nationkey", file=path)
    files.save(t["nation"], path, spec)
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        cli.main(list(argv), t.spark, {"nation": spec})
    return out.getvalue()


_register("cli_query", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1 ORDER BY n_name DESC LIMIT 3", lambda t: _rows(t, [(r["n_nationkey"], r["n_name"]) for r in json.loads(_cli(t, "--output", "json", "query", "nation", "-w", "n_regionkey = 1", "--sort", "n_name:desc", "--limit", "3", "--select", "n_nationkey,n_name"))], "n_nationkey int, n_name string"))
_register("cli_output_csv", "SELECT 'n_nationkey,n_name' || chr(10) || string_agg(n_nationkey || ',' || n_name, chr(10) ORDER BY n_nationkey) || chr(10) AS csv FROM nation WHERE n_regionkey = 1", lambda t: _rows(t, [(_cli(t, "--output", "csv", "query", "nation", "-w", "n_regionkey = 1", "--sort", "n_nationkey", "--select", "n_nationkey,n_name"),)], "csv string"))
_register("cli_stats", "SELECT 'nation' AS collection, CAST(count(*) AS BIGINT) AS n FROM nation", lambda t: _rows(t, [(r["collection"], r["rows"]) for r in json.loads(_cli(t, "--output", "json", "stats"))], "collection string, n long"))
_register("rest_query_params", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 1000 AND o_orderpriority IN ('1-URGENT', '2-HIGH') ORDER BY o_totalprice DESC, o_orderkey LIMIT 20", lambda t: _rows(t, [(r["o_orderkey"], r["o_totalprice"]) for r in _route(_db(t, "orders"), "GET", "/orders")(query="o_orderstatus=F&o_totalprice[$gte]=1000&o_orderpriority[$in]=1-URGENT,2-HIGH&sort=o_totalprice:desc&limit=20&select=o_orderkey,o_totalprice")[1]], "o_orderkey long, o_totalprice double"))
_register("rest_aggregate_params", "SELECT o_orderstatus AS status, count(*) AS n, round(avg(o_totalprice), 2) AS mean FROM orders WHERE o_totalprice < 50000 GROUP BY 1", lambda t: _rows(t, [(r["group"]["o_orderstatus"], r["count"], round(r["avg"]["o_totalprice"], 2)) for r in _route(_db(t, "orders"), "GET", "/orders/aggregate")(query="count=true&avg=o_totalprice&groupBy=o_orderstatus&o_totalprice[$lt]=50000")[1]], "status string, n long, mean double"))


def _routed(t: Tables) -> DataFrame:
    db = _db(t, "region", "nation")
    call = lambda method, path, *a, **b: _route(db, method, path)(*a, **b)[0]
    out = [("get", call("GET", "/region/:id", {"id": "1"})), ("missing", call("GET", "/region/:id", {"id": "77"})), ("post", call("POST", "/region", body={"r_regionkey": 77, "r_name": "x"})), ("duplicate", call("POST", "/region", body={"r_regionkey": 77, "r_name": "x"})), ("foreign key", call("POST", "/nation", body={"n_nationkey": 77, "n_name": "x", "n_regionkey": 99}))]
    out += [("batch", call("POST", "/region/batch", body=[{"r_regionkey": 78, "r_name": "y"}])), ("put", call("PUT", "/region/:id", {"id": "77"}, body={"r_name": "z"})), ("immutable", call("PUT", "/region/:id", {"id": "77"}, body={"r_regionkey": 1})), ("delete", call("DELETE", "/region/:id", {"id": "77"})), ("restricted", call("DELETE", "/region/:id", {"id": "1"}))]
    return _rows(t, out, "what string, status int")


_register("rest_routes", "SELECT * FROM (VALUES ('get', 200), ('missing', 404), ('post', 201), ('duplicate', 409), ('foreign key', 422), ('batch', 201), ('put', 200), ('immutable', 400), ('delete', 200), ('restricted', 422)) v(what, status)", _routed)
_register("error_taxonomy", "SELECT * FROM (VALUES ('ConcurrencyError', 409), ('DanglingReferenceError', 422), ('DuplicateKeyError', 409), ('ForeignKeyError', 422), ('HookError', 422), ('MigrationError', 500), ('NotFoundError', 404), ('OperationError', 400), ('UniqueConstraintError', 409), ('ValidationError', 400)) v(tag, status)", lambda t: _rows(t, [(e.tag, rest.error_response(e("x"))[0]) for e in (E.ConcurrencyError, E.DanglingReferenceError, E.DuplicateKeyError, E.ForeignKeyError, E.HookError, E.MigrationError, E.NotFoundError, E.OperationError, E.UniqueConstraintError, E.ValidationError)], "tag string, status int"))

# migrations of files

_CHAIN = (
    Migration(0, 1, lambda rows: {k: {**r, "rich": r["c_acctbal"] > 5000} for k, r in rows.items()}),
    Migration(1, 2, lambda rows: {k: {**r, "c_name": r["c_name"].lower()} for k, r in rows.items()}),
)


def _old_file(t: Tables) -> CollectionSpec:
    path = f"{work_dir(t.spark, 'files')}/customer.json"
    rows = t["customer"].select("c_custkey", "c_name", "c_acctbal").where("c_custkey <= 300")
    files.save(rows, path, CollectionSpec(rows.schema, id_field="c_custkey"))
    return CollectionSpec(_parse_datatype_string("c_custkey bigint not null, c_name string, c_acctbal double, rich boolean"), id_field="c_custkey", file=path, version=2, migrations=_CHAIN)


def _migrated(t: Tables) -> DataFrame:
    spec = _old_file(t)
    loaded = Database(t.spark, {"customer": spec})["customer"].query()  # migrates, and writes the file back
    return loaded.withColumn("version", F.lit(files.version_of(t.spark, spec.file)))


_CUSTOMERS = "SELECT c_custkey, lower(c_name) AS c_name, c_acctbal, c_acctbal > 5000 AS rich{} FROM customer WHERE c_custkey <= 300"
_register("migrate_on_load", _CUSTOMERS.format(", 2 AS version"), _migrated)


def _cli_migrated(t: Tables) -> DataFrame:
    import contextlib
    import io

    spec, out = _old_file(t), []
    for action in ("dry-run", "run", "status"):
        text = io.StringIO()
        with contextlib.redirect_stdout(text):
            cli.main(["--output", "json", "migrate", action], t.spark, {"customer": spec})
        row = json.loads(text.getvalue())[0]
        out.append((action, row["file_version"], row["status"], str(row["steps"])))
    return _rows(t, out, "action string, file_version int, status string, steps string")


_register("cli_migrate", "SELECT * FROM (VALUES ('dry-run', 0, 'needs-migration', '0 to 1, 1 to 2'), ('run', 0, 'migrated', '2'), ('status', 2, 'up-to-date', '0')) v(action, file_version, status, steps)", _cli_migrated)
_register("migrate_errors", "SELECT * FROM (VALUES ('ahead', 'MigrationError'), ('gap', 'MigrationError'), ('fails', 'MigrationError')) v(what, outcome)", lambda t: (lambda spec: _rows(t, [("ahead", _outcome(lambda: (Database(t.spark, {"customer": spec}), files.load(t.spark, spec.file, spec.schema, version=1, migrations=_CHAIN[:1], id_field="c_custkey")))), ("gap", _outcome(lambda: files.load(t.spark, spec.file, spec.schema, version=3, migrations=_CHAIN, id_field="c_custkey"))), ("fails", _outcome(lambda: files.load(t.spark, _old_file(t).file, spec.schema, version=1, migrations=(Migration(0, 1, lambda rows: 1 / 0),), id_field="c_custkey")))], "what string, outcome string"))(_old_file(t)))
_register("watch_evaluate", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2 ORDER BY n_name DESC LIMIT 2", lambda t: (lambda seen: (watch(_db(t, "nation")["nation"], seen.append, where={"n_regionkey": 2}, sort={"n_name": "desc"}, limit=2, select=["n_nationkey", "n_name"]).stop(), t.spark.createDataFrame(seen[-1], t["nation"].select("n_nationkey", "n_name").schema))[1])([]))
