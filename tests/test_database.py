import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string as schema

from quillon import errors as E
from quillon.database import Database
from quillon.frontends import rest
from quillon.plugins import Plugin
from quillon.spec import CollectionSpec, Relationship
from quillon.streaming.watch import watch

def specs():
    authors = CollectionSpec(schema("id string not null, name string, country string"), {"books": Relationship("inverse", "books")}, unique=("name",))
    books = CollectionSpec(
        schema("id string not null, title string not null, year double, authorId string, tags array<string>, stock struct<n: double, at: string>, createdAt string, updatedAt string, deletedAt string"),
        {"author": Relationship("ref", "authors")},
        computed={"label": lambda: F.concat("title", F.lit(" ("), F.col("year").cast("int").cast("string"), F.lit(")"))},
        id_generator="nano",
    )
    return {"authors": authors, "books": books}


ROWS = {
    "authors": [{"id": "a1", "name": "Ann", "country": "x"}, {"id": "a2", "name": "Bob", "country": None}],
    "books": [{"id": "b1", "title": "One", "year": 1990.0, "authorId": "a1", "tags": ["t"], "stock": (1.0, "p")}, {"id": "b2", "title": "Two", "year": 2000.0, "authorId": "a1"}, {"id": "b3", "title": "Three", "year": None, "authorId": None}],
}


@pytest.fixture
def db(spark, tmp_path):
    return Database(spark, specs(), ROWS, root=f"{tmp_path}/db")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_queries(db):
    got = db["books"].query(populate={"author": True}, where={"author.name": "Ann"}, sort={"year": "desc"}, select={"id": True, "label": True, "author": {"name": True}})
    assert [r.asDict(recursive=True) for r in got.collect()] == [{"id": "b2", "label": "Two (2000)", "author": {"name": "Ann"}}, {"id": "b1", "label": "One (1990)", "author": {"name": "Ann"}}]
    nested = db["authors"].query(populate={"books": {"author": True}}, sort={"id": "asc"}).collect()
    assert [[b.author.name for b in r.books] for r in nested] == [["Ann", "Ann"], []]
    for where, want in (({"books": {"$some": {"year": {"$gt": 1995}}}}, ["a1"]), ({"books": {"$every": {"year": {"$gt": 1995}}}}, ["a2"]), ({"books": {"$none": {}}}, ["a2"]), ({"$not": {"books": {"$some": {}}}}, ["a2"]), ({"$or": [{"name": "Bob"}, {"books": {"$some": {"id": "b1"}}}]}, ["a1", "a2"])):
        assert ids(db["authors"].query(where=where)) == want, where
    assert ids(db["books"].query(where={"author": {"country": "x"}})) == ["b1", "b2"]
    assert db["books"].aggregate(count=True, sum="year", avg="year", min="title", groupBy="authorId").orderBy("authorId").collect()[1].asDict() == {"authorId": "a1", "count": 2, "sum_year": 3990.0, "avg_year": 1995.0, "min_title": "One"}
    assert db["books"].find_by_id("b1").title == "One"
    with pytest.raises(E.NotFoundError):
        db["books"].find_by_id("zz")
    with pytest.raises(E.CollectionNotFoundError):
        db["zz"]
    db.frames["authors"] = db.frames["authors"].where("id <> 'a1'")
    with pytest.raises(E.DanglingReferenceError):
        db["books"].query(populate={"author": True})
    assert db["books"].query(populate={"author": True}, on_dangling="null").where("author is null").count() == 3


def test_create(db):
    books = db["books"]
    made = books.create({"title": "New", "label": "ignored", "authorId": "a2"})
    assert len(made.id) == 21 and made.createdAt and books.frame.count() == 4
    for row, error in (({"id": "b1", "title": "x"}, E.DuplicateKeyError), ({"id": "n"}, E.ValidationError), ({"id": "n", "title": "x", "authorId": "zz"}, E.ForeignKeyError)):
        with pytest.raises(error):
            books.create(row)
    with pytest.raises(E.UniqueConstraintError):
        db["authors"].create({"id": "a3", "name": "Ann"})
    got = books.create_many([{"id": "c1", "title": "x"}, {"id": "c1", "title": "y"}, {"id": "b2", "title": "z"}, {"id": "c2", "title": "w", "authorId": "zz"}, {"id": "c3"}], skip_duplicates=True)
    assert ids(got.created) == ["c1"] and sorted((s["id"], s["reason"]) for s in got.skipped.collect()) == [("b2", "duplicate id"), ("c1", "duplicate id"), ("c2", "foreign key"), ("c3", "validation")]
    assert books.frame.count() == 5


def test_update(db):
    books = db["books"]
    row = books.update("b1", {"year": {"$increment": 5}, "title": {"$append": "!"}, "tags": {"$append": ["u"]}, "stock": {"n": {"$multiply": 3}}, "authorId": {"$toggle": True}})
    assert (row.year, row.title, row.tags, row.stock.n, row.stock.at, row.authorId) == (1995.0, "One!", ["t", "u"], 3.0, "p", "a1") and row.updatedAt
    assert books.update("b1", {"tags": {"$remove": "t"}, "stock": {"at": None}}).tags == ["u"]
    got = books.update_many({"authorId": "a1"}, {"year": {"$decrement": 1}})
    assert got.count == 2 and sorted(r.year for r in got.rows.collect()) == [1994.0, 1999.0]
    for changes, error in (({"id": "q"}, E.ValidationError), ({"createdAt": "q"}, E.ValidationError), ({"authorId": "zz"}, E.ForeignKeyError), ({"title": None}, E.ValidationError)):
        with pytest.raises(error):
            books.update("b1", changes)
    with pytest.raises(E.NotFoundError):
        books.update("zz", {"year": 1})
    with pytest.raises(E.UniqueConstraintError):
        db["authors"].update("a2", {"name": "Ann"})


def test_delete(db):
    with pytest.raises(E.ForeignKeyError):
        db["authors"].delete("a1")
    assert db["books"].delete("b3", soft=True).deletedAt and db["books"].frame.count() == 3
    assert db["books"].delete_many({"authorId": "a1"}, limit=1).count == 1
    assert db["books"].delete("b2").id == "b2"
    assert db["authors"].delete("a1").id == "a1" and ids(db["authors"].frame) == ["a2"]
    with pytest.raises(E.OperationError):
        db["authors"].delete("a2", soft=True)


def test_upsert(db):
    got = db["authors"].upsert_many([{"where": {"id": "a1"}, "create": {}, "update": {"country": "y"}}, {"where": {"name": "Bob"}, "create": {}, "update": {"name": "Bob"}}, {"where": {"name": "Cy"}, "create": {"country": "z"}, "update": {}}])
    assert [(r.name, r.country, a) for r, a in got] == [("Ann", "y", "updated"), ("Bob", None, "unchanged"), ("Cy", "z", "created")]
    with pytest.raises(E.ValidationError):
        db["authors"].upsert({"country": "y"}, {}, {})


def test_relationship_writes(db):
    db["books"].create_with_relationships({"id": "b9", "title": "Nine", "author": {"$create": {"id": "a9", "name": "Nia"}}})
    assert db["books"].find_by_id("b9").authorId == "a9"
    db["authors"].create_with_relationships({"id": "a8", "name": "Ed", "books": {"$createMany": [{"id": "b8", "title": "Eight"}], "$connect": [{"id": "b3"}]}})
    assert ids(db["books"].query(where={"authorId": "a8"})) == ["b3", "b8"]
    with pytest.raises(E.ForeignKeyError):
        db["books"].create_with_relationships({"id": "bx", "title": "x", "author": {"$connect": {"id": "zz"}}})
    assert not db["books"].frame.where("id = 'bx'").count()
    db["authors"].update_with_relationships("a8", {"country": "q", "books": {"$disconnect": [{"id": "b3"}], "$connect": [{"id": "b9"}], "$update": [{"where": {"id": "b8"}, "data": {"year": 8.0}}]}})
    assert ids(db["books"].query(where={"authorId": "a8"})) == ["b8", "b9"] and db["books"].find_by_id("b8").year == 8.0
    db["authors"].update_with_relationships("a8", {"books": {"$set": [{"id": "b3"}]}})
    assert ids(db["books"].query(where={"authorId": "a8"})) == ["b3"]
    with pytest.raises(E.ForeignKeyError):
        db["authors"].delete_with_relationships("a8", {"books": "restrict"})
    assert db["authors"].delete_with_relationships("a8", {"books": "set_null"})[1] == {"books": {"count": 1, "action": "set_null"}}
    assert db["authors"].delete_with_relationships("a1", {"books": "cascade"})[1]["books"]["count"] == 2
    assert ids(db["books"].frame) == ["b3", "b8", "b9"] and db.audit().count() == 0


def test_transactions(db, spark):
    with pytest.raises(RuntimeError):
        with db.transaction() as tx:
            tx["authors"].create({"id": "t", "name": "T"})
            assert tx["authors"].frame.count() == 3 and db["authors"].frame.count() == 2
            raise RuntimeError
    assert db["authors"].frame.count() == 2
    with db.transaction() as tx:
        tx["authors"].create({"id": "t", "name": "T"})
        with pytest.raises(E.TransactionError):
            with db.transaction():
                pass
    assert db["authors"].frame.count() == 3
    with pytest.raises(E.TransactionError):
        tx["authors"]
    again = Database(spark, db.specs, root=db.store.root)
    assert again["authors"].frame.count() == 3
    again["authors"].delete("t")
    with pytest.raises(E.ConcurrencyError):
        db["authors"].delete("t")


def test_live_queries(db):
    seen = []
    query = watch(db["authors"], lambda rows: seen.append([r.id for r in rows]), where={"country": "x"}, sort={"id": "asc"}, select=["id"])
    db["authors"].create({"id": "a5", "name": "E", "country": "x"})
    query.processAllAvailable()
    db["authors"].create({"id": "a6", "name": "F", "country": "y"})  # the same result isn't given again
    query.processAllAvailable()
    query.stop()
    assert seen == [["a1"], ["a1", "a5"]]


def test_plugins_and_hooks(spark, tmp_path):
    log = []
    plugin = Plugin("p", operators={"$even": (None, lambda c, x: (c % 2 == 0) == F.lit(x))}, generators={"mine": lambda: "id-1"}, hooks={"before_create": [lambda rows, name: rows.withColumn("name", F.upper("name"))], "on_change": [lambda rows, name: log.append(rows.count()), lambda rows, name: 1 / 0]}, shutdown=lambda: log.append("bye"))
    spec = CollectionSpec(schema("id string not null, name string, n double"), id_generator="mine", append_only=True)
    db = Database(spark, {"x": spec}, root=f"{tmp_path}/db", plugins=[plugin])
    assert db["x"].create({"name": "a", "n": 4.0}).asDict() == {"id": "id-1", "name": "A", "n": 4.0}
    assert db["x"].query(where={"n": {"$even": True}}).count() == 1 and log == [1]
    with pytest.raises(E.OperationError):
        db["x"].delete("id-1")
    db.close()
    assert log[-1] == "bye"
    for bad in (Plugin(""), Plugin("p", operators={"even": (None, len)}), Plugin("p", operators={"$eq": (None, len)}), Plugin("p", dependencies=["q"]), Plugin("p", hooks={"x": []})):
        with pytest.raises(E.PluginError):
            Database(spark, {"x": CollectionSpec(spec.schema)}, plugins=[bad])


def test_rest_routes(db):
    table = {(r.method, r.path): r.handle for r in rest.routes(db)}
    assert table["GET", "/books/:id"]({"id": "b1"})[1]["title"] == "One"
    assert table["GET", "/books/:id"]({"id": "zz"})[0] == 404
    assert [r["id"] for r in table["GET", "/books"](query="year[$gte]=1995&sort=id")[1]] == ["b2"]
    assert table["GET", "/books/aggregate"](query="sum=year")[1] == {"sum": {"year": 3990.0}}
    assert table["GET", "/books/:id/author"]({"id": "b1"})[1]["name"] == "Ann"
    assert len(table["GET", "/authors/:id/books"]({"id": "a1"})[1]) == 2
    assert table["POST", "/authors"](body={"id": "a1", "name": "Z"})[0] == 409
    assert table["PUT", "/authors/:id"]({"id": "a2"}, body={"country": "c"}) == (200, {"id": "a2", "name": "Bob", "country": "c"})


def test_files_and_command_line(spark, tmp_path, capsys):
    import json

    from quillon.frontends import cli
    from quillon.sources import files

    spec = CollectionSpec(schema("id string, n double, tags array<string>"))
    df = spark.createDataFrame([("1", 1.5, ["a"]), ("2", None, None)], spec.schema)
    for ext in ("json", "yaml", "toml", "json5", "jsonl", "toon"):
        files.save(df, f"{tmp_path}/x.{ext}", spec)
        assert sorted(files.load(spark, f"{tmp_path}/x.{ext}", spec.schema).collect()) == sorted(df.collect()), ext
    assert files.load(spark, f"{tmp_path}/none.json", spec.schema).count() == 0
    config = tmp_path / "quillon.json"
    config.write_text(json.dumps({"collections": {"x": {"file": "x.json", "schema": "id string, n double, tags array<string>"}}}))
    run = lambda *a: (cli.main(["--config", str(config), "--output", "json", *a], spark), capsys.readouterr().out)
    assert json.loads(run("query", "x", "--where", "n > 1")[1]) == [{"id": "1", "n": 1.5, "tags": ["a"]}]
    assert run("delete", "x", "2", "--force")[0] == 0
    assert [r["id"] for r in json.loads(run("query", "x")[1])] == ["1"]
    assert run("describe", "x")[0] == 0 and run("convert", "x", "--to", "yaml")[0] == 0
    assert json.loads(run("stats")[1])[0]["format"] == "yaml"
