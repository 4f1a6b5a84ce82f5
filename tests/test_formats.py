import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.errors import MigrationError, SerializationError, UnsupportedFormatError
from quillon.frontends import parsers
from quillon.migrate import Migration, dry_run, run, validate
from quillon.sources import prose
from quillon.sources.codecs import ALL, Codecs

ROWS = {"a1": {"id": "a1", "n": 1, "x": 2.5, "ok": True, "tags": ["p", "q r"], "o": {"k": "v: w", "l": []}}, "b": {"id": "b", "n": -3, "x": 0.5, "ok": False, "tags": [], "o": {"k": "it's \"q\"\nnew", "l": [1, 2]}}}


@pytest.mark.parametrize("codec", [c for c in ALL if c.name != "jsonl"], ids=lambda c: c.name)
def test_round_trip(codec):
    assert Codecs().decode(Codecs().encode(ROWS, codec.extensions[0]), codec.extensions[0]) == ROWS


def test_json_lines_and_registry():
    c = Codecs()
    assert c.decode(c.encode(ROWS, "x.ndjson") + "\n \n", "jsonl") == list(ROWS.values())
    with pytest.raises(UnsupportedFormatError):
        c.of("x.pdf")
    with pytest.raises(SerializationError):
        c.decode("{", "json")
    assert Codecs((*ALL, ALL[0])).replaced == ["json"]


def test_relaxed_notations():
    c = Codecs()
    assert c.decode("// a\n{a: 'x', /* b */ \"b\": [1, +2, .5, 0xF,], c: null,}", "json5") == {"a": "x", "b": [1, 2, 0.5, 15], "c": None}
    assert c.decode('{"a": "//no", /* c */ "b": [1,],} // end', "jsonc") == {"a": "//no", "b": [1]}
    assert c.decode("{\n  # c\n  a: plain text, with comma\n  b: 5\n  c: [1, 2]\n  d: '''\n     x\n     y\n     '''\n}", "hjson") == {"a": "plain text, with comma", "b": 5, "c": [1, 2], "d": "x\ny"}
    assert c.decode("users[2]{id,name}:\n  1,Ann\n  2,\"B, b\"\nmeta:\n  n: 3\n  tags[2]: a,b\nlist[2]:\n  - x: 1\n    y: 2\n  - z", "toon") == {"users": [{"id": 1, "name": "Ann"}, {"id": 2, "name": "B, b"}], "meta": {"n": 3, "tags": ["a", "b"]}, "list": [{"x": 1, "y": 2}, "z"]}
    assert c.decode(c.encode({"a": None, "b": [1, None]}, "toml"), "toml") == {"b": [1]}


PROSE = '@prose [{id}] "{title}" by {author} ({year})\n  tags: {tags}\n\nNotes are left alone.\n[1] "Dune" by Frank Herbert (1965)\n  tags: [a, b]\n[2] "X" by ~ (-1.5)\n'


def test_prose():
    rows = prose.decode(PROSE)
    assert rows == [{"tags": ["a", "b"], "id": 1, "title": "Dune", "author": "Frank Herbert", "year": 1965}, {"tags": None, "id": 2, "title": "X", "author": None, "year": -1.5}]
    text = prose.encode(rows, '[{id}] "{title}" by {author} ({year})', ["tags: {tags}"])
    assert prose.decode(text) == rows
    with pytest.raises(SerializationError):
        prose.decode("none")
    with pytest.raises(SerializationError):
        prose.Template("{a}{b}")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.fixed_dictionaries({"a": st.one_of(st.none(), st.booleans(), st.integers(-99, 99), st.text(alphabet="ab 1~\"-,\\", max_size=6).map(str.strip)), "b": st.text(alphabet="xyz by", min_size=1, max_size=6).map(lambda s: "q" + s.strip())}), max_size=4))
def test_prose_round_trip(rows):
    assert prose.decode(prose.encode(rows, "# {a} by {b}.")) == rows


def test_migrations():
    chain = [Migration(0, 1, lambda r: {k: {**v, "b": 1} for k, v in r.items()}), Migration(1, 2, lambda r: {k: {**v, "c": v["b"]} for k, v in r.items()})]
    assert run({"x": {"id": "x"}}, chain, 0, 2) == {"x": {"id": "x", "b": 1, "c": 1}}
    assert dry_run(1, 2, chain) == {"status": "needs-migration", "steps": [(1, 2)]}
    assert [dry_run(v, 2, chain)["status"] for v in (None, 2, 3)] == ["no-file", "up-to-date", "ahead"]
    for bad in ([Migration(0, 2, None)], [chain[1]], [chain[0], chain[0]], [chain[0]]):
        with pytest.raises(MigrationError):
            validate(2, bad)


def test_command_line_texts():
    assert parsers.cli_filters(["a >= 5", "a<9", "name contains x y", "b='007'", "c != null"]) == {"a": {"$gte": 5, "$lt": 9}, "name": {"$contains": "x y"}, "b": "007", "c": {"$ne": None}}
    assert parsers.cli_sets("a=1,b='x,y',c=true") == {"a": 1, "b": "x,y", "c": True}
    assert parsers.cli_sort("a:desc,b") == {"a": "desc", "b": "asc"}
    with pytest.raises(parsers.ParseError):
        parsers.cli_filter("nothing")


def test_query_strings():
    assert parsers.rest_query("name=01&age[$gte]=18&age[$lt]=30&tag[$in]=a,2&sort=a:desc,b&limit=5&select=x, y&z=true") == {"where": {"name": "01", "age": {"$gte": 18, "$lt": 30}, "tag": {"$in": ["a", 2]}, "z": True}, "sort": {"a": "desc", "b": "asc"}, "limit": 5, "select": ["x", "y"]}
    assert parsers.rest_aggregate("sum=a,b&groupBy=c&d=1") == {"where": {"d": 1}, "sum": ["a", "b"], "groupBy": "c"}
    assert parsers.rest_aggregate("") == {"count": True}
