"""A table of handlers for any web framework: method, path, and a function of (params, query, body) to (status, body)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from quillon import errors as E
from quillon.database import Database
from quillon.frontends import parsers
from quillon.operators import aggregate
from quillon.operators.order import Page
from quillon.spec import foreign_key

STATUS = {
    "NotFoundError": 404, "CollectionNotFoundError": 404, "DuplicateKeyError": 409, "UniqueConstraintError": 409, "ConcurrencyError": 409,
    "ValidationError": 400, "ParseError": 400, "OperationError": 400, "ForeignKeyError": 422, "HookError": 422, "DanglingReferenceError": 422, "PopulationError": 422,
}


@dataclass(frozen=True)
class Route:
    method: str
    path: str
    handle: Callable


def error_response(e: Exception) -> tuple[int, dict]:
    if isinstance(e, E.EngineError):
        return STATUS.get(e.tag, 500), {"error": e.tag, "message": e.message, **{k: v for k, v in e.fields.items() if k != "message"}}
    return 500, {"error": "InternalError", "message": "internal error"}


def _guarded(f: Callable) -> Callable:
    def run(params: dict | None = None, query: dict | str = "", body=None) -> tuple[int, object]:
        try:
            return f(params or {}, query, body)
        except Exception as e:  # noqa: BLE001  every error has a response
            return error_response(e)

    return run


def _rows(found) -> list[dict]:
    return [r.asDict(recursive=True) for r in (found.items if isinstance(found, Page) else found).collect()]


def routes(db: Database) -> list[Route]:
    out = []
    for name, spec in db.specs.items():
        add = lambda method, path, f: out.append(Route(method, path, _guarded(f)))
        kind = spec.schema[spec.id_field].dataType.simpleString()
        ident = lambda p, kind=kind: p["id"] if kind == "string" else int(p["id"])
        top = f"/{name}"

        def summary(p, q, b, name=name):
            asked = parsers.rest_aggregate(q)
            found = db[name].aggregate(**asked).collect()
            got = [aggregate.nested(r.asDict(recursive=True), asked) for r in found]
            return 200, got if "groupBy" in asked else got[0]

        def one(p, q, b, name=name, ident=ident):
            return 200, db[name].find_by_id(ident(p)).asDict(recursive=True)

        add("GET", top, lambda p, q, b, name=name: (200, _rows(db[name].query(**parsers.rest_query(q)))))
        add("GET", f"{top}/aggregate", summary)
        add("GET", f"{top}/:id", one)
        add("POST", top, lambda p, q, b, name=name: (201, db[name].create(b).asDict(recursive=True)))
        add("POST", f"{top}/batch", lambda p, q, b, name=name: (201, {"created": _rows(db[name].create_many(b).created)}))
        add("PUT", f"{top}/:id", lambda p, q, b, name=name, ident=ident: (200, db[name].update(ident(p), b).asDict(recursive=True)))
        add("DELETE", f"{top}/:id", lambda p, q, b, name=name, ident=ident: (200, db[name].delete(ident(p)).asDict(recursive=True)))
        for relation, rel in spec.relationships.items():

            def related(p, q, b, name=name, relation=relation, rel=rel, ident=ident):
                row, key = db[name].find_by_id(ident(p)), foreign_key(db.specs, name, relation)
                if rel.kind == "inverse":
                    return 200, _rows(db[rel.target].query(where={key: ident(p)}))
                return 200, None if row[key] is None else db[rel.target].find_by_id(row[key]).asDict(recursive=True)

            add("GET", f"{top}/:id/{relation}", related)
    return out


def procedures(db: Database) -> dict[str, Callable]:
    """Procedures by "collection.name": the handlers of a remote procedure group."""
    out: dict[str, Callable] = {}
    for name in db.specs:
        c = lambda name=name: db[name]
        row = lambda r: r.asDict(recursive=True)
        out |= {
            f"{name}.findById": lambda x, c=c: row(c().find_by_id(x["id"])),
            f"{name}.query": lambda x, c=c: _rows(c().query(**x)),
            f"{name}.queryStream": lambda x, c=c: (row(r) for r in c().query(**x).toLocalIterator()),
            f"{name}.create": lambda x, c=c: row(c().create(x["data"])),
            f"{name}.update": lambda x, c=c: row(c().update(x["id"], x["updates"])),
            f"{name}.delete": lambda x, c=c: row(c().delete(x["id"])),
            f"{name}.aggregate": lambda x, c=c: [row(r) for r in c().aggregate(**x).collect()],
            f"{name}.createMany": lambda x, c=c: _rows(c().create_many(x["data"], **x.get("options", {})).created),
            f"{name}.updateMany": lambda x, c=c: {"count": c().update_many(x["where"], x["updates"]).count},
            f"{name}.deleteMany": lambda x, c=c: {"count": c().delete_many(x["where"], limit=x.get("limit")).count},
            f"{name}.upsert": lambda x, c=c: (lambda got: {**row(got[0]), "__action": got[1]})(c().upsert(x["where"], x["create"], x["update"])),
            f"{name}.upsertMany": lambda x, c=c: [{**row(r), "__action": a} for r, a in c().upsert_many(x["data"])],
        }
    return out
