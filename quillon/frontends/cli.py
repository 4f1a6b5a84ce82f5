"""Command line: query, create, update, delete, collections, describe, stats, convert and migrate over a JSON configuration.

The configuration names collections: {"collections": {name: {"file": path, "schema": "id string, ...", "relationships": ...}}}.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.types import StructType, _parse_datatype_string

from quillon import migrate
from quillon.database import Database
from quillon.errors import EngineError, ValidationError
from quillon.frontends import parsers
from quillon.sources import files
from quillon.sources.codecs import Codecs
from quillon.spec import CollectionSpec, Relationship

CONFIG = "quillon.json"


def discover(start: str = ".") -> Path:
    """The configuration in a folder or the nearest one above."""
    here = Path(start).resolve()
    for folder in (here, *here.parents):
        if (folder / CONFIG).exists():
            return folder / CONFIG
    raise ValidationError(f"no {CONFIG} in {here} or above", issues=[])


def read_config(path: Path) -> dict[str, CollectionSpec]:
    value = json.loads(path.read_text())
    if not isinstance(value.get("collections"), dict):
        raise ValidationError("collections are missing", issues=[{"field": "collections", "message": "missing"}])
    out = {}
    for name, c in value["collections"].items():
        if not isinstance(c.get("schema"), str):
            raise ValidationError(f"{name} has no schema", issues=[{"field": f"collections.{name}.schema", "message": "missing"}])
        schema = _parse_datatype_string(c["schema"])
        assert isinstance(schema, StructType)
        relations = {k: Relationship(r["type"], r["target"], r.get("foreignKey")) for k, r in c.get("relationships", {}).items()}
        file = str((path.parent / c["file"]).resolve()) if c.get("file") else None
        out[name] = CollectionSpec(schema, relations, unique=tuple(map(tuple, c.get("unique", ()))), version=c.get("version", 0), append_only=c.get("appendOnly", False), file=file, format=c.get("format"))
    return out


def open_database(spark: SparkSession, specs: dict[str, CollectionSpec]) -> Database:
    return Database(spark, specs)


def show(rows: list[dict], how: str) -> str:
    if how == "json":
        return json.dumps(rows, indent=2, ensure_ascii=False, default=str)
    if how == "csv":
        return files.to_csv(rows)
    if how == "yaml":
        return Codecs().encode(json.loads(json.dumps(rows, default=str)), "yaml")
    keys = list(dict.fromkeys(k for r in rows for k in r))
    if not keys:
        return "(no rows)"
    cell = lambda v: (t if len(t := "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, default=str)) <= 40 else t[:37] + "...")
    lines = [keys, *[[cell(r.get(k)) for k in keys] for r in rows]]
    widths = [max(len(line[i]) for line in lines) for i in range(len(keys))]
    text = ["  ".join(x.ljust(w) for x, w in zip(line, widths, strict=True)).rstrip() for line in lines]
    return "\n".join([text[0], "  ".join("-" * w for w in widths), *text[1:]])


def main(argv: list[str] | None = None, spark: SparkSession | None = None, specs: dict[str, CollectionSpec] | None = None) -> int:
    """specs: the collections, in place of those of the configuration, which can't hold migrations or computed fields."""
    p = argparse.ArgumentParser(prog="quillon", description=__doc__)
    p.add_argument("--config")
    p.add_argument("--output", choices=("table", "json", "yaml", "csv"), default="table")
    sub = p.add_subparsers(dest="command", required=True)
    q = sub.add_parser("query")
    q.add_argument("collection")
    q.add_argument("--where", "-w", action="append", default=[])
    q.add_argument("--select")
    q.add_argument("--sort", default="")
    q.add_argument("--limit", type=int)
    c = sub.add_parser("create")
    c.add_argument("collection")
    c.add_argument("--data", required=True)
    u = sub.add_parser("update")
    u.add_argument("collection")
    u.add_argument("id")
    u.add_argument("--set", action="append", required=True, dest="sets")
    d = sub.add_parser("delete")
    d.add_argument("collection")
    d.add_argument("id")
    d.add_argument("--force", action="store_true")
    for name in ("collections", "stats", "init"):
        sub.add_parser(name)
    sub.add_parser("describe").add_argument("collection")
    v = sub.add_parser("convert")
    v.add_argument("collection")
    v.add_argument("--to", required=True)
    m = sub.add_parser("migrate")
    m.add_argument("action", nargs="?", choices=("status", "dry-run", "run"), default="status")
    a = p.parse_args(argv)
    try:
        print(_run(a, spark, specs))
    except EngineError as e:
        print(f"{e.tag}: {e.message}", file=sys.stderr)
        return 1
    return 0


def _run(a: argparse.Namespace, spark: SparkSession | None, specs: dict[str, CollectionSpec] | None = None) -> str:
    if a.command == "init":
        path = Path(a.config or CONFIG)
        if path.exists():
            raise ValidationError(f"{path} exists", issues=[])
        path.write_text(json.dumps({"collections": {"notes": {"file": "notes.json", "schema": "id string, title string, createdAt string, updatedAt string"}}}, indent=2))
        return f"wrote {path}"
    path = Path(a.config or CONFIG) if a.config or specs else discover()
    spark = spark or SparkSession.builder.appName("quillon").getOrCreate()
    specs = specs or read_config(path)
    if a.command == "migrate":
        return _migrate(a, spark, specs)
    if a.command == "describe":
        spec = specs[a.collection]
        rows = [{"field": f.name, "type": f.dataType.simpleString(), "optional": f.nullable} for f in spec.schema]
        return show([*rows, *[{"field": k, "type": f"{r.kind} {r.target}", "optional": True} for k, r in spec.relationships.items()]], a.output)
    db = open_database(spark, specs)
    if a.command in ("collections", "stats"):
        return show([{"collection": n, "file": s.file, "format": s.format or (s.file or "").rsplit(".", 1)[-1], "relationships": len(s.relationships), "rows": db.frames[n].count()} for n, s in specs.items()], a.output)
    col = db[a.collection]
    if a.command == "query":
        asked = {"where": parsers.cli_filters(a.where), "sort": parsers.cli_sort(a.sort), "limit": a.limit, "select": a.select.split(",") if a.select else None}
        return show([r.asDict(recursive=True) for r in col.query(**asked).collect()], a.output)
    if a.command == "convert":
        target = str(Path(col.spec.file).with_suffix("." + a.to))
        files.save(col.frame, target, col.spec, a.to)
        value = json.loads(path.read_text())
        value["collections"][a.collection]["file"] = str(Path(value["collections"][a.collection]["file"]).with_suffix("." + a.to))
        path.write_text(json.dumps(value, indent=2))
        return f"wrote {target}"
    if a.command == "create":
        row = col.create(json.loads(a.data))
    elif a.command == "update":
        row = col.update(a.id, parsers.cli_sets(a.sets))
    else:
        if not a.force and input(f"delete {a.id}? [y/N] ").strip().lower() not in ("y", "yes"):
            return "not deleted"
        row = col.delete(a.id)
    db.flush()
    return show([row.asDict(recursive=True)], a.output)


def _migrate(a: argparse.Namespace, spark: SparkSession, specs: dict[str, CollectionSpec]) -> str:
    """status and dry-run: what would be done with each file; run: migrated rows are written back."""
    rows = []
    for name, spec in specs.items():
        if not spec.file:
            continue
        have = files.version_of(spark, spec.file, spec.format)
        plan = migrate.dry_run(have, spec.version, spec.migrations)
        row = {"collection": name, "file_version": have, "version": spec.version, "status": plan["status"], "steps": len(plan["steps"])}
        if a.action == "dry-run":
            row["steps"] = ", ".join(f"{x} to {y}" for x, y in plan["steps"])
        elif a.action == "run" and plan["status"] == "needs-migration":
            files.save(files.load(spark, spec.file, spec.schema, spec.format, version=spec.version, migrations=spec.migrations, id_field=spec.id_field), spec.file, spec)
            row["status"] = "migrated"
        rows.append(row)
    return show(rows, a.output)


if __name__ == "__main__":
    sys.exit(main())
