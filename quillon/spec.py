"""Declarations of collections and their relationships."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Relationship:
    """ref: this collection's foreign key holds the target's id; inverse: the target's foreign key holds this one's."""

    kind: str
    target: str
    foreign_key: str | None = None


@dataclass(frozen=True)
class CollectionSpec:
    schema: StructType
    relationships: Mapping[str, Relationship] = field(default_factory=dict)
    computed: Mapping[str, Callable[[], Column] | Column] = field(default_factory=dict)
    unique: tuple = ()
    indexes: tuple = ()
    search_index: tuple = ()
    hooks: Mapping[str, tuple] = field(default_factory=dict)
    id_field: str = "id"
    id_generator: str | Callable | None = None
    version: int = 0
    migrations: tuple = ()
    append_only: bool = False
    file: str | None = None
    format: str | None = None
    #: of prose files: the headline, and the lines below it
    template: str | None = None
    overflow: tuple = ()


def indexed_columns(spec: CollectionSpec) -> list[str]:
    """Columns of the spec's indexes, single or compound."""
    return list(dict.fromkeys(c for i in spec.indexes for c in ((i,) if isinstance(i, str) else i) if c in spec.schema.names))


def singular(name: str) -> str:
    return name[:-3] + "y" if name.endswith("ies") else name[:-1] if name.endswith("s") else name


def foreign_key(specs: Mapping[str, CollectionSpec], source: str, relation: str) -> str:
    """The column with the key: as declared, of the target's ref back, or by name."""
    rel = specs[source].relationships[relation]
    if rel.foreign_key:
        return rel.foreign_key
    if rel.kind == "ref":
        return f"{relation}Id"
    if rel.target in specs:
        for name, back in specs[rel.target].relationships.items():
            if back.kind == "ref" and back.target == source:
                return back.foreign_key or f"{name}Id"
    return f"{singular(source)}Id"
