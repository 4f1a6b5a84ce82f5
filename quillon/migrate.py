"""Chains of migrations: steps from a version to the next, over rows by id or over DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from quillon.errors import MigrationError


@dataclass(frozen=True)
class Migration:
    from_version: int
    to_version: int
    #: {id: row} -> {id: row}, or DataFrame -> DataFrame
    transform: Callable


def validate(version: int, migrations: Sequence[Migration]) -> list[Migration]:
    """The chain in order: from 0 to the version, by single steps, without gaps or duplicates."""
    chain = sorted(migrations, key=lambda m: m.from_version)
    if not chain and version:
        raise MigrationError(f"no migrations to version {version}", to_version=version)
    for i, m in enumerate(chain):
        if m.to_version != m.from_version + 1 or m.from_version != i:
            raise MigrationError(f"step {m.from_version} to {m.to_version} doesn't fit the chain", from_version=m.from_version, to_version=m.to_version)
    if chain and chain[-1].to_version != version:
        raise MigrationError(f"the chain ends at {chain[-1].to_version}, not {version}", to_version=version)
    return chain


def run(rows, migrations: Sequence[Migration], have: int, version: int):
    for m in validate(version, migrations):
        if m.from_version >= have:
            try:
                rows = m.transform(rows)
            except Exception as e:
                raise MigrationError(f"step {m.from_version} to {m.to_version}: {e}", from_version=m.from_version, to_version=m.to_version) from e
    return rows


def dry_run(have: int | None, version: int, migrations: Sequence[Migration]) -> dict:
    """status no-file, up-to-date, needs-migration or ahead, with the steps that would run."""
    if have is None:
        return {"status": "no-file", "steps": []}
    if have > version:
        return {"status": "ahead", "steps": []}
    steps = [(m.from_version, m.to_version) for m in validate(version, migrations) if m.from_version >= have]
    return {"status": "needs-migration" if steps else "up-to-date", "steps": steps}
