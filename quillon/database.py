"""Databases of collections: queries, changes, relationship writes and transactions over versioned snapshots.

A change is a job over the whole collection: the next snapshot is computed as a plan, checked by anti and semi joins,
written as a new version and taken as current. Many rows should be changed by one call, or in one transaction.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quillon.errors import CollectionNotFoundError, DuplicateKeyError, ForeignKeyError, HookError, NotFoundError, OperationError, TransactionError, UniqueConstraintError, ValidationError
from quillon.functions import ids, search
from quillon.operators import aggregate, constraints, predicate, projection, updates
from quillon.plans import query as plans
from quillon.plugins import Registry
from quillon.spec import CollectionSpec, foreign_key, indexed_columns
from quillon.store import Store


@dataclass
class Created:
    created: DataFrame
    #: id and reason
    skipped: DataFrame


@dataclass
class Changed:
    count: int
    rows: DataFrame


class Collection:
    def __init__(self, db: Database, name: str):
        self.db, self.name, self.spec = db, name, db.specs[name]

    # reading

    @property
    def frame(self) -> DataFrame:
        return self.db.frames[self.name]

    def query(self, on_dangling: str = "error", **query):
        """where, populate, sort, select, limit, offset, cursor; a lazy DataFrame, or a page for a cursor."""
        return plans.run(self.name, query, self.db.specs, self.db.frames, self.db.registry.operators, on_dangling, self.db.search_table)

    def find_by_id(self, ident) -> Row:
        row = self.frame.where(F.col(self.spec.id_field) == F.lit(ident)).limit(1).first()
        if row is None:
            raise NotFoundError(f"{self.name} has no row {ident!r}", collection=self.name, id=ident)
        return row

    def aggregate(self, **spec) -> DataFrame:
        """Over the stored rows: where, then count, sum, avg, min, max, groupBy."""
        return aggregate.aggregate(self.frame.where(predicate.where(self.frame.schema, spec.get("where"), self.db.registry.operators)), spec)

    def watch(self, on_result: Callable[[list], None], **query):
        from quillon.streaming.watch import watch

        return watch(self, on_result, **query)

    # changing

    def create(self, row: Mapping) -> Row:
        return self.create_many([row]).created.first()

    def create_many(self, rows: Sequence[Mapping] | DataFrame, skip_duplicates: bool = False, validate_relationships: bool = True) -> Created:
        """All or none; with skip_duplicates, rows that fail are left out with a reason: validation, duplicate id, unique or foreign key."""
        stored = self.frame
        new, failed = self._judged(rows, validate_relationships)
        skipped = self.db.spark.createDataFrame([], "id string, reason string")
        if skip_duplicates:
            failed = self.db.keep(failed)
            skipped = failed.select(F.col(self.spec.id_field).alias("id"), F.col("why").alias("reason"))
            new = new.join(failed.select("_n"), "_n", "left_anti")
        else:
            self._raise_first(failed)
        new = new.drop("_issues", "_n")
        self._publish(stored.unionByName(new), ("create", new))
        return Created(new, skipped)

    def _judged(self, rows: Sequence[Mapping] | DataFrame, validate_relationships: bool = True, others: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """New rows (with _n and _issues), and of those that can't be created _n, id, why and issues. others: the stored rows, unless
        they are the collection's."""
        new = self._inputs(rows)
        stored, ident = self.frame if others is None else others, self.spec.id_field
        new = self.db.keep(new.withColumn("_issues", constraints.issues(new, self.spec)).withColumn("_n", F.monotonically_increasing_id()))
        bad = [("validation", new.where(F.size("_issues") > 0))]
        bad.append(("duplicate id", new.join(stored.select(ident), ident, "left_semi")))
        first = new.groupBy(ident).agg(F.min("_n").alias("_first"))
        bad.append(("duplicate id", new.join(first, ident).where("_n <> _first").select(new.columns)))
        for keys in constraints.normalize(self.spec.unique):
            bad.append(("unique", constraints.taken(new, stored, keys, ident)))
            again = new.where(" and ".join(f"{k} is not null" for k in keys)).groupBy(*keys).agg(F.min("_n").alias("_first"))
            bad.append(("unique", new.join(again, list(keys)).where("_n <> _first").select(new.columns)))
        if validate_relationships:
            for _, key, target in constraints.refs(self.db.specs, self.name):
                if key in new.columns:
                    targets = self.db.frames[target].select(self.db.specs[target].id_field)
                    if target == self.name:
                        targets = targets.unionByName(new.select(ident))
                    bad.append(("foreign key", constraints.fk_violations(new, key, targets, self.db.specs[target].id_field)))
        failed = None
        for i, (why, df) in enumerate(bad):
            part = df.select("_n", ident, F.lit(i).alias("_rank"), F.lit(why).alias("_why"), F.col("_issues"))
            failed = part if failed is None else failed.unionByName(part)
        return new, failed.groupBy("_n", ident).agg(F.min_by("_why", "_rank").alias("why"), F.first("_issues").alias("issues"))

    def _raise_first(self, failed: DataFrame) -> None:
        if (r := failed.orderBy("_n").first()) is not None:
            ident = r[self.spec.id_field]
            what = {"validation": ValidationError, "duplicate id": DuplicateKeyError, "unique": UniqueConstraintError, "foreign key": ForeignKeyError}[r.why]
            raise what(f"{self.name} {ident!r}: {r.why}", collection=self.name, id=ident, issues=[{"field": c, "message": "is missing"} for c in r.issues])

    def update(self, ident, changes: Mapping) -> Row:
        got = self.update_many(F.col(self.spec.id_field) == F.lit(ident), changes)
        if not got.count:
            raise NotFoundError(f"{self.name} has no row {ident!r}", collection=self.name, id=ident)
        return got.rows.first()

    def update_many(self, condition: Mapping | Column, changes: Mapping) -> Changed:
        self._changeable("update")
        changes = {k: v for k, v in changes.items() if k not in self.spec.computed}
        stored, hit = self.frame, self._condition(condition)
        new_values = updates.expressions(stored.schema, changes, self.spec.id_field)
        touched = stored.where(hit)
        changed = self._hooked("before_update", touched.withColumns(new_values)).select(*stored.columns)
        changed = self.db.keep(changed)
        count = changed.count()
        if count:
            rest = stored.where(~F.coalesce(hit, F.lit(False)))
            self._check(changed, rest, set(new_values))
            self._publish(rest.unionByName(changed), ("update", changed))
        return Changed(count, changed)

    def delete(self, ident, soft: bool = False) -> Row:
        got = self.delete_many(F.col(self.spec.id_field) == F.lit(ident), soft, restrict_soft=True)
        if not got.count:
            raise NotFoundError(f"{self.name} has no row {ident!r}", collection=self.name, id=ident)
        return got.rows.first()

    def delete_many(self, condition: Mapping | Column, soft: bool = False, limit: int | None = None, restrict_soft: bool = False, check_restrict: bool = True) -> Changed:
        self._changeable("delete")
        stored, ident = self.frame, self.spec.id_field
        gone = stored.where(self._condition(condition))
        if limit is not None:
            gone = gone.orderBy(ident).limit(max(0, limit))
        gone = self.db.keep(self._hooked("before_delete", gone))
        count = gone.count()
        if not count:
            return Changed(0, gone)
        if soft and "deletedAt" not in stored.columns:
            raise OperationError(f"{self.name} has no deletedAt", collection=self.name, reason="no soft delete")
        if check_restrict and (not soft or restrict_soft):
            for c, key in constraints.referrers(self.db.specs, self.name):
                others = self.db.frames[c]
                if c == self.name:
                    others = others.join(gone.select(ident), ident, "left_anti")
                bad = constraints.restrict_violations(gone, others, key, ident).first() if key in others.columns else None
                if bad is not None:
                    raise ForeignKeyError(f"{self.name} {bad[ident]!r} is referred to by {c}.{key}", collection=self.name, field=key, value=bad[ident])
        rest = stored.join(gone.select(ident), ident, "left_anti").select(*stored.columns)
        if soft:
            gone = self.db.keep(gone.withColumns({c: updates.now().cast(stored.schema[c].dataType) for c in ("deletedAt", "updatedAt") if c in stored.columns}))
            rest = rest.unionByName(gone)
        self._publish(rest, ("delete" if not soft else "update", gone))
        return Changed(count, gone)

    def upsert(self, where: Mapping, create: Mapping, update: Mapping) -> tuple[Row, str]:
        return self.upsert_many([{"where": where, "create": create, "update": update}])[0]

    def upsert_many(self, inputs: Sequence[Mapping]) -> list[tuple[Row, str]]:
        """(row, "created" | "updated" | "unchanged") of each input {where, create, update}, in their order and in one version.

        All inputs are held against the rows as they were before, by one join for each form of input (the fields and update
        operators that it names); of several that update one row, the last one counts."""
        self._changeable("upsert")
        stored, ident = self.frame, self.spec.id_field
        keys = [(ident,), *constraints.normalize(self.spec.unique)]
        forms: dict[tuple, list[tuple[int, Mapping]]] = {}
        for i, x in enumerate(inputs):
            if not any(all(k in x["where"] for k in u) for u in keys) or any(isinstance(v, Mapping) or k not in stored.columns for k, v in x["where"].items()):
                raise ValidationError("where must hold the id or a unique key, and values of fields", issues=[{"field": "where", "message": "not unique"}])
            changes = {k: v for k, v in x["update"].items() if k not in self.spec.computed}
            form = tuple(sorted(x["where"])), tuple(sorted((k, updates.form(stored.schema, k, v)) for k, v in changes.items()))
            forms.setdefault(form, []).append((i, {**x, "update": changes}))
        judged = None
        for (names, changes), some in forms.items():
            kinds = [stored.schema[c].dataType for c in names] + [updates.operand_type(stored.schema, k, op) for k, op in changes if not op.startswith("=")]
            moving = [(k, op) for k, op in changes if not op.startswith("=")]
            shape = StructType([StructField("_i", LongType()), *[StructField(f"_x{n}", kind) for n, kind in enumerate(kinds)]])
            try:
                asked = self.db.spark.createDataFrame([(i, *[x["where"][c] for c in names], *[updates.operand(x["update"][k], op) for k, op in moving]) for i, x in some], shape)
            except Exception as e:
                raise ValidationError(f"{self.name}: {e}", issues=[{"field": "*", "message": str(e)}]) from e
            same = reduce(Column.__and__, [F.col(f"_x{n}").eqNullSafe(F.col(f"`{c}`")) for n, c in enumerate(names)])
            both = asked.join(stored.withColumn("_hit", F.lit(True)), same, "left")
            new = {k: F.col(f"_x{len(names) + n}") if not op else {op: F.col(f"_x{len(names) + n}")} for n, (k, op) in enumerate(moving)}
            new |= {k: some[0][1]["update"][k] for k, op in changes if op.startswith("=")}
            values = updates.expressions(stored.schema, new, ident)
            plain = all(not op for _, op in changes)
            kept = reduce(Column.__and__, [F.col(f"`{k}`").eqNullSafe(v) for k, v in values.items() if k in new], F.lit(True)) if plain else F.lit(False)
            both = both.withColumn("_same", kept)
            both = both.select("_i", F.coalesce("_hit", F.lit(False)).alias("_hit"), "_same", *[F.when(F.col("_same"), F.col(f"`{c}`")).otherwise(values[c]).alias(c) if c in values else F.col(f"`{c}`") for c in stored.columns])
            judged = both if judged is None else judged.unionByName(both)
        if judged is None:
            return []
        judged = self.db.keep(judged)
        last = judged.where("_hit and not _same").groupBy(ident).agg(F.max("_i").alias("_i"))
        changed = self.db.keep(self._hooked("before_update", judged.join(last.select("_i"), "_i", "left_semi").select(*stored.columns)))
        missing = sorted(r["_i"] for r in judged.where("not _hit").select("_i").collect())
        touched = {k.split(".")[0] for _, changes in forms for k, _ in changes}
        rest = stored.join(changed.select(ident), ident, "left_anti").select(*stored.columns)
        n_changed = changed.count()
        if n_changed:
            self._check(changed, rest, touched)
        whole, events, made = rest.unionByName(changed), [("update", changed)] if n_changed else [], {}
        if missing:  # an id for each first, so that the rows can be told apart afterwards
            given = {i: {ident: self._new_id(), **inputs[i]["where"], **inputs[i]["create"]} for i in missing}
            new, failed = self._judged(list(given.values()), others=whole)
            self._raise_first(failed)
            new = new.drop("_issues", "_n")
            whole, events = whole.unionByName(new), [*events, ("create", new)]
            by_id = {r[ident]: r for r in new.collect()}
            made = {i: (by_id[r[ident]], "created") for i, r in given.items()}
        if events:
            self._publish(whole, *events)
        after = {r[ident]: r for r in changed.collect()}
        found = {r["_i"]: r for r in judged.where("_hit").collect()}
        out = []
        for i in range(len(inputs)):
            if i in made:
                out.append(made[i])
            else:
                row = Row(**{c: found[i][c] for c in stored.columns})
                out.append((row, "unchanged") if found[i]["_same"] else (after[row[ident]], "updated"))
        return out

    def merge(self, rows: DataFrame, update: Sequence[str] | None = None) -> DataFrame:
        """Upserts a DataFrame by id, with one full join and one version: rows with a new id are created, of others the columns
        ``update`` (all that rows have, if it isn't given) are set. Gives id and action: created, updated or unchanged. Rows with
        the same id are an error, as are those that no create or update would take."""
        self._changeable("upsert")
        stored, ident = self.frame, self.spec.id_field
        if (twice := constraints.unique_violations(rows, [ident]).first()) is not None:
            raise DuplicateKeyError(f"{self.name} {twice[ident]!r}: duplicate id", collection=self.name, id=twice[ident])
        names = [c for c in (update or rows.columns) if c in stored.columns and c != ident]
        given = rows.select(F.col(ident).alias("_id"), *[F.col(f"`{c}`").cast(stored.schema[c].dataType).alias(f"_{c}") for c in rows.columns if c in stored.columns and c != ident])
        both = stored.withColumn("_hit", F.lit(True)).join(given.withColumn("_new", F.lit(True)), F.col(ident) == F.col("_id"), "full")
        same = reduce(Column.__and__, [F.col(f"`{c}`").eqNullSafe(F.col(f"`_{c}`")) for c in names], F.lit(True))
        action = F.when(F.col("_new").isNull(), "stored").when(F.col("_hit").isNull(), "created").when(same, "unchanged").otherwise("updated")
        stamp = {"updatedAt"} & set(stored.columns) - set(names)

        def value(c: str) -> Column:
            now, new = F.col(f"`{c}`"), F.col(f"`_{c}`") if f"_{c}" in given.columns else F.lit(None).cast(stored.schema[c].dataType)
            if c == ident:
                return F.coalesce(now, F.col("_id")).alias(c)
            if c in ("createdAt", "updatedAt"):
                time = updates.now().cast(stored.schema[c].dataType)
                new = F.coalesce(new, time)
                now = F.when(F.col("_action") == "updated", time).otherwise(now) if c in stamp else now
            if c in names:
                now = F.when(F.col("_new").isNotNull(), new).otherwise(now)
            return F.when(F.col("_action") == "created", new).otherwise(now).alias(c)

        whole = self.db.keep(both.withColumn("_action", action).select(*[value(c) for c in stored.columns], "_action"))
        done = whole.where("_action <> 'stored'")
        changed, new = (done.where(F.col("_action") == a).select(*stored.columns) for a in ("updated", "created"))
        rest = whole.where("_action in ('stored', 'unchanged')").select(*stored.columns)
        self._check(changed, rest.unionByName(new), set(names))
        self._check(new, rest.unionByName(changed), set(stored.columns))
        if not done.where("_action <> 'unchanged'").isEmpty():
            self._publish(whole.select(*stored.columns), ("update", changed), ("create", new))
        return done.select(ident, F.col("_action").alias("action"))

    # relationship writes

    def create_with_relationships(self, row: Mapping) -> Row:
        """$create, $createMany, $connect (or a bare id object) and $connectOrCreate on relations; all in one transaction."""
        plain = {k: v for k, v in row.items() if k not in self.spec.relationships}
        ident = self.spec.id_field
        plain.setdefault(ident, self._new_id())
        with self.db.joined() as tx:
            after = []
            for name, ops in row.items():
                if name not in self.spec.relationships:
                    continue
                rel, key = self.spec.relationships[name], foreign_key(self.db.specs, self.name, name)
                ops = ops if isinstance(ops, Mapping) and any(k.startswith("$") for k in ops) else {"$connect": ops}
                if rel.kind == "ref":
                    plain[key] = self._link_ref(tx, rel.target, ops)
                else:
                    after.append((rel.target, key, ops))
            made = tx[self.name].create(plain)
            for target, key, ops in after:
                self._link_many(tx, target, key, made[ident], ops)
        return self.find_by_id(plain[ident])

    def update_with_relationships(self, ident, changes: Mapping) -> Row:
        """Besides plain changes: $disconnect, $connect, $update, $delete and $set on relations, in this order."""
        plain = {k: v for k, v in changes.items() if k not in self.spec.relationships}
        with self.db.joined() as tx:
            own = tx[self.name]
            row = own.find_by_id(ident)
            for name, ops in changes.items():
                if name not in self.spec.relationships:
                    continue
                rel, key = self.spec.relationships[name], foreign_key(self.db.specs, self.name, name)
                if rel.kind == "ref":
                    if ops.get("$disconnect"):
                        plain[key] = None
                    if "$connect" in ops:
                        plain[key] = tx[rel.target]._one(ops["$connect"])
                    if "$update" in ops and row[key] is not None:
                        tx[rel.target].update(plain.get(key) or row[key], ops["$update"])
                    continue
                target = tx[rel.target]
                ours = {key: ident}
                for op in ("$disconnect", "$delete"):
                    for w in _many(ops.get(op)):
                        target.update_many({**ours, **w}, {key: None})
                target._connect(_many(ops.get("$connect")), key, ident)
                for u in _many(ops.get("$update")):
                    target.update_many({**ours, **u["where"]}, u["data"])
                if "$set" in ops:
                    target.update_many(ours, {key: None})
                    target._connect(_many(ops["$set"]), key, ident)
            if plain:
                own.update(ident, plain)
        return self.find_by_id(ident)

    def delete_with_relationships(self, ident, include: Mapping[str, str] | None = None, soft: bool = False) -> tuple[Changed, dict]:
        got = self.delete_many_with_relationships(F.col(self.spec.id_field) == F.lit(ident), include, soft)
        if not got[0].count:
            raise NotFoundError(f"{self.name} has no row {ident!r}", collection=self.name, id=ident)
        return got

    def delete_many_with_relationships(self, condition, include: Mapping[str, str] | None = None, soft: bool = False, limit: int | None = None) -> tuple[Changed, dict]:
        """include: by relation, cascade, cascade_soft, set_null, restrict or preserve. All restricts are checked first."""
        ident, cascaded = self.spec.id_field, {}
        gone = self.frame.where(self._condition(condition))
        gone = self.db.keep(gone.orderBy(ident).limit(limit) if limit is not None else gone)
        hits = {}
        for name, how in (include or {}).items():
            rel = self.spec.relationships[name]
            if rel.kind == "inverse" and how != "preserve":
                key = foreign_key(self.db.specs, self.name, name)
                related = self.db.frames[rel.target].join(gone.select(F.col(ident).alias("_id")), F.col(key) == F.col("_id"), "left_semi")
                if how == "restrict":
                    if related.first() is not None:
                        raise ForeignKeyError(f"{self.name} is referred to by {rel.target}.{key}", collection=self.name, field=key)
                else:
                    hits[name] = rel.target, key, self.db.keep(related.select(self.db.specs[rel.target].id_field)), how
        with self.db.joined() as tx:
            for name, (target, key, related, how) in hits.items():
                other = tx[target]
                tid = other.spec.id_field
                mark = other.frame.join(related, tid, "left_semi")
                rest = other.frame.join(related, tid, "left_anti")
                n = related.count()
                if n and how == "cascade":
                    other._publish(rest.select(*other.frame.columns), ("delete", mark))
                elif n:
                    column = "deletedAt" if how == "cascade_soft" else key
                    value = updates.now() if how == "cascade_soft" else F.lit(None)
                    other._publish(rest.unionByName(mark.withColumn(column, value.cast(mark.schema[column].dataType))).select(*other.frame.columns), ("update", mark))
                cascaded[name] = {"count": n, "action": how}
            done = tx[self.name]._delete_rows(gone, soft)
        return done, cascaded

    # internals

    def _delete_rows(self, gone: DataFrame, soft: bool) -> Changed:
        marked = gone.select(F.col(self.spec.id_field))
        stored = self.frame
        rest = stored.join(marked, self.spec.id_field, "left_anti").select(*stored.columns)
        if soft:
            rest = rest.unionByName(gone.withColumn("deletedAt", updates.now().cast(stored.schema["deletedAt"].dataType)))
        n = gone.count()
        if n:
            self._publish(rest, ("update" if soft else "delete", gone))
        return Changed(n, gone)

    def _one(self, w):
        """The id of the row that a connection names."""
        if not isinstance(w, Mapping):
            w = {self.spec.id_field: w}
        row = self.frame.where(predicate.where(self.frame.schema, dict(w))).first()
        if row is None:
            raise ForeignKeyError(f"{self.name} has no row {dict(w)}", collection=self.name, value=dict(w))
        return row[self.spec.id_field]

    def _connect(self, some: list, key: str, parent) -> None:
        """Sets the key of all the rows that the connections name: one query for those by id, and one update."""
        if not some:
            return
        ident = self.spec.id_field
        by_id = [w if not isinstance(w, Mapping) else w[ident] for w in some if not isinstance(w, Mapping) or set(w) == {ident}]
        found = [self._one(w) for w in some if isinstance(w, Mapping) and set(w) != {ident}]
        if by_id:
            have = {r[0] for r in self.frame.where(F.col(ident).isin(by_id)).select(ident).collect()}
            if lost := [x for x in by_id if x not in have]:
                raise ForeignKeyError(f"{self.name} has no row {lost[0]!r}", collection=self.name, value=lost[0])
        self.update_many(F.col(ident).isin([*by_id, *found]), {key: parent})

    def _link_ref(self, tx: Database, target: str, ops: Mapping):
        other = tx[target]
        ident = other.spec.id_field
        if "$create" in ops:
            return other.create({ident: other._new_id(), **ops["$create"]})[ident]
        if "$connectOrCreate" in ops:
            x = ops["$connectOrCreate"]
            found = other.frame.where(predicate.where(other.frame.schema, dict(x["where"]))).first()
            return found[ident] if found is not None else other.create({ident: other._new_id(), **x["create"]})[ident]
        return other._one(ops["$connect"])

    def _link_many(self, tx: Database, target: str, key: str, parent, ops: Mapping) -> None:
        other = tx[target]
        ident = other.spec.id_field
        new = [*_many(ops.get("$create")), *_many(ops.get("$createMany"))]
        for x in _many(ops.get("$connectOrCreate")):
            found = other.frame.where(predicate.where(other.frame.schema, dict(x["where"]))).first()
            if found is None:
                new.append(x["create"])
            else:
                other.update(found[ident], {key: parent})
        if new:
            other.create_many([{ident: other._new_id(), **r, key: parent} for r in new])
        other._connect(_many(ops.get("$connect")), key, parent)

    def _new_id(self):
        g = self.spec.id_generator
        return (g if callable(g) else self.db.registry.generators.get(g) or ids.GENERATORS.get(g or "nano", ids.nano_id))()

    def _condition(self, condition: Mapping | Column) -> Column:
        return condition if isinstance(condition, Column) else predicate.where(self.frame.schema, condition, self.db.registry.operators)

    def _changeable(self, what: str) -> None:
        if self.spec.append_only:
            raise OperationError(f"{self.name} only takes new rows", collection=self.name, reason="append-only", operation=what)

    def _inputs(self, rows: Sequence[Mapping] | DataFrame) -> DataFrame:
        spec, schema = self.spec, self.frame.schema
        if not isinstance(rows, DataFrame):
            given = [{k: v for k, v in r.items() if k in schema.names} for r in rows]
            if "string" == schema[spec.id_field].dataType.simpleString():
                given = [{spec.id_field: self._new_id(), **r} for r in given]
            loose = StructType([type(f)(f.name, f.dataType, True) for f in schema])
            try:
                rows = self.db.spark.createDataFrame([tuple(r.get(c) for c in schema.names) for r in given], loose)
            except Exception as e:
                raise ValidationError(f"{self.name}: {e}", issues=[{"field": "*", "message": str(e)}]) from e
        rows = projection.strip_computed(rows, spec.computed)
        missing = {f.name: F.lit(None).cast(f.dataType) for f in schema if f.name not in rows.columns}
        rows = rows.withColumns(missing) if missing else rows
        stamps = {c: F.coalesce(F.col(c), updates.now().cast(schema[c].dataType)) for c in ("createdAt", "updatedAt") if c in schema.names}
        rows = rows.withColumns(stamps) if stamps else rows
        rows = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])
        return self._hooked("before_create", rows)

    def _check(self, changed: DataFrame, rest: DataFrame, touched: set[str]) -> None:
        """Of changed rows against the others: needed columns, touched unique keys and foreign keys."""
        bad = changed.withColumn("_issues", constraints.issues(changed, self.spec)).where(F.size("_issues") > 0).first()
        ident = self.spec.id_field
        if bad is not None:
            raise ValidationError(f"{self.name} {bad[ident]!r}: {bad['_issues']} missing", issues=[{"field": c, "message": "is missing"} for c in bad["_issues"]])
        for keys in constraints.normalize(self.spec.unique):
            if touched.intersection(keys) and (constraints.taken(changed, rest, keys, ident).first() is not None or constraints.unique_violations(changed, keys).first() is not None):
                raise UniqueConstraintError(f"{self.name}: {', '.join(keys)} is taken", collection=self.name, fields=list(keys))
        for _, key, target in constraints.refs(self.db.specs, self.name):
            if key in touched and (bad := constraints.fk_violations(changed, key, self.db.frames[target], self.db.specs[target].id_field).first()) is not None:
                raise ForeignKeyError(f"{self.name}.{key} = {bad[key]!r} has no row in {target}", collection=self.name, field=key, value=bad[key])

    def _hooked(self, point: str, rows: DataFrame) -> DataFrame:
        for hook in (*self.db.registry.hooks.get(point, ()), *self.spec.hooks.get(point, ())):
            try:
                got = hook(rows, self.name)
            except Exception as e:
                raise HookError(f"{point} of {self.name}: {e}", hook=point, collection=self.name) from e
            rows = rows if got is None else got
        return rows

    def _publish(self, df: DataFrame, *events: tuple[str, DataFrame]) -> None:
        """The collection's next version, and the hooks after each (operation, rows) that it is made of."""
        self.db.publish(self.name, df, *events)
        for operation, rows in events:
            for point in (f"after_{operation}", "on_change"):
                for hook in (*self.db.registry.hooks.get(point, ()), *self.spec.hooks.get(point, ())):
                    try:
                        hook(rows, self.name)
                    except Exception:  # noqa: BLE001  the change is done; hooks after it can't undo it
                        continue


def _many(x) -> list:
    return [] if x is None else [x] if isinstance(x, Mapping) or not isinstance(x, (list, tuple)) else list(x)


class Database:
    """Collections by name. initial: rows or DataFrames by collection, which win over stored rows with the same id, and over those
    of the collection's file. save_after: seconds from a change to the writing of the collection's file (0: at once); without it,
    files are written by ``flush``. New rows of an append-only collection in JSON lines are appended to its file."""

    def __init__(self, spark: SparkSession, specs: Mapping[str, CollectionSpec], initial: Mapping | None = None, root: str | None = None, plugins: Sequence = (), save_after: float | None = None):
        from quillon.sources.persist import Saver

        self.spark, self.specs = spark, dict(specs)
        self.registry = Registry(plugins, self.specs)
        self.store = Store(spark, root)
        self.frames: dict[str, DataFrame] = {}
        self.versions: dict[str, int] = {}
        self._lock, self._search, self.saver = threading.Lock(), {}, Saver(self, save_after)
        for name, spec in self.specs.items():
            df, version = self.store.load(name, spec.schema)
            from_file = not version and spec.file
            if from_file:
                df = self.saver.load(name)
            given = (initial or {}).get(name)
            if given is not None:
                if not isinstance(given, DataFrame):
                    by_id = {r[spec.id_field]: r for r in given}  # of one id, the last
                    given = spark.createDataFrame([tuple(r.get(c) for c in spec.schema.names) for r in by_id.values()], spec.schema)
                df = df.join(given.select(spec.id_field), spec.id_field, "left_anti").select(*given.columns).unionByName(given) if version or from_file else given
            self.frames[name], self.versions[name] = df, version

    def __getitem__(self, name: str) -> Collection:
        if name not in self.specs:
            raise CollectionNotFoundError(f"no collection {name}", collection=name)
        return Collection(self, name)

    def keep(self, df: DataFrame) -> DataFrame:
        """The rows, written once: ids and times in them don't change when they are read again."""
        return self.store.write("_work", df)[0]

    def publish(self, name: str, df: DataFrame, *events: tuple[str, DataFrame]) -> None:
        frame, path = self.store.write(name, df, indexed_columns(self.specs[name]))
        self._commit({name: (frame, path)}, {name: events})

    def take(self, name: str, frame: DataFrame, path: str) -> None:
        """Rows from the collection's file as its next version; the file isn't written again."""
        self.versions |= self.store.commit({name: path}, {name: self.versions[name]})
        self.frames[name] = frame
        self._search.pop(name, None)
        self.store.log(name, "update", self.versions[name])

    def _commit(self, new: Mapping[str, tuple[DataFrame, str]], events: Mapping[str, Sequence[tuple[str, DataFrame]]]) -> None:
        """Takes new frames (with their paths) as current, all at once or none."""
        self.versions |= self.store.commit({n: path for n, (_, path) in new.items()}, {n: self.versions[n] for n in new})
        for name, (frame, _) in new.items():
            self.frames[name] = frame
            operations = {op for op, _ in events[name]}
            self._search_after(name, events[name])
            self.store.log(name, operations.pop() if len(operations) == 1 else "update", self.versions[name])
            self.saver.changed(name, events[name])

    # the search index: tokens of the collection's rows, sorted by token; made when a query first wants it

    def search_table(self, name: str) -> DataFrame | None:
        """(token, id) of the collection's ``search_index`` fields, or None if it has none."""
        spec = self.specs[name]
        if not spec.search_index or spec.schema is None:
            return None
        if name not in self._search:
            self._search[name] = self._sorted_tokens(name, self.frames[name])
        return self._search[name]

    def _sorted_tokens(self, name: str, rows: DataFrame) -> DataFrame:
        spec = self.specs[name]
        table = search.token_table(rows, spec.id_field, list(spec.search_index))
        return self.keep(table.repartitionByRange("token").sortWithinPartitions("token"))

    def _search_after(self, name: str, events: Sequence[tuple[str, DataFrame]]) -> None:
        """Keeps the index up: tokens of created rows are added, and those of changed or deleted ones replaced."""
        if (table := self._search.pop(name, None)) is None:
            return
        ident = self.specs[name].id_field
        for operation, rows in events:
            if operation != "create":
                table = table.join(rows.select(ident), ident, "left_anti")
            if operation != "delete":
                table = table.unionByName(search.token_table(rows, ident, list(self.specs[name].search_index)).select(*table.columns))
        self._search[name] = self.keep(table.repartitionByRange("token").sortWithinPartitions("token"))

    @contextmanager
    def transaction(self):
        """A database with the same collections whose changes are seen by itself alone, until the block ends well: then one commit
        takes them all. One transaction at a time; another one, or one within it, is refused."""
        if not self._lock.acquire(blocking=False):
            raise TransactionError("another transaction is open", operation="begin")
        tx = Transaction(self)
        try:
            yield tx
            if tx.written:
                self._commit(tx.written, tx.events)
        finally:
            tx.closed = True
            self._lock.release()

    def joined(self):
        """A transaction, or in one that itself: for changes that are made of several."""
        return self.transaction()

    def begin(self) -> Transaction:
        """A transaction to be ended by its ``commit`` or ``rollback``."""
        return Transaction.begun(self)

    def audit(self) -> DataFrame | None:
        return constraints.audit(self.specs, self.frames)

    def flush(self) -> None:
        """Writes the collections that have a file, in its format."""
        self.saver.flush()

    def close(self) -> None:
        self.saver.close()
        self.registry.shutdown()


class Transaction(Database):
    def __init__(self, db: Database):
        self.db, self.spark, self.specs, self.registry, self.store = db, db.spark, db.specs, db.registry, db.store
        self.frames, self.versions, self._search = dict(db.frames), dict(db.versions), {}
        self.written: dict[str, tuple[DataFrame, str]] = {}
        self.events: dict[str, list[tuple[str, DataFrame]]] = {}
        self.closed, self._context = False, None

    @classmethod
    def begun(cls, db: Database) -> Transaction:
        context = db.transaction()
        tx = context.__enter__()
        tx._context = context
        return tx

    def commit(self) -> None:
        self._end(None)

    def rollback(self) -> None:
        self._end(TransactionError("rolled back", operation="rollback"))

    def _end(self, why: Exception | None) -> None:
        if self.closed or self._context is None:
            raise TransactionError("the transaction is closed", operation="end")
        if why is None:
            self._context.__exit__(None, None, None)
        else:
            try:
                self._context.__exit__(type(why), why, None)
            except TransactionError as e:
                if e is not why:
                    raise

    def __getitem__(self, name: str) -> Collection:
        if self.closed:
            raise TransactionError("the transaction is closed", operation="use")
        return super().__getitem__(name)

    def transaction(self):
        raise TransactionError("a transaction is open already", operation="begin", reason="nested")

    @contextmanager
    def joined(self):
        yield self

    def publish(self, name: str, df: DataFrame, *events: tuple[str, DataFrame]) -> None:
        if self.closed:
            raise TransactionError("the transaction is closed", operation="write")
        self.written[name] = self.store.write(name, df, indexed_columns(self.specs[name]))
        self.frames[name] = self.written[name][0]
        self.events.setdefault(name, []).extend(events)
        self._search.pop(name, None)
