"""Live queries: a stream over the change log that evaluates the query anew, and gives its result where it differs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql.streaming import StreamingQuery

from quillon.store import CHANGE_SCHEMA


def watch(collection, on_result: Callable[[list], None], debounce_ms: int = 10, available_now: bool = False, **query) -> StreamingQuery:
    """Gives the first result at once, then a whole result for each batch of changes of this collection, unless it equals
    the one before. Stop the returned query to end it. available_now: only the changes that are there."""
    from quillon.database import Transaction
    from quillon.errors import TransactionError

    db, last = collection.db, [None]
    if isinstance(db, Transaction):
        raise TransactionError("no live queries in a transaction", operation="watch")

    def evaluate() -> None:
        found = collection.query(**query).collect()
        if found != last[0]:
            last[0] = found
            on_result(found)

    evaluate()
    db.store._fs.mkdirs(db.store._path(db.store.changes))
    log = db.spark.readStream.schema(CHANGE_SCHEMA).json(db.store.changes)
    mine = log.where(log["collection"] == collection.name)

    def batch(changes, _epoch: int) -> None:
        if not changes.isEmpty():
            evaluate()

    writer = mine.writeStream.foreachBatch(batch)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{debounce_ms} milliseconds")
    return writer.start()


def watch_by_id(collection, ident, on_row: Callable[[object], None], **more) -> StreamingQuery:
    """The row with the id, or None, each time that it changes."""
    return watch(collection, lambda rows: on_row(rows[0] if rows else None), where={collection.spec.id_field: ident}, **more)
