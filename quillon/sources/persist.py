"""Files behind a database: loaded when it is opened, written after changes, and loaded anew when others change them."""

from __future__ import annotations

import threading
from collections.abc import Sequence

from pyspark.sql import DataFrame

from quillon.sources import files
from quillon.sources.codecs import ALL, Codecs, prose_codec


class Saver:
    """Writes the files of changed collections: after ``delay`` seconds without another change, at once if it is 0, or by
    ``flush`` alone if it is None."""

    def __init__(self, db, delay: float | None = None):
        self.db, self.delay = db, delay
        self.pending: dict[str, threading.Timer | None] = {}
        self.stamps: dict[str, tuple | None] = {}
        self._lock = threading.RLock()

    def codecs(self, name: str) -> Codecs:
        spec = self.db.specs[name]
        own = [prose_codec(spec.template or "{id}", spec.overflow)]
        return Codecs((*ALL, *own, *dict.fromkeys(self.db.registry.codecs.values())))

    def load(self, name: str) -> DataFrame:
        """The rows of the collection's file. A file of an older version is written back once its rows are migrated."""
        spec, spark, codecs = self.db.specs[name], self.db.spark, self.codecs(name)
        df = files.load(spark, spec.file, spec.schema, spec.format, codecs, spec.version, spec.migrations, spec.id_field)
        have = files.version_of(spark, spec.file, spec.format, codecs) if spec.version else None
        if have is not None and have < spec.version:
            files.save(df, spec.file, spec, codecs=codecs)
        self.stamps[name] = files.stamp(spark, spec.file)
        return df

    def changed(self, name: str, events: Sequence[tuple[str, DataFrame]]) -> None:
        spec = self.db.specs[name]
        if not spec.file:
            return
        if spec.append_only and files.format_of(spec.file, spec.format) in files.LINES and all(op == "create" for op, _ in events):
            with self._lock:
                for _, rows in events:
                    files.append(rows, spec.file)
                self.stamps[name] = files.stamp(self.db.spark, spec.file)
            return
        if self.delay is None:
            self.pending.setdefault(name, None)
        elif self.delay <= 0:
            self.save(name)
        else:
            with self._lock:
                if (timer := self.pending.get(name)) is not None:
                    timer.cancel()
                timer = self.pending[name] = threading.Timer(self.delay, self.save, (name,))
                timer.daemon = True
                timer.start()

    def save(self, name: str) -> None:
        spec = self.db.specs[name]
        with self._lock:
            if (timer := self.pending.pop(name, None)) is not None:
                timer.cancel()
            files.save(self.db.frames[name], spec.file, spec, codecs=self.codecs(name))
            self.stamps[name] = files.stamp(self.db.spark, spec.file)

    def flush(self) -> None:
        """Writes all collections that have a file, but for append-only ones whose file has all rows already."""
        for name, spec in self.db.specs.items():
            if spec.file and not (spec.append_only and files.format_of(spec.file, spec.format) in files.LINES and self.stamps.get(name)):
                self.save(name)

    def close(self) -> None:
        for name in list(self.pending):
            if self.delay is not None:
                self.save(name)


class FileWatcher:
    """Looks for files that others have changed, every so many seconds, and publishes their rows."""

    def __init__(self, db, seconds: float = 1.0):
        self.db, self.seconds = db, seconds
        self._stop, self._thread = threading.Event(), None

    def poll(self) -> list[str]:
        """The collections that were loaded anew."""
        out = []
        for name, spec in self.db.specs.items():
            if spec.file and (now := files.stamp(self.db.spark, spec.file)) is not None and now != self.db.saver.stamps.get(name):
                rows = self.db.saver.load(name)
                frame, path = self.db.store.write(name, rows)
                self.db.take(name, frame, path)
                out.append(name)
        return out

    def start(self) -> FileWatcher:
        def run() -> None:
            while not self._stop.wait(self.seconds):
                self.poll()

        self._thread = threading.Thread(target=run, daemon=True)
        self._thread.start()
        return self

    def stop(self) -> None:
        self._stop.set()
        if self._thread is not None:
            self._thread.join()
