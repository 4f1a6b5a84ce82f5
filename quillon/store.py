"""Versioned snapshots. A version of a collection is a folder of Parquet files that never changes; a commit is a small file that
names the current folder of every collection. New versions are written whole, and one new commit then takes all of them as
current, so a change of several collections is seen as a whole or not at all, readers keep what they began with, and a rollback
has nothing to undo. A commit is made only once (its file is created, never replaced), so of two writers one fails. A row is
appended to the change log for each collection of a commit."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from quillon.errors import ConcurrencyError, StorageError

CHANGE_SCHEMA = "collection string, operation string, version long, at double"
#: Seconds after which a commit that was begun, but isn't readable, counts as given up.
GIVEN_UP = 60


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; where that is unset, below a temporary one, if all
    executors run on this machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise StorageError("spark.checkpoint.dir must name a folder that all executors share", path=None)
        import tempfile

        shared = tempfile.gettempdir()
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Store:
    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = (root or work_dir(spark, "quillon-store")).rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._jvm = jvm

    def _names(self, folder: str) -> list[str]:
        top = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(top)) if self._fs.exists(top) else []

    def _read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    @property
    def commits(self) -> str:
        return f"{self.root}/_commits"

    def current(self) -> tuple[int, dict[str, dict]]:
        """The last commit: its number, and {collection: {version, path}}. 0 and {} before the first one."""
        for name in reversed(self._names(self.commits)):
            try:
                return int(name.split(".")[0]), json.loads(self._read(f"{self.commits}/{name}"))
            except ValueError:  # begun, and not readable
                continue
        return 0, {}

    def load(self, name: str, schema: StructType) -> tuple[DataFrame, int]:
        at = self.current()[1].get(name)
        if at is None:
            return self.spark.createDataFrame([], schema), 0
        return self.spark.read.schema(schema).parquet(f"{self.root}/{at['path']}"), at["version"]

    def write(self, name: str, df: DataFrame, indexed: Sequence[str] = ()) -> tuple[DataFrame, str]:
        """The rows as a folder that no commit names yet, and its path below the root. indexed: columns that get Bloom filters, by
        which a scan for a value skips row groups."""
        path = f"{name}/{uuid.uuid4().hex}"
        writer = df.write
        for c in indexed:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        writer.parquet(f"{self.root}/{path}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{path}"), path

    def commit(self, paths: Mapping[str, str], expected: Mapping[str, int]) -> dict[str, int]:
        """Takes written folders as current, all at once, and gives their versions. Fails, and changes nothing, if a collection
        isn't at the expected version any more."""
        number, now = self.current()
        for name in paths:
            have = now.get(name, {"version": 0})["version"]
            if have != expected[name]:
                raise ConcurrencyError(f"{name} is at version {have}, not {expected[name]}", collection=name)
        names = self._names(self.commits)
        last = int(names[-1].split(".")[0]) if names else 0
        if last > number and time.time() - self._fs.getFileStatus(self._path(f"{self.commits}/{names[-1]}")).getModificationTime() / 1000 < GIVEN_UP:
            raise ConcurrencyError("another commit is being made", collection=next(iter(paths)))
        new = now | {name: {"version": expected[name] + 1, "path": path} for name, path in paths.items()}
        try:
            out = self._fs.create(self._path(f"{self.commits}/{last + 1:012d}.json"), False)
        except Exception as e:
            if "AlreadyExists" in str(e) or "already exists" in str(e):
                raise ConcurrencyError("another commit was made meanwhile", collection=next(iter(paths))) from e
            raise StorageError(f"a commit can't be written: {e}", path=self.commits) from e
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        return {name: expected[name] + 1 for name in paths}

    def log(self, collection: str, operation: str, version: int) -> None:
        line = json.dumps({"collection": collection, "operation": operation, "version": version, "at": time.time()})
        path = self._path(f"{self.changes}/{time.time_ns():020d}-{uuid.uuid4().hex}.json")
        hidden = self._path(f"{self.changes}/_{uuid.uuid4().hex}")
        try:
            out = self._fs.create(hidden)
            out.write(bytearray(line.encode() + b"\n"))
            out.close()
            self._fs.rename(hidden, path)
        except Exception as e:
            raise StorageError(f"the change log can't be written: {e}", path=self.changes) from e

    @property
    def changes(self) -> str:
        return f"{self.root}/changes"

    def vacuum(self, keep: int = 2) -> int:
        """Deletes the folders of collections that none of the last commits names, and gives their number. For times without
        writers: a version that is being written is named by no commit yet."""
        names = self._names(self.commits)[-keep:]
        used = {at["path"] for name in names for at in json.loads(self._read(f"{self.commits}/{name}")).values()}
        gone = [f"{c}/{x}" for c in {p.split("/")[0] for p in used} for x in self._names(f"{self.root}/{c}") if f"{c}/{x}" not in used]
        for path in gone:
            self._fs.delete(self._path(f"{self.root}/{path}"), True)
        return len(gone)
