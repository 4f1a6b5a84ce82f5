"""Files of rows in any format, as DataFrames. JSON lines are read and written by Spark itself, file by file in parallel, and JSON
is read by Spark's own parser. Other formats hold one object of rows by id (or a list) in a file, so each file is parsed by one
task and files are read in parallel; such files are meant for collections that people read, and are written through the driver."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillon.errors import MigrationError, SerializationError, StorageError
from quillon.migrate import run as migrate
from quillon.sources.codecs import Codecs

VERSION = "_version"
LINES = ("jsonl", "ndjson")
ATTEMPTS, WAIT = 3, 0.1


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stamp(spark: SparkSession, path: str) -> tuple[int, int] | None:
    """Time of the last change and length of a file, or of the newest part of a folder; None if there is none."""
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return None
    at = fs.getFileStatus(p)
    parts = [at] if at.isFile() else list(fs.listStatus(p))
    return max([x.getModificationTime() for x in parts], default=0), sum(x.getLen() for x in parts)


def format_of(path: str, fmt: str | None = None) -> str:
    return (fmt or path.rsplit(".", 1)[-1]).lower()


def _objects(value, id_field: str) -> dict:
    """Rows by id of a file's content: an object of rows, or a list."""
    return value if isinstance(value, dict) else {str(row.get(id_field)): row for row in value}


def version_of(spark: SparkSession, path: str, fmt: str | None = None, codecs: Codecs | None = None) -> int | None:
    """The version that a file says it has; 0 if it says none, None if there is no file."""
    if stamp(spark, path) is None:
        return None
    fmt = format_of(path, fmt)
    if fmt in LINES or fmt == "prose":
        return 0
    text = spark.read.text(path, wholetext=True).first()
    value = (codecs or Codecs()).decode(text.value, fmt) if text else {}
    return int(value.get(VERSION, 0)) if isinstance(value, dict) else 0


def load(spark: SparkSession, path: str, schema: StructType, fmt: str | None = None, codecs: Codecs | None = None, version: int = 0, migrations=(), id_field: str = "id") -> DataFrame:
    """A missing file gives no rows. Rows of an older version are migrated; a newer version is an error."""
    if stamp(spark, path) is None:
        return spark.createDataFrame([], schema)
    fmt = format_of(path, fmt)
    if fmt in LINES:
        return spark.read.schema(schema).json(path)
    codecs = codecs or Codecs()
    texts = spark.read.text(path, wholetext=True)
    if not version and not migrations:
        if fmt == "json":
            entries = texts.select(F.explode(F.map_entries(F.from_json("value", "map<string,string>"))).alias("e")).where(F.col("e.key") != VERSION).select(F.col("e.value").alias("row"))
            items = texts.where(F.ltrim("value").startswith("[")).select(F.explode(F.from_json("value", "array<string>")).alias("row"))
            rows = entries.unionByName(items)
        else:

            @F.udf("array<string>")
            def decoded(text):
                value = codecs.decode(text, fmt)
                value = [v for k, v in value.items() if k != VERSION] if isinstance(value, dict) else value
                return [json.dumps(r) for r in value if isinstance(r, dict)]

            rows = texts.select(F.explode(decoded("value")).alias("row"))
        return rows.where("row is not null").select(F.from_json("row", schema).alias("row")).select("row.*")
    # versioned files are whole objects: the chain of migrations takes all rows of one file at once
    out = []
    for r in texts.toLocalIterator():
        value = codecs.decode(r.value, fmt)
        have = int(value.pop(VERSION, 0)) if isinstance(value, dict) else 0
        if have > version:
            raise MigrationError(f"{path} has version {have}, ahead of {version}", from_version=have, to_version=version)
        out += list(migrate(_objects(value, id_field), migrations, have, version).values())
    needed = [f.name for f in schema if not f.nullable]
    for r in out:
        if lost := [c for c in needed if r.get(c) is None]:
            raise MigrationError(f"{path}: {r.get(id_field)!r} has no {', '.join(lost)} after its migration", to_version=version)
    try:
        return spark.createDataFrame([tuple(r.get(c) for c in schema.names) for r in out], schema)
    except Exception as e:
        raise MigrationError(f"{path} doesn't fit the schema after its migration: {e}", to_version=version) from e


def _by_id(df: DataFrame, ident: str, version: int = 0) -> dict:
    value: dict = {VERSION: version} if version else {}
    for row in df.toJSON().toLocalIterator():
        r = json.loads(row)
        value[str(r.get(ident))] = {c: r.get(c) for c in df.columns}
    return value


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A whole file in place of the one before: written beside it, and taken over by one rename. Tried again after failures."""
    jvm = spark.sparkContext._jvm
    target, fs = _fs(spark, path)
    part, _ = _fs(spark, f"{path}.part")
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    for attempt in range(ATTEMPTS):
        try:
            out = fs.create(part, True)
            out.write(bytearray(text.encode()))
            out.close()
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(target).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
            context.rename(fs.makeQualified(part), fs.makeQualified(target), options)
            return
        except Exception as e:
            if attempt == ATTEMPTS - 1:
                raise StorageError(f"{path}: {e}", path=path) from e
            time.sleep(WAIT * 2**attempt)


def save(df: DataFrame, path: str, spec=None, fmt: str | None = None, codecs: Codecs | None = None) -> None:
    """Writes rows: JSON lines by Spark as a folder of parts, other formats as one file of rows by id."""
    fmt = format_of(path, fmt or (spec.format if spec else None))
    if fmt in LINES:
        df.write.mode("overwrite").json(path)
        return
    ident = spec.id_field if spec else "id"
    codecs = codecs or Codecs()
    value = _by_id(df, ident, spec.version if spec else 0)
    if fmt == "prose":
        if not spec or not spec.template:
            raise SerializationError("prose needs the collection's template", format="prose")
        from quillon.sources.codecs import prose_codec

        value, codecs = [r for k, r in value.items() if k != VERSION], Codecs((prose_codec(spec.template, spec.overflow),))
    write_text(df.sparkSession, path, codecs.encode(value, fmt))


def append(df: DataFrame, path: str) -> None:
    """New rows as JSON lines, in parts of their own."""
    df.write.mode("append").json(path)


def load_many(spark: SparkSession, path: str, schemas: dict[str, StructType], fmt: str | None = None, codecs: Codecs | None = None) -> dict[str, DataFrame]:
    """Several collections of one file: {collection: {id: row}}."""
    fmt, codecs = format_of(path, fmt), codecs or Codecs()
    if stamp(spark, path) is None:
        return {c: spark.createDataFrame([], s) for c, s in schemas.items()}
    text = spark.read.text(path, wholetext=True).first()
    value = codecs.decode(text.value if text else "", fmt) or {}
    out = {}
    for c, schema in schemas.items():
        rows = {k: v for k, v in (value.get(c) or {}).items() if k != VERSION}
        out[c] = spark.createDataFrame([tuple(r.get(x) for x in schema.names) for r in rows.values()], schema)
    return out


def save_many(frames: dict[str, DataFrame], path: str, specs=None, fmt: str | None = None, codecs: Codecs | None = None) -> None:
    """Several collections as one file: {collection: {id: row}}."""
    specs = specs or {}
    value = {c: _by_id(df, specs[c].id_field if c in specs else "id", specs[c].version if c in specs else 0) for c, df in frames.items()}
    write_text(next(iter(frames.values())).sparkSession, path, (codecs or Codecs()).encode(value, format_of(path, fmt)))


def to_csv(rows: list[dict]) -> str:
    """Rows with the union of their keys as header; fields are quoted where they must be."""
    keys = list(dict.fromkeys(k for r in rows for k in r))
    if not keys:
        return ""

    def cell(v) -> str:
        if v is None:
            return ""
        text = v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
        return '"' + text.replace('"', '""') + '"' if any(c in text for c in ',"\n\r') else text

    return "\n".join(",".join(map(cell, line)) for line in [keys, *[[r.get(k) for k in keys] for r in rows]])
