"""Vectorised byte kernels shared by the Arrow-based operators of this subpackage.

Texts arrive as Arrow string arrays. A chunk is a run of whole texts of about ``CHUNK_BYTES`` (one
longer text is a chunk of its own), so that memory is bounded by the chunk and the longest text.
Nulls count as empty texts. Hashes are 64 bits, made by a polynomial over the bytes and a finaliser.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CHUNK_BYTES = 1 << 19
U = np.uint64
_P = 0x9E3779B97F4A7C55 | 1
_PINV = pow(_P, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}

#: The separators of words: space and \t to \r.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def bounded_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches small, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; where that is unset, below a temporary one, if all
    executors run on this machine."""
    import tempfile
    import uuid

    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        top = f"{tempfile.gettempdir()}/quillon-checkpoints"
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written to the shared folder and read again: a cut of the lineage that outlives executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def power(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... modulo 2 ** 64, n of them at least."""
    key = str(base)
    if key not in _powers or len(_powers[key]) < n:
        n = max(n, CHUNK_BYTES + 1)
        out = np.empty(n, U)
        out[0] = 1
        have, step = 1, base
        while have < n:  # doubling
            k = min(have, n - have)
            np.multiply(out[:k], U(step), out=out[have : have + k])
            have += k
            step = step * step % (1 << 64)
        if n > 8 * CHUNK_BYTES:
            return out
        _powers[key] = out
    return _powers[key]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes of these texts, their offsets in the bytes)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    _, offs, data = texts.buffers()
    at = np.frombuffer(offs, np.int64, n + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


class Spans:
    """Spans of a chunk (words or lines): start, end, the text that each belongs to, and where each text's spans begin."""

    def __init__(self, start: np.ndarray, end: np.ndarray, offs: np.ndarray):
        self.start, self.end = start, end
        self.first = np.searchsorted(start, offs)  # len(texts) + 1
        self.n = np.diff(self.first)
        self.text = np.repeat(np.arange(len(offs) - 1), self.n)


def words(data: np.ndarray, offs: np.ndarray, apart: np.ndarray = SPACE) -> Spans:
    """Maximal runs of bytes that aren't separators; no word crosses the end of a text."""
    if not len(data):
        return Spans(np.zeros(0, np.int64), np.zeros(0, np.int64), offs)
    inside = ~apart[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before[offs[:-1][offs[:-1] < len(data)]] = False
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = offs[1:][offs[1:] > 0] - 1
    after[ends] = False
    return Spans(np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1, offs)


def hashes(data: np.ndarray, s: Spans) -> np.ndarray:
    """A hash of each span's bytes."""
    if not len(s.start):
        return np.zeros(0, U)
    total = np.empty(len(data) + 1, U)
    total[0] = 0
    np.cumsum((data.astype(U) + U(1)) * power(_P, len(data))[: len(data)], out=total[1:])
    raw = (total[s.end] - total[s.start]) * power(_PINV, len(data))[s.start]
    return mix(raw ^ ((s.end - s.start).astype(U) * U(0xD6E8FEB86659FD93)))


def shingles(h: np.ndarray, s: Spans, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of k consecutive words, the text of each, and the index of its first word. Texts with fewer words give none."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    ok = s.text[:n] == s.text[k - 1 :]
    out = h[:n] * U(0x2127599BF4325C37)
    for i in range(1, k):
        out = mix(out + h[i : n + i] + U(i))
    at = np.flatnonzero(ok)
    return out[at], s.text[:n][at], at


def summed(values: np.ndarray, s: Spans) -> np.ndarray:
    """Sums of one value a span, over each text."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[s.first[1:]] - total[s.first[:-1]]


class Memory:
    """Results of a function of many strings, kept by a Python worker over its tasks.

    Two generations of ``most`` entries each: what was used since the older one was filled stays, so memory is bounded
    and frequent strings remain. Strings longer than ``longest`` are computed each time.
    """

    def __init__(self, compute, most: int = 400_000, longest: int = 64):
        self.compute, self.most, self.longest, self.new, self.old = compute, most, longest, {}, {}

    def values(self, keys: list[str]) -> list:
        """compute's results for the keys, in order; no result is None."""
        if len(self.new) >= self.most:
            self.old, self.new = self.new, {}
        new = self.new
        out = list(map(new.get, keys))
        if None in out:
            places = [i for i, v in enumerate(out) if v is None]
            found = {keys[i]: None for i in places}
            found = dict(zip(found, map(self.old.get, found), strict=True))
            if unknown := [k for k, v in found.items() if v is None]:
                found.update(zip(unknown, self.compute(unknown), strict=True))
            for i in places:
                out[i] = found[keys[i]]
            new.update(found if max(map(len, found)) <= self.longest else {k: v for k, v in found.items() if len(k) <= self.longest})
        return out

    def by_text(self, runs: list[list[str]]) -> list[list]:
        """The results for the runs of each text."""
        flat = self.values([x for r in runs for x in r])
        ends = list(accumulate(map(len, runs)))
        return [flat[i:j] for i, j in zip([0, *ends], ends)]  # noqa: B905


_workers: dict = {}


def worker(key: tuple, make):
    """make(), once for each key in a Python worker."""
    if key not in _workers:
        _workers[key] = make()
    return _workers[key]


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run (of mapInArrow) in a worker that keeps nothing of other operators meanwhile (see ``worker``; unless run ``keeps`` its
    own there), and gives the memory of its own arrays back to the system at its end; a worker that waits for tasks counts with its executor."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _workers and not keeps:
            _workers.clear()
            gc.collect()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
                trim(0)

    return task
