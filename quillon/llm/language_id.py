"""Language identification by prediction by partial matching.

Each language has a context tree over bytes, of variable order up to 3: the node of a context holds how often each byte
followed it in the language's training texts. A byte costs its exact code length under these frozen counts. In a context
with n followers of d kinds (escape method C), a byte seen c times has probability c / (n + d); another byte costs the
escape d / (n + d) and then its cost in the context that is one byte shorter; below the empty context all 256 bytes are
alike. A context that a language doesn't have costs nothing and leaves the byte to the shorter one. The language with
the shortest code for the whole text is predicted; the score is its share of 2 ** -length over all languages.

Training counts 4-byte runs over all training texts, summed by each task before the shuffle. All counts are kept, so the
model grows with the corpus. Costs by the last byte alone are a dense table (65,536 x languages); those of 2 and 3 bytes are
hash tables of the runs that some language has. A model of over ``MOST_CELLS`` costs (runs x languages) is cut into shards
by the two bytes before the one that is coded; each byte of a text then belongs to one shard, each shard is broadcast
and scored by itself, and the shards' lengths are summed. So a broadcast has a bounded size, whatever the corpus.

Defined cases: a null text or one without a letter is ``und`` with score 0; so is any text if nothing was learned. Rows
without a language don't train. Equal code lengths: the language that sorts first. Extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm import kernels as K

MOST_CELLS = 8_000_000  # of a shard
EDGE = b"\n\n\n"
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True


def _grams(data: np.ndarray) -> np.ndarray:
    """The byte at each place with the three before it, most significant first; data begins with EDGE."""
    x = data.astype(np.uint32)
    return x[:-3] << np.uint32(24) | x[1:-2] << np.uint32(16) | x[2:-1] << np.uint32(8) | x[3:]


def count_grams(docs: DataFrame) -> DataFrame:
    """lang, gram, n over docs (lang, text) without nulls."""
    K.bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(text.encode("utf-8", "replace"))
            for lang, texts in by_lang.items():
                data = np.frombuffer(EDGE + EDGE.join(texts), np.uint8)
                for i in range(0, len(data), K.CHUNK_BYTES):
                    part = data[i : i + K.CHUNK_BYTES + 3]
                    if len(part) > 3:
                        new = np.unique(_grams(part), return_counts=True)
                        if lang in held:
                            new = _merged(*(np.concatenate(x) for x in zip(held[lang], new, strict=True)))
                        if len(new[0]) > 1_000_000:
                            yield _rows(lang, *new)
                            new = np.zeros(0, np.uint32), np.zeros(0, np.int64)
                        held[lang] = new
        for lang, new in held.items():
            yield _rows(lang, *new)

    return docs.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _merged(grams: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kinds, at = np.unique(grams, return_inverse=True)
    return kinds, np.bincount(at, n, len(kinds)).astype(np.int64)


def _rows(lang: str, grams: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


class Table:
    """Rows of numbers by key: a hash table with open places, looked up for many keys at once."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        self.keys, self.rows = keys, rows
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.place = np.full(1 << self.bits, -1, np.int32)
        todo = np.arange(len(keys))
        at = self._hash(keys)
        while len(todo):
            free = self.place[at[todo]] < 0
            slot, first = np.unique(at[todo[free]], return_index=True)
            self.place[slot] = todo[free][first]
            todo = todo[self.place[at[todo]] != todo]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        at = self._hash(keys)
        out = self.place[at].astype(np.int64)
        if not len(self.keys):
            return out
        todo = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            out[todo] = self.place[at[todo]]
            todo = todo[(out[todo] >= 0) & (self.keys[out[todo]] != keys[todo])]
        return out


def _shard(gram: np.ndarray, shards: int) -> np.ndarray:
    """The shard of 4-byte runs, by their two middle bytes."""
    return (gram >> 8 & 0xFFFF) * 40503 % 65536 * shards >> 16


def short_costs(langs: int, by_lang: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Costs of a byte after one byte (65,536 rows: the two bytes), by language. by_lang: two-byte runs and their counts."""
    out = np.empty((1 << 16, langs), np.float32)
    for k, (gram, n) in enumerate(by_lang):
        one = np.bincount(gram, n, 1 << 16).reshape(256, 256)
        below = Model.cost(one.sum(0)[None, :], np.full((1, 256), 8.0))
        out[:, k] = Model.cost(one, np.repeat(below, 256, 0)).ravel()
    return out


class Model:
    """Costs of a byte after the three before it, for each language, of one shard of all runs."""

    def __init__(self, langs: list[str], grams: list[tuple[np.ndarray, np.ndarray]], short: np.ndarray | None = None, shard: int = 0, shards: int = 1):
        """grams: of each language, the shard's 4-byte runs and their counts. short: the short costs, if the shard hasn't all runs."""
        self.langs, self.shard, self.shards = langs, shard, shards
        self.short = short_costs(len(langs), [(g & 0xFFFF, n) for g, n in grams]) if short is None else short
        three = [_merged(g & 0xFFFFFF, n) for g, n in grams]
        self.escape2, self.three = self._order(three, lambda g: self.short[g & 0xFFFF])
        self.escape3, self.four = self._order(grams, lambda g: self.three.rows[self.three.find(g & 0xFFFFFF)])

    @staticmethod
    def cost(counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        """Costs of each byte (column) in each context (row), from the counts there and the costs in the shorter context."""
        n, d = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
        total = np.maximum(n + d, 1)
        with np.errstate(divide="ignore"):
            escape = np.where(n > 0, -np.log2(np.maximum(d, 1) / total), 0.0)
            return np.where(counts > 0, -np.log2(counts / total), escape + shorter)

    def _order(self, by_lang: list[tuple[np.ndarray, np.ndarray]], shorter) -> tuple[Table, Table]:
        """Escapes by context, and costs by run, of runs of one length; both for all languages, of what some language has."""
        every = np.unique(np.concatenate([g for g, _ in by_lang]))
        contexts = np.unique(every >> 8)
        escape = np.zeros((len(contexts), len(by_lang)), np.float32)
        cost = shorter(every).astype(np.float32) if len(every) else np.zeros((0, len(by_lang)), np.float32)
        for k, (gram, n) in enumerate(by_lang):
            at = np.searchsorted(contexts, gram >> 8)
            total, kinds = np.bincount(at, n, len(contexts)), np.bincount(at, minlength=len(contexts))
            has = kinds > 0
            escape[has, k] = -np.log2(kinds[has] / (total + kinds)[has])
            cost[:, k] += escape[np.searchsorted(contexts, every >> 8), k]
            cost[np.searchsorted(every, gram), k] = -np.log2(n / (total + kinds)[at])
        return Table(contexts, escape), Table(every, cost)

    def costs(self, gram: np.ndarray) -> np.ndarray:
        """Of each 4-byte run, the cost of its last byte in each language."""
        at = self.four.find(gram)
        out = self.four.rows[at] if len(self.four.rows) else np.zeros((len(gram), len(self.langs)), np.float32)
        new = np.flatnonzero(at < 0)
        if len(new):
            g = gram[new]
            at = self.three.find(g & 0xFFFFFF)
            cost = self.three.rows[at] if len(self.three.rows) else np.zeros((len(g), len(self.langs)), np.float32)
            rest = np.flatnonzero(at < 0)
            cost[rest] = self.short[g[rest] & 0xFFFF] + self._escapes(self.escape2, g[rest] >> 8 & 0xFFFF)
            out[new] = cost + self._escapes(self.escape3, g >> 8)
        return out

    def _escapes(self, table: Table, context: np.ndarray) -> np.ndarray:
        at = table.find(context)
        out = np.zeros((len(context), len(self.langs)), np.float32)
        out[at >= 0] = table.rows[at[at >= 0]]
        return out

    def lengths(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Bits of each text in each language, as far as its bytes are the shard's. data: texts that each begin with EDGE, at offs."""
        out = np.zeros((len(offs) - 1, len(self.langs)))
        step = 1 << 18
        for i in range(3, len(data), step):
            j = min(i + step, len(data))
            gram = _grams(data[i - 3 : j]).astype(np.int64)
            at = np.arange(i, j)
            text = np.searchsorted(offs, at, "right") - 1
            inside = at - offs[text] >= 3  # a text's cost begins after its EDGE
            if self.shards > 1:
                inside &= _shard(gram, self.shards) == self.shard
            gram, text = gram[inside], text[inside]
            cost = self.costs(gram)
            for k in range(len(self.langs)):
                out[:, k] += np.bincount(text, cost[:, k], len(out))
        return out


class Trained:
    """Counts of 4-byte runs, written to the shared folder; ``shard(k)`` makes the model of one of its shards."""

    def __init__(self, counts: DataFrame, langs: list[str], shards: int):
        self.counts, self.langs, self.shards = counts, langs, shards
        two = counts.groupBy("lang", F.col("gram").bitwiseAND(0xFFFF).alias("gram")).agg(F.sum("n").alias("n"))
        self.short = short_costs(len(langs), self._by_lang(two))

    def _by_lang(self, counts: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
        got = counts.select("lang", "gram", "n").toArrow()
        lang, gram, n = (got.column(i).to_numpy() for i in range(3))
        return [(gram[lang == x], n[lang == x]) for x in self.langs]

    def shard(self, k: int) -> Model:
        mine = F.expr(f"((gram >> 8) & 65535) * 40503 % 65536 * {self.shards} >> 16") == k
        return Model(self.langs, self._by_lang(self.counts.where(mine)), self.short, k, self.shards)


def train(docs: DataFrame) -> Trained | None:
    """The model of docs (lang, text); rows with a null in either don't count."""
    counts = K.written(count_grams(docs.where("lang is not null and text is not null")), "grams")
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
    if not langs:
        return None
    runs = counts.select("gram").distinct().count()
    return Trained(counts, langs, -(-runs * len(langs) // MOST_CELLS))


def _measured(docs: DataFrame, model: Model, rest: list[str], text: str) -> DataFrame:
    """rest with has_letter and bits (of each language, in the shard's part) of the text."""
    shape = docs.select(*[F.col(f"`{c}`") for c in rest]).schema.add("has_letter", "boolean").add("bits", T.ArrayType(T.DoubleType()))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            found, bits = [np.zeros(0, bool)], [np.zeros((0, len(model.langs)))]
            for _, _, data, offs in K.chunks(b.column(len(rest))):
                letters = np.diff(np.append(0, np.cumsum(LETTER[data]))[offs]) > 0
                raw = data.tobytes()
                for k in np.flatnonzero(~letters).tolist():  # without an ASCII letter
                    letters[k] = any(map(str.isalpha, raw[offs[k] : offs[k + 1]].decode("utf-8", "replace")))
                with_edge = EDGE + EDGE.join(raw[x:y] for x, y in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True))
                found.append(letters)
                bits.append(model.lengths(np.frombuffer(with_edge, np.uint8), offs + 3 * np.arange(len(offs))))
            ends = np.arange(len(b) + 1, dtype=np.int32) * len(model.langs)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], pa.array(np.concatenate(found)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(bits).ravel()))], shape.names)

    return docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").cast("string").alias("_text")).mapInArrow(measure, shape)


def predict(docs: DataFrame, trained: Trained | None, text: str = "text") -> DataFrame:
    """docs without the text, with lang_pred and score."""
    K.bounded_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c not in (text, "lang_pred", "score")]
    own = [F.col(f"`{c}`") for c in rest]
    if trained is None:
        return docs.select(*own, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    if trained.shards == 1:
        measured = _measured(docs.select(F.struct(F.lit(True).alias("_"), *own).alias("_rest"), F.col(f"`{text}`").alias("_text")), trained.shard(0), ["_rest"], "_text")
    else:  # a pass over the texts for each shard
        rows = K.written(docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(F.lit(True).alias("_"), *own).alias("_rest"), F.col(f"`{text}`").alias("_text")), "texts")
        parts = [_measured(rows.select("_row", "_text"), trained.shard(k), ["_row"], "_text") for k in range(trained.shards)]
        sums = reduce(DataFrame.unionByName, parts).groupBy("_row").agg(F.max("has_letter").alias("has_letter"), *[F.sum(F.get("bits", F.lit(k))).alias(f"b{k}") for k in range(len(trained.langs))])
        sums = sums.select("_row", "has_letter", F.array(*[f"b{k}" for k in range(len(trained.langs))]).alias("bits"))
        measured = rows.select("_row", "_rest").join(sums, "_row")
    least = F.array_min("bits")
    best = F.element_at(F.array(*map(F.lit, trained.langs)), F.array_position("bits", least).cast("int"))
    share = 1.0 / F.aggregate("bits", F.lit(0.0), lambda s, x: s + F.pow(F.lit(2.0), F.greatest(least - x, F.lit(-1000.0))))
    return measured.select(*[F.col(f"_rest.`{c}`") for c in rest], F.when(F.col("has_letter"), best).otherwise("und").alias("lang_pred"), F.when(F.col("has_letter"), share).otherwise(0.0).alias("score"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = train(docs.where(~held_out).select("lang", "text"))
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
