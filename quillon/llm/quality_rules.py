"""Quality rules with the frequency of lines across the documents of a host.

Base rules, from the text alone: fewer than ``MIN_WORDS`` words, or more than half of the words in 3-word windows that
are found twice or more in the text.

Line frequency. A line is normalised to its words, with A-Z lower-cased, and hashed. For each host, the distinct
documents with the line are counted, in two ways:

1. ``df``: documents with the line. Lines with ``df`` above the limit, ``MIN_DOCS``, are candidates. It doesn't grow with
   the host, so a line that many documents share is found in a host of any size.
2. ``apart``: distinct rests of the documents with the line, a rest being all lines that aren't candidates. Only a
   candidate with as many of these as the limit is removed: a line that recurs beside texts that differ, however much of
   them it holds. Lines that recur only since whole documents have copies aren't; to choose one of those is the task of
   deduplication. Documents with the same candidates and at most one word beside ``COPY`` of these are near copies whatever
   that rest is (by words 0.8 alike or more), so they count as one.

A document is depleted, and rejected, if removed lines hold more than ``MAX_REMOVED`` of its words and fewer than
``MIN_WORDS`` words are left. All counts cover all documents.

Skew: a line counts once a document, and counts are summed before the shuffle. The counts go back to the lines by a join
on (host, line) that adaptive execution can split, with lines dealt by a salt besides.

Defined cases: a null or empty text has no words and fails the base rules; a null host is a host of its own; documents
are told apart by ``doc_id`` and text, so rows that are equal count once; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import kernels as K

MIN_WORDS, MIN_DOCS, MAX_REMOVED = 50, 20, 0.5
COPY = 8  # h words the same beside r others on either side: h / (h + 2 r) >= 0.8
LOW_BITS = (1 << 32) - 1  # sums of as many bits can't overflow in a text
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
FEED = np.zeros(256, bool)
FEED[10] = True
U = np.uint64
BASE_COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def _lines(data: np.ndarray, offs: np.ndarray, w: K.Spans, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each line with a word: its text, number in the text (from 0, lines without a word included), hash of its words (h), words."""
    feeds = np.cumsum(FEED[data])
    line = feeds[w.start] + w.text  # a text's end ends a line too
    first = np.flatnonzero(np.diff(line, prepend=-1))
    n = np.diff(np.append(first, len(line)))
    place = (np.arange(len(line)) - np.repeat(first, n)).astype(U)
    hashed = K.mix(np.add.reduceat(K.mix(h + place * U(0x9E3779B97F4A7C15)), first)) if len(first) else np.zeros(0, U)
    text = w.text[first]
    begin = offs[text]
    before = np.where(begin > 0, feeds[np.maximum(begin - 1, 0)], 0) if len(feeds) else begin
    return text, line[first] - text - before, hashed, n


def _raw_line_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lines with a word, byte by byte, and the text of each."""
    s = K.words(data, offs, FEED)  # runs without line feeds: lines that aren't empty
    if not len(s.start):
        return np.zeros(0, U), s.text
    has = np.cumsum(np.append(0, ~K.SPACE[data]))
    ok = has[s.end] > has[s.start]
    return K.hashes(data, s)[ok], s.text[ok]


def _again(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are found twice or more, and which are equal to an earlier one."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = k[1:] == k[:-1]
    many, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    many[order[1:]] |= same
    many[order[:-1]] |= same
    return many, later


def base_figures(texts: pa.Array) -> dict[str, np.ndarray]:
    """Base columns of each text, and of each line with a word: row, line, hash, words."""
    out: dict[str, list] = {c: [] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "row", "line", "hash", "words")}
    for i, j, data, offs in K.chunks(texts):
        w = K.words(data, offs)
        out["n_words"].append(w.n)
        of_text = lambda flags: np.diff(np.append(0, np.cumsum(flags))[offs])  # noqa: B023, E731
        out["word_chars"].append(of_text(((data & 0xC0) != 0x80) & ~K.SPACE[data]))
        out["n_symbols"].append(of_text(SYMBOLS[data]))
        salt = K.mix(np.arange(1, j - i + 1).astype(U))
        h, text = _raw_line_hashes(data, offs)
        _, later = _again(h ^ salt[text])
        out["n_dup_lines"].append(np.bincount(text[later], minlength=j - i))
        h, text, at = K.shingles(K.hashes(data, w), w, 3)
        many, _ = _again(h ^ salt[text])
        inside = np.zeros(len(w.start) + 3, bool)
        for k in range(3):
            inside[at[many] + k] = True
        out["n_repeat_words"].append(K.summed(inside[: len(w.start)].astype(np.int64), w))
        text, line, h, n = _lines(data, offs, w, K.hashes(K.LOWER[data], w))
        for c, x in (("row", text + i), ("line", line), ("hash", h.view(np.int64)), ("words", n)):
            out[c].append(x)
    return {c: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for c, x in out.items()}


def figures(docs: DataFrame, host: str = "source") -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, host and the base columns of each document; the same ids and host with n_words, content (sum of the lines' hashes), line, hash and words of each line)."""
    K.bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), F.xxhash64(F.col(host).cast("string")).alias("host"), F.col("text").cast("string"))

    def base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = base_figures(b.column(3))
            failed = (x["n_words"] < MIN_WORDS) | (100 * x["n_repeat_words"] > 50 * x["n_words"])
            at = np.searchsorted(x["row"], np.arange(len(b) + 1))
            lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x[c].astype(t))) for c, t in (("line", np.int32), ("hash", np.int64), ("words", np.int32))]
            content = np.diff(np.append(0, np.cumsum(x["hash"] & LOW_BITS))[at])
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *[pa.array(x[c]) for c in BASE_COLUMNS[:-1]], pa.array(failed), pa.array(content), *lists], ["doc_id", "text_key", "host", *BASE_COLUMNS, "content", "line", "hash", "words"])

    shape = "doc_id long, text_key long, host long, " + ", ".join(f"{c} long" for c in BASE_COLUMNS[:-1]) + ", base_failed boolean, content long, line array<int>, hash array<long>, words array<int>"
    both = K.written(rows.mapInArrow(K.lean(base), shape), "lines")
    lines = both.select("doc_id", "text_key", "host", "n_words", "content", F.explode(F.arrays_zip("line", "hash", "words")).alias("x")).select("doc_id", "text_key", "host", "n_words", "content", "x.*")
    return both.drop("content", "line", "hash", "words"), lines


def removed_lines(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, text_key, line and words of the lines to remove."""
    ids = ["doc_id", "text_key"]
    once = lines.select("host", "hash", *ids).distinct()
    df = once.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("df"))
    candidates = K.written(df.where(F.col("df") > min_docs).select("host", "hash"), "candidates")
    marked = K.written(lines.join(candidates, ["host", "hash"]), "marked")
    by_doc = marked.distinct().groupBy("host", *ids, "n_words", "content")
    by_doc = by_doc.agg(F.sum("words").alias("held"), F.sum(F.col("hash").bitwiseAND(LOW_BITS)).alias("taken"), F.collect_set("hash").alias("hash"))
    rest = F.col("n_words") - F.col("held")
    copied = F.col("held") >= COPY * rest
    other = F.struct(copied.alias("copied"), F.when(copied, F.col("taken")).otherwise(F.col("content") - F.col("taken")).alias("text"))
    apart = by_doc.select("host", F.explode("hash").alias("hash"), other.alias("other")).distinct().groupBy("host", "hash").agg(F.count(F.lit(1)).alias("apart"))
    bad = apart.where(F.col("apart") >= min_docs).select("host", "hash")
    return marked.join(bad, ["host", "hash"]).select(*ids, "line", "words")


def judge(docs: DataFrame, host: str = "source") -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, base columns, n_removed_words and kept of each row; doc_id, text_key, line, words of the lines to remove)."""
    base, lines = figures(docs, host)
    removed = K.written(removed_lines(lines), "removed")
    gone = removed.groupBy("doc_id", "text_key", "line").agg(F.max("words").alias("words")).groupBy("doc_id", "text_key").agg(F.sum("words").alias("n_removed_words"))
    same = base["doc_id"].eqNullSafe(gone["doc_id"]) & (base["text_key"] == gone["text_key"])
    out = base.join(gone, same, "left").select(base["doc_id"], base["text_key"], *BASE_COLUMNS, F.coalesce("n_removed_words", F.lit(0)).alias("n_removed_words"))
    depleted = (F.col("n_removed_words") > MAX_REMOVED * F.col("n_words")) & (F.col("n_words") - F.col("n_removed_words") < MIN_WORDS)
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted), removed


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return judge(docs)[0].drop("text_key")
