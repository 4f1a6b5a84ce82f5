"""Quality classifier with hierarchical empirical Bayes over sites.

1. Evidence. Figures of a text's shape (symbols, repeats, capitals, ...), and what its words and pairs of words say, go into
   a logistic regression, which is fitted on labelled documents: at most ``MOST_LABELLED`` of them, those whose ids hash
   lowest. Words and pairs are hashed to ``BUCKETS`` each; a bucket's weight is the logarithm of how much more often good
   documents have it than bad ones, and a text's figure is the mean of its buckets' weights. For the fit, each labelled
   document's weights come from the labelled documents of the other ``FOLDS`` - 1 folds. The probability that a document is
   good is its evidence.
2. Sites. Evidence is summed by host and by (host, path), over all documents. The global mean is the prior of a host's
   mean, and a host's posterior mean that of its paths'. How strongly a prior counts (as so many documents) is estimated
   by the method of moments from the variance between hosts, and between the paths of a host, beyond what sampling gives.
   A site with few documents so stays near the mean above it. A document's own evidence is taken out of its sites' sums.
3. Posterior. The log-odds of the document's evidence are moved by those of its path's posterior against the global mean.
   A document is kept if its posterior is at least ``KEEP``.

Sums by host and path are combined before the shuffle and go back to the documents by a join that adaptive execution
can split; a row has only a few numbers there. Two rows of moments come to the driver.

Defined cases: a null or empty text has the figures of no words; null hosts and paths are sites of their own; labels that
disagree on a document count by the smallest; without labels of both kinds every document's evidence is 0.5 and all are
kept; rows with the same document id are judged each, and all have its label; equal rows count once in the fit; extra columns
pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import kernels as K
from quillon.llm.quality_rules import SYMBOLS, base_figures

U = np.uint64
MOST_LABELLED = 20_000
KEEP = 0.3
BUCKETS, FOLDS, SMOOTH = 1 << 15, 5, 2.0
FIGURES = ["symbols", "repeated", "same_as_last", "capitals", "marks", "digits", "bars", "same_lines", "word_length", "words"]
_CAPITAL, _DIGIT, _MARK = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_CAPITAL[65:91] = True
_DIGIT[48:58] = True
_MARK[[33, 63]] = True


def figures(texts: pa.Array) -> np.ndarray:
    """A row of FIGURES for each text, in shares, and logarithms of word length and number of words."""
    base = base_figures(texts)
    rows = []
    for i, j, data, offs in K.chunks(texts):
        s = K.words(data, offs)
        h = K.hashes(data, s)
        again = np.zeros(len(h), np.int64)
        again[1:] = (h[1:] == h[:-1]) & (s.text[1:] == s.text[:-1])
        of_text = lambda flags: np.diff(np.append(0, np.cumsum(flags))[offs])  # noqa: B023, E731
        n, chars = np.maximum(s.n, 1), np.maximum(base["word_chars"][i:j], 1)
        lines = np.maximum(np.diff(np.searchsorted(base["row"], np.arange(i, j + 1))), 1)
        rows.append(np.column_stack([of_text(SYMBOLS[data]) / chars, base["n_repeat_words"][i:j] / n, K.summed(again, s) / n, of_text(_CAPITAL[data]) / chars, of_text(_MARK[data]) / n, of_text(_DIGIT[data]) / chars, of_text(data == 124) / n, base["n_dup_lines"][i:j] / lines, np.log(chars / n), np.log1p(s.n)]))
    return np.concatenate(rows) if rows else np.zeros((0, len(FIGURES)))


def buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of each text, and the text of each: those of words, and (from BUCKETS on) of pairs of words."""
    out, rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, _, data, offs in K.chunks(texts):
        low = K.LOWER[data]
        s = K.words(low, offs)
        h = K.hashes(low, s)
        two, text, _ = K.shingles(h, s, 2)
        cut = lambda x: (K.mix(x) & U(BUCKETS - 1)).astype(np.int64)
        every = np.unique(np.concatenate([s.text * (2 * BUCKETS) + cut(h), text * (2 * BUCKETS) + BUCKETS + cut(two)]))
        out.append(every % (2 * BUCKETS))
        rows.append(every // (2 * BUCKETS) + i)
    return np.concatenate(out), np.concatenate(rows)


def leanings(bucket: np.ndarray, row: np.ndarray, n: int, value: np.ndarray) -> np.ndarray:
    """Of n texts, the means of their buckets' weights (value): of words, and of pairs."""
    out = np.zeros((n, 2))
    for k, part in enumerate((bucket < BUCKETS, bucket >= BUCKETS)):
        out[:, k] = np.bincount(row[part], value[part], n) / np.maximum(np.bincount(row[part], minlength=n), 1)
    return out


def weights_of(counts: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The buckets' weights, from the documents that have each (a row for bad ones, one for good ones), of so many."""
    share = (counts + SMOOTH) / (docs[:, None] + 2 * SMOOTH)
    return np.log(share[1] / share[0]).astype(np.float32)


def fit(x: np.ndarray, good: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression, by Newton's method on standardised figures."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    w[-1] = np.log((good.sum() + 1) / (len(good) - good.sum() + 1))
    penalty = np.diag([ridge] * len(mean) + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (good - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1] / scale, float(w[-1] - (w[:-1] * mean / scale).sum())


def logit(p):
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.ln(p / (1 - p))


def _fitted(docs: DataFrame, label: DataFrame) -> tuple[np.ndarray, float, np.ndarray] | None:
    """Weights of the figures, intercept, and weights of the buckets, from docs (doc_id, _text) that have a label (doc_id, _good).

    The driver gets a count for each fold, kind and bucket, and a row of figures for each of MOST_LABELLED documents at most;
    the names of these are broadcast."""
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.xxhash64("_text")]
    some = docs.join(label, "doc_id").select(F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("_fold"), F.col("_good").cast("int").alias("_good"), *[x.alias(f"_o{i}") for i, x in enumerate(order)])
    some = some.distinct().orderBy("_o0", "_o1", "_o2").limit(MOST_LABELLED)
    chosen = K.written(some.select("_fold", "_good", F.col("_o1").alias("doc_id"), F.col("_o2").alias("_key")), "labelled")
    texts = docs.withColumn("_key", F.xxhash64("_text")).join(F.broadcast(chosen), ["doc_id", "_key"]).groupBy("doc_id", "_key", "_fold", "_good").agg(F.min("_text").alias("_text"))
    shape = "_fold int, _good int, _figures array<double>, _buckets array<int>"

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = figures(b.column(2))
            bucket, row = buckets(b.column(2))
            ends = np.arange(len(b) + 1, dtype=np.int32) * x.shape[1]
            at = np.searchsorted(row, np.arange(len(b) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel())), pa.ListArray.from_arrays(pa.array(at), pa.array(bucket.astype(np.int32)))], ["_fold", "_good", "_figures", "_buckets"])

    measured = K.written(texts.select("_fold", "_good", "_text").mapInArrow(K.lean(measure), shape), "labelled-figures")
    got = measured.select("_fold", "_good", F.explode("_buckets").alias("b")).groupBy("_fold", "_good", "b").agg(F.count(F.lit(1)).alias("n")).toArrow()
    fold, good, bucket, n = (got.column(i).to_numpy() for i in range(4))
    counts = np.zeros((FOLDS, 2, 2 * BUCKETS))
    counts[fold, np.minimum(good, 1), bucket] = n
    docs_of = np.zeros((FOLDS, 2))
    for r in measured.groupBy("_fold", "_good").count().collect():
        docs_of[r["_fold"], min(r["_good"], 1)] += r["count"]
    by_fold = np.stack([weights_of(counts.sum(0) - c, docs_of.sum(0) - d) for c, d in zip(counts, docs_of, strict=True)])
    shared = docs.sparkSession.sparkContext.broadcast(by_fold)

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_fold = shared.value
        for b in batches:
            lists = b.column(3)
            offs = lists.offsets.to_numpy()
            row = np.repeat(np.arange(len(b)), np.diff(offs))
            bucket = lists.values.to_numpy()[offs[0] : offs[-1]]
            x = leanings(bucket, row, len(b), by_fold[b.column(0).to_numpy()[row], bucket])
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(x[:, 0]), pa.array(x[:, 1])], ["_good", "_figures", "words", "pairs"])

    known = measured.mapInArrow(K.lean(lean), "_good int, _figures array<double>, words double, pairs double").toArrow()
    good = known.column(0).to_numpy().astype(float) if len(known) else np.zeros(0)
    if not 0 < good.sum() < len(good):
        return None
    shapes = known.column(1).combine_chunks().flatten().to_numpy().reshape(len(good), len(FIGURES))
    w, bias = fit(np.column_stack([shapes, known.column(2).to_numpy(), known.column(3).to_numpy()]), good)
    return w, bias, weights_of(counts.sum(0), docs_of.sum(0))


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", text: str = "text") -> DataFrame:
    """docs without the text, with evidence, prior (the path's posterior), posterior and kept. labels: doc_id, quality (0 or 1)."""
    spark = docs.sparkSession
    K.bounded_batches(spark)
    new = ["evidence", "prior", "posterior", "kept"]
    rest = [c for c in docs.columns if c != text and c not in new]
    rows = docs.select(*[F.col(f"`{c}`") for c in rest], F.xxhash64(F.col(host).cast("string")).alias("_host"), F.xxhash64(F.col(host).cast("string"), F.col(path).cast("string")).alias("_path"), F.col(text).cast("string").alias("_text"))
    label = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("_good"))
    model = _fitted(docs.select("doc_id", F.col(text).cast("string").alias("_text")), label)
    shape = rows.drop("_text").schema.add("evidence", "double")
    shared = spark.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            texts = b.column(len(rest) + 2)
            if model is None:
                p = np.full(len(b), 0.5)
            else:
                w, bias, weights = model
                bucket, row = buckets(texts)
                x = np.column_stack([figures(texts), leanings(bucket, row, len(b), weights[bucket])])
                p = 1 / (1 + np.exp(-np.clip(x @ w + bias, -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(p)], shape.names)

    one = K.written(rows.mapInArrow(K.lean(measure), shape), "evidence")

    paths = K.written(one.groupBy("_host", "_path").agg(F.count(F.lit(1)).alias("_n"), F.sum("evidence").alias("_s")), "paths")
    hosts = paths.groupBy("_host").agg(F.sum("_n").alias("_hn"), F.sum("_s").alias("_hs"))
    mean, strength = _moments(hosts.select(F.col("_hn").alias("n"), F.col("_hs").alias("s")))
    _, strength_path = _moments(paths.select(F.col("_host").alias("group"), F.col("_n").alias("n"), F.col("_s").alias("s")))
    sites = paths.join(hosts, "_host").select("_path", "_n", "_s", "_hn", "_hs")
    own = F.col("evidence")
    of_host = (strength * mean + F.col("_hs") - own) / (strength + F.col("_hn") - 1)
    of_path = (strength_path * of_host + F.col("_s") - own) / (strength_path + F.col("_n") - 1)
    moved = logit(own) + logit(F.col("prior")) - logit(F.lit(mean))
    out = one.join(sites, "_path").withColumn("prior", of_path).withColumn("posterior", 1 / (1 + F.exp(-moved)))
    return out.select(*[F.col(f"`{c}`") for c in rest], "evidence", "prior", "posterior", (F.col("posterior") >= KEEP).alias("kept"))


def _moments(sites: DataFrame) -> tuple[float, float]:
    """Global mean, and the strength of the prior in documents, of sites (n, s, and group, unless they are all of one) within their groups."""
    if "group" in sites.columns:
        total = sites.groupBy("group").agg(F.sum("n").alias("gn"), F.sum("s").alias("gs"))
        sites = sites.join(total, "group")
    else:
        whole = sites.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
        sites = sites.select("n", "s", F.lit(0).alias("group"), F.lit(whole.n).alias("gn"), F.lit(whole.s).alias("gs"))
    m = F.col("gs") / F.col("gn")
    r = sites.agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.count(F.lit(1)).alias("k"), F.countDistinct("group").alias("g"),
        F.sum(F.col("n") * (F.col("s") / F.col("n") - m) ** 2).alias("between"), F.sum(F.col("n") * m * (1 - m)).alias("within"), F.sum(F.col("n") ** 2 / F.col("gn")).alias("n2"),
    ).first()
    if not r.n:
        return 0.5, 1.0
    mean, sampling = r.s / r.n, r.within / r.n
    variance = (r.between - (r.k - r.g) * sampling) / max(r.n - r.n2, 1.0)
    return float(mean), float(min(max(sampling / max(variance, 1e-9) - 1, 1.0), 1e4))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return classify(docs.select("doc_id", "source", "lang", "text"), labels).drop("source", "lang")
