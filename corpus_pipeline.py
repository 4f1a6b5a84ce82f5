"""A corpus pipeline over documents; part of the subpackage quillon.llm.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. All but the last return the
columns of documents. A document is a row's doc_id and text; what a stage rejects is taken out by both, nulls included.
Rows without a doc_id belong to no group of copies, so the third stage keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontamination, ngram_join, quality_classifier, quality_rules, sentencepiece_fst
from quillon.llm.kernels import shared_dir, written

KEY = "_text_key"
WORDS, PERCENT = 5, 80  # of near copies; those of op5 (3, 90) are its own


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn(KEY, F.xxhash64("text"))


def _same(docs: DataFrame, other: DataFrame) -> Column:
    return docs["doc_id"].eqNullSafe(other["_id"]) & (docs[KEY] == other["_key"])


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """docs but for those rejected (doc_id, key of the text)."""
    rejected = rejected.toDF("_id", "_key").distinct()
    docs = _keyed(docs)
    return docs.join(rejected, _same(docs, rejected), "left_anti").drop(KEY)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a posterior below the threshold go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = quality_classifier.classify(_keyed(docs).select("doc_id", KEY, "source", "lang", "text"), labels)
    return _without(docs, judged.where("not kept").select("doc_id", KEY))


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are depleted go; from the others, lines above the limits are removed."""
    judged, removed = quality_rules.judge(docs)
    gone = judged.where("not kept").select("doc_id", "text_key", F.lit(True).alias("_gone"), F.lit(None).cast("int").alias("line"))
    lines = removed.select("doc_id", "text_key", F.lit(False).alias("_gone"), "line")
    # one join for both: a row for each document that is changed
    changes = gone.unionByName(lines).groupBy("doc_id", "text_key").agg(F.max("_gone").alias("_gone"), F.collect_set("line").alias("_lines")).toDF("_id", "_key", "_gone", "_lines")
    keyed = _keyed(docs)
    out = keyed.join(changes, _same(keyed, changes), "left").where("_gone is null or not _gone")
    text = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("_lines", i)), "\n")
    changed = F.col("_lines").isNotNull()
    out = out.withColumn("text", F.when(changed, text).otherwise(F.col("text")))
    return out.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*docs.columns)


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by WORDS-word shingles, PERCENT / 100 alike or more, the one with the smallest id stays, with one
    of its rows; documents without words stay, as do rows without an id."""
    groups = written(ngram_join.join(docs.select("doc_id", "text"), n=WORDS, percent=PERCENT), "groups")
    copies = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_id")).distinct()
    kept = docs.join(copies, docs["doc_id"] == copies["_id"], "left_anti")
    twice = groups.where("doc_id = component_id and n_shingles > 0").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_id"))
    if twice.isEmpty():
        return kept
    again = kept["doc_id"] == twice["_id"]
    return kept.join(twice, again, "left_anti").unionByName(kept.join(twice, again, "left_semi").dropDuplicates(["doc_id"]))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hits = decontamination.decontaminate(_keyed(docs).select("doc_id", "text"), benchmark)
    return _without(docs, hits.where("contaminated").select("doc_id", "text_key"))


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, and round_trip (the ids decode to the text) of each row; a null text has no ids, and repeated rows keep
    one row each."""
    import public_tokenizers

    return sentencepiece_fst.encoded(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", quality_classifier_stage),
    ("quality rules", quality_rules_stage),
    ("n-gram Jaccard join", ngram_join_stage),
    ("benchmark decontamination", decontamination_stage),
    ("SentencePiece encoding and decoding", sentencepiece_stage),
]
#: SQL can't express the classifier, line frequencies by this verdict, or the transducer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_dir(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
