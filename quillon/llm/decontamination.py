"""Benchmark decontamination by winnowing, with DataFrame functions only.

Words are runs of digits, ASCII letters (A-Z lower-cased) and characters beyond ASCII. A window is ``span`` consecutive
words of a benchmark item; an item of fewer words, but not none, is one window. A document's word is hit if it is in an
occurrence of a window. Texts are cut into blocks of ``BLOCK`` words and the ``span`` - 1 words after these, so that each
window is in one block as a whole, and a row has a bounded number of words however long its text is. Winnowing finds the
occurrences, in one scan for items of all lengths:

1. Hash every ``k`` consecutive words; of every ``span - k + 1`` consecutive hashes keep the least, and its last place. A
   shared run of ``span`` words has the same hashes on either side, so one kept place at least is in common. Items of fewer
   than ``span`` words are found by the hash of all their words, in the same way.
2. The benchmark's kept hashes meet those of the documents. While there are at most ``MOST_IN_PLAN`` of them, they are
   put into the plan as a set, which each document's kept hashes are looked up in within the scan; beyond that, kept hashes and
   their places alone are joined by hash, and go back to the blocks that they are of.
3. Each hit is extended: the windows around the place of the hash are compared word by word.

Skew: hits are grouped by block, and then by document, so a passage that is in many documents makes as many small groups.
One block has at most one hit a word and item place.

Defined cases: null and empty texts have no words and are not contaminated; null ids are a document or item of their
own; repeated items count as one if their ids are the same; extra columns are ignored. Rows with the same document id
are separate if the texts differ and are given once each; equal rows give equal results.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

APART = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
MOST_IN_PLAN = 200_000
BLOCK = 4096


def words(text: Column) -> Column:
    """The words of a text; null has none."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.filter(F.split(low, APART), lambda w: w != "")


def let(value: Column, f) -> Column:
    """f(value), with the value computed once; in a lambda, an expression would be computed for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def computed(df: DataFrame, name: str, value: Column, *kept: str) -> DataFrame:
    """df with a column that filters and projections above it don't compute again."""
    return df.select(*kept, F.explode(F.array(value)).alias(name))


def _grams(w: Column, k: int) -> Column:
    """Hashes of every k consecutive words of w, a column."""
    return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))


def _kept(h: Column, m: int) -> Column:
    """Of every m consecutive hashes the least; of all if they are fewer."""

    def halves(of: Column, have: int) -> Column:  # of: the least of every ``have``, and of fewer at the end
        if have == m:
            return F.slice(of, 1, F.greatest(F.size(of) - (m - 1), F.lit(1)))
        step = min(have, m - have)
        return let(F.transform(of, lambda x, i: F.least(x, F.get(of, i + step))), lambda x: halves(x, have + step))

    return F.when(F.size(h) > 0, let(h, lambda x: halves(x, 1))).otherwise(h)


def _context(w: Column, at: Column, before: int, length: int) -> Column:
    """length words of w from at - before on; null beyond its ends."""
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda j: F.when(at - before + j >= 0, F.get(w, F.greatest(at - before + j, F.lit(0)))))


def _blocks(texts: DataFrame, span: int, *ids: str) -> DataFrame:
    """ids, base (number of the first word) and w (words) of each block of texts (ids, w); texts without words give none."""
    cut = F.transform(F.sequence(F.lit(0), F.expr(f"(size(w) - 1) div {BLOCK}")), lambda b: F.struct((b * BLOCK).cast("int").alias("base"), F.slice("w", (b * BLOCK + 1).cast("int"), BLOCK + span - 1).alias("w")))
    return texts.where(F.size("w") > 0).select(*ids, F.explode(cut).alias("_b")).select(*ids, "_b.base", "_b.w")


def _least_windows(kept: Column, known: list[int] | None) -> Column:
    """(number of the window, hash) of the windows whose least hash is known."""
    every = F.transform(kept, lambda h, i: F.struct(i.alias("i"), h.alias("h")))
    return every if known is None else F.filter(every, lambda x: x["h"].isin(known))


def _spots(windows: Column, g: Column, m: int) -> Column:
    """(place, hash) of the last least hash of each window, once."""

    def spot(x: Column) -> Column:
        part = F.slice(g, x["i"] + 1, m)
        return F.struct((x["i"] + F.size(part) - F.array_position(F.reverse(part), x["h"]).cast("int")).alias("at"), x["h"].alias("h"))

    return F.array_distinct(F.transform(windows, spot))


def _of_kind(kind: int):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x["at"].alias("at"), x["h"].alias("h"))


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = 13, k: int = 5) -> DataFrame:
    """A row for each document with a hit: doc_id, text_key, hits (sorted places of its hit words), items (item ids with occurring windows, as sorted strings)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).withColumn("m", F.size("w")).where("m > 0")
    lengths = sorted(r.m for r in items.where(F.col("m") < span).select("m").distinct().collect())  # span - 1 at most
    # kind: words of a window; of each, words a hash, hashes a window, words before a place, words around it
    kinds = {span: (k, span - k + 1, span - k, 2 * span - k), **{n: (n, 1, 0, n) for n in lengths}}
    around = lambda x, n: F.struct(F.lit(n).alias("kind"), x["h"].alias("h"), x["at"].alias("at"), _context(F.col("w"), x["at"], *kinds[n][2:]).alias("words"))

    marks = None
    for n, (size, m, _, _) in kinds.items():
        of = computed(_blocks(items.where(F.col("m") >= span if n == span else F.col("m") == n), span, "item_id"), "g", _grams(F.col("w"), size), "item_id", "w")
        spots = _spots(_least_windows(_kept(F.col("g"), m), None), F.col("g"), m)
        found = of.select("item_id", "w", F.explode(spots).alias("x")).select("item_id", around(F.col("x"), n).alias("x")).select("item_id", "x.kind", "x.h", F.col("x.words").alias("theirs"))
        marks = found if marks is None else marks.unionByName(found)
    marks = marks.distinct()
    hashes = marks.select("kind", "h").distinct().limit(MOST_IN_PLAN + 1).collect()
    in_plan = len(hashes) <= MOST_IN_PLAN
    ids = ("doc_id", "text_key")
    d = computed(docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text"), "w", words(F.col("text")), *ids)
    d = _blocks(d, span, *ids)
    used = [n for n in kinds if not in_plan or any(r.kind == n for r in hashes)]
    if not used:
        return docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.array().cast("array<int>").alias("hits"), F.array().cast("array<string>").alias("items")).limit(0)
    kept_columns = [*ids, "base", "w"]
    for n in used:
        size, m, _, _ = kinds[n]
        d = computed(d, f"g{n}", _grams(F.col("w"), size), *kept_columns)
        d = computed(d, f"x{n}", _least_windows(_kept(F.col(f"g{n}"), m), [r.h for r in hashes if r.kind == n] if in_plan else None), *kept_columns, f"g{n}")
        if m == 1:
            d = d.drop(f"g{n}").withColumnRenamed(f"x{n}", f"s{n}")
            d = d.withColumn(f"s{n}", F.transform(f"s{n}", lambda x: F.struct(x["i"].alias("at"), x["h"].alias("h"))))
        else:
            if in_plan and len(used) == 1:
                d = d.where(F.size(f"x{n}") > 0)
            d = computed(d, f"s{n}", _spots(F.col(f"x{n}"), F.col(f"g{n}"), m), *kept_columns)
        kept_columns.append(f"s{n}")
    every = F.flatten(F.array(*[F.transform(f"s{n}", _of_kind(n)) for n in used]))
    if not in_plan:
        # hashes and places alone meet the marks; the places found go back to their blocks
        found = d.select(*ids, "base", F.explode(every).alias("x")).select(*ids, "base", "x.*").join(marks.select("kind", "h").distinct(), ["kind", "h"], "left_semi")
        found = found.groupBy(*ids, "base").agg(*[F.collect_set(F.when(F.col("kind") == n, F.struct("at", "h"))).alias(f"s{n}") for n in used])
        found = found.toDF("_id", "_key", "_base", *[f"s{n}" for n in used])
        d = d.select(*ids, "base", "w").join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")) & (F.col("base") == F.col("_base")))
    d = d.select(*ids, "base", "w", every.alias("every")).where(F.size("every") > 0)
    # the words around a place are cut before its row is made, so that no row carries the block
    ours = lambda x: reduce(lambda out, n: F.when(x["kind"] == n, around(x, n)).otherwise(out), used, F.lit(None))
    d = d.select(*ids, "base", F.explode(F.transform("every", ours)).alias("x")).select(*ids, "base", "x.kind", "x.h", "x.at", F.col("x.words").alias("ours"))
    pairs = d.distinct().join(marks, ["kind", "h"])
    # windows that begin at each place of the context and are the same on either side
    same = F.transform(F.arrays_zip("ours", "theirs"), lambda z: F.coalesce(z["ours"] == z["theirs"], F.lit(False)))
    pairs = pairs.select(*ids, "base", "kind", "at", "item_id", same.alias("same"))
    starts = F.filter(F.sequence(F.lit(0), F.size("same") - F.col("kind")), lambda o: F.forall(F.slice("same", o + 1, F.col("kind")), lambda x: x))
    before = reduce(lambda out, n: F.when(F.col("kind") == n, F.lit(kinds[n][2])).otherwise(out), used, F.lit(0))
    pairs = pairs.select(*ids, "base", "kind", "item_id", F.transform(starts, lambda o: F.col("at") - before + o).alias("starts")).where(F.size("starts") > 0)
    rows = pairs.select(*ids, "base", "item_id", F.explode("starts").alias("start"), F.col("kind").alias("length"))
    covered = F.array_distinct(F.flatten(F.transform(F.collect_set(F.struct("start", "length")), lambda s: F.sequence(F.col("base") + s["start"], F.col("base") + s["start"] + s["length"] - 1))))
    by_block = rows.groupBy(*ids, "base").agg(covered.alias("hits"), F.collect_set("item_id").alias("items"))
    once = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    return by_block.groupBy(*ids).agg(once("hits").alias("hits"), once("items").alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, span: int = 13, k: int = 5, share: int = 20) -> DataFrame:
    """Every document's text_key, n_words, n_hit, items, and contaminated: at least one word in ``share`` is hit."""
    hit = contamination(docs, benchmark, span, k)
    base = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    same = base["doc_id"].eqNullSafe(hit["doc_id"]) & (base["text_key"] == hit["text_key"])
    out = base.join(hit, same, "left").select(base["doc_id"], base["text_key"], "n_words", F.coalesce(F.size("hits"), F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    out = decontaminate(docs.select("doc_id", "text"), benchmark)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")
