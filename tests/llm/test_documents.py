import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import components, decontamination, kernels, language_id, ngram_join, quality_classifier, quality_rules
from tests.llm import brute

WORDS = ["the", "and", "over", "Haus", "größe", "blue", "x", "42", "on-line", "ñandú", "tree", "seven"]


def text(rng, n):
    return " ".join(rng.choice(WORDS) + (rng.choice(["", "", ",", ".\n"])) for _ in range(n))


def near(rng, base, edits):
    w = base.split(" ")
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("most", [200_000, 3])
def test_decontamination_equals_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(decontamination, "MOST_IN_PLAN", most)  # beyond it, fingerprints are joined
    rng = random.Random(1)
    unique = lambda n: " ".join(f"w{rng.randrange(40)}" for _ in range(n))
    items = [(1, unique(30)), (2, unique(13)), (3, unique(12)), (4, "Solo"), (5, None), (6, ""), (7, unique(60)), (7, unique(20)), (None, unique(15)), (8, "aa aa aa aa aa aa aa aa aa aa aa aa aa aa aa aa")]
    docs = [None, "", "solo", "SOLO! solo", unique(300), "aa " * 40]
    for _, t in items:
        if t:
            w = t.split()
            docs += [t, f"{unique(20)} {t} {unique(30)}", " ".join(w[:-1]), "; ".join(w).upper(), f"{unique(5)} {' '.join(w[1:14])}\n{unique(200)}"]
    rows = [(i, t, "clash") for i, t in enumerate(docs)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, w string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in decontamination.decontaminate(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute.contamination(docs, [(i, t) for i, t in items if i is not None] + [("", None)])
    for i, (n, hit, ids) in enumerate(want):
        if any(t and i is None for i, t in items):
            extra = brute.contamination([docs[i]], items)[0]
            n, hit = extra[0], extra[1]
        assert got[i][:2] == (n, hit) and got[i][3] == (hit > 0 and 20 * hit >= n)
        assert [x for x in got[i][2] if x is not None] == ids
    assert decontamination.decontaminate(frame.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_decontamination_of_very_long_texts_in_blocks(spark):
    rng = random.Random(31)
    word = lambda n: [f"w{rng.randrange(10**5)}" for _ in range(n)]
    whole = word(150_000)
    passage = whole[4090:4110]  # over the edge of a block
    items = [(1, " ".join(whole)), (2, " ".join(passage)), (3, "w1")]
    docs = [(1, " ".join(whole)), (2, " ".join([*word(5000), *passage[:12], *word(5000)])), (3, " ".join([*word(4080), *passage[2:], *word(9)])), (4, " ".join(["w1x"] * 300_000)), (5, "aa " * 40_000)]
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontamination.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute.contamination([t for _, t in docs], items)
    assert got == {i: x for (i, _), x in zip(docs, want, strict=True)}


def test_ngram_join_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 7)  # keys of several blocks
    monkeypatch.setattr(ngram_join, "BUFFER", 3000)
    monkeypatch.setattr(ngram_join, "FRAGMENT", 500)
    rng = random.Random(2)
    docs = [None, "", " \n", "one", "ONE", "two words", "two  words", "a b c", "x y z"]
    for n in (12, 20, 30, 60, 150, 400, 2500):
        base = text(rng, n)
        docs += [base, base.upper() if base.isascii() else base, *(near(rng, base, e) for e in (0, 1, 1, 1, 2, 2, 3, 5, max(1, n // 60), max(1, n // 40)))]
    docs += [near(rng, docs[40], 1) for _ in range(30)]
    rows = [(i * 3, t, 1) for i, t in enumerate(docs)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_shingles int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(frame).collect()}
    assert got == brute.linked([(i, t) for i, t, _ in rows])
    assert ngram_join.join(frame.limit(0)).count() == 0


@pytest.mark.parametrize("percent", [90, 80, 50])
def test_ngram_join_prefixes_of_linked_sets_meet(percent):
    rng, lengths = np.random.default_rng(3), ngram_join.Lengths(percent)
    for size in [1, 2, 3, 5, 9, 10, 11, 19, 28, 40, 100, 333, 1000]:
        for _ in range(40):
            gone = int(rng.integers(0, size - lengths.o(size) + 1))
            a = rng.integers(0, 1 << 63, size, dtype=np.uint64)
            b = np.concatenate([a[gone:], rng.integers(0, 1 << 63, int(rng.integers(0, size - lengths.o(size) - gone + 1)), dtype=np.uint64)])
            both = len(np.intersect1d(a, b))
            if 100 * both < percent * (len(a) + len(b) - both):
                continue
            first = [x[ngram_join.ranks(x, np.array([len(x)])) < lengths.first(len(x))] for x in (a, b)]
            assert len(np.intersect1d(*first)) >= max(lengths.shared(len(a)), lengths.shared(len(b)))
            heads = [x[ngram_join.ranks(x, np.array([len(x)])) < lengths.head(len(x))] for x in (a, b)]
            rare = {int(x): int(v) for x, v in zip(np.union1d(a, b), rng.integers(2, 9, len(np.union1d(a, b))))}  # noqa: B905
            kept = [sorted(h.tolist(), key=lambda x: (rare[x], x))[: len(h) - (1 + 2 * lengths.o(len(x)) // 5) + 1] for h, x in zip(heads, (a, b), strict=True)]
            assert set(kept[0]) & set(kept[1])


def test_ngram_join_of_a_group_of_near_copies_that_are_not_all_linked(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    rng = random.Random(21)
    base = " ".join(f"v{rng.randrange(10**6)}" for _ in range(90))
    docs = [near(rng, base, rng.randrange(6)) for _ in range(120)] + [base] * 30
    rows = [(i, t) for i, t in enumerate(docs)] + [(7, docs[7]), (7, docs[7].upper()), (8, "another text of eight"), (500, "another text of eight")]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute.linked(list(enumerate(docs)))
    eight = min(want[8][1], 500)
    assert {x for x in got if x[0] not in (8, 500)} == {(i, *x) for i, x in want.items() if i != 8}
    assert {x for x in got if x[0] in (8, 500)} == {(8, want[8][0], eight), (8, 2, eight), (500, 2, eight)}


def test_ngram_join_stage_drops_copies_by_five_words_at_80_percent(spark):
    import corpus_pipeline

    rng = random.Random(12)
    docs = ["one", "ONE", "a b c d", "a b c d"]
    for n in (30, 100, 300):
        base = text(rng, n)
        docs += [base, *(near(rng, base, e) for e in (1, 1, 2, 3, 5, 8)), *(f"{base} {text(rng, n * share // 100)}" for share in (5, 12, 20, 30))]
    rows = [(i * 3, t) for i, t in enumerate(docs)]
    want, strict = ({i for i, (_, c) in brute.linked(rows, *setting).items() if i == c} for setting in ((5, 80), (3, 90)))
    got = corpus_pipeline.ngram_join_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert {r.doc_id for r in got.collect()} == want and want < strict


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **{x: 100 for x in [100, *range(200, 250)]}}


def test_base_figures_equal_brute_force(spark):
    rng = random.Random(5)
    docs = [None, "", "\n \n", "a b a b a b", "x\n\nx\n x\nx", "#|<> *a", *(text(rng, n) for n in (3, 49, 50, 120, 500)), "same line here\n" * 30]
    frame = spark.createDataFrame([(i, t, None if i == 3 else "h", True) for i, t in enumerate(docs)], "doc_id long, text string, source string, kept boolean")
    for r in quality_rules.judge(frame)[0].collect():
        assert tuple(r[c] for c in quality_rules.BASE_COLUMNS) == brute.base(docs[r.doc_id])
    assert quality_rules.judge(frame.limit(0))[0].count() == 0


def test_frequent_lines_are_removed_but_copies_are_kept(spark):
    rng = random.Random(6)
    word = lambda n: " ".join(f"t{rng.randrange(10**6)}" for _ in range(n))
    notice = word(60)
    rows = [(i, f"{word(80)}\n{notice.upper()}" if i < 60 else f"{notice}\n{word(10)}" if i < 65 else None, "a") for i in range(65)]
    copied = "\n".join(word(30) for _ in range(4))
    rows += [(100 + i, f"{copied}\n{word(3)}", "a") for i in range(80)]
    judged, removed = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    kept = {r.doc_id: r.kept for r in judged.collect()}
    assert all(kept[i] for i in range(60)) and not any(kept[i] for i in range(60, 65)) and all(kept[i] for i in range(100, 180))
    assert {(r.doc_id, r.line) for r in removed.collect()} == {(i, 1) for i in range(60)} | {(i, 0) for i in range(60, 65)}


def test_frequent_lines_that_hold_most_of_their_documents_are_removed(spark):
    rng = random.Random(13)
    word = lambda n: " ".join(f"t{rng.randrange(10**6)}" for _ in range(n))
    notice = word(60)
    rows = [(i, f"{notice}\n{word(40)}", "a") for i in range(200)]
    copied = "\n".join([word(60), word(40)])
    rows += [(1000 + i, copied, "b") for i in range(100)]  # exact copies have one rest
    judged, removed = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert {r.doc_id: (r.kept, r.n_removed_words) for r in judged.collect()} == {**dict.fromkeys(range(200), (False, 60)), **dict.fromkeys(range(1000, 1100), (True, 0))}
    assert {(r.doc_id, r.line) for r in removed.collect()} == {(i, 0) for i in range(200)}


def test_the_limit_of_frequent_lines_does_not_grow_with_the_host(spark):
    rng = random.Random(14)
    word = lambda n: " ".join(f"t{rng.randrange(10**6)}" for _ in range(n))
    notice, rare = word(20), word(20)
    rows = [(i, f"{word(60)}\n{notice if i < 30 else rare if i < 45 else word(1)}", "a") for i in range(2000)]
    judged, removed = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert {(r.doc_id, r.line) for r in removed.collect()} == {(i, 1) for i in range(30)} and judged.where("not kept").count() == 0


def test_language_identification(spark, monkeypatch):
    rng = random.Random(7)
    langs = {"en": "the and with house river green".split(), "de": "der und mit haus fluß grün".split(), "es": "el y con casa río verde".split()}
    make = lambda x, n: " ".join(rng.choice(langs[x]) for _ in range(n))
    docs = spark.createDataFrame([(i, make(x, 40), x) for i in range(20) for x in langs] + [(1, None, "en"), (2, "x", None)], "doc_id long, text string, lang string")
    model = language_id.train(docs)
    assert model.shards == 1
    tests = [(x, make(x, 12)) for x in langs for _ in range(10)] + [("und", None), ("und", ""), ("und", "12 !? 😀"), ("und", "…")]
    frame = spark.createDataFrame([(i, t, "clash") for i, (_, t) in enumerate(tests)], "id int, text string, score string")
    got = language_id.predict(frame, model).collect()
    monkeypatch.setattr(language_id, "MOST_CELLS", 300)
    sharded = language_id.train(docs)
    assert sharded.shards > 3
    again = {r.id: r for r in language_id.predict(frame, sharded).collect()}
    assert all(again[r.id].lang_pred == r.lang_pred and again[r.id].score == pytest.approx(r.score) for r in got)
    assert {r.id: r.lang_pred for r in got} == {i: x for i, (x, _) in enumerate(tests)}
    assert all(0 <= r.score <= 1 for r in got)
    assert language_id.train(docs.limit(0)) is None
    assert {r.lang_pred for r in language_id.predict(docs, None).collect()} == {"und"}


def test_code_lengths_are_exact():
    data = [b"abracadabra abracadabra", b"banana bandana"]
    grams = []
    for d in data:
        x = np.frombuffer(language_id.EDGE + d, np.uint8)
        grams.append(tuple(v.astype(np.int64) for v in np.unique(language_id._grams(x), return_counts=True)))
    model = language_id.Model(["a", "b"], grams)

    def cost(d, before, c):  # method C over contexts of 3, 2, 1 and 0 bytes
        text, total = language_id.EDGE + d, 0.0
        for k in (3, 2, 1, 0):
            ctx = before[len(before) - k :]
            follow = [text[i] for i in range(3, len(text)) if text[i - k : i] == ctx]
            n, kinds = len(follow), len(set(follow))
            if n and c in follow:
                return total - np.log2(follow.count(c) / (n + kinds))
            if n:
                total -= np.log2(kinds / (n + kinds))
        return total + 8.0

    probe = b"abranana zz"
    full = language_id.EDGE + probe
    want = [sum(cost(d, full[i - 3 : i], full[i]) for i in range(3, len(full))) for d in data]
    got = model.lengths(np.frombuffer(full, np.uint8), np.array([0, len(full)]))[0]
    assert np.allclose(got, want, rtol=1e-5)


def test_quality_classifier(spark):
    rng = random.Random(8)
    good = [(i, text(rng, 80), "s1" if i % 3 else None, "en") for i in range(150)]
    bad = [(1000 + i, " ".join("*$%&"[j % 4] * 3 + rng.choice(WORDS) for j in range(60)), "s2", "de") for i in range(150)]
    rows = [*good, *bad, (5000, None, None, None), (5001, "", "s1", "en"), (3, text(rng, 90), "s1", "en")]
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, *_ in good[::2] + bad[::2]] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = quality_classifier.classify(docs, labels).collect()
    assert len(got) == len(rows)
    assert all(r.kept == (r.doc_id < 1000) for r in got if r.doc_id < 5000)
    assert all(0 <= r.posterior <= 1 for r in got)
    none = quality_classifier.classify(docs, labels.limit(0)).collect()
    assert all(r.kept for r in none)
    assert quality_classifier.classify(docs.limit(0), labels).count() == 0


def test_sparse_sites_shrink_toward_the_mean_above(spark):
    sites = spark.createDataFrame([(0, 1000.0, 900.0), (0, 1000.0, 100.0), (0, 2.0, 2.0)], "group int, n double, s double")
    mean, strength = quality_classifier._moments(sites)
    assert abs(mean - 0.5) < 0.01 and 1.0 <= strength < 5.0
    same = spark.createDataFrame([(0, 500.0, 250.0)] * 4, "group int, n double, s double")
    assert quality_classifier._moments(same)[1] == 1e4


def test_workers_of_other_operators_keep_nothing():
    kernels.worker(("vocabulary",), lambda: bytearray(1 << 20))
    task = kernels.lean(lambda batches: (x + len(kernels._workers) for x in batches))
    assert list(task(iter([1, 2]))) == [1, 2] and not kernels._workers



def test_kernels_split_chunks_alike():
    import pyarrow as pa

    from quillon.llm import kernels as K

    rng = random.Random(9)
    texts = [text(rng, rng.randrange(200)) if rng.random() < 0.9 else None for _ in range(100)]
    for most in (1, 1000, 1 << 21):
        found = []
        for _, _, data, offs in K.chunks(pa.array(texts), most):
            found += K.words(data, offs).n.tolist()
        assert found == [len(brute.SPACED.findall(t or "")) for t in texts]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(10)
    word = lambda n: " ".join(f"{rng.choice(WORDS)}{rng.randrange(500)}" for _ in range(n))
    item = word(40)
    rows = [(i, word(100), "en", f"s{i % 3}", 0) for i in range(40)]
    rows += [(100 + i, " ".join("*#%" + rng.choice(WORDS) for _ in range(60)), "en", "s0", 0) for i in range(40)]
    rows += [(200, rows[3][1], "en", "s1", 0), (201, near(rng, rows[4][1], 1), "en", "s2", 0), (202, f"{word(40)} {item}", "en", "s1", 0), (203, "short text", "en", "s1", 0), (None, word(60), None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i, *_ in rows[:80]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    kept = docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, kept, str(tmp_path)).write.parquet(f"{tmp_path}/stage{i}")
        kept = spark.read.parquet(f"{tmp_path}/stage{i}")
        assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {*range(40), None}
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.collect()} == {*range(40), None} and out.where("not round_trip").count() == 0


def test_nulls_in_ids_are_kept(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (None, None), (1, "a b c d")], "doc_id long, text string")
    got = ngram_join.join(docs).collect()
    assert sorted((r.n_shingles, r.component_id or -1) for r in got) == [(0, -1), (2, -1), (2, 1)]
    assert decontamination.decontaminate(docs, docs.select(F.col("doc_id").alias("item_id"), "text")).count() == 3
