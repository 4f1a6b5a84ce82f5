"""Each query of the ten operators over a small folder of tables, with all columns of its contract."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
import sentencepiece  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from quillon.llm import oracles, queries, quality_rules  # noqa: E402
from tests.llm import brute  # noqa: E402
from tests.llm.test_documents import near, text  # noqa: E402
from tests.llm.test_pages import plain_rule  # noqa: E402

LANGS = {"en": "the and with house river green".split(), "de": "der und mit haus fluß grün".split()}


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(77)
    item = " ".join(f"b{rng.randrange(900)}" for _ in range(30))
    notice = " ".join(f"n{rng.randrange(900)}" for _ in range(30))
    base = text(rng, 120)
    docs = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, base), (7, base), (8, near(rng, base, 1)), (9, f"{text(rng, 20)} {item} x"), (10, item.upper()), (11, "#" * 40 + " x" * 70), (12, "12 34 ?!"), (-13, "short " * 3)]
    docs += [(100 + i, f"{text(rng, 60)}\n{notice}") for i in range(30)] + [(200 + i, f"{notice}\n{text(rng, 9)}") for i in range(3)]
    docs += [(300 + i, " ".join(rng.choice(LANGS["de" if i % 2 else "en"]) for _ in range(60))) for i in range(40)]
    lang = lambda i: ("de" if i % 2 else "en") if i >= 300 else None
    return {
        "documents": [(i, t, lang(i), None if i == 4 else "s0" if 100 <= i < 300 else f"s{i % 2}", 5, "clash") for i, t in docs],
        "benchmark": [(1, item), (2, "One"), (3, None), (4, ""), (10, item), (5, "no such words here")],
        "labels": [(i, int(i != 11), 0) for i, _ in docs if i >= 100 or i == 11] + [(None, 1, 0), (6, None, None)],
        "pages": [(1, "http://a.com/x", "<article><p>A &amp; b</p></article><nav>m</nav>"), (2, "https://www.example.com/en/1?q=/", "<p>open</p>"), (3, None, None), (4, "http://Sub.Example.com/en/", ""), (5, "http://b.net/es/z#f", "<article>ü\n ü</article>"), (5, "http://b.net/es/z#f", "<article>ü\n ü</article>"), (6, "no scheme", "x")],
    }


SHAPES = {"documents": "doc_id long, text string, lang string, source string, n_chars long, score string", "benchmark": "item_id long, text string", "labels": "doc_id long, quality int, toxic int", "pages": "page_id long, url string, html string"}


@pytest.fixture(scope="module")
def folder(spark, tables, tmp_path_factory):
    top = tmp_path_factory.mktemp("tables")
    for name, rows in tables.items():
        spark.createDataFrame(rows, SHAPES[name]).coalesce(1).write.parquet(f"{top}/{name}.parquet")
        spark.createDataFrame([], SHAPES[name]).write.parquet(f"{top}/empty/{name}.parquet")
    return str(top)


@pytest.fixture(scope="module")
def run(spark, folder):
    return lambda name: {r[0]: r for r in queries.queries()[name](spark, folder).collect()}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty_tables_give_no_rows(spark, folder, name):
    assert queries.queries()[name](spark, f"{folder}/empty").count() == 0


@pytest.mark.parametrize("name", sorted(oracles.ALL))
def test_queries_equal_their_sql(run, folder, name):
    con = duckdb.connect()
    for t in SHAPES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    found = con.execute(oracles.ALL[name])
    columns = [d[0] for d in found.description]
    want = {r[columns.index("doc_id")]: dict(zip(columns, r, strict=True)) for r in found.fetchall()}
    assert {i: r.asDict() for i, r in run(name).items()} == want


def test_decontamination(run, tables):
    docs = tables["documents"]
    want = brute.contamination([d[1] for d in docs], tables["benchmark"])
    got = run("op1_decontamination")
    for d, (n, hit, items) in zip(docs, want, strict=True):
        digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        assert tuple(got[d[0]]) == (d[0], n, hit, len(items), digest, hit > 0 and 20 * hit >= n)
    assert got[10].contaminated and got[10].n_items == 2 and got[4].contaminated


def test_token_output(run, tables):
    library, start, got = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0, run("op2_token_output")
    for i, t, *_ in sorted(tables["documents"]):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert tuple(got[i]) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_counts_and_encoding(run, tables):
    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    counts, encoded = run("op3_token_counts"), run("op4_sentencepiece")
    for i, t, *_ in tables["documents"]:
        ids = library.encode(t or "")
        assert counts[i].n_tokens == len(ids)
        assert (encoded[i].n_tokens, encoded[i].ids_crc32, encoded[i].round_trip) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)


def test_ngram_join(run, tables):
    want = brute.linked([d[:2] for d in tables["documents"]])
    assert {i: (r.n_shingles, r.component_id) for i, r in run("op5_ngram_join").items()} == want


def test_language_id(run, tables):
    for i, r in run("op6_language_id").items():
        t, lang = next(d[1:3] for d in tables["documents"] if d[0] == i)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1
        assert r.lang_pred == ("und" if not any(c.isalpha() for c in t or "") else r.lang_pred) and r.lang_pred in ("en", "de", "und")
        if lang:
            assert r.lang_pred == lang and r.score > 0.99


def test_quality_rules(run, tables):
    got = run("op7_quality_rules")
    for i, t, *_ in tables["documents"]:
        assert tuple(got[i][c] for c in quality_rules.BASE_COLUMNS) == brute.base(t)
    assert all(got[100 + i].kept and got[100 + i].n_removed_words == 30 for i in range(30)) and not any(got[200 + i].kept for i in range(3))


def test_quality_classifier(run, tables):
    got = run("op8_quality_classifier")
    assert got.keys() == {d[0] for d in tables["documents"]} and all(0 <= r.posterior <= 1 for r in got.values())
    assert all(got[i].kept for i in got if i >= 100)


def test_url_filter(run, tables):
    got = run("op9_url_filter")
    for i, url, _ in tables["pages"]:
        host, path, rule, verdict = plain_rule(url)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict or "allow")


def test_html_extraction(spark, folder):
    got = [tuple(r) for r in queries.queries()["op10_html_extraction"](spark, folder).select("page_id", "text", "n_chars").collect()]
    assert sorted(got) == [(1, "A & b", 5), (2, "open", 4), (3, "", 0), (4, "", 0), (5, "ü ü", 3), (5, "ü ü", 3), (6, "x", 1)]


