import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.orc as orc
import pytest

P = pytest.importorskip("public_tokenizers")
import sentencepiece  # noqa: E402
from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402
from sentencepiece import sentencepiece_model_pb2  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from quillon.llm import sentencepiece_fst, token_counts, token_output  # noqa: E402
from quillon.llm.pieces import Normaliser, Pieces  # noqa: E402

MODEL, WORDS = P.path("piece_bpe_32k.model"), P.path("word_bpe_49k.json")
SP = sentencepiece.SentencePieceProcessor(model_file=MODEL)
FST, COUNTER = sentencepiece_fst.Transducer(Pieces(MODEL)), token_counts.Counter(MODEL)
ODD = ["", " ", "   ", "\n", "\n\n a\n", "a  b", " x ", "Straße über 😀 中文", "the " * 50, "x" * 300, "\t\x00\x7f", "<0x41>", "aaaaaaaaaa", "  word" * 7, "é́", "▁ ▁x"]


def unigram():
    m = sentencepiece_model_pb2.ModelProto()
    with open(MODEL, "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    for p in m.pieces:
        if p.type == 1:
            p.score = max(p.score, -40000) / 3000 - 1
    return m.SerializeToString()


@pytest.mark.parametrize("text", ODD)
def test_encoding_and_counts_equal_the_library(text):
    want = SP.encode(text)
    assert FST.encode([text])[0].tolist() == want
    assert COUNTER.count([text]) == [len(want)]
    assert FST.decode(want) == SP.decode(want) == text.replace("▁", " ")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abthe \n\t,.éß中😀▁A1", max_size=60))
def test_encoding_equals_the_library_on_random_texts(text):
    ids = FST.encode([text])[0].tolist()
    assert ids == SP.encode(text)
    assert COUNTER.count([text]) == [len(ids)]
    assert FST.decode(ids) == text.replace("▁", " ")


def test_a_unigram_model_takes_the_greatest_sum_of_scores():
    proto = unigram()
    sp, fst, counter = sentencepiece.SentencePieceProcessor(model_proto=proto), sentencepiece_fst.Transducer(Pieces(proto=proto)), token_counts.Counter(proto=proto)
    rng = random.Random(4)
    texts = [*ODD, *("".join(rng.choice("abthe inérsß中 ,.") for _ in range(40)) for _ in range(200))]
    assert [x.tolist() for x in fst.encode(texts)] == [sp.encode(t) for t in texts]
    assert counter.count(texts) == [len(sp.encode(t)) for t in texts]


def test_the_normaliser_of_a_model_is_compiled():
    library = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    m = sentencepiece_model_pb2.ModelProto()
    m.ParseFromString(library.serialized_model_proto())
    own = Normaliser(m.normalizer_spec.precompiled_charsmap)
    plain = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=False, remove_extra_whitespaces=False)
    for text in [*ODD, "ｆｕｌｌ　width １２", "ﬁne ½ ™", "e\u0301 か\u3099 \u200b", "Å Ω", "㍿ ㌔"]:
        assert own.apply(text).replace("▁", " ") == plain.normalize(text).replace("▁", " "), text
    whole = sentencepiece_model_pb2.ModelProto()
    whole.ParseFromString(unigram())
    whole.normalizer_spec.CopyFrom(m.normalizer_spec)
    whole.normalizer_spec.add_dummy_prefix = True
    proto = whole.SerializeToString()
    sp, fst = sentencepiece.SentencePieceProcessor(model_proto=proto), sentencepiece_fst.Transducer(Pieces(proto=proto))
    texts = ["ｆｕｌｌ width  x ", "ﬁne ½", "e\u0301t\u0301 ", "  plain the ", "", "中文 １２"]
    assert [x.tolist() for x in fst.encode(texts)] == [sp.encode(t) for t in texts]


def test_long_runs_and_the_trie_give_the_same():
    p = Pieces(MODEL)
    for run in ["▁" + "theinganderß" * 4, "▁" * 40 + "word", "▁" + "😀" * 5]:
        ids = [x for at, _, k in p.path(run) for x in ([k] if k != -1 else p.fallback(run[at]))]
        assert ids == FST.encode([run.replace("▁", " ")[1:]])[0].tolist()


def test_queries_of_counts_and_encoding(spark):
    rows = [(i, t, "clash") for i, t in enumerate([None, *ODD, "Ab", "Ab"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, MODEL).collect()}
    assert got == {i: len(SP.encode(t or "")) for i, t, _ in rows}
    for r in sentencepiece_fst.digests(docs.select("doc_id", "text"), MODEL).collect():
        ids = SP.encode(rows[r.doc_id][1] or "")
        assert (r.n_tokens, r.ids_crc32, r.round_trip) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)
    full = {r.doc_id: (r.ids, r.decoded) for r in sentencepiece_fst.encode_decode(docs, MODEL).collect()}
    assert full[8] == (SP.encode(rows[8][1]), rows[8][1])
    assert token_counts.token_counts(docs.limit(0), MODEL).count() == 0


PARTS = ["a", "É", "é", " ", "\n", "\t", "\x1c", "'s", "12", "<|endoftext|>", "!?", "中文", "İ", "\x01", ".", ",", "The", "Å", "ß."]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=20))
def test_word_bpe_equals_the_library(parts):
    text = "".join(parts)
    assert encoded(ENCODER, [text, None])[1] == [2]
    assert encoded(ENCODER, [text])[0] == [*TOKENIZER.encode(text, add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("text", ["J\u030cx a", "H\u0331", "W\u030a. T\u0308", "<|ENDOFTEXT|> x", "The<|EndOfText|>.", "Aé. AÉ, ⓐ. ª, É."])
def test_word_bpe_keeps_letters_whose_case_matters(text):
    assert encoded(ENCODER, [text, "a", text]) == [[*TOKENIZER.encode(t, add_special_tokens=False).ids, 2] for t in (text, "a", text)]


def encoded(encoder, texts):
    out = []
    for _, _, ids, ends in encoder.encode(pa.array(texts, pa.string())):
        out += [x.tolist() for x in np.split(ids, ends[:-1])]
    return out


def test_texts_in_chunks_and_vocabularies_that_keep_spaces(monkeypatch):
    texts = ["The end.", None, "", "a b\nc " * 50, "x" * 1000, "The END, the end"]
    whole = token_output.Encoder(P.path("byte_bpe_50k.json"), 50256)
    assert ENCODER.by_runs and not whole.by_runs  # spaces are part of its pieces
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for most in (1, 100, 1 << 20):
        monkeypatch.setattr(token_output, "CHUNK_BYTES", most)
        for array in (pa.array(texts), pa.array(["zz", *texts])[1:]):
            assert [x for _, _, ids, ends in ENCODER.encode(array) for x in np.split(ids, ends[:-1])][0].tolist() == [*TOKENIZER.encode(texts[0]).ids, 2]
        assert encoded(ENCODER, texts) == [[*TOKENIZER.encode(t or "").ids, 2] for t in texts]
        assert encoded(whole, texts) == [[*library.encode(t or "").ids, 50256] for t in texts]


TOKENIZER = Tokenizer.from_file(WORDS)
ENCODER = token_output.Encoder(WORDS, 2)


def test_orc_files(spark, tmp_path):
    rows = [(9, "Hello there."), (3, None), (5, ""), (None, "x"), (3, "twice"), (40, "the end " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = f"file://{tmp_path}/ids"
    token_output.write_tokens(docs, path, WORDS, 2, shards=3)
    stored = token_output.read_tokens(spark, path).orderBy("shard", "first").collect()
    assert [r.doc_id for r in stored if r.doc_id is not None] == sorted(i for i, _ in rows if i is not None)
    by_text = {(r.doc_id, len(r.ids)): list(r.ids) for r in stored}
    for i, t in rows:
        want = [*TOKENIZER.encode(t or "", add_special_tokens=False).ids, 2]
        assert by_text[i, len(want)] == want
    start = 0
    for r in sorted(token_output.summaries(spark, path).collect(), key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    assert [r.doc_id for r in token_output.read_tokens(spark, path, [9]).collect()] == [9]
    files = list((tmp_path / "ids").glob("*.orc"))
    assert files and all(orc.ORCFile(f).schema.names == ["shard", "doc_id", "first", "ids"] for f in files)
    empty = f"file://{tmp_path}/empty"
    token_output.write_tokens(docs.limit(0), empty, WORDS, 2, shards=2)
    assert token_output.summaries(spark, empty).count() == 0


def test_orc_files_have_indexes_and_filters_that_prune(spark, tmp_path):
    docs = spark.range(40_000).selectExpr("id * 2 AS doc_id", "'a b' AS text")
    path = f"file://{tmp_path}/ids"
    token_output.write_tokens(docs, path, WORDS, 2, shards=2)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    every = spark.sparkContext._gateway.new_array(jvm.boolean, 6)  # the row, its four columns, the ids' elements
    for i in range(6):
        every[i] = True
    for f in (tmp_path / "ids").glob("*.orc"):
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(f)), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        index = reader.rows().readRowIndex(0, every, every)
        assert len(index.getRowGroupIndex()[2].getEntryList()) >= 2  # of doc_id, for some 20,000 rows in groups of 10,000
        assert index.getBloomFilterIndex()[2] is not None and index.getBloomFilterIndex()[4] is None
    some = token_output.read_tokens(spark, path, [100, 101, 70_000])
    assert sorted(r.doc_id for r in some.collect()) == [100, 70_000]
    assert "doc_id" in some._jdf.queryExecution().toString().split("PushedFilters:")[1].split("]")[0]
