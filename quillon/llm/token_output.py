"""Token ids as ORC files: integer run-length encoding, row indexes and Bloom filters on document ids.

``write_tokens`` deals the texts by ranges of document id (one shuffle of the texts, none of the ids), encodes
each range in order and writes one ORC file a range. A file has the columns

* ``shard``: number of the range, ascending with document id;
* ``doc_id``; with a Bloom filter, and min/max in every row index, for pruning;
* ``first``: ids of the documents before it in its file;
* ``ids``: the ids as ``array<int>``, run-length encoded by ORC.

``read_tokens`` reads them back, by stripe, and takes document ids to look up: the filter reaches the ORC reader,
which skips files, stripes and row groups by their metadata.

Defined cases: a null or empty text has the end id alone; rows with the same or a null document id keep one row
each (nulls first, ties in any order); other columns of the input, whatever their names, are ignored; an empty
table gives files without rows.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.kernels import Memory, bounded_batches, shared_dir, worker

#: A control character; its id stands for no other text.
MARK = "\x01"
CHUNK_BYTES = 1 << 22
# The normalizer and the splitting pattern of vocabularies whose pieces end at white space and at marks.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def splits_at_spaces(spec: dict) -> bool:
    """Does a vocabulary (its file's content) drop white space as an end of pieces, and see letters in lower case and apart
    from marks? Only then runs between spaces can be encoded apart; else whole texts are."""
    first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    return (
        (spec.get("normalizer") or {}).get("normalizers") == NORMALIZER
        and (first.get("pattern"), first.get("behavior"), first.get("invert")) == ({"Regex": PATTERN}, "Removed", True)
        and not any(c.isspace() for t in spec.get("added_tokens", ()) for c in t["content"])
        and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") for t in spec.get("added_tokens", ()))
    )


class Encoder:
    """Whole texts to ids by the tokenizers library, with the end id after each text.

    Where the vocabulary treats a space or line feed as an end of any piece and drops it (``splits_at_spaces``), a text is
    encoded by its runs between those: the distinct runs of a chunk of texts are encoded once, and their ids gathered by
    index. Runs that were met before are remembered (see ``Memory``).
    """

    def __init__(self, path: str, end_id: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the unit of parallel work
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_runs = splits_at_spaces(spec)
        #: What all added tokens begin with; runs that have it keep their letters, as these tokens tell case.
        self.added = os.path.commonprefix([t["content"] for t in spec.get("added_tokens", ())])
        self.end = end_id

        def alone(run: str) -> bytes:
            return array("i", tokenizer.encode(run, add_special_tokens=False).ids).tobytes()

        self.alone = alone
        if not self.by_runs:
            return
        mark = tokenizer.encode(MARK, add_special_tokens=False).ids
        joined = len(mark) == 1

        def joint(runs: list[str]) -> list[bytes]:
            """Many runs at once, with a run between them that no other run's ids have."""
            out = [b""] * len(runs)
            some = []
            for i, run in enumerate(runs):
                if joined and MARK not in run and "<|" not in run:
                    some.append(i)
                else:
                    out[i] = alone(run)
            for k in range(0, len(some), 500):
                part = some[k : k + 500]
                ids = np.array(tokenizer.encode_batch_fast([f" {MARK} ".join([runs[i] for i in part])], add_special_tokens=False)[0].ids, "<i4")
                raw, cuts = ids.tobytes(), (np.flatnonzero(ids == mark[0]) * 4).tolist()
                for i, begin, end in zip(part, [0, *[c + 4 for c in cuts]], [*cuts, len(raw)], strict=True):
                    out[i] = raw[begin:end]
            return out

        self.tails = {c: np.frombuffer(alone(c), "<i4") for c in ".,"}
        self.known = Memory(joint)

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, row after the last, ids of these texts, their ends in the ids), a chunk of texts at a time."""
        texts = texts.cast(pa.large_string()).fill_null("")
        at = np.append(0, np.cumsum(pc.binary_length(texts).to_numpy()))
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK_BYTES, "right")) - 1)
            ids, ends = self._runs(texts.slice(i, j - i)) if self.by_runs else self._whole(texts.slice(i, j - i))
            yield i, j, ids, ends
            i = j

    def _whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = [np.append(np.frombuffer(self.alone(t), "<i4"), np.int32(self.end)) for t in texts.to_pylist()]
        return np.concatenate(found).astype(np.int32), np.cumsum([len(x) for x in found])

    def _runs(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        offs = parts.offsets.to_numpy()
        offs = offs - offs[0]
        runs = pc.dictionary_encode(parts.values.slice(parts.offsets[0].as_py(), int(offs[-1])))
        flat, size = self._distinct(runs.dictionary)
        # one more run, of the end id, after the runs of each text
        at = np.insert(runs.indices.to_numpy(), offs[1:], len(size))
        flat, size = np.append(flat, np.int32(self.end)), np.append(size, 1)
        begin, n = np.cumsum(size) - size, size[at]
        ends = np.cumsum(n)
        place = np.repeat(begin[at] - (ends - n), n)
        place += np.arange(len(place))
        return flat[place], ends[offs[1:] + np.arange(len(texts))]

    def _distinct(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct runs one after the other, and how many each has. A run is encoded as its stem, in which the
        normalizer sees the same letters, and the mark after a last letter, which the splitting pattern always parts from a small
        letter. Many runs have the same stem."""
        if not len(runs):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        plain = pc.invert(pc.match_substring(runs, self.added, ignore_case=True))
        low = pc.if_else(pc.and_(plain, pc.string_is_ascii(runs)), pc.ascii_lower(runs), runs)
        # a letter and a mark beyond ASCII after it may make one letter in one case alone
        low = pc.if_else(pc.and_(plain, pc.match_substring_regex(low, "^[A-Z][!-~]")), pc.binary_join_element_wise(pc.ascii_lower(pc.utf8_slice_codeunits(low, 0, 1)), pc.utf8_slice_codeunits(low, 1), pa.scalar("", low.type)), low)
        which = np.full(len(runs), -1, np.int8)
        for k, c in enumerate(self.tails):
            which[pc.match_substring_regex(low, rf"\p{{Ll}}[{c}]$").to_numpy(zero_copy_only=False)] = k
        cut = pa.array(which >= 0)
        stems = pc.dictionary_encode(pc.if_else(cut, pc.utf8_slice_codeunits(low, 0, -1), low))
        found = self.known.values(stems.dictionary.to_numpy(zero_copy_only=False).tolist())
        n = np.fromiter(map(len, found), np.int64, len(found)) // 4
        tails = list(self.tails.values())
        pieces = np.concatenate([np.frombuffer(b"".join(found), "<i4"), *tails])
        first = np.cumsum(n) - n
        # each run is a row of two pieces: its stem, and its mark or nothing
        mark_n = np.array([len(x) for x in tails] + [0])
        mark_first = int(n.sum()) + np.append(np.cumsum(mark_n[:-1]) - mark_n[:-1], 0)
        at = stems.indices.to_numpy()
        begin = np.column_stack([first[at], mark_first[which]]).ravel()
        size = np.column_stack([n[at], mark_n[which]]).ravel()
        ends = np.cumsum(size)
        place = np.repeat(begin - (ends - size), size) + np.arange(int(ends[-1]))
        return pieces[place].astype(np.int32), size.reshape(-1, 2).sum(1)


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int, shards: int | None = None) -> None:
    """Writes documents (doc_id, text) as token ids. shards: files; by default one for each shuffle partition."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, first, shard = worker((Encoder, vocabulary, end_id), lambda: Encoder(vocabulary, end_id)), 0, TaskContext.get().partitionId()
        for b in batches:
            for i, j, ids, ends in encoder.encode(b.column(1)):
                starts = np.append(0, ends[:-1])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(j - i, shard, np.int64)),
                        b.column(0).slice(i, j - i),
                        pa.array(first + starts),
                        pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids)),
                    ],
                    ["shard", "doc_id", "first", "ids"],
                )
                first += int(ends[-1])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    out = dealt.mapInArrow(encode, "shard long, doc_id long, first long, ids array<int>")
    out.write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.row.index.stride", "10000").option("orc.stripe.size", str(64 << 20)).option("compression", "zstd").orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """shard, doc_id, first, ids; with doc_ids, of these documents only, with pruning by metadata."""
    rows = spark.read.schema("shard long, doc_id long, first long, ids array<int>").orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def summaries(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document, read back from the files.

    The driver sees one count a file."""
    bounded_batches(spark)
    rows = read_tokens(spark, path)
    totals = {r.shard: r.n for r in rows.groupBy("shard").agg(F.max(F.col("first") + F.size("ids")).alias("n")).collect()}
    base, before = 0, {}
    for shard in sorted(totals):
        before[shard] = base
        base += totals[shard]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(3)
            offs, flat = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<u4", copy=False)
            starts = np.array([before[s] for s in b.column(0).to_pylist()], np.int64) + b.column(2).to_numpy()
            crc = [zlib.crc32(flat[i:j]) for i, j in zip(offs[:-1], offs[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(starts), pa.array(np.diff(offs).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_dir(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return summaries(spark, path)
