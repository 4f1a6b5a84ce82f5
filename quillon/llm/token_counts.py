"""Token counts by dynamic programming over a trie of pre-tokens.

The distinct pre-tokens of a batch of texts that weren't counted yet are inserted in a trie. A node stands for a prefix,
and holds the forward score of its best segmentation and the number of ids; these follow from the nodes above it, so
they are computed once for all pre-tokens that begin so. The count at a pre-token's last node is stored (for a bounded
number of frequent pre-tokens, by each Python worker); a text's count is the sum over its pre-tokens.

In a unigram model the forward score is the greatest sum of piece scores. The score of a BPE model isn't a sum; there,
the forward step admits a piece only if it may follow the last piece of the prefix before it (see ``pieces``).
A pre-token of over ``MOST_DEPTH`` characters isn't put in the trie; its segmentation is searched alone.

Defined cases: a null or empty text has 0 ids; repeated rows keep one row each; other columns pass through unless they
are named as the new one, which replaces them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.forward import MOST_DEPTH, Forward
from quillon.llm.kernels import Memory, bounded_batches, worker
from quillon.llm.pieces import Pieces

class Counter:
    """Counts of whole texts. Pre-tokens not counted yet are inserted in a trie (see ``forward``), a batch at a time."""

    def __init__(self, model: str | None = None, proto: bytes | None = None):
        self.pieces = Pieces(model, proto)
        forward = Forward(self.pieces)

        def compute(runs: list[str]) -> list[int]:
            out = np.zeros(len(runs), np.int64)
            short = [i for i, r in enumerate(runs) if len(r) <= MOST_DEPTH]
            if short:
                out[short] = forward.solve([runs[i] for i in short]).counts()
            for i in range(len(runs)):
                if len(runs[i]) > MOST_DEPTH:
                    out[i] = sum(1 if k != -1 else len(self.pieces.fallback(runs[i][at])) for at, _, k in self.pieces.path(runs[i]))
            return out.tolist()

        self.known = Memory(compute)

    def count(self, texts: list[str | None]) -> list[int]:
        runs = [self.pieces.runs(t) for t in texts]
        return list(map(sum, self.known.by_text(runs)))


def token_counts(docs: DataFrame, model: str, text: str = "text", into: str = "n_tokens") -> DataFrame:
    """docs with the number of ids of each text under the SentencePiece model."""
    bounded_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c not in (into, text)]
    shape = docs.select(*[F.col(f"`{c}`") for c in rest]).schema.add(into, "long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker((Counter, model), lambda: Counter(model))
        for b in batches:
            n = pa.array([x for i in range(0, len(b), 500) for x in counter.count(b.column(len(rest)).slice(i, 500).to_pylist())], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], [*rest, into])

    return docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").cast("string")).mapInArrow(count, shape)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))
