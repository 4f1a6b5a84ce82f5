"""SentencePiece encoding and decoding by a weighted finite-state transducer over the tropical semiring.

The transducer has three parts, compiled from the model:

* the normaliser: the model's character map (the longest mapped sequence at each place), spaces to the escape mark, and one
  mark before the text (see ``pieces.Normaliser`` and ``Pieces.runs``);
* the pieces: an acceptor with a state for each beginning of a piece, an arc for each character, and, where a piece ends, its
  id as output, its weight, and an empty arc back to the first state;
* byte fallback: an arc for any character that no piece has alone, with the ids of its UTF-8 bytes.

Weights: in a unigram model an arc costs the piece's negated score. In a BPE model (the public one), whose scores are ranks of
merges and no sum, the pieces are composed with one more acceptor: its states are pieces, and it lets one piece follow another
only if merging the two gives the two again (weight 0, else infinity). One path is left, that of the merges (see ``pieces``).

Input. Runs between spaces can be composed apart. The new runs of a batch are one acyclic acceptor, that shares prefixes; it is
composed with the pieces level by level. A state of the composition is a node of the input, a state of the pieces, and the
node where the piece begins; the shortest distance of each node follows from those of the nodes where its last pieces begin,
as all arcs lead one level down. A run of over ``MOST_DEPTH`` characters is composed alone, in the same way. The results of frequent
runs are remembered (see ``Memory``).

Defined cases: a null or empty text gives no ids, and decodes to the empty text; lone surrogates can't occur in a Spark
string; the escape mark itself in a text decodes to a space, as in SentencePiece; under a model with a character map, or one
that drops extra spaces, decoding gives the normalised text; repeated rows keep one row each; an empty table gives no rows;
extra columns pass through unless they are named as the new ones.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.forward import MOST_DEPTH, Solved
from quillon.llm.kernels import Memory, bounded_batches, lean, worker
from quillon.llm.pieces import BPE, MARK, Pieces


MOST_PAIRS = 1_000_000


class Composition:
    """Composes the pieces with acceptors of many runs; arcs of the pieces as arrays, sorted by state and character."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        keys = np.fromiter(pieces.arcs, np.int64, len(pieces.arcs))
        order = np.argsort(keys)
        self.keys, self.to = keys[order], np.fromiter(pieces.arcs.values(), np.int64, len(keys))[order]
        self.final, self.weights = np.array(pieces.final), -np.array(pieces.scores)
        self.alone = {ord(p) for p in pieces.ids if len(p) == 1}
        self.pairs, self.may = np.array([-1], np.int64), np.array([False])

    def step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The states that the arcs lead to, or 0."""
        key = state << 21 | char
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], 0)

    def follows(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The acceptor of pairs: has the state ``left`` (-1: the first, or after fallback) an arc of the piece ``right``? Its arcs are
        made when they are first asked for."""
        key = (left + 1) << 21 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        if (new := np.unique(key[self.pairs[at] != key])).size:
            p = self.pieces
            if len(self.pairs) > MOST_PAIRS:  # begun anew, with all that is asked for now
                self.pairs, self.may, new = np.array([-1], np.int64), np.array([False]), np.unique(key)
            may = [p._follows(p.pieces[(k >> 21) - 1], p.pieces[k & 0x1FFFFF]) if k >> 21 else p.alone(p.pieces[k]) for k in new.tolist()]
            place = np.searchsorted(self.pairs, new)
            self.pairs, self.may = np.insert(self.pairs, place, new), np.insert(self.may, place, may)
            at = np.searchsorted(self.pairs, key)
        return self.may[at]

    def shortest(self, runs: list[str]) -> Solved:
        """The shortest distances and last pieces of all nodes of the runs' acceptor; no run is empty."""
        p, bpe = self.pieces, self.pieces.kind == BPE
        length = np.array(list(map(len, runs)))
        chars = np.frombuffer("".join(runs).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        first = np.cumsum(length) - length
        # by node of the input; node 0 is the first
        levels = [(np.zeros(1), np.full(1, -1), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64))]
        dist, last, before, n, char = (x.copy() for x in levels[0])
        room = 1
        node, active, made, depth, top = np.zeros(len(runs), np.int64), np.arange(len(runs)), 1, 0, 0
        at_node, state, begin = (np.zeros(0, np.int64) for _ in range(3))  # states of the composition, by node
        while True:
            active = active[length[active] > depth]
            if not len(active):
                break
            key, back = np.unique(node[active] << 21 | chars[first[active] + depth], return_inverse=True)
            node[active] = made + back
            above, c = key >> 21, key & 0x1FFFFF
            depth, m = depth + 1, len(key)
            # a piece may begin at each node of the level above
            starts = np.arange(top, made)
            at_node, state, begin = np.append(at_node, starts), np.append(state, np.zeros(len(starts), np.int64)), np.append(begin, starts)
            order = np.argsort(at_node, kind="stable")
            at_node, state, begin = at_node[order], state[order], begin[order]
            lo, hi = np.searchsorted(at_node, above), np.searchsorted(at_node, above, "right")
            take = np.repeat(lo - np.append(0, np.cumsum(hi - lo)[:-1]), hi - lo) + np.arange((hi - lo).sum())
            to = np.repeat(np.arange(m), hi - lo)
            state, begin = self.step(state[take], c[to]), begin[take]
            ok = state > 0
            to, state, begin = to[ok], state[ok], begin[ok]
            at_node = to + made
            # arcs that end a piece here, the longest (first begun) first; then fallback
            ends = self.final[state]
            arc = np.flatnonzero(ends >= 0)
            arc = arc[np.argsort(begin[arc], kind="stable")]
            v, b, k = to[arc], begin[arc], ends[arc]
            if bpe:
                ok = self.follows(last[b], k)
                v, b, k = v[ok], b[ok], k[ok]
                cost = np.zeros(len(v))
            else:
                cost = dist[b] + self.weights[k]
            lone = np.flatnonzero(~np.isin(c, list(self.alone))) if not bpe else np.setdiff1d(np.arange(m), v)
            v, b, k = np.append(v, lone), np.append(b, above[lone]), np.append(k, np.full(len(lone), -1))
            cost = np.append(cost, np.zeros(len(lone)) if bpe else dist[above[lone]] - p.unknown_score)
            order = np.lexsort((np.arange(len(v)), cost, v))
            v, b, k, cost = v[order], b[order], k[order], cost[order]
            head = np.append(True, v[1:] != v[:-1])
            b, k, cost = b[head], k[head], cost[head]
            count = n[b] + 1
            for x in np.flatnonzero(k < 0).tolist():
                count[x] += len(p.fallback(chr(c[x]))) - 1
            if made + m > room:
                room = 2 * (made + m)
                dist, last, before, n, char = (np.resize(x, room) for x in (dist, last, before, n, char))
            new = slice(made, made + m)
            dist[new], last[new], before[new], n[new], char[new] = cost, k, b, count, c
            top, made = made, made + m
        return Solved(p, node, last[:made], before[:made], n[:made], char[:made])


class Transducer:
    """encode and decode whole texts."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        composition = Composition(pieces)

        def compute(runs: list[str]) -> list[bytes]:
            out = [b""] * len(runs)
            short = [i for i, r in enumerate(runs) if len(r) <= MOST_DEPTH]
            for i, got in zip(short, composition.shortest([runs[i] for i in short]).paths() if short else [], strict=True):
                out[i] = got
            for i, run in enumerate(runs):
                if len(run) > MOST_DEPTH:
                    ids = [x for at, _, k in pieces.path(run) for x in ([k] if k != -1 else pieces.fallback(run[at]))]
                    out[i] = np.array(ids, "<i4").tobytes()
            return out

        self.known = Memory(compute, most=100_000)
        self.raw: list[bytes] = []

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        runs = [self.pieces.runs(t) for t in texts]
        return [np.frombuffer(b"".join(x), "<i4") for x in self.known.by_text(runs)]

    def decode(self, ids) -> str:
        """The inverse transducer: pieces and bytes to text, marks to spaces, without the first mark."""
        p = self.pieces
        if not self.raw:
            self.raw = [bytes([int(x[3:5], 16)]) if t == 6 else b"" if t == 3 else " ⁇ ".encode() if t == 2 else x.encode() for x, t in zip(p.pieces, p.types, strict=True)]
        raw = self.raw
        out = b"".join([raw[i] for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids)]).decode("utf-8", "replace").replace(MARK, " ")
        return out[1:] if p.dummy_prefix and out.startswith(" ") else out


def encode_decode(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """docs without the text, with ids (array<int>) and decoded (string)."""
    return _apply(docs, model, text, "ids array<int>, decoded string", lambda ids, decoded, texts: [_lists(ids), pa.array(decoded, pa.string())])


def _lists(ids: list[np.ndarray]) -> pa.Array:
    return pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))


def _apply(docs: DataFrame, model: str, text: str, shape: str, columns) -> DataFrame:
    from pyspark.sql.types import _parse_datatype_string

    bounded_batches(docs.sparkSession)
    new = _parse_datatype_string(shape)
    rest = [c for c in docs.columns if c != text and c not in new.names]
    schema = docs.select(*[F.col(f"`{c}`") for c in rest]).schema
    for f in new:
        schema = schema.add(f)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = worker((Transducer, model), lambda: Transducer(Pieces(model)))
        for b in batches:
            for i in range(0, len(b), 500):
                part = b.slice(i, 500)
                texts = part.column(len(rest)).to_pylist()
                ids = fst.encode(texts)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns(ids, [fst.decode(x) for x in ids], texts)], schema.names)

    return docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").cast("string")).mapInArrow(lean(run, keeps=True), schema)


def digests(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """docs without the text, with n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers) and round_trip."""

    def columns(ids, decoded, texts):
        crc = [zlib.crc32(x.tobytes()) for x in ids]
        return [pa.array(list(map(len, ids)), pa.int64()), pa.array(crc, pa.int64()), pa.array([d == (t or "").replace(MARK, " ") for d, t in zip(decoded, texts, strict=True)], pa.bool_())]

    return _apply(docs, model, text, "n_tokens long, ids_crc32 long, round_trip boolean", columns)


def encoded(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """docs without the text, with ids, n_tokens and round_trip."""

    def columns(ids, decoded, texts):
        return [_lists(ids), pa.array(list(map(len, ids)), pa.int64()), pa.array([d == (t or "").replace(MARK, " ") for d, t in zip(decoded, texts, strict=True)], pa.bool_())]

    return _apply(docs, model, text, "ids array<int>, n_tokens long, round_trip boolean", columns)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(docs, public_tokenizers.path("piece_bpe_32k.model"))
