"""N-gram Jaccard join by vertical partitioning of the global n-gram order.

A document's set holds its distinct ``n``-word shingles, as 64-bit hashes. Documents with equal sets are one class, whose
smallest document id stands for it. Two classes link if the sets' Jaccard similarity is ``percent`` / 100 or more; then
they share at least o(s) n-grams, the least number that a set of s n-grams can share with a linked one.

1. Fragments. All n-grams have a global order, by a second hash. Of a set, the first s - o(s) + l(s) n-grams are dealt to
   the fragments of the n-grams' range. Two linked sets share the l first of their common n-grams there (the rest of the
   common ones come after them). Each fragment counts, for each set, how many of its n-grams other sets have too; these
   partial counts are summed per set. A set with fewer than l(o(s)) can't link: only the others, the members, go on.
   A buffer of a task gives an n-gram that several of its sets have once, without a set, so however many sets have it,
   a fragment gets it once from each buffer.
2. Keys. The members' n-grams are ordered anew, the rarest first, among the first s - o(s) + l'(s) of the old order. Linked
   sets share an n-gram among the rarest k(s) of these (see ``Lengths``). A passage that many documents have gives no key
   but to documents that are little else. An n-gram that one member has alone is a place in the order, but no row.
3. Pairs, the first round: of each key, two of its sets and each of the others.
4. Partial overlaps. The two sets of a pair are cut into the ``PARTS`` fragments of the n-grams' range, overlaps are counted in
   each fragment apart, and summed per pair. Sets that verified links connect are one component.
5. Pairs, the second round: of each key whose sets aren't in one component, pairs of sets in different ones, but for those that
   sizes or the parity of 1,024 bits rule out (bits that differ are n-grams that one set lacks); of each key as many as would
   connect what all of them would. Keys of many sets are dealt to pairs of blocks of ``BLOCK`` sets. The pairs are verified as before.
6. The third round is the same, but takes all such pairs: few sets are left in different components by now, and nearly all
   that could link are connected. So every pair of sets that links is verified, or connected by verified links.

Skew: exact copies are one set. A group of near copies of any size costs two pairs at most for each of its sets and key, and is one
component after the first round, or a few; keys are joined to these sets by a join that adaptive execution can split. Only sets
that share a rare n-gram, but aren't connected, are compared with one another, by bits, in blocks.

Defined cases: documents without words, or without text, have an empty set, n_shingles 0 and no links; documents of fewer
than ``n`` words have one shingle, the whole sequence; rows with one document id and different texts are linked as that id;
rows without a document id are components of their own (null); extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import kernels as K
from quillon.llm.components import components

U = np.uint64
FRAGMENT = 1_000_000  # n-grams of a fragment, about
BUFFER = 1_000_000  # n-grams of a buffer
PARTS = 8
BITS = 1024
BLOCK = 1024


def sets_of(texts: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sorted hashes of the sets of these rows one after the other, ends of the sets)."""
    for i, j, data, offs in K.chunks(texts):
        low = K.LOWER[data]
        s = K.words(low, offs)
        h = K.hashes(low, s)
        out, text, _ = K.shingles(h, s, n)
        few = np.flatnonzero((s.n > 0) & (s.n < n))
        if len(few):
            whole = np.zeros(len(few), U)
            for k in range(n - 1):
                has = s.n[few] > k
                whole[has] = K.mix(whole[has] * U(0x2127599BF4325C37) + h[s.first[few[has]] + k] + U(k + 1))
            out, text = np.concatenate([out, K.mix(whole + U(0x5BD1E995))]), np.concatenate([text, few])
            order = np.argsort(text, kind="stable")
            out, text = out[order], text[order]
        bounds = np.searchsorted(text, np.arange(j - i + 1)).tolist()
        for x, y in zip(bounds, bounds[1:]):  # noqa: B905
            out[x:y].sort()
        if len(out):
            keep = np.append(True, (out[1:] != out[:-1]) | (text[1:] != text[:-1]))
            out, text = out[keep], text[keep]
        yield i, out, np.searchsorted(text, np.arange(j - i), "right")


class Lengths:
    """Numbers for sets of a size (int or array). o: the least number of n-grams shared with a linked set.

    Let x and y link and y be the smaller one. Their common n-grams are o(x) at least, so of the first l of these, in any
    order of all n-grams, none comes after place |x| - o(x) + l of x, or |y| - o(y) + l of y. y has at least o(x) n-grams. So
    if l grows with the size, prefixes of s - o(s) + l(s) have l(|y|) n-grams in common, and that is at least l(o(x)) and l(o(y)).
    Of two such prefixes that share m, in another order, the first of the common ones is among the first |prefix| - m + 1.
    """

    def __init__(self, percent: int):
        self.percent = percent

    def o(self, s):
        return (s * self.percent + 99) // 100

    def first(self, s):
        """n-grams dealt to the fragments."""
        return np.minimum(s - self.o(s) + 1 + s // 10, s)

    def shared(self, s):
        """How many of these a member has in common with others."""
        return 1 + self.o(s) // 10

    def head(self, s):
        """n-grams that the keys are taken from, the rarest |head| - (1 + 2 * o // 5) + 1 of them."""
        return np.minimum(s - self.o(s) + 1 + 2 * s // 5, s)


def names(items: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set, from 128 bits of its items and its size; never 0."""
    begin = np.append(0, ends[:-1])
    total = [np.append(U(0), np.cumsum(K.mix(items + U(c)))) for c in (0x1234567, 0x7654321)]
    a, b = (t[ends] - t[begin] for t in total)
    out = K.mix(a + K.mix(b + (ends - begin).astype(U))).view(np.int64)
    out[out == 0] = 1
    return out


def ranks(items: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The place of each item within its set, in the global order by a second hash."""
    second = K.mix(items ^ U(0xA0761D6478BD642F))
    owner = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((second, owner))
    out = np.empty(len(items), np.int64)
    out[order] = np.arange(len(items)) - np.repeat(np.cumsum(size) - size, size)
    return out


def sizes(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles and set_id of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, items, ends in sets_of(b.column(1), n):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(ends)), pa.array(np.diff(ends, prepend=0)), pa.array(names(items, ends))], ["doc_id", "n_shingles", "set_id"])

    return docs.mapInArrow(K.lean(run), "doc_id long, n_shingles long, set_id long")


def dealt(docs: DataFrame, n: int, lengths: Lengths, fragments: int) -> DataFrame:
    """frag, grams, sets: the first n-grams of the sets by fragment, 4 bytes (within the fragment) and 8 bytes each. A set 0
    stands for several. Negative fragments hold, in place of n-grams, how many of a set's a buffer has seen in others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # names, sizes, items of sets
        rows = turn = 0

        def given() -> pa.RecordBatch:
            nonlocal turn
            name, size, items = (np.concatenate(x) for x in zip(*new, strict=True))
            new.clear()
            once = np.zeros(len(name), bool)
            once[np.unique(name, return_index=True)[1]] = True
            keep = np.repeat(once, size)
            items, owner = items[keep], np.repeat(name[once], size[once])
            order = np.argsort(items)
            items, owner = items[order], owner[order]
            head = np.append(True, items[1:] != items[:-1])
            first = np.flatnonzero(head)
            count = np.diff(np.append(first, len(items)))
            several = np.repeat(count > 1, count)
            mine, seen = np.unique(owner[several], return_counts=True)
            items, owner = items[first], np.where(count > 1, 0, owner[first])
            frag = ((items >> U(32)) * U(fragments) >> U(32)).astype(np.int64)
            begin = np.flatnonzero(np.diff(frag, prepend=-1))
            cut = [*begin.tolist(), len(items)]
            low = items.astype(np.uint32)
            turn += 1
            frags = [*frag[begin].tolist(), -1 - turn * 7919 % fragments]
            grams = [*[low[x:y].tobytes() for x, y in zip(cut, cut[1:])], seen.astype(np.uint32).tobytes()]  # noqa: B905
            sets = [*[owner[x:y].tobytes() for x, y in zip(cut, cut[1:])], mine.tobytes()]  # noqa: B905
            return pa.RecordBatch.from_arrays([pa.array(frags, pa.int32()), pa.array(grams, pa.binary()), pa.array(sets, pa.binary())], ["frag", "grams", "sets"])

        for b in batches:
            for _, items, ends in sets_of(b.column(1), n):
                size = np.diff(ends, prepend=0)
                own = names(items, ends)
                keep = ranks(items, size) < np.repeat(lengths.first(size), size)
                has = np.append(0, np.cumsum(keep))[ends]
                new.append((own, np.diff(has, prepend=0), items[keep]))
                rows += int(keep.sum())
                if rows >= BUFFER:
                    yield given()
                    rows = 0
        if rows:
            yield given()

    return docs.mapInArrow(K.lean(run), "frag int, grams binary, sets binary")


def _joined(blobs: list[bytes], kind) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind)


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Rows (key, counts or n-grams, sets) in order of the key, with all rows of a key together."""
    at, first, second = None, [], []
    for b in batches:
        for key, x, y in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
            if key != at and first:
                yield at, _joined(first, np.uint32), _joined(second, np.int64)
                first, second = [], []
            at = key
            first.append(x)
            second.append(y)
    if first:
        yield at, _joined(first, np.uint32), _joined(second, np.int64)


def shared_counts(pieces: DataFrame, fragments: int) -> DataFrame:
    """set_id, shared: how many of the n-grams dealt of a set others have too; counted by fragment, and summed by set."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frag, g, s in _by_key(batches):
            n = g
            if frag >= 0:
                order = np.lexsort((s, g))
                g, s = g[order], s[order]
                once = np.append(True, (g[1:] != g[:-1]) | (s[1:] != s[:-1]))
                g, s = g[once], s[once]
                first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
                size = np.diff(np.append(first, len(g)))
                several = np.repeat((size > 1) | np.logical_or.reduceat(s == 0, first), size)
                s, n = np.unique(s[several & (s != 0)], return_counts=True)
            part = (K.mix(s.view(U)) % U(fragments)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            part, s, n = part[order], s[order], n[order].astype(np.uint32)
            begin = np.flatnonzero(np.diff(part, prepend=-1))
            cut = [*begin.tolist(), len(s)]
            blobs = [[x[i:j].tobytes() for i, j in zip(cut, cut[1:])] for x in (n, s)]  # noqa: B905
            yield pa.RecordBatch.from_arrays([pa.array(part[begin], pa.int32()), *[pa.array(x, pa.binary()) for x in blobs]], ["part", "n", "sets"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, n, s in _by_key(batches):
            s, at = np.unique(s, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(np.bincount(at, n).astype(np.int64))], ["set_id", "shared"])

    counts = pieces.repartition("frag").sortWithinPartitions("frag").mapInArrow(K.lean(count), "part int, n binary, sets binary")
    return counts.repartition("part").sortWithinPartitions("part").mapInArrow(K.lean(total), "set_id long, shared long")


MOST_FILTER_BITS = 27


def rows_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs (doc_id, text) whose ids may be among ids: all that are, and few others. The filter has some 16 bits an id,
    2 ** MOST_FILTER_BITS (16 MB) at most; with very many ids it lets more rows pass. It only spares the shuffle of other texts."""
    n = ids.count()
    bits = min(MOST_FILTER_BITS, max(16, (n * 16).bit_length()))
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits))
    words = ids.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).cast("int").alias("word"))
    got = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()
    known = np.zeros(1 << bits - 6, np.int64)
    known[got.column(0).to_numpy()] = got.column(1).to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            at = b.column(2).to_numpy()
            out = b.filter(pa.array((known[at >> 6] >> (at & 63)) & 1 == 1))
            yield pa.RecordBatch.from_arrays(out.columns[:2], ["doc_id", "text"])

    return docs.where("doc_id is not null").select("doc_id", "text", bit.alias("bit")).mapInArrow(K.lean(run), "doc_id long, text string")


def parity(items: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A row of BITS bits for each set, as 64-bit words: whether an odd number of its items falls on each bit."""
    size = np.diff(ends, prepend=0)
    place = np.repeat(np.arange(len(size)), size) * BITS + (K.mix(items + U(0x9FB21C651E98DF25)) & U(BITS - 1)).astype(np.int64)
    odd = np.bincount(place, minlength=len(size) * BITS).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64).reshape(len(size), BITS // 64)


def members(docs: DataFrame, chosen: DataFrame, n: int, lengths: Lengths) -> DataFrame:
    """set_id, n, part, head, items: each chosen set (doc_id, set_id) by part of the n-grams' range; the first ``head`` items
    are those that its keys may come from. Part -1 holds its parity bits."""
    rows = rows_of(docs, chosen.select("doc_id")).join(chosen.select("doc_id", "set_id"), "doc_id").select("set_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, items, ends in sets_of(b.column(1), n):
                size = np.diff(ends, prepend=0)
                own = names(items, ends)
                same = own == b.column(0).slice(i, len(ends)).to_numpy()  # not another text of that document id
                set_at = np.repeat(np.arange(len(size)), size)
                late = ranks(items, size) >= np.repeat(lengths.head(size), size)
                part = (items >> U(61)).astype(np.int64)
                keep = same[set_at]
                set_at, late, part, items_kept = set_at[keep], late[keep], part[keep], items[keep]
                order = np.lexsort((late, part, set_at))
                set_at, late, part, items_kept = set_at[order], late[order], part[order], items_kept[order]
                first = np.flatnonzero(np.append(True, (set_at[1:] != set_at[:-1]) | (part[1:] != part[:-1]))) if len(part) else np.zeros(0, np.int64)
                head = np.add.reduceat((~late).astype(np.int64), first) if len(first) else first
                bits, mine = parity(items, ends)[same], np.flatnonzero(same)
                offs = np.concatenate([first, [len(part)], len(part) + (BITS // 64) * np.arange(1, len(mine) + 1)]).astype(np.int32)
                flat = np.concatenate([items_kept.view(np.int64), bits.ravel()])
                at = np.concatenate([set_at[first], mine])
                columns = [own[at], size[at], np.concatenate([part[first], np.full(len(mine), -1)]).astype(np.int32), np.concatenate([head, np.zeros(len(mine), np.int64)]).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))], ["set_id", "n", "part", "head", "items"])

    return rows.mapInArrow(K.lean(run), "set_id long, n long, part int, head int, items array<long>")


def keys(parts: DataFrame, lengths: Lengths) -> DataFrame:
    """key, set_id, n, odd (how rare the set's n-grams are): for each set the rarest n-grams of its head, as far as another set
    has them in its head."""
    grams = parts.where("head > 0").select("set_id", "n", F.explode(F.slice("items", 1, F.col("head"))).alias("gram"))
    df = K.written(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "frequencies")
    by_set = grams.join(df, "gram").groupBy("set_id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("grams"))
    o = f"((n * {lengths.percent} + 99) div 100)"
    # of |head| - (1 + 2 * o div 5) + 1 places, those that only this set has come first, |head| - size(grams) of them
    most = F.expr(f"cast(size(grams) - 2 * {o} div 5 as int)")
    rare = F.aggregate("grams", F.lit(0.0), lambda s, x: s + 1.0 / x["df"]) + F.expr(f"least(n - {o} + 1 + 2 * n div 5, n) - size(grams)")
    cut = by_set.where(most > 0).select("set_id", "n", rare.alias("odd"), F.slice("grams", F.lit(1), most).alias("grams"))  # before rows are made of them
    return cut.select("set_id", "n", "odd", F.explode("grams").alias("x")).select(F.col("x.gram").alias("key"), "set_id", "n", "odd")


def close(a: str, b: str, percent: int):
    return F.expr(f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})")


def star_pairs(key_rows: DataFrame, percent: int) -> DataFrame:
    """a, b: two of each key's sets (the one whose n-grams are the least rare, and one by a hash) and every other one of a size
    that can link."""
    one = F.struct("set_id", "n")
    ends = key_rows.groupBy("key").agg(F.min_by(one, F.struct("odd", "set_id")).alias("x"), F.min_by(one, F.xxhash64("set_id", F.col("key").bitwiseAND(3))).alias("y"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    pairs = key_rows.join(ends, "key").select("set_id", "n", F.explode(F.array_distinct(F.array("x", "y"))).alias("e")).where(F.col("e.set_id") != F.col("set_id"))
    pairs = pairs.select(F.least("set_id", "e.set_id").alias("a"), F.greatest("set_id", "e.set_id").alias("b"), "n", F.col("e.n").alias("m"))
    return pairs.where(close("n", "m", percent)).select("a", "b").distinct()


def verified(pairs: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link: overlaps counted by part, and summed."""
    parts = parts.where("part >= 0")
    right = parts.select(F.col("set_id").alias("b"), "part", F.col("n").alias("nb"), F.col("items").alias("_b"))
    left = parts.select(F.col("set_id").alias("a"), "part", F.col("n").alias("na"), F.col("items").alias("_a"))
    partial = pairs.join(right, "b").join(left, ["a", "part"]).select("a", "b", "na", "nb", F.size(F.array_intersect("_a", "_b")).alias("both"))
    total = partial.groupBy("a", "b", "na", "nb").agg(F.sum("both").alias("both"))
    return total.where(f"100 * both >= {percent} * (na + nb - both)").select("a", "b")


def _forest(s: np.ndarray, t: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Which of the pairs (s, t) are enough to connect all that they connect: of each label the first pair that leaves it, over
    and over, with the labels merged. label: of each set, small numbers."""
    label, left, out = label.copy(), np.arange(len(s)), []
    while True:
        left = left[label[s[left]] != label[t[left]]]
        if not len(left):
            return np.unique(np.concatenate(out)) if out else left
        a, b = label[s[left]], label[t[left]]
        first = np.unique(np.concatenate([np.unique(a, return_index=True)[1], np.unique(b, return_index=True)[1]]))
        out.append(left[first])
        root = np.arange(label.max() + 1)
        root[np.maximum(a[first], b[first])] = np.minimum(a[first], b[first])
        while (root[root] != root).any():
            root = root[root]
        label = root[label]


def cross_pairs(key_rows: DataFrame, comps: DataFrame, parts: DataFrame, percent: int, forest: bool) -> DataFrame:
    """a, b: pairs of sets with a key in common, in different components (node, component), that may link by sizes and bits; all
    of these, or (forest) of each key as many as connect what all would, the closest by bits first."""
    own = key_rows.join(comps.select(F.col("node").alias("set_id"), "component"), "set_id", "left").select("key", "set_id", "n", F.coalesce("component", "set_id").alias("comp"))
    open_keys = own.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("set_id")).alias("same")).where("x <> y")
    open_keys = open_keys.groupBy("x", "y", "k", "same").agg(F.min("key").alias("key"))  # of keys that the same sets have, one
    rows = own.join(open_keys.select("key", F.ceil(F.col("k") / BLOCK).cast("int").alias("blocks")), "key")
    bits = parts.where("part = -1").select("set_id", F.col("items").alias("bits"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int")).join(bits, "set_id")
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j")))
    rows = rows.withColumn("pair", F.explode(pair)).select("key", "pair.i", "pair.j", "own", "set_id", "n", "comp", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def found() -> Iterator[pa.RecordBatch]:
            own, sets, n, comp, bits = (np.concatenate(x) for x in zip(*held, strict=True))
            bits = bits.reshape(-1, BITS // 64).view(U)
            inner = at[1] == at[2]
            left, right = (np.arange(len(own)),) * 2 if inner else (np.flatnonzero(own == at[1]), np.flatnonzero(own == at[2]))
            pairs = []
            for x in range(0, len(left), 128):
                p = left[x : x + 128]
                a, b = n[p][:, None], n[right][None, :]
                ok = (comp[p][:, None] != comp[right][None, :]) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))
                if inner:
                    ok &= p[:, None] < right[None, :]
                u, v = np.nonzero(ok)
                u, v = p[u], right[v]
                for y in range(0, len(u), 100_000):
                    s, t = u[y : y + 100_000], v[y : y + 100_000]
                    apart = np.bitwise_count(bits[s] ^ bits[t]).sum(1, dtype=np.int64)
                    least = -(-percent * (n[s] + n[t]) // (100 + percent))  # the overlap of a link
                    may = apart <= n[s] + n[t] - 2 * least
                    pairs.append((s[may], t[may], apart[may]))
            if not pairs:
                return
            s, t, apart = (np.concatenate(x) for x in zip(*pairs, strict=True))
            if forest and len(s):
                order = np.argsort(apart, kind="stable")
                s, t = s[order], t[order]
                some = _forest(s, t, np.unique(comp, return_inverse=True)[1])
                s, t = s[some], t[some]
            s, t = sets[s], sets[t]
            if len(s):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(s, t)), pa.array(np.maximum(s, t))], ["a", "b"])

        for b in batches:
            key, i, j, own, sets, n, comp = (b.column(c).to_numpy() for c in range(7))
            bits = b.column(7).flatten().to_numpy().reshape(-1, BITS // 64)
            cuts = [*np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))).tolist(), len(key)] if len(key) else []
            for x, y in zip(cuts, cuts[1:]):  # noqa: B905
                now = key[x], i[x], j[x]
                if now != at and held:
                    yield from found()
                    held = []
                at = now
                held.append((own[x:y], sets[x:y], n[x:y], comp[x:y], bits[x:y]))
        if held:
            yield from found()

    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(K.lean(run), "a long, b long").distinct()


def merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, component), with those connected that the links (a, b) connect."""
    if links.isEmpty():
        return comps
    for c in ("a", "b"):
        links = links.join(comps.toDF(c, "_to"), c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
    whole = components(links).toDF("component", "_to")
    out = comps.join(whole, "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
    return K.written(out.unionByName(whole.toDF("node", "component")).distinct(), "components")


def join(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links lead to) of each row of docs (doc_id, text)."""
    K.bounded_batches(docs.sparkSession)
    lengths = Lengths(percent)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = K.written(sizes(docs, n), "sizes")
    named = own.where("n_shingles > 0 and doc_id is not null")
    classes = named.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"))
    # members: sets that may link, by partial counts
    total = own.agg(F.sum("n_shingles")).first()[0] or 0
    fragments = max(1, total * (110 - percent) // 100 // FRAGMENT)
    counts = shared_counts(dealt(docs.where("doc_id is not null"), n, lengths, fragments), fragments)
    may = classes.join(counts, "set_id").where(f"shared >= 1 + ((n * {percent} + 99) div 100) div 10")
    chosen = K.written(may.select(F.col("rep").alias("doc_id"), "set_id"), "chosen")
    parts = K.written(members(docs, chosen, n, lengths), "members")
    if parts.where("part = -1").count() > chosen.count():  # rows with one document id and the same set
        parts = K.written(parts.dropDuplicates(["set_id", "part"]), "members")
    key_rows = K.written(keys(parts, lengths), "keys")
    links = K.written(verified(star_pairs(key_rows, percent), parts, percent), "links")
    # a document id with several texts holds their sets together
    several = named.groupBy("doc_id").agg(F.min("set_id").alias("a"), F.max("set_id").alias("z")).where("a <> z")
    same_id = named.join(several.select("doc_id", "a"), "doc_id").where("a <> set_id").select("a", F.col("set_id").alias("b"))
    comps = components(links.unionByName(same_id))
    for forest in (True, False):
        candidates = K.written(cross_pairs(key_rows, comps, parts, percent, forest), "candidates")
        if candidates.isEmpty():
            break
        comps = merged(comps, K.written(verified(candidates, parts, percent), "more-links"))
    linked = classes.join(comps, F.col("set_id") == F.col("node"))
    smallest = linked.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_set = linked.join(smallest, "component").select("set_id", "component_id")
    out = own.join(classes.select("set_id", "rep"), "set_id", "left").join(of_set, "set_id", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "rep")).otherwise(F.col("doc_id"))).alias("component_id"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
