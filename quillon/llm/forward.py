"""Forward scores over a trie of runs, for all the new runs of a batch at once.

Runs (pre-tokens) are inserted in a trie, level by level: a node stands for a prefix and is made once for all runs that
begin so. Nodes of a level get their forward state from the nodes above: the score of the best segmentation of the
prefix, its last piece, the node before that piece, and the number of ids. In a unigram model the best has the greatest
sum of scores; in a BPE model a piece is admitted only where it may follow the last piece of the node before it, and
one segmentation is left (see ``pieces``). A run's result is the state of its last node.
"""

from __future__ import annotations

import numpy as np

from quillon.llm.pieces import BPE, Pieces

U = np.uint64
BASE = 0x5851F42D4C957F2D | 1
MOST_PAIRS = 1_000_000
#: Longer runs are left to Pieces.path.
MOST_DEPTH = 128


class Forward:
    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        ids = np.array(sorted(pieces.ids.values()))
        keys = np.array([self._hash(pieces.pieces[i]) for i in ids], U)
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], ids[order].astype(np.int64)
        if (np.diff(self.keys) == 0).any():
            raise ValueError("pieces collide")
        self.lengths = sorted({len(p) for p in pieces.ids}, reverse=True)
        self.scores = np.array(pieces.scores)
        self.pairs, self.may = np.array([-1], np.int64), np.array([False])

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h * BASE + ord(c) + 1) % (1 << 64)
        return h

    def follows(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Which pieces may follow: ids, with left -1 for the begin of a run or a character that no piece has."""
        key = (left + 1) << 20 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        if (new := np.unique(key[self.pairs[at] != key])).size:
            p = self.pieces
            if len(self.pairs) > MOST_PAIRS:  # begun anew, with all that is asked for now
                self.pairs, self.may, new = np.array([-1], np.int64), np.array([False]), np.unique(key)
            may = [p._follows(p.pieces[(k >> 20) - 1], p.pieces[k & 0xFFFFF]) if k >> 20 else p.alone(p.pieces[k]) for k in new.tolist()]
            place = np.searchsorted(self.pairs, new)
            self.pairs, self.may = np.insert(self.pairs, place, new), np.insert(self.may, place, may)
            at = np.searchsorted(self.pairs, key)
        return self.may[at]

    def solve(self, runs: list[str]) -> Solved:
        """The forward states of the runs' tries; no run is empty."""
        p = self.pieces
        bpe = p.kind == BPE
        length = np.array(list(map(len, runs)))
        chars = np.frombuffer("".join(runs).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        first = np.cumsum(length) - length
        # by node; node 0 is the root
        char = [np.zeros(1, np.int64)]
        score, last, before, n = np.zeros(1), np.full(1, -1), np.zeros(1, np.int64), np.zeros(1, np.int64)
        node = np.zeros(len(runs), np.int64)
        active = np.arange(len(runs))
        made, depth, up, h = 1, 0, np.zeros(1, np.int64), np.zeros(1, U)
        while True:
            active = active[length[active] > depth]
            if not len(active):
                break
            key, back = np.unique(node[active] << 21 | chars[first[active] + depth], return_inverse=True)
            node[active] = made + back
            above, c = key >> 21, key & 0x1FFFFF
            up = np.concatenate([up, above])
            h = np.concatenate([h, h[above] * U(BASE) + c.astype(U) + U(1)])
            depth += 1
            m = len(key)
            own = h[made:]
            best = np.full(m, -np.inf)
            got, prior, count = np.full(m, -2), np.zeros(m, np.int64), np.zeros(m, np.int64)
            anc, power = above.copy(), BASE
            ancestors = [None, (anc, U(power))]
            for _ in range(2, min(depth, self.lengths[0]) + 1):
                anc, power = up[anc], power * BASE % (1 << 64)
                ancestors.append((anc, U(power)))
            for k in self.lengths:
                if k > depth:
                    continue
                todo = np.flatnonzero(got == -2) if bpe else np.arange(m)
                anc, power = ancestors[k]
                anc = anc[todo]
                sub = own[todo] - h[anc] * power
                at = np.minimum(np.searchsorted(self.keys, sub), len(self.keys) - 1)
                ok = self.keys[at] == sub
                todo, anc, ids = todo[ok], anc[ok], self.key_ids[at[ok]]
                if not len(todo):
                    continue
                ok = self.follows(last[anc], ids) if bpe else score[anc] + self.scores[ids] > best[todo]
                todo, anc, ids = todo[ok], anc[ok], ids[ok]
                got[todo], prior[todo], count[todo] = ids, anc, n[anc] + 1
                best[todo] = 0.0 if bpe else score[anc] + self.scores[ids]
            if bpe:
                rest = np.flatnonzero(got == -2)
            else:  # a character that no piece has
                lone = np.searchsorted(self.keys, c.astype(U) + U(1))
                unknown = self.keys[np.minimum(lone, len(self.keys) - 1)] != c.astype(U) + U(1)
                rest = np.flatnonzero(unknown & (score[above] + p.unknown_score > best))
            if len(rest):
                got[rest], prior[rest] = -1, above[rest]
                best[rest] = 0.0 if bpe else score[above[rest]] + p.unknown_score
                count[rest] = n[above[rest]] + [len(p.fallback(chr(x))) for x in c[rest].tolist()]
            score, last, before, n = np.concatenate([score, best]), np.concatenate([last, got]), np.concatenate([before, prior]), np.concatenate([n, count])
            char.append(c)
            made += m
        return Solved(p, node, last, before, n, np.concatenate(char))


class Solved:
    def __init__(self, pieces: Pieces, node: np.ndarray, last: np.ndarray, before: np.ndarray, n: np.ndarray, char: np.ndarray):
        self.pieces, self.node, self.last, self.before, self.n, self.char = pieces, node, last, before, n, char

    def counts(self) -> np.ndarray:
        return self.n[self.node]

    def paths(self) -> list[bytes]:
        """The ids of each run, as little-endian 32-bit integers."""
        n = self.counts()
        ends = np.cumsum(n)
        out = np.zeros(int(ends[-1]) if len(ends) else 0, "<i4")
        at, here, place = np.arange(len(n)), self.node.copy(), ends.copy()
        while len(at):
            ids = self.last[here]
            known = ids >= 0
            place[known] -= 1
            out[place[known]] = ids[known]
            for k in np.flatnonzero(~known):
                got = self.pieces.fallback(chr(self.char[here[k]]))
                place[k] -= len(got)
                out[place[k] : place[k] + len(got)] = got
            here = self.before[here]
            more = here > 0
            at, here, place = at[more], here[more], place[more]
        raw = out.tobytes()
        ends = (ends * 4).tolist()
        return [raw[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)]
