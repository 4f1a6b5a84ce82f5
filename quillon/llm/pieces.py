"""Vocabulary of a SentencePiece model, shared by token counts and by encoding and decoding.

A model of type unigram takes the segmentation with the greatest sum of piece scores. A model of type BPE takes the
one that its merges give. Both are shortest paths over the pieces of a text; in a BPE model, each piece costs nothing
and one piece may follow another only if merging the two alone gives the two again. Exactly one path is left then.
(The scores of a BPE model are ranks of merges, so the greatest sum of them isn't its segmentation.)

A run of spaces and the characters up to the next space are segmented apart from the rest, as no piece goes on after
a space that follows another character; ``Pieces`` checks that of its model.
"""

from __future__ import annotations

import re

import numpy as np

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
INFINITY = float("inf")
SPACES = re.compile(" +")


class Normaliser:
    """The character map of a model, compiled to a transducer: at each place the longest mapped sequence is replaced, and any
    other character stays.

    The map is a double-array trie over UTF-8 bytes, whose leaves are offsets of texts that end with a zero byte."""

    def __init__(self, charsmap: bytes):
        size = int.from_bytes(charsmap[:4], "little")
        units = np.frombuffer(charsmap, "<u4", size // 4, 4).astype(np.int64)
        texts = charsmap[4 + size :]
        offset = lambda unit: unit >> 10 << ((unit & 1 << 9) >> 6)
        bytes_ = np.arange(1, 256)
        self.map: dict[str, str] = {}
        todo = [(offset(int(units[0])), b"")]
        while todo:
            at, key = todo.pop()
            near = at ^ bytes_
            near = np.where(near < len(units), near, 0)
            for c in bytes_[(units[near] & 0x800000FF) == bytes_].tolist():
                unit = int(units[at ^ c])
                below = (at ^ c) ^ offset(unit)
                if unit >> 8 & 1:
                    begin = int(units[below]) & 0x7FFFFFFF
                    self.map[(key + bytes([c])).decode()] = texts[begin : texts.index(b"\0", begin)].decode()
                todo.append((below, key + bytes([c])))
        self.lengths: dict[str, list[int]] = {}
        for key in sorted(self.map, key=len, reverse=True):
            have = self.lengths.setdefault(key[0], [])
            if len(key) not in have:
                have.append(len(key))
        self.first = re.compile("[" + "".join(map(re.escape, sorted(self.lengths))) + "]") if self.map else None

    def apply(self, text: str) -> str:
        out, at = [], 0
        while self.first is not None and (m := self.first.search(text, at)):
            i = m.start()
            n = next((n for n in self.lengths[text[i]] if text[i : i + n] in self.map), 0)
            out += [text[at:i], self.map[text[i : i + n]] if n else text[i]]
            at = i + max(n, 1)
        return "".join([*out, text[at:]]) if out else text


class Pieces:
    def __init__(self, path: str | None = None, proto: bytes | None = None):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        if proto is None:
            with open(path, "rb") as f:
                proto = f.read()
        model.ParseFromString(proto)
        self.kind = model.trainer_spec.model_type
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("the model must be of type unigram or BPE")
        spec = model.normalizer_spec
        if not spec.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("spaces must be escaped, and begin pieces")
        self.normaliser = Normaliser(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.dummy_prefix, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.pieces = [p.piece for p in model.pieces]
        self.types = [p.type for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.scores = [p.score for p in model.pieces]
        if any(p.type == USER for p in model.pieces) or any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces that go on after a space, or that the user defined, aren't supported")
        self.bytes = [self.pieces.index(f"<0x{b:02X}>") for b in range(256)] if model.trainer_spec.byte_fallback else None
        self.unknown = self.types.index(UNKNOWN)
        self.lines = not any("\n" in p for p in self.ids)
        self.longest = max(map(len, self.ids))
        #: A character that no piece has costs so much in a unigram model.
        self.unknown_score = min(self.scores[i] for i in self.ids.values()) - 10.0
        #: The pieces as an acceptor: arcs by state and character, and of each state the id of the piece that ends there, or -1.
        self.arcs: dict[int, int] = {}
        self.final = [-1]
        for piece, i in self.ids.items():
            state = 0
            for c in piece:
                key = state << 21 | ord(c)
                state = self.arcs.get(key, 0)
                if not state:
                    state = self.arcs[key] = len(self.final)
                    self.final.append(-1)
            self.final[state] = i
        self.together: dict[tuple[str, str], bool] = {}
        self.trees: dict[str, tuple[list, list] | None] = {}
        self.splits: dict[str, list[str]] = {}

    def runs(self, text: str | None) -> list[str]:
        """The normalised text in runs that are segmented apart: marks with what follows them in the line.

        The normaliser escapes spaces as marks, with one before the text if the model wants it. A line feed begins a run,
        unless some piece has one."""
        text = (text if self.normaliser is None else self.normaliser.apply(text or "")) or ""
        text = text.replace(MARK, " ")
        if self.squeeze:
            text = SPACES.sub(" ", text.strip(" "))
        if not text:
            return []
        parts = (text.replace("\n", " \n") if self.lines else text).split(" ")
        if self.dummy_prefix and "" not in parts:
            return [x if x[0] == "\n" and self.lines else MARK + x for x in parts]
        out, marks = [], "" if self.dummy_prefix else None
        for x in parts:
            marks = "" if marks is None else marks if self.lines and x[:1] == "\n" else marks + MARK
            if self.lines and x[:1] == "\n":
                out += [marks, x] if marks else [x]
                marks = ""
            elif x:
                out.append(marks + x)
                marks = ""
        return [*out, marks] if marks else out

    def fallback(self, char: str) -> list[int]:
        """Ids of a character that no piece has."""
        return [self.unknown] if self.bytes is None else [self.bytes[b] for b in char.encode("utf-8", "replace")]

    def merged(self, text: str, until: int = 1) -> list[str]:
        """The merges of a short text, the best first, of equals the leftmost, until so many parts are left."""
        parts = list(text)
        while len(parts) > until:
            best, at = None, -1
            for i in range(len(parts) - 1):
                got = self.ids.get(parts[i] + parts[i + 1])
                if got is not None and (best is None or self.scores[got] > best):
                    best, at = self.scores[got], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def tree(self, piece: str) -> tuple[list, list] | None:
        """The right and the left edge of the merges that make the piece, from the top: (part, its rank, the rank of
        what it is merged into). Lower ranks are merged first. None if merges don't make it."""
        got = self.trees.get(piece, 0)
        if got == 0:
            got = None
            if self.merged(piece) == [piece]:
                edges = ([], [])
                for edge, side in zip(edges, (1, 0), strict=True):
                    part, above = piece, INFINITY
                    while True:
                        rank = self.rank(part) if len(part) > 1 else -INFINITY
                        edge.append((part, rank, above))
                        if len(part) == 1:
                            break
                        part, above = self.split(part)[side], rank
                got = edges
            self.trees[piece] = got
        return got

    def rank(self, part: str) -> float:
        got = self.ids.get(part)
        return INFINITY if got is None else -self.scores[got]

    def split(self, piece: str) -> list[str]:
        """The two parts of the last merge that makes the piece."""
        if piece not in self.splits:
            self.splits[piece] = self.merged(piece, until=2)
        return self.splits[piece]

    def follows(self, left: str, right: str) -> bool:
        """May the piece right follow left in a BPE model? Not if the merges of one of them are met by a merge across
        the two that comes first: of a lower rank, or of the same rank and further left."""
        key = left, right
        got = self.together.get(key)
        if got is None:
            if len(self.together) > 400_000:
                self.together.clear()
            got = self.together[key] = self._follows(left, right)
        return got

    def _follows(self, left: str, right: str) -> bool:
        if left[-1] == MARK or right[0] == MARK:  # pieces of marks have one rank
            return self.merged(left + right) == [left, right]
        a, b = self.tree(left), self.tree(right)
        if a is None or b is None:
            return False
        a, b = a[0], b[1]
        i = j = 0
        while True:
            x, rank_x, above_x = a[i]
            y, rank_y, above_y = b[j]
            across = self.rank(x + y)
            if across < above_x and across <= above_y and across < INFINITY:
                return False
            if i == len(a) - 1 and j == len(b) - 1:
                return True
            if j == len(b) - 1 or (i < len(a) - 1 and rank_x >= rank_y):
                i += 1
            else:
                j += 1

    def alone(self, piece: str) -> bool:
        """Do the merges of its characters give the piece itself?"""
        return self.tree(piece) is not None

    def compose(self, run: str, i: int) -> list[tuple[int, int, float]]:
        """Arcs of the composition of a run with the pieces and byte fallback that leave position i, the longest first: (end,
        id or -1 for fallback, weight)."""
        out, state, single, free = [], 0, False, self.kind == BPE
        for j in range(i, len(run)):
            state = self.arcs.get(state << 21 | ord(run[j]), 0)
            if not state:
                break
            k = self.final[state]
            if k != -1:
                single = single or j == i
                out.append((j + 1, k, 0.0 if free else -self.scores[k]))
        if not single:
            out.insert(0, (i + 1, -1, 0.0 if free else -self.unknown_score))
        return out[::-1]

    def path(self, run: str) -> list[tuple[int, int, int]]:
        """The arcs (begin, end, id) of the tropical shortest path from 0 to the end of the run; composes as it goes."""
        return self.least_sum(run) if self.kind == UNIGRAM else self.only_path(run)

    def least_sum(self, run: str) -> list[tuple[int, int, int]]:
        best: list = [(0.0, 0, -1)] + [None] * len(run)  # by position: cost, begin, id
        for i in range(len(run)):
            cost = best[i][0]
            for j, k, w in self.compose(run, i):
                if best[j] is None or cost + w < best[j][0]:
                    best[j] = cost + w, i, k
        path, at = [], len(run)
        while at:
            _, begin, k = best[at]
            path.append((begin, at, k))
            at = begin
        return path[::-1]

    def only_path(self, run: str) -> list[tuple[int, int, int]]:
        """Weights are 0 or infinity: the first path that best-first search ends is the shortest. States that lead nowhere
        are left for good."""
        pieces, follows, end = self.pieces, self.follows, len(run)
        path: list[tuple[int, int, int]] = []
        open_arcs, nowhere = [iter(self.compose(run, 0))], set()
        while True:
            last = path[-1][2] if path else -1
            for j, k, _ in open_arcs[-1]:
                if (j, k) not in nowhere and (k == -1 or (follows(pieces[last], pieces[k]) if last != -1 else self.alone(pieces[k]))):
                    path.append((path[-1][1] if path else 0, j, k))
                    if j == end:
                        return path
                    open_arcs.append(iter(self.compose(run, j)))
                    break
            else:
                open_arcs.pop()
                _, j, k = path.pop()
                nowhere.add((j, k))
