"""Edit distances of many strings against a block of them, within a bound, in numpy.

A block of strings lies in a trie, so common beginnings are measured once.  Bit-parallel columns of the distance table
(Myers; 64 rows a word, any number of words) go down the trie level by level for several strings at once, and a branch
ends where not even its longest string can come back within the bound.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Strings times words of the trie that go down together.
TOGETHER = 1 << 18
ONE = np.uint64(1)
TOP = np.uint64(63)


def _codes(strings: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the strings, a row each, with -1 behind the end, and their lengths."""
    lengths = np.array([len(s) for s in strings], dtype=np.int64)
    out = np.full((len(strings), int(lengths.max(initial=0)) + 1), -1, dtype=np.int64)
    flat = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out, lengths


class Trie:
    """The distinct strings of a block; ``edits[n]`` is the distance allowed where the longer of two strings has length ``n``."""

    def __init__(self, strings: Sequence[str], edits: np.ndarray):
        self.edits = edits
        self.words = sorted(set(strings))
        codes, lengths = _codes(self.words)
        self.alphabet = np.unique(codes[codes >= 0])
        symbols = np.searchsorted(self.alphabet, codes)
        common = np.zeros(len(self.words), dtype=np.int64)
        if len(self.words) > 1:
            common[1:] = np.cumprod((codes[1:] == codes[:-1]) & (codes[1:] >= 0), axis=1).sum(axis=1)
        common[:1] = -1
        self.levels = []
        above, parents = np.zeros(len(self.words), dtype=np.int64), 1
        for depth in range(1, int(lengths.max(initial=0)) + 1):
            deep = lengths >= depth
            starts = deep & (common < depth)
            first = np.flatnonzero(starts)
            node = np.cumsum(starts) - 1
            begin = np.searchsorted(above[first], np.arange(parents + 1))
            word = np.full(len(first), -1, dtype=np.int64)
            ends = np.flatnonzero(lengths == depth)
            word[node[ends]] = ends
            # strings that end above the level stand between its nodes, and are shorter than any of theirs
            longest = np.maximum.reduceat(lengths, first)
            self.levels.append((begin[:-1], np.diff(begin), symbols[first, depth - 1], longest, word))
            above, parents = np.where(deep, node, -1), len(first)
        self.empty = 0 if self.words and not self.words[0] else -1

    def near(self, strings: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place in ``strings``, place in ``words``, distance) of all that are near enough."""
        together = max(1, TOGETHER // len(self.words))
        for at in range(0, len(strings), together):
            some, word, distance = (np.concatenate(x) for x in zip(*self._down(strings[at:at + together])))
            yield some + at, word, distance

    def _down(self, strings: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        codes, lengths = _codes(strings)
        parts, kinds = max(1, -(-int(lengths.max()) // 64)), len(self.alphabet)
        masks = [np.zeros((len(strings), kinds + 1), dtype=np.uint64) for _ in range(parts)]
        for place in range(codes.shape[1] - 1):
            own = np.flatnonzero(lengths > place)
            kind = np.searchsorted(self.alphabet, codes[own, place])
            kind[self.alphabet[np.minimum(kind, kinds - 1)] != codes[own, place]] = kinds  # in no string of the trie
            masks[place // 64][own, kind] |= ONE << np.uint64(place % 64)
        masks = [m.ravel() for m in masks]
        last, bit = (np.maximum(lengths, 1) - 1) // 64, ((np.maximum(lengths, 1) - 1) % 64).astype(np.uint64)
        who, node, score = np.arange(len(strings)), np.zeros(len(strings), dtype=np.int64), lengths.copy()
        up = [np.full(len(strings), ~np.uint64(0)) for _ in range(parts)]
        down = [np.zeros(len(strings), dtype=np.uint64) for _ in range(parts)]
        hit = np.flatnonzero((lengths <= self.edits[lengths]) & (self.empty >= 0))
        yield hit, np.full(len(hit), self.empty), lengths[hit]
        open_ = np.arange(len(strings))
        for depth, (begin, many, symbol, longest, word) in enumerate(self.levels, 1):
            each = many[node[open_]]
            source = np.repeat(open_, each)
            if not len(source):
                return
            child = np.arange(len(source)) + np.repeat(begin[node[open_]] - (np.cumsum(each) - each), each)
            who, score = who[source], score[source]
            slot = who * (kinds + 1) + symbol[child]
            new_up, new_down = [], []
            rising, falling = ONE, np.uint64(0)  # row 0 of the table grows with every character
            for k in range(parts):
                eq, pv, mv = masks[k][slot], up[k][source], down[k][source]
                xv = eq | mv
                eq |= falling
                xh = (((eq & pv) + pv) ^ pv) | eq
                ph, mh = mv | ~(xh | pv), pv & xh
                if parts == 1:
                    at = bit[who]
                    score += ((ph >> at) & ONE).astype(np.int64)
                    score -= ((mh >> at) & ONE).astype(np.int64)
                else:
                    at, here = bit[who], last[who] == k
                    score += np.where(here, ((ph >> at) & ONE).astype(np.int64) - ((mh >> at) & ONE).astype(np.int64), 0)
                next_rising, next_falling = (ph >> TOP, mh >> TOP) if k + 1 < parts else (None, None)
                ph = (ph << ONE) | rising
                mh = (mh << ONE) | falling
                new_up.append(mh | ~(xv | ph))
                new_down.append(ph & xv)
                rising, falling = next_rising, next_falling
            up, down, node = new_up, new_down, child
            size, reach = lengths[who], longest[child]
            if not lengths.all():
                score[size == 0] = depth
            ends = np.flatnonzero((word[child] >= 0) & (score <= self.edits[np.maximum(size, depth)]))
            if len(ends):
                yield who[ends], word[child[ends]], score[ends]
            open_ = np.flatnonzero(score - (reach - depth) <= self.edits[np.maximum(size, reach)])
