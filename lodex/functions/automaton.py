"""All terms of a list in many texts at once: goto and failure links of a term automaton in flat arrays.

States are numbered by depth, so the edges, keyed by state and symbol, are one rising array, and edge i leads to state i + 1.
Texts are cut into lanes that overlap by the longest term, and all lanes take a step together, so the cost is one walk of the
text however many terms there are.
"""

from __future__ import annotations

import string
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np

#: Characters of a lane, and of texts that are walked together.
LANE, BLOCK = 512, 4_000_000
#: States times symbols up to which all steps are in one table, with the failure links followed beforehand.
CELLS = 1 << 24
_WORD = np.array([chr(c) in string.ascii_letters + string.digits + "_" for c in range(0x80)] + [False])


def is_word(points: np.ndarray) -> np.ndarray:
    """Letters and digits of ASCII and the underscore."""
    return _WORD[np.minimum(points, 0x80)]


@dataclass(frozen=True)
class Automaton:
    """Of distinct terms: `symbols` numbers their characters from 1 by code point, and the last entry stands for all
    others; `fail` is each state's longest proper suffix that is a state; `term` is the term that ends at a state, or -1, and
    `also` the next state of the failure path where one ends, or 0; `whole` terms count only as whole words."""

    terms: tuple[str, ...]
    whole: np.ndarray
    symbols: np.ndarray
    width: int
    keys: np.ndarray
    fail: np.ndarray
    term: np.ndarray
    also: np.ndarray

    @cached_property
    def root(self) -> np.ndarray:
        """The state that each symbol leads to from the root."""
        out = np.zeros(self.width, np.int64)
        n = np.searchsorted(self.keys, self.width)
        out[self.keys[:n]] = np.arange(1, n + 1)
        return out

    @cached_property
    def sizes(self) -> np.ndarray:
        return np.array([len(t) for t in self.terms] or [0], np.int64)

    @cached_property
    def steps(self) -> np.ndarray | None:
        """Each state's next one for each symbol, or none where that were too many."""
        if len(self.fail) * self.width > CELLS:
            return None
        table = np.zeros((len(self.fail), self.width), np.int32)
        parents, level = self.keys // self.width, np.array([0])
        while len(level):  # a state has its suffix's steps, but for its own edges
            table[level] = table[self.fail[level]]
            edges = np.arange(*np.searchsorted(parents, [level[0], level[-1] + 1]))
            table[parents[edges], self.keys[edges] % self.width] = edges + 1
            level = edges + 1
        return table.ravel()

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The states after reading a symbol each."""
        out = self.root[symbol]
        todo = np.flatnonzero((state > 0) & (symbol > 0))
        s, c = state[todo], symbol[todo]
        while len(todo):
            key = s * self.width + c
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            out[todo[hit]] = at[hit] + 1
            s = self.fail[s]
            left = ~hit & (s > 0)  # at the root, its own edge is taken already
            todo, s, c = todo[left], s[left], c[left]
        return out

    def occurrences(self, texts: list[str]) -> np.ndarray:
        """Rows (text, start, term) of all places of all terms, in no order."""
        found = [np.zeros((0, 3), np.int64)]
        a, n = 0, 0
        for i, t in enumerate(texts):
            n += len(t)
            if n >= BLOCK or i == len(texts) - 1:
                own = self._walk(texts[a : i + 1])
                own[:, 0] += a
                found.append(own)
                a, n = i + 1, 0
        return np.concatenate(found)

    def _walk(self, texts: list[str]) -> np.ndarray:
        sizes = np.array([len(t) for t in texts], np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        symbol = self.symbols[np.minimum(points, len(self.symbols) - 1)]
        ends = np.cumsum(sizes)
        counts = -(-sizes // LANE)
        owner = np.repeat(np.arange(len(texts)), counts)
        begin = (ends - sizes)[owner] + LANE * (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts))
        first = np.maximum((ends - sizes)[owner], begin - (self.sizes.max() - 1))
        length = np.minimum(begin + LANE, ends[owner]) - first
        order = np.argsort(-length, kind="stable")
        owner, begin, first, length = owner[order], begin[order], first[order], length[order]
        state, ending = np.zeros(len(owner), np.int64), (self.term >= 0) | (self.also > 0)
        lanes, at, states = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for t in range(int(length.max(initial=0))):
            m = np.searchsorted(-length, -t)  # lanes longer than t
            state = self.step(state[:m], symbol[first[:m] + t]) if self.steps is None else self.steps[state[:m] * self.width + symbol[first[:m] + t]]
            hit = np.flatnonzero(ending[state])
            if len(hit):
                hit = hit[first[hit] + t >= begin[hit]]  # an overlap's places are the lane's before
                lanes.append(hit)
                at.append(first[hit] + t)
                states.append(state[hit])
        lane, last, state = map(np.concatenate, (lanes, at, states))
        out = []
        while len(lane):
            term = self.term[state]
            ends_here = term >= 0
            text, stop, k = owner[lane][ends_here], last[ends_here], term[ends_here]
            start, low = stop - self.sizes[k] + 1, (ends - sizes)[text]
            inside = (start > low) & is_word(points[np.maximum(start - 1, 0)]) | (stop + 1 < ends[text]) & is_word(points[np.minimum(stop + 1, len(points) - 1)])
            good = ~(self.whole[k] & inside)
            out.append(np.stack([text[good], start[good] - low[good], k[good]], axis=1))
            state = self.also[state]
            lane, last, state = lane[state > 0], last[state > 0], state[state > 0]
        return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def first_of(found: np.ndarray, rank: np.ndarray, texts: int) -> np.ndarray:
    """Of each text, the term that begins first, among those of one start the one of least rank; -1 where none occurs. Terms
    of rank -1 don't count."""
    out = np.full(texts, -1)
    found = found[rank[found[:, 2]] >= 0] if len(found) else found
    order = np.lexsort((rank[found[:, 2]], found[:, 1], found[:, 0])) if len(found) else []
    found = found[order]
    new = np.concatenate([[True], np.diff(found[:, 0]) > 0]) if len(found) else np.zeros(0, bool)
    out[found[new, 0]] = found[new, 2]
    return out


def is_whole(term: str) -> bool:
    """Terms of up to four ASCII characters count as whole words only."""
    return len(term) <= 4 and term.isascii()


@lru_cache(maxsize=16)
def automaton(terms: tuple[str, ...]) -> Automaton:
    """Of the distinct terms in small letters, without the empty one, in order."""
    known = tuple(sorted({t.lower() for t in terms if t}))
    sizes = np.array([len(t) for t in known], np.int64)
    points = np.frombuffer("".join(known).encode("utf-32-le"), np.uint32)
    used = np.unique(points)
    symbols = np.zeros(int(used.max(initial=0)) + 2, np.int32)
    symbols[used] = np.arange(1, len(used) + 1)
    width, starts = len(used) + 1, np.cumsum(sizes) - sizes
    state, levels, n = np.zeros(len(known), np.int64), [], 1
    for depth in range(int(sizes.max(initial=0))):
        own = np.flatnonzero(sizes > depth)
        keys, inverse = np.unique(state[own] * width + symbols[points[starts[own] + depth]], return_inverse=True)
        state[own] = n + inverse
        levels.append(keys)
        n += len(keys)
    term, fail, also = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64)
    term[state] = np.arange(len(known)) if len(known) else term[:0]
    out = Automaton(known, np.array([is_whole(t) for t in known], bool), symbols, width, np.concatenate([np.zeros(0, np.int64), *levels]), fail, term, also)
    n = 1
    for depth, keys in enumerate(levels):
        own, parents = np.arange(n, n + len(keys)), keys // width
        if depth:  # shallower states have their links by now
            fail[own] = out.step(fail[parents], keys % width)
        also[own] = np.where(term[fail[own]] >= 0, fail[own], also[fail[own]])
        n += len(keys)
    return out
