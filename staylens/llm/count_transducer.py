"""Weighted acyclic automata over word sequences of one to three words.

A :class:`CountTransducer` accepts word sequences and gives each its count.  It is built
level by level from sorted keys: states after one word, states after two words, and arcs
into the final state.  States after two words that have the same only arc (word and
weight) are one state.  A key is three numbers of the automaton's own sorted words in one
64-bit value, 0 for no word, so keys sort like the sequences themselves: every range of
prefixes is a slice.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import zstandard

from staylens.llm.blocks import pack_ints, unpack_ints

BITS = 21
MAX_WORDS = (1 << BITS) - 2
_LOW = np.uint64((1 << BITS) - 1)
_B1, _B2 = np.uint64(BITS), np.uint64(2 * BITS)


def key(first, second=0, third=0) -> np.ndarray:
    """Keys of the sequences with these word numbers (from 1; 0: none)."""
    a, b, c = (np.asarray(x, dtype=np.uint64) for x in (first, second, third))
    return (a << _B2) | (b << _B1) | c


def parts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The three word numbers of each key."""
    return keys >> _B2, (keys >> _B1) & _LOW, keys & _LOW


def run_starts(rising: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    if not len(rising):
        return np.zeros(0, dtype=np.int64)
    return np.concatenate([[0], np.flatnonzero(rising[1:] != rising[:-1]) + 1])


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs (sorts ``keys`` in place)."""
    keys.sort()
    at = run_starts(keys)
    return keys[at], np.diff(at, append=len(keys))


@dataclass
class CountTransducer:
    """``words`` (sorted), ``keys`` (rising) and their ``counts`` (all above 0)."""

    words: list[str]
    keys: np.ndarray
    counts: np.ndarray

    # --- building ------------------------------------------------------------------

    def part(self, start: int, end: int) -> "CountTransducer":
        """The keys from ``start`` to ``end`` with the words they use."""
        return self._with(self.keys[start:end], self.counts[start:end])

    def at_least(self, least: int) -> "CountTransducer":
        kept = self.counts >= least
        return self._with(self.keys[kept], self.counts[kept])

    def _with(self, keys: np.ndarray, counts: np.ndarray) -> "CountTransducer":
        used = np.unique(np.concatenate(parts(keys)))
        used = used[used > 0].astype(np.int64)
        number = np.zeros(len(self.words) + 1, dtype=np.uint64)
        number[used] = np.arange(1, len(used) + 1)
        return CountTransducer([self.words[i - 1] for i in used.tolist()],
                               key(*(number[p.astype(np.int64)] for p in parts(keys))), counts)

    def renumbered(self, words: list[str], number: dict[str, int]) -> "CountTransducer":
        """The same sequences over other sorted words, which hold all of this one's."""
        to = np.zeros(len(self.words) + 1, dtype=np.uint64)
        to[1:] = np.fromiter(map(number.__getitem__, self.words), np.uint64, len(self.words))
        return CountTransducer(words, key(*(to[p.astype(np.int64)] for p in parts(self.keys))),
                               self.counts)

    @staticmethod
    def union(many: Iterable["CountTransducer"]) -> "CountTransducer":
        """Every sequence of any of them, counts summed."""
        many = list(many)
        if len(many) == 1:
            return many[0]
        words = sorted(set().union(*(t.words for t in many)))
        if len(words) > MAX_WORDS:
            raise ValueError("a range of prefixes holds too many words; use more partitions")
        number = {w: i for i, w in enumerate(words, 1)}
        many = [t.renumbered(words, number) for t in many]
        keys = np.concatenate([t.keys for t in many] or [np.zeros(0, np.uint64)])
        counts = np.concatenate([t.counts for t in many] or [np.zeros(0, np.int64)])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        at = run_starts(keys)
        return CountTransducer(words, keys[at], np.add.reduceat(counts, at) if len(at) else counts)

    # --- composing --------------------------------------------------------------------

    def compose(self, asked: "CountTransducer") -> "CountTransducer":
        """The sequences of ``asked`` that this automaton accepts, with its counts."""
        number = {w: i for i, w in enumerate(self.words, 1)}
        to = np.array([0, *(number.get(w, 0) for w in asked.words)], dtype=np.uint64)
        triples = parts(asked.keys)
        mapped = [to[p.astype(np.int64)] for p in triples]
        known = ~np.any([(p > 0) & (m == 0) for p, m in zip(triples, mapped)], axis=0)
        keys = key(*mapped)
        at = np.searchsorted(self.keys, keys)
        known &= at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        return CountTransducer(asked.words, asked.keys[known], self.counts[at[known]])

    def cut(self, bound: tuple[str, str, str]) -> int:
        """How many keys lie before the sequence ``bound`` ('' for no word)."""
        value = 0
        for level, word in enumerate(bound):
            shift = BITS * (2 - level)
            if not word:
                break
            i = bisect_left(self.words, word)
            value |= (i + 1) << shift
            if i == len(self.words) or self.words[i] != word:
                break
        return int(np.searchsorted(self.keys, np.uint64(value)))

    # --- storing -------------------------------------------------------------------------

    def dumps(self) -> bytes:
        """The automaton as packed arrays, one after the other: words; arcs out of the start state;
        arcs out of the states after one word, with the states they lead to; states after
        two words and their arcs into the final state."""
        one, two, three = parts(self.keys)
        pairs = self.keys >> _B1
        heads1, heads2 = run_starts(one), run_starts(pairs)
        heads2 = heads2[two[heads2] > 0]
        single, double = (two == 0), (two > 0) & (three == 0)
        weight1 = np.where(single[heads1], self.counts[heads1], 0)
        weight2 = np.where(double[heads2], self.counts[heads2], 0)
        fan1 = np.bincount(np.searchsorted(heads1, heads2, "right") - 1, minlength=len(heads1))
        arcs = np.flatnonzero(three > 0)
        fan2 = np.bincount(np.searchsorted(heads2, arcs, "right") - 1, minlength=len(heads2))
        state, sizes, first = self._states(fan2, three[arcs], self.counts[arcs])
        own = _ranges(first, sizes)
        words = zstandard.compress(" ".join(self.words).encode(), 1)
        packed = [words, *map(pack_ints, (
            one[heads1], weight1, fan1, two[heads2], weight2, state, sizes, three[arcs][own],
            self.counts[arcs][own]))]
        return np.array([len(p) for p in packed], dtype="<u8").tobytes() + b"".join(packed)

    @staticmethod
    def _states(fan: np.ndarray, word: np.ndarray, weight: np.ndarray):
        """A state for each place (0: no arcs): equal single arcs are one state.  Also the
        states' numbers of arcs, and where the arcs of each state first stand."""
        start = np.cumsum(fan) - fan
        state = np.zeros(len(fan), dtype=np.int64)
        lone = np.flatnonzero(fan == 1)
        pair = np.stack([word[start[lone]].astype(np.int64), weight[start[lone]]], axis=1)
        order = np.lexsort(pair.T)
        fresh = np.ones(len(lone), dtype=bool)
        fresh[1:] = np.any(pair[order][1:] != pair[order][:-1], axis=1)
        state[lone[order]] = np.cumsum(fresh)
        many = np.flatnonzero(fan > 1)
        state[many] = int(fresh.sum()) + 1 + np.arange(len(many))
        made = np.concatenate([lone[order][fresh], many])
        return state, fan[made], start[made]

    @classmethod
    def loads(cls, data: bytes) -> "CountTransducer":
        ends = np.cumsum([80, *np.frombuffer(data[:80], "<u8").tolist()]).tolist()
        packed = [data[a:b] for a, b in zip(ends, ends[1:])]
        text = zstandard.decompress(packed[0]).decode()
        (word1, weight1, fan1, word2, weight2, state, sizes, word3, weight3) = \
            map(unpack_ints, packed[1:])
        first = np.concatenate([[0], np.cumsum(sizes) - sizes]).astype(np.int64)
        sizes = np.concatenate([[0], sizes])
        of1 = np.repeat(word1, fan1)
        own = _ranges(first[state], sizes[state])
        times = sizes[state]
        keys = np.concatenate([key(word1), key(of1, word2),
                               key(np.repeat(of1, times), np.repeat(word2, times), word3[own])])
        counts = np.concatenate([weight1, weight2, weight3[own]])
        keys, counts = keys[counts > 0], counts[counts > 0]
        order = np.argsort(keys, kind="stable")
        return cls(text.split(" ") if text else [], keys[order], counts[order])

    def sequences(self) -> list[str]:
        """The accepted sequences, words joined by a space."""
        words = ["", *self.words]
        a, b, c = (p.tolist() for p in parts(self.keys))
        return [" ".join(words[i] for i in t if i) for t in zip(a, b, c)]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, ``size`` numbers each."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)
