"""Compressed FM-index of one shard of word ids: wavelet-matrix ranks, backward search, matching statistics of streamed
sequences, sampled suffix positions (numpy). Kept are bit vectors with 32-bit counts and every ``sample``-th position;
the suffix order itself goes once the index is built."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


class Bits:
    """A bit vector with rank: 64-bit words and a count before each."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(np.r_[bits, np.zeros(64 + (-len(bits)) % 64, bool)], bitorder="little")
        self.words = packed.view(np.uint64)
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words[:-1]), dtype=np.int64)].astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        w = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w].astype(np.int64) + np.bitwise_count(self.words[w] & low)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)

    def at_or_before(self, i: np.ndarray) -> np.ndarray:
        """The last one at or before i; there must be one."""
        w = i >> 6
        word = self.words[w] & (ALL >> (np.uint64(63) - (i & 63).astype(np.uint64)))
        while (todo := np.flatnonzero(word == 0)).size:
            w[todo] -= 1
            word[todo] = self.words[w[todo]]
        high = (word >> np.uint64(32)).astype(np.int64)
        top = np.frexp(np.where(high > 0, high, (word & np.uint64(0xFFFFFFFF)).astype(np.int64)).astype(np.float64))[1] - 1
        return (w << 6) + top + np.where(high > 0, 32, 0)

    def at_or_after(self, i: np.ndarray) -> np.ndarray:
        """The first one at or after i; there must be one."""
        w = i >> 6
        word = self.words[w] & (ALL << (i & 63).astype(np.uint64))
        while (todo := np.flatnonzero(word == 0)).size:
            w[todo] += 1
            word[todo] = self.words[w[todo]]
        return (w << 6) + np.frexp((word & (~word + np.uint64(1))).astype(np.float64))[1] - 1


class Wavelet:
    """Wavelet matrix over symbols 0 .. sigma - 1."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.levels: list[tuple[int, Bits, int]] = []
        seq = seq.astype(np.int32)
        for shift in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            bit = (seq >> shift) & 1 == 1
            zeros = len(seq) - int(bit.sum())
            self.levels.append((shift, Bits(bit), zeros))
            seq = np.r_[seq[~bit], seq[bit]]
        self.base = np.zeros(sigma, np.int64)
        self.base = self.rank(np.arange(sigma), np.zeros(sigma, np.int64))

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c before position i."""
        at = i
        for shift, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = np.where((c >> shift) & 1, zeros + ones, at - ones)
        return at - self.base[c]

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at i and its occurrences before i."""
        at, c = i, np.zeros(len(i), np.int64)
        for shift, bits, zeros in self.levels:
            one, ones = bits.get(at), bits.rank(at)
            c |= one.astype(np.int64) << shift
            at = np.where(one, zeros + ones, at - ones)
        return c, at - self.base[c]


def suffix_order(rank: np.ndarray) -> np.ndarray:
    """Suffixes by prefix doubling; only those that still share their prefix are sorted again. A rank that occurs once
    ends every comparison, and the last symbol's must."""
    n = len(rank)
    active = np.argsort(rank, kind="stable")
    key, old, rank = rank[active], np.zeros(n, np.int64), np.empty(n, np.int64)
    step = 0
    while len(active):
        if step:
            old = rank[active]
            key = old * n + rank[active + step]
            order = np.argsort(key)
            active, key, old = active[order], key[order], old[order]
        at = np.arange(len(active))
        new = np.r_[True, key[1:] != key[:-1]]
        head = np.maximum.accumulate(np.where(new, at, 0))
        group = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], at, 0))
        rank[active] = old + head - group
        active = active[~(new & np.r_[new[1:], True])]
        step = max(1, 2 * step)
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


class Matches(NamedTuple):
    """Of every window of the streamed sequences: its sequence, its start there, and the suffix interval of the window
    ``shift`` words further right whose occurrences it shares (each ``shift`` words further left)."""

    seq: np.ndarray
    start: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    shift: np.ndarray


class FMIndex:
    """Index of sequences of ids (0 .. words - 1) laid end to end; ``lengths`` are those of the sequences.

    Each sequence ends in a separator that sorts below all words and, among separators, by position, so no match
    crosses it. Symbol 0 of the BWT stands for every separator. ``depth``: mark, too, the suffix rows that differ from
    the one before in their first ``depth`` words, so that an interval can be widened to fewer words.
    """

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, words: int, depth: int = 0, sample: int = 8):
        seqs, n = len(lengths), len(ids) + len(lengths)
        self.n, self.words = n, words
        ends = np.cumsum(lengths + 1) - 1
        self.begins = ends - lengths
        rank = np.empty(n, np.int64)
        inner = np.ones(n, bool)
        inner[ends] = False
        rank[ends] = np.arange(seqs)
        rank[inner] = ids + seqs
        text = np.zeros(n, np.int32)
        text[inner] = ids + 1
        sa = suffix_order(rank) if n else np.empty(0, np.int64)
        bwt = text[sa - 1]
        self.wavelet = Wavelet(bwt, words + 1)
        self.before = np.r_[0, np.cumsum(np.bincount(text, minlength=words + 1))][:-1]
        first = np.zeros(n, bool)
        first[self.begins] = True
        marked = (sa % sample == 0) | first[sa]
        self.marks, self.sampled = Bits(marked), sa[marked].astype(np.int32)
        if depth:
            self.runs = Bits(np.r_[True, bwt[1:] != bwt[:-1]])
            edge = np.zeros(n + 1, bool)
            edge[0] = edge[n] = True
            for j in range(depth):  # rows that agree so far; a separator agrees with nothing
                same = np.flatnonzero(~edge[1:n]) + 1
                a, b = text[np.minimum(sa[same] + j, n - 1)], text[np.minimum(sa[same - 1] + j, n - 1)]
                edge[same[(a != b) | (a == 0)]] = True
            self.edges = Bits(edge)

    def step(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals after one word more to the left."""
        return self.before[c] + self.wavelet.rank(c, lo), self.before[c] + self.wavelet.rank(c, hi)

    def search(self, ids: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of all patterns, ids[at : at + length]; id -1 occurs nowhere."""
        lo, hi = np.zeros(len(lengths), np.int64), np.full(len(lengths), self.n, np.int64)
        for j in range(int(lengths.max(initial=0)) - 1, -1, -1):
            live = np.flatnonzero((j < lengths) & (lo < hi))
            c = ids[at[live] + j].astype(np.int64) + 1
            hi[live[c == 0]] = lo[live[c == 0]]
            live, c = live[c > 0], c[c > 0]
            lo[live], hi[live] = self.step(c, lo[live], hi[live])
        return lo, hi

    def matches(self, ids: np.ndarray, lengths: np.ndarray, width: int) -> Matches:
        """Matching statistics cut at ``width`` words (the index's depth + 1) of sequences that the index holds too.

        Every sequence is streamed from its end: the interval of the last width - 1 words is narrowed by the word to
        their left, reported, and widened again by dropping the word to the right. An interval of one row is the
        sequence itself, so nothing else matches so many words there.
        """
        ends = np.cumsum(lengths)
        lo, hi = np.zeros(len(lengths), np.int64), np.full(len(lengths), self.n, np.int64)
        head_lo, head_hi, shift = lo.copy(), lo.copy(), lo.copy()
        out: list[list[np.ndarray]] = []
        live = np.argsort(-lengths, kind="stable")
        for step in range(int(lengths.max(initial=0))):
            live = live[: np.searchsorted(-lengths[live], -step)]  # those with more than ``step`` words
            c = ids[ends[live] - 1 - step].astype(np.int64) + 1
            a, b = lo[live], hi[live]
            new = self.before[c] + self.wavelet.rank(c, a)
            alike = self.runs.rank(a + 1) == self.runs.rank(b)  # all have the same word to their left
            to = new + b - a
            mixed = np.flatnonzero(~alike)
            to[mixed] = self.before[c[mixed]] + self.wavelet.rank(c[mixed], b[mixed])
            if step + 1 < width:
                lo[live], hi[live] = new, to
                continue
            still = alike & (b - a == head_hi[live] - head_lo[live]) & (step >= width)
            head_lo[live], head_hi[live] = np.where(still, head_lo[live], new), np.where(still, head_hi[live], to)
            shift[live] = np.where(still, shift[live] + 1, 0)
            out.append([live, lengths[live] - 1 - step, head_lo[live], head_hi[live], shift[live]])
            lo[live], hi[live] = self.edges.at_or_before(new), self.edges.at_or_after(to)
        return Matches(*(np.concatenate(x) for x in zip(*out))) if out else Matches(*[np.empty(0, np.int64)] * 5)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walk left to the next sampled one."""
        out, walked, live = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        rows = rows.copy()
        while len(live):
            hit = self.marks.get(rows)
            out[live[hit]] = self.sampled[self.marks.rank(rows[hit])] + walked
            live, rows = live[~hit], rows[~hit]
            c, before = self.wavelet.access(rows)
            rows = self.before[c] + before
            walked += 1
        return out
