"""Words of whole texts as numpy arrays: byte spans and 64-bit hashes, straight from Arrow's text buffers."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes hashed at a time, and so the bound of the work arrays; longer words are hashed one by one.
CHUNK = 1 << 20
MULT = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
SPACED = np.ones(256, bool)  # words [^\x20\x09-\x0D]+
SPACED[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, bool)  # words [0-9a-zA-Z\x80-]+
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = True
ALNUM[128:] = True


class Words(NamedTuple):
    data: np.ndarray  # bytes of all texts
    starts: np.ndarray  # of words, in data
    ends: np.ndarray
    hashes: np.ndarray  # uint64; empty if not asked for
    offsets: np.ndarray  # words of text i: offsets[i] to offsets[i + 1]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inverse = pow(MULT, -1, 1 << 64)
    powers, inverses = np.ones(CHUNK + 1, np.uint64), np.ones(CHUNK + 1, np.uint64)
    powers[1:], inverses[1:] = np.uint64(MULT), np.uint64(inverse)
    byte = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return np.cumprod(powers, dtype=np.uint64), np.cumprod(inverses, dtype=np.uint64), byte


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts end to end, and the offset of each (null: empty)."""
    a = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if not len(a):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(a.buffers()[1], np.int64, len(a) + 1, a.offset * 8)
    data = np.frombuffer(a.buffers()[2] or b"", np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def tokenize(texts: pa.Array, is_word: np.ndarray = SPACED, fold: bool = False, hashes: bool = True) -> Words:
    data, offs = text_bytes(texts)
    mask = is_word[data]
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1]
    last[:-1] &= ~mask[1:]
    some = offs[:-1] < offs[1:]
    a, b = offs[:-1][some], offs[1:][some] - 1
    first[a], last[b] = mask[a], mask[b]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    h = hash_words(FOLD[data] if fold else data, starts, ends) if hashes else np.empty(0, np.uint64)
    return Words(data, starts, ends, h, np.searchsorted(starts, offs))


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    powers, inverses, byte = _powers()
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        a = starts[i]
        j = int(np.searchsorted(ends, a + CHUNK, "right"))
        if j <= i:
            out[i] = xxhash.xxh64_intdigest(data[a : ends[i]].tobytes())
            i += 1
            continue
        part = data[a : ends[j - 1]]
        run = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(byte[part] * powers[: len(part)], out=run[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = mixed((run[e] - run[s]) * inverses[s] + (e - s).astype(np.uint64))
        i = j
    return out


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k items from each position on; too few items: none. Built by doubling."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    acc, at, power, width = None, 0, h, 1
    while True:
        if k & width:
            acc = power if acc is None else mixed(acc[: len(power) - at] * np.uint64(MULT) + power[at : at + len(acc)][: len(power) - at])
            at += width
        if at == k:
            return acc[: len(h) - k + 1]
        power = mixed(power[:-width] * np.uint64(0xA0761D6478BD642F) + power[width:] + np.uint64(width))
        width *= 2


def within(offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Start positions of k-grams that stay inside one text, and the text of each."""
    n = np.maximum(np.diff(offsets) - k + 1, 0)
    text = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + offsets[:-1][text], text


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut to about ``limit`` bytes of text each, so that memory is bounded; a longer text stands alone."""
    for batch in batches:
        n = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False).cumsum()
        i = 0
        while i < len(n):
            j = max(i + 1, int(np.searchsorted(n, (n[i - 1] if i else 0) + limit, "right")))
            yield batch.slice(i, j - i)
            i = j


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i] + lengths[i] for every i, end to end."""
    total = np.cumsum(lengths)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(starts - (total - lengths), lengths)


def cut_by(order: np.ndarray, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(key, rows) for each distinct key of keys[order]; order sorts by key."""
    k = keys[order]
    edges = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.empty(0, int)
    for a, b in zip(edges, np.r_[edges[1:], len(k)]):
        yield int(k[a]), order[a:b]
