"""Removal of repeated byte passages by suffix arrays of shards.

A window is ``width`` consecutive bytes of one text. Every window that also starts elsewhere is removed, all of its
copies included. Hashes only route: windows have equal anchors (their least ``GRAM``-byte hash) if they are equal.

1. Anchors are counted over the different texts. An anchor that one text holds once ties its windows to nothing.
2. Texts meet by hash, so copies of a text are one (and repeat each other whole). Stretches of windows of a repeated
   anchor go to the anchor's shard, once for all places of one task that hold the same bytes. Windows of very common
   anchors go in stretches of ``SUB``, to the shard of the bytes that all windows of the stretch share.
3. A shard sorts the suffixes of its different stretches, a block of bounded size at a time (Larsson-Sadakane), takes
   common prefixes (Kasai), and merges blocks by binary search of each block's windows in the other suffix arrays.
4. Removal spans are cut from the whole texts that were sent to a shard; other texts never move again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._stage import release, staged, table
from ._words import CHUNK, MULT, _powers, cut_by, mixed, pieces, ragged, text_bytes

GRAM = 200
#: Windows of a stretch at most; of a stretch of a very common anchor.
STRETCH, SUB = 256, 16
#: Different texts with an anchor, in a piece or in all, beyond which it is very common.
HOT_HERE, HOT = 32, 4096
#: Characters of text for each anchor bucket, each shard, and each group of texts.
BUCKET_CHARS, SHARD_CHARS, PART_CHARS = 16 << 20, 4 << 20, 16 << 20
#: Bytes of a block, which has a suffix array of its own.
BLOCK = 512 << 10
SEPARATOR = 0xFF  # in no UTF-8 text

FLAGS = "part long, refs binary, cells binary, hots binary"
COUNTED = "bucket long, low binary, ref binary, twice binary, hot binary, " + FLAGS
TEXTS = "part long, ref long, ids array<long>, _text string"
SENT = "shard long, part long, lengths binary, cells binary, body binary, seg binary, uid binary, start binary, copies binary, own long, ids array<long>, n_bytes long, n_removed long, n_spans long, sha string, _text string"
SPANS = "part long, uids binary, begins binary, ends binary"
RESULT = "k long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
_TYPES = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}


def _table(schema: str, rows: list[dict]) -> pa.Table:
    fields = [x.split() for x in schema.split(", ")]
    return pa.table({n: pa.array([r.get(n) for r in rows], _TYPES[t]) for n, t in fields})


def _sliding(x: np.ndarray, n: int, best=np.minimum) -> np.ndarray:
    """Best of the n values from each position on."""
    width = 1
    while 2 * width <= n:
        x, width = best(x[:-width], x[width:]), 2 * width
    return best(x[: len(x) - (n - width)], x[n - width :]) if n > width else x


class Anchored:
    """Anchors of the windows that start in one bounded part of some texts laid end to end."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, at: int, stop: int, width: int, buckets: int):
        part = data[at : min(len(data), stop + width - 1)]
        powers, inverses, byte = _powers()
        self.at, self.inverses = at, inverses
        self.run = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(byte[part] * powers[: len(part)], out=self.run[1:])
        self.buckets = buckets
        self.n = max(0, len(part) - width + 1)
        first, last = np.searchsorted(offs, [at, at + self.n], "right")
        edges = np.clip(offs[first - 1 : last + 1], at, at + self.n) - at
        text = np.repeat(np.arange(first - 1, first - 1 + len(edges) - 1), np.diff(edges))
        self.text = text
        self.valid = np.arange(at, at + self.n) + width <= offs[text + 1] if self.n else np.empty(0, bool)
        if not self.valid.any():
            self.least = np.zeros(self.n, np.uint64)
            self.places = np.empty(0, np.int64)
            self.values = np.empty(0, np.uint64)
            return
        grams = self.hashes(np.arange(len(part) - GRAM + 1), GRAM) | np.uint64(1)
        reach = width - GRAM + 1
        self.least = np.where(self.valid, _sliding(grams, reach), np.uint64(0))
        none = np.zeros(reach - 1, np.uint64)
        self.places = np.flatnonzero(_sliding(np.r_[none, self.least, none], reach, np.maximum) == grams)
        self.values = grams[self.places]

    def hashes(self, start: np.ndarray, length: int) -> np.ndarray:
        return mixed((self.run[start + length] - self.run[start]) * self.inverses[start] + np.uint64(length * MULT & 0xFFFFFFFF))

    def cells(self, values: np.ndarray) -> np.ndarray:
        """The bucket of a hash and 32 bits of it."""
        return (((values >> np.uint64(32)) % np.uint64(self.buckets)) << np.uint64(32) | (values & np.uint64(0xFFFFFFFF))).astype(np.int64)


def anchored(data: np.ndarray, offs: np.ndarray, width: int, buckets: int) -> Iterator[Anchored]:
    step = CHUNK - width
    for at in range(0, len(data), step):
        yield Anchored(data, offs, at, min(len(data), at + step), width, buckets)


def _flag_rows(ref: np.ndarray, cell: np.ndarray, hot: np.ndarray, parts: int, **more) -> Iterator[dict]:
    part = ref % parts
    for p, i in cut_by(np.argsort(part, kind="stable"), part):
        yield {"part": p, "refs": ref[i].tobytes(), "cells": cell[i].tobytes(), "hots": hot[i].tobytes(), **{k: p % v for k, v in more.items()}}


def _counting(width: int, buckets: int, parts: int):
    """Anchors of the different texts of a piece, by bucket; those common in the piece at once as flags of its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            refs, first = np.unique(batch.column(0).to_numpy(), return_index=True)
            data, offs = text_bytes(batch.column(1).take(pa.array(first)))
            found = [(a.cells(a.values), np.searchsorted(offs, a.places + a.at, "right") - 1) for a in anchored(data, offs, width, buckets)]
            cell, text = (np.concatenate(x) if found else np.empty(0, np.int64) for x in (zip(*found) if found else ((), ())))
            order = np.lexsort((text, cell))
            cell, text = cell[order], text[order]
            new = np.r_[True, (cell[1:] != cell[:-1]) | (text[1:] != text[:-1])] if len(cell) else np.empty(0, bool)
            head = np.flatnonzero(new)
            cell, text, twice = cell[head], text[head], np.diff(np.r_[head, len(cell)]) > 1
            ref = refs[text]
            values, counts = np.unique(cell, return_counts=True)
            common = values[counts > HOT_HERE]
            hot = np.isin(cell, common)
            rows = list(_flag_rows(ref[hot], cell[hot], np.ones(int(hot.sum()), bool), parts, bucket=buckets))
            known = {b: common[i].astype(np.uint32).tobytes() for b, i in cut_by(np.arange(len(common)), common >> 32)}
            cell, ref, twice = cell[~hot], ref[~hot], twice[~hot]
            for b, i in cut_by(np.arange(len(cell)), cell >> 32):
                rows.append({"bucket": b, "low": cell[i].astype(np.uint32).tobytes(), "ref": ref[i].tobytes(), "twice": twice[i].tobytes(), "hot": known.pop(b, None)})
            rows += [{"bucket": b, "low": b"", "ref": b"", "twice": b"", "hot": f} for b, f in known.items()]
            yield from _table(COUNTED, rows).to_batches()

    return run


def _joined(t: pa.Table, column: str, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in t.column(column).to_pylist() if x), dtype)


def _repeated_anchors(parts: int):
    """Of one bucket: flags of the texts whose anchors occur again, in another text or in the same."""

    def run(group: pa.Table) -> pa.Table:
        names = [x.split()[0] for x in FLAGS.split(", ")]
        done, posts = group.filter(group.column("part").is_valid()).select(names), group.filter(group.column("part").is_null())
        low, ref, twice, common = _joined(posts, "low", np.uint32), _joined(posts, "ref", np.int64), _joined(posts, "twice", bool), np.unique(_joined(posts, "hot", np.uint32))
        order = np.lexsort((ref, low))
        low, ref, twice = low[order], ref[order], twice[order]
        one = np.r_[True, (low[1:] != low[:-1]) | (ref[1:] != ref[:-1])] if len(low) else np.empty(0, bool)  # copies of a text count once
        low, ref, twice = low[one], ref[one], twice[one]
        _, at = np.unique(low, return_inverse=True)
        n, again = np.bincount(at), np.bincount(at, twice) > 0
        hot = (n[at] > HOT) | np.isin(low, common)
        again = hot | (n[at] > 1) | again[at]
        cell = low.astype(np.int64) | (group.column("bucket")[0].as_py() << 32)
        own = _table(FLAGS, list(_flag_rows(ref[again], cell[again], hot[again], parts)))
        return pa.concat_tables([done.cast(own.schema), own])

    return run


def _collapsing(parts: int):
    """Texts with the ids that hold them: a row for each different text of a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            ref, k = batch.column(0).to_numpy(), batch.column(2).to_pylist()
            _, first, of = np.unique(ref, return_index=True, return_inverse=True)
            texts = batch.column(1)
            same, alone = [[] for _ in first], []
            for i, g in enumerate(of.tolist()):
                if i == first[g] or texts[i] == texts[int(first[g])]:
                    same[g].append(k[i])
                else:
                    alone.append(i)
            rows = [*zip(first.tolist(), same), *((i, [k[i]]) for i in alone)]
            at = [i for i, _ in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ref[at] % parts, pa.int64()), pa.array(ref[at], pa.int64()), pa.array([ids for _, ids in rows], pa.list_(pa.int64())), texts.take(pa.array(at, pa.int64()))],
                names=["part", "ref", "ids", "_text"],
            )

    return run


class Outbox:
    """Stretches of one group of texts for their shards: equal bytes once, with all their places."""

    def __init__(self, part: int, shards: int):
        self.part, self.shards = part, shards
        self.boxes: dict[int, tuple[dict[tuple[int, bytes], int], list[tuple[int, int, int, int]]]] = {}

    def add(self, cell: int, body: bytes, uid: int, start: int, copies: int) -> None:
        known, places = self.boxes.setdefault(cell % self.shards, ({}, []))
        places.append((known.setdefault((cell, body), len(known)), uid, start, copies))

    def rows(self) -> Iterator[dict]:
        for shard, (known, places) in self.boxes.items():
            seg, uid, start, copies = np.array(places, np.int64).T
            cells, bodies = zip(*known)
            packed = lambda x: np.ascontiguousarray(x, np.int64).tobytes()
            yield {"shard": shard, "part": self.part, "lengths": packed([len(b) for b in bodies]), "cells": packed(cells), "body": b"".join(bodies), "seg": packed(seg), "uid": packed(uid), "start": packed(start), "copies": packed(copies)}


def _sending(width: int, buckets: int, shards: int, texts: bool):
    """Of one group of texts: what is known of each, and stretches of its windows of repeated anchors."""

    def run(group: pa.Table, flags: pa.Table) -> pa.Table:
        if not len(group):
            return _table(SENT, [])
        part = group.column("part")[0].as_py()
        ref, cell, hot = _joined(flags, "refs", np.int64), _joined(flags, "cells", np.int64), _joined(flags, "hots", bool)
        order = np.lexsort((cell, ref))
        ref, cell, hot = ref[order], cell[order], hot[order]
        box, uid = Outbox(part, shards), {}
        owners: list[list[int]] = []  # rows of each different text
        column, refs = group.column("_text").combine_chunks(), group.column("ref").to_pylist()
        for i, r in enumerate(refs):
            for u in uid.setdefault(r, []):
                if column[owners[u][0]] == column[i]:
                    owners[u].append(i)
                    break
            else:
                uid[r].append(len(owners))
                owners.append([i])
        ids = group.column("ids").to_pylist()
        copies = [sum(len(ids[i]) for i in own) for own in owners]
        sent = np.zeros(len(owners), bool)
        batch = pa.RecordBatch.from_arrays([pa.array([own[0] for own in owners]), column.take(pa.array([own[0] for own in owners]))], names=["i", "_text"])
        done, rows = 0, []
        for piece in pieces(iter([batch]), "_text"):
            data, offs = text_bytes(piece.column(1))
            own = [refs[i] for i in piece.column(0).to_pylist()]
            a, b = np.searchsorted(ref, own, "left"), np.searchsorted(ref, own, "right")
            for anchors in anchored(data, offs, width, buckets):
                _stretches(anchors, data, offs, width, cell, hot, a, b, done, copies, box, sent)
            for u in range(done, done + len(piece)):
                text, n = column[owners[u][0]].as_py(), int(offs[u - done + 1] - offs[u - done])
                gone = copies[u] > 1
                known = {"part": part, "own": u, "n_bytes": n, "n_removed": n if gone else 0, "n_spans": int(gone), "sha": hashlib.sha256(b"" if gone else text.encode()).hexdigest()}
                rows += [known | {"ids": ids[i], "_text": text if (sent[u] or texts) and not gone else None} for i in owners[u]]
            done += len(piece)
        return _table(SENT, [*rows, *box.rows()])

    return run


def _stretches(t: Anchored, data, offs, width, cell, hot, a, b, done: int, copies: list[int], box: Outbox, sent: np.ndarray) -> None:
    """Put the stretches of repeated anchors into the outbox and mark their texts as sent."""
    new = np.flatnonzero(np.r_[True, (t.least[1:] != t.least[:-1]) | (t.text[1:] != t.text[:-1])]) if t.n else np.empty(0, np.int64)
    count = np.diff(np.r_[new, t.n])
    new, count = new[t.valid[new]], count[t.valid[new]]
    text, value = t.text[new], t.cells(t.least[new])
    edge = np.searchsorted(text, np.arange(len(offs)))
    for d in np.flatnonzero((a < b) & (edge[1:] > edge[:-1])):
        part = slice(edge[d], edge[d + 1])
        at = np.searchsorted(cell[a[d] : b[d]], value[part])
        at[at == b[d] - a[d]] = 0
        again = cell[a[d] : b[d]][at] == value[part]
        common = hot[a[d] : b[d]][at]
        for s, n, c, often in zip(new[part][again].tolist(), count[part][again].tolist(), value[part][again].tolist(), common[again].tolist()):
            cuts = zip(*_common(t, s, n, width)) if often else ((s + x, min(STRETCH, n - x), c) for x in range(0, n, STRETCH))
            for first, m, own in cuts:
                begin = t.at + first
                box.add(own, data[begin : begin + m - 1 + width].tobytes(), done + int(d), int(begin - offs[d]), copies[done + d])
            sent[done + d] = True


def _common(t: Anchored, s: int, n: int, width: int) -> tuple[list[int], list[int], list[int]]:
    """The n windows from s on, of one very common anchor, in stretches of up to ``SUB`` whose bytes from the last window's
    start to the first one's end are the same wherever any of the windows occurs: (first, count, cell)."""
    window = np.arange(s, s + n)
    place = np.searchsorted(t.places, window)
    while len(wrong := np.flatnonzero(t.values[place] != t.least[window])):
        place[wrong] += 1
    anchor = t.places[place]
    group = (anchor - window) // SUB
    first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (group[1:] != group[:-1])])
    core = anchor[first] - SUB * group[first]  # the last window that a whole stretch can have
    cell = t.hashes(core, width - SUB + 1) ^ mixed(group[first].astype(np.uint64))
    return (s + first).tolist(), np.diff(np.r_[first, n]).tolist(), (cell >> np.uint64(1)).astype(np.int64).tolist()


class SuffixArray:
    """Suffixes of byte strings laid end to end, sorted by their first ``width`` bytes or more."""

    def __init__(self, bodies: list[bytes], width: int):
        sep = bytes([SEPARATOR])
        self.width, sizes = width, np.array([len(b) + 1 for b in bodies])
        self.text = np.frombuffer(sep.join(bodies) + sep, np.uint8)
        self.n = len(self.text)
        self.seg = np.repeat(np.arange(len(bodies), dtype=np.int32), sizes)
        self.room = (np.repeat(np.cumsum(sizes) - 1, sizes) - np.arange(self.n)).astype(np.int32)  # bytes up to the separator
        padded = np.r_[self.text, np.full(7, SEPARATOR, np.uint8)]
        self.word = np.zeros(self.n, np.uint64)
        for j in range(8):
            self.word = self.word << np.uint64(8) | padded[j : j + self.n].astype(np.uint64)
        self.order = self._sorted()
        self.repeated = self._repeated(self._common_prefixes())

    def _sorted(self) -> np.ndarray:
        """Larsson-Sadakane: only suffixes that still share a rank are sorted again, by the rank of what follows."""
        n, step = self.n, 8
        active = np.argsort(self.word, kind="stable")
        key, old, rank = self.word[active], np.zeros(n, np.int64), np.full(n + 1, n)  # the end sorts last, as in the words of eight bytes
        while len(active):
            at = np.arange(len(active))
            other = np.r_[True, old[1:] != old[:-1]]
            new = other | np.r_[True, key[1:] != key[:-1]]
            rank[active] = old + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(other, at, 0))
            if step >= self.width:
                break
            active = active[~(new & np.r_[new[1:], True])]
            old, key = rank[active], rank[np.minimum(active + step, n)]
            order = np.argsort(old * (n + 1) + key)
            active, key, old = active[order], key[order], old[order]
            step *= 2
        order = np.argsort(rank[:n], kind="stable")
        same = rank[order[1:]] == rank[order[:-1]]  # in all that was compared; these are in no order
        self.tied, self.first = np.zeros((2, n), bool)
        self.tied[order[1:][same]] = True
        self.first[order[np.r_[same, False] & ~np.r_[False, same]]] = True
        return order.astype(np.int32)

    def _agree(self, i: np.ndarray, j: np.ndarray, known: np.ndarray, other: "SuffixArray | None" = None) -> np.ndarray:
        """Common bytes of the suffixes i and j (of ``other``), at least ``known``, up to ``width`` and to a separator."""
        other = other or self
        out = known.copy()
        most = np.minimum(np.minimum(self.room[i], other.room[j]), self.width)
        live = np.flatnonzero(out < most)
        while len(live):
            x = self.word[i[live] + out[live]] ^ other.word[j[live] + out[live]]
            same = np.full(len(live), 8)
            for b in range(8):
                same[x >= np.uint64(1) << np.uint64(8 * b)] = 7 - b
            out[live] += same
            live = live[(same == 8) & (out[live] < most[live])]
        return np.minimum(out, most)

    def _common_prefixes(self) -> np.ndarray:
        """Kasai: a suffix shares at most one byte less with its neighbour than the suffix one to the left; here first
        for every 64th place, then for the places between, halving the distance."""
        before = np.full(self.n, -1, np.int64)
        before[self.order[1:]] = self.order[:-1]
        found, step = np.zeros(self.n, np.int64), 64
        places = np.arange(0, self.n, step)
        known = np.zeros(len(places), np.int64)
        while True:
            known[self.tied[places]] = self.width
            i = before[places] >= 0
            found[places[i]] = self._agree(places[i], before[places[i]], known[i])
            if step == 1:
                break
            step //= 2
            places = np.arange(step, self.n, 2 * step)
            known = np.where(self.first[places] | self.tied[places - step], 0, np.maximum(found[places - step] - step, 0))
        return found[self.order]

    def _repeated(self, common: np.ndarray) -> np.ndarray:
        """Which places start ``width`` bytes that start in another place too."""
        near = np.flatnonzero(common >= self.width)
        out = np.zeros(self.n, bool)
        out[self.order[near]] = out[self.order[near - 1]] = True
        return out

    def holds(self, other: "SuffixArray", places: np.ndarray) -> np.ndarray:
        """Which windows of ``other`` start somewhere here, by binary search: eight bytes after eight, in the range of
        suffixes that agree so far."""
        lo, hi = np.zeros(len(places), np.int64), np.full(len(places), self.n, np.int64)
        depth, live = 0, np.arange(len(places))
        while depth < self.width and len(live):
            skip = min(depth, self.width - 8)  # the last eight bytes end the window
            key = other.word[places[live] + skip]
            lo[live], hi[live] = self._bound(lo[live], hi[live], skip, key, False), self._bound(lo[live], hi[live], skip, key, True)
            live, depth = live[lo[live] < hi[live]], skip + 8
        return lo < hi

    def _bound(self, lo: np.ndarray, hi: np.ndarray, depth: int, key: np.ndarray, upper: bool) -> np.ndarray:
        lo, hi = lo.copy(), hi.copy()
        while len(i := np.flatnonzero(lo < hi)):
            mid = (lo[i] + hi[i]) // 2
            word = self.word[np.minimum(self.order[mid] + depth, self.n - 1)]
            right = word <= key[i] if upper else word < key[i]
            lo[i[right]], hi[i[~right]] = mid[right] + 1, mid[~right]
        return lo


def repeated_windows(bodies: list[bytes], weights: np.ndarray, width: int, block: int = BLOCK) -> list[np.ndarray]:
    """For each different stretch: which of its windows start in another place of any stretch. All do in a stretch that
    has several places itself."""
    size = np.array([len(b) + 1 for b in bodies])
    cuts = np.flatnonzero(np.diff((np.cumsum(size) - size) // block)) + 1
    blocks = np.split(np.arange(len(bodies)), cuts)
    out: list[np.ndarray] = []
    for x in blocks:
        own = SuffixArray([bodies[i] for i in x], width)
        out.append((own, own.repeated | (weights[x][own.seg] > 1)))
    for i, (mine, found) in enumerate(out):
        for j, (other, _) in enumerate(out):
            if i != j and len(todo := np.flatnonzero(~found & (mine.room >= width))):
                found[todo] = other.holds(mine, todo)
    result = []
    for (own, found), x in zip(out, blocks):
        head = np.cumsum(size[x]) - size[x]
        result += [found[h : h + s - width] for h, s in zip(head.tolist(), size[x].tolist())]
    return result


def _indexing(width: int, block: int):
    """Of one shard: spans of its repeated windows, by place."""

    def run(group: pa.Table) -> pa.Table:
        known: dict[tuple[int, bytes], int] = {}
        seg, uid, start, copies, part = [], [], [], [], []
        for row in group.to_pylist():
            lengths, cells = np.frombuffer(row["lengths"], np.int64), np.frombuffer(row["cells"], np.int64)
            ends = np.cumsum(lengths)
            of = np.array([known.setdefault((c, row["body"][e - n : e]), len(known)) for c, e, n in zip(cells.tolist(), ends.tolist(), lengths.tolist())], np.int64)
            own = np.frombuffer(row["seg"], np.int64)
            seg.append(of[own])
            part.append(np.full(len(own), row["part"]))
            for name, to in (("uid", uid), ("start", start), ("copies", copies)):
                to.append(np.frombuffer(row[name], np.int64))
        seg, uid, start, copies, part = (np.concatenate(x) for x in (seg, uid, start, copies, part))
        weights = np.bincount(seg, copies, len(known)).astype(np.int64)
        bodies = [b for _, b in known]
        found = repeated_windows(bodies, weights, width, block)
        first, last, count = [], [], np.zeros(len(bodies), np.int64)
        for i, f in enumerate(found):
            edge = np.flatnonzero(np.diff(np.r_[False, f, False]))
            first.append(edge[::2])
            last.append(edge[1::2] - 1 + width)
            count[i] = len(edge) // 2
        first, last, head = np.concatenate(first), np.concatenate(last), np.cumsum(count) - count
        alone = np.flatnonzero(copies == 1)  # of other texts all is known
        n = count[seg[alone]]
        span, place = ragged(head[seg[alone]], n), np.repeat(alone, n)
        begin, end = start[place] + first[span], start[place] + last[span]
        rows = [{"part": p, "uids": uid[place[i]].tobytes(), "begins": begin[i].tobytes(), "ends": end[i].tobytes()} for p, i in cut_by(np.argsort(part[place], kind="stable"), part[place])]
        return _table(SPANS, rows)

    return run


def _cutting(texts: bool):
    """Texts of one group and all their spans: what stays."""

    def run(docs: pa.Table, spans: pa.Table) -> pa.Table:
        uid, begin, end = (_joined(spans, c, np.int64) for c in ("uids", "begins", "ends"))
        order = np.argsort(uid, kind="stable")
        uid, begin, end = uid[order], begin[order], end[order]
        own = docs.column("own").to_numpy()
        a, b = np.searchsorted(uid, own, "left"), np.searchsorted(uid, own, "right")
        rows = []
        for i, text in enumerate(docs.column("_text")):
            data = np.frombuffer(text.as_py().encode(), np.uint8)
            gone = np.zeros(len(data) + 1, np.int64)
            np.add.at(gone, begin[a[i] : b[i]], 1)
            np.add.at(gone, end[a[i] : b[i]], -1)
            keep = np.cumsum(gone)[:-1] == 0
            kept = data[keep].tobytes()
            n_spans = int((~keep & np.r_[True, keep[:-1]]).sum()) if len(keep) else 0
            rows.append({"k": docs.column("ids")[i].as_py()[0], "n_bytes": len(data), "n_removed": len(data) - len(kept), "n_spans": n_spans, "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept if texts else None})
        return _table(RESULT, rows)

    return run


def remove_repeated_bytes(docs: DataFrame, width: int = 400, text: str = "text", key: str = "doc_id", texts: bool = True, block: int = BLOCK) -> DataFrame:
    """One row for each row of ``docs``: (key, n_bytes, n_removed, n_spans, kept_sha256, kept). ``kept`` holds the bytes
    left (null without ``texts``; characters may be cut).

    Null texts have no bytes; texts shorter than ``width`` lose nothing; rows that repeat a text repeat each other, be
    their ids equal or null. ``width`` is ``GRAM`` + ``SUB`` or more. Extra columns are not read; an empty table gives no
    rows.
    """
    if width < GRAM + SUB:
        raise ValueError(f"width must be {GRAM + SUB} or more")
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("_text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    kept = F.encode(F.coalesce("_text", F.lit("")), "UTF-8") if texts else F.lit(None).cast("binary")
    short = rows.filter(F.col("n_bytes") < width).select("k", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(F.coalesce("_text", F.lit("")), 256).alias("kept_sha256"), kept.alias("kept"))
    base = rows.filter(F.col("n_bytes") >= width).select(F.xxhash64("_text").alias("ref"), "_text", "k")
    chars = int(base.agg(F.sum(F.length("_text"))).first()[0] or 0)
    buckets, shards, parts = (max(8, chars // n) for n in (BUCKET_CHARS, SHARD_CHARS, PART_CHARS))
    counted = base.select("ref", "_text").mapInArrow(_counting(width, buckets, parts), COUNTED)
    flags = staged(counted.groupBy("bucket").applyInArrow(_repeated_anchors(parts), FLAGS), "byte-anchors")
    del counted
    release(spark)
    by_part = base.mapInArrow(_collapsing(parts), TEXTS)
    sent = staged(by_part.groupBy("part").cogroup(flags.groupBy("part")).applyInArrow(_sending(width, buckets, shards, texts), SENT), "byte-stretches")
    del by_part
    release(spark)
    names = [x.split()[0] for x in SENT.split(", ")]
    spans = sent.filter("shard IS NOT NULL").select(names[:9]).groupBy("shard").applyInArrow(_indexing(width, block), SPANS)
    cut = sent.filter("_text IS NOT NULL").select("part", "own", "ids", "_text").groupBy("part").cogroup(spans.groupBy("part")).applyInArrow(_cutting(texts), RESULT)
    whole = sent.filter("_text IS NULL AND shard IS NULL")
    none = F.lit(b"") if texts else F.lit(None).cast("binary")  # with ``texts`` only those that go whole are here
    whole = whole.select(F.explode("ids").alias("k"), "n_bytes", "n_removed", "n_spans", F.col("sha").alias("kept_sha256"), none.alias("kept"))
    return cut.unionByName(whole).unionByName(short).withColumnRenamed("k", key)


def op13_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(table(spark, sf_dir, "documents"), texts=False).drop("kept")


OP13_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
part AS (SELECT r, n, c, substr(h, 2 * c + 1, 1822) AS h FROM (SELECT *, unnest(range(0, n - 399, 512)) AS c FROM d WHERE n >= 400)),
win AS (SELECT r, c + j AS i, md5(substr(h, 2 * j + 1, 800)) AS x FROM (SELECT *, unnest(range(0, least(512, n - 399 - c))) AS j FROM part)),
twice AS (SELECT r, i FROM win SEMI JOIN (SELECT x FROM win GROUP BY x HAVING count(*) > 1) USING (x)),
span AS (
  SELECT r, min(i) AS s, max(i) + 400 AS e
  FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS g FROM (SELECT r, i, (coalesce(i - lag(i) OVER (PARTITION BY r ORDER BY i) > 400, true))::INT AS new FROM twice)) GROUP BY r, g
),
gap AS (SELECT r, s, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS p FROM span),
kept AS (SELECT r, string_agg(substr(h, 2 * p + 1, 2 * (s - p)), '' ORDER BY s) || any_value(substr(h, 2 * last + 1)) AS t, count(*) AS n_spans, sum(e - s) AS n_removed FROM (SELECT *, max(e) OVER (PARTITION BY r) AS last FROM gap) JOIN d USING (r) GROUP BY r)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(t, h))) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""
