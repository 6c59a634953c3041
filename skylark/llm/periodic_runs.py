"""Periodic runs of words, found in tiles by octave of period.

A run of period q (least period, 4 q words or more) is found in the octave o with B = 2^o <= q < 2 B: among grid points B
words apart, each point b inside the run has its next B words again at b + q, but for those at the run's end. So

1. The task that reads a document tests its grid for such repeats (one comparison a word and octave) and explodes it into
   tiles, each overlapping its neighbours by 8 B words, of the octaves where two points in a row repeat. Other tiles
   hold no run and are not made.
2. Tiles are dealt out and solved on their own. The Z-functions at a grid point, forward (how far does w[b:] agree with
   w[b + q:]) and backward, give the longest stretch of period q in the tile; stretches whose first period is itself a
   power are left out.
3. Stretches are shuffled by document and period and stitched where they overlap by a period or more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._sql import CRC_TABLE, crc
from ._stage import staged, table
from ._words import mixed, pieces, tokenize

#: Words of a tile without its overlap; octaves beyond an eighth of it have tiles of eight times their step.
TILE = 4096
#: Words that a grid point is compared by, at most, before the tile is made.
GRAM = 64
LEAST, POWER = 6, 4

ROWS = "rid long, k long, n long, sha string, words string, octaves long, first long, ids binary"
FRAGMENTS = "rid long, period long, start long, stop long"
RESULT = "k long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, collapsed string, runs array<struct<start:bigint,length:bigint,period:bigint>>"


def _doubled(g: np.ndarray, width: int) -> np.ndarray:
    """Hashes of 2 * width items from those of width items."""
    return mixed(g[:-width] * np.uint64(0xA0761D6478BD642F) + g[width:] + np.uint64(width))


def _next(g: np.ndarray, width: int) -> np.ndarray:
    return _doubled(g, width) if len(g) > width else g[:0]


def hits(g: np.ndarray, step: int) -> np.ndarray:
    """For every grid point (row) and period step .. 2 step - 1 (column): whether the hashes there agree."""
    points = -(-len(g) // step)
    ahead = np.zeros((points + 1) * step, g.dtype)
    ahead[: len(g)] = g
    equal = ahead[step:].reshape(points, step) == g[::step, None]
    equal.ravel()[max(0, len(g) - step) :] = False
    return equal


def planted(n: int, h: int) -> np.ndarray:
    """Which original word stands at each place of a document that is made periodic."""
    g, at = h // 10, np.arange(n)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.where(at < a, at, a + (at - a) % p)


def tiles(length: int, marked: dict[int, np.ndarray], tile: int) -> Iterator[tuple[int, int, int]]:
    """(octaves as bits, first word, last word + 1) of a document's tiles that hold a marked place."""
    low, wide = {}, tile // 8
    for octave, places in marked.items():
        step = 1 << octave
        if step <= wide:
            for t in np.unique(places // tile).tolist():
                low[t] = low.get(t, 0) | 1 << octave
        else:
            for t in np.unique(places // (8 * step)).tolist():
                yield 1 << octave, max(0, 8 * t * step - 4 * step), min(length, 8 * (t + 1) * step + 4 * step)
    for t, octaves in low.items():
        yield octaves, max(0, t * tile - tile // 2), min(length, (t + 1) * tile + tile // 2)


def _exploding(tile: int):
    """A row for each document, with its words (joined by one space) where it may hold a run, and a row for each tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            yield _rows(batch, tile)

    return run


def _rows(batch: pa.RecordBatch, tile: int) -> pa.RecordBatch:
    rid, k, crc = (batch.column(i).to_pylist() for i in range(3))
    words = tokenize(batch.column(3))
    count = np.diff(words.offsets)
    order = np.argsort(-count, kind="stable")  # the longest first: an octave concerns the first documents
    maps: dict[int, np.ndarray] = {}
    at = []
    for d in order.tolist():
        own = np.arange(count[d])
        if crc[d] is not None and crc[d] % 10 == 0 and count[d]:
            maps[d] = own = planted(int(count[d]), crc[d])
        at.append(own + words.offsets[d])
    seq = words.hashes[np.concatenate(at)] if at else words.hashes
    size = count[order]
    begin = np.cumsum(size) - size
    doc = np.repeat(np.arange(len(order)), size)
    marked: dict[int, dict[int, np.ndarray]] = {}
    g, width, octave = seq, 1, 0
    while True:
        step = 1 << octave
        live = int(np.searchsorted(-size, -max(LEAST, POWER * step), "right"))
        if not live:
            break
        if 1 < step <= GRAM:
            g, width = _next(g, width), step
        end = int(begin[live - 1] + size[live - 1])
        equal = hits(g[: max(0, end - width + 1)], step)
        point, shift = np.nonzero(equal[:-1] & equal[1:])
        for point in (point, point + 1):
            b = point * step
            same = doc[b] == doc[b + step + shift + width - 1]
            b = np.unique(b[same])
            cut = np.flatnonzero(np.diff(doc[b])) + 1
            for places in np.split(b, cut) if len(b) else ():
                d = int(doc[places[0]])
                own = marked.setdefault(d, {})
                own[octave] = np.union1d(own.get(octave, places[:0]), places - begin[d])
        octave += 1
    names = [x.split()[0] for x in ROWS.split(", ")]
    out: dict[str, list] = {x: [] for x in names}

    def add(*row) -> None:
        for name, value in zip(names, row):
            out[name].append(value)

    texts = batch.column(3)
    for place, d in enumerate(order.tolist()):
        own = (texts[d].as_py() or "").encode().split()
        if d in maps:
            own = [own[i] for i in maps[d].tolist()]
        joined = b" ".join(own)
        add(rid[d], k[d], len(own), hashlib.sha256(joined).hexdigest(), joined.decode() if place in marked else None, None, None, None)
        if place in marked:
            ids = np.unique(seq[begin[place] : begin[place] + size[place]], return_inverse=True)[1].astype(np.int32)
            for octaves, first, last in tiles(len(own), marked[place], tile):
                add(rid[d], None, None, None, None, octaves, first, ids[first:last].tobytes())
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(out[x.split()[0]], kinds[x.split()[1]]) for x in ROWS.split(", ")], names=names)


class Tile:
    """Words of a tile, with hashes of the 1, 2, 4, ... words from each place on."""

    def __init__(self, ids: np.ndarray):
        self.n, self.grams = len(ids), [mixed(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))]
        while len(self.grams[-1]) > (width := 1 << (len(self.grams) - 1)):
            self.grams.append(_doubled(self.grams[-1], width))

    def forward(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Z-values: how many words from p and from q > p on agree."""
        z = np.zeros(len(p), np.int64)
        for k in range(len(self.grams) - 1, -1, -1):
            i = np.flatnonzero(q + z + (1 << k) <= self.n)
            i = i[self.grams[k][p[i] + z[i]] == self.grams[k][q[i] + z[i]]]
            z[i] += 1 << k
        return z

    def backward(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Z-values of the reversed tile: how many words before p and before q > p agree."""
        z = np.zeros(len(p), np.int64)
        for k in range(len(self.grams) - 1, -1, -1):
            i = np.flatnonzero(p - z >= 1 << k)
            i = i[self.grams[k][p[i] - z[i] - (1 << k)] == self.grams[k][q[i] - z[i] - (1 << k)]]
            z[i] += 1 << k
        return z

    def stretches(self, octave: int) -> np.ndarray:
        """Distinct (period, start, stop) of the octave's periods: longest in the tile, two periods long or more."""
        step = 1 << octave
        k = min(octave, GRAM.bit_length() - 1, len(self.grams) - 1)
        b, shift = np.nonzero(hits(self.grams[k], step))
        b, q = b * step, shift + step
        start = b - self.backward(b, b + q)
        stop = b + q + self.forward(b, b + q)
        i = np.flatnonzero(stop - start >= 2 * q)
        found = np.unique(np.stack([q[i], start[i], stop[i]], 1), axis=0)
        return found[~self._power(found[:, 1], found[:, 0], 2 * step)]

    def _power(self, b: np.ndarray, q: np.ndarray, most: int) -> np.ndarray:
        """Whether the q words from b on repeat a shorter word: then q / r is a period of them for a prime r."""
        least = np.zeros(most, np.int64)
        for r in range(2, most):
            if r * r >= most:
                break
            if not least[r]:
                part = least[r * r :: r]
                part[part == 0] = r
        out, rest = np.zeros(len(q), bool), q.copy()
        while len(i := np.flatnonzero(rest > 1)):
            r = np.where(least[rest[i]] > 0, least[rest[i]], rest[i])
            rest[i] //= r
            shift = q[i] // r
            out[i] |= self.forward(b[i], b[i] + shift) >= q[i] - shift
        return out


def _solving(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of every tile, by document and period."""
    for batch in batches:
        out: list[np.ndarray] = []
        for rid, octaves, first, ids in zip(*(batch.column(i).to_pylist() for i in range(4))):
            t = Tile(np.frombuffer(ids, np.int32))
            for octave in range(octaves.bit_length()):
                if octaves >> octave & 1 and len(found := t.stretches(octave)):
                    out.append(np.c_[np.full(len(found), rid), found[:, 0], found[:, 1:] + first])
        rows = np.concatenate(out) if out else np.empty((0, 4), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, i]), pa.int64()) for i in range(4)], names=["rid", "period", "start", "stop"])


def stitched(fragments: DataFrame) -> DataFrame:
    """(rid, period, start, stop): stretches of a document and period that overlap by a period or more are one."""
    own = Window.partitionBy("rid", "period").orderBy("start", "stop")
    reach = F.max("stop").over(own.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col("start") > reach - F.col("period"), F.lit(True)).cast("int")
    rows = fragments.withColumn("new", new).withColumn("run", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("rid", "period", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("run")


def _collapsing(texts: bool):
    """Documents (k, n, sha, words, runs) to their results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_collapsed(*row, texts) for row in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_pylist(rows, schema=_schema())

    return run


def _schema() -> pa.Schema:
    run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([(name, kinds.get(kind, run)) for name, kind in (x.split(" ", 1) for x in RESULT.split(", "))])


def _collapsed(k: int | None, n: int, sha: str, words: str | None, runs: list[dict] | None, texts: bool) -> dict:
    out = {"k": k, "n_runs": 0, "start": None, "length": None, "period": None, "exponent_milli": None, "runs_sha256": hashlib.sha256(b"").hexdigest(), "collapsed_sha256": sha, "collapsed": words if texts else None, "runs": []}
    if not runs:
        return out
    best, gone = runs[0], np.zeros(n + 1, np.int64)
    for r in runs:  # by start, then period, so ties keep the first
        if r["length"] * best["period"] > best["length"] * r["period"]:
            best = r
        gone[r["start"] + r["period"]] += 1
        gone[r["start"] + r["length"]] -= 1
    kept = " ".join(compress(words.split(" "), (np.cumsum(gone)[:n] == 0).tolist()))
    listed = "".join(f"{r['start']},{r['length']},{r['period']}\n" for r in runs)
    sha256 = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return out | {
        "n_runs": len(runs), "start": best["start"], "length": best["length"], "period": best["period"], "exponent_milli": 1000 * best["length"] // best["period"],
        "runs_sha256": sha256(listed), "collapsed_sha256": sha256(kept), "collapsed": kept if texts else None, "runs": [{x: r[x] for x in ("start", "length", "period")} for r in runs],
    }


def find_runs(docs: DataFrame, text: str = "text", key: str = "doc_id", tile: int = TILE, texts: bool = True) -> DataFrame:
    """One row for each row of ``docs``: (key, n_runs, start, length, period, exponent_milli, runs_sha256,
    collapsed_sha256, collapsed, runs). ``runs`` lists all, by start and period; ``collapsed`` is the text left when each
    run keeps its first period only (null without ``texts``, or where nothing repeats at all).

    A document whose key has a CRC-32 divisible by 10 is made periodic first (``planted``); a null key's is not. Null
    and blank texts have no words and no runs; repeated rows each give a row; extra columns are not read.
    """
    crc32 = F.crc32(F.encode(F.col(key).cast("string"), "UTF-8"))
    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).cast("long").alias("k"), crc32.alias("crc"), F.col(text).alias("_text"))
    rows = staged(base.mapInArrow(_exploding(tile), ROWS), "run-tiles")
    dealt = rows.filter("ids IS NOT NULL").select("rid", "octaves", "first", "ids").repartition("rid", "first", "octaves")
    runs = stitched(dealt.mapInArrow(_solving, FRAGMENTS)).withColumn("length", F.col("stop") - F.col("start"))
    runs = runs.filter(F.col("length") >= F.greatest(F.lit(LEAST), POWER * F.col("period")))
    runs = runs.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    own = rows.filter("n IS NOT NULL").select("rid", "k", "n", "sha", "words").join(runs, "rid", "left")
    out = own.select("k", "n", "sha", "words", "runs").mapInArrow(_collapsing(texts), RESULT)
    return out.withColumnRenamed("k", key)


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    return find_runs(table(spark, sf_dir, "documents"), texts=False).drop("collapsed", "runs")


OP12_SQL = rf"""
WITH {CRC_TABLE},
d AS (SELECT row_number() OVER () AS r, doc_id, {crc('doc_id')} AS h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w0 FROM documents, crc_table),
a AS (SELECT *, len(w0) AS n, h // 10 AS g FROM d),
b AS (SELECT *, CASE WHEN n > 0 THEN g % n ELSE 0 END AS a FROM a),
t AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM b),
doc AS (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 THEN list_transform(range(n), lambda i: w0[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w0 END AS w FROM t),
word AS (SELECT r, n, unnest(w) AS x, unnest(range(n)) AS i FROM doc),
gram AS (SELECT r, n, i, (x, lead(x) OVER o, lead(x, 2) OVER o) AS x FROM word WINDOW o AS (PARTITION BY r ORDER BY i) QUALIFY lead(i, 2) OVER o IS NOT NULL),
pair AS (SELECT u.r, u.i, v.i - u.i AS q FROM gram u JOIN gram v ON u.r = v.r AND u.x = v.x AND v.i > u.i AND 4 * (v.i - u.i) <= u.n),
stretch AS (SELECT r, q, min(i) AS s, count(*) + 2 + q AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM pair) GROUP BY r, q, k HAVING count(*) + 2 + q >= greatest(6, 4 * q)),
run AS (SELECT * FROM stretch x WHERE NOT EXISTS (SELECT 1 FROM stretch y WHERE y.r = x.r AND y.q < x.q AND y.s <= x.s AND y.s + y.l >= x.s + x.l)),
best AS (SELECT r, s, l, q FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY l::DOUBLE / q DESC, s, q) AS k FROM run) WHERE k = 1),
listed AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM run GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM run),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, s AS start, l AS length, q AS period, (1000 * l // q)::BIGINT AS exponent_milli, sha256(coalesce(listed.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM doc LEFT JOIN listed USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
"""
