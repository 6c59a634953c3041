"""Benchmark decontamination with an FM-index for each training shard.

A shard is a bounded run of documents inside a task. Its words become ids of the test vocabulary; stretches with a
word outside it cannot hold a test phrase, so only the others are indexed (suffix order, BWT, wavelet matrix).
Every phrase is searched backwards through the wavelet ranks, occurrences are located by sampled suffix positions,
and the word spans found are merged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._stage import staged, table
from ._words import ALNUM, pieces, ragged, tokenize, within
from .fm_index import FMIndex

#: Test texts held by a task at once, in bytes (about as much again as word ids); a larger benchmark is searched in so
#: many passes over the documents, whose spans are written between them.
BLOCK_BYTES = 8 << 20
SPANS = "array<struct<start:int,end:int>>"


class Phrases:
    """The words of a block of test items as 32-bit ids of their own vocabulary, which travel; windows are places in
    them and are made where they are used."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        w = tokenize(pa.array([t for _, t in items], pa.string()), ALNUM, fold=True)
        self.names, self.width = [n for n, _ in items], width
        self.vocab, ids = np.unique(w.hashes, return_inverse=True)
        self.ids, self.offsets = ids.astype(np.int32), w.offsets

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, words, item) of every window; an item of fewer words is one."""
        at, item = within(self.offsets, self.width)
        counts = np.diff(self.offsets)
        short = np.flatnonzero((counts > 0) & (counts < self.width))
        return np.r_[at, self.offsets[short]], np.r_[np.full(len(at), self.width), counts[short]].astype(np.int64), np.r_[item, short]

    def hits(self, hashes: np.ndarray, offsets: np.ndarray, windows: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of every occurrence inside the texts."""
        none = np.empty(0, np.int64)
        place, lengths, _ = windows
        if not len(lengths) or not len(hashes):
            return none, none
        ids = np.minimum(np.searchsorted(self.vocab, hashes), len(self.vocab) - 1)
        known = self.vocab[ids] == hashes
        begin, end = known.copy(), known.copy()
        begin[1:] &= ~known[:-1]
        end[:-1] &= ~known[1:]
        some = offsets[:-1] < offsets[1:]
        a, b = offsets[:-1][some], offsets[1:][some] - 1
        begin[a], end[b] = known[a], known[b]
        starts = np.flatnonzero(begin)
        counts = np.flatnonzero(end) + 1 - starts
        keep = counts >= lengths.min()
        starts, counts = starts[keep], counts[keep]
        if not len(starts):
            return none, none
        index = FMIndex(ids[ragged(starts, counts)], counts, len(self.vocab))
        lo, hi = index.search(self.ids, place, lengths)
        at = index.locate(ragged(lo, hi - lo))
        run = np.searchsorted(index.begins, at, "right") - 1
        return starts[run] + at - index.begins[run], np.repeat(np.arange(len(lo)), hi - lo)


def merged_spans(first: np.ndarray, length: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the maximal covered stretches inside each text."""
    n = int(offsets[-1])
    depth = np.cumsum(np.bincount(first, minlength=n + 1) - np.bincount(first + length, minlength=n + 1))[:n] > 0
    begin, end = depth.copy(), depth.copy()
    begin[1:] &= ~depth[:-1]
    end[:-1] &= ~depth[1:]
    some = offsets[:-1] < offsets[1:]
    a, b = offsets[:-1][some], offsets[1:][some] - 1
    begin[a], end[b] = depth[a], depth[b]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def _lists(counts: np.ndarray, values: pa.Array, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), values).cast(kind)


SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])


def _searcher(phrases: Phrases) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = phrases.windows()
        _, lengths, item = windows
        for batch in pieces(batches, "_text"):
            names = batch.schema.names
            w = tokenize(batch.column(names.index("_text")), ALNUM, fold=True)
            first, phrase = phrases.hits(w.hashes, w.offsets, windows)
            length, doc = lengths[phrase], np.searchsorted(w.offsets, first, "right") - 1
            old = batch.column(names.index("spans"))  # of earlier blocks of test items
            n_old = np.diff(np.asarray(old.offsets))
            if n_old.sum():
                s = old.flatten()
                base = np.repeat(w.offsets[:-1], n_old)
                first = np.r_[first, np.asarray(s.field("start")) + base]
                length = np.r_[length, np.asarray(s.field("end")) - np.asarray(s.field("start"))]
            a, b = merged_spans(first, length, w.offsets)
            of = np.searchsorted(w.offsets, a, "right") - 1
            base = w.offsets[of]
            spans = pa.StructArray.from_arrays([pa.array(a - base, pa.int32()), pa.array(b - base, pa.int32())], fields=list(SPAN))
            found = [set(x) for x in batch.column(names.index("items")).to_pylist()]
            pairs = np.unique(np.c_[doc, item[phrase]], axis=0) if len(doc) else np.empty((0, 2), int)
            for d, i in pairs:
                found[d].add(phrases.names[i])
            out = dict(zip(names, batch.columns)) | {
                "n_words": pa.array(np.diff(w.offsets), pa.int64()),
                "spans": _lists(np.bincount(of, minlength=len(batch)), spans, pa.list_(SPAN)),
                "items": pa.array([sorted(x) for x in found], pa.list_(pa.string())),
            }
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", width: int = 10, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` (all, if none are given) with n_words, spans (merged word spans of test phrases)
    and items (sorted ids, as strings, of the test items found).

    A phrase is ``width`` consecutive words of an item, or all words of a shorter one; null and wordless texts hold
    and match nothing; repeated rows are judged alike, repeated item ids count once, a null id is written ``null``.
    Columns of ``docs`` named like the three results are replaced by them. Empty tables give empty results.
    The benchmark goes to the tasks in blocks of at most ``BLOCK_BYTES`` of text (one item at least).
    """
    kept = [c for c in (keep or docs.columns) if c not in ("n_words", "spans", "items")]
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), F.col(text).alias("_text"), F.lit(0).cast("long").alias("n_words"), F.array().cast(SPANS).alias("spans"), F.array().cast("array<string>").alias("items"))
    tests = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("item"), F.col(item_text).alias("t")).filter(F.col("t").isNotNull())
    blocks = max(1, -(-int(tests.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // BLOCK_BYTES))
    for b in range(blocks):
        part = tests if blocks == 1 else tests.filter(F.pmod(F.xxhash64("item", "t"), F.lit(blocks)) == b)
        phrases = Phrases([tuple(r) for r in part.distinct().collect()], width)
        out = out.mapInArrow(_searcher(phrases), T.StructType([f for f in out.schema]))
        if b < blocks - 1:  # one block of phrases at a time lives on the driver and in the tasks
            out = staged(out, "leaks")
    return out.select("_row.*", "n_words", "spans", "items")


def hit_words() -> F.Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def cut_spans(words: F.Column, spans: F.Column) -> F.Column:
    """Those of an array of words that no span covers."""
    return F.filter(words, lambda _, i: ~F.exists(spans, lambda s: (s["start"] <= i) & (i < s["end"])))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without a word of a test phrase; same columns."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(options.pop("text", "text")).alias("_t"))
    return find_leaks(row, benchmark, text="_t", keep=["_row"], **options).filter(F.size("spans") == 0).select("_row.*")


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_leaks(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP5_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, {_WORDS} AS w FROM benchmark),
phrases AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS phrase
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS p FROM b WHERE len(w) > 0)
), spots AS (
  SELECT r, n, p, array_to_string(w[p : p + n - 1], ' ') AS phrase
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM phrases))
), hits AS (SELECT s.r, s.p, s.n, f.item FROM spots s JOIN phrases f ON s.n = f.n AND s.phrase = f.phrase),
covered AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""
