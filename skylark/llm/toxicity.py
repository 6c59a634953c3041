"""Toxicity from subword-bag embeddings: a word is the mean vector of its character n-grams, a passage the mean of its
words, and a linear softmax on that mean gives the classes. Vectors and softmax are trained jointly in numpy.

A text is cut into passages of equal length, ``PASSAGE`` words at most, and scores as its most toxic one: a few words
would vanish in the mean of a long text. Passages of texts labelled 1 that look clean after the first half of the
training are left out of the second half, but for the text's worst.

Training sees at most ``MAX_ROWS`` labelled documents and ``MAX_WORDS`` words of them (a documented bound); scoring sees
every word of every text. Tasks hash the words and count them, and score the rows that fit the final scale; the driver
gets their counts, the word hashes within the bound and the vocabulary that occurs in several documents, not texts.
As the model is linear in the n-grams, a passage's score needs one number for each n-gram bucket, and an unseen
misspelling shares most of its n-grams with the word it stands for.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._stage import staged, table
from ._words import ALNUM, CHUNK, FOLD, MASK, MULT, _powers, mixed, pieces, ragged, tokenize

#: Labelled rows that are learnt from: those of least hash, whatever the table's size.
MAX_ROWS = 4000
#: And of those, in order of another hash, as many as hold so many words in all; longer ones are not learnt from. Words are
#: counted before any reach the driver, so it holds 8 bytes for each of these words and no more.
MAX_WORDS = 2_000_000
#: Words of more bytes are not in the training vocabulary.
TAUGHT = 256
#: Words beyond so many bytes are scored singly, piece by piece.
LONG = 1 << 16
#: Words whose n-grams are listed at once, when scoring.
TOGETHER = 1 << 13
BUCKETS = 1 << 16
SIZES = (3, 4, 5, 6)
DIM = 8
#: Words of a passage, and the least that its mean is taken over (so that a text of one word says little).
PASSAGE, LEAST = 32, 16
#: Words of the training vocabulary occur in so many of its documents, and in such a share of them.
MIN_DOCS, MIN_SHARE = 2, 0.001
EPOCHS = 100
RATE = 0.05
#: The softmax sees means times this.
GAIN = 30.0
DECAY = 2e-5
#: Spread of the first vectors, and weight of an array's mean step scale beside each number's own.
START, EVEN = 0.01, 1.0
#: Each step moves the vectors so much towards zero; those of n-grams that say little stay there.
SHRINK = 0.003


def passages(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, number of words, text) of every passage."""
    n = np.diff(offsets)
    count = -(-n // PASSAGE)
    text = np.repeat(np.arange(len(n)), count)
    i = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    begin, end = i * n[text] // count[text], (i + 1) * n[text] // count[text]
    return offsets[:-1][text] + begin, end - begin, text


def distinct(ids: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, word, share) of the distinct words of each passage; passages cover the words end to end."""
    of = np.repeat(np.arange(len(first)), size)
    key = np.unique(of * (int(ids.max(initial=0)) + 1) + ids)
    of, word = np.divmod(key, int(ids.max(initial=0)) + 1)
    return of, word, 1 / np.maximum(size, LEAST)[of]


def subwords(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, edges): the n-gram buckets of each word, bracketed as <word>, and the whole word, end to end."""
    size = ends - starts + 2
    at = np.cumsum(size) - size
    text = np.empty(int(size.sum()), np.uint8)
    inner = np.ones(len(text), bool)
    inner[at], inner[at + size - 1] = False, False
    text[at], text[at + size - 1] = ord("<"), ord(">")
    text[inner] = FOLD[data[ragged(starts, ends - starts)]]
    word = np.repeat(np.arange(len(size)), size)
    parts, owners, h = [], [], np.zeros(len(text), np.uint64)
    for n in range(1, max(SIZES) + 1):
        h = h[: len(text) - n + 1] * np.uint64(0x100000001B3) + text[n - 1 :]
        if n in SIZES and len(h):
            ok = word[: len(h)] == word[n - 1 :]
            parts.append(mixed(h[ok] + np.uint64(n)) % np.uint64(BUCKETS))
            owners.append(word[: len(h)][ok])
    parts.append(mixed(polynomials(text, at, at + size)) % np.uint64(BUCKETS))
    owners.append(np.arange(len(size)))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(parts)[order].astype(np.int64), np.r_[0, np.cumsum(np.bincount(owner, minlength=len(size)))]


def polynomials(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of whole words, from one running sum for each stretch of words; a longer word is put together from parts."""
    powers, inverses, _ = _powers()
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        a = starts[i]
        j = int(np.searchsorted(ends, a + CHUNK, "right"))
        if j <= i:
            h = 0
            for at in range(int(a), int(ends[i]), CHUNK):
                part = data[at : min(at + CHUNK, ends[i])]
                own = int((part * inverses[: len(part)]).sum(dtype=np.uint64)) * int(powers[len(part) - 1])
                h = (h * pow(MULT, len(part), 1 << 64) + own) & MASK
            out[i] = h
            i += 1
            continue
        part = data[a : ends[j - 1]]
        run = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * inverses[: len(part)], out=run[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = (run[e] - run[s]) * powers[e - 1]
        i = j
    return out


def long_word_score(word: np.ndarray, weights: np.ndarray) -> float:
    """The mean weight of a folded word's n-grams, in pieces of bounded memory."""
    text = np.r_[ord("<"), word, ord(">")].astype(np.uint8)
    total, count = float(weights[int(mixed(polynomials(text, np.zeros(1, np.int64), np.array([len(text)])))[0] % np.uint64(BUCKETS))]), 1
    for at in range(0, len(text), LONG):
        h = np.zeros(0, np.uint64)
        for n in range(1, max(SIZES) + 1):
            part = text[at : at + LONG + n - 1]
            h = part.astype(np.uint64) if n == 1 else h[: len(part) - n + 1] * np.uint64(0x100000001B3) + part[n - 1 :]
            if n in SIZES and len(part) >= n:
                grams = mixed(h + np.uint64(n)) % np.uint64(BUCKETS)
                total, count = total + float(weights[grams].sum()), count + len(grams)
    return total / count


def word_scores(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The mean weight of each word's n-grams."""
    out, short = np.empty(len(starts)), np.flatnonzero(ends - starts <= LONG)
    for i in range(0, len(short), TOGETHER):
        part = short[i : i + TOGETHER]
        grams, edges = subwords(data, starts[part], ends[part])
        out[part] = np.add.reduceat(weights[grams], edges[:-1]) / np.diff(edges)
    for i in np.flatnonzero(ends - starts > LONG):
        out[i] = long_word_score(FOLD[data[starts[i] : ends[i]]], weights)
    return out


class Model(NamedTuple):
    weights: np.ndarray  # of each bucket, for class 1 against class 0
    bias: float
    scale: tuple[float, float] = (1.0, 0.0)  # from the worst passage's logit to the text's

    def score(self, texts: pa.Array) -> np.ndarray:
        logit = self.worst(texts) * self.scale[0] + self.scale[1]
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))

    def worst(self, texts: pa.Array) -> np.ndarray:
        """Logit of each text's most toxic passage; of a wordless text, the bias."""
        w = tokenize(texts, ALNUM, fold=True)
        out = np.full(len(texts), self.bias)
        if len(w.hashes):
            _, first, ids = np.unique(w.hashes, return_index=True, return_inverse=True)
            each = word_scores(w.data, w.starts[first], w.ends[first], self.weights)
            begin, size, text = passages(w.offsets)
            of, word, share = distinct(ids, begin, size)
            logit = np.bincount(of, weights=each[word] * share, minlength=len(begin)) + self.bias
            head = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
            out[text[head]] = np.maximum.reduceat(logit, head)
        return out


def _counts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, doc, n) of each labelled document: the hash of its folded words, and their number."""
    for batch in pieces(batches, "_text"):
        w = tokenize(batch.column(1), ALNUM, fold=True)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_digests(w), pa.int64()), pa.array(np.diff(w.offsets), pa.int64())], names=["label", "doc", "n"])


def _words_of(chosen: set[tuple[int, int]]):
    """(label, doc, words) of the chosen documents: the hashes of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            w = tokenize(batch.column(1), ALNUM, fold=True)
            labels, docs, edges = batch.column(0).to_pylist(), _digests(w), w.offsets.tolist()
            rows = [(y, d, w.hashes[a:b].tobytes()) for y, d, a, b in zip(labels, docs, edges, edges[1:]) if (d, y) in chosen]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["label", "doc", "words"])

    return run


def _digests(w) -> list[int]:
    """63 bits of the folded words of each text: their crc, which gives the order, and half of another hash."""
    folded, out = FOLD[w.data].tobytes(), []
    for a, b in zip(w.offsets[:-1], w.offsets[1:]):
        text = b" ".join(folded[w.starts[i] : w.ends[i]] for i in range(a, b))
        out.append(zlib.crc32(text) << 31 | int.from_bytes(blake2b(text, digest_size=4).digest(), "little") >> 1)
    return out


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, hash, word) of the distinct folded words of each document; those beyond ``TAUGHT`` bytes are left to scoring."""
    for batch in pieces(batches, "_text"):
        w = tokenize(batch.column(1), ALNUM, fold=True)
        folded, docs, rows = FOLD[w.data].tobytes(), _digests(w), []
        for doc, a, b in zip(docs, w.offsets[:-1], w.offsets[1:]):
            h, first = np.unique(w.hashes[a:b], return_index=True)
            rows += [(doc, x, folded[w.starts[i] : w.ends[i]]) for x, i in zip(h.view(np.int64).tolist(), (a + first).tolist()) if w.ends[i] - w.starts[i] <= TAUGHT]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["doc", "h", "word"])


def _worst_of(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_digests(tokenize(batch.column(1), ALNUM, fold=True)), pa.int64()), pa.array(model.worst(batch.column(1)), pa.float64())], names=["label", "doc", "worst"])

    return run


class _Sums:
    """Sums of rows of x by target, and of their gradients back by source, for fixed (source, target, weight); taken in
    stretches of about ``STRETCH`` terms, so that what is gathered at once stays small."""

    STRETCH = 1 << 17

    def __init__(self, source: np.ndarray, target: np.ndarray, weight: np.ndarray, sources: int, targets: int):
        self.shape = (sources, targets)
        self.ways = []
        for a, b in ((source, target), (target, source)):
            order = np.argsort(b, kind="stable")
            edges = np.flatnonzero(np.r_[True, np.diff(b[order]) > 0]) if len(b) else np.empty(0, int)
            ids = b[order][edges].astype(np.int32)
            cuts = np.unique(np.searchsorted(edges, np.arange(0, len(b), self.STRETCH)))
            self.ways.append((a[order].astype(np.int32), weight[order][:, None].astype(np.float32), np.r_[edges, len(b)], ids, np.r_[cuts, len(edges)]))

    def __call__(self, x: np.ndarray, back: bool = False) -> np.ndarray:
        a, weight, edges, ids, cuts = self.ways[back]
        out = np.zeros((self.shape[not back], x.shape[1]), np.float32)
        for i, j in zip(cuts[:-1], cuts[1:]):
            if i < j:
                s, e = edges[i], edges[j]
                terms = x[a[s:e]]
                terms *= weight[s:e]
                out[ids[i:j]] = np.add.reduceat(terms, edges[i:j] - s)
        return out


def scaled(model: Model, y: np.ndarray, x: np.ndarray) -> Model:
    """The model with its final scale, fitted to labels and worst logits of rows kept from training, since the worst of
    many passages runs higher than a single one."""
    if not model.weights.any() or not 0 < y.sum() < len(y):
        return model
    a, b, spread = 0.0, float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), x.std() + 1e-9
    z = (x - x.mean()) / spread
    for _ in range(50):  # Newton's method, slightly damped
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        q = p * (1 - p)
        h = np.array([[(q * z * z).sum() + 0.05, (q * z).sum()], [(q * z).sum(), q.sum() + 1e-6]])
        da, db = np.linalg.solve(h, [((y - p) * z).sum() - 0.05 * a, (y - p).sum()])
        a, b = a + np.clip(da, -1, 1), b + np.clip(db, -1, 1)
    a = max(a, 0.0)
    return model._replace(scale=(float(a / spread), float(b - a * x.mean() / spread)))


def fit_passages(rows: list[tuple[int, bytes]], vocabulary: dict[int, bytes], seed: int = 3) -> Model:
    """Joint training of the n-gram vectors and the softmax by full-batch Adam; rows are (label, word hashes), and
    ``vocabulary`` has the words of those hashes (as signed numbers) that occur in several documents."""
    labels = np.array([r[0] for r in rows], np.int64)
    prior = (labels.sum() + 0.5) / (len(labels) + 2)  # without labels nothing counts as toxic
    hashes = np.frombuffer(b"".join(r[1] for r in rows), np.int64)
    if not len(hashes) or labels.min() == labels.max() or not vocabulary:  # nothing to tell apart
        return Model(np.zeros(BUCKETS), float(np.log(prior / (1 - prior))))
    offsets = np.r_[0, np.cumsum([len(r[1]) // 8 for r in rows])]
    distinct_words, ids = np.unique(hashes, return_inverse=True)
    at = np.searchsorted(distinct_words, known := np.array(sorted(vocabulary), np.int64))
    present = (at < len(distinct_words)) & (distinct_words[np.minimum(at, len(distinct_words) - 1)] == known)
    known_at = at[present]
    spelt = [vocabulary[int(h)] for h in known[present]]
    begin, size, text = passages(offsets)
    of, word, share = distinct(ids, begin, size)
    keep = np.zeros(len(distinct_words), bool)
    keep[known_at] = True
    first, live = np.flatnonzero(keep), keep[word]
    of, word, share = of[live], (np.cumsum(keep) - 1)[word[live]], share[live]
    edge = np.r_[0, np.cumsum([len(x) for x in spelt])]
    grams, edges = subwords(np.frombuffer(b"".join(spelt), np.uint8), edge[:-1], edge[1:])
    used, grams = np.unique(grams, return_inverse=True)  # untouched buckets stay at zero
    gram_word = np.repeat(np.arange(len(first)), np.diff(edges))
    to_word = _Sums(grams, gram_word, (1 / np.diff(edges))[gram_word], len(used), len(first))
    to_passage = _Sums(word, of, share, len(first), len(begin))
    rng = np.random.default_rng(seed)
    e = rng.normal(0, START, (len(used), DIM)).astype(np.float32)
    v = rng.normal(0, 0.3, (DIM, 2)).astype(np.float32)
    y = labels[text]
    b = np.log(np.bincount(y, minlength=2) / len(y)).astype(np.float32)
    target, weight = np.eye(2, dtype=np.float32)[y], np.ones(len(y), np.float32)
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in (e, v, b)]
    for step in range(1, EPOCHS + 1):
        mean = to_passage(to_word(e)) * np.float32(GAIN)
        logit = mean @ v + b
        p = np.exp(logit - logit.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        if step == EPOCHS // 2:  # clean passages of texts labelled 1 say nothing about them
            head = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
            worst = np.repeat(np.maximum.reduceat(p[:, 1], head), np.diff(np.r_[head, len(text)]))
            weight = ((y == 0) | (p[:, 1] >= 0.5) | (p[:, 1] == worst)).astype(np.float32)
        g = (p - target) * (weight / weight.sum())[:, None]
        g_e = to_word(to_passage((g @ v.T) * np.float32(GAIN), back=True), back=True)
        for x, d, (m, s) in zip((e, v, b), (g_e + DECAY * e / len(used) ** 0.5, mean.T @ g + DECAY * v, g.sum(0)), state):
            m += 0.1 * (d - m)
            s += 0.001 * (d * d - s)
            root = np.sqrt(s / (1 - 0.999**step))
            x -= RATE * (m / (1 - 0.9**step)) / (root + EVEN * np.sqrt(np.mean(root * root)) + 1e-8)  # rare n-grams take small steps
        norm = np.linalg.norm(e, axis=1, keepdims=True)
        e *= np.maximum(0, 1 - SHRINK / np.maximum(norm, 1e-12))
    weights = np.zeros(BUCKETS)
    weights[used] = (e @ (v[:, 1] - v[:, 0])).astype(np.float64) * GAIN
    return Model(weights, float(b[1] - b[0]))


def remainder(key: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % n


def labelled(docs: DataFrame, labels: DataFrame, label: str, key: str, text: str, learn: Column, max_rows: int) -> DataFrame:
    """(label, _text) of at most ``max_rows`` documents with a 0/1 label that ``learn`` admits, those of least hash.
    The rows are chosen by id before any text moves; a document with two labels counts once, with the larger, and an id
    with several texts by the least of them."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull() & learn).groupBy(key).agg(F.max(label).cast("int").alias("label"))
    present = docs.select(key).filter(F.col(key).isNotNull()).distinct()
    chosen = known.join(present, key).orderBy(F.xxhash64(key), key).limit(max_rows)
    rows = chosen.join(docs.select(F.col(key), F.col(text).alias("_text")), key)
    return rows.groupBy(key).agg(F.max("label").alias("label"), F.min("_text").alias("_text")).select("label", "_text")


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", learn: Column | None = None, max_rows: int = MAX_ROWS) -> Model:
    rows = staged(labelled(docs, labels, label, key, text, F.lit(True) if learn is None else learn, max_rows), "labelled")
    counts = rows.mapInArrow(_counts_of, "label int, doc long, n long").filter(F.col("n") <= MAX_WORDS)
    known = sorted((r["doc"], r["label"], r["n"]) for r in counts.collect())  # three numbers a row
    chosen = [r[:2] for r, n in zip(known, accumulate(n for _, _, n in known)) if n <= MAX_WORDS]
    held, rest = chosen[::4], [r for i, r in enumerate(chosen) if i % 4]
    found = rows.mapInArrow(_words_of(set(rest)), "label int, doc long, words binary").collect()
    found = sorted((r["doc"], r["label"], bytes(r["words"])) for r in found)
    own = rows.sparkSession.createDataFrame([(d,) for d, _ in rest], "doc long")
    counted = rows.mapInArrow(_vocabulary, "doc long, h long, word binary").join(F.broadcast(own.distinct()), "doc").groupBy("h").agg(F.count("*").alias("n"), F.min("word").alias("word"))
    least = max(MIN_DOCS, len(rest) * MIN_SHARE)
    vocabulary = {r["h"]: bytes(r["word"]) for r in counted.filter(F.col("n") >= least).collect()}
    model = fit_passages([r[1:] for r in found], vocabulary)
    if not model.weights.any():
        return model
    worst = {(r["doc"], r["label"]): r["worst"] for r in rows.mapInArrow(_worst_of(model), "label int, doc long, worst double").collect()}
    return scaled(model, np.array([r[1] for r in held], float), np.array([worst[r] for r in held]))


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            at = batch.schema.names.index("_text")
            rest = [c for i, c in enumerate(batch.columns) if i != at]
            names = [c for i, c in enumerate(batch.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(model.score(batch.column(at)), pa.float64())], names=[*names, "_score"])

    return run


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with _score in [0, 1] (probability of class 1). Null, empty and wordless texts score the prior, as all do
    where there are no labels of both kinds to learn from (1 in 4 where there are none); repeated rows score alike; an
    empty table gives no rows. All columns are kept, whatever their names."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text).alias("_text"))
    return row.mapInArrow(_scorer(model), row.select("_row").schema.add("_score", "double")).select("_row.*", "_score")


def drop_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.5, **options) -> DataFrame:
    """The documents that score below ``limit``; same columns."""
    model = train(docs, labels, **options)
    return scored(docs, model).filter(F.col("_score") < limit).drop("_score")


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"), learn=remainder("doc_id", 5) != 0)
    out = scored(docs, model).select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), F.col("_score").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
