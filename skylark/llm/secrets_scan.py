"""Secret scan with inferred credential grammars.

Fixed patterns find the base spans. Credentials found by them (a bounded sample, harvested from the documents) are the
labelled examples from which one probabilistic automaton for each kind is inferred: a prefix tree whose statistically
compatible states are merged. Ordinary tokens give background automata in the same way, one for each shape (letters,
numbers, both), so that numbers and names are measured against their like. Every other token of credential characters
is then scored by the log-likelihood of the best kind against that of the best background.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._stage import table
from ._words import FOLD, Words, hash_words, pieces, ragged, text_bytes, tokenize

#: Fixed patterns of the base kinds, in the order of their names; the second of each is the least length that counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "grammar")
HINTS = ("pass", "secret", "token", "api")
#: Candidates: whole runs of the characters that assigned values are made of, of their least length; ordinary tokens are
#: learnt from a length of ``SHORT`` on.
CLASSES = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-."
LEAST, SHORT = 6, 4
#: Credentials of each kind, and ordinary tokens of each shape, that are learnt from: those of least hash, of so many
#: characters at most. Longer tokens are scored whole, too.
MAX_EXAMPLES, MAX_LENGTH = 3000, 256
#: Hoeffding bound of state compatibility (ALERGIA) and the least visits of a tested state.
ALPHA, LEAST_VISITS = 0.05, 20
#: Nats per character, and in all, by which a credential kind must beat the background.
MARGIN, EVIDENCE = 0.5, 12.0
UNSEEN = 0.05
END = "$"
_CLASS = np.zeros(256, np.int64)
_CLASS[[ord(c) for c in CLASSES]] = np.arange(len(CLASSES))
_TOKEN = np.zeros(256, bool)
_TOKEN[[ord(c) for c in CLASSES]] = True
_LETTER, _DIGIT = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[ord(c) for c in CLASSES if c.isalpha()]] = True
_DIGIT[[ord(c) for c in CLASSES if c.isdigit()]] = True
_LOWER = _LETTER & (np.arange(256) >= ord("a"))
_DOT = ord(".")


class Automaton:
    """Deterministic probabilistic automaton: counts of visits, ends and transitions of each state."""

    def __init__(self) -> None:
        self.visits, self.ends, self.next = [0], [0], [{}]

    def add(self, word: str) -> None:
        state = 0
        self.visits[0] += 1
        for c in word:
            if c not in self.next[state]:
                self.next[state][c] = [len(self.visits), 0]
                self.visits.append(0)
                self.ends.append(0)
                self.next.append({})
            step = self.next[state][c]
            step[1] += 1
            state = step[0]
            self.visits[state] += 1
        self.ends[state] += 1

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def compatible(self, a: int, b: int, into: dict[int, int]) -> bool:
        """Whether both states end and go on alike, and so do the states that they lead to; merged states count as
        those that they joined."""
        stack, seen = [(a, b)], set()
        while stack:
            pair = tuple(_last(x, into) for x in stack.pop())
            a, b = pair
            n1, n2 = self.visits[a], self.visits[b]
            if a == b or pair in seen or n1 < LEAST_VISITS or n2 < LEAST_VISITS:
                continue
            seen.add(pair)
            if self._differ(self.ends[a], n1, self.ends[b], n2):
                return False
            for c in self.next[a].keys() | self.next[b].keys():
                x, y = self.next[a].get(c), self.next[b].get(c)
                if self._differ(x[1] if x else 0, n1, y[1] if y else 0, n2):
                    return False
                if x and y:
                    stack.append((x[0], y[0]))
        return True

    def fold(self, a: int, b: int, into: dict[int, int]) -> set[int]:
        """Merge the tree below b into a; returns the states that grew."""
        stack, grown = [(a, b)], set()
        while stack:
            a, b = (_last(x, into) for x in stack.pop())
            if a == b:
                continue
            into[b] = a
            grown.add(a)
            self.visits[a] += self.visits[b]
            self.ends[a] += self.ends[b]
            for c, (to, n) in self.next[b].items():
                if c in self.next[a]:
                    self.next[a][c][1] += n
                    stack.append((self.next[a][c][0], to))
                else:
                    self.next[a][c] = [to, n]
        return grown

    def merged(self) -> Automaton:
        """Red states are settled; a state that one of them leads to joins the first compatible red one, or turns red.
        A red state that has grown is looked at again."""
        into: dict[int, int] = {}
        red, settled, todo = [0], {0}, [0]
        while todo:
            r = _last(todo.pop(), into)
            for c in sorted(self.next[r], key=lambda c: (-self.next[r][c][1], c)):
                to = self.next[r][c][0] = _last(self.next[r][c][0], into)
                if to in settled:
                    continue
                # states seen too seldom to be told apart join their likeliest kin: the last red one
                mate = next((q for q in reversed(red) if self.compatible(q, to, into)), None)
                if mate is None:
                    red.append(to)
                    settled.add(to)
                    todo.append(to)
                else:
                    grown = self.fold(mate, to, into)
                    red = [q for q in red if q not in into]
                    settled = set(red)
                    todo += [q for q in grown if q in settled]
            if r not in into and any(_last(to, into) not in settled for to, _ in self.next[r].values()):
                todo.append(r)
        for r in red:
            for step in self.next[r].values():
                step[0] = _last(step[0], into)
        return self.only(red)

    def only(self, states: list[int]) -> Automaton:
        """The automaton of these states, which lead to each other only."""
        out, number = Automaton(), {s: i for i, s in enumerate(states)}
        out.visits, out.ends = [self.visits[s] for s in states], [self.ends[s] for s in states]
        out.next = [{c: [number[to], n] for c, (to, n) in self.next[s].items()} for s in states]
        return out

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(next state, log-likelihood) of each state and class, and the log-likelihood of an end in each state. A
        fixed share of the mass is for unseen transitions, which return to the start, so automata of few and of many
        examples compare."""
        rest, seen = UNSEEN / (len(CLASSES) + 1), np.zeros((len(self.visits), len(CLASSES)))
        to = np.zeros(seen.shape, np.int32)
        for i, steps in enumerate(self.next):
            for c, (state, n) in steps.items():
                to[i, CLASSES.index(c)], seen[i, CLASSES.index(c)] = state, n
        share = (1 - UNSEEN) / np.maximum(1, np.array(self.visits))
        return to, np.log(seen * share[:, None] + rest), np.log(np.array(self.ends) * share + rest)

    def per_character(self, word: str) -> float:
        """Log-likelihood for each character and the end."""
        data = np.frombuffer(word.encode(), np.uint8)
        return float(log_likelihood(self.tables(), data, np.zeros(1, np.int64), np.array([len(data)]))[0] / (len(word) + 1))


def _last(state: int, into: dict[int, int]) -> int:
    while state in into:
        state = into[state]
    return state


def log_likelihood(tables: tuple[np.ndarray, np.ndarray, np.ndarray], data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Log-likelihood of the words data[start : end], all at once, character by character; the few longest singly."""
    to, step, end = tables
    size = ends - starts
    state, total = np.zeros(len(starts), np.int64), np.zeros(len(starts))
    order = np.argsort(-size, kind="stable")
    for j in range(int(min(size.max(initial=0), MAX_LENGTH))):
        order = order[: np.searchsorted(-size[order], -j)]
        c = _CLASS[data[starts[order] + j]]
        total[order] += step[state[order], c]
        state[order] = to[state[order], c]
    for i in np.flatnonzero(size > MAX_LENGTH):
        at, sum_ = int(state[i]), 0.0
        for c in _CLASS[data[starts[i] + MAX_LENGTH : ends[i]]].tolist():
            sum_ += step[at, c]
            at = to[at, c]
        total[i], state[i] = total[i] + sum_, at
    return total + end[state]


def infer(words: list[str]) -> Automaton:
    a = Automaton()
    for w in sorted(words):
        a.add(w)
    return a.merged()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, leftmost non-overlapping for each kind."""
    out = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def credential(text: str, span: tuple[int, int, int]) -> str:
    return ASSIGN.fullmatch(text[span[0] : span[2]])[2] if span[1] == 0 else text[span[0] : span[2]]


class Tokens:
    """Candidate tokens of a batch of texts, without dots around them, of the least length on; those inside a base span
    are left out. ``spans`` holds the base spans of each text, in code points."""

    def __init__(self, texts: pa.Array, least: int = LEAST):
        self.words: Words = tokenize(texts, _TOKEN)
        w = self.words
        starts, ends = w.starts.copy(), w.ends.copy()
        while (dot := (ends > starts) & (w.data[np.minimum(starts, len(w.data) - 1)] == _DOT)).any() if len(starts) else False:
            starts[dot] += 1
        while (dot := (ends > starts) & (w.data[ends - 1] == _DOT)).any() if len(starts) else False:
            ends[dot] -= 1
        whole = texts.to_pylist()
        self.spans = [base_spans(t or "") for t in whole]
        self.credentials = [(s[1], credential(t, s)) for t, spans in zip(whole, self.spans) for s in spans]
        keep = ends - starts >= least
        self.first = text_bytes(texts)[1]
        for i, spans in enumerate(self.spans):
            if spans:  # tokens inside the one that starts before them and reaches furthest
                own = slice(w.offsets[i], w.offsets[i + 1])
                point = self.bytes_of(i)
                begin, reach = point[[s for s, _, _ in spans]], np.maximum.accumulate(point[[e for _, _, e in spans]])
                before = np.searchsorted(begin, starts[own], "right") - 1
                keep[own] &= (before < 0) | (ends[own] > reach[before])
        self.text = np.repeat(np.arange(len(whole)), np.diff(w.offsets))[keep]
        self.starts, self.ends = starts[keep], ends[keep]
        h = w.hashes[keep]
        trimmed = (starts != w.starts)[keep] | (ends != w.ends)[keep]
        if trimmed.any():
            h = h.copy()
            h[trimmed] = hash_words(w.data, self.starts[trimmed], self.ends[trimmed])
        self.hash, self.distinct, self.of = np.unique(h, return_index=True, return_inverse=True)

    def bytes_of(self, i: int) -> np.ndarray:
        """Where each code point of text i, and its end, begins among all bytes."""
        own = self.words.data[self.first[i] : self.first[i + 1]]
        return self.first[i] + np.r_[np.flatnonzero(own & 0xC0 != 0x80), len(own)]

    def shapes(self) -> np.ndarray:
        """Of the distinct tokens: -1 letters, -2 digits, -3 both (neither counts as letters)."""
        starts, size = self.starts[self.distinct], (self.ends - self.starts)[self.distinct]
        at, head = ragged(starts, size), np.cumsum(size) - size
        if not len(size):
            return np.empty(0, np.int64)
        letter, digit = (np.logical_or.reduceat(kind[self.words.data[at]], head) for kind in (_LETTER, _DIGIT))
        return np.where(digit, np.where(letter, -3, -2), -1)

    def word(self, i: int) -> str:
        return self.words.data[self.starts[i] : self.ends[i]].tobytes().decode()


def _harvest(limit: int):
    """The examples of least hash of each kind and of ordinary tokens of each shape of a task; merged by the caller."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, dict[str, int]] = {}
        for batch in pieces(batches, "_text"):
            t = Tokens(batch.column(0), SHORT)
            for kind, word in set(t.credentials):
                if len(word) <= MAX_LENGTH:
                    kept.setdefault(kind, {})[word] = int(tokenize(pa.array([word]), _TOKEN).hashes[0] >> np.uint64(1))
            shapes, short = t.shapes(), (t.ends - t.starts)[t.distinct] <= MAX_LENGTH
            for shape in (-1, -2, -3):
                own = np.flatnonzero((shapes == shape) & short)[:limit]  # np.unique sorts by hash
                kept.setdefault(shape, {}).update((t.word(t.distinct[i]), int(t.hash[i] >> np.uint64(1))) for i in own)
            for kind, own in kept.items():
                if len(own) > 4 * limit:
                    kept[kind] = dict(sorted(own.items(), key=lambda x: (x[1], x[0]))[:limit])
        rows = [(k, w, h) for k, own in kept.items() for w, h in sorted(own.items(), key=lambda x: (x[1], x[0]))[:limit]]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["kind", "word", "hash"])

    return run


def train(docs: DataFrame, text: str = "text", limit: int = MAX_EXAMPLES) -> dict[int, Automaton]:
    """One automaton for each credential kind, and for each shape of ordinary tokens (-1 to -3), with at least 5
    distinct examples; at most ``limit`` of each are learnt from, those of least hash."""
    found = docs.select(F.col(text).alias("_text")).mapInArrow(_harvest(limit), "kind int, word string, hash long").distinct()
    top = found.withColumn("i", F.row_number().over(Window.partitionBy("kind").orderBy("hash", "word"))).filter(F.col("i") <= limit)
    words: dict[int, list[str]] = {}
    for r in top.collect():  # at most ``limit`` words of ``MAX_LENGTH`` characters for each of six kinds
        words.setdefault(r["kind"], []).append(r["word"])
    return {k: infer(v) for k, v in words.items() if len(v) >= 5}


class Scanner:
    def __init__(self, models: dict[int, Automaton]):
        self.kinds = [m.tables() for k, m in sorted(models.items()) if k >= 0]
        self.background = [m.tables() for k, m in sorted(models.items()) if k < 0]

    def scores(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How many nats the best credential kind explains each token better than the best background. A token without
        lower-case letters counts as its lower-cased form, where that is likelier: formats are written in either case."""
        if not self.kinds or not self.background or not len(starts):
            return np.full(len(starts), -math.inf)
        size = ends - starts
        at, head = ragged(starts, size), np.cumsum(size) - size
        folded = FOLD[data[at]]
        upper = ~np.logical_or.reduceat(_LOWER[data[at]], head) & np.logical_or.reduceat(folded != data[at], head)

        def best(models: list) -> np.ndarray:
            out = np.max([log_likelihood(m, data, starts, ends) for m in models], 0)
            if upper.any():
                low = np.max([log_likelihood(m, folded, head[upper], (head + size)[upper]) for m in models], 0)
                out[upper] = np.maximum(out[upper], low)
            return out

        return best(self.kinds) - best(self.background)

    def spans(self, texts: pa.Array) -> list[list[tuple[int, int, int]]]:
        """Of each text, by start and kind: base spans, and tokens beyond them that score above the margins (kind 3)."""
        t = Tokens(texts)
        starts, ends = t.starts[t.distinct], t.ends[t.distinct]
        score = self.scores(t.words.data, starts, ends)
        secret = (score > EVIDENCE) & (score > MARGIN * (ends - starts + 1))
        out, hit = [list(s) for s in t.spans], np.flatnonzero(secret[t.of])
        for i in np.unique(t.text[hit]):
            own = hit[slice(*np.searchsorted(t.text[hit], [i, i + 1]))]
            point = t.bytes_of(i)
            out[i] = sorted(out[i] + list(zip(np.searchsorted(point, t.starts[own]).tolist(), [3] * len(own), np.searchsorted(point, t.ends[own]).tolist())))
        return out


def _scanning(scanner: Scanner):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            found = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans] for spans in scanner.spans(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))], names=["_row", "secrets"])

    return run


def find_secrets(docs: DataFrame, text: str = "text", models: dict[int, Automaton] | None = None) -> DataFrame:
    """``docs`` with secrets: an array of (kind, start, end) in code points, end exclusive, by start, then kind.

    Kinds are assign, access, hex and grammar. Null and empty texts hold none; where too few examples exist to infer
    a grammar only base spans are found; repeated rows are judged alike; a column named secrets is replaced.
    """
    models = train(docs, text) if models is None else models
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "secrets"]).alias("_row"), F.col(text).alias("_text"))
    schema = row.select("_row", F.lit(None).cast("array<struct<kind:string,start:int,end:int>>").alias("secrets")).schema
    return row.mapInArrow(_scanning(Scanner(models)), schema).select("_row.*", "secrets")


def op8_secret_grammars(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(F.filter("secrets", lambda s: s["kind"] != "grammar")), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))
