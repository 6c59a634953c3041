"""Prefix tries, periodic runs and suffix arrays against brute force, on odd tables and with bounds that make every
path run."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from skylark.llm import periodic_runs, prefix_trie, suffix_dedup

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


# prefix tries --------------------------------------------------------------------------------------------------------


def trie(rows):
    """Nodes of the rebuilt conversations of (conv_id, turn, role, text)."""
    own: dict[int, list] = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    seqs = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in seqs}
    built = {c: tuple(seqs.get(c - c % 100, [])[: h[c]] + s[h[c] :]) for c, s in seqs.items()}
    members: dict[tuple, list[int]] = {}
    for c, s in built.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    ends = lambda p: sha(",".join(str(c) for c in sorted(members[p]) if built[c] == p).encode())
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p], ends(p)) for p, m in members.items())


def nodes_of(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


@pytest.fixture(scope="module")
def turns():
    rng, rows = random.Random(5), []
    for c in [*range(0, 40), 100, *range(130, 190), 205, 311]:  # 200 and 300 are absent
        for t in range(rng.choice((1, 2, 3, 7))):
            rows.append((c, t, rng.choice(("user", "bot", None)), rng.choice(("a", "b", "é" * 60, "x" * 60 + "1", "x" * 60 + "2", None, ""))))
    rows += [(7, 3, "user", "x" * 60 + "2"), (7, 3, "user", "x" * 60 + "1"), (7, None, "user", "late"), (7, 3, None, "x")]  # ties and a null turn
    rows += [(c, 0, "u", "hello") for c in range(5000, 5300)] + [(None, 0, "u", "nobody")]
    return rows


@pytest.mark.parametrize("shard", [1, 7, 100, prefix_trie.SHARD_TURNS])
def test_trie_nodes(spark, turns, shard):
    df = spark.createDataFrame([(*r, "clash") for r in turns], "conv_id long, turn long, role string, text string, path string").repartition(3)
    got = prefix_trie.prefix_nodes(prefix_trie.rebuilt_paths(prefix_trie.turn_paths(df)), shard)
    assert nodes_of(got) == trie(turns)


def test_trie_of_nothing(spark, turns):
    df = spark.createDataFrame(turns[:1], "conv_id long, turn long, role string, text string").filter("turn < 0")
    assert nodes_of(prefix_trie.prefix_nodes(prefix_trie.rebuilt_paths(prefix_trie.turn_paths(df)))) == []


def test_many_ids_of_one_path(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ID_BLOCK", 8)  # the ids' hash runs over many blocks
    paths = spark.range(-50, 300).selectExpr("id AS conv_id", "array(struct(1L AS a, 2L AS b, 3 AS n)) AS path").repartition(5)
    got = nodes_of(prefix_trie.prefix_nodes(paths))
    want = sha(",".join(map(str, range(-50, 300))).encode())
    assert [(g[1], g[3], g[6]) for g in got] == [(0, 350, 349 * 3), (1, 350, 349 * 3)] and got[1][7] == want


def test_double_array_holds_every_path():
    rng = random.Random(3)
    for _ in range(40):
        paths = sorted({tuple(rng.choice((1, 2, 3, 50, 51, 900)) for _ in range(rng.randint(0, 6))) for _ in range(60)})
        flat, offsets = np.array([x for p in paths for x in p], np.int64), np.cumsum([0, *map(len, paths)])
        t = prefix_trie.DoubleArray(prefix_trie.dense_ids(flat, flat * 7, offsets), offsets)
        seen = {}
        for d, (live, state) in enumerate(t.walk()):
            for p, s in zip(live.tolist(), state.tolist()):
                assert seen.setdefault(s, paths[p][:d]) == paths[p][:d]
        assert len(seen) == len({p[:d] for p in paths for d in range(len(p) + 1)}) == int((t.check >= 0).sum())


# periodic runs -------------------------------------------------------------------------------------------------------


def runs_of(key, text):
    w = WORDS.findall((text or "").encode())
    n, h = len(w), 1 if key is None else zlib.crc32(str(key).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    ids: dict[bytes, int] = {}
    x, found = np.array([ids.setdefault(v, len(ids)) for v in w], int), []
    for q in range(1, n // 4 + 1):
        edge = np.flatnonzero(np.diff(np.r_[0, (x[:-q] == x[q:]).astype(int), 0]))
        for s, e in zip(edge[::2].tolist(), (edge[1::2] + q).tolist()):
            if e - s >= max(6, 4 * q) and not any(a <= s and e <= b for a, b, _ in found):
                found.append((s, e, q))
    runs = sorted(((s, e - s, q) for s, e, q in found), key=lambda r: (r[0], r[2]))
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    listed = "".join("%d,%d,%d\n" % r for r in runs).encode()
    return (str(key), len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(listed), sha(b" ".join(v for i, v in enumerate(w) if i not in gone)))


@pytest.fixture(scope="module")
def periodic(corpus):
    rng, rows = random.Random(11), list(corpus)
    for i, q in enumerate((1, 2, 3, 5, 8, 13, 40, 64, 130, 300)):
        unit = [rng.choice("abc") + rng.choice("defg") for _ in range(q)]
        noise = [rng.choice("uvwxyz") for _ in range(rng.randint(0, 90))]
        rows.append((2000 + i, " ".join(noise + (unit * 12)[: q * 4 + rng.randint(0, 3 * q)] + noise[::-1] + unit * 5)))
    rows += [(3000 + i, " ".join(rng.choice("ab") for _ in range(rng.randint(1, 400)))) for i in range(40)]
    return rows + [(None, "p q " * 30), rows[0], rows[0], (None, None), (4000, "é é é é é é"), (4001, "a\x1ca " * 9)]


@pytest.mark.parametrize("tile", [64, 512, periodic_runs.TILE])
def test_runs(spark, periodic, tile):
    df = spark.createDataFrame([(*r, 1, "clash") for r in periodic], "doc_id long, text string, n long, words string").repartition(3)
    got = periodic_runs.find_runs(df, tile=tile).collect()
    key = lambda r: tuple(map(str, r))
    want = sorted((runs_of(*r) for r in periodic), key=key)
    assert sorted(((str(r.doc_id), r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in got), key=key) == want
    assert all(sha(r.collapsed.encode()) == r.collapsed_sha256 for r in got if r.collapsed is not None)


def test_runs_of_nothing(spark, empty):
    assert periodic_runs.find_runs(empty).count() == 0


# suffix arrays -------------------------------------------------------------------------------------------------------


def test_windows_of_stretches():
    """Small and large blocks find the same, however the text repeats itself."""
    for seed in range(300):
        rng = random.Random(seed)
        width = rng.choice((12, 20, 37, 400))
        pool = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 3 * width // 2))) for _ in range(4)]
        bodies = sorted({b"".join(rng.choice(pool) for _ in range(rng.randint(1, 6)))[: 4 * width] for _ in range(rng.randint(1, 8))})
        bodies = [b for b in bodies if len(b) >= width] or [b"a" * 3 * width]
        count = Counter(b[i : i + width] for b in bodies for i in range(len(b) - width + 1))
        want = [[count[b[i : i + width]] > 1 for i in range(len(b) - width + 1)] for b in bodies]
        for block in (1 << 20, 2 * width):
            assert [g.tolist() for g in suffix_dedup.repeated_windows(bodies, np.ones(len(bodies), int), width, block)] == want, seed


def removed(docs, width=400):
    texts = [(t or "").encode() for _, t in docs]
    count = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for (k, _), t in zip(docs, texts):
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - width + 1):
            if count[t[i : i + width]] > 1:
                gone[i] += 1
                gone[i + width] -= 1
        keep = np.cumsum(gone)[: len(t)] == 0
        kept = np.frombuffer(t, np.uint8)[keep].tobytes()
        out.append((str(k), len(t), len(t) - len(kept), int((~keep & np.r_[True, keep[:-1]]).sum()), sha(kept)))
    return sorted(out)


@pytest.fixture(scope="module")
def passages(corpus):
    rng = random.Random(23)
    text = lambda n: "".join(rng.choice("abcdé fgh") for _ in range(n))
    line, passage, short = text(390), text(700), text(330)
    rows = [r for r in corpus if r[1] is None or len(r[1]) < 9000]
    rows += [(5000 + i, text(rng.randint(0, 300)) + rng.choice((line, passage, short)) + text(rng.randint(0, 300))) for i in range(60)]
    rows += [(6000, "ab" * 700), (6001, "ab" * 250 + text(500)), (6002, text(50) + passage + passage[:500]), (None, passage), (None, passage), (6003, "x" * 399), (6004, "x" * 400), (6005, "é" * 220)]
    return rows + [rows[3], rows[3]]


@pytest.mark.parametrize("hot,block", [(32, 512 << 10), (1, 4000)])
def test_repeated_bytes_go(spark, passages, monkeypatch, hot, block):
    monkeypatch.setattr(suffix_dedup, "HOT_HERE", hot)
    df = spark.createDataFrame([(*r, "clash", 1) for r in passages], "doc_id long, text string, part string, n_bytes int").repartition(3)
    key = lambda r: (str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
    got = suffix_dedup.remove_repeated_bytes(df, block=block).collect()
    assert sorted(map(key, got)) == removed(passages)
    assert all(sha(bytes(r.kept)) == r.kept_sha256 for r in got)
    plain = suffix_dedup.remove_repeated_bytes(df, texts=False, block=block).collect()
    assert sorted(map(key, plain)) == sorted(map(key, got)) and not any(r.kept for r in plain)


def test_repeated_bytes_across_parts_of_a_long_text(spark):
    """A text is anchored in parts of about a million bytes; a passage over the edge of two is found in both texts."""
    rng = np.random.default_rng(2)
    long = bytes(rng.integers(97, 123, 1_200_000, dtype=np.uint8)).decode()
    at = suffix_dedup.CHUNK - 400
    rows = [(1, long), (2, "!" + long[at - 650 : at + 650] + "!"), (3, "?" + long[at - 100 : at + 299] + "?")]
    got = suffix_dedup.remove_repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string"), texts=False).collect()
    want = [(1, 1300, 1, sha((long[: at - 650] + long[at + 650 :]).encode())), (2, 1300, 1, sha(b"!!")), (3, 0, 0, sha(rows[2][1].encode()))]
    assert sorted((r.doc_id, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


def test_repeated_bytes_of_nothing(spark, empty):
    assert suffix_dedup.remove_repeated_bytes(empty).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeated_bytes(empty, width=100)
