"""Jaccard join, substring dedup, decontamination: against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skylark.llm import components, decontamination, jaccard_join, substring_dedup
from skylark.llm.fm_index import FMIndex, Matches

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute_components(rows, width, num, den):
    sets = []
    for _, t in rows:
        w = SPACE.findall(lower(t))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def plain(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.mark.parametrize("width, num, bound, most", [(4, 85, 4 << 20, 256), (5, 80, 4 << 20, 256), (4, 85, 300, 256), (4, 60, 150, 256), (4, 60, 4 << 20, 2)])
def test_jaccard_join(docs, width, num, bound, most):
    """Small bounds send regions through Voronoi cells and blocks."""
    got = jaccard_join.similar_sets(docs, width, num, 100, bound=bound, most=most)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_components(plain(docs), width, num, 100)


def test_region_links_are_exact():
    rng = np.random.default_rng(1)
    for trial in range(60):
        base = [np.unique(rng.integers(0, 400, 60)) for _ in range(4)]
        sets = [np.unique(np.r_[rng.choice(b, int(len(b) * rng.uniform(0.7, 1)), replace=False), rng.integers(0, 400, rng.integers(0, 6))]).astype(np.uint64) for b in base for _ in range(6)]
        links = jaccard_join.region_links(sets, 7, 10)
        root = list(range(len(sets)))
        find = lambda x: x if root[x] == x else find(root[x])
        for a, b in links:
            hit = len(np.intersect1d(sets[a], sets[b]))
            assert 10 * hit >= 7 * (len(sets[a]) + len(sets[b]) - hit)
            root[find(a)] = find(b)
        for a in range(len(sets)):
            for b in range(a):
                hit = len(np.intersect1d(sets[a], sets[b]))
                if 10 * hit >= 7 * (len(sets[a]) + len(sets[b]) - hit):
                    assert find(a) == find(b)


def test_counts_of_shared_shingles_are_never_too_low(monkeypatch):
    """Shingles of one owner that agree in bucket and 32 bits count as shared; nothing is merged away."""
    a = np.array([5, 5 + (1 << 40), 9], np.uint64)  # bucket 0 of 1: the first two agree in their low 32 bits
    rows = [r for r in jaccard_join._postings([a], [7], 1) if r[0] == 2]
    assert [np.frombuffer(r[7], np.int64).tolist() + np.frombuffer(r[8], np.int64).tolist() for r in rows] == [[7, 1]]


def test_common_phrases_bring_no_documents_together(spark, monkeypatch):
    """Pairs of near copies that all quote one phrase: a region holds a pair, not all holders of the phrase."""
    rng, phrase, rows, sizes = random.Random(3), " ".join(f"p{i}" for i in range(30)), [], []
    for i in range(60):
        own = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        rows += [(2 * i, f"{phrase} {' '.join(own)}"), (2 * i + 1, f"{phrase} {' '.join(own[:-1])} changed")]
    join = jaccard_join._join_regions
    monkeypatch.setattr(jaccard_join, "_join_regions", lambda members, *a: sizes.append(members.groupBy("region").count().agg(F.max("count")).first()[0]) or join(members, *a))
    got = jaccard_join.similar_sets(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, 4, 85, 100)
    assert sizes == [2]


def test_prefixes_keep_one_order_of_all_shingles():
    """The rarest first, then by hash; a listed slot counts for every set that has it."""
    sets = [np.array([1, 2, 3, 4, 5, 6, 7, 8, 9, 10], np.uint64), np.array([1, 2, 11, 12], np.uint64)]
    first = jaccard_join.rarest_first(sets, jaccard_join._slots(np.array([2, 1, 3], np.uint64), 8), np.array([3, 2, 2], np.uint8), 8, 50, 100)
    assert [x.tolist() for x in first] == [[4, 5, 6, 7, 8, 9], [11, 12, 1]]
    assert [len(x) for x in jaccard_join.rarest_first(sets, np.empty(0, np.uint64), np.empty(0, np.uint8), 8, 50, 100)] == [6, 3]


def test_regions_that_pivots_do_not_split_are_not_repeated(spark, monkeypatch):
    """Variants of one text, most of them too far apart to link: all lie about as far from every pivot, so the region goes
    to blocks once and into no cells."""
    rng, base, stuck = random.Random(5), [f"b{i}" for i in range(60)], []
    rows = [(i, " ".join([*base[: (k := rng.randrange(8))], *(f"v{i % 9}x{j}" for j in range(4)), *base[k:]])) for i in range(40)]
    blocks = jaccard_join._in_blocks
    monkeypatch.setattr(jaccard_join, "_in_blocks", lambda m, *a: stuck.append(m.groupBy("dig").count().agg(F.max("count")).first()[0]) or blocks(m, *a))
    got = jaccard_join.similar_sets(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, bound=300, most=4).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, 4, 85, 100)
    assert [n for n in stuck if n] and max(n for n in stuck if n) < 8


def test_many_null_ids(spark):
    """Copies without an id are told apart by their texts, in about the time of those with one."""
    texts = [" ".join(f"w{(i * 7 + j) % 50 if j else i % 40}" for j in range(30)) for i in range(300)]
    rows = [(None, t) for t in texts] + [(1000 + i, t) for i, t in enumerate(texts[:50])] + [(None, None), (None, "")]
    got = jaccard_join.similar_sets(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    want = brute_components([(10**9 if d is None else d, t) for d, t in rows], 4, 85, 100)
    named = lambda x: None if x == 10**9 else x
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted(((named(d), n, named(c)) for d, n, c in want), key=str)


def test_components_of_a_long_chain(spark):
    links = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    out = {r.node: r.root for r in components.components(links, "a", "b").collect()}
    assert out == {i: 0 for i in range(61)}


def test_one_of_each_stays(docs):
    kept = jaccard_join.first_of_each(docs.dropDuplicates(["doc_id"]), width=5, num=80)
    want = {d for d, n, c in brute_components(plain(docs.dropDuplicates(["doc_id"])), 5, 80, 100) if d == c or n == 0}
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == docs.columns


def test_one_row_of_each_stays(spark, docs, empty):
    found = brute_components(plain(docs), 5, 80, 100)
    want = Counter(d for d, n, _ in found if n == 0) + Counter({d for d, n, c in found if n and d == c})
    kept = jaccard_join.first_of_each(docs, width=5, num=80)
    assert docs.count() > docs.dropDuplicates(["doc_id"]).count()  # repeated rows
    assert Counter(r.doc_id for r in kept.collect()) == want and kept.columns == docs.columns
    assert jaccard_join.first_of_each(empty).count() == 0
    near, far, lone = "a b c d e f g", "p q r s t u v", "k l m n o"
    odd = [(1, near), (2, near), (2, far), (None, near), (None, lone), (None, lone), (3, None), (3, "")]
    got = jaccard_join.first_of_each(spark.createDataFrame(odd, "doc_id long, text string"), width=5, num=80).collect()
    assert Counter(map(tuple, got)) == Counter([(1, near), (2, far), (None, lone), (3, None), (3, "")])


def test_null_ids_and_empty_tables(spark, empty):
    rows = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (None, "x"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in jaccard_join.similar_sets(rows, 4, 85).collect()), key=str)
    assert got == sorted([(None, 5), (5, 5), (None, None), (None, None)], key=str)
    assert jaccard_join.similar_sets(empty).count() == 0
    assert substring_dedup.remove_repeats(empty).count() == 0
    cut = substring_dedup.remove_repeats(spark.createDataFrame([(None, "w " * 25), (1, "w " * 25)], "doc_id long, text string"))
    assert sorted(((r.doc_id, r.n_removed) for r in cut.collect()), key=str) == sorted([(None, 24), (1, 25)], key=str)  # the first window stays



def brute_repeats(rows, width):
    first, out = {}, []
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    words = [SPACE.findall(t or "") for _, t in rows]
    for i in order:
        for p in range(len(words[i]) - width + 1):
            first.setdefault(tuple(words[i][p : p + width]), (rows[i][0], p))
    for i, (d, _) in enumerate(rows):
        keep = [True] * len(words[i])
        for p in range(len(words[i]) - width + 1):
            if first[tuple(words[i][p : p + width])] < (d, p):
                keep[p : p + width] = [False] * width
        left = " ".join(w for w, k in zip(words[i], keep) if k)
        out.append((d, len(words[i]), len(words[i]) - sum(keep), hashlib.sha256(left.encode()).hexdigest(), left))
    return sorted(out)


@pytest.mark.parametrize("hot, stretch", [(8, 64), (1, 3)])
def test_substring_dedup(docs, monkeypatch, hot, stretch):
    monkeypatch.setattr(substring_dedup, "HOT_HERE", hot)
    monkeypatch.setattr(substring_dedup, "STRETCH", stretch)
    for width in (20, 9):
        got = substring_dedup.remove_repeats(docs, width=width)
        assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in got.collect()) == brute_repeats(plain(docs), width)


def brute_leaks(rows, items, width=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    phrases = set()
    for name, t in items:
        w = word.findall(lower(t))
        for p in range(max(1, len(w) - width + 1)) if w else []:
            phrases.add((name, tuple(w[p : p + width])))
    out = []
    for d, t in rows:
        w = word.findall(lower(t))
        hit, names = set(), set()
        for name, ph in phrases:
            for p in range(len(w) - len(ph) + 1):
                if tuple(w[p : p + len(ph)]) == ph:
                    hit |= set(range(p, p + len(ph)))
                    names.add(name)
        out.append((d, len(w), len(hit), sorted(names)))
    return sorted(out)


@pytest.mark.parametrize("block", [32 << 20, 200])
def test_decontamination(spark, docs, corpus, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
    long = [t for _, t in corpus if t and len(t.split()) > 90]
    items = [("7", " ".join(long[0].split()[20:45])), ("12", long[1].upper().replace(" ", ", ")), ("3", "A-b"), ("4", None), ("5", "!!"), ("9", "nowhere to be found in any of these odd little texts"), ("7", "one two three")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = decontamination.find_leaks(docs, bench, keep=["doc_id"]).withColumn("n_hit", decontamination.hit_words())
    want = brute_leaks(plain(docs), [(n, t) for n, t in items])
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.items) for r in got.collect()) == want
    clean = decontamination.drop_leaks(docs, bench)
    assert Counter(r.doc_id for r in clean.collect()) == Counter(d for d, _, n, _ in want if not n) and clean.columns == docs.columns


def test_phrases_stay_small():
    """What travels is less than twice the test texts, and windows are not kept."""
    import pickle

    rng = np.random.default_rng(1)
    items = [(str(i), " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(1000))) for i in range(50)]
    assert len(pickle.dumps(decontamination.Phrases(items, 10))) < 2 * sum(len(t) for _, t in items)


def test_decontamination_of_nothing(docs, empty, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find_leaks(docs, none).filter(F.size("spans") > 0).count() == 0
    assert decontamination.find_leaks(empty, none).count() == 0


def test_matching_statistics_are_those_of_brute_force():
    rng = np.random.default_rng(5)
    for trial in range(40):
        width, lengths = int(rng.integers(2, 6)), rng.integers(1, 25, rng.integers(1, 15))
        ids = rng.integers(0, 3, lengths.sum())
        index, ends = FMIndex(ids, lengths, 3, depth=width - 1, sample=5), np.cumsum(lengths)
        windows = {(s, p): tuple(ids[ends[s] - n + p :][:width]) for s, n in enumerate(lengths) for p in range(n - width + 1)}
        got = index.matches(ids, lengths, width)
        assert sorted(zip(got.seq.tolist(), got.start.tolist())) == sorted(windows)
        for s, p, lo, hi, shift in zip(*got):
            own = sorted((index.locate(np.arange(lo, hi)) - shift).tolist())
            assert own == sorted(int(index.begins[t]) + q for (t, q), w in windows.items() if w == windows[s, p])


def test_repeats_come_from_the_index(docs, monkeypatch):
    """Without the index's matches nothing is removed."""
    whole = substring_dedup.remove_repeats(docs, texts=False).agg(F.sum("n_removed")).first()[0]
    none = Matches(*[np.empty(0, np.int64)] * 5)
    monkeypatch.setattr(FMIndex, "matches", lambda *a: none)
    words = np.arange(30, dtype=np.uint64)
    at = np.r_[0, 0]
    assert whole > 0 and not substring_dedup.repeated(words, at, at, np.r_[1, 2], at, 20).any()
    monkeypatch.undo()
    assert substring_dedup.repeated(words, at, np.r_[0, 1], np.r_[1, 2], at, 20).tolist() == [False, True]


def test_hashes_only_route(monkeypatch):
    """Where all anchors, or windows of other words, share their hashes, the index still tells them apart."""
    rng = random.Random(11)
    passage = [rng.choice("abcdefgh") for _ in range(30)]
    texts = [[rng.choice("abcdefgh") for _ in range(rng.randint(0, 40))] + passage[: rng.randint(10, 30)] for _ in range(30)] + [["a"] * 50]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    batch = pa.RecordBatch.from_pydict({"k": list(range(len(rows))), "_text": [t for _, t in rows], "ref": [5 * i for i in range(len(rows))]})
    true_grams = substring_dedup.grams
    for modulus in (None, 3, 1):
        monkeypatch.setattr(substring_dedup, "grams", true_grams if modulus is None else lambda *a: true_grams(*a) % np.uint64(modulus))
        p = substring_dedup.Piece(batch, 12, 8)
        met, gone = p.met(), np.zeros(len(p.at), bool)
        gone[met] = p.repeated(met)
        first = {}
        want = [first.setdefault(tuple(texts[d][s : s + 12]), (d, s)) != (d, s) for d, s in zip(p.doc.tolist(), p.start.tolist())]
        assert gone.tolist() == want and any(want)
        assert modulus is None or len(met) == len(p.at)  # the hash told nothing apart


def test_many_rows_of_one_id_and_text(spark):
    rows = [(1, "a b c d e f g h i j k l")] * 700 + [(2, "a b c d e f g h i j z z")] * 3 + [(None, None)] * 5 + [(None, "q r s t u v w x y z")] * 4
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = substring_dedup.remove_repeats(docs, width=9).groupBy("doc_id", "n_words", "n_removed", "kept").count().collect()
    assert {tuple(r) for r in got} == {(1, 12, 0, "a b c d e f g h i j k l", 700), (2, 12, 10, "z z", 3), (None, 0, 0, "", 5), (None, 10, 0, "q r s t u v w x y z", 4)}


def test_fm_index_round_trip():
    rng = np.random.default_rng(0)
    for trial in range(20):
        lengths = rng.integers(1, 30, rng.integers(1, 20))
        ids = rng.integers(0, 4, lengths.sum())
        index, seqs = FMIndex(ids, lengths, 4, depth=3, sample=4), np.split(ids, np.cumsum(lengths)[:-1])
        patterns, size = rng.integers(-1 if trial % 3 == 0 else 0, 4, (20, 4)), rng.integers(1, 5, 20)
        for p, n, lo, hi in zip(patterns, size, *index.search(patterns.ravel(), 4 * np.arange(20), size)):
            want = sorted(index.begins[i] + j for i, s in enumerate(seqs) for j in range(len(s) - n + 1) if (s[j : j + n] == p[:n]).all())
            assert sorted(index.locate(np.arange(lo, hi))) == want


def test_files_of_the_last_write_are_released(spark):
    """Once a step is staged, release frees its shuffle files too, not only those of the steps before it."""
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in manager.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    before = files()
    jaccard_join.staged(spark.range(1000).repartition(7), "released")
    own = files() - before
    jaccard_join.release(spark)
    end = time.time() + 10
    while own & files() and time.time() < end:
        time.sleep(0.2)
    assert own and not own & files()
