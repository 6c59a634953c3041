"""Every stage of the pipeline against plain Python, and the whole on odd tables."""

from __future__ import annotations

import hashlib
import math
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from skylark.llm import toxicity

sys.path.insert(0, str(Path(__file__).parent))
from test_groups import brute_components, brute_leaks  # noqa: E402
from test_others import brute_shards, brute_targets  # noqa: E402

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"
MASK = (1 << 64) - 1


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def stage(spark, docs, name):
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, SF)
    assert name == "sharding" or out.columns == docs.columns
    return out.collect()


def mixed(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def plain_score(model, text):
    """The score from its definition, n-gram by n-gram and passage by passage."""
    words = [w.lower() for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode())]

    def of_word(w):
        t, weights, whole = b"<" + w + b">", [], 0
        for n in toxicity.SIZES:
            for i in range(len(t) - n + 1):
                h = 0
                for c in t[i : i + n]:
                    h = (h * 0x100000001B3 + c) & MASK
                weights.append(model.weights[mixed((h + n) & MASK) % toxicity.BUCKETS])
        for c in t:
            whole = (whole * toxicity.MULT + c) & MASK
        return float(np.mean([*weights, model.weights[mixed(whole) % toxicity.BUCKETS]]))

    count = -(-len(words) // toxicity.PASSAGE)
    worst = model.bias
    for i in range(count):
        part = words[i * len(words) // count : (i + 1) * len(words) // count]
        logit = model.bias + sum(of_word(w) for w in set(part)) / max(len(part), toxicity.LEAST)
        worst = logit if i == 0 else max(worst, logit)
    return 1 / (1 + math.exp(-(worst * model.scale[0] + model.scale[1])))


def test_toxicity_stage(spark, docs):
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = docs.collect()
    want = {r.doc_id: plain_score(model, r.text) for r in rows}
    got = {r.doc_id: r._score for r in toxicity.scored(docs, model).collect()}
    assert all(got[d] == pytest.approx(want[d], abs=1e-9) for d in want)
    kept = {r.doc_id for r in stage(spark, docs, "toxicity")}
    assert kept == {d for d, s in want.items() if s < 0.5} and 0 < len(kept) <= len(rows)


def test_near_copies_stage(spark, docs):
    found = brute_components([(r.doc_id, r.text) for r in docs.collect()], 5, 80, 100)
    assert {r.doc_id for r in stage(spark, docs, "near_copies")} == {d for d, n, c in found if d == c or not n}


def test_decontamination_stage(spark, docs):
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    word, short = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), []
    grams = {tuple(w[i : i + 10]) for _, t in items for w in [word.findall(t.lower())] for i in range(len(w) - 9)}
    short = [i for i in items if len(word.findall(i[1].lower())) < 10]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    dirty = {d for d, t in rows for w in [word.findall((t or "").lower())] if any(tuple(w[i : i + 10]) in grams for i in range(len(w) - 9))}
    dirty |= {d for d, _, n, _ in brute_leaks(rows, short) if n} if short else set()
    assert {r.doc_id for r in stage(spark, docs, "decontamination")} == {d for d, _ in rows} - dirty


def test_mixing_stage(spark, docs):
    rows, sizes = docs.collect(), Counter()
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows}
    for r in rows:
        sizes[r.source] += size[r.doc_id]
    target, want = brute_targets(sizes), Counter()
    for r in rows:
        rate = target[r.source] / sizes[r.source] if sizes[r.source] else 0
        draw = int(hashlib.md5(f"mix-1:{r.doc_id}".encode()).hexdigest()[:8], 16) / 2**32
        want[r.doc_id] = math.floor(rate) + (draw < rate - math.floor(rate))
    assert Counter(r.doc_id for r in stage(spark, docs, "mixing")) == +want


def test_sharding_stage(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.unionByName(docs.limit(40)).collect()]
    repeated = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in stage(spark, repeated, "sharding")]
    assert sorted(got) == sorted(brute_shards(rows, 24))


def test_the_whole_is_its_stages(spark, docs):
    rows = docs
    for name, f in corpus_pipeline.STAGES[:-1]:
        rows = spark.createDataFrame(f(spark, rows, SF).collect(), docs.schema)
    want = corpus_pipeline.STAGES[-1][1](spark, rows, SF).collect()
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, want)) and want


def test_what_a_stage_was_made_from_is_deleted(spark, tmp_path):
    from skylark.llm import _stage

    before = _stage.staged(spark.range(3), "before")
    corpus_pipeline.run(spark, SF).collect()
    names = [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in _stage._paths(spark)]
    first = names.index("before")
    assert names[first + 1 :] == ["pipeline-mixing", "shard-keys", "shard-places"] and before.count() == 3
    n = _stage.staged_so_far(spark)
    _stage.staged(spark.range(1), "one"), _stage.staged(spark.range(1), "two")
    _stage.discard(spark, keep=1, since=n)
    assert [p.rsplit("/", 1)[1][:3] for p in _stage._paths(spark)[n:]] == ["two"]


SCHEMAS = {"documents": "doc_id long, text string, lang string, source string, n_chars long, _text string, size int, k string", "labels": "doc_id long, quality int, toxic int, label string", "benchmark": "item_id long, text string"}
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ODD = {
    "documents": [(None, None, None, None, None, None, None, None), (1, "", "en", None, 0, "x", 1, "y"), (1, "a b c d e f", "en", "s", 3, None, None, None), (1, "a b c d e f", "en", "s", 3, None, None, None), (2, "A b c D e f", "en", "s", 3, None, None, None), (None, "z y x w v u t", None, "s", 1, None, None, None), (7, LONG, "en", "t", 9, None, None, None), (8, LONG + " tail", "en", "t", 9, None, None, None)],
    "labels": [(1, None, 0, "x"), (None, 1, 1, None), (1, 1, 0, None), (9, 0, 1, None)],
    "benchmark": [(None, None), (1, ""), (2, "no such words here at all in any of these odd texts")],
}


@pytest.mark.parametrize("case", ["odd", "empty", "no documents", "no labels"])
def test_odd_tables(spark, tmp_path, case):
    """Nulls in every column, empty and very long texts, ties, repeated rows, extra columns with clashing names."""
    for name, schema in SCHEMAS.items():
        rows = [] if case == "empty" or case == f"no {name}" else ODD[name]
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in out}
    assert ids <= {None, 1, 7} and (bool(out) == (case in ("odd", "no labels")))
    assert all(0 <= r.shard < 24 for r in out) and all(sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out))) for s in {r.shard for r in out})
