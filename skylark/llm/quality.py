"""Quality classifier: a sparse rule ensemble over text statistics, scored as one Spark expression.

Small boosted trees are grown on the statistics of labelled rows; every path from a root to a node is a conjunctive rule;
an L1-penalised logistic fit weighs the rules and drops most; the rest are compiled into column expressions, so scoring
is a projection inside the JVM.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._stage import table
from .toxicity import labelled, remainder

#: Labelled rows that are learnt from: those of least hash.
MAX_ROWS = 6000
TREES, DEPTH, LEAST_LEAF, SHARE, STEP = 24, 3, 8, 0.6, 0.3
#: Penalties tried, largest first; the one of least loss on held-back rows wins.
PENALTIES = (0.02, 0.005, 0.0015, 0.0005)


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text as column expressions; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    chars = F.greatest(F.length(t), F.lit(1)).cast("double")
    words = F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.split(t, "\n")
    left = lambda pattern: F.length(F.regexp_replace(t, pattern, "")) / chars  # noqa: E731  share of characters outside the class
    n = F.greatest(F.size(words), F.lit(1)).cast("double")
    return {
        "chars": F.length(t).cast("double"),
        "words": F.size(words).cast("double"),
        "word_length": chars / n,
        "distinct_words": F.size(F.array_distinct(words)) / n,
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines).cast("double"),
        "line_words": n / F.size(lines).cast("double"),
        "upper": left(r"[^A-ZÀ-Þ]+"),
        "marks": left(r"[^#$%&*+<=>@\[\]^_{}~]+"),
        "bars": left(r"[^|]+"),
        "shouts": left(r"[^!?]+"),
        "digits": left(r"[^0-9]+"),
        "stops": left(r"[^.,;:]+"),
    }


class Rule(NamedTuple):
    tests: tuple[tuple[str, bool, float], ...]  # (statistic, above, bound), all of which hold

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, above, bound in self.tests:
            out &= (x[name] > bound) == above
        return out

    def column(self) -> Column:
        out = None
        for name, above, bound in self.tests:
            test = F.col(f"_stats.{name}") > F.lit(float(bound)) if above else F.col(f"_stats.{name}") <= F.lit(float(bound))
            out = test if out is None else out & test
        return out


class Model(NamedTuple):
    rules: tuple[tuple[Rule, float], ...]
    bias: float

    def column(self) -> Column:
        total = F.lit(float(self.bias))
        for rule, weight in self.rules:
            total = total + F.when(rule.column(), F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _paths(x: dict[str, np.ndarray], cuts: dict[str, np.ndarray], rows: np.ndarray, names: list[str], grad: np.ndarray, hess: np.ndarray, tests: tuple, out: list, value: np.ndarray) -> None:
    """Grow one tree by second-order gain; every node but the root adds its path to ``out``."""
    if tests:
        out.append(Rule(tuple(sorted(tests))))
    best = (1e-6, None, None)
    g, h = grad[rows].sum(), hess[rows].sum()
    if len(tests) < DEPTH and len(rows) >= 2 * LEAST_LEAF:
        for name in names:
            at = np.searchsorted(cuts[name], x[name][rows], "left")  # rows right of cut i have at > i
            k = len(cuts[name])
            gl = np.cumsum(np.bincount(at, grad[rows], k + 1))[:k]
            hl = np.cumsum(np.bincount(at, hess[rows], k + 1))[:k]
            nl = np.cumsum(np.bincount(at, minlength=k + 1))[:k]
            ok = (nl >= LEAST_LEAF) & (len(rows) - nl >= LEAST_LEAF)
            gain = np.where(ok, gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1), 0)
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), name, float(cuts[name][gain.argmax()]))
    if best[1] is None:
        value[rows] = -g / (h + 1)
        return
    above = x[best[1]][rows] > best[2]
    for side in (False, True):
        _paths(x, cuts, rows[above == side], names, grad, hess, (*tests, (best[1], side, best[2])), out, value)


def grow_rules(x: dict[str, np.ndarray], y: np.ndarray, seed: int = 5) -> list[Rule]:
    rng, names, rules = np.random.default_rng(seed), list(x), []
    cuts = {n: np.unique(np.quantile(v, np.linspace(0.01, 0.99, 50))) for n, v in x.items()}
    f = np.full(len(y), np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        rows = np.flatnonzero(rng.random(len(y)) < SHARE)
        value = np.zeros(len(y))
        own = [n for n in names if rng.random() < 0.7] or names
        _paths(x, cuts, rows, own, p - y, p * (1 - p), (), rules, value)
        f += STEP * value  # rows outside the sample stay behind, which keeps trees different
    return list(dict.fromkeys(rules))


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty on centred rules, by accelerated proximal gradient."""
    mean = r.mean(0)
    z, n = r - mean, len(y)
    step = 4 * n / (np.linalg.eigvalsh(z.T @ z)[-1] + n)
    w, b, v, c, t = np.zeros(z.shape[1]), 0.0, np.zeros(z.shape[1]), 0.0, 1.0
    for _ in range(rounds):
        d = 1 / (1 + np.exp(-(z @ v + c))) - y
        new, shift = v - step * (z.T @ d) / n, c - step * d.mean()
        new = np.sign(new) * np.maximum(0, np.abs(new) - step * penalty)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / nt * (new - w), shift + (t - 1) / nt * (shift - b)
        w, b, t = new, shift, nt
    return w, float(b - w @ mean)


def fit(x: dict[str, np.ndarray], y: np.ndarray) -> Model:
    prior = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    if len(y) < 4 * LEAST_LEAF or y.min() == y.max():
        return Model((), prior)
    held = np.arange(len(y)) % 5 == 0
    rules = grow_rules({k: v[~held] for k, v in x.items()}, y[~held])
    if not rules:
        return Model((), prior)
    r = np.stack([rule.holds(x) for rule in rules], 1).astype(np.float64)
    best = (np.inf, None, 0.0)
    for penalty in PENALTIES:
        w, b = lasso(r[~held], y[~held], penalty)
        m = np.clip(r[held] @ w + b, -30, 30)
        loss = float(np.mean(np.logaddexp(0, m) - y[held] * m))
        if loss < best[0]:
            best = (loss, w, b)
    return Model(tuple((rule, float(w)) for rule, w in zip(rules, best[1]) if abs(w) > 1e-6), best[2])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", learn: Column | None = None, max_rows: int = MAX_ROWS) -> Model:
    rows = labelled(docs, labels, label, key, text, F.lit(True) if learn is None else learn, max_rows)
    stats = statistics(F.col("_text"))
    found = rows.select("label", *[c.alias(n) for n, c in stats.items()]).toPandas()  # max_rows rows of a dozen numbers
    found = found.sort_values(list(found.columns)).sample(frac=1.0, random_state=1)
    return fit({n: found[n].to_numpy(float) for n in stats}, found["label"].to_numpy(float))


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with _score in [0, 1] (probability of class 1). A null text scores as an empty one; repeated rows
    score alike; an empty table gives no rows. All columns are kept, whatever their names."""
    stats = F.struct(*[c.alias(n) for n, c in statistics(F.col(text)).items()])
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), stats.alias("_stats"))
    return row.select("_row", model.column().alias("_score")).select("_row.*", "_score")


def op10_rule_ensemble(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"), learn=remainder("doc_id", 3) != 1)
    out = scored(docs, model).select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), F.col("_score").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
