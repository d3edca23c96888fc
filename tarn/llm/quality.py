"""Quality classifier: a sparse rule ensemble that runs as Spark columns.

Statistics of a text (shares of symbols, capitals, digits, repeated words ...)
are column expressions. On the driver, shallow trees are grown on bootstrap
samples of labelled rows' statistics; every path from a root is a conjunctive
rule; a logistic model with an L1 penalty weights the rules, and most weights
become zero. The rest is compiled to one column expression, so scoring is a
projection without Python or shuffle.

Learning reads at most ``max_rows`` labelled rows (chosen by a hash of their id);
the ids are broadcast, and only statistics reach the driver, where they are sorted:
partitioning and the order of rows don't change the model. An id that repeats is
learned from once a label, by its text of the smallest hash.

Defined cases: null text counts as empty; an empty text is scored like any other;
labels that are null are no labels; with labels of one value only, or none, the
score is the label's share (0.5 without labels); rows are scored one by one, so
repeats and ties are alike; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm import _sample

MAX_ROWS = 20_000
THRESHOLD = 0.3

# Name and SQL of each statistic, over text t (never null), its characters n and words w.
STATISTICS = {
    "chars": "cast(n as double)",
    "words": "cast(size(w) as double)",
    "word_length": "n / size(w)",
    "symbols": r"regexp_count(t, '[#$%&*@~^=<>{}|\\[\\]\\\\]') / n",
    "exclaims": r"regexp_count(t, '[!?]') / n",
    "points": r"regexp_count(t, '[.,;:]') / n",
    "capitals": r"regexp_count(t, '\\p{Lu}') / n",
    "digits": r"regexp_count(t, '[0-9]') / n",
    "lines": r"regexp_count(t, '\\n') / size(w)",
    "distinct": "size(array_distinct(w)) / size(w)",
    "again": "size(filter(w, (x, i) -> i > 0 and x = get(w, i - 1))) / size(w)",
    "distinct_lines": r"size(array_distinct(split(t, '\\n'))) / size(split(t, '\\n'))",
}


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """``row``, a struct of the kept columns, and a double column for each of STATISTICS."""
    base = docs.select(F.struct(*keep).alias("row"), F.coalesce("text", F.lit("")).alias("t"))
    base = base.select("row", "t", F.expr("greatest(char_length(t), 1)").alias("n"), F.expr(r"split(t, '[ \\t-\\r]+')").alias("w"))
    return base.select("row", *(F.expr(f"cast({sql} as double)").alias(f"s_{name}") for name, sql in STATISTICS.items()))


@dataclass(frozen=True)
class Model:
    """Score = sigmoid(bias + sum of weights of the rules that hold); a rule is a tuple of (statistic, above, threshold)."""

    bias: float
    rules: tuple[tuple[float, tuple[tuple[int, bool, float], ...]], ...]

    def column(self) -> Column:
        names = [f"s_{n}" for n in STATISTICS]
        total = F.lit(self.bias)
        for weight, tests in self.rules:
            holds = None
            for f, above, at in tests:
                c = F.col(names[f])
                one = c > F.lit(at) if above else c <= F.lit(at)
                holds = one if holds is None else holds & one
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for weight, tests in self.rules:
            z += weight * holds(x, tests)
        return 1 / (1 + np.exp(-z))


def holds(x: np.ndarray, tests) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, above, at in tests:
        out &= x[:, f] > at if above else x[:, f] <= at
    return out


def _grow(x: np.ndarray, y: np.ndarray, tests: tuple, depth: int, out: set, rng) -> None:
    """Adds the paths to all nodes below a node that holds rows x, y."""
    if depth == 0 or len(y) < 20 or y.min() == y.max():
        return
    best = (0.0, None)
    base = len(y) * y.mean() * (1 - y.mean())
    for f in rng.choice(x.shape[1], max(1, x.shape[1] // 2), replace=False):
        for at in np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 33))):
            left = x[:, f] <= at
            n = int(left.sum())
            if min(n, len(y) - n) < 5:
                continue
            p, q = y[left].mean(), y[~left].mean()
            gain = base - n * p * (1 - p) - (len(y) - n) * q * (1 - q)
            if gain > best[0] + 1e-12:
                best = (gain, (int(f), float(at)))
    if best[1] is None:
        return
    f, at = best[1]
    for above in (False, True):
        own = (x[:, f] > at) == above
        path = tuple(sorted((*tests, (f, above, at))))
        out.add(path)
        _grow(x[own], y[own], path, depth - 1, out, rng)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, penalty: float = 2e-4, steps: int = 1500, seed: int = 5) -> Model:
    """Rules from ``trees`` trees, weighted by L1 logistic regression (accelerated proximal gradient)."""
    if len(y) == 0 or y.min() == y.max():
        p = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        return Model(float(np.log(p / (1 - p))), ())
    rng, paths = np.random.default_rng(seed), set()
    for _ in range(trees):
        own = rng.integers(0, len(y), min(len(y), 4000))
        _grow(x[own], y[own], (), depth, paths, rng)
    paths = sorted(paths)
    r = np.stack([holds(x, p) for p in paths], 1).astype(np.float32)
    p = y.mean()
    bias, w = float(np.log(p / (1 - p))), np.zeros(r.shape[1], np.float32)
    rate = 1 / (0.25 * (np.linalg.norm(r, 2) ** 2 / len(y) + 1))
    ahead_w, ahead_b, t = w, bias, 1.0
    for _ in range(steps):
        g = (1 / (1 + np.exp(-(r @ ahead_w + ahead_b))) - y).astype(np.float32) / len(y)
        new_w = ahead_w - rate * (r.T @ g)
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - rate * penalty, 0)
        new_b = ahead_b - rate * float(g.sum())
        new_t = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead_w, ahead_b = new_w + (t - 1) / new_t * (new_w - w), new_b + (t - 1) / new_t * (new_b - bias)
        w, bias, t = new_w, new_b, new_t
    return Model(bias, tuple((float(a), q) for a, q in zip(w, paths, strict=True) if abs(a) > 1e-6))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Learns ``quality`` from labelled rows whose crc32(doc_id) is no multiple of five.

    What is fitted is sorted first, so the model doesn't depend on partitions or the order of rows.
    """
    own = labels.where(F.col("quality").isNotNull() & (_sample.remainder(5) != 0)).select("doc_id", F.col("quality").cast("int").alias("quality"))
    drawn = _sample.draw(own, max_rows)
    names = [f"s_{n}" for n in STATISTICS]
    met = _sample.texts_of(docs.select("doc_id", "text"), drawn)
    rows = statistics(met, "doc_id", "quality", "text_hash").select("row.*", *names)
    rows = _sample.one_each(rows, ["doc_id", "quality"], *names).select("quality", *names).toPandas()
    x, y = rows[names].to_numpy(np.float64), rows["quality"].to_numpy(np.float64)
    order = np.lexsort((y, *x.T))
    return fit(x[order], y[order])


def score(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The kept columns and ``score``, the probability of label 1."""
    return statistics(docs, *keep).select("row.*", model.column().alias("score"))


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, that score ``threshold`` or more."""
    # with the partition id the optimizer leaves the score where it is: as a filter it would be
    # pushed below the statistics, which would then be computed anew in every rule
    score = F.when(F.spark_partition_id() >= 0, model.column()).alias("score")
    return statistics(docs, *docs.columns).select("row", score).where(F.col("score") >= threshold).select("row.*")
