"""Quality classifier: a sparse ensemble of rules.

Shallow trees are grown on text statistics of labelled documents; every path from a root to a node is a conjunction of
thresholds. A logistic regression with an L1 penalty weighs these rules, most of them with 0. The rest is compiled into
one Spark column, so that scoring is part of the scan and never leaves the JVM.

Training takes at most SAMPLE labelled rows, those with the smallest hash of their id: their statistics (not their
texts) come to the driver. Each tree draws as many of them as there are, with replacement. All documents are scored on whole texts.

Null and empty texts have statistics of 0 and a score like others. Without labelled rows, with one class only, or with fewer
rows than a tree divides (20), the score is the share of label 1, from 0.01 to 0.99 (0.5 without rows). Rows are scored one by one: repeated rows get equal scores. Labels that
aren't 0 or 1 are left out. Columns of docs keep their names.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name
from .text_stats import with_stats

SAMPLE, TREES, DEPTH, CUTS, PENALTY, STEPS = 20_000, 12, 3, 32, 2e-4, 400

Rule = tuple[tuple[str, bool, float], ...]  # (feature, above, threshold), all must hold


def features(stats: str) -> dict[str, Column]:
    s = lambda name: F.col(f"{stats}.{name}")
    over = lambda a, b: s(a) / F.greatest(s(b), F.lit(1))
    return {
        "log_words": F.log1p(s("n_words").cast("double")),
        "word_length": over("word_chars", "n_words"),
        "symbols": over("n_symbols", "n_words"),
        "exclamations": over("n_exclamations", "n_words"),
        "capitals": over("n_capitals", "word_chars"),
        "digits": over("n_digits", "word_chars"),
        "stops": over("n_stops", "n_words"),
        "distinct": over("n_distinct_words", "n_words"),
        "repeated_lines": over("n_dup_lines", "n_lines"),
    }


def grow(x: np.ndarray, y: np.ndarray, names: list[str], rng: np.random.Generator, rows: np.ndarray, depth: int, path: Rule, out: set[Rule]) -> None:
    """Add the paths of one tree: at each node the best Gini cut among a random half of the features."""
    if path:
        out.add(path)
    if depth == 0 or len(rows) < 20 or y[rows].min() == y[rows].max():
        return
    best = (1e-9, 0, 0.0)
    for j in rng.permutation(len(names))[: (len(names) + 1) // 2]:
        v, t = x[rows, j], y[rows]
        for cut in np.unique(np.quantile(v, np.linspace(0.02, 0.98, CUTS))):
            low = v <= cut
            a, b = low.sum(), (~low).sum()
            if a and b:
                p, pa, pb = t.mean(), t[low].mean(), t[~low].mean()
                gain = p * (1 - p) - (a * pa * (1 - pa) + b * pb * (1 - pb)) / len(rows)
                if gain > best[0]:
                    best = (gain, j, float(cut))
    gain, j, cut = best
    if gain > 1e-9:
        for above in (False, True):
            grow(x, y, names, rng, rows[(x[rows, j] > cut) == above], depth - 1, (*path, (names[j], above, cut)), out)


def holds(rule: Rule, x: np.ndarray, names: list[str]) -> np.ndarray:
    return np.logical_and.reduce([(x[:, names.index(f)] > cut) == above for f, above, cut in rule])


def lasso(r: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> tuple[float, np.ndarray]:
    """Intercept and weights of an L1 logistic regression, by accelerated proximal gradient steps."""
    a = np.hstack([np.ones((len(r), 1)), r])
    rate = 4 * len(a) / max(1e-9, np.linalg.norm(a.T @ a, 2))
    w = z = np.zeros(a.shape[1])
    momentum = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ z, -40, 40)))
        step = z - rate * (a.T @ (p - y)) / len(a)
        new = np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0)
        new[0] = step[0]
        after = (1 + math.sqrt(1 + 4 * momentum**2)) / 2
        z, w, momentum = new + (momentum - 1) / after * (new - w), new, after
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray, names: list[str], seed: int = 7) -> tuple[float, list[tuple[Rule, float]]]:
    """Intercept, and the rules with weights other than 0."""
    rng, found = np.random.default_rng(seed), set()
    for _ in range(TREES if len(y) else 0):
        grow(x, y, names, rng, rng.integers(0, len(y), len(y)), DEPTH, (), found)
    if not found:
        share = min(0.99, max(0.01, float(y.mean()))) if len(y) else 0.5
        return math.log(share / (1 - share)), []
    rules = sorted(found)
    columns: dict[bytes, tuple[Rule, np.ndarray]] = {}
    for rule in rules:  # of rules that hold for the same rows, the first and shortest
        on = holds(rule, x, names)
        if on.tobytes() not in columns or len(rule) < len(columns[on.tobytes()][0]):
            columns[on.tobytes()] = (rule, on)
    kept = list(columns.values())
    bias, weights = lasso(np.stack([on for _, on in kept], 1).astype(float), y)
    return bias, [(rule, float(w)) for (rule, _), w in zip(kept, weights, strict=True) if abs(w) > 1e-6]


def compile_rules(model: tuple[float, list[tuple[Rule, float]]], columns: dict[str, Column]) -> Column:
    """The score over feature columns. Weights stand in one array, which Spark compiles term by term: a long sum would outgrow a method."""
    bias, rules = model
    terms = [F.lit(bias)]
    for rule, weight in rules:
        hit = F.lit(True)
        for name, above, cut in rule:
            hit = hit & (columns[name] > cut if above else columns[name] <= cut)
        terms.append(F.when(hit, weight).otherwise(0.0))
    return 1 / (1 + F.exp(-F.aggregate(F.array(*terms), F.lit(0.0), lambda a, x: a + x)))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> tuple[float, list[tuple[Rule, float]]]:
    """The model from labels (key, label): at most SAMPLE of them, the first by a hash of the key."""
    own = labels.where(F.col(label).isin(0, 1)).select(F.col(key).alias("_k"), F.col(label).cast("double").alias("_y")).orderBy(F.xxhash64(key), "_k", "_y").limit(SAMPLE)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("text")).join(F.broadcast(own), F.col("_key") == F.col("_k")).select("_k", "_y", "text")
    columns = features("stats")
    got = with_stats(rows, "text", repeats=False).select("_k", "_y", *(c.alias(n) for n, c in columns.items())).orderBy(F.xxhash64("_k"), "_k", "_y", *columns).limit(SAMPLE).toArrow()
    x = np.stack([got[n].to_numpy() for n in columns], 1) if got.num_rows else np.zeros((0, len(columns)))
    return fit(x, got["_y"].to_numpy() if got.num_rows else np.zeros(0), list(columns))


def score(docs: DataFrame, model: tuple[float, list[tuple[Rule, float]]], text: str = "text", name: str = "score") -> DataFrame:
    """docs and the probability of label 1 (with underscores after its name if docs has that name)."""
    name = free_name(docs, name)
    stats, values = free_name(docs, "_stats"), free_name(docs, "_features")
    out = with_stats(docs, text, stats, repeats=False)
    out = out.withColumn(values, F.struct(*(c.alias(n) for n, c in features(stats).items())))
    columns = {n: F.col(values)[n] for n in features(stats)}
    return out.withColumn(name, compile_rules(model, columns)).drop(stats, values)


def keep_good(docs: DataFrame, model: tuple[float, list[tuple[Rule, float]]], text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs with a score of least or more.

    The row number in the condition keeps the filter above the projections: pushed below them, it would compute the
    statistics anew for every rule.
    """
    name, row = free_name(docs, "_score"), free_name(docs, "_row")
    out = score(docs, model, text, name).withColumn(row, F.monotonically_increasing_id())
    return out.where((F.col(name) >= least) & (F.col(row) >= 0)).select(*docs.columns)
