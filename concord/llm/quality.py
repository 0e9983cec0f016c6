"""Quality classifier: a sparse ensemble of rules over text statistics (operator 10).

1. STATISTICS are Spark expressions over the whole text; none uses doc_id, lang, source or a label.
2. fit() takes statistics of labelled rows, MAX_ROWS of them at most (those with the least hash of doc_id),
   boosts shallow trees on them, takes every path from a root as a rule, a conjunction of bounds on
   statistics, and fits logistic weights with an L1 penalty, which leaves few rules.
3. score() compiles the rules into one column expression that any executor evaluates in generated code.

Defined cases: a null text counts as empty; an empty text has all statistics 0 and is scored like
any other; repeated rows get equal scores; labels that are null are not used, and of repeated ones each kind once; an empty table gives no
rows; with labels of one kind alone, or none, the score is their share (0.5 for none); other columns are
carried along.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm import common

MAX_ROWS = 20_000
TREES, DEPTH, RATE, BINS = 24, 3, 0.3, 32
PENALTY = 0.002
THRESHOLD = 0.7

_UPPER = r"\p{Lu}"
_SIGNS = r"[#$%&*+<=>@\\^_`{|}~]"


def statistics(t: Column, words: Column, lines: Column) -> dict[str, Column]:
    """Name -> expression. Ratios are of code points, words or lines, 0 for an empty text."""
    chars = F.length(t)
    n_words, n_lines = F.size(words), F.size(lines)
    over = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0)).cast("double")
    count = lambda pattern: F.regexp_count(t, F.lit(pattern))
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(n_words, F.lit(1))), lambda a, b: a == b)
    return {
        "chars": chars.cast("double"),
        "words": n_words.cast("double"),
        "word_length": over(chars, n_words),
        "upper_share": over(count(_UPPER), chars),
        "sign_share": over(count(_SIGNS), chars),
        "digit_share": over(count("[0-9]"), chars),
        "bar_share": over(F.length(t) - F.length(F.replace(t, F.lit("|"), F.lit(""))), n_words),
        "shout_share": over(F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit(""))), n_words),
        "stop_share": over(count(r"[.;:?]"), n_words),
        "distinct_words": over(F.size(F.array_distinct(words)), n_words),
        "distinct_lines": over(F.size(F.array_distinct(lines)), n_lines),
        "line_words": over(n_words, n_lines),
        "same_next": over(F.size(F.filter(pairs, lambda same: same)), n_words),
        "single_letters": over(F.size(F.filter(words, lambda w: F.length(w) == 1)), n_words),
    }


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs with a struct column __statistics."""
    text = common.whole_text(F.col("text"))
    parts = F.struct(text.alias("t"), F.filter(F.split(text, r"\s+"), lambda w: w != "").alias("words"), F.filter(F.split(text, "\n"), lambda x: x != "").alias("lines"))
    fields = lambda p: F.struct(*[c.alias(k) for k, c in statistics(p["t"], p["words"], p["lines"]).items()])
    return docs.withColumn("__statistics", common.let(parts, fields))


@dataclass(frozen=True)
class Rule:
    """All of (statistic, above, bound): above says whether the statistic must exceed the bound or not."""

    terms: tuple[tuple[str, bool, float], ...]
    weight: float


@dataclass(frozen=True)
class Model:
    intercept: float
    rules: tuple[Rule, ...]


def _grow(x: np.ndarray, bins: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int, terms: tuple, out: list, step: np.ndarray) -> None:
    """Split rows where the boosted logistic loss falls most; each node below the root adds its path to out."""
    g, h = grad[rows].sum(), hess[rows].sum()
    value = -g / (h + 1.0)
    best = (1e-6, None, None)
    if depth and len(rows) >= 10:
        for f, e in enumerate(edges):
            if not len(e):
                continue
            b = bins[rows, f]
            gl = np.cumsum(np.bincount(b, grad[rows], len(e) + 1))[:-1]
            hl = np.cumsum(np.bincount(b, hess[rows], len(e) + 1))[:-1]
            n = np.cumsum(np.bincount(b, minlength=len(e) + 1))[:-1]
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            gain[(n < 5) | (n > len(rows) - 5)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), f, k)
    if best[1] is None:
        step[rows] = value
        return
    _, f, k = best
    for above, part in ((False, rows[bins[rows, f] <= k]), (True, rows[bins[rows, f] > k])):
        path = (*terms, (f, above, float(edges[f][k])))
        out.append(path)
        _grow(x, bins, edges, grad, hess, part, depth - 1, path, out, step)


def _simplify(path: tuple) -> tuple:
    """One bound for each statistic and side: the tightest."""
    tight: dict = {}
    for f, above, bound in path:
        old = tight.get((f, above))
        tight[f, above] = bound if old is None else (max if above else min)(old, bound)
    return tuple(sorted((f, above, bound) for (f, above), bound in tight.items()))


def paths(x: np.ndarray, y: np.ndarray) -> list[tuple]:
    """Distinct paths of boosted trees as conjunctions."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    bins = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    share = y.mean()
    margin = np.full(len(y), np.log(share / (1 - share)))
    found: list[tuple] = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        step = np.zeros(len(y))
        _grow(x, bins, edges, p - y, p * (1 - p) + 1e-9, np.arange(len(y)), DEPTH, (), found, step)
        margin += RATE * step
    return sorted({_simplify(p) for p in found})


def holds(path: tuple, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for f, above, bound in path:
        out &= (x[:, f] > bound) if above else (x[:, f] <= bound)
    return out


def lasso(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 600) -> tuple[float, np.ndarray]:
    """(intercept, weights) of logistic regression with an L1 penalty on the weights, by accelerated proximal gradients."""
    design = np.column_stack([np.ones(len(y)), a.astype(float)])
    probe = np.ones(design.shape[1])
    for _ in range(30):
        probe = design.T @ (design @ probe)
        probe /= np.linalg.norm(probe)
    rate = 4 * len(y) / np.linalg.norm(design.T @ (design @ probe)) * 0.95
    w = v = np.zeros(design.shape[1])
    t = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-design @ v))
        new = v - rate * (design.T @ (p - y)) / len(y)
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        w, v, t = new, new + (t - 1) / t_new * (new - w), t_new
    return float(w[0]), w[1:]


def fit_rows(x: np.ndarray, y: np.ndarray, names: list[str], penalty: float = PENALTY) -> Model:
    if not len(y):
        return Model(0.0, ())
    if y.min() == y.max():
        share = min(max(float(y.mean()), 1e-6), 1 - 1e-6)
        return Model(float(np.log(share / (1 - share))), ())
    found = paths(x, y)
    if not found:
        return Model(float(np.log(y.mean() / (1 - y.mean()))), ())
    intercept, weights = lasso(np.column_stack([holds(p, x) for p in found]), y, penalty)
    rules = [Rule(tuple((names[f], above, bound) for f, above, bound in p), float(w)) for p, w in zip(found, weights, strict=True) if abs(w) > 1e-6]
    return Model(intercept, tuple(rules))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, penalty: float = PENALTY) -> Model:
    """docs: doc_id, text; labels: doc_id, quality 0 or 1."""
    usable = labels.select("doc_id", F.col("quality").cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    bounded = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_rows)
    empty = F.array().cast("array<string>")
    names = list(statistics(F.lit(""), empty, empty))
    rows = with_statistics(docs.select("doc_id", "text").join(F.broadcast(bounded), "doc_id")).select("doc_id", "y", "__statistics.*")
    # The same rows in the same order on every run; repeated documents count once for each label.
    first = rows.distinct().orderBy(F.xxhash64("doc_id"), *rows.columns).limit(max_rows)
    data = sorted(map(tuple, first.collect()))
    x = np.array([r[2:] for r in data], dtype=float).reshape(len(data), len(names))
    return fit_rows(x, np.array([r[1] for r in data], dtype=float), names, penalty)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with score, 0 to 1, higher for better texts, in place of a column of that name."""
    margin = F.lit(model.intercept)
    for r in model.rules:
        here = None
        for statistic, above, bound in r.terms:
            c = F.col(f"__statistics.{statistic}")
            term = c > bound if above else c <= bound
            here = term if here is None else here & term
        margin = margin + F.when(here, F.lit(r.weight)).otherwise(F.lit(0.0))
    return with_statistics(docs).withColumn(name, 1 / (1 + F.exp(-margin))).drop("__statistics")


def accept(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, as they are, whose score reaches the threshold."""
    return score(docs, model, "__score").where(F.col("__score") >= threshold).drop("__score")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
