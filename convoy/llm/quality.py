"""A quality classifier made of rules.

Statistics of a text are Spark columns. Shallow trees, boosted on a sample of labelled rows, yield
rules: every path from a root to a node is a conjunction of comparisons. A logistic regression with
an L1 penalty weighs the rules and drops most of them, and what is left is compiled to one Spark
expression, so scoring runs in the JVM whatever the size of the corpus.

Only fitting takes place on the driver, on the statistics of at most ``MAX_ROWS`` labelled rows: all
of them while there are fewer, else those of least hash. Labels, ids, languages and sources are no
statistics.

Defined cases. Null text counts as empty and gets a score like any other. Labels that are null are
left out, and rows that repeat an id in the labels are averaged and rounded. Without labelled rows
every score is one half; with labels of one kind only, all scores are the smoothed share of ones.
An empty table gives no rows. Extra columns are not looked at.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoy.functions.coerce import computed_once
from convoy.llm.common import text_or_empty

MAX_ROWS = 20_000
# Trees and penalty of least loss in three-fold cross-validation on learnable rows alone (see README).
TREES, DEPTH, BINS, PENALTY = 20, 3, 32, 2e-4
HELD_OUT = 2
Comparison = tuple[int, bool, float]  # statistic, whether at most (or above), bound


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text by name; all are doubles, and 0 where there is nothing to count."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n_chars, n_words = F.length(text), F.size(words)

    def share(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))

    def count(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern))

    return {
        "log_chars": F.log1p(n_chars.cast("double")),
        "word_length": share(n_chars, n_words),
        "distinct_words": share(F.size(F.array_distinct(words)), n_words),
        "upper": share(count(r"\p{Lu}"), n_chars),
        "digits": share(count(r"\p{N}"), n_chars),
        "marks": share(count(r"[^\p{L}\p{N}\s.,;:'-]"), n_chars),
        "stops": share(count(r"[.!?](?=\s|$)"), n_words),
        "lines": share(count(r"\n"), n_words),
        "bare_words": share(count(r"(?<!\S)[^\p{L}\p{N}\s]+(?!\S)"), n_words),
    }


# The names, in the order in which rules count them.
NAMES = ["log_chars", "word_length", "distinct_words", "upper", "digits", "marks", "stops", "lines", "bare_words"]


@dataclass
class Rules:
    """A fitted ensemble: conjunctions of comparisons with their weights, and the intercept."""

    rules: list[tuple[tuple[Comparison, ...], float]]
    intercept: float

    def column(self, values: dict[str, Column]) -> Column:
        """The score, from 0 to 1, of a row with these statistics.

        The rules are one literal that is gone through per row, so the plan's size does not depend on
        their number.
        """
        listed = [
            {"tests": [{"at": at, "below": below, "bound": bound} for at, below, bound in rule], "weight": weight}
            for rule, weight in self.rules
        ]
        kind = "array<struct<tests:array<struct<at:int,below:boolean,bound:double>>,weight:double>>"
        rules = F.from_json(F.lit(json.dumps(listed)), kind)

        def total(row: Column) -> Column:
            def holds(test: Column) -> Column:
                value = F.get(row, test["at"])
                return F.when(test["below"], value <= test["bound"]).otherwise(value > test["bound"])

            return F.aggregate(
                rules,
                F.lit(self.intercept),
                lambda done, rule: done + F.when(F.forall(rule["tests"], holds), rule["weight"]).otherwise(0.0),
            )

        # A one-element array binds the statistics, so that they are put together once for all rules.
        bound = F.transform(F.array(F.array(*[values[n] for n in NAMES])), total)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-bound[0]))

    def score(self, matrix: np.ndarray) -> np.ndarray:
        total = np.full(len(matrix), self.intercept)
        for rule, weight in self.rules:
            total += weight * holds(rule, matrix)
        return 1 / (1 + np.exp(-total))


def holds(rule: tuple[Comparison, ...], matrix: np.ndarray) -> np.ndarray:
    out = np.ones(len(matrix), dtype=bool)
    for at, below, bound in rule:
        out &= matrix[:, at] <= bound if below else matrix[:, at] > bound
    return out


def _grow(matrix: np.ndarray, residual: np.ndarray, rows: np.ndarray, path: tuple[Comparison, ...], depth: int,
          found: list, fitted: np.ndarray) -> None:
    """One tree on ``residual``: adds the path of every node but the root, and fits the leaves."""
    if path:
        found.append(path)
    best = None
    if depth and len(rows) >= 20:
        y = residual[rows]
        total, n = y.sum(), len(rows)
        for at in range(matrix.shape[1]):
            x = matrix[rows, at]
            bounds = np.unique(np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], method="lower"))
            for bound in bounds:
                low = x <= bound
                k = int(low.sum())
                if k < 5 or n - k < 5:
                    continue
                left = y[low].sum()
                gain = left * left / k + (total - left) ** 2 / (n - k) - total * total / n
                if best is None or gain > best[0] + 1e-12:
                    best = (gain, at, float(bound))
    if best is None or best[0] < 1e-9:
        fitted[rows] = residual[rows].mean() if len(rows) else 0.0
        return
    _, at, bound = best
    low = matrix[rows, at] <= bound
    _grow(matrix, residual, rows[low], (*path, (at, True, bound)), depth - 1, found, fitted)
    _grow(matrix, residual, rows[~low], (*path, (at, False, bound)), depth - 1, found, fitted)


def tree_rules(matrix: np.ndarray, labels: np.ndarray, trees: int, depth: int, seed: int) -> list[tuple[Comparison, ...]]:
    """Paths of boosted trees, each grown on the logistic residuals of half of the rows."""
    rng = np.random.default_rng(seed)
    score = np.zeros(len(labels))
    found: list[tuple[Comparison, ...]] = []
    for _ in range(trees):
        residual = labels - 1 / (1 + np.exp(-score))
        rows = np.sort(rng.choice(len(labels), max(1, len(labels) // 2), replace=False))
        paths: list[tuple[Comparison, ...]] = []
        fitted = np.zeros(len(labels))
        _grow(matrix, residual, rows, (), depth, paths, fitted)
        found += paths
        score += 1.0 * fitted
    return list(dict.fromkeys(found))


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L1-penalised logistic regression, by accelerated proximal gradient."""
    n, k = x.shape
    mean = x.mean(axis=0)
    spread = np.maximum(np.sqrt(mean * (1 - mean)), 0.05)
    z = (x - mean) / spread
    step = 4.0 / max(np.linalg.norm(z.T @ z / n, 2), 1e-9) if k else 1.0
    weight, bias = np.zeros(k), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    ahead, bias_ahead, t = weight.copy(), bias, 1.0
    for _ in range(steps):
        error = 1 / (1 + np.exp(-(z @ ahead + bias_ahead))) - y
        moved = ahead - step * (z.T @ error / n)
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
        new_bias = bias_ahead - min(step, 4.0) * error.mean()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t_new * (new - weight)
        bias_ahead = new_bias + (t - 1) / t_new * (new_bias - bias)
        weight, bias, t = new, new_bias, t_new
    scaled = weight / spread
    return scaled, float(bias - (scaled * mean).sum())


def fit_rules(matrix: np.ndarray, labels: np.ndarray, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY,
              seed: int = 6) -> Rules:
    """The ensemble of a sample: ``matrix`` has a column for each of ``NAMES``, ``labels`` are 0 and 1."""
    if not len(labels):
        return Rules([], 0.0)
    if labels.min() == labels.max():
        share = (labels.sum() + 1) / (len(labels) + 2)
        return Rules([], float(np.log(share / (1 - share))))
    rules = tree_rules(matrix, labels, trees, depth, seed)
    table = np.stack([holds(r, matrix) for r in rules], axis=1).astype(np.float64)
    weights, bias = lasso_logistic(table, labels, penalty)
    return Rules([(r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-6], bias)


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learned from: the CRC-32 of the id as text leaves remainder 2 by 4."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == HELD_OUT


def with_statistics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    return docs.select(
        F.col(id_column).alias("doc_id"), *[c.alias(n) for n, c in statistics(text_or_empty(text_column)).items()]
    )


def learn(values: DataFrame, labels: DataFrame, label_column: str = "quality", max_rows: int = MAX_ROWS) -> Rules:
    """Fit on ``values`` (see ``with_statistics``) and ``labels`` (doc_id and the label)."""
    known = (
        labels.where(~held_out(F.col("doc_id")) & F.col(label_column).isNotNull())
        .groupBy("doc_id")
        .agg(F.round(F.avg(label_column)).cast("int").alias("_label"))
    )
    sample = (
        values.join(known, "doc_id")
        .orderBy(F.xxhash64("doc_id"), *NAMES)
        .limit(max_rows)
        .select("_label", *NAMES)
        .collect()
    )
    rows = np.array([tuple(r) for r in sample], dtype=np.float64).reshape(len(sample), len(NAMES) + 1)
    return fit_rules(rows[:, 1:], rows[:, 0])


def scored(values: DataFrame, rules: Rules, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``values``."""
    score = rules.column({n: F.col(n) for n in NAMES})
    return values.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )


def accepted(docs: DataFrame, rules: Rules, threshold: float = 0.7, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with the columns of ``docs``."""
    found = statistics(text_or_empty(text_column))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    measured = docs.select(row, *[c.alias(n) for n, c in found.items()])
    # Each statistic is worked out once, not once for every rule that compares it.
    held = computed_once(measured, ["row"])
    return held.where(rules.column({n: F.col(n) for n in NAMES}) >= threshold).select("row.*")
