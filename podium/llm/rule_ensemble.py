"""Quality classifier: a sparse rule ensemble that runs as Spark column expressions.

Shallow trees are boosted on statistics of a bounded labelled sample. Every path from a root is a
rule, a conjunction of comparisons. A logistic model with an L1 penalty gives most rules the weight
zero; the others become a sum of CASE expressions over the statistics, and the score its sigmoid.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podium.llm.common import is_held_out, labelled, learning_rows, texts

Rule = tuple[tuple[int, bool, float], ...]  # (statistic, at most, threshold), ...


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text that isn't null, each a number for any text, the empty one too."""
    n = F.length(text)
    some = F.greatest(n, F.lit(1))

    def count(*singles: str) -> Column:
        """Occurrences of single ASCII characters."""
        return sum((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(s))) for s in singles[1:]), F.octet_length(text) - F.octet_length(F.replace(text, F.lit(singles[0]))))

    words, lines = F.split(text, "[ \n\t]+"), F.split(text, "\n")
    n_words, n_lines = F.size(words), F.size(lines)
    return {
        "chars": n.cast("double"),
        "words": n_words.cast("double"),
        "word_length": n / n_words,
        "symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")) / n_words,
        "capitals": F.regexp_count(text, F.lit(r"\p{Lu}")) / some,
        "exclamations": count("!") / n_words,
        "stops": count(".", ",") / n_words,
        "bars": count("|") / n_words,
        "lines": n_lines / n_words,
        "distinct_words": F.size(F.array_distinct(words)) / F.sqrt(n_words),
        "distinct_word_share": F.size(F.array_distinct(words)) / n_words,
        "distinct_lines": F.size(F.array_distinct(lines)) / n_lines,
    }


@dataclass(frozen=True)
class Ensemble:
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    bias: float
    names: tuple[str, ...]

    def score(self, s: dict[str, Column]) -> Column:
        """Between 0 and 1, as a column expression over the statistics' columns."""
        total = F.lit(self.bias)
        for rule, weight in zip(self.rules, self.weights):
            holds = None
            for f, at_most, t in rule:
                c = s[self.names[f]] <= t if at_most else s[self.names[f]] > t
                holds = c if holds is None else holds & c
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _split(x: np.ndarray, residual: np.ndarray, least: int, cuts: list[np.ndarray]) -> tuple[int, float] | None:
    """The statistic and threshold that lower the squared error most."""
    best, found = 1e-9, None
    n, total = len(residual), residual.sum()
    for f, thresholds in enumerate(cuts):
        bins = np.searchsorted(thresholds, x[:, f])
        k = np.cumsum(np.bincount(bins, minlength=len(thresholds) + 1))[:-1]
        s = np.cumsum(np.bincount(bins, residual, minlength=len(thresholds) + 1))[:-1]
        ok = (k >= least) & (n - k >= least)
        if ok.any():
            gain = np.where(ok, s**2 / np.maximum(k, 1) + (total - s) ** 2 / np.maximum(n - k, 1) - total**2 / n, -1)
            if gain.max() > best:
                best, found = gain.max(), (f, float(thresholds[gain.argmax()]))
    return found


def _paths(x, residual, depth, least, cuts, path, out, step, margin, rows) -> None:
    """Adds a tree's paths to ``out`` and its predictions to ``margin``."""
    at = _split(x[rows], residual[rows], least, cuts) if depth and len(rows) >= 2 * least else None
    if at is None:
        margin[rows] += step * residual[rows].mean() * 4
        return
    f, t = at
    low = x[rows, f] <= t
    for side, own in ((True, rows[low]), (False, rows[~low])):
        rule = (*path, (f, side, t))
        out[rule] = None
        _paths(x, residual, depth - 1, least, cuts, rule, out, step, margin, own)


def grow(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, seed: int = 0) -> list[Rule]:
    """All paths of boosted trees, each grown on a random half of the rows."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.002, 0.998, 128))) for f in range(x.shape[1])]
    out: dict[Rule, None] = {}
    margin = np.zeros(len(y))
    for _ in range(trees):
        residual = y - 1 / (1 + np.exp(-margin))
        rows = np.flatnonzero(rng.random(len(y)) < 0.5)
        if len(rows) < 4:
            rows = np.arange(len(y))
        _paths(x, residual, depth, max(2, len(y) // 1000), cuts, (), out, 0.3, margin, rows)
    return list(out)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, at_most, t in rule:
        out &= x[:, f] <= t if at_most else x[:, f] > t
    return out


def lasso(r: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, steps: int = 600) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty by accelerated proximal steps; the bias is free."""
    scale = np.maximum(r.std(axis=0), 0.05)
    z = np.concatenate([r / scale, np.ones((len(r), 1))], axis=1)
    weight = weight / weight.sum()
    size = 4.0 / np.linalg.norm(z * np.sqrt(weight)[:, None], 2) ** 2
    w = v = np.zeros(z.shape[1])
    t = 1.0
    for _ in range(steps):
        g = z.T @ (weight * (1 / (1 + np.exp(-(z @ v))) - y))
        new = v - size * g
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - size * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
    return w[:-1] / scale, float(w[-1])


def fit_rows(x: np.ndarray, y: np.ndarray, names: list[str], penalty: float = 0.0005, seed: int = 0) -> Ensemble:
    """An ensemble on statistics ``x`` and classes ``y``; both classes weigh the same in all."""
    if not len(y) or y.min() == y.max():  # one class: its share is all there is to learn
        share = (y.sum() + 1) / (len(y) + 2)
        return Ensemble((), (), float(np.log(share / (1 - share))), tuple(names))
    rules = grow(x, y, seed=seed)
    r = np.stack([holds(rule, x) for rule in rules], axis=1).astype(float)
    _, first = np.unique(r, axis=1, return_index=True)  # equal rules on all rows: one of them
    first = [i for i in sorted(first) if 0 < r[:, i].mean() < 1]
    rules, r = [rules[i] for i in first], r[:, first]
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    w, bias = lasso(r, y, weight, penalty)
    used = np.flatnonzero(np.abs(w) > 1e-3)
    return Ensemble(tuple(rules[i] for i in used), tuple(float(w[i]) for i in used), bias, tuple(names))


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", n: int = 6000, modulus: int = 4, held_out: int = 2, seed: int = 0) -> Ensemble:
    """Learns from at most ``n`` labelled documents of each class, none of them held out."""
    sample = labelled(documents, learning_rows(labels, modulus, held_out), label, n)
    s = statistics(F.col("text"))
    got = sample.select("doc_id", "label", *[c.alias(k) for k, c in s.items()]).orderBy("doc_id").toPandas()
    return fit_rows(got[list(s)].to_numpy(float), got["label"].to_numpy(float), list(s), seed=seed)


def _scored(documents: DataFrame, model: Ensemble, keep: list[str]) -> tuple[DataFrame, str]:
    """The columns ``keep`` and the score, and the score's name, which none of them has."""
    own = "_"
    while any(c.lower().startswith(own) for c in keep):
        own += "_"
    s = statistics(F.col(f"{own}text"))
    d = documents.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias(f"{own}text"))
    d = d.select(*keep, *[c.alias(f"{own}{k}") for k, c in s.items()])
    # Always true, but not the same for each row: else a filter on the score would be pushed below
    # the statistics, with a copy of these in every rule.
    here = F.monotonically_increasing_id() >= 0
    return d.select(*keep, F.when(here, model.score({k: F.col(f"{own}{k}") for k in s})).alias(f"{own}score")), f"{own}score"


def score(documents: DataFrame, model: Ensemble, modulus: int = 4, held_out: int = 2, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; null texts are empty, null ids never held out.

    Rows keep their number and multiplicity; other columns are ignored. No shuffle and no Python: the
    statistics and the rules are evaluated in the scan's stage.
    """
    d, of = _scored(documents.select("doc_id", "text"), model, ["doc_id"])
    return d.select(
        "doc_id", is_held_out(modulus, held_out).alias("held_out"), F.col(of).alias("score"), (F.col(of) >= threshold).cast("int").alias("predicted")
    )


def keep(documents: DataFrame, model: Ensemble, threshold: float = 0.7) -> DataFrame:
    """The rows of ``documents``, all columns, that score ``threshold`` at least."""
    d, of = _scored(documents, model, documents.columns)
    return d.where(F.col(of) >= threshold).drop(of)
