"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Boosted shallow trees over the statistics give candidate rules, one for each path from a root to
a node. A logistic model with an L1 penalty on the rules keeps a few; these are compiled to one Spark
column expression, so scoring is a projection over the statistics.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skiff.llm.common import fold, give_back, training_rows
from skiff.llm.text_stats import COUNTS, with_stats


def features() -> dict[str, Column]:
    """The statistics rules test, from the counts; a zero denominator counts as one."""

    def per(top: str, bottom: str) -> Column:
        return F.col(top) / F.greatest(F.col(bottom), F.lit(1)).cast("double")

    return {
        "words": F.col("n_words").cast("double"),
        "word_length": per("word_chars", "n_words"),
        "symbols": per("n_symbols", "n_words"),
        "bangs": per("n_bangs", "n_words"),
        "pipes": per("n_pipes", "n_words"),
        "stops": per("n_stops", "n_words"),
        "digits": per("n_digits", "word_chars"),
        "upper": F.col("n_upper") / F.greatest(F.col("n_upper") + F.col("n_lower"), F.lit(1)).cast("double"),
        "wide": per("n_wide", "word_chars"),
        "same_next": per("n_same_next", "n_words"),
        "repeat_words": per("n_repeat_words", "n_words"),
        "dup_lines": per("n_dup_lines", "n_lines"),
        "line_words": per("n_words", "n_lines"),
        "stop_lines": per("n_stop_lines", "n_lines"),
    }


Rule = tuple[tuple[int, bool, float], ...]  # (feature, above, threshold), all of which hold


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for f, above, t in rule:
        ok &= (x[:, f] > t) == above
    return ok


def tree_paths(x: np.ndarray, target: np.ndarray, bins: list[np.ndarray], depth: int, least: int) -> tuple[list[Rule], np.ndarray]:
    """A least-squares tree: the rules of its nodes but the root, and its prediction."""
    rules: list[Rule] = []
    out = np.full(len(x), target.mean())

    def grow(rows: np.ndarray, rule: Rule) -> None:
        if rule:
            rules.append(rule)
        out[rows] = target[rows].mean()
        if len(rule) == depth or len(rows) < 2 * least:
            return
        best, total, n = (1e-9, None, None), target[rows].sum(), len(rows)
        for f, cuts in enumerate(bins):
            if not len(cuts):
                continue
            code = np.searchsorted(cuts, x[rows, f])  # 0..len(cuts); above cut i: code > i
            s = np.cumsum(np.bincount(code, target[rows], len(cuts) + 1))[:-1]
            c = np.cumsum(np.bincount(code, minlength=len(cuts) + 1))[:-1]
            ok = (c >= least) & (n - c >= least)
            gain = np.where(ok, s**2 / np.maximum(c, 1) + (total - s) ** 2 / np.maximum(n - c, 1) - total**2 / n, 0)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), f, float(cuts[k]))
        if best[1] is None:
            return
        high = x[rows, best[1]] > best[2]
        grow(rows[~high], (*rule, (best[1], False, best[2])))
        grow(rows[high], (*rule, (best[1], True, best[2])))

    grow(np.arange(len(x)), ())
    return rules, out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, penalty: float = 2e-3, steps: int = 600) -> tuple[float, list[tuple[Rule, float]]]:
    """(intercept, rules with weights other than 0)."""
    share = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    if len(set(y.tolist())) < 2:
        return base, []
    bins = [np.unique(np.quantile(c, np.linspace(0.01, 0.99, 99), method="lower")) for c in x.T]
    bins = [np.where(np.isclose(b, 0), 0, b) for b in bins]
    logit, rules = np.full(len(y), base), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        paths, step = tree_paths(x, y - p, bins, depth, max(5, len(y) // 500))
        for r in paths:
            rules.setdefault(tuple(sorted(r)), None)
        logit = logit + 0.3 * step / max(1e-3, float((p * (1 - p)).mean()))
    names = list(rules)
    z = np.stack([holds(r, x) for r in names], 1).astype(float)
    z, first = np.unique(z, axis=1, return_index=True)
    names = [names[i] for i in first]
    # Accelerated proximal gradient on the logistic loss with an L1 penalty.
    lipschitz = 0.25 * np.linalg.norm(np.hstack([z, np.ones((len(y), 1))]), 2) ** 2 / len(y)
    w, b, v, c, momentum = np.zeros(z.shape[1]), base, np.zeros(z.shape[1]), base, 1.0
    for _ in range(steps):
        miss = (1 / (1 + np.exp(-(z @ v + c))) - y) / len(y)
        step = v - z.T @ miss / lipschitz
        new_w = np.sign(step) * np.maximum(0, np.abs(step) - penalty / lipschitz)
        new_b = c - miss.sum() / lipschitz
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        v, c = new_w + (momentum - 1) / following * (new_w - w), new_b + (momentum - 1) / following * (new_b - b)
        w, b, momentum = new_w, new_b, following
    return float(b), [(r, float(x)) for r, x in zip(names, w) if abs(x) > 1e-6]


def compiled(intercept: float, rules: list[tuple[Rule, float]], stat: list[Column]) -> Column:
    """The ensemble's probability as a column expression."""
    total = F.lit(intercept)
    for rule, weight in rules:
        ok = F.lit(True)
        for f, above, t in rule:
            ok = ok & (stat[f] > t if above else stat[f] <= t)
        total = total + F.when(ok, weight).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def learn(documents: DataFrame, labels: DataFrame, max_rows: int = 8000) -> tuple[float, list[tuple[Rule, float]]]:
    """The ensemble for ``labels.quality``, from at most ``max_rows`` labelled texts outside the held-out fold."""
    stat = features()
    train = with_stats(training_rows(documents, labels, "quality", max_rows), "_id", "y")
    rows = train.select("_id", "y", *[c.alias(n) for n, c in stat.items()]).orderBy("_id").toPandas()
    model = fit(rows[list(stat)].to_numpy(dtype=float), rows["y"].to_numpy(dtype=float))
    give_back()
    return model


def with_quality(docs: DataFrame, model: tuple[float, list[tuple[Rule, float]]], *keep: str, text: bool = False) -> DataFrame:
    """The columns ``keep`` of ``docs``, with ``text`` also the text as ``_text``, and its score."""
    stat, names = features(), [*keep, *["_text"] * text]
    stats = with_stats(docs, *keep, text=text).select(*names, *[c.alias(n) for n, c in stat.items()])
    return stats.select(*names, compiled(*model, [F.col(n) for n in stat]).alias("score"))


def score_quality(documents: DataFrame, labels: DataFrame, max_rows: int = 8000, threshold: float = 0.3) -> DataFrame:
    """Score every whole text: doc_id, held_out, score (0 to 1) and predicted (1 if score >= threshold).

    Each row gives a row: null and empty texts have all counts 0; a null id counts as held out;
    repeated rows score alike. Without usable labels every score is the share of label 1, or 0.5.
    Columns besides doc_id and text are ignored.
    """
    model = learn(documents, labels, max_rows)
    scored = with_quality(documents.select("doc_id", "text"), model, "doc_id")
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
