"""Quality rules by weak supervision: rules vote or abstain, and their accuracies are estimated.

Every rule votes for good (1), for bad (-1) or abstains (0) on the statistics of a text.
Expectation-maximisation over the counts of vote patterns, of which there are a fixed number at
most, estimates how often each rule is right when it votes, without labels; the posterior
probability of good replaces the test that a text pass every rule.

Two assumptions go beyond independent rules. "symbols" and "marks" read one count at two bounds, so a text far beyond
counts double, on purpose: as one rule of three votes it is a small cluster of its own that EM takes for good ones.
And a vote never speaks for the class that it votes against (``estimate`` holds the signs of weights).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skiff.llm.common import materialize
from skiff.llm.text_stats import with_stats


def _vote(good: Column | None, bad: Column) -> Column:
    vote = F.when(bad, -1)
    return (vote if good is None else vote.when(good, 1)).otherwise(0)


def rules() -> dict[str, Column]:
    """The votes. Rules that look for one kind of junk only vote against a text, or abstain."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    lines = F.greatest(F.col("n_lines"), F.lit(1)).cast("double")
    letters = F.greatest(F.col("n_upper") + F.col("n_lower"), F.lit(1)).cast("double")
    mean_length = F.col("word_chars") / words
    some = F.col("n_words") >= 20
    return {
        "length": _vote(F.col("n_words").between(80, 50_000), F.col("n_words") < 20),
        "word_length": _vote(mean_length.between(3.2, 8) & some, (mean_length < 2.2) | (mean_length > 12)),
        "sentences": _vote((F.col("n_stops") / words).between(0.02, 0.4) & some, (F.col("n_stops") / words < 0.002) & (F.col("n_words") >= 50)),
        "symbols": _vote(None, F.col("n_symbols") / words > 0.15),
        "marks": _vote(None, F.col("n_symbols") / words > 0.5),
        "pipes": _vote(None, F.col("n_pipes") / words > 0.1),
        "bangs": _vote(None, F.col("n_bangs") / words > 0.3),
        "case": _vote(None, F.col("n_upper") / letters > 0.5),
        "runs": _vote(None, F.col("n_same_next") / words > 0.2),
        "repetition": _vote(None, F.col("n_repeat_words") / words > 0.4),
        "lines": _vote(None, F.col("n_dup_lines") / lines > 0.5),
    }


def estimate(votes: np.ndarray, count: np.ndarray, rounds: int = 100) -> tuple[float, np.ndarray]:
    """(log odds of good, log-odds weight of each rule's vote [rule, bad/abstain/good]).

    EM for rules independent given the class, from the start that votes against a text are very rare
    among good ones; half counts keep every rate inside (0, 1). Abstaining is evidence as well.
    """
    m = votes.shape[1]
    shown = np.stack([(votes == v) for v in (-1, 0, 1)], 2).astype(float)  # pattern, rule, vote
    log_good = np.log(np.tile([0.002, 0.598, 0.4], (m, 1)))
    log_bad = np.log(np.tile([0.3, 0.5, 0.2], (m, 1)))
    prior = np.log(0.8 / 0.2)
    for _ in range(rounds):
        odds = prior + (shown * (log_good - log_bad)).sum((1, 2))
        p = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
        good, bad = count * p, count * (1 - p)
        a = np.einsum("p,prv->rv", good, shown) + 0.5
        b = np.einsum("p,prv->rv", bad, shown) + 0.5
        log_good, log_bad = np.log(a / a.sum(1, keepdims=True)), np.log(b / b.sum(1, keepdims=True))
        prior = np.log((good.sum() + 1) / (bad.sum() + 1))
    weight = log_good - log_bad
    # An assumption, not a result: a vote of bad never speaks for good, nor one of good for bad.
    weight[:, 0], weight[:, 2] = np.minimum(weight[:, 0], 0), np.maximum(weight[:, 2], 0)
    return float(prior), weight


def judge_quality(documents: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Judge every whole text by the base rules and by the posterior probability of good quality.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept
    (false if base_failed, else posterior >= threshold) and posterior, a row for each row. A null
    or empty text has counts 0 and fails the base; null ids stay; repeated rows are judged alike and
    each counts in the estimate. Columns besides doc_id and text are ignored. An empty table
    gives an empty one.
    """
    counted = with_stats(documents.select("doc_id", "text"), "doc_id")
    voted = counted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *[v.cast("byte").alias(f"v_{n}") for n, v in rules().items()])
    voted = materialize(voted, "votes")
    names = [f"v_{n}" for n in rules()]
    patterns = voted.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).orderBy(*names).toPandas()  # 3 ** rules rows at most
    odds, weight = estimate(patterns[names].to_numpy(dtype=int), patterns["n"].to_numpy(dtype=float))
    total = F.lit(odds)
    for name, w in zip(names, weight):
        total = total + F.when(F.col(name) == -1, float(w[0])).when(F.col(name) == 1, float(w[2])).otherwise(float(w[1]))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = voted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (1 / (1 + F.exp(-total))).alias("posterior"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("posterior") >= threshold)).alias("kept"), "posterior")
