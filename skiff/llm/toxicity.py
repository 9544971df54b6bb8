"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the embeddings of its character n-grams (hashed to buckets; words are bounded
by marks), a text the mean of its words, and a softmax over the two classes reads that mean. A
misspelling that training never saw shares most n-grams with the word, and so its score.
Training runs on a bounded sample; scoring is a scan, as the trained layers fold into one
number for each bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from skiff.llm.common import arrow_map, fold, give_back, training_rows
from skiff.llm.textkit import _BYTE, _LOWER, _PLACE, Words, mix, slices, utf8

BUCKETS, GRAMS = 1 << 18, (3, 4, 5, 6)
OPEN, CLOSE = 2, 3  # marks of a word's ends; control characters that words rarely hold
#: Sharpness of the averaged layer: a mean over hundreds of words has to move a logit.
SHARP = 30.0


def grams(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of every n-gram of the words data[start:end], A-Z folded."""
    length = end - start + 2
    first = np.cumsum(length) - length
    total = int(length.sum())
    word = np.repeat(np.arange(len(start)), length)
    inside = np.arange(total) - np.repeat(first, length)
    raw = _LOWER[data[np.clip(inside - 1 + np.repeat(start, length), 0, max(0, len(data) - 1))]]
    raw[first] = OPEN
    raw[first + length - 1] = CLOSE
    value = _BYTE[raw]
    words, buckets = [], []
    for n in GRAMS:
        if total < n:
            continue
        h = np.zeros(total - n + 1, np.uint64)
        for j in range(n):
            h += value[j : total - n + 1 + j] * _PLACE[j]
        ok = word[: total - n + 1] == word[n - 1 :]
        words.append(word[: total - n + 1][ok])
        buckets.append((mix(h[ok] + np.uint64(n)) & np.uint64(BUCKETS - 1)).astype(np.int64))
    return np.concatenate(words), np.concatenate(buckets)


@dataclass
class Bags:
    """Texts as bags of distinct words, and words as bags of buckets, both as pairs sorted by the first."""

    w_of: np.ndarray
    bucket: np.ndarray
    size: np.ndarray  # n-grams of each word
    doc: np.ndarray
    word: np.ndarray
    count: np.ndarray


def _bags(texts: list[str]) -> Bags:
    """Read the texts slice by slice, so that memory holds distinct words only."""
    data, offsets = utf8(pa.array(texts, pa.string()))
    known: dict[int, int] = {}
    parts: list[list[np.ndarray]] = [[np.zeros(0, np.int32)] for _ in range(5)]
    for i, j in slices(offsets):
        at = offsets[i : j + 1]
        words = Words(data[at[0] : at[-1]], at - at[0])
        if not len(words.start):
            continue
        keys, one, inverse = np.unique(words.hashes(lower=True), return_index=True, return_inverse=True)
        fresh = np.array([k not in known for k in keys.tolist()])
        if fresh.any():
            w_of, bucket = grams(words.data, words.start[one[fresh]], words.end[one[fresh]])
            order = np.argsort(w_of, kind="stable")
            parts[0].append((w_of[order] + len(known)).astype(np.int32))
            parts[1].append(bucket[order].astype(np.int32))
            for k in keys[fresh].tolist():
                known[k] = len(known)
        index = np.array([known[k] for k in keys.tolist()])
        pair, count = np.unique(words.doc * len(keys) + inverse, return_counts=True)
        parts[2].append((pair // len(keys) + i).astype(np.int32))
        parts[3].append(index[pair % len(keys)].astype(np.int32))
        parts[4].append(count.astype(np.int32))
    w_of, bucket, doc, word, count = (np.concatenate(p) for p in parts)
    return Bags(w_of, bucket, np.bincount(w_of, minlength=len(known)), doc, word, count)


def fit(texts: list[str], y: np.ndarray, dims: int = 4, steps: int = 200, rate: float = 0.05, level: float = 2.6, decay: float = 1e-3, seed: int = 1) -> tuple[np.ndarray, float]:
    """Train the embeddings and the softmax; returns (score of each bucket, bias).

    Embeddings start along one direction at the n-gram's log odds of being in texts of either class,
    beyond ``level`` standard errors; those within are noise and stay pruned, as are those of words
    alone. Then full-batch Adam on the cross entropy trains both layers together. The layers are
    linear, so gradients pass between texts, words and n-grams as one number each.
    """
    share = min(max(float(y.mean()) if len(y) else 0.0, 1e-3), 1 - 1e-3)
    base = np.log(share / (1 - share))
    bag = _bags(texts)
    if not len(bag.word) or len(set(y.tolist())) < 2:
        return np.zeros(BUCKETS, np.float32), float(base)
    w_of, bucket, size, doc, word, count = bag.w_of, bag.bucket, bag.size, bag.doc, bag.word, bag.count
    words_of = np.bincount(doc, count, len(y))
    # In how many texts of either class a bucket is.
    seen = np.zeros((2, BUCKETS))
    at, edge = np.searchsorted(w_of, np.arange(len(size) + 1)), np.searchsorted(doc, np.arange(len(y) + 1))
    for d in range(len(y)):
        mine = word[edge[d] : edge[d + 1]]
        if len(mine):
            seen[int(y[d]), np.unique(np.concatenate([bucket[at[w] : at[w + 1]] for w in mine.tolist()]))] += 1
    n1, n0 = float(y.sum()), float(len(y) - y.sum())
    odds = np.log((seen[1] + 0.5) / (n1 - seen[1] + 0.5)) - np.log((seen[0] + 0.5) / (n0 - seen[0] + 0.5))
    error = np.sqrt(1 / (seen[1] + 0.5) + 1 / (n1 - seen[1] + 0.5) + 1 / (seen[0] + 0.5) + 1 / (n0 - seen[0] + 0.5))
    beyond = np.sign(odds) * np.maximum(0, np.abs(odds) - level * error)
    some = beyond[bucket] != 0
    w_of, bucket = w_of[some], bucket[some]
    used, gram = np.unique(bucket, return_inverse=True)
    hold = np.bincount(w_of, minlength=len(size))[word] > 0
    doc, word, count = doc[hold], word[hold], count[hold]
    share = count / words_of[doc]
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.01, (len(used), dims))
    emb[:, 0] = beyond[used]
    top = rng.normal(0, 0.01, (dims, 2))
    top[0] = (-1, 1)
    bias = np.array([0.0, base])
    layers = [emb, top, bias]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in layers]
    for step in range(1, steps + 1):
        line = top[:, 1] - top[:, 0]
        word_score = np.bincount(w_of, (emb @ line)[gram], len(size)) / size
        logit = SHARP * np.bincount(doc, share * word_score[word], len(y)) + bias[1] - bias[0]
        miss = (1 / (1 + np.exp(-np.clip(logit, -50, 50))) - y) / len(y)
        by_word = np.bincount(word, SHARP * share * miss[doc], len(size)) / size
        by_gram = np.bincount(gram, by_word[w_of], len(used))
        g_line = by_gram @ emb
        grads = [np.outer(by_gram, line) + decay / max(1, len(used)) * emb, np.stack([-g_line, g_line], 1), np.array([-miss.sum(), miss.sum()])]
        for p, g, m in zip(layers, grads, moments):
            m[0] += 0.1 * (g - m[0])
            m[1] += 0.01 * (g * g - m[1])
            p -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-9)
    scores = np.zeros(BUCKETS, np.float32)
    scores[used] = SHARP * (emb @ (top[:, 1] - top[:, 0]))
    return scores, float(bias[1] - bias[0])


def predict(data: np.ndarray, offsets: np.ndarray, scores: np.ndarray, bias: float) -> np.ndarray:
    """Probability of the toxic class for each text; one without words has the bias alone."""
    words = Words(data, offsets)
    logit = np.full(len(offsets) - 1, bias)
    if len(words.start):
        _, one, word = np.unique(words.hashes(lower=True), return_index=True, return_inverse=True)
        w_of, bucket = grams(data, words.start[one], words.end[one])
        each = np.bincount(w_of, scores[bucket], len(one)) / np.bincount(w_of, minlength=len(one))
        logit += np.bincount(words.doc, each[word], len(logit)) / np.maximum(words.count, 1)
    return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))


def learn(documents: DataFrame, labels: DataFrame, max_rows: int = 3000) -> tuple[np.ndarray, float]:
    """The model for ``labels.toxic``, from at most ``max_rows`` labelled texts outside the held-out fold."""
    rows = training_rows(documents, labels, "toxic", max_rows).orderBy("_id").toPandas()
    model = fit(rows["text"].tolist(), rows["y"].to_numpy(dtype=float))
    del rows
    give_back()
    return model


def with_toxicity(docs: DataFrame, model: tuple[np.ndarray, float], *keep: str, text: bool = False) -> DataFrame:
    """The columns ``keep`` of ``docs``, with ``text`` also the text as ``_text``, and its score."""
    scores, bias = model
    names = [*keep, *["_text"] * text]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offsets = utf8(batch.column(len(keep)))
        out = []
        for i, j in slices(offsets):
            at = offsets[i : j + 1]
            out.append(predict(data[at[0] : at[-1]], at - at[0], scores, bias))
        yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(np.concatenate(out), pa.float64())], [*names, "score"])

    some = docs.select(*keep, F.col("text").alias("_text"))
    return arrow_map(some, run, StructType([*some.schema.fields[: len(names)], StructField("score", DoubleType())]))


def score_toxicity(documents: DataFrame, labels: DataFrame, max_rows: int = 3000) -> DataFrame:
    """Score every whole text: doc_id, held_out, score (0 to 1) and predicted (1 if score >= 0.5).

    Each row gives a row: null and empty texts get the score of a text without words; a null id counts as
    held out; repeated rows score alike. Without usable labels all scores are near 0. Columns
    besides doc_id and text are ignored.
    """
    scored = with_toxicity(documents.select("doc_id", "text"), learn(documents, labels, max_rows), "doc_id")
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
