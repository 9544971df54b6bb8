"""Brute-force versions that several tests use."""

import collections
import math
import re

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_components(rows, k, t):
    sets = []
    for d, x in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
        sets.append((d, {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()))
    home = list(range(len(sets)))

    def root(i):
        while home[i] != i:
            i = home[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and len(a & b) >= t * len(a | b):
                home[root(i)] = root(j)
    least = {}
    for i, (d, a) in enumerate(sets):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(a), least.get(root(i))) for i, (d, a) in enumerate(sets)), key=str)


def brute_cut(rows, length):
    raw = [(d, (t or "").encode()) for d, t in rows]
    seen = collections.Counter(t[i : i + length] for _, t in raw for i in range(len(t) - length + 1))
    out = []
    for d, t in raw:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(t), sum(gone), runs, bytes(b for b, g in zip(t, gone) if not g)))
    return sorted(out, key=str)


def plain_counts(text):
    """The counts of a text, one after the other."""
    text = text or ""
    raw, words = text.encode(), [w.encode() for w in WORD.findall(text)]
    at = collections.defaultdict(list)
    for i in range(len(words) - 2):
        at[tuple(words[i : i + 3])].append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_bytes": len(raw), "n_words": len(words), "word_chars": sum(map(len, WORD.findall(text))), "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
        "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_same_next": sum(a == b for a, b in zip(words, words[1:])),
        "n_upper": sum(65 <= b < 91 for b in raw), "n_lower": sum(97 <= b < 123 for b in raw), "n_digits": sum(48 <= b < 58 for b in raw), "n_wide": sum(b >= 0xC0 for b in raw),
        "n_bangs": text.count("!"), "n_pipes": text.count("|"), "n_stops": text.count("."), "n_stop_lines": sum(x.encode()[-1:] in [b"%c" % c for c in b".!?:;\"')"] for x in lines),
    }


def plain_quality(text, model):
    """The probability of a rule ensemble for one text, rule by rule."""
    from skiff.llm import rule_classifier

    c = plain_counts(text)
    per = lambda a, b: c[a] / max(1, c[b])
    x = {
        "words": c["n_words"], "word_length": per("word_chars", "n_words"), "symbols": per("n_symbols", "n_words"), "bangs": per("n_bangs", "n_words"), "pipes": per("n_pipes", "n_words"),
        "stops": per("n_stops", "n_words"), "digits": per("n_digits", "word_chars"), "upper": c["n_upper"] / max(1, c["n_upper"] + c["n_lower"]), "wide": per("n_wide", "word_chars"),
        "same_next": per("n_same_next", "n_words"), "repeat_words": per("n_repeat_words", "n_words"), "dup_lines": per("n_dup_lines", "n_lines"), "line_words": per("n_words", "n_lines"), "stop_lines": per("n_stop_lines", "n_lines"),
    }
    values = [x[n] for n in rule_classifier.features()]
    total = model[0] + sum(w for rule, w in model[1] if all((values[f] > t) == above for f, above, t in rule))
    return 1 / (1 + math.exp(-total))


def plain_toxicity(text, model):
    """The probability of the n-gram model for one text, word by word and n-gram by n-gram."""
    from skiff.llm import toxicity

    scores, bias = model

    def bucket(gram):
        h = sum(int(toxicity._BYTE[b]) * int(toxicity._PLACE[j]) for j, b in enumerate(gram)) + len(gram)
        return int(toxicity.mix(np.array([h % (1 << 64)], np.uint64))[0]) & (toxicity.BUCKETS - 1)

    each = []
    for w in WORD.findall(text or ""):
        raw = bytes([toxicity.OPEN]) + re.sub("[A-Z]", lambda m: m[0].lower(), w).encode() + bytes([toxicity.CLOSE])
        hit = [scores[bucket(raw[i : i + n])] for n in toxicity.GRAMS for i in range(len(raw) - n + 1)]
        each.append(sum(map(float, hit)) / len(hit))
    total = bias + (sum(each) / len(each) if each else 0.0)
    return 1 / (1 + math.exp(-min(50, max(-50, total))))
