"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

The leaves of a word's tree hold ``rank * size + place`` of each mergeable pair; the root is the leftmost pair
of lowest rank. A merge changes at most three leaves and the nodes above them, a logarithmic
number, and merging ends when the root is empty. Words of a batch that pad to one tree size go through
their trees in step, as rows of numpy arrays; very long ones go one by one.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skiff.llm.common import arrow_map

NONE = np.iinfo(np.int64).max
#: Chunks of text that a worker remembers.
REMEMBER = 700_000
#: White space of the tokenizer's patterns.
WHITE = r"\t-\r \x85\xa0  -     　"
#: Characters whose case folding and class Python and the tokenizers library see alike, which no normal form
#: changes or joins, and of which none depends on those beside it. Whatever holds others is normalised and cut by the library.
_OTHER = re.compile(
    "[^\0-\u02af\u0370-\u0373\u0375-\u037d\u037f-\u0386\u0388-\u03a2\u03a4-\u0482\u048a-\u052f\u05d0-\u05ea\u0620-\u064a\u1e00-\u1eff"
    "\u2010-\u2027\u2030-\u205e\u20a0-\u20cf\u2100-\u2328\u232b-\u25ff\u3001-\u3029\u3030-\u3098\u309b-\u30ff\u4e00-\u9fff\uac00-\ud7a3\uff00-\uff9f]"
)
_CODECS: dict[str, "Codec"] = {}


def byte_letters() -> list[str]:
    """The printable letter for each byte in byte-level vocabularies: itself, or 256 and up in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letter = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in letter):
        letter[b] = chr(256 + n)
    return [letter[b] for b in range(256)]


class _Behind(dict):
    """A dict whose misses go to another one."""

    def __init__(self, own: dict, other: dict):
        super().__init__(own)
        self.other = other

    def __missing__(self, key):
        return self.other[key]


class Codec:
    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        library = Tokenizer.from_file(path)
        self.normalize, self.cut_other = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + self.suffix] for c in letters], np.int64)
        self.base = max(vocab.values()) + 1
        pairs = [(vocab[a] * self.base + vocab[b], vocab[a + b]) for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"])]
        keys = np.array([p[0] for p in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.merged = np.array([p[1] for p in pairs], np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text_of = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(pattern.replace("\\s", WHITE))
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.chunks: dict[str, tuple[bytes, str]] = {"": (b"", "")}

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs, NONE where there is none."""
        key = a * self.base + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], NONE)

    def _rows(self, words: list[bytes], size: int) -> list[list[int]]:
        """Merge words of at most ``size`` symbols, one tree to a row."""
        n = len(words)
        length = np.array([len(w) for w in words])
        flat = np.frombuffer(b"".join(words), np.uint8)
        row = np.repeat(np.arange(n), length)
        col = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
        sym = np.full((n, size + 1), -1, np.int64)
        sym[row, col] = self.inner[flat]
        sym[np.arange(n), length - 1] = self.last[[w[-1] for w in words]]
        after = np.minimum(np.arange(1, size + 2), size)[None, :].repeat(n, 0)
        before = np.arange(-1, size)[None, :].repeat(n, 0)
        tree = np.full((n, 2 * size), NONE, np.int64)
        r = self.rank(sym[:, :-1], sym[:, 1:])
        tree[:, size:] = np.where(r == NONE, NONE, r * size + np.arange(size))
        level = size
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        live = np.flatnonzero(tree[:, 1] != NONE)
        while len(live):
            root = tree[live, 1]
            at = root % size
            gone = after[live, at]
            sym[live, at] = self.merged[root // size]
            sym[live, gone] = -1
            follow = after[live, gone]
            after[live, at] = follow
            before[live, follow] = at
            prior = before[live, at]
            has = prior >= 0
            here = self.rank(sym[live, at], sym[live, follow])
            tree[live, size + at] = np.where(here == NONE, NONE, here * size + at)
            tree[live, size + gone] = NONE
            p = np.maximum(prior, 0)
            there = self.rank(np.where(has, sym[live, p], -1), sym[live, at])
            value = np.where(there == NONE, NONE, there * size + p)
            tree[live, size + p] = np.where(has, value, tree[live, size + p])
            for leaf in (at, gone, p):
                node = (size + leaf) // 2
                for _ in range(size.bit_length() - 1):
                    tree[live, node] = np.minimum(tree[live, 2 * node], tree[live, 2 * node + 1])
                    node //= 2
            live = live[tree[live, 1] != NONE]
        return [x[x >= 0].tolist() for x in sym]

    def _long(self, word: bytes) -> list[int]:
        """Merge one long word; the same tree with plain lists."""
        n = len(word)
        size = 1 << (n - 1).bit_length()
        sym = self.inner[np.frombuffer(word, np.uint8)]
        sym[-1] = self.last[word[-1]]
        r = self.rank(sym[:-1], sym[1:])
        tree = np.full(2 * size, NONE, np.int64)
        tree[size : size + n - 1] = np.where(r == NONE, NONE, r * size + np.arange(n - 1))
        level = size
        while level > 1:
            level //= 2
            tree[level : 2 * level] = np.minimum(tree[2 * level : 4 * level : 2], tree[2 * level + 1 : 4 * level : 2])
        nodes, s = tree.tolist(), sym.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        table = self.pairs()

        def put(leaf: int, value: int) -> None:
            node = size + leaf
            nodes[node] = value
            while node > 1:
                node //= 2
                low = min(nodes[2 * node], nodes[2 * node + 1])
                if nodes[node] == low:
                    break
                nodes[node] = low

        while nodes[1] != NONE:
            at = nodes[1] % size
            gone = after[at]
            s[at], s[gone] = int(self.merged[nodes[1] // size]), -1
            follow = after[at] = after[gone]
            put(gone, NONE)
            rank = NONE
            if follow < n:
                before[follow] = at
                rank = table.get(s[at] * self.base + s[follow], NONE)
            put(at, NONE if rank == NONE else rank * size + at)
            p = before[at]
            if p >= 0:
                rank = table.get(s[p] * self.base + s[at], NONE)
                put(p, NONE if rank == NONE else rank * size + p)
        return [x for x in s if x >= 0]

    def pairs(self) -> dict[int, int]:
        if not hasattr(self, "_pairs"):
            self._pairs = dict(zip(self.keys.tolist(), self.ranks.tolist()))
        return self._pairs

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each (non-empty) word."""
        out: list[list[int]] = [[]] * len(words)
        sizes: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            sizes.setdefault(1 << max(1, (len(w) - 1).bit_length()), []).append(i)
        for size, of in sizes.items():
            if size > 64:
                for i in of:
                    out[i] = self._long(words[i])
                continue
            for k in range(0, len(of), 4096):
                part = of[k : k + 4096]
                for i, ids in zip(part, self._rows([words[i] for i in part], size)):
                    out[i] = ids
        return out

    def words(self, chunk: str) -> list[str]:
        """The words of a normalised chunk."""
        if not chunk.isascii() and _OTHER.search(chunk):
            return [chunk[a:z] for _, (a, z) in self.cut_other(chunk)]
        return [chunk] if chunk.isalpha() else self.split.findall(chunk)

    def learn(self, chunks: set[str]) -> dict[str, tuple[bytes, str]]:
        """(ids, decoded text) of the chunks that are not remembered; a chunk has no plain space or special token.

        Memory holds the first REMEMBER chunks that a worker meets, mostly frequent ones.
        """
        chunks.difference_update(self.chunks)
        known = self.chunks
        out, split = {}, {}
        for c in chunks:
            # After a letter a single mark is a word of its own, so the rest may be known.
            rest = known.get(c[:-1]) if c[-1] in ",.!?;:" and c[-2:-1].isalpha() and (c.isascii() or not _OTHER.search(c)) else None
            mark = rest and known.get(c[-1])
            if mark:
                out[c] = rest[0] + mark[0], f"{rest[1]} {mark[1]}"
            else:
                split[c] = self.words(c)
        new = list(set().union(*split.values()))
        fresh = dict(zip(new, self.merge([w.encode() for w in new])))
        show = self.text_of.__getitem__
        for c, ps in split.items():
            ids = fresh[ps[0]] if len(ps) == 1 else [i for p in ps for i in fresh[p]]
            out[c] = array("I", ids).tobytes(), " ".join(map(show, ids))
        if len(known) < REMEMBER:
            known.update(out)
            return {}
        return out

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.text_of[i] for i in ids if i in self.text_of)

    def encode_all(self, texts: list[str | None]) -> Iterator[tuple[bytes, str]]:
        """(ids, decoded text) of each text; ids as little-endian 32-bit integers."""
        for k in range(0, len(texts), 200):
            rows = [self._chunks(t or "") for t in texts[k : k + 200]]
            extra = self.learn(set().union(*(run for row in rows for run in row if isinstance(run, list))))
            look = (_Behind(extra, self.chunks) if extra else self.chunks).__getitem__
            for row in rows:
                ids, shown = [], []
                for run in row:
                    if isinstance(run, list):
                        x, y = zip(*map(look, run))
                        ids += x
                        shown += y
                    else:
                        ids.append(array("I", [run]).tobytes())
                        shown.append(self.text_of[run])
                yield b"".join(ids), " ".join(filter(None, shown))

    def _chunks(self, text: str) -> list:
        """Runs of chunks, with the ids of special tokens between them."""
        if "<|" not in text:
            return [self._cut(text)]
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += [self._cut(text[at : m.start()]), self.special[m[0]]]
            at = m.end()
        return [*out, self._cut(text[at:])]

    def _cut(self, text: str) -> list[str]:
        """Normalise (NFC, lower case letter by letter) and cut at spaces, which no word holds."""
        other = not text.isascii() and _OTHER.search(text)
        return (self.normalize(text) if other else text.lower().replace("\n", " ")).split(" ")


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_documents(documents: DataFrame, tokenizer: str, keep: bool = False) -> DataFrame:
    """Encode every text and decode the ids again.

    Returns doc_id, n_tokens, ids_sha256 and decoded_sha256 for each row; with ``keep`` also the ids
    (array of long) and the decoded text. Null and empty texts give no ids. Each repeated row gives a
    row, a null id stays null, and other columns are ignored.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * keep

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n, a, b, ids, decoded = [], [], [], [], []
        for x, s in codec(tokenizer).encode_all(batch.column(1).to_pylist()):
            n.append(len(x) // 4)
            a.append(hashlib.sha256(x).hexdigest())
            b.append(hashlib.sha256(s.encode()).hexdigest())
            if keep:
                ids.append(np.frombuffer(x, "<u4").astype(np.int64))
                decoded.append(s)
        cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)]
        if keep:
            cols += [pa.array(ids, pa.list_(pa.int64())), pa.array(decoded, pa.string())]
        yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in schema.split(", ")])

    return arrow_map(documents.select("doc_id", "text"), rows, schema)
