"""The corpus operators against brute force on small texts, exact round trips, and held-out accuracy."""

import bisect
import collections
import hashlib
import random
import re
import zlib
from fractions import Fraction
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tests_llm_shared import WORD, brute_components, brute_cut, plain_counts, plain_quality, plain_toxicity

from skiff.llm import best_fit_packing, jaccard_join, label_sharding, projection_index, quality_rules, rule_classifier, segment_bpe, suffix_dedup, suffix_sort, toxicity, warc_bundles
from skiff.llm.common import BATCH_BYTES, arrow_map, shared_dir, training_rows
from skiff.llm.queries import tokenizer
from skiff.llm.textkit import Words, utf8

DATA = "/root/testdata/sf0.01"
EDGE = [(None, None), (None, "a b c d e f"), (1, ""), (1, " \n\t"), (2, "one"), (2, "one"), (3, "ONE"), (4, "é" * 50), (5, "x " * 400), (6, "x " * 400)]


def documents(spark, rows):
    """With columns whose names clash with those the operators use."""
    return spark.createDataFrame([(d, t, "n", 1, 2, "s") for d, t in rows], "doc_id long, text string, n string, score int, comp int, _row string")


def some_texts(seed, n=60):
    r = random.Random(seed)
    rows = [(i, " ".join(r.choice(["the", "of", "Ab", "cé", "d.", "e"]) + str(r.randint(0, 3)) for _ in range(r.randint(0, 60)))) for i in range(n)]
    for i in range(n, 2 * n):
        words = rows[r.randint(0, 9)][1].split(" ")
        for _ in range(r.randint(0, 3)):
            words[r.randrange(len(words))] = r.choice(["new", "the"])
        rows.append((i, " ".join(words)))
    return rows + EDGE


# --- shared scans


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab é\n\x0b　", max_size=20), max_size=8))
def test_words(texts):
    data, at = utf8(pa.array(texts, pa.string()))
    w = Words(data, at)
    raw = data.tobytes()
    got = [[] for _ in texts]
    for d, a, z in zip(w.doc, w.start, w.end):
        got[d].append(raw[a:z].decode())
    assert got == [WORD.findall(t) for t in texts]
    h = w.hashes().tolist()
    assert len(set(h)) == len({x for row in got for x in row})


# --- 2: Jaccard join


@pytest.mark.parametrize("k,t,turns", [(3, "0.9", 2), (5, "0.8", 0), (2, "0.5", 2)])
def test_jaccard(spark, monkeypatch, k, t, turns):
    monkeypatch.setattr(jaccard_join, "TURNS", turns)
    rows = some_texts(k)
    got = sorted((tuple(r) for r in jaccard_join.jaccard_components(documents(spark, rows), k, t).collect()), key=str)
    assert got == brute_components(rows, k, Fraction(t))


@pytest.mark.parametrize("shared,own,most", [(1840, 260, 66), (336, 60, 66)])
def test_texts_around_one_passage_meet_once(spark, monkeypatch, shared, own, most):
    # Twelve texts, 66 pairs of no link, that share their prefixes: what they have of their own is of common words.
    r, passage = random.Random(2), " ".join(f"p{i}" for i in range(shared))
    rows = [(d, passage + "".join(f" c{r.randrange(9)}" for _ in range(own + d))) for d in range(12)]
    made, distinct = [], type(documents(spark, [])).distinct

    def spy(df):
        if df.columns == ["x_gid", "y_gid"]:
            made.append(df.count())
        return distinct(df)

    monkeypatch.setattr(type(documents(spark, [])), "distinct", spy)
    got = sorted((tuple(r) for r in jaccard_join.jaccard_components(documents(spark, rows), 5, "0.8").collect()), key=str)
    assert got == brute_components(rows, 5, Fraction("0.8")) and made[-1] <= most


def test_bitmaps_of_any_ratio_rule_out_no_link(spark):
    # 32 of 65 hashes in the third of four words; all but one of the others in the first.
    small = np.arange(128, 160)
    big = np.concatenate([small, np.arange(32, 64), [168]])
    sides = [x.astype(np.uint64) << np.uint64(20) for x in (small, big)]
    one, two = ((len(u), jaccard_join.parity(u).tolist()) for u in sides)
    assert [len(one[1]), len(two[1])] == [1, 4]
    pairs = [[*one, *two], [*two, *one]]
    df = spark.createDataFrame([(i, *p[:2], i, *p[2:]) for i, p in enumerate(pairs)], "a long, na long, ba array<long>, b long, nb long, bb array<long>")
    assert jaccard_join._may_link(df, Fraction("0.3")).count() == len(pairs)


def test_jaccard_at_a_low_threshold(spark):
    words = [f"w{i}" for i in range(100)]
    rows = [*some_texts(6), (9001, " ".join(words[:33])), (9002, " ".join(words[:70])), (9003, " ".join(words))]
    got = sorted((tuple(r) for r in jaccard_join.jaccard_components(documents(spark, rows), 2, "0.3").collect()), key=str)
    assert got == brute_components(rows, 2, Fraction("0.3"))


def test_one_of_each_component_stays(spark):
    rows = some_texts(8)[: -len(EDGE)] + [(d and d + 5000, t) for d, t in EDGE]
    kept = [r.doc_id for r in jaccard_join.drop_near_copies(documents(spark, rows), 3, "0.9").collect()]
    want = {c for _, n, c in brute_components(rows, 3, Fraction("0.9")) if n}
    empty = {(d, t) for d, t in rows if not WORD.findall(t or "")}
    assert {d for d in kept} >= want - {None} and len(kept) == len({c for _, n, c in brute_components(rows, 3, Fraction("0.9")) if n}) + len(empty)


def test_empty_tables(spark):
    none = documents(spark, EDGE).where("1 = 0")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert jaccard_join.jaccard_components(none).count() == 0
    assert suffix_dedup.suffix_dedup(none).count() == 0
    assert best_fit_packing.pack(none, tokenizer("byte_bpe_50k.json")).count() == 0
    assert segment_bpe.encode_documents(none, tokenizer("word_bpe_49k.json")).count() == 0
    assert label_sharding.shard_documents(none).count() == 0
    assert quality_rules.judge_quality(none).count() == 0
    assert toxicity.score_toxicity(none, labels).count() == 0
    assert rule_classifier.score_quality(none, labels).count() == 0
    assert warc_bundles.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert projection_index.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# --- 8: suffix array


@settings(max_examples=80, deadline=None)
@given(st.lists(st.binary(max_size=12).map(lambda b: bytes(97 + x % 2 for x in b) * 9), max_size=30))
def test_deep_shallow_order(texts):
    order, lcp = suffix_sort.deep_shallow(texts)
    assert [texts[i] for i in order] == sorted(texts)
    assert lcp == [0 if i == 0 else suffix_sort.common(texts[order[i - 1]], texts[order[i]]) for i in range(len(order))]


@pytest.mark.parametrize("length,block", [(20, 4096), (40, 2), (33, 5)])
def test_suffix_dedup(spark, length, block):
    rows = some_texts(length)
    got = sorted((tuple(r)[:4] + (bytes(r.kept),) for r in suffix_dedup.suffix_dedup(documents(spark, rows), length, block).collect()), key=str)
    assert got == brute_cut(rows, length)


def test_long_documents_are_cut_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE", 300)
    r = random.Random(1)
    part = "".join(r.choice("abcd ") for _ in range(900))
    rows = [(1, part + "x" * 500 + part[100:400]), (2, "y" + part[500:800]), (3, "short")]
    docs = pa.array([t for _, t in rows])
    raw, at = utf8(docs)
    for a, z, doc, begin, end in suffix_dedup.pieces(at, 50):
        assert all(e - b <= 300 + 49 for b, e in zip(begin, end)) and z - a >= max(end)
    got = sorted((tuple(r)[:4] + (bytes(r.kept),) for r in suffix_dedup.suffix_dedup(documents(spark, rows), 50).collect()), key=str)
    assert got == brute_cut(rows, 50)


# --- 6 and 7: tokens

ODD = ["", " ", "\n", "a  b", "a \nb", "a\n b ", " lead", "trail ", "<|endoftext|>x <|endoftext|>", "<|startoftext|>Hi", "ΣΑΣ Σ", "é İ ß", "日本語　x", "it's I'LL 're", "a" * 3000, "😀 \x1c\x85", "1234 5.6"]


def test_segment_tree_equals_library(spark):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    rows = list(enumerate(ODD + [t for _, t in some_texts(3)])) + [(None, None)]
    got = {(r.doc_id): r for r in segment_bpe.encode_documents(documents(spark, rows), path, keep=True).collect()}
    for d, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        assert (got[d].ids, got[d].decoded, got[d].n_tokens) == (ids, text, len(ids))
        assert got[d].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and got[d].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_every_character_is_cut_as_the_library_does():
    codec = segment_bpe.codec(tokenizer("word_bpe_49k.json"))
    for x in [*range(0xD800), *range(0xE000, 0x110000)]:
        text = f"a{chr(x)}b"
        plain = codec.normalize(text)
        assert [w for c in codec._cut(text) if c for w in codec.words(c)] == [plain[a:z] for _, (a, z) in codec.cut_other(plain)], hex(x)


def test_segment_tree_on_texts_of_all_planes():
    from tokenizers import Tokenizer

    path, r = tokenizer("word_bpe_49k.json"), random.Random(11)
    lib, codec = Tokenizer.from_file(path), segment_bpe.codec(path)
    rare = [chr(x) for x in [*range(0x300, 0x370), *range(0x500, 0x600), *range(0x1C80, 0x1C90), *range(0x1100, 0x1200), *range(0xF900, 0xFA00)]] + [chr(r.randrange(0x10000, 0x110000)) for _ in range(500)]
    texts = ["".join(r.choice(rare) if r.random() < 0.4 else r.choice("aÉA's .\n,Σtre가") for _ in range(r.randint(1, 30))) for _ in range(4000)]
    for text, (ids, shown) in zip(texts, codec.encode_all(texts)):
        want = lib.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want and shown == lib.decode(want, skip_special_tokens=False), ascii(text)


def test_packing(spark):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    rows = list(enumerate(ODD + [t * 3 for _, t in some_texts(5) if t]))
    cap = 64
    got = best_fit_packing.pack(documents(spark, rows), path, capacity=cap).collect()
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for d, t in rows:
        ids = np.array(lib.encode(t, add_special_tokens=False).ids + [2], "<u4")
        mine = sorted(by_doc[d], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine))) and (len(ids) > cap or len(mine) == 1)
        assert all(r.length == cap for r in mine[1:])
        assert b"".join(ids[r.start : r.start + r.length].tobytes() for r in mine) == ids.tobytes()
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in mine)
    for mine in by_seq.values():
        at = 0
        for r in sorted(mine, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= cap


def plain_best_fit(lengths, cap):
    """The number of sequences of best-fit decreasing, one piece after the other."""
    gaps, n = [], 0
    for x in sorted(lengths, reverse=True):
        k = bisect.bisect_left(gaps, x)
        gap = gaps.pop(k) if k < len(gaps) else cap
        n += gap == cap
        if gap > x:
            bisect.insort(gaps, gap - x)
    return n


def test_packing_is_near_plain_best_fit(spark):
    path = tokenizer("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = best_fit_packing.pack(docs, path).toPandas()
    plain = plain_best_fit(got["length"], 1024)
    assert got["sequence_id"].nunique() <= plain * 1.001 + 1
    assert (got.groupby("sequence_id")["length"].sum() <= 1024).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(1, 40)), max_size=60))
def test_a_gap_goes_to_its_successor(steps):
    gaps, known = best_fit_packing.Gaps(), []
    for n, (put, size) in enumerate(steps):
        if put:
            gaps.put(size, n)
            known.append(size)
        else:
            fit = min((g for g in known if g >= size), default=None)
            hit = gaps.take(size)
            assert (hit and hit[0]) == fit
            if fit:
                known.remove(fit)


# --- 3: WARC


def test_warc(spark):
    big, wide = "x" * 150, "日本" * 60
    rows = [(5, "u", big), (3, "http://a\r\nb", big), (3, "v", big), (None, None, big), (7, "u", "short"), (8, "u", "short"), (9, "é", None), (10, "u", wide), (11, "u", wide)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    got = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc_bundles.round_trip(pages).collect()}
    first = {hashlib.sha256(big.encode()).hexdigest(): 3, hashlib.sha256(wide.encode()).hexdigest(): 10}
    want = set()
    for p, _, h in rows:
        raw = (h or "").encode()
        d = hashlib.sha256(raw).hexdigest()
        f = first.get(d)
        want.add((p, len(raw), d, "response" if f in (None, p) else "revisit", None if f in (None, p) else f))
    assert got == want


def test_bundles_can_be_sought(spark):
    import zstandard

    pages = spark.createDataFrame([(i, f"http://h/{i}", "p" * i) for i in range(40)], "page_id long, url string, html string")
    index, folder = warc_bundles.archive_pages(pages)
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(folder)
    for r in index.where("page_id % 7 = 0").collect():
        raw = system.open_input_file(f"{base}/{r.bundle}").read()
        frames = warc_bundles.read_seek_table(raw)
        begin, size, full = frames[r.frame]
        plain = zstandard.ZstdDecompressor().decompress(raw[begin : begin + size])
        assert len(plain) == full
        fields, block = warc_bundles.parse(plain[r.at : r.at + r.length])
        assert fields["WARC-Record-ID"] == f"<urn:page:{r.page_id}>" and block.endswith(b"p" * r.page_id)


# --- 4: quality rules


def base_counts(x):
    x = x or ""
    w = WORD.findall(x)
    at = collections.defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in x.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), dup, len(covered)


def test_base_counts(spark):
    r = random.Random(2)
    rows = [(i, "".join(r.choice(["a ", "b ", "é", "\n", "\n\n", "x #", "ab", "\t", "\x0b", "日 "]) for _ in range(r.randint(0, 80)))) for i in range(200)]
    rows += EDGE + [(900, "x\ny\nx"), (901, "x\n x\nx\n\n"), (902, "x\nx")]
    got = sorted((tuple(x)[:7] for x in quality_rules.judge_quality(documents(spark, rows)).collect()), key=str)
    want = []
    for d, x in rows:
        c = base_counts(x)
        want.append((d, *c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
    assert got == sorted(want, key=str)


def test_posterior_separates_junk(spark):
    r = random.Random(6)

    def prose(n):
        return " ".join(("".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) + ("." if i % 9 == 0 else "")) for i in range(n))

    good = [(i, prose(120)) for i in range(150)]
    bad = [(1000 + i, prose(120).replace(" ", "*** ") if i % 2 else prose(120).upper().replace(" ", "!! ")) for i in range(40)]
    kept = {x.doc_id: x.kept for x in quality_rules.judge_quality(documents(spark, good + bad)).collect()}
    assert all(kept[d] for d, _ in good) and not any(kept[d] for d, _ in bad)


# --- 1 and 5: classifiers, on the given tables


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


def test_toxicity_held_out(tables):
    docs, labels = tables
    got = toxicity.score_toxicity(docs, labels).join(labels, "doc_id").where("held_out").select("toxic", "predicted", "score").collect()
    assert np.mean([r.toxic == r.predicted for r in got]) >= 0.93 and all(0 <= r.score <= 1 for r in got)


ODD_ROWS = [*EDGE, (7, "Word! " * 3000), (7, "Word! " * 3000), (None, "one # two | three\n" * 60), (8, "x" * 30000), (9, "é.\né.\n! 12 A"), (10, "dull rotten " * 40)]


def test_models_equal_their_plain_evaluation(spark, tables):
    docs, labels = tables
    rows = [(r.doc_id, r.text) for r in docs.where("doc_id % 4 = 0").collect()] + ODD_ROWS
    some = documents(spark, rows)
    for module, learn, add, plain, cut in ((toxicity, toxicity.learn, toxicity.with_toxicity, plain_toxicity, 0.5), (rule_classifier, rule_classifier.learn, rule_classifier.with_quality, plain_quality, 0.3)):
        model = learn(docs, labels)
        got = add(some, model, "doc_id", text=True).collect()
        assert len(got) == len(rows)
        known = {t: plain(t, model) for t in {t for _, t in rows}}
        assert collections.Counter((r.doc_id, r._text) for r in got) == collections.Counter(rows)
        assert all(r.score == pytest.approx(known[r._text], abs=1e-6) for r in got), module.__name__
        scored = (toxicity.score_toxicity if module is toxicity else rule_classifier.score_quality)(some, labels.where("1 = 0")).collect()
        assert len(scored) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= cut) for r in scored)
        assert all(r.held_out for r in scored if r.doc_id is None)


def test_verdicts_equal_their_plain_evaluation(spark, tables):
    rows = [(r.doc_id, r.text) for r in tables[0].collect()] + ODD_ROWS
    texts = {t: plain_counts(t) for t in {t for _, t in rows}}
    names = list(quality_rules.rules())

    def votes(c):
        n, lines, letters = max(1, c["n_words"]), max(1, c["n_lines"]), max(1, c["n_upper"] + c["n_lower"])
        mean, stops, some = c["word_chars"] / n, c["n_stops"] / n, c["n_words"] >= 20
        against = {"symbols": c["n_symbols"] / n > 0.15, "marks": c["n_symbols"] / n > 0.5, "pipes": c["n_pipes"] / n > 0.1, "bangs": c["n_bangs"] / n > 0.3, "case": c["n_upper"] / letters > 0.5, "runs": c["n_same_next"] / n > 0.2, "repetition": c["n_repeat_words"] / n > 0.4, "lines": c["n_dup_lines"] / lines > 0.5}
        out = {k: -int(v) for k, v in against.items()}
        out["length"] = -1 if c["n_words"] < 20 else int(80 <= c["n_words"] <= 50_000)
        out["word_length"] = -1 if mean < 2.2 or mean > 12 else int(3.2 <= mean <= 8 and some)
        out["sentences"] = -1 if stops < 0.002 and c["n_words"] >= 50 else int(0.02 <= stops <= 0.4 and some)
        return tuple(out[n] for n in names)

    of = {t: votes(c) for t, c in texts.items()}
    patterns = sorted(collections.Counter(of[t] for _, t in rows).items())
    odds, weight = quality_rules.estimate(np.array([p for p, _ in patterns]), np.array([float(n) for _, n in patterns]))
    want = []
    for d, t in rows:
        c = texts[t]
        failed = c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]
        want.append((d, c["n_words"], failed, not failed and odds + sum(weight[i][v + 1] for i, v in enumerate(of[t])) >= 0))
    got = [(r.doc_id, r.n_words, r.base_failed, r.kept) for r in quality_rules.judge_quality(documents(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and any(x[3] for x in got) and not all(x[3] or x[2] for x in got)


def test_misspellings_share_scores():
    r = random.Random(3)
    clean = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(80)]
    texts = [" ".join(r.choice(clean) for _ in range(30)) + (" wretchedfool" if i % 4 == 0 else "") for i in range(200)]
    scores, bias = toxicity.fit(texts, np.array([float(i % 4 == 0) for i in range(200)]))
    data, at = utf8(pa.array([" ".join(clean[:20]) + " wretchedfol", " ".join(clean[:20]), ""]))
    p = toxicity.predict(data, at, scores, bias)
    assert p[0] > 0.5 > p[1] and 0 <= p[2] <= 1


def test_quality_held_out(tables):
    docs, labels = tables
    got = rule_classifier.score_quality(docs, labels).join(labels, "doc_id").where("held_out").select("quality", "predicted").collect()
    assert np.mean([r.quality == r.predicted for r in got]) >= 0.93


def test_labels_of_the_held_out_fold_change_nothing(tables):
    docs, labels = tables
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    turned = labels.withColumn("quality", F.when(fold, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert rule_classifier.learn(docs, labels) == rule_classifier.learn(docs, turned)


# --- 9: nearest neighbours


def recall_and_share(spark, x, ids, df, **more):
    """Mean recall of the 10 nearest, and the mean share of the vectors that a query verifies."""
    found, verified = projection_index.search_index(df, **more)
    got = collections.defaultdict(set)
    for r in found.collect():
        got[r.query_id].add(r.vec_id)
    hits, asked = 0, ids[ids % 100 == 0]
    for q in asked:
        order = np.lexsort((ids, ((x - x[ids == q]) ** 2).sum(1)))
        hits += len(got[q] & set([i for i in ids[order] if i != q][:10]))
    return hits / (10 * len(asked)), np.mean([r.verified for r in verified.collect()]) / len(ids)


def test_recall_without_structure(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.toPandas()
    recall, share = recall_and_share(spark, np.stack(rows["embedding"].to_list()).astype(float), rows["vec_id"].to_numpy(), df)
    assert recall >= 0.9 and share < 0.8


def test_recall_and_pruning_with_structure(spark, monkeypatch):
    monkeypatch.setattr(projection_index, "PART", 150)  # cells in parts, and copies of them
    monkeypatch.setattr(projection_index, "SERVED", 4)
    rng = np.random.default_rng(5)
    x = 4 * rng.normal(size=(40, 32))[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 32))
    x[:400] = x[0]  # a hot cell
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    recall, share = recall_and_share(spark, x, np.arange(3000), df)
    assert recall >= 0.9 and share < 0.2


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [2.0, 0.0]), (8, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (9, [1.0, 0.0]), (100, [5.0, 0.0]), (200, [])]
    got = sorted(tuple(r) for r in projection_index.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), confidence=1 - 1e-12).collect())
    assert got == [(0, 1, 1, 0.0), (0, 2, 9, 0.0), (0, 3, 7, 1.0), (0, 4, 100, 4.0), (100, 1, 7, 3.0), (100, 2, 0, 4.0), (100, 3, 1, 4.0), (100, 4, 9, 4.0)]


def test_repeated_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), *((i, [float(i), 0.5]) for i in range(5, 25))]
    got = collections.Counter(tuple(r) for r in projection_index.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), confidence=1 - 1e-12).collect())
    want = []
    for n, (q, v) in enumerate(rows):
        if q % 100 == 0:
            near = sorted((sum((a - b) ** 2 for a, b in zip(v, w)) ** 0.5, i) for m, (i, w) in enumerate(rows) if m != n)[:10]
            want += [(q, r, i, d) for r, (d, i) in enumerate(near, 1)]
    assert got == collections.Counter(want) and len(want) == 20


# --- 10: sharding


def test_sharding(spark):
    rows = [(i % 30, "same") for i in range(60)] + [(i, f"x{i % 15}") for i in range(45)] + [(i, f"own {i}") for i in range(100, 160)] + [(None, None), (None, "")]
    got = label_sharding.shard_documents(documents(spark, rows)).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert len(got) == len(rows) and max(map(len, by.values())) - min(map(len, by.values())) <= 1 and set(by) == set(range(8))
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    shards = collections.defaultdict(set)
    for r in got:
        shards[r.text_crc32].add(r.shard)
    cut = sum(len(shards[zlib.crc32(f"x{i}".encode())]) > 1 for i in range(15))
    assert cut == 0 and {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}


def test_propagation_gathers_equal_texts(spark):
    rows = [(i, f"x{i % 40}") for i in range(160)] + [(i, f"own {i}") for i in range(200, 300)]
    placed, history = label_sharding.propagate(documents(spark, rows))
    got = placed.collect()
    hubs, count = collections.defaultdict(collections.Counter), collections.Counter()
    for r in got:
        hubs[bytes(r.hub)][r.shard] += 1
        count[r.shard] += 1
    # The start, by hash of the id, knows nothing of the texts: most links are cut before the first round.
    assert history[0]["cut"] > 80 and history[0]["moved"] > 80 and history[-1]["moved"] == 0
    assert all(a["cut"] >= b["cut"] for a, b in zip(history, history[1:]))
    assert sum(sum(c.values()) - max(c.values()) for c in hubs.values()) == history[-1]["cut"] <= 4
    assert len(got) == len(rows) and max(count.values()) - min(count.values()) <= 1


def test_training_rows_are_bounded_and_filled(spark):
    docs = documents(spark, [(7, f"copy {i}") for i in range(60)] + [(i, f"text {i}") for i in range(100, 140)] + [(141, None)])
    labels = spark.createDataFrame([(7, 1)] + [(i, i % 2) for i in range(100, 1000)], "doc_id long, toxic int")
    usable = {i for i in [7, *range(100, 140)] if zlib.crc32(str(i).encode()) % 5}
    for bound in (20, 1000):
        got = training_rows(docs, labels, "toxic", bound).collect()
        assert len(got) == len({r["_id"] for r in got}) == min(bound, len(usable)) and {r["_id"] for r in got} <= usable
    assert 7 not in usable or [r["text"] for r in got if r["_id"] == 7] == ["copy 0"]


def test_a_cluster_needs_a_shared_folder():
    def session(master, folder=None):
        known = {"spark.master": master, "spark.checkpoint.dir": folder}
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: known.get(k) or d))

    assert shared_dir(session("local")).startswith("file://") and shared_dir(session("yarn", "hdfs://a/b/")) == "hdfs://a/b"
    for master in ("spark://h:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(ValueError):
            shared_dir(session(master))


def test_batches_are_bounded_by_bytes(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 20_000).alias("text"))

    def sizes(batch):
        yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], ["n"])

    got = [r.n for r in arrow_map(docs, sizes, "n long").collect()]
    assert sum(got) >= 400 * 100_000 and max(got) < 2 * BATCH_BYTES
