"""Each stage of the pipeline against brute force on what its predecessor kept."""

import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests_llm_shared import brute_components, brute_cut, plain_quality, plain_toxicity
from tokenizers import Tokenizer

import corpus_pipeline
from skiff.llm import rule_classifier, toxicity
from skiff.llm.common import materialize
from skiff.llm.queries import tokenizer

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        made = materialize(stage(spark, docs, DATA), "stage")
        out.append((name, docs, made))
        docs = made
    return out


def test_columns(spark, steps):
    names = spark.read.parquet(f"{DATA}/documents.parquet").columns
    assert [n for n, _, _ in steps] == ["quality classifier", "toxicity", "n-gram Jaccard join", "suffix-array dedup", "best-fit packing"]
    assert all(made.columns == names for _, _, made in steps[:-1])


def test_classifiers_drop_what_they_reject(spark, steps):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    for (_, docs, made), module, plain, stays in ((steps[0], rule_classifier, plain_quality, lambda p: p >= 0.3), (steps[1], toxicity, plain_toxicity, lambda p: p < 0.5)):
        model = module.learn(docs, labels)
        want = [tuple(r) for r in docs.collect() if stays(plain(r.text, model))]
        assert sorted(tuple(r) for r in made.collect()) == sorted(want) and len(want) < docs.count()


def test_one_of_each_group_stays(steps):
    _, docs, made = steps[2]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(r.doc_id for r in made.collect()) == sorted({c for _, _, c in brute_components(rows, 5, Fraction("0.8"))})


def test_repeats_are_cut(steps):
    _, docs, made = steps[3]
    want = {d: kept.decode(errors="ignore") for d, _, _, _, kept in brute_cut([(r.doc_id, r.text) for r in docs.collect()], 400)}
    got = {r.doc_id: (r.text, r.n_chars) for r in made.collect()}
    assert got == {d: (t, len(t)) for d, t in want.items()}


def check_packed(docs, rows):
    """Token ids, cuts and offsets of every document, made again one by one."""
    lib, total = Tokenizer.from_file(tokenizer("byte_bpe_50k.json")), {}
    lib.no_truncation()
    want = Counter()
    for doc, text in docs:
        ids = np.array([*lib.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        want.update((doc, p, a, z - a, zlib.crc32(ids[a:z].tobytes())) for p, (a, z) in enumerate(zip(cuts, cuts[1:])))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == total.get(r.sequence_id, 0)
        total[r.sequence_id] = r.offset + r.length
    assert not total or max(total.values()) <= 1024


def test_all_is_packed(steps):
    _, docs, made = steps[4]
    check_packed([(r.doc_id, r.text) for r in docs.collect()], made.collect())


def test_odd_rows_and_empty_tables(spark):
    long = "A long sentence of plain words, that goes on. " * 700
    rows = [(None, None), (None, "twice"), (None, "twice"), (1, ""), (2, " \n"), (3, long), (3, long), (4, "Short one."), (5, None)]
    docs = spark.createDataFrame([(d, t, len(t or ""), "x", 1.0, "y") for d, t in rows], "doc_id long, text string, n_chars long, _row string, score double, `odd name` string")
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, DATA)
        out, none = made.collect(), stage(spark, docs.where("1 = 0"), DATA)
        assert none.count() == 0 and none.columns == made.columns
        if name == "best-fit packing":
            check_packed(rows, out)
            continue
        assert made.columns == docs.columns
        got = Counter((r.doc_id, r.text) for r in out)
        if name == "n-gram Jaccard join":
            assert got == Counter(set(rows))
        elif name == "suffix-array dedup":
            assert got == Counter((d, "" if t == long else t) for d, t in rows) and all(r.n_chars == (None if r.text is None else len(r.text)) for r in out)
        else:
            module, plain, stays = (rule_classifier, plain_quality, lambda p: p >= 0.3) if name == "quality classifier" else (toxicity, plain_toxicity, lambda p: p < 0.5)
            model = module.learn(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
            assert got == Counter((d, t) for d, t in rows if stays(plain(t, model)))


def test_a_mark_in_the_text_survives_a_cut(spark):
    same = "".join(chr(97 + i * i % 26) + chr(97 + i * 7 % 23) for i in range(250))
    # The repeat starts and ends inside letters: their other bytes go, the marks of the input stay.
    docs = spark.createDataFrame([(1, f"one \ufffd mark \u00e9{same}\u00e0 and \ufffd"), (2, f"other \u0169{same}\u00e1 end"), (3, "no cut \ufffd"), (4, None)], "doc_id long, text string")
    docs = docs.withColumn("n_chars", F.char_length("text").cast("long"))
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.repeats(spark, docs, DATA).collect()}
    want = {d: kept.decode(errors="ignore") for d, _, _, _, kept in brute_cut([(r.doc_id, r.text) for r in docs.where("text is not null").collect()], 400)}
    assert got == {d: (t, len(t)) for d, t in want.items()} | {4: (None, None)}
    assert got[1][0].count("\ufffd") == 2 and same not in got[1][0]
