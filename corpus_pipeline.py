"""A corpus pipeline: five stages over ``documents``, each written and read again for the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skiff.llm import best_fit_packing, jaccard_join, rule_classifier, suffix_dedup, toxicity
from skiff.llm.common import materialize
from skiff.llm.queries import table, tokenizer


def _rows(docs: DataFrame) -> DataFrame:
    """Each row as its text and one column with all others, so that no name of them can clash and the text is sent once."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"], F.col("text").isNull().alias("_null")).alias("_row"), "doc_id", "text")


def _columns(docs: DataFrame, text: str) -> list:
    """The columns of ``docs`` again, with ``text`` in the place of the text."""
    return [F.col(text).alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the quality classifier does not reject.

    A null or empty text is scored as one without words; repeated rows and rows with equal ids are judged
    each by its own text, ties of a score with the threshold stay, and an empty table gives an empty one.
    """
    model = rule_classifier.learn(docs, table(spark, sf_dir, "labels"))
    return rule_classifier.with_quality(_rows(docs), model, "_row", text=True).where("score >= 0.3").select(*_columns(docs, "_text"))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the toxicity model does not reject.

    A null or empty text has the score of a text without words; repeated rows and rows with equal ids are
    judged each by its own text, a score of 0.5 is rejected, and an empty table gives an empty one.
    """
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.with_toxicity(_rows(docs), model, "_row", text=True).where("score < 0.5").select(*_columns(docs, "_text"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: five-word shingles, similarity 0.8 at least.

    The one with the smallest id stays, a null id being the largest; rows of equal id and text are
    one. Null texts, and texts without words, are near nothing and stay; an empty table gives an empty one.
    """
    return jaccard_join.drop_near_copies(docs, k=5, threshold="0.8")


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut what is covered by repeated strings of 400 bytes; bytes of letters that a cut splits go too.

    Null texts stay null and all rows stay, also those of which nothing is left. Repeated rows
    are documents of their own, so theirs is cut; an empty table gives an empty one.
    """
    cut = suffix_dedup.with_cut(_rows(docs), 400, suffix_dedup.BLOCK, "_row", as_text=True)
    cut = cut.withColumn("_text", F.when(~F.col("_row._null"), F.col("kept")))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("_row", F.col("_row").withField("n_chars", F.char_length("_text").cast("long")))
    return cut.select(*_columns(docs, "_text"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 1024 tokens; a null or empty text is the end id alone, and an empty table gives an empty one."""
    return best_fit_packing.pack(docs, tokenizer("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES = [
    ("quality classifier", quality),
    ("toxicity", toxic),
    ("n-gram Jaccard join", near_copies),
    ("suffix-array dedup", repeats),
    ("best-fit packing", packing),
]

#: SQL expresses neither the models nor the merges; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what happens to odd rows is said at each stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
