"""The registered queries of the corpus operators, one for each, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Path of a public tokenizer's vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skiff.llm.toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skiff.llm.jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), k=3, threshold="0.9")


def op3_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skiff.llm.warc_bundles import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op4_weak_supervision_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skiff.llm.quality_rules import judge_quality

    return judge_quality(table(spark, sf_dir, "documents"))


def op5_rule_ensemble_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skiff.llm.rule_classifier import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skiff.llm.best_fit_packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), capacity=1024, end_id=2)


def op7_segment_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skiff.llm.segment_bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skiff.llm.suffix_dedup import suffix_dedup

    cut = suffix_dedup(table(spark, sf_dir, "documents"), length=400)
    digest = F.sha2("kept", 256).alias("kept_sha256")
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", digest, (F.col("n_bytes") - F.col("n_removed")).alias("n_kept"), (F.col("n_removed") > 0).alias("cut"))


def op9_projection_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skiff.llm.projection_index import nearest

    return nearest(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op10_label_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skiff.llm.label_sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"), shards=8)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL where it can express the result over whole tables; op9 is approximate, and tests measure its recall."""
    return {
        "op3_warc_bundles": """
            WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
                 d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
                 f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
            SELECT page_id, payload_bytes, payload_digest,
                   CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
                   CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to
            FROM f""",
    }
