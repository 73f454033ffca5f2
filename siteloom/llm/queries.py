"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import align_tokenizers
from .common import documents
from .cross_entropy import cross_entropy_difference
from .langid import identify
from .minhash import near_duplicates
from .mixing import mix
from .oracles import ORACLES
from .pieces import MODEL, segment
from .pii import find_pii
from .quality_rules import quality_rules
from .repeats import remove_repeats
from .rule_ensemble import score_quality
from .spelling import spelling_variants
from .toxicity import score_toxicity
from .webp import texts_as_images


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), width=3, percent=85)


def op3_information_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(documents(spark, sf_dir))


def op2_entropy_balancing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


def op4_nbest_segmentation(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    return segment(documents(spark, sf_dir), model)


def op1_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts_as_images(documents(spark, sf_dir))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(documents(spark, sf_dir))
    n = F.octet_length("kept").cast("long")
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - n).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_byte_cnn_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))


def op6_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_entropy_difference(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1"))


def op11_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(documents(spark, sf_dir))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_lossless_webp,
        op2_entropy_balancing,
        op3_information_pii,
        op4_nbest_segmentation,
        op5_byte_cnn_lang,
        op6_rule_ensemble,
        op7_quality_rules,
        op8_minhash_dedup,
        op9_cross_entropy_difference,
        op10_suffix_dedup,
        op11_nnpu_toxicity,
        op12_tokenizer_alignment,
        op13_spelling_variants,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLES.items() if k in queries()}
