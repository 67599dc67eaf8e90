"""The queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archives, fingerprints, jaccard, lines, packing, pieces, quality, repeats, secrets, toxicity
from .common import table


def tokenizer(name: str) -> str:
    """Where a public vocabulary file is; a parameter of the operators that need one."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", lines.host(F.col("url")).alias("host"), lines.page_text(F.col("html")).alias("text"))
    return lines.dedup(pages, "host", "text").select("page_id", "host", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.archive(spark, table(spark, sf_dir, "pages"))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited(table(spark, sf_dir, "documents"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeats(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict = {f.__name__: f for f in (op1_sentencepiece, op2_line_dedup, op3_warc, op4_secret_scans, op5_suffix_array_dedup, op6_best_fit_packing, op7_quality_rules, op8_fingerprints, op9_jaccard_join, op10_toxicity)}
ORACLE: dict[str, str] = {"op2_line_dedup": lines.SQL, "op7_quality_rules": quality.SQL, "op9_jaccard_join": jaccard.SQL}
