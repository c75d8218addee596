"""The operators' registered queries and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from sievefp.llm import bpe, brown, covertree, decontaminate, jaccard, lines, quality, suffixes, tokenfile, warc
from sievefp.llm.common import table


def vocabulary() -> str:
    """Path of the byte-level BPE file; SIEVEFP_BPE names another one."""
    if named := os.environ.get("SIEVEFP_BPE"):
        return named
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), size=3, percent=90).drop("_key")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("_key")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.removed_digests(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_digests(table(spark, sf_dir, "pages"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.line_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", "text")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_file_digests(table(spark, sf_dir, "documents"), vocabulary())


def op7_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(table(spark, sf_dir, "documents"), vocabulary())


def op9_brown_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score(table(spark, sf_dir, "documents"))


def op10_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict:
    return {
        "op1_jaccard_join": op1_jaccard_join,
        "op2_decontaminate": op2_decontaminate,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_warc": op4_warc,
        "op5_line_dedup": op5_line_dedup,
        "op6_token_files": op6_token_files,
        "op7_cover_tree": op7_cover_tree,
        "op8_bpe_trie": op8_bpe_trie,
        "op9_brown_scores": op9_brown_scores,
        "op10_importance_resampling": op10_importance_resampling,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_jaccard_join": jaccard.ORACLE,
        "op2_decontaminate": decontaminate.ORACLE,
        "op4_warc": warc.ORACLE,
        "op5_line_dedup": lines.ORACLE,
        "op7_cover_tree": covertree.ORACLE,
    }
