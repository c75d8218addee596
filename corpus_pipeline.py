"""The training-data pipeline: documents through five operators of sievefp.llm.

Each stage takes what the one before it kept, is written as Parquet in the shared folder and
read again.  All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievefp.llm import bpe, decontaminate, jaccard, lines, quality
from sievefp.llm.common import fresh, named, new_path, stored, table, text_key
from sievefp.llm.registry import vocabulary


def accept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling accepts.

    Null and empty texts weigh 0, as clean ones nearly do, and mostly stay; rows that repeat
    id and text go or stay together.  Without labels all documents stay."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later occurrences of three-line windows; one that loses all its
    lines goes, and n_chars follows the text.

    Null and empty texts stay; of documents with equal ids and texts each row stays."""
    own = [c for c in ("n_lines", "n_removed") if c in docs.columns]
    held = fresh(docs, *own)  # columns of docs that line_dedup would replace
    found = lines.line_dedup(docs.withColumnsRenamed(dict(zip(own, held))))
    left = found.filter(~((F.col("n_removed") > 0) & (F.col("n_removed") == F.col("n_lines"))))
    length = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    names = dict(zip(own, held))
    return left.withColumn("n_chars", length).select(*[named(names.get(c, c)).alias(c) for c in docs.columns])


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group of near copies."""
    return jaccard.one_of_each(docs, size=5, percent=80)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten-word window of a benchmark item.

    Null and empty texts have no words and stay; rows that repeat id and text go or stay
    together.  Without benchmark items all documents stay."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    key, hit_id, hit_key = fresh(docs, "_key", "_hit_id", "_hit_key")
    hit = stored(found.filter("contaminated").select(F.col("doc_id").alias(hit_id), F.col("_key").alias(hit_key)), "contaminated")
    keyed = docs.withColumn(key, text_key())
    return keyed.join(hit, F.col("doc_id").eqNullSafe(F.col(hit_id)) & (F.col(key) == F.col(hit_key)), "left_anti").drop(key)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of them and of the text decoded from them.

    The executor's memory is shared with idle workers of the stages before, so parts are small."""
    return bpe.bpe_digests(docs, vocabulary(), ids=True, part=1 << 22, lean=True)


STAGES = [
    ("quality", accept),
    ("lines", dedup_lines),
    ("near copies", dedup_near),
    ("decontamination", remove_contaminated),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: SQL can express neither the classifier nor the byte-pair encoding.
ORACLE_SQL = None
