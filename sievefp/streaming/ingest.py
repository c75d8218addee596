"""Streams: new rows into a dataset, and searches of a stream of queries."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sievefp.functions import bits, metrics
from sievefp.sources import store


def ingest(rows: DataFrame, featurizer: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Fingerprints of a stream of rows, appended to a dataset of store.create.

    Each batch is one data folder, named by the checkpoint and the batch, so that a batch that
    is done again after a restart is added once.  What the dataset holds already stays."""
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def add(batch: DataFrame, number: int) -> None:
        store.append(featurizer(batch), path, f"stream-{stream}-{number}")

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def match(queries: DataFrame, fps: DataFrame, threshold: float, metric: str = "tanimoto") -> DataFrame:
    """query_id, mol_id, coeff of a stream of queries (query_id, words, popcnt) against a
    table: a stateless stream-static join."""
    asked = queries.select("query_id", F.col("words").alias("query_words"), F.col("popcnt").alias("query_bits"))
    coeff = metrics.coefficient(metric, bits.common(F.col("words"), F.col("query_words")), F.col("query_bits"), F.col("popcnt"))
    # each query is dealt to the popcounts that Tanimoto, Dice and cosine can reach from it
    ratio = {"tanimoto": threshold, "dice": threshold / (2 - threshold), "cosine": threshold**2}[metrics.check(metric)]
    if not 0 < threshold <= 1:
        raise ValueError("a stream is searched with a threshold over 0 and up to 1")
    low, high = F.ceil(F.col("query_bits") * ratio - 1e-9).cast("int"), F.floor(F.col("query_bits") / ratio + 1e-9).cast("int")
    dealt = asked.filter("query_bits > 0").withColumn("popcnt", F.explode(F.sequence(F.greatest(low, F.lit(1)), high)))
    return dealt.join(fps, "popcnt").select("query_id", "mol_id", coeff.alias("coeff")).filter(metrics.at_least(F.col("coeff"), threshold))
