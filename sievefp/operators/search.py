"""Searches of one query, or a table of queries, over a fingerprint table.

A fingerprint table has mol_id LONG, words ARRAY<BIGINT>, popcnt INT.  One query's words are
literals of the plan, so a search is a scan with a pushed-down popcount range, a projection
and a filter, without a shuffle; ties rank by mol_id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievefp.functions import bits, metrics
from sievefp.operators import tiles
from sievefp.plans.bounds import popcount_range


def _bits(words: Sequence[int]) -> int:
    return sum((w & (1 << 64) - 1).bit_count() for w in words)


def within(fps: DataFrame, limits: tuple[int, int] | None) -> DataFrame:
    """Rows whose popcount lies in limits; no rows for None."""
    if limits is None:
        return fps.filter(F.lit(False))
    return fps.filter(F.col("popcnt").between(*limits))


def _scored(fps: DataFrame, words: Sequence[int], limits, score) -> DataFrame:
    shared = bits.common(F.col("words"), bits.literal(words))
    return within(fps, limits).select("mol_id", score(shared, F.lit(_bits(words)), F.col("popcnt")).alias("coeff"))


def _ranked(found: DataFrame, k: int = 0) -> DataFrame:
    ordered = found.orderBy(F.desc("coeff"), "mol_id")
    return ordered.limit(k) if k > 0 else ordered


def similarity(fps: DataFrame, words: Sequence[int], threshold: float, metric: str = "tanimoto") -> DataFrame:
    """mol_id, coeff of rows whose coefficient reaches the threshold, the best first."""
    metrics.check(metric)
    limits = popcount_range(metric, _bits(words), threshold, 64 * len(words))
    found = _scored(fps, words, limits, lambda c, q, d: metrics.coefficient(metric, c, q, d))
    return _ranked(found.filter(metrics.at_least(F.col("coeff"), threshold)))


def top_k(fps: DataFrame, words: Sequence[int], k: int, threshold: float = 0.0, metric: str = "tanimoto") -> DataFrame:
    """The k best rows of those that reach the threshold; k = 0 gives all of them."""
    metrics.check(metric)
    limits = popcount_range(metric, _bits(words), threshold, 64 * len(words))
    found = _scored(fps, words, limits, lambda c, q, d: metrics.coefficient(metric, c, q, d))
    return _ranked(found.filter(metrics.at_least(F.col("coeff"), threshold)), k)


def tversky(fps: DataFrame, words: Sequence[int], threshold: float, a: float, b: float) -> DataFrame:
    limits = popcount_range("tversky", _bits(words), threshold, 64 * len(words), a, b)
    found = _scored(fps, words, limits, lambda c, q, d: metrics.tversky(c, q, d, a, b))
    return _ranked(found.filter(metrics.at_least(F.col("coeff"), threshold)))


def substructure(fps: DataFrame, words: Sequence[int]) -> DataFrame:
    """mol_id of rows that hold every bit of the query; an empty query finds none."""
    q = _bits(words)
    limits = popcount_range("substructure", q, 1.0, 64 * len(words)) if q else None
    return within(fps, limits).filter(bits.holds(F.col("words"), bits.literal(words))).select("mol_id")


def device_similarity(fps: DataFrame, words: Sequence[int], threshold: float) -> DataFrame:
    """Tanimoto search that never returns coefficients of 0, whatever the threshold."""
    return similarity(fps, words, threshold).filter(F.col("coeff") > 0)


def batch_similarity(fps: DataFrame, queries: DataFrame, threshold: float, metric: str = "tanimoto", words: int = 1) -> DataFrame:
    """query_id, mol_id, coeff: every row that reaches the threshold for each query
    (query_id, words, popcnt)."""
    metrics.check(metric)
    return tiles.best_matches(fps, queries, None, threshold, metric, 64 * words)


def batch_top_k(fps: DataFrame, queries: DataFrame, k: int, threshold: float, metric: str = "tanimoto", words: int = 1) -> DataFrame:
    """query_id, mol_id, coeff, rank: the k best rows for each query (query_id, words, popcnt)
    of those that reach the threshold; ties rank by mol_id.

    Queries meet rows block by block, and a block pair gives the k best of each query only.
    """
    metrics.check(metric)
    found = tiles.best_matches(fps, queries, k, threshold, metric, 64 * words)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("coeff"), "mol_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def distance_matrix(fps: DataFrame, threshold: float, metric: str = "tanimoto", words: int = 1) -> DataFrame:
    """i, j, dist (1 - coefficient) of all ordered pairs of different rows that reach the
    threshold, as a sparse symmetric matrix by mol_id; the diagonal is left out.

    Blocks of rows are compared pair by pair; the lower triangle mirrors the upper one.  With
    a threshold of 0 every pair is part of the result.  mol_id must be unique.
    """
    metrics.check(metric)
    return tiles.matrix(fps, threshold, metric, 64 * words)
