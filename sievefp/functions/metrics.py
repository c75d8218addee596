"""Similarity coefficients from popcounts, in single precision as results carry them.

c: common bits, q: bits of the query, d: bits of the row.  A coefficient without bits to
divide by is null, so that filters drop it; Tversky's is 0 there.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SYMMETRIC = ("tanimoto", "dice", "cosine")


def check(metric: str) -> str:
    if metric not in SYMMETRIC:
        raise ValueError(f"metric must be one of {', '.join(SYMMETRIC)}, not {metric!r}")
    return metric


def _ratio(over: Column, under: Column) -> Column:
    return (over.cast("double") / F.nullif(under.cast("double"), F.lit(0.0))).cast("float")


def coefficient(metric: str, c: Column, q: Column, d: Column) -> Column:
    if check(metric) == "tanimoto":
        return _ratio(c, q + d - c)
    if metric == "dice":
        return _ratio(c * 2, q + d)
    return _ratio(c, F.sqrt(q.cast("double") * d.cast("double")))


def tversky(c: Column, q: Column, d: Column, a: float, b: float) -> Column:
    """c / (c + a (q - c) + b (d - c)) with every step rounded to single precision."""
    single = lambda x: x.cast("float")
    under = single(c) + single(F.lit(float(a))) * single(q - c) + single(F.lit(float(b))) * single(d - c)
    return F.when(under == 0, F.lit(0.0).cast("float")).otherwise(_ratio(single(c), F.when(under != 0, under)))


def at_least(coeff: Column, threshold: float) -> Column:
    return coeff >= F.lit(float(threshold)).cast("float")
