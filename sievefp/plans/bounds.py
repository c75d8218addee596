"""Popcounts that can reach a threshold.

A row of d bits shares at most min(q, d) of a query's q bits, which bounds its coefficient.
The bound is evaluated on the driver for every popcount a width allows, and the range from
the first to the last that reaches the threshold becomes a predicate on the stored popcount:
it is pushed into the scan and, with rows laid out by popcount, skips row groups.
"""

from __future__ import annotations

import math
from collections.abc import Callable


def _best(kind: str, a: float, b: float) -> Callable[[int, int], float]:
    def tanimoto(q, d):
        return min(q, d) / max(q, d)

    def dice(q, d):
        return 2 * min(q, d) / (q + d)

    def cosine(q, d):
        return min(q, d) / math.sqrt(q * d)

    def tversky(q, d):
        return min(q, d) / (a * q + b * d + (1 - a - b) * min(q, d))

    def substructure(q, d):
        return min(q, d) / q

    return {"tanimoto": tanimoto, "dice": dice, "cosine": cosine, "tversky": tversky, "substructure": substructure}[kind]


def popcount_range(kind: str, query_bits: int, threshold: float, width: int, a: float = 0.0, b: float = 0.0) -> tuple[int, int] | None:
    """(least, most) popcount that may reach threshold; None if none may.

    A bound of 0 / 0 reaches nothing; a positive one over 0 reaches everything.
    """
    best = _best(kind, a, b)
    kept = []
    for d in range(width + 1):
        try:
            bound = best(query_bits, d)
        except ZeroDivisionError:
            bound = math.inf if min(query_bits, d) else math.nan
        if bound >= threshold:
            kept.append(d)
    return (kept[0], kept[-1]) if kept else None


def partner_limit(metric: str, bits: int, threshold: float, width: int) -> int:
    """The greatest popcount, not under bits, that a row of ``bits`` bits may pair with; -1
    if there is none (no bits, or a threshold out of reach)."""
    if threshold <= 0:
        return width
    found = popcount_range(metric, bits, threshold * (1 - 1e-9), width)
    return found[1] if found and bits and found[1] >= bits else -1
