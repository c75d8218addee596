"""Set-level similarity (instantaneous similarity) from column sums of bits.

With c the number of rows that set a bit and n rows, a bit contributes c (c - 1) / 2 pairs
that both set it, (n - c) (n - c - 1) / 2 that both lack it and c (n - c) that differ.  All
64 * words columns count, padding included.  Leave-one-out indices come from the column sums
in closed form: one pass over the set bits, no dense matrix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievefp.functions import bits


def column_sums(fps: DataFrame) -> DataFrame:
    """bit, c of the bits that some row sets (at most 64 * words rows)."""
    return fps.select(F.explode(bits.on_bits(F.col("words"))).alias("bit")).groupBy("bit").agg(F.count("*").alias("c"))


def _sums(fps: DataFrame, words: int) -> tuple[int, list[int]]:
    """(rows, column sums): one pass; the driver gets at most 64 * words + 1 numbers."""
    places = F.concat(F.array(F.lit(-1)), bits.on_bits(F.col("words")))
    found = {r["bit"]: r["count"] for r in fps.select(F.explode(places).alias("bit")).groupBy("bit").count().collect()}
    return found.get(-1, 0), [found.get(i, 0) for i in range(64 * words)]


def counters(fps: DataFrame, words: int, k: int = 1) -> DataFrame:
    """One row: n, a, d, dis, p; every bit's share is taken to the power 1 / k."""
    n, sums = _sums(fps, words)
    part = lambda of: float(sum(of(c) ** (1.0 / k) for c in sums))
    a, d, dis = part(lambda c: c * (c - 1) / 2), part(lambda c: (n - c) * (n - c - 1) / 2), part(lambda c: c * (n - c))
    return fps.sparkSession.createDataFrame([(float(n), a, d, dis, a + d + dis)], "n double, a double, d double, dis double, p double")


def set_similarity(fps: DataFrame, words: int, k: int = 1) -> DataFrame:
    """One row: jt = a / (a + dis), rr = a / p, sm = (a + d) / p."""
    ratio = lambda x, y: x / F.nullif(y, F.lit(0.0))
    a, d, dis, p = (F.col(x) for x in ("a", "d", "dis", "p"))
    return counters(fps, words, k).select(ratio(a, a + dis).alias("jt"), ratio(a, p).alias("rr"), ratio(a + d, p).alias("sm"))


def complementary(fps: DataFrame, words: int, index: str = "RR") -> DataFrame:
    """mol_id, index: the set's index without each row in turn; null for fewer than 3 rows."""
    if index not in ("RR", "JT", "SM"):
        raise ValueError("index must be RR, JT or SM")
    n, sums = _sums(fps, words)
    rest = n - 1
    if rest < 2:
        return fps.select("mol_id", "popcnt", F.lit(None).cast("double").alias("index"))
    a0, x0, d0 = (float(sum(of(c) for c in sums)) for of in (lambda c: c * (c - 1) / 2, lambda c: c * (rest - c), lambda c: (rest - c) * (rest - c - 1) / 2))
    # without a row, a column it sets loses one: what changes depends on the sum of its columns' sums
    counts = F.array(*[F.lit(float(c)) for c in sums])
    held = F.aggregate(bits.on_bits(F.col("words")), F.lit(0.0), lambda s, i: s + F.get(counts, i))
    own = F.size(bits.on_bits(F.col("words"))).cast("double")
    a = F.lit(a0) - (held - own)
    pairs = F.lit(64.0 * words * rest * (rest - 1) / 2)
    value = {
        "RR": a / pairs,
        "JT": a / F.nullif(F.lit(a0 + x0) + held - own * rest, F.lit(0.0)),
        "SM": (F.lit(a0 + d0) + own * (rest + 1) - held * 2) / pairs,
    }[index]
    return fps.select("mol_id", "popcnt", value.alias("index"))


def medoid(fps: DataFrame, words: int, index: str = "RR") -> DataFrame:
    """mol_id of the row whose absence lowers the index most; ties by popcount, then mol_id."""
    return complementary(fps, words, index).orderBy("index", "popcnt", "mol_id").limit(1).select("mol_id")


def outlier(fps: DataFrame, words: int, index: str = "RR") -> DataFrame:
    """mol_id of the row whose absence raises the index most; ties by popcount, then mol_id."""
    return complementary(fps, words, index).orderBy(F.desc("index"), "popcnt", "mol_id").limit(1).select("mol_id")
