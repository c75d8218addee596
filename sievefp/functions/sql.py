"""SQL functions on fingerprints: fp_popcount, fp_common, fp_tanimoto, fp_dice, fp_contains, fp_bits."""

from __future__ import annotations

from pyspark.sql import SparkSession

_COMMON = "aggregate(zip_with(a, b, (x, y) -> bit_count(x & y)), 0, (s, n) -> s + n)"
_COUNT = "aggregate({0}, 0, (s, w) -> s + bit_count(w))"


def register(spark: SparkSession) -> None:
    """Defines the functions in the session; fp_bits is a table function of set positions."""
    two = "a ARRAY<BIGINT>, b ARRAY<BIGINT>"
    count_a, count_b = _COUNT.format("a"), _COUNT.format("b")
    bodies = {
        "fp_popcount(a ARRAY<BIGINT>) RETURNS INT": count_a,
        f"fp_common({two}) RETURNS INT": _COMMON,
        f"fp_tanimoto({two}) RETURNS FLOAT": f"CAST(CAST({_COMMON} AS DOUBLE) / nullif({count_a} + {count_b} - {_COMMON}, 0) AS FLOAT)",
        f"fp_dice({two}) RETURNS FLOAT": f"CAST(CAST(2 * {_COMMON} AS DOUBLE) / nullif({count_a} + {count_b}, 0) AS FLOAT)",
        f"fp_contains({two}) RETURNS BOOLEAN": "forall(zip_with(a, b, (x, y) -> (x & y) = y), t -> t)",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION fp_bits(a ARRAY<BIGINT>) RETURNS TABLE(bit INT) RETURN "
        "SELECT p FROM (SELECT explode(sequence(0, size(a) * 64 - 1)) AS p) WHERE getbit(a[CAST(floor(p / 64) AS INT)], 63 - p % 64) = 1"
    )
