"""Columns on packed fingerprints: ARRAY<BIGINT> words, most significant bit first.

Bit p stands in word p div 64 at shift 63 - p mod 64; a short last piece of a bit string is
right-aligned in its word.  Words are unsigned 64-bit values in two's complement.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def signed(word: int) -> int:
    """An unsigned 64-bit word as the LONG that holds its bits."""
    return word - (1 << 64) if word >= 1 << 63 else word


def pack_string(bits: str) -> list[int]:
    """Words of a string of 0 and 1."""
    return [signed(int(bits[i : i + 64], 2)) for i in range(0, len(bits), 64)]


def pack_positions(positions: Sequence[int], width: int) -> list[int]:
    """Words of the set bit positions of a fingerprint of width bits."""
    on = set(positions)
    return pack_string("".join("1" if p in on else "0" for p in range(width)))


def literal(words: Sequence[int]) -> Column:
    return F.array(*[F.lit(signed(w)).cast("long") for w in words])


def pack(positions: Column, words: int) -> Column:
    """Words of an array of set bit positions (null: none), for widths that fill their words.

    Lambdas take words * positions steps a row, so more than a few words are packed by numpy
    on Arrow batches."""
    if words > 4:
        return _packer(words)(positions)

    def word(k):
        mine = F.filter(F.array_distinct(positions), lambda p: F.floor(p / 64) == k)
        shifted = F.transform(mine, lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(63) - F.pmod(p, F.lit(64))).cast("int")))
        return F.aggregate(shifted, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))

    return F.transform(F.sequence(F.lit(0), F.lit(words - 1)), word)


def _packer(words: int):
    import numpy as np
    import pandas as pd

    def run(positions: pd.Series) -> pd.Series:
        lists = [np.asarray(p if p is not None else (), np.int64) for p in positions]
        rows = np.repeat(np.arange(len(lists)), [len(p) for p in lists])
        flat = np.concatenate([*lists, np.empty(0, np.int64)])
        out = np.zeros((len(lists), words), np.uint64)
        np.bitwise_or.at(out, (rows, flat // 64), np.uint64(1) << (63 - flat % 64).astype(np.uint64))
        return pd.Series(list(out.view(np.int64)))

    return F.pandas_udf(run, "array<long>", F.PandasUDFType.SCALAR)


def popcount(words: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda s, w: s + F.bit_count(w))


def common(a: Column, b: Column) -> Column:
    """How many bits both have."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda s, n: s + n)


def holds(words: Column, query: Column) -> Column:
    """Whether every bit of query is set in words."""
    return F.forall(F.zip_with(words, query, lambda w, q: w.bitwiseAND(q) == q), lambda same: same)


def on_bits(words: Column) -> Column:
    """The positions of set bits, ascending."""
    every = F.sequence(F.lit(0), F.size(words) * 64 - 1)
    return F.filter(every, lambda p: F.getbit(F.get(words, F.floor(p / 64).cast("int")), (F.lit(63) - p % 64).cast("int")) == 1)
