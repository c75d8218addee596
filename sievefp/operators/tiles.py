"""All-against-all comparisons by tiles of rows.

Rows are dealt to blocks: strips of neighbouring popcounts, and where a strip holds more than
TILE rows, pieces of it by a hash of the id, so that a popcount that half of all rows share is
many blocks.  Block pairs whose popcounts cannot reach the threshold are never made.  The
others are compared by one matrix product each: with two columns more than the bits, it gives
how far common bits lie above what the threshold asks for.  Common bits are whole numbers, so
they are read off the entries that reach it by rounding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievefp.plans.bounds import partner_limit, popcount_range

TILE = 4096
#: Rows of a block that one product takes.
_ROWS = 512
#: Partners of a block that travel with one copy of it, at least where the k best are kept.
_SHARE = 8
#: MB of blocks that one partition of panels has: Python workers may get it as one batch.
_PART_MB = 8
#: Panels a core where the k best are kept, so many at least.
_PANELS = 16
#: Columns of the first block that tell what a row's k best must reach at least.
_PROBE = 512
#: Room for rounding in single precision; what lies within is computed exactly.
_SLACK = 0.01


def strips(counts: dict[int, int], tile: int) -> list[tuple[int, int, int]]:
    """(least popcount, greatest, pieces) of consecutive strips of about a tile of rows."""
    out: list[list[int]] = []
    held = 0
    for popcnt, n in sorted(counts.items()):
        if out and held + n <= tile:
            out[-1][1] = popcnt
            held += n
        else:
            out.append([popcnt, popcnt, -(-n // tile)])
            held = n
    return [tuple(s) for s in out]


def _blocks(rows: DataFrame, id: str, width: int, tile: int) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """(block, ids, pops, words) as one row a block, and the strips; block = strip << 32 | piece."""
    counts = {r["popcnt"]: r["count"] for r in rows.groupBy("popcnt").count().collect()}  # width + 1 rows at most
    plan = strips(counts, tile)
    strip_of, pieces = [0] * (width + 1), [1] * (width + 1)
    for s, (low, high, k) in enumerate(plan):
        for p in range(low, high + 1):
            strip_of[p], pieces[p] = s, k
    at = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("popcnt"))
    block = F.call_function("shiftleft", at(strip_of).cast("long"), F.lit(32)) + F.pmod(F.xxhash64(id), at(pieces).cast("long"))
    dealt = rows.select(block.alias("block"), F.col(id).alias("id"), F.col("popcnt").cast("int").alias("popcnt"), "words")

    def pack(key, table):
        words = table["words"].combine_chunks().flatten().to_numpy()
        ids, pops = table["id"].to_numpy(), table["popcnt"].to_numpy()
        return pa.table({"block": [key[0].as_py()], "ids": [ids.astype("<i8").tobytes()], "pops": [pops.astype("<i4").tobytes()], "words": [words.astype("<i8").tobytes()]})

    return dealt.groupBy("block").applyInArrow(pack, "block long, ids binary, pops binary, words binary"), plan


def _pairs(spark, left: list, right: list, reach, mirror: bool, share=lambda pairs: _SHARE) -> tuple[DataFrame, int]:
    """(a, b, share) of the blocks of two lists of strips that reach(left strip) = (least,
    greatest popcount) lets meet, and how many they are; with mirror, both lists are one and a <= b."""
    rows, every = [], 0
    for s, (low, high, k) in enumerate(left):
        least, most = reach(low, high)
        inside = [t for t, (lo, hi, _) in enumerate(right) if hi >= least and lo <= most and (not mirror or t >= s)]
        if inside:
            rows.append((s, k, inside[0], inside[-1]))
            every += k * sum(kt for _, _, kt in right[inside[0] : inside[-1] + 1])
    met = spark.createDataFrame(rows, "s long, ks int, low int, high int").select("s", "ks", F.explode(F.sequence("low", "high")).alias("t"))
    pieces = spark.createDataFrame([(t, k) for t, (_, _, k) in enumerate(right)], "t int, kt int")
    # a row for each popcount at most on either side; block pairs are made where they are dealt
    met = met.join(F.broadcast(pieces), "t")
    i, j = (F.explode(F.sequence(F.lit(0), F.col(k) - 1)) for k in ("ks", "kt"))
    block = lambda s, i: F.call_function("shiftleft", F.col(s).cast("long"), F.lit(32)) + F.col(i)
    both = met.select("s", "t", i.alias("i"), "kt").select("s", "t", "i", j.alias("j")).select(block("s", "i").alias("a"), block("t", "j").alias("b"))
    both = both.filter("a <= b") if mirror else both
    shares = max(1, -(-sum(k for *_, k in right) // share(every)))
    return both.withColumn("share", F.pmod(F.xxhash64("b"), F.lit(shares))), every


class _Block:
    """A block's ids and popcounts, and its bits with the columns of the threshold's side."""

    def __init__(self, ids, pops, words, metric: str, threshold: float, left: bool):
        self.ids, self.pops = np.frombuffer(ids, "<i8"), np.frombuffer(pops, "<i4").astype(np.float64)
        n = len(self.ids)
        raw = np.frombuffer(words, np.uint8).reshape(n, -1)
        width = raw.shape[1] * 8
        self.bits = np.empty((n, width + 2), np.float32)
        self.bits[:, :width] = np.unpackbits(raw, axis=1)
        if left:
            self.ask(metric, threshold)
        else:
            self.bits[:, width], self.bits[:, width + 1] = (np.sqrt(self.pops), 0) if metric == "cosine" else (1, self.pops)

    def ask(self, metric: str, threshold) -> None:
        """Common bits must reach: tanimoto t / (1 + t) (q + d), dice t / 2 (q + d), cosine t sqrt(q d);
        the threshold is one, or one for each row."""
        t = np.maximum(threshold, 0)
        share = {"tanimoto": t / (1 + t), "dice": t / 2, "cosine": t}[metric]
        own = np.sqrt(self.pops) if metric == "cosine" else self.pops
        self.least = np.broadcast_to(np.float32(threshold), len(self.ids))
        self.bits[:, -2], self.bits[:, -1] = -share * own, -share

    def first(self, start: int, n: int) -> _Block:
        """Some of the rows, without copies."""
        out = _Block.__new__(_Block)
        for name in ("ids", "pops", "bits", "least"):
            if hasattr(self, name):
                setattr(out, name, getattr(self, name)[start : start + n])
        return out


def _coefficient(metric: str, c: np.ndarray, q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """As metrics.coefficient, nan without bits to divide by."""
    with np.errstate(invalid="ignore", divide="ignore"):
        if metric == "tanimoto":
            return (c / (q + d - c)).astype(np.float32)
        return (2 * c / (q + d)).astype(np.float32) if metric == "dice" else (c / np.sqrt(q * d)).astype(np.float32)


def _found(x: _Block, y: _Block, metric: str, same: bool) -> Iterator[tuple]:
    """(rows, columns, coefficients) of what reaches x's threshold, some rows of x at a time;
    with same, each pair of one block once."""
    (a, b), (c, d) = x.bits[:, -2:].T.astype(np.float64), y.bits[:, -2:].T.astype(np.float64)
    for start in range(0, len(x.ids), _ROWS):
        product = x.bits[start : start + _ROWS] @ y.bits.T
        above = product >= -_SLACK
        if same:
            above &= np.arange(start, start + len(above))[:, None] < np.arange(len(y.ids))
        at, product = np.flatnonzero(above), product.ravel()
        for some in range(0, len(at), 1 << 17):
            one = at[some : some + (1 << 17)]
            rows, cols = np.divmod(one, len(y.ids))
            rows += start
            common = np.rint(product[one] - a[rows] * c[cols] - b[rows] * d[cols])
            coeff = _coefficient(metric, common, x.pops[rows], y.pops[cols])
            hit = coeff >= x.least[rows]
            yield rows[hit], cols[hit], coeff[hit]


def _panels(pairs: DataFrame, every: int, left: DataFrame, right: DataFrame, width: int, tile: int) -> DataFrame:
    """For each (a, share): the block a, then its partners, as rows (other, a, b, ids, pops, words).

    So many partitions that none grows with the tables."""
    own = pairs.select("a", "share").distinct().join(left, F.col("a") == F.col("block")).select("a", "share", F.lit(False).alias("other"), F.lit(None).cast("long").alias("b"), "ids", "pops", "words")
    others = pairs.join(right, F.col("b") == F.col("block")).select("a", "share", F.lit(True).alias("other"), "b", "ids", "pops", "words")
    n = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-every * tile * (width // 8 + 12) // int(_PART_MB * 1e6)))
    both = own.unionByName(others).repartition(n, "a", "share").sortWithinPartitions("a", "share", "other")
    return both.select("other", "a", "b", "ids", "pops", "words")


def _visit(metric: str, threshold: float, found, mirror: bool, end=lambda x: ()):
    """Runs over panels and yields what found(x, y, same) does of each pair of blocks, and end(x)
    of each panel; with mirror, both blocks are of one table.

    A block that meets itself is compared with the copy at hand: another copy may hold its
    rows in another order, as a shuffle brings them in any, and each pair is told by order."""

    def run(batches):
        x = own = None
        for batch in batches:
            for other, a, b, *held in zip(*batch.columns):
                held, same = [h.as_buffer() for h in held], mirror and a.as_py() == b.as_py()
                if not other.as_py():
                    yield from end(x) if x else ()
                    x, own = _Block(*held, metric, threshold, True), held
                else:
                    yield from found(x, _Block(*(own if same else held), metric, threshold, False), same)
        yield from end(x) if x else ()

    return run


def half_matrix(fps: DataFrame, threshold: float, metric: str, width: int, tile: int = TILE) -> DataFrame:
    """i, j, coeff of each pair of different rows that reaches the threshold, once."""

    def found(x, y, same):
        for rows, cols, coeff in _found(x, y, metric, same):
            yield pa.RecordBatch.from_arrays([pa.array(x.ids[rows]), pa.array(y.ids[cols]), pa.array(coeff)], ["i", "j", "coeff"])

    return _half_panels(fps, threshold, metric, width, tile).mapInArrow(_visit(metric, threshold, found, True), "i long, j long, coeff float")


def matrix(fps: DataFrame, threshold: float, metric: str, width: int, tile: int = TILE) -> DataFrame:
    """i, j, dist of both orders of each pair of different rows that reaches the threshold.

    Rows of one i and one distance stand together, so that a file holds little more of them
    than j: the result is what this costs on disk."""

    def found(x, y, same):
        for rows, cols, coeff in _slabs(_found(x, y, metric, same)):
            dist = (np.float32(1) - coeff).view(np.uint32).astype(np.uint64)
            yield from _sorted(rows, dist, cols, x.ids, y.ids)
            yield from _sorted(cols, dist, rows, y.ids, x.ids)

    return _half_panels(fps, threshold, metric, width, tile).mapInArrow(_visit(metric, threshold, found, True), "i long, j long, dist float")


def _half_panels(fps: DataFrame, threshold: float, metric: str, width: int, tile: int) -> DataFrame:
    blocks, plan = _blocks(fps.select("mol_id", "words", "popcnt"), "mol_id", width, tile)
    most = [partner_limit(metric, p, threshold, width) for p in range(width + 1)]
    pairs = _pairs(fps.sparkSession, plan, plan, lambda low, high: (0, max(most[low : high + 1])), True)
    return _panels(*pairs, blocks, blocks, width, tile)


def _slabs(found: Iterator[tuple], most: int = 1 << 20) -> Iterator[tuple]:
    """What is found, in pieces of some most entries."""
    held, n = [], 0
    for part in found:
        held.append(part)
        n += len(part[0])
        if n >= most:
            yield tuple(np.concatenate(c) for c in zip(*held))
            held, n = [], 0
    if n:
        yield tuple(np.concatenate(c) for c in zip(*held))


def _sorted(i: np.ndarray, dist: np.ndarray, j: np.ndarray, i_ids: np.ndarray, j_ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Entries by i, distance and j, which are sorted as one number: 16, 32 and 16 bits."""
    key = np.sort(i.astype(np.uint64) << np.uint64(48) | dist << np.uint64(16) | j.astype(np.uint64))
    for some in range(0, len(key), 1 << 17):
        one = key[some : some + (1 << 17)]
        columns = [i_ids[(one >> np.uint64(48)).astype(np.int64)], j_ids[(one & np.uint64(0xFFFF)).astype(np.int64)], (one >> np.uint64(16)).astype(np.uint32).view(np.float32)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["i", "j", "dist"])


def best_matches(fps: DataFrame, queries: DataFrame, k: int | None, threshold: float, metric: str, width: int, tile: int = TILE) -> DataFrame:
    """query_id, mol_id, coeff of all rows that reach the threshold; with k, of each panel (a
    block of queries and some blocks of rows) the k best for each query only: the k best of all
    are among them.

    With k, a row is computed only if it reaches the k-th best that its query has so far."""
    blocks, plan = _blocks(fps.select("mol_id", "words", "popcnt"), "mol_id", width, tile)
    asked, ask_plan = _blocks(queries.select("query_id", "words", "popcnt"), "query_id", width, tile)
    ranges = [popcount_range(metric, p, threshold * (1 - 1e-9), width) or (1, 0) for p in range(width + 1)]

    def reach(low, high):
        open_ = [r for r in ranges[low : high + 1] if r[0] <= r[1]] if threshold > 0 else [(0, width)]
        return (min(r[0] for r in open_), max(r[1] for r in open_)) if open_ else (1, 0)

    def found(x, y, same):
        for rows, cols, coeff in _found(x, y, metric, False):
            yield _matches(x.ids[rows], y.ids[cols], coeff)

    share = lambda every: _SHARE
    if k is not None:  # few panels give few rows to rank, but each core has several
        share = lambda every: max(_SHARE, every // (_PANELS * fps.sparkSession.sparkContext.defaultParallelism))
    pairs = _pairs(fps.sparkSession, ask_plan, plan, reach, False, share)
    panels = _panels(*pairs, asked, blocks, width, tile)
    if k is None:
        run = _visit(metric, threshold, found, False)
    else:
        run = _visit(metric, threshold, lambda x, y, same: _keep(x, y, metric, threshold, k), False, _kept)
    return panels.mapInArrow(run, "query_id long, mol_id long, coeff float")


def _matches(query_ids: np.ndarray, mol_ids: np.ndarray, coeff: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(query_ids), pa.array(mol_ids), pa.array(coeff)], ["query_id", "mol_id", "coeff"])


def _keep(x: _Block, y: _Block, metric: str, threshold: float, k: int) -> tuple:
    """Brings x.best, the k best of each row so far (rows, ids, coefficients, by row), up to y;
    gives no rows yet.  Coefficients of the k-th best are reached too, for ids decide ties."""
    least, least_id = np.full(len(x.ids), threshold, np.float32), np.full(len(x.ids), np.iinfo(np.int64).max)
    if not hasattr(x, "best"):
        x.best = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
        if 0 < k <= len(y.ids):
            few = y.first(0, _PROBE) if k <= _PROBE else y
            for start in range(0, len(x.ids), _ROWS):
                some = slice(start, start + _ROWS)
                common = (x.bits[some, :-2] @ few.bits[:, :-2].T).astype(np.float64)
                coeff = np.nan_to_num(_coefficient(metric, common, x.pops[some, None], few.pops), nan=-np.inf)
                least[some] = np.maximum(least[some], np.partition(coeff, len(few.ids) - k, axis=1)[:, len(few.ids) - k])
    else:
        rows, ids, coeff = x.best
        last = np.flatnonzero(np.bincount(rows, minlength=len(x.ids)) == k)  # k best are known
        at = np.searchsorted(rows, last, "right") - 1
        least[last], least_id[last] = np.maximum(least[last], coeff[at]), ids[at]
    x.ask(metric, least)
    for rows, cols, coeff in _slabs(_found(x, y, metric, False)):
        ids = y.ids[cols]
        better = (coeff > least[rows]) | (ids < least_id[rows])
        rows, ids, coeff = (np.concatenate((old, new[better])) for old, new in zip(x.best, (rows, ids, coeff)))
        order = np.lexsort((ids, -coeff, rows))
        order = order[np.arange(len(order)) - np.searchsorted(rows[order], rows[order]) < k]
        x.best = rows[order], ids[order], coeff[order]
    return ()


def _kept(x: _Block) -> Iterator[pa.RecordBatch]:
    rows, ids, coeff = getattr(x, "best", ((), (), ()))
    if len(rows):
        yield _matches(x.ids[rows], ids, coeff)
