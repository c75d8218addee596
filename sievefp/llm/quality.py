"""Quality classifier by importance resampling.

Two generative models over hashed uni- and bigrams are compared: the target's, from labelled
good documents, and the raw text's, from all documents.  Both give each slot of a hash table
the probability that a document holds an n-gram of it, and are normalised by their numbers of
documents.  A document's log weight is the log of the ratio of its probabilities under both,
up to a constant that all documents share: the sum of the log odds ratios of its distinct
n-grams.  Every n-gram counts.  The target's estimates are shrunk towards the raw model's: a
log ratio is taken times the probability, given how often the n-gram stands in labelled good
and bad documents, that the n-gram tells them apart at all.  So text that is merely rare or
often copied moves a weight by next to nothing.

Documents are resampled by Gumbel top-k: a standard Gumbel variate is added to each log
weight, and the k largest are taken, which draws k documents without replacement in
proportion to their weights.  k is a parameter; if it is not given, labels set it: it is the
number of documents whose weight reaches the cut that parts held-out labelled good from bad.

The target, the shrinkage and the cut come from at most ``labelled`` labelled documents, a
quarter of them held out for the cut; the raw model, the weights and the selection cover all
documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievefp.llm.common import U64, Hasher, drop, fresh, mix, named, slabs, stored, summed_counts, tidy
from sievefp.llm.common import _lower as LOWER

#: Most labelled documents the fit and the cut are made from; also what is broadcast.
LABELLED = 20_000
SLOTS = 1 << 20
#: Documents that each slot is given in both models, with and without its n-gram.
PRIOR = 1.0
#: A good document that is rejected counts as much as this many bad ones that are kept.
KEEP_CARE = 3.0

_kind = np.full(256, 2, np.uint8)  # 0 blank, 1 word, 2 marks
_kind[[9, 10, 11, 12, 13, 32]] = 0
_kind[48:58] = _kind[65:91] = _kind[97:123] = 1
_kind[128:] = 1


def ngram_slots(data: np.ndarray, offsets: np.ndarray, slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of the distinct uni- and bigrams of words and runs of marks of each row.

    A token that repeats the one before it gives the same bigram whatever the token is, and
    so do runs of 3, 5 and 9 equal tokens (n-grams of repetition).
    """
    data = LOWER[data]
    kind = np.zeros(len(data) + 2, np.uint8)
    kind[1:-1] = _kind[data]
    row_start = np.zeros(len(data) + 1, bool)
    row_start[offsets[:-1]] = True
    change = (kind[1:] != kind[:-1]) | row_start
    starts = np.flatnonzero(change[:-1] & (kind[1:-1] > 0))
    ends = np.flatnonzero(change[1:] & (kind[1:-1] > 0)) + 1
    tokens = Hasher.get().spans(data, starts, ends)
    bounds = np.searchsorted(starts, offsets)
    first = np.zeros(len(tokens), bool)
    inner = bounds[:-1]
    first[inner[inner < len(tokens)]] = True
    out = np.empty(2 * len(tokens), np.int64)
    mask = U64(slots - 1)
    out[0::2] = mix(tokens, 1) & mask
    before = np.concatenate([tokens[:1], tokens[:-1]])
    before[first] = U64(0x5555)
    pair = np.where(before == tokens, U64(0x777), before * U64(0x9E3779B97F4A7C15) ^ (tokens + U64(1)))
    out[1::2] = mix(pair, 2) & mask
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    keys = [np.repeat(rows, 2) * slots + out]
    run = (before == tokens) & ~first
    for reach in (1, 2, 4):  # runs of 2 equal tokens -> of 3 -> of 5 -> of 9
        run[reach:] &= run[:-reach].copy()
        run[:reach] = False
        keys.append(rows[run] * slots + int(mix(np.array([reach], U64), 3)[0] & mask))
    both = np.unique(np.concatenate(keys))
    return both // slots, both % slots


def _labels(labels: DataFrame, id: str, most: int) -> DataFrame:
    """doc id, good, fit: at most ``most`` labelled documents, by a hash of their id."""
    one = labels.filter(F.col(id).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(id).alias("_lid")).agg(
        F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")
    )
    mixed = F.xxhash64(F.lit("labelled"), "_lid")
    return one.orderBy(mixed, "_lid").limit(most).select("_lid", ((F.col("q") == 1) & (F.col("t") == 0)).alias("_good"), (F.pmod(F.xxhash64(F.lit("fit"), "_lid"), F.lit(4)) > 0).alias("_fit"))


def _with_labels(docs: DataFrame, labels: DataFrame, id: str) -> DataFrame:
    # at most LABELLED rows of an id and two flags
    return docs.join(F.broadcast(labels), named(id) == F.col("_lid"), "left")


class Model:
    """Log odds ratios by slot; ``cut`` is the weight from which a document counts as good."""

    def __init__(self, ratio: np.ndarray, cut: float = -np.inf):
        self.ratio, self.cut = ratio, cut

    def weights(self, column: pa.Array) -> np.ndarray:
        """The log weight of each text; 0 for null, empty and blank ones."""
        out = []
        for _, _, data, offsets in slabs(column):
            rows, slots = ngram_slots(data, offsets, len(self.ratio))
            out.append(np.bincount(rows, self.ratio[slots], len(offsets) - 1))
        return np.concatenate(out) if out else np.zeros(0)


def telling(good: np.ndarray, bad: np.ndarray, n_good: int, n_bad: int) -> np.ndarray:
    """The probability of each slot to part good from bad documents.

    The log odds are half the likelihood ratio statistic of the shares of good and of bad
    documents less the log of the number of documents: half of that is the penalty of one more
    parameter, half the odds before any are seen."""
    n, both = max(n_good + n_bad, 1), good + bad

    def part(seen, expected):
        return seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9))

    half = 0.0
    for held, of in ((good, n_good), (bad, n_bad)):
        lack = np.maximum(of - held, 0)
        half = half + part(held, both * of / n) + part(lack, np.maximum(n - both, 0) * of / n)
    return 1 / (1 + np.exp(np.clip(np.log(n) - half, -50, 50)))


def log_ratios(target: np.ndarray, raw: np.ndarray, bad: np.ndarray, n_target: int, n_raw: int, n_bad: int, prior: float = PRIOR) -> np.ndarray:
    """The shrunk log odds ratio of each slot, from the numbers of documents that hold it."""
    if not n_target or not n_raw:
        return np.zeros(len(raw), np.float32)
    expected = raw * (n_target / n_raw)
    # good text is more common in the target than in all text: the median ratio is made 0
    often = (expected > 5) & (target > 0)
    if often.any():
        ratio = np.log(target[often] / expected[often])
        order = np.argsort(ratio, kind="stable")
        weight = np.cumsum(target[often][order])
        expected = np.minimum(expected * np.exp(ratio[order][np.searchsorted(weight, weight[-1] / 2)]), n_target)
    odds = lambda x: np.log((x + prior) / (n_target - x + prior))
    target = np.minimum(target, n_target)
    return ((odds(target) - odds(expected)) * telling(target, bad, n_target, n_bad)).astype(np.float32)


def _counter(slots: int):
    """Numbers of documents by slot: raw of all, target and bad of the labelled ones to fit to."""

    def count(batches):
        for batch in batches:
            kind = [0 if g is None or not f else 1 if g else 2 for g, f in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            kind = np.array(kind, np.int8)
            held, size = {"raw": [], "target": [], "bad": []}, 0
            for a, b, data, offsets in slabs(batch.column(0)):
                rows, found = ngram_slots(data, offsets, slots)
                found = found.astype(np.int32)
                held["raw"].append(found)
                for name, k in (("target", 1), ("bad", 2)):
                    if (kind[a:b] == k).any():
                        held[name].append(found[kind[a:b][rows] == k])
                size += len(found)
                if size > 1 << 21:
                    yield {n: np.bincount(np.concatenate(x), minlength=slots) for n, x in held.items() if x}
                    held, size = {"raw": [], "target": [], "bad": []}, 0
            yield {n: np.bincount(np.concatenate(x), minlength=slots) for n, x in held.items() if x}

    return count


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", labelled: int = LABELLED, slots: int = SLOTS, prior: float = PRIOR) -> Model:
    """The model of labelled good against all documents.

    Labels: id, quality (1 good), toxic (1 bad; null counts as 0); rows with a null id or
    quality are left out, and of repeated ones the worst counts.  Without labelled good
    documents all ratios are 0, and without bad ones there is no cut: every document is kept.
    """
    known = stored(_labels(labels, id, labelled), "labelled")
    columns = _with_labels(docs.select(named(id).alias(id), named(text).alias(text)), known, id).select(named(text), "_good", "_fit")
    sums = summed_counts(columns, _counter(slots), slots, ["raw", "target", "bad"])
    seen = {(r["_good"], r["_fit"]): r["count"] for r in known.groupBy("_good", "_fit").count().collect()}
    ratio = log_ratios(sums["target"], sums["raw"], sums["bad"], seen.get((True, True), 0), docs.count(), seen.get((False, True), 0), prior)
    model = Model(ratio)
    if not (seen.get((True, False)) and seen.get((False, False)) and seen.get((False, True))):
        return model
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def score(batches):
        plain = Model(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(plain.weights(batch.column(0))), batch.column(1)], ["w", "good"])

    # at most as many rows as labelled documents (and rows that repeat their ids)
    held = columns.filter("_good is not null and not _fit").select(named(text), "_good").mapInArrow(tidy(score), "w double, good boolean")
    held = held.groupBy(F.round("w", 3).alias("w"), "good").count().toPandas()
    drop(known)
    w, good, n = held["w"].to_numpy(float), held["good"].to_numpy(bool), held["count"].to_numpy(float)
    if good.any() and not good.all():
        model.cut = _best_cut(w, good, n)
    return model


def _best_cut(w: np.ndarray, good: np.ndarray, n: np.ndarray) -> float:
    order = np.argsort(w)
    w, good, n = w[order], good[order], n[order]
    lost = np.cumsum(n * good) / (n * good).sum()  # good ones at or under w[i]
    caught = np.cumsum(n * ~good) / (n * ~good).sum()
    gain = caught - KEEP_CARE * lost
    best = int(np.argmax(gain))
    if gain[best] <= 0:
        return -np.inf
    return float((w[best] + w[min(best + 1, len(w) - 1)]) / 2)


def gumbel(id: str, seed: int):
    """A standard Gumbel variate of each id; the same for the same id and seed."""
    u = (F.pmod(F.xxhash64(F.lit(seed), named(id)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def weigh(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text", weight: str = "log_weight", key: str = "sample_key", seed: int = 7) -> DataFrame:
    """docs with log_weight and sample_key, the weight plus a Gumbel variate by id and seed.

    Only texts go to Python.  Columns that have the two names already are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model.ratio)

    def weights(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        plain = Model(shared.value)
        for some in texts:
            yield pa.array(plain.weights(some), pa.float64())

    with_weight = docs.withColumn(weight, F.arrow_udf(tidy(weights), "double")(named(text)))
    return with_weight.withColumn(key, named(weight) + gumbel(id, seed))


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 1024, small: int = 4096) -> float:
    """The exact k-th largest value of a double column: the range that holds it is narrowed
    by counts in bins until few enough values are left to look at."""
    if k <= 0:
        return float("inf")
    low, high = df.agg(F.min(column), F.max(column)).first()
    above = 0
    while low < high:
        inside = df.filter(F.col(column).between(low, high))
        width = (high - low) / bins
        at = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)) if width > 0 else F.lit(0)
        counts = sorted(((r[0], r[1], r[2], r[3]) for r in inside.groupBy(at.alias("b")).agg(F.count("*"), F.min(column), F.max(column)).collect()), reverse=True)
        for _, n, least, most in counts:
            if above + n >= k:
                break
            above += n
        if (least, most) == (low, high):
            break
        low, high = least, most
        if n <= small:
            values = sorted((r[0] for r in df.filter(F.col(column).between(low, high)).select(column).collect()), reverse=True)
            return values[k - above - 1]
    return low


def classify(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", k: int | None = None) -> DataFrame:
    """id, log_weight, accepted for every row of docs.

    Accepted are the k rows with the largest sample_key (rows that tie with the last one
    too); without k, as many as there are rows whose log weight reaches the model's cut.
    Null, empty and blank texts weigh 0.  Rows that repeat an id share its variate.
    """
    model = fit(docs, labels, id, text)
    narrow = docs.select(named(id).alias("_id"), named(text).alias("_text"))
    keys = stored(weigh(narrow, model, "_id", "_text").drop("_text"), "weights")
    limit = threshold(keys, model, k=k)
    return keys.select(F.col("_id").alias(id), "log_weight", (F.col("sample_key") >= F.lit(limit)).alias("accepted"))


def threshold(keys: DataFrame, model: Model, weight: str = "log_weight", key: str = "sample_key", k: int | None = None) -> float:
    """The least sample key that is accepted."""
    if k is None:
        if model.cut == -np.inf:
            return float("-inf")
        k = keys.filter(named(weight) >= F.lit(model.cut)).count()
    elif k >= keys.count():
        return float("-inf")
    return kth_largest(keys, key, k)


def accepted(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", k: int | None = None) -> DataFrame:
    """The rows of docs that classify accepts, with the columns of docs, whatever their names."""
    model = fit(docs, labels, id, text)
    weight, key = fresh(docs, "_weight", "_sample")
    weighed = stored(weigh(docs, model, id, text, weight, key), "weighed")
    limit = threshold(weighed, model, weight, key, k)
    return weighed.filter(named(key) >= F.lit(limit)).drop(weight, key)
