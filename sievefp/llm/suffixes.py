"""Repeated passages of bytes by a depth-limited radix sort of suffixes.

A byte goes if some string of ``length`` bytes covers it that also starts anywhere else.
Suffixes matter through ``length`` bytes only, and not all of them need sorting one by one:
every window of ``length`` bytes names one anchor in it, the rightmost place where the hash of
the next GRAM bytes is least, so equal windows have equal anchors at equal offsets, and the
windows of one anchor are sorted as one row while they stay together.

Passes go from the most significant digit on.  The first digit of a window is the gram at its
anchor; suffixes alone with theirs repeat nothing and drop out.  Anchors with equal contexts
(all bytes that their windows cover, by 128-bit digests) repeat each other; one of each goes
on.  Each further pass cuts the offsets from window to anchor into finer cells.  What all
windows of a cell have in common is the next digit, compared byte by byte: rows are sorted by
it, rows that are alone with theirs drop out, and rows whose windows are all equal repeat each
other, so that one of them goes on.  In the last pass a cell is one offset and the digit is the
whole window: equal groups are exactly the repeated windows.  Rows are dealt by ranges of
digit and bytes, so a digit that many rows share is many tasks, and groups are read as a
stream.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievefp.llm.common import U64, Hasher, drop, mix, named, shuffles, stored, text_key, told, utf8, with_documents

LENGTH = 200
GRAM = 32
#: A cell of offsets is cut into so many in each pass.
RADIX = 4
_PIECE = 1 << 18


def _rolling(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of each data[i : i + size]."""
    h = Hasher.get()
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(h.values[data] * h.power[: len(data)], out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * h.inverse[: len(data) - size + 1], 7)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i : i + width]) for each i, in two running passes over blocks of width."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(U64).max, U64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(anchor, first window, last window, hash of the gram) of one text's bytes.

    Windows from first to last (starts) name the anchor; every start has one.  Long texts are
    done in pieces that overlap by a window, so memory stays bounded.
    """
    out = []
    for begin in range(0, max(len(data) - length + 1, 0), _PIECE):
        piece = data[begin : begin + _PIECE + length - 1]
        grams = _rolling(piece, gram)
        least = _sliding_min(grams, length - gram + 1)
        # the rightmost place of each window's least value: the last place up to the window's
        # end that is least in some window, or one before if that window is another
        ends = np.arange(len(least)) + length - gram
        place = np.where(_covers(grams, least, length - gram + 1), np.arange(len(grams)), -1)
        last = np.maximum.accumulate(place)
        at = last[ends]
        wrong = np.flatnonzero(grams[at] != least)
        while len(wrong):
            at[wrong] = last[at[wrong] - 1]
            wrong = wrong[grams[at[wrong]] != least[wrong]]
        cut = np.flatnonzero(np.diff(at, prepend=-1))
        out.append(np.stack([at[cut] + begin, cut + begin, np.append(cut[1:], len(at)) - 1 + begin, grams[at[cut]].view(np.int64)]))
    return np.concatenate(out, axis=1) if out else np.empty((4, 0), np.int64)


def _covers(grams: np.ndarray, least: np.ndarray, width: int) -> np.ndarray:
    """Whether each place holds the least of some window that covers it."""
    # max of least over windows = ~min(~least)
    inverted = np.full(len(grams) + width - 1, np.iinfo(U64).max, U64)
    inverted[width - 1 : width - 1 + len(least)] = ~least
    most = ~_sliding_min(inverted, width)
    return most[: len(grams)] == grams


def _document_anchors(column: pa.Array, length: int, gram: int):
    """For each text: (anchor, first, last, gram hash, context digest) of its anchors."""
    data, offsets = utf8(column)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        text = data[a:b]
        at, first, last, digit = anchors(text, length, gram)
        raw = text.tobytes()
        blake = hashlib.blake2b
        context = [
            blake(raw[f : l + length], digest_size=16, salt=(p - f).to_bytes(8, "little")).digest()
            for p, f, l in zip(at.tolist(), first.tolist(), last.tolist())
        ]
        yield at, first, last, digit, context


def _anchor_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """id, _key, at, first, last, digit, context of every anchor of every text."""

    def run(batches):
        for batch in batches:
            for i, (_, made) in enumerate(zip(range(batch.num_rows), _document_anchors(batch.column(2), length, gram))):
                n = len(made[0])
                if n:
                    which = pa.array(np.full(n, i))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(which), batch.column(1).take(which), *(pa.array(x, pa.int32()) for x in made[:3]), pa.array(made[3]), pa.array(made[4], pa.binary())],
                        ["id", "_key", "at", "first", "last", "digit", "context"],
                    )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, _key long, at int, first int, last int, digit long, context binary")


def steps(most: int) -> list[int]:
    """Offsets of a cell in each pass, for offsets from 0 to most."""
    out = [1]
    while out[-1] * RADIX <= most:
        out.append(out[-1] * RADIX)
    return out[::-1]


_ROW = "digit long, context binary, low int, high int, bytes binary"


def _sorted_groups(batches):
    """Rows (lo, core, low, high, bytes, digit, context) in order of all but the last two.

    Rows of equal low, high and bytes repeat each other: each comes out without bytes.  One of
    each such group goes on with its bytes, if the core has another or if the core's rows may
    go on in another task (at either end of this one's)."""
    core = group = held = None
    first, many, out = True, 0, []

    def made():
        columns = zip(*out) if out else [[]] * 5
        kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary())
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["digit", "context", "low", "high", "bytes"])
        out.clear()
        return batch

    for batch in batches:
        for lo, digit_bytes, low, high, text, digit, context in zip(*(c.to_pylist() for c in batch.columns)):
            row = (digit, context, low, high, text)
            if (lo, digit_bytes) != core:
                if held and first:
                    out.append(held)
                first = core is None
                core, group, held, groups = (lo, digit_bytes), None, None, 0
            if row[2:] != group:
                group, many, lead = row[2:], 1, row
                groups += 1
                if groups == 1:
                    held = row
                else:
                    if held:
                        out.append(held)
                    held = None
                    out.append(row)
            else:
                many += 1
                if many == 2:
                    out.append((*lead[:4], None))
                out.append((*row[:4], None))
        yield made()
    if held:
        out.append(held)
    yield made()


def _repeated(bodies: DataFrame, length: int, gram: int) -> DataFrame:
    """digit, context, low, high: offsets at which windows of a context repeat another's, from
    contexts (digit, context, low, high, bytes)."""
    found, rows, spread = [], bodies, shuffles(bodies.sparkSession)
    for step in steps(length - gram):
        cell = F.explode(F.sequence((F.col("low") / step).cast("int"), (F.col("high") / step).cast("int")))
        cells = rows.withColumn("cell", cell).withColumn("lo", F.col("cell") * step)
        low, high = F.greatest("low", "lo"), F.least("high", F.col("lo") + step - 1)
        part = F.substring("bytes", F.col("high") - high + 1, F.lit(length) + high - low)
        cells = cells.select("digit", "context", "lo", low.alias("low"), high.alias("high"), part.alias("bytes"))
        core = F.substring("bytes", F.col("high") - F.col("lo") + 1, F.lit(length - step + 1))
        order = ["lo", "core", "low", "high", "bytes"]
        dealt = cells.withColumn("core", core).repartitionByRange(spread, *order).sortWithinPartitions(*order)
        before, rows = rows, stored(dealt.select(*order, "digit", "context").mapInArrow(_sorted_groups, _ROW), f"pass-{step}", F.count("bytes").alias("open"))
        found.append(rows.filter("bytes is null").drop("bytes"))
        if not told(rows, "open"):
            break
        rows = rows.filter("bytes is not null")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _contexts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """digit, context, low, high, bytes of wanted (id, _key, at, first, last, digit, context)."""
    lists = stored(
        wanted.groupBy("id", "_key").agg(F.collect_list(F.struct("digit", "context", "at", "first", "last")).alias("places")).withColumnsRenamed({"id": "_wid", "_key": "_wkey"}),
        "context-places",
    )
    rows = with_documents(docs, lists).select("text", "places")

    def run(batches):
        for batch in batches:
            for text, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = text.encode()
                for start in range(0, len(places), 10_000):
                    some = places[start : start + 10_000]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([p["digit"] for p in some], pa.int64()), pa.array([p["context"] for p in some], pa.binary()),
                            pa.array([p["at"] - p["last"] for p in some], pa.int32()), pa.array([p["at"] - p["first"] for p in some], pa.int32()),
                            pa.array([raw[p["first"] : p["last"] + length] for p in some], pa.binary()),
                        ],
                        ["digit", "context", "low", "high", "bytes"],
                    )

    bodies = stored(rows.mapInArrow(run, _ROW), "bodies")
    drop(lists)
    return bodies


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """_id, _key, spans (array of [from, to) structs) of the documents (id, _key, text) that
    hold bytes covered by repeated windows.  Rows that repeat id and text are each other's
    repeats."""
    rows = stored(_anchor_rows(docs, length, gram), "anchors")
    twice = stored(rows.groupBy("digit").count().filter("count > 1").select("digit"), "digits")
    shared = stored(rows.hint("merge").join(twice, "digit"), "shared")
    drop(rows, twice)
    # contexts under a digit; a context that occurs more than once repeats all through
    kinds = shared.groupBy("digit", "context").agg(F.count("*").alias("n"), F.min(F.struct("id", "_key", "at", "first", "last")).alias("one"))
    kinds = stored(kinds, "contexts")
    many = kinds.groupBy("digit").agg(F.count("*").alias("m")).filter("m > 1").select("digit")
    bodies = _contexts(docs, kinds.join(many, "digit").select("digit", "context", "one.*"), length)
    parted = _repeated(bodies, length, gram)
    parted = stored(parted.groupBy("digit", "context").agg(F.collect_set(F.struct("low", "high")).alias("runs")), "runs")
    drop(bodies)
    full = kinds.filter("n > 1").select("digit", "context", F.lit(True).alias("all"))
    verdict = stored(full.join(parted, ["digit", "context"], "full"), "verdicts")
    whole = F.array(F.struct(F.col("first").alias("from"), (F.col("last") + length).alias("to")))
    pieces = F.transform("runs", lambda r: F.struct((F.col("at") - r["high"]).alias("from"), (F.col("at") - r["low"] + length).alias("to")))
    hit = shared.hint("merge").join(verdict, ["digit", "context"]).select("id", "_key", F.explode(F.when(F.col("all"), whole).otherwise(pieces)).alias("span"))
    found = stored(hit.groupBy(F.col("id").alias("_id"), F.col("_key").alias("_rkey")).agg(F.collect_set("span").alias("spans")), "removed")
    drop(shared, kinds, parted, verdict)
    return found


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["from"], s["to"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _with_spans(docs: DataFrame, length: int, id: str, text: str) -> DataFrame:
    keyed = docs.select(named(id).alias("id"), text_key(text).alias("_key"), named(text).alias("text"))
    spans = repeated_spans(keyed, length)
    both = keyed.hint("merge").join(spans, F.col("id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_rkey")), "left")
    return both.select("id", "text", "spans")


def removed_digests(docs: DataFrame, length: int = LENGTH, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs.

    Null texts are empty; texts shorter than ``length`` bytes keep all.  Runs that touch are
    one span.  A row that repeats another's id and text repeats its windows, too.
    """
    rows = _with_spans(docs, length, id, text)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            sizes, gone, runs, digests = [], [], [], []
            for body, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = memoryview((body or "").encode())
                merged = _merged(spans or [])
                digest, at = hashlib.sha256(), 0
                for a, b in merged:
                    digest.update(raw[at:a])
                    at = b
                digest.update(raw[at:])
                sizes.append(len(raw))
                gone.append(sum(b - a for a, b in merged))
                runs.append(len(merged))
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, gone, runs)), pa.array(digests)], [id, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            )

    return rows.mapInArrow(run, f"{id} {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = LENGTH, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, spans (array of [from, to) byte places removed), text (what is left; bytes of a
    character that was cut are dropped)."""
    rows = _with_spans(docs, length, id, text)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            kept, found = [], []
            for body, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                merged = _merged(spans or [])
                raw = (body or "").encode()
                edges = [0, *(x for s in merged for x in s), len(raw)]
                left = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                kept.append(None if body is None else left.decode("utf-8", "ignore"))
                found.append([{"from": a, "to": b} for a, b in merged])
            spans_type = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, spans_type), pa.array(kept)], [id, "spans", "text"])

    return rows.mapInArrow(run, f"{id} {kind}, spans array<struct<from: int, to: int>>, text string")
