"""What the operators share: the cluster's shared folder, row keys, and byte-level text tools.

The text tools work on whole Arrow string columns with numpy: words are found with a
byte table and hashed with prefix sums of a polynomial, so no Python loop runs per word.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import hashlib
import tempfile
import threading
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

U64 = np.uint64
#: While tables are written: shuffle files of plans that have ended go, and Python workers
#: get their rows in small batches.
_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}
_writing = {"lock": threading.Lock(), "writers": 0, "before": {}}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.  Only a local master may leave it unset: then it is
    a temporary folder of this machine; on a cluster that is an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sievefp-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def _settings(spark: SparkSession):
    """_WRITING holds in the session from the first writer that begins to the last that ends."""
    with _writing["lock"]:
        if not _writing["writers"]:
            _writing["before"] = {k: spark.conf.get(k, None) for k in _WRITING}
            for k, v in _WRITING.items():
                spark.conf.set(k, v)
        _writing["writers"] += 1
    try:
        yield
    finally:
        with _writing["lock"]:
            _writing["writers"] -= 1
            if not _writing["writers"]:
                for k, v in _writing["before"].items():
                    spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, name: str, *told) -> DataFrame:
    """Cut lineage: df written as a Parquet table in the shared folder and read again.

    Once it is written nothing reads its shuffle files any more, so Spark may remove them.
    The write counts the rows, and takes further aggregates where told names any.
    """
    spark, path, seen = df.sparkSession, new_path(df.sparkSession, name), Observation()
    with _settings(spark):
        df.observe(seen, F.count(F.lit(1)).alias("rows"), *told).write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at, out._told = path, seen.get
    return out


def told(df: DataFrame, name: str = "rows"):
    """What the write of a stored table counted: its rows, or an aggregate given to stored."""
    return df._told[name]


def drop(*tables: DataFrame | None) -> None:
    """Removes tables that ``stored`` has written and that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_stored_at", None)
        if path:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def tidy(run):
    """run, after whose last batch the Python worker gives back the memory it no longer uses.

    Workers wait for their next task in turn, so an executor has more of them than cores, and
    what each of them has freed but not given back counts against its memory."""

    @functools.wraps(run)
    def body(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # a C library without malloc_trim
                ctypes.CDLL(None).malloc_trim(0)

    return body


def parts(batch: pa.RecordBatch, column: int, most: int):
    """Slices of batch, in order, of rows whose texts have at most so many bytes together."""
    _, offsets = utf8(batch.column(column))
    row = 0
    while row < batch.num_rows:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield batch.slice(row, to - row)
        row = to


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def extended(df: DataFrame, name: str, kind: str) -> StructType:
    """The schema of df and one more column."""
    return StructType([*df.schema.fields, StructField(name, _parse_datatype_string(kind))])


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names for columns of our own that no column of df has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def named(column: str):
    """The column of exactly this name, whatever dots it holds."""
    return F.col(f"`{column.replace('`', '``')}`")


def shuffles(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_key(text: str = "text"):
    """Tells rows of one doc_id apart; rows that repeat id and text count as one document."""
    return F.xxhash64(F.coalesce(named(text), F.lit("")), named(text).isNull())


#: Slots of the table that tells which documents can be left out of a join.
_DOC_SLOTS = 1 << 20


def with_documents(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """docs (id, _key, ...) joined with wanted (_wid, _wkey, ...) by document.

    A broadcast set of hash slots, of fixed size whatever the tables hold, keeps most other
    documents out of the shuffle while wanted is small; beyond, the join does all the work."""
    slot = lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(_DOC_SLOTS)).alias("_slot")
    slots = wanted.select(slot("_wid", "_wkey")).distinct()
    near = docs.withColumn("_slot", slot("id", "_key")).join(F.broadcast(slots), "_slot", "left_semi").drop("_slot")
    return near.hint("merge").join(wanted, F.col("id").eqNullSafe(F.col("_wid")) & (F.col("_key") == F.col("_wkey")))


# ---------------------------------------------------------------- bytes and words

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Bytes that are worked on at once; longer words have a hash of their own kind.
_SLAB = 1 << 18


def _mixed(x: np.ndarray) -> np.ndarray:
    """Full avalanche on uint64 (the finaliser of splitmix64), in place where possible."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    return _mixed(x + U64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, U64)
    out[0] = 1
    filled = 1
    while filled < n:  # doubling: base^(filled + i) = base^filled * base^i
        step = min(filled, n - filled)
        out[filled : filled + step] = out[:step] * U64(pow(base, filled, 1 << 64))
        filled += step
    return out


class Hasher:
    """Polynomial hashing modulo 2^64 over random byte values; words up to a slab long."""

    BASE = 0x5851F42D4C957F2D
    _made: "Hasher | None" = None

    def __init__(self):
        self.values = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=U64)
        self.power = _powers(self.BASE, 2 * _SLAB + 1)
        self.inverse = _powers(pow(self.BASE, -1, 1 << 64), 2 * _SLAB + 1)

    @classmethod
    def get(cls) -> "Hasher":
        if cls._made is None:
            cls._made = cls()
        return cls._made

    def spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each data[start:end]; spans are in order and do not overlap."""
        out = np.empty(len(starts), U64)
        if not len(starts):
            return out
        long = ends - starts > _SLAB
        block = starts // _SLAB
        cuts = np.flatnonzero(np.diff(block, prepend=-1, append=block[-1] + 1))
        for a, b in zip(cuts[:-1], cuts[1:]):
            low = int(starts[a])
            high = int(ends[b - 1]) if not long[b - 1] else int(starts[b - 1])
            piece = data[low:high]
            sums = np.zeros(len(piece) + 1, U64)
            np.cumsum(self.values[piece] * self.power[: len(piece)], out=sums[1:])
            first, last = starts[a:b] - low, np.minimum(ends[a:b] - low, len(piece))
            out[a:b] = (sums[last] - sums[first]) * self.inverse[np.minimum(first, 2 * _SLAB)]
        out = mix(out ^ (ends - starts).astype(U64))
        for i in np.flatnonzero(long):
            digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
            out[i] = U64(int.from_bytes(digest, "little"))
        return out


def byte_table(separators: bytes) -> np.ndarray:
    """True at bytes that belong to words."""
    inside = np.ones(256, bool)
    inside[np.frombuffer(separators, np.uint8)] = False
    return inside


_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and the offsets of its rows."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data, offsets


def slabs(column: pa.Array, most: int = _SLAB):
    """Consecutive rows of about 256 KB: (first row, row after the last, bytes, offsets)."""
    data, offsets = utf8(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, to, data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row]
        row = to


def find_words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
    """(lower-cased bytes, starts, ends, words per row); no word spans two rows."""
    data = _lower[data]
    flag = np.zeros(len(data) + 2, np.int8)
    flag[1:-1] = inside[data]
    step = np.diff(flag)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    # a word that runs over a row's border is cut there
    borders = offsets[1:-1]
    borders = np.unique(borders[(borders > 0) & (borders < len(data))])
    joined = borders[(flag[borders] == 1) & (flag[borders + 1] == 1)]
    if len(joined):
        starts, ends = np.sort(np.concatenate([starts, joined])), np.sort(np.concatenate([ends, joined]))
    counts = np.diff(np.searchsorted(starts, offsets))
    return data, starts, ends, counts


def word_hashes(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
    """(hash of each word, words per row)."""
    data, starts, ends, counts = find_words(data, offsets, inside)
    return Hasher.get().spans(data, starts, ends), counts


# ------------------------------------------------- counts in a table of fixed size

def summed_counts(df: DataFrame, counter, slots: int, names: list[str], per_row: int = 1 << 14) -> dict[str, np.ndarray]:
    """Counts over all rows in tables of a fixed number of slots.

    counter(batches) yields {name: int64 array of slots} for a partition's batches.  Each
    task sends its sums as slots / per_row blocks, which are added up block by block; the
    result has len(names) * slots numbers whatever the size of df.
    """
    index = {n: i for i, n in enumerate(names)}

    def count(batches):
        total = {}
        for name, array in (x for found in counter(batches) for x in found.items()):
            if name in total:
                total[name] += array
            else:
                total[name] = array.astype(np.int64)
        rows = [
            (index[name] * (slots // per_row) + i, block.astype("<i8").tobytes())
            for name, array in total.items()
            for i, block in enumerate(array.reshape(-1, per_row))
            if block.any()
        ]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], ["block", "counts"]
            )

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, b in zip(batch.column(0).to_pylist(), batch.column(1)):
                block = np.frombuffer(b.as_buffer(), "<i8")
                total[k] = total[k] + block if k in total else block
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.int32()), pa.array([v.astype("<i8").tobytes() for v in total.values()], pa.binary())],
                ["block", "counts"],
            )

    schema = "block int, counts binary"
    sums = df.mapInArrow(tidy(count), schema).repartition(shuffles(df.sparkSession), "block").mapInArrow(tidy(add), schema)
    out = {n: np.zeros(slots, np.int64) for n in names}
    with _settings(df.sparkSession):
        found = sums.collect()
    for row in found:
        name, i = names[row["block"] // (slots // per_row)], row["block"] % (slots // per_row)
        out[name][i * per_row : (i + 1) * per_row] = np.frombuffer(row["counts"], "<i8")
    return out
