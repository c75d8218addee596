"""Searches against published values, brute force and edge cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievefp.engine import FingerprintEngine
from sievefp.functions import bits, metrics, sql
from sievefp.operators import isim, search, tiles
from sievefp.plans.bounds import partner_limit, popcount_range
from sievefp.sources import featurize, store

# Popcounts and common bits of ten molecules' fingerprints (Morgan, 2048 bits).
POPCOUNTS = [35, 39, 40, 42, 43, 43, 45, 46, 47, 48]
COMMON = """35 4 25 30 24 30 28 30 28 29
4 39 5 7 6 5 7 6 5 5
25 5 40 29 27 33 34 29 36 35
30 7 29 42 27 38 37 38 34 34
24 6 27 27 43 32 29 27 28 26
30 5 33 38 32 43 37 38 36 36
28 7 34 37 29 37 45 35 39 35
30 6 29 38 27 38 35 46 34 34
28 5 36 34 28 36 39 34 47 37
29 5 35 34 26 36 35 34 37 48"""
# Set bits of one of them.
ON = [9, 43, 48, 67, 81, 233, 277, 314, 340, 352, 366, 378, 561, 564, 650, 758, 807, 849, 875, 935, 949, 974, 1057, 1058, 1088, 1114, 1199, 1200, 1237, 1283, 1363, 1380, 1391, 1447, 1535, 1683, 1697, 1722, 1745, 1750, 1825, 1852, 1873, 1917, 1991]


def table(spark, rows):
    """rows: (id, positions) of 128 bits."""
    made = [(i, bits.pack_positions(p, 128), len(set(p))) for i, p in rows]
    return spark.createDataFrame(made, featurize.SCHEMA)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    base = [sorted(r.sample(range(128), r.randrange(1, 60))) for _ in range(50)]
    base += [sorted(set(b) ^ {r.randrange(128), 0}) for b in base[:30]]
    return [(i, b) for i, b in enumerate(base)] + [(900, []), (901, [0, 64, 127]), (902, [0, 64, 127])]


@pytest.fixture(scope="module")
def fps(spark, rows):
    return table(spark, rows).cache()


def coeff(metric, p, q, a=0.0, b=0.0):
    c, x, y = len(set(p) & set(q)), len(set(p)), len(set(q))
    under = {"tanimoto": x + y - c, "dice": (x + y) / 2, "cosine": math.sqrt(x * y)}[metric]
    return np.float32(c / under) if under else None


@pytest.mark.parametrize("metric,row,best", [
    ("tanimoto", 0, [1.0, 0.63829786, 0.625, 0.5882353, 0.53846157]),
    ("cosine", 0, [1.0, 0.782461, 0.773309, 0.747667, 0.707528]),
    ("dice", 0, [1.0, 0.7792208, 0.7692308, 0.7407407, 0.7]),
    ("tanimoto", 6, [1.0, 0.73584908, 0.74, 0.72549021]),
])
def test_published_coefficients(spark, metric, row, best):
    shared = [int(x) for x in COMMON.split("\n")[row].split()]
    df = spark.createDataFrame(list(zip(shared, POPCOUNTS)), "c int, d int")
    got = [r[0] for r in df.select(metrics.coefficient(metric, F.col("c"), F.lit(POPCOUNTS[row]), F.col("d")).alias("x")).orderBy(F.desc("x")).limit(len(best)).collect()]
    assert np.allclose(got, sorted(best, reverse=True), rtol=1e-6)


def test_published_tversky(spark):
    df = spark.createDataFrame(list(zip([int(x) for x in COMMON.split("\n")[6].split()], POPCOUNTS)), "c int, d int")
    got = sorted((r[0] for r in df.select(metrics.tversky(F.col("c"), F.lit(45), F.col("d"), 0.5, 0.5)).collect()), reverse=True)
    assert got[0] == 1.0 and math.isclose(got[1], 0.85057473, rel_tol=1e-6)


def test_published_fingerprint(spark):
    words = bits.pack_positions(ON, 2048)
    assert -9223371899415822336 in words
    df = spark.createDataFrame([(words,)], "w array<long>").select(bits.popcount(F.col("w")).alias("n"), bits.on_bits(F.col("w")).alias("on"), bits.pack(bits.on_bits(F.col("w")), 32).alias("again"))
    row = df.first()
    assert (row.n, row.on, row.again) == (45, ON, words)


def test_pack_string_aligns_a_short_piece_right():
    assert bits.pack_string("1" + "0" * 63 + "01") == [-(1 << 63), 1]


@pytest.mark.parametrize("metric", metrics.SYMMETRIC)
@pytest.mark.parametrize("threshold", [0.0, 0.3, 0.7, 1.0])
def test_similarity_is_brute_force(fps, rows, metric, threshold):
    query = rows[0][1]
    want = {(i, float(c)) for i, p in rows if (c := coeff(metric, query, p)) is not None and c >= np.float32(threshold)}
    got = [(r.mol_id, r.coeff) for r in search.similarity(fps, bits.pack_positions(query, 128), threshold, metric).collect()]
    assert set(got) == want and got == sorted(got, key=lambda r: (-r[1], r[0]))


def test_top_k_and_its_limits(fps, rows):
    words = bits.pack_positions(rows[0][1], 128)
    every = search.similarity(fps, words, 0.2).collect()
    assert search.top_k(fps, words, 3, 0.2).collect() == every[:3]
    assert search.top_k(fps, words, 0, 0.2).collect() == every
    assert search.similarity(fps, words, 1.01).count() == 0
    assert search.device_similarity(fps, words, 0.0).filter("coeff = 0").count() == 0


def test_empty_query(fps):
    assert search.similarity(fps, [0, 0], 0.5).count() == 0
    assert search.substructure(fps, [0, 0]).count() == 0


def test_substructure(fps, rows):
    query = [0, 64]
    got = {r.mol_id for r in search.substructure(fps, bits.pack_positions(query, 128)).collect()}
    assert got == {i for i, p in rows if set(query) <= set(p)} and {901, 902} <= got


def test_bounds_lose_nothing():
    for kind, a, b in (("tanimoto", 0, 0), ("dice", 0, 0), ("cosine", 0, 0), ("tversky", 0.3, 0.9), ("tversky", 1.0, 0.0)):
        for q in range(1, 20):
            for t in (0.1, 0.5, 0.9):
                found = popcount_range(kind, q, t, 64, a, b)
                for d in range(1, 65):
                    c = min(q, d)
                    best = {"tanimoto": c / (q + d - c), "dice": 2 * c / (q + d), "cosine": c / math.sqrt(q * d), "tversky": c / ((c + a * (q - c) + b * (d - c)) or 1)}[kind]
                    if best >= t + 1e-9:  # at a tie in exact arithmetic the last bit decides
                        assert found and found[0] <= d <= found[1]
    assert popcount_range("tanimoto", 35, 1.1, 64) is None
    assert partner_limit("tanimoto", 0, 0.5, 64) == -1


@pytest.mark.parametrize("metric", metrics.SYMMETRIC)
@pytest.mark.parametrize("threshold", [0.0, 0.4, 1.0])
def test_matrix_is_brute_force(fps, rows, metric, threshold):
    want = {(i, j) for i, p in rows for j, q in rows if i != j and (c := coeff(metric, p, q)) is not None and c >= np.float32(threshold)}
    got = search.distance_matrix(fps, threshold, metric, 2).collect()
    assert {(r.i, r.j) for r in got} == want and len(got) == len(want)
    positions = dict(rows)
    assert all(r.dist == np.float32(1) - coeff(metric, positions[r.i], positions[r.j]) for r in got)


@pytest.mark.parametrize("metric", metrics.SYMMETRIC)
def test_tiles_of_any_size_find_the_same(fps, metric):
    same = lambda df: sorted(map(tuple, df.collect()))
    unordered = lambda df: same(df.select(F.least("i", "j"), F.greatest("i", "j"), "coeff"))
    assert unordered(tiles.half_matrix(fps, 0.4, metric, 128, tile=7)) == unordered(tiles.half_matrix(fps, 0.4, metric, 128))
    asked = fps.filter("mol_id % 20 = 0").select(F.col("mol_id").alias("query_id"), "words", "popcnt")
    whole = search.batch_similarity(fps, asked, 0.4, metric, 2)
    assert same(tiles.best_matches(fps, asked, None, 0.4, metric, 128, tile=7)) == same(whole)
    assert set(same(search.batch_top_k(fps, asked, 2, 0.4, metric, 2).drop("rank"))) <= set(same(whole))


def test_a_block_meets_itself_whatever_the_order_of_its_copies():
    import pyarrow as pa

    r = np.random.default_rng(3)
    words, ids = r.integers(0, 1 << 63, 60), np.arange(60)
    pops = np.array([int(w).bit_count() for w in words])
    copy = lambda order: [pa.scalar(x[order].astype(kind).tobytes()) for x, kind in ((ids, "<i8"), (pops, "<i4"), (words, "<i8"))]
    rows = [(False, 5, None, *copy(ids)), (True, 5, 5, *copy(ids[::-1]))]
    kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    batch = pa.RecordBatch.from_arrays([pa.array([x.as_py() if isinstance(x, pa.Scalar) else x for x in c], k) for c, k in zip(zip(*rows), kinds)], list("oabipw"))

    def found(x, y, same):
        for i, j, _ in tiles._found(x, y, "dice", same):
            yield from zip(x.ids[i].tolist(), y.ids[j].tolist())

    got = list(tiles._visit("dice", 0.5, found, True)([batch]))
    want = {(i, j) for i in range(60) for j in range(i) if 4 * int(words[i] & words[j]).bit_count() >= pops[i] + pops[j]}
    assert len(got) == len(want) and {(max(p), min(p)) for p in got} == want


def test_matrix_takes_few_bytes_a_pair(spark, tmp_path):
    words = [int(w) for w in np.random.default_rng(4).integers(-(1 << 63), 1 << 63, 1500)]
    df = spark.createDataFrame([(i, [w], (w & (1 << 64) - 1).bit_count()) for i, w in enumerate(words)], featurize.SCHEMA)
    search.distance_matrix(df, 0.5, "cosine").write.parquet(str(tmp_path / "matrix"))
    n = spark.read.parquet(str(tmp_path / "matrix")).count()
    assert n > 1_000_000 and sum(f.stat().st_size for f in (tmp_path / "matrix").glob("*.parquet")) < 2.5 * n


def test_partitions_of_panels_do_not_grow_with_the_table(spark, monkeypatch):
    df = table(spark, [(i, [i % 50, 60 + i % 7, 70 + i % 11]) for i in range(400)])
    asked = df.select(F.col("mol_id").alias("query_id"), "words", "popcnt")
    monkeypatch.setattr(tiles, "_PART_MB", 0.01, raising=False)
    parts = tiles.best_matches(df, asked, None, 0.9, "tanimoto", 128, tile=20).rdd.getNumPartitions()
    assert parts >= 400 // 20 * 400 // 20 * 20 * 28 // 10_000 > 4


def test_strips_cut_a_common_popcount():
    assert tiles.strips({1: 3, 2: 4, 3: 100, 5: 1}, 8) == [(1, 2, 1), (3, 3, 13), (5, 5, 1)]


def test_batch_equals_single_searches(fps, rows):
    asked = fps.filter("mol_id < 5").select(F.col("mol_id").alias("query_id"), "words", "popcnt")
    got = search.batch_top_k(fps, asked, 3, 0.3, words=2).collect()
    for i in range(5):
        one = search.top_k(fps, bits.pack_positions(rows[i][1], 128), 3, 0.3).collect()
        assert sorted((r.rank, r.mol_id) for r in got if r.query_id == i) == [(k + 1, r.mol_id) for k, r in enumerate(one)]


@pytest.mark.parametrize("metric", metrics.SYMMETRIC)
def test_best_matches_give_k_a_panel(spark, metric):
    """Many ties, copies of one row, empty rows, and blocks smaller than k."""
    r = random.Random(9)
    some = [(i, r.sample(range(128), r.randrange(0, 6))) for i in range(240)] + [(i, [1, 2, 3]) for i in range(240, 300)]
    df = table(spark, some)
    asked = df.filter("mol_id % 5 = 0").select(F.col("mol_id").alias("query_id"), "words", "popcnt")
    for threshold, k in ((0.0, 4), (0.5, 2)):
        got = {}
        found = tiles.best_matches(df, asked, k, threshold, metric, 128, tile=9).collect()
        for x in found:
            got.setdefault(x.query_id, []).append((-x.coeff, x.mol_id))
        for i, p in some[::5]:
            every = sorted((-float(c), j) for j, q in some if (c := coeff(metric, p, q)) is not None and c >= np.float32(threshold))
            assert sorted(got.get(i, []))[:k] == every[:k]
        assert max(len(x) for x in got.values()) <= k * 300 // 9 // 3  # not k a block: some partners share a panel


def test_k_best_ask_more_of_later_blocks():
    r = np.random.default_rng(6)
    words = r.integers(0, 1 << 63, 3000)
    pops = np.array([int(w).bit_count() for w in words], "<i4")
    block = lambda a, b, left: tiles._Block(np.arange(a, b).astype("<i8").tobytes(), pops[a:b].tobytes(), words[a:b].astype("<i8").tobytes(), "tanimoto", 0.0, left)
    x, computed = block(0, 500, True), []
    for start in range(0, 3000, 1000):
        y = block(start, start + 1000, False)
        tiles._keep(x, y, "tanimoto", 0.0, 3)
        computed.append(sum(len(c) for _, _, c in tiles._found(x, y, "tanimoto", False)))
    assert sum(computed) < 0.05 * 500 * 3000 and len(x.best[0]) == 1500


@pytest.mark.parametrize("index", ["RR", "JT", "SM"])
def test_complementary_is_dense(spark, index):
    r = np.random.default_rng(1)
    dense = (r.random((12, 128)) < 0.3).astype(int)
    df = table(spark, [(i, np.flatnonzero(x).tolist()) for i, x in enumerate(dense)])

    def value(x):
        n, c = len(x), x.sum(0)
        a, d, dis = (c * (c - 1) / 2).sum(), ((n - c) * (n - c - 1) / 2).sum(), (c * (n - c)).sum()
        return {"RR": a / (a + d + dis), "JT": a / (a + dis), "SM": (a + d) / (a + d + dis)}[index]

    want = {i: value(np.delete(dense, i, 0)) for i in range(12)}
    got = {x.mol_id: x["index"] for x in isim.complementary(df, 2, index).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i]) for i in want)
    assert isim.medoid(df, 2, index).first()[0] == min(want, key=want.get)
    assert isim.outlier(df, 2, index).first()[0] == max(want, key=want.get)
    whole = isim.set_similarity(df, 2).first()
    assert math.isclose(whole[index.lower()], value(dense))


def test_degenerate_sets(spark):
    assert [r["index"] for r in isim.complementary(table(spark, [(1, [3]), (2, [])]), 2).collect()] == [None, None]
    assert isim.counters(table(spark, [(1, []), (2, [])]), 2).first().d == 128.0
    assert isim.complementary(table(spark, []), 2).count() == 0


def test_engine(spark, fps, rows, tmp_path):
    config = store.make_config("bits", {"fpSize": 128}, 2)
    engine = FingerprintEngine(spark, fps=fps, config=config)
    words = engine.query_of(0)
    path = str(tmp_path / "saved")
    engine.save(path)
    disk = FingerprintEngine(spark, path, in_memory=False)
    assert disk.on_disk_similarity(words, 0.4).collect() == engine.similarity(words, 0.4).collect()
    assert disk.on_disk_tversky(words, 0.4, 0.5, 0.5).collect() == engine.tversky(words, 0.4, 0.5, 0.5).collect()
    assert engine.fp_type == "bits" and engine.fp_params == {"fpSize": 128} and "bits" in str(engine)
    with pytest.raises(ValueError):
        disk.fps
    with pytest.raises(ValueError):
        engine.similarity([1], 0.5)
    with pytest.raises(ValueError):
        engine.similarity(words, 0.5, "euclid")
    with pytest.raises(KeyError):
        engine.query_of(12345)
    with pytest.raises(ValueError):
        FingerprintEngine(spark)


def test_plan_pushes_popcount_down(spark, fps, tmp_path):
    path = str(tmp_path / "pushed")
    store.create(fps, path, store.make_config("bits", {"fpSize": 128}, 2))
    plan = search.similarity(store.load(spark, path), [255, 0], 0.7)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(popcnt" in plan and "LessThanOrEqual(popcnt" in plan and "Python" not in plan


def test_sql_functions(spark, fps):
    sql.register(spark)
    fps.createOrReplaceTempView("test_fps")
    row = spark.sql("SELECT fp_popcount(words) n, fp_common(words, words) c, fp_contains(words, words) h FROM test_fps WHERE mol_id = 901").first()
    assert tuple(row) == (3, 3, True)
    assert [r[0] for r in spark.sql("SELECT bit FROM fp_bits(array(1L, -9223372036854775808L)) ORDER BY bit").collect()] == [63, 64]
