"""Sources, datasets, streams and the command line."""

import gzip

import pytest
from pyspark.sql import functions as F

from sievefp import cli
from sievefp.functions import bits
from sievefp.sources import featurize, molecules, store
from sievefp.streaming import ingest

SD = "first\n  x\n\n  0  0  0     0  0            999 V2000\nM  END\n>  <mol_id>  (1) \n7\n\n>  <other>\nx\n\n$$$$\nsecond\n  x\n\n  0  0  0     0  0            999 V2000\nM  END\n>  <mol_id>\n8\n\n$$$$\n"


def fps(spark, ids):
    return spark.createDataFrame([(i, [i * 7919 % 251, -i], 0) for i in ids], featurize.SCHEMA).withColumn("popcnt", bits.popcount(F.col("words")))


def config():
    return store.make_config("bits", {"fpSize": 128}, 2)


def ids(df):
    return sorted(r.mol_id for r in df.collect())


def test_smiles_file(spark, tmp_path):
    for name, open_ in (("a.smi", open), ("b.smi.gz", gzip.open)):
        with open_(tmp_path / name, "wt") as out:
            out.write("CC 1\nC C(=O)\t2\nlonely\n\nO  3  \n")
        got = molecules.molecules(spark, str(tmp_path / name)).collect()
        assert sorted(map(tuple, got)) == [(1, "CC"), (2, "C C(=O)"), (3, "O")]


def test_smiles_with_a_bad_id(spark, tmp_path):
    (tmp_path / "bad.smi").write_text("CC one\n")
    with pytest.raises(Exception, match="not an integer"):
        molecules.molecules(spark, str(tmp_path / "bad.smi")).collect()


def test_sd_file(spark, tmp_path):
    (tmp_path / "a.sdf").write_text(SD)
    got = molecules.molecules(spark, str(tmp_path / "a.sdf")).orderBy("mol_id").collect()
    assert [r.mol_id for r in got] == [7, 8]
    assert got[0].mol.startswith("first\n") and got[1].mol.startswith("second\n") and got[1].mol.endswith("M  END\n")
    with pytest.raises(Exception, match="lacks an integer"):
        molecules.sd_file(spark, str(tmp_path / "a.sdf"), "absent").collect()


def test_other_sources(spark):
    assert ids(molecules.molecules(spark, [["CC", 1], ["CCC", 2]])) == [1, 2]
    for bad in (3, "x.xyz"):
        with pytest.raises(ValueError):
            molecules.molecules(spark, bad)
    with pytest.raises(ValueError):
        molecules.rows(spark, [], "mol2")
    assert featurize.molecule_format("InChI=1S/CH4/h1H4") == "inchi"
    assert featurize.molecule_format("x\n\n\n 1 V3000\nM  END") == "molfile"
    assert featurize.molecule_format("CCO") == "smiles"


def test_parameters():
    given = {"radius": 2}
    made = featurize.with_defaults("Morgan", given)
    assert made["radius"] == 2 and made["fpSize"] == 2048 and given == {"radius": 2}
    assert "includeRedundantEnvironments" in made and list(featurize.DEFAULTS["TopologicalTorsion"]) == ["fpSize", "includeChirality", "torsionAtomCount", "countSimulation"]
    assert featurize.words_of("MACCSKeys", {}) == 3
    with pytest.raises(ValueError):
        featurize.with_defaults("Other", {})
    with pytest.raises(ValueError):
        featurize.width("Morgan", {})


def test_lifecycle(spark, tmp_path):
    path = str(tmp_path / "set")
    store.create(fps(spark, [5, 3, 9]), path, config(), sort_by_popcount=False)
    with pytest.raises(FileExistsError):
        store.create(fps(spark, [1]), path, config())
    store.append(fps(spark, [11, 12, 12]), path)
    assert ids(store.load(spark, path)) == [3, 5, 9, 11, 12, 12]
    store.sort(spark, path)
    store.delete(spark, path, [12, 999])
    assert ids(store.load(spark, path)) == [3, 5, 9, 11]
    assert store.read_config(spark, path)["fp_params"] == {"fpSize": 128}
    bins = store.popcount_bins(store.load(spark, path)).orderBy("popcnt").collect()
    assert bins[0].start == 0 and bins[-1].end == 4 and all(a.end == b.start for a, b in zip(bins, bins[1:]))
    with pytest.raises(ValueError):
        store.read_config(spark, str(tmp_path))


@pytest.mark.parametrize("change", [store.sort, lambda s, p: store.delete(s, p, [3]), lambda s, p: store.append(fps(s, [9]), p)])
@pytest.mark.parametrize("step", ["write_config", "remove"])
def test_a_change_that_fails_loses_nothing(spark, tmp_path, monkeypatch, change, step):
    path = str(tmp_path / "set")
    store.create(fps(spark, [5, 3]), path, config())

    def fail(*_):
        raise OSError("the driver died")

    before = ids(store.load(spark, path))
    if step == "write_config":
        monkeypatch.setattr(store, "write_config", fail)
        with pytest.raises(OSError):
            change(spark, path)
        assert ids(store.load(spark, path)) == before
    else:
        monkeypatch.setattr(store.paths, "remove", fail)
        try:
            change(spark, path)
        except OSError:
            pass
        assert set(ids(store.load(spark, path))) in ({3, 5}, {5}, {3, 5, 9})
    monkeypatch.undo()
    change(spark, path)
    assert 5 in ids(store.load(spark, path))


def test_jdbc(spark):
    from sievefp.engine import FingerprintEngine

    url, driver = "jdbc:derby:memory:fps;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    assert store.jdbc_config(spark, url, "mols", driver) is None
    store.write_jdbc(fps(spark, [5, 3, -9]), url, "mols", config(), driver)
    store.write_jdbc(fps(spark, [70]), url, "mols", config(), driver)
    assert store.jdbc_config(spark, url, "mols", driver) == config() and store.jdbc_ids(spark, url, "mols", driver) == (-9, 70)
    with pytest.raises(ValueError, match="another configuration"):
        store.write_jdbc(fps(spark, [1]), url, "mols", config() | {"fp_type": "other"}, driver)
    back = store.read_jdbc(spark, url, "mols", 2, properties=driver)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, fps(spark, [5, 3, -9, 70]).collect()))
    assert back.rdd.getNumPartitions() > 1
    engine = FingerprintEngine(spark, jdbc={"url": url, "table": "mols", "properties": driver})
    assert engine.similarity(engine.query_of(3), 1.0).first().mol_id == 3 and engine.version and engine.words == 2
    with pytest.raises(ValueError):
        FingerprintEngine(spark, jdbc={"url": url, "table": "absent", "properties": driver})
    with pytest.raises(ValueError):
        FingerprintEngine(spark, jdbc={"url": url, "table": "mols", "properties": driver}, in_memory=False)


def test_versions_are_compared(spark, tmp_path):
    from sievefp.engine import FingerprintEngine

    path = str(tmp_path / "old")
    store.create(fps(spark, [1]), path, config() | {"version": "0.0"})
    with pytest.warns(UserWarning, match="0.0"):
        assert FingerprintEngine(spark, path, in_memory=False).version == "0.0"


def test_many_rows_of_an_iterable(spark):
    got = molecules.rows(spark, ((f"m{i}", i) for i in range(25)), at_once=10)
    assert sorted(map(tuple, got.collect())) == [(i, f"m{i}") for i in range(25)]


def test_merge_and_migrate(spark, tmp_path):
    one, two, both, new = (str(tmp_path / n) for n in ("one", "two", "both", "new"))
    store.create(fps(spark, [1, 2]), one, store.make_config("bits", {"nBits": 128}, 2))
    store.create(fps(spark, [2, 3]), two, store.make_config("bits", {"nBits": 128}, 2))
    store.merge(spark, [one, two], both)
    assert ids(store.load(spark, both)) == [1, 2, 2, 3]
    store.migrate(spark, both, new)
    assert store.read_config(spark, new)["fp_params"] == {"fpSize": 128} and ids(store.load(spark, new)) == [1, 2, 2, 3]
    with pytest.raises(ValueError):
        store.merge(spark, [one], str(tmp_path / "x"))
    with pytest.raises(ValueError):
        store.merge(spark, [one, new], str(tmp_path / "x"))


def test_featurizers(spark):
    df = spark.createDataFrame([(1, [0.5, -0.5] * 32, "b a a", "Red Tin"), (2, None, None, "x")], "id long, v array<float>, t string, p string")
    sign = featurize.sign_bits(df, "id", "v").orderBy("mol_id").collect()
    assert [r.popcnt for r in sign] == [32, 0] and sign[0].words == [bits.signed(0xAAAAAAAAAAAAAAAA)]
    assert [r.popcnt for r in featurize.thermometer(df, id="id", vec="v").orderBy("mol_id").collect()] == [128, 0]
    tokens = featurize.hashed_tokens(df, "id", "t").orderBy("mol_id").collect()
    assert [r.popcnt for r in tokens] == [2, 0] and all(len(r.words) == 32 for r in tokens)
    assert [r.words for r in featurize.keys(df, ["Red", "x"], "id", "p").orderBy("mol_id").collect()] == [[-(1 << 63)], [1 << 62]]


def test_streams(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    store.create(fps(spark, [1]), path, config())
    fps(spark, [2, 3]).write.parquet(source)
    rows = spark.readStream.schema(featurize.SCHEMA).parquet(source)
    ingest.ingest(rows, lambda df: df, path, str(tmp_path / "state")).awaitTermination()
    assert ids(store.load(spark, path)) == [1, 2, 3]
    store.append(fps(spark, [4]), path)
    store.append(fps(spark, [2, 3]), path, store.read_config(spark, path)["data"][1])  # a batch that is done again
    assert ids(store.load(spark, path)) == [1, 2, 3, 4]
    asked = spark.readStream.schema(featurize.SCHEMA).parquet(source).select(F.col("mol_id").alias("query_id"), "words", "popcnt")
    query = ingest.match(asked, fps(spark, [2, 3, 4]), 0.99).writeStream.format("memory").queryName("matched").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert {(r.query_id, r.mol_id) for r in spark.table("matched").collect()} >= {(2, 2), (3, 3)}


def test_command_line():
    args = cli.arguments(["a.smi", "out"])
    assert (args.fp_type, args.fp_params, args.processes) == ("Morgan", {"radius": 2, "fpSize": 256}, 8)


def test_molecules(spark, tmp_path):
    pytest.importorskip("rdkit")
    path = str(tmp_path / "mols")
    store.create_from_molecules(spark, [["CC", 1], ["CCC", 2], ["bad", 3]], path, "Morgan", {"radius": 2}, "smiles")
    assert ids(store.load(spark, path)) == [1, 2]


def test_molecules_need_the_package(spark):
    try:
        import rdkit  # noqa: F401
    except ImportError:
        with pytest.raises(ImportError, match="rdkit"):
            featurize.molecules(molecules.rows(spark, [["CC", 1]]), "Morgan")
