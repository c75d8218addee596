"""Fingerprint datasets: Parquet laid out by popcount, with their configuration beside it.

A dataset is a folder with _fingerprints.json (type, parameters, versions, words, and the
names of the data folders that make it up) and those folders.  Rows lie in ranges of popcount,
sorted inside each file, so a popcount range reads few row groups.  Every change writes a new
data folder and then puts a new _fingerprints.json in place: a change that fails on the way
leaves the dataset as it was, and readers see it before or after.  One writer at a time.
"""

from __future__ import annotations

import json
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievefp import __version__, paths
from sievefp.sources import featurize

_CONFIG = "_fingerprints.json"


def read_config(spark: SparkSession, path: str) -> dict:
    place = f"{path}/{_CONFIG}"
    if not paths.exists(spark, place):
        raise ValueError(f"{path} is not a fingerprint dataset")
    return json.loads(paths.read_text(spark, place))


def write_config(spark: SparkSession, path: str, config: dict) -> None:
    paths.write_text(spark, f"{path}/{_CONFIG}", json.dumps(config, indent=1))


def make_config(fp_type: str, params: dict, words: int) -> dict:
    return {"fp_type": fp_type, "fp_params": dict(params), "rdkit_version": featurize.chemistry_version(), "version": __version__, "words": words}


def _settings(config: dict) -> dict:
    return {k: v for k, v in config.items() if k != "data"}


def by_popcount(fps: DataFrame) -> DataFrame:
    return fps.select("mol_id", "words", "popcnt").repartitionByRange("popcnt", "mol_id").sortWithinPartitions("popcnt", "mol_id")


def _add(fps: DataFrame, path: str, config: dict, name: str | None = None) -> dict:
    """Writes rows as one more data folder of config; nothing reads it yet."""
    name = name or f"data-{uuid.uuid4().hex}"
    fps.select("mol_id", "words", "popcnt").write.mode("overwrite").parquet(f"{path}/{name}")
    return config | {"data": [*config.get("data", []), name]}


def create(fps: DataFrame, path: str, config: dict, sort_by_popcount: bool = True) -> None:
    """Writes a new dataset of fingerprints."""
    spark = fps.sparkSession
    if paths.exists(spark, f"{path}/{_CONFIG}"):
        raise FileExistsError(path)
    write_config(spark, path, _add(by_popcount(fps) if sort_by_popcount else fps, path, _settings(config)))


def create_from_molecules(spark: SparkSession, source, path: str, fp_type: str, fp_params: dict | None = None, mol_format: str | None = None, id_property: str = "mol_id", sort_by_popcount: bool = True, full_sanitization: bool = True) -> None:
    """Fingerprints of a molecule source as a new dataset; fp_params is not changed."""
    from sievefp.sources import molecules

    params = featurize.with_defaults(fp_type, fp_params)
    mols = molecules.molecules(spark, source, mol_format, id_property)
    fps = featurize.molecules(mols, fp_type, params, mol_format if mol_format != "rdkit" else "molfile", full_sanitization)
    create(fps, path, make_config(fp_type, params, featurize.words_of(fp_type, params)), sort_by_popcount)


def load(spark: SparkSession, path: str) -> DataFrame:
    folders = [f"{path}/{name}" for name in read_config(spark, path)["data"]]
    return spark.read.schema(featurize.SCHEMA).parquet(*folders)


def _replace(spark: SparkSession, path: str, fps: DataFrame, config: dict) -> None:
    """Makes fps the only data folder; the others go once the new configuration is in place."""
    before = config["data"]
    write_config(spark, path, _add(fps, path, _settings(config)))
    for name in before:
        paths.remove(spark, f"{path}/{name}")


def sort(spark: SparkSession, path: str) -> None:
    """Lays the rows out by popcount anew and records the present versions."""
    config = read_config(spark, path)
    _replace(spark, path, by_popcount(load(spark, path)), config | {"version": __version__, "rdkit_version": featurize.chemistry_version()})


def append(fps: DataFrame, path: str, name: str | None = None) -> None:
    """Adds rows as a new data folder; searches need no sort afterwards.  A folder of a name
    that the dataset has already is not added again."""
    config = read_config(fps.sparkSession, path)
    if name is None or name not in config["data"]:
        write_config(fps.sparkSession, path, _add(fps, path, config, name))


def delete(spark: SparkSession, path: str, ids) -> None:
    """Removes every row with one of the ids (a list, or a DataFrame with mol_id); ids that
    the dataset lacks are ignored."""
    gone = ids if isinstance(ids, DataFrame) else spark.createDataFrame([(int(i),) for i in ids], "mol_id long")
    left = load(spark, path).join(gone.select("mol_id").distinct(), "mol_id", "left_anti")
    _replace(spark, path, by_popcount(left), read_config(spark, path))


def merge(spark: SparkSession, inputs: list[str], path: str, sort_by_popcount: bool = True) -> None:
    """All rows of two or more datasets of the same configuration; ids are not compared."""
    if len(inputs) < 2:
        raise ValueError("at least two datasets are needed")
    configs = [_settings(read_config(spark, p)) for p in inputs]
    if any(c != configs[0] for c in configs):
        raise ValueError("the datasets have different configurations")
    fps = load(spark, inputs[0])
    for other in inputs[1:]:
        fps = fps.unionByName(load(spark, other))
    create(fps, path, configs[0], sort_by_popcount)


def migrate(spark: SparkSession, old: str, new: str) -> None:
    """A copy whose parameters say fpSize where older ones said nBits."""
    config = read_config(spark, old)
    params = {("fpSize" if k == "nBits" else k): v for k, v in config["fp_params"].items()}
    create(load(spark, old), new, config | {"fp_params": params, "version": __version__})


def popcount_bins(fps: DataFrame) -> DataFrame:
    """popcnt, start, end: the rows [start, end) that each popcount takes in popcount order."""
    counts = fps.groupBy("popcnt").agg(F.count("*").alias("n"))
    until = F.sum("n").over(Window.orderBy("popcnt"))  # one row for each popcount
    return counts.select("popcnt", (until - F.col("n")).alias("start"), until.alias("end"))


# ------------------------------------------------------------------------ JDBC


def write_jdbc(fps: DataFrame, url: str, table: str, config: dict, properties: dict | None = None) -> None:
    """Creates a table mol_id, fp_0.., popcnt or adds rows to it, 64 000 at a time.

    The configuration goes to a table of one row, named like the table with _config; rows are
    added only to a table of the same configuration."""
    spark = fps.sparkSession
    known = jdbc_config(spark, url, table, properties)
    if known is None:
        rows = spark.createDataFrame([(json.dumps(_settings(config)),)], "config string")
        rows.write.option("createTableColumnTypes", "config VARCHAR(4000)").jdbc(url, f"{table}_config", properties=properties or {})
    elif known != _settings(config):
        raise ValueError(f"{table} has another configuration")
    wide = fps.select("mol_id", *[F.get("words", F.lit(i)).alias(f"fp_{i}") for i in range(config["words"])], F.col("popcnt").cast("long").alias("popcnt"))
    wide.write.mode("append").option("batchsize", 64_000).jdbc(url, table, properties=properties or {})


def jdbc_config(spark: SparkSession, url: str, table: str, properties: dict | None = None) -> dict | None:
    """The configuration stored with a table; None where there is none."""
    try:
        row = spark.read.jdbc(url, f"{table}_config", properties=properties or {}).first()
    except Exception as failed:  # each database has its own error for a table that is not there
        if "config" in str(failed).lower():
            return None
        raise
    return json.loads(row[0])


def jdbc_ids(spark: SparkSession, url: str, table: str, properties: dict | None = None) -> tuple[int, int] | None:
    """(least, greatest) mol_id of a table, found by the database; None if it is empty.  Rows
    with greater ids are what an incremental load adds."""
    column = spark.sparkContext._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier("mol_id")
    row = spark.read.jdbc(url, f"(SELECT MIN({column}) AS low, MAX({column}) AS high FROM {table}) ids", properties=properties or {}).first()
    return None if row[0] is None else (int(row[0]), int(row[1]))


def read_jdbc(spark: SparkSession, url: str, table: str, words: int, bounds: tuple[int, int] | None = None, partitions: int | None = None, schema: str | None = None, properties: dict | None = None) -> DataFrame:
    """A table of write_jdbc, read in ranges of mol_id: from bounds, or from what the database
    says, in as many parts as there are cores."""
    reader = spark.read.option("fetchsize", 64_000)
    name = f"{schema}.{table}" if schema else table
    low, high = bounds or jdbc_ids(spark, url, name, properties) or (0, 0)
    parts = max(1, min(partitions or spark.sparkContext.defaultParallelism, high - low + 1))
    wide = reader.jdbc(url, name, column="mol_id", lowerBound=low, upperBound=high + 1, numPartitions=parts, properties=properties or {})
    columns = {c.lower(): c for c in wide.columns}
    of = lambda c: F.col(columns[c])
    return wide.select(of("mol_id").cast("long").alias("mol_id"), F.array(*[of(f"fp_{i}").cast("long") for i in range(words)]).alias("words"), of("popcnt").cast("int").alias("popcnt"))


def check_versions(config: dict) -> None:
    featurize.warn_if_other_version(config.get("rdkit_version"))
    if config.get("version") != __version__:
        warnings.warn(f"the dataset was written by version {config.get('version')}", stacklevel=2)
