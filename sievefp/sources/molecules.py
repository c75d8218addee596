"""Molecule sources: SMILES files, SD files and rows, all as (mol_id LONG, mol STRING)."""

from __future__ import annotations

import itertools
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievefp import paths


def smiles_file(spark: SparkSession, path: str) -> DataFrame:
    """Lines "SMILES id", split at the last white space; compressed files are read as such.

    Lines without two fields are skipped; an id that is no integer fails the job."""
    lines = spark.read.text(path).filter(F.col("value").rlike(r"\S\s+\S"))
    field = lambda n: F.regexp_extract("value", r"^\s*(.*\S)\s+(\S+)\s*$", n)
    number = F.when(field(2).rlike(r"^[+-]?\d+$"), field(2).cast("long")).otherwise(F.raise_error(F.concat(F.lit("the molecule id is not an integer: "), field(2))).cast("long"))
    return lines.select(number.alias("mol_id"), field(1).alias("mol"))


def sd_file(spark: SparkSession, path: str, id_property: str = "mol_id") -> DataFrame:
    """Records of an SD file; the id stands under the property's header line.

    A record without the property, or with one that is no integer, fails the job."""
    records = spark.read.option("lineSep", "$$$$").text(path).filter(F.col("value").rlike(r"\S"))
    body = F.regexp_replace(F.regexp_replace("value", r"\r\n", "\n"), r"^\n", "")
    quoted = "".join(f"\\{c}" if not c.isalnum() and c != "_" else c for c in id_property)
    found = F.regexp_extract(body, rf"(?m)^> .*<{quoted}>[^\n]*\n([^\n]*)", 1)
    number = F.when(found.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(found).cast("long")).otherwise(F.raise_error(F.lit(f"a record lacks an integer {id_property}")).cast("long"))
    block = F.concat(F.regexp_extract(body, r"(?s)^(.*?)M  END", 1), F.lit("M  END\n"))
    return records.select(number.alias("mol_id"), block.alias("mol"))


def rows(spark: SparkSession, source: Iterable, format: str = "smiles", at_once: int = 100_000) -> DataFrame:
    """An iterable of (mol, id): text, or rdkit molecules with format "rdkit".

    The driver holds at most ``at_once`` rows; more go to the shared folder as they come."""
    if format not in ("smiles", "inchi", "molfile", "rdkit"):
        raise ValueError(f"{format} is not a molecule format")
    if format == "rdkit":
        from rdkit import Chem

        source = ((Chem.MolToMolBlock(m), i) for m, i in source)
    left, path = iter(source), None
    while True:
        some = [(int(i), m) for m, i in itertools.islice(left, at_once)]
        df = spark.createDataFrame(some, "mol_id long, mol string")
        if path is None and len(some) < at_once:
            return df
        path = path or paths.scratch(spark, "molecules")
        df.write.mode("append").parquet(path)
        if len(some) < at_once:
            return spark.read.schema(df.schema).parquet(path)


def molecules(spark: SparkSession, source, format: str | None = None, id_property: str = "mol_id") -> DataFrame:
    """(mol_id, mol) of a path (by its extension), a DataFrame or an iterable."""
    if isinstance(source, DataFrame):
        return source.select(F.col("mol_id").cast("long").alias("mol_id"), "mol")
    if isinstance(source, str):
        name = source.lower()
        for packed in (".gz", ".bz2", ".zst"):
            name = name.removesuffix(packed)
        if name.endswith((".smi", ".smiles")):
            return smiles_file(spark, source)
        if name.endswith(".sdf"):
            return sd_file(spark, source, id_property)
        raise ValueError(f"no reader for {source}")
    if isinstance(source, Iterable):
        return rows(spark, source, format or "smiles")
    raise ValueError("a path, a DataFrame or an iterable of (molecule, id) is needed")
