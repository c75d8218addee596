"""Ways to make fingerprints: tables with mol_id LONG, words ARRAY<BIGINT>, popcnt INT."""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from sievefp.functions import bits

SCHEMA = StructType([StructField("mol_id", LongType()), StructField("words", ArrayType(LongType())), StructField("popcnt", IntegerType())])

# Fingerprint types and their default parameters.
DEFAULTS = {
    "MACCSKeys": {},
    "Morgan": {"radius": 3, "fpSize": 2048, "countSimulation": False, "includeChirality": False, "useBondTypes": True, "onlyNonzeroInvariants": False, "includeRingMembership": True, "includeRedundantEnvironments": False},
    "TopologicalTorsion": {"fpSize": 2048, "includeChirality": False, "torsionAtomCount": 4, "countSimulation": True},
    "AtomPair": {"fpSize": 2048, "minDistance": 1, "maxDistance": 30, "includeChirality": False, "use2D": True, "countSimulation": True},
    "RDKit": {"fpSize": 2048, "minPath": 1, "maxPath": 7, "useHs": True, "branchedPaths": True, "useBondOrder": True, "countSimulation": False, "numBitsPerFeature": 2},
    "RDKitPattern": {"fpSize": 2048, "tautomerFingerprints": False},
}
MACCS_BITS = 166


def width(fp_type: str, params: dict) -> int:
    """Bits of a fingerprint; the words are those of the next multiple of 64."""
    if fp_type == "MACCSKeys":
        return MACCS_BITS
    if "fpSize" not in params:
        raise ValueError("fpSize is needed")
    return int(params["fpSize"])


def words_of(fp_type: str, params: dict) -> int:
    return -(-width(fp_type, params) // 64)


def with_defaults(fp_type: str, params: dict | None) -> dict:
    """A new dict: the type's defaults, overridden by params."""
    if fp_type not in DEFAULTS:
        raise ValueError(f"fp_type must be one of {', '.join(DEFAULTS)}")
    return DEFAULTS[fp_type] | (params or {})


def from_positions(df: DataFrame, id: str, positions: Column, words: int) -> DataFrame:
    packed = df.select(F.col(id).cast("long").alias("mol_id"), bits.pack(positions, words).alias("words"))
    return packed.withColumn("popcnt", bits.popcount(F.col("words")))


def sign_bits(df: DataFrame, id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """One bit for each component: set where it is positive."""
    return thermometer(df, (0.0,), id, vec)


def thermometer(df: DataFrame, levels: tuple[float, ...] = (-0.1, 0.0, 0.1, 0.2), id: str = "vec_id", vec: str = "embedding", size: int = 64) -> DataFrame:
    """A bit for each level and component: set where the component is above the level.

    A level's bits fill whole words; its first component is the most significant bit."""
    per_level = -(-size // 64)

    def word(level: float, w: int) -> Column:
        zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
        places = F.sequence(F.lit(64 * w), F.lit(min(64 * w + 64, size) - 1))
        bit = lambda i: F.call_function("shiftleft", one, (F.lit(63) - i % 64).cast("int"))
        return F.aggregate(places, zero, lambda s, i: s.bitwiseOR(F.when(F.get(vec, i).cast("double") > level, bit(i)).otherwise(zero)))

    words = F.array(*[word(level, w) for level in levels for w in range(per_level)])
    packed = df.select(F.col(id).cast("long").alias("mol_id"), words.alias("words"))
    return packed.withColumn("popcnt", bits.popcount(F.col("words")))


def hashed_tokens(df: DataFrame, id: str = "doc_id", text: str = "text", width: int = 2048) -> DataFrame:
    """A bit for each distinct blank-separated token, at the first 16 bits of its MD5 modulo width."""
    packed = df.select(F.col(id).cast("long").alias("mol_id"), _token_packer(width)(F.col(text)).alias("words"))
    return packed.withColumn("popcnt", bits.popcount(F.col("words")))


def _token_packer(width: int):
    import hashlib
    from functools import lru_cache

    import numpy as np
    import pyarrow as pa

    def run(texts):
        place = lru_cache(1 << 18)(lambda t: int.from_bytes(hashlib.md5(t.encode()).digest()[:2], "big") % width)
        for some in texts:
            lists = [list(map(place, {*text.split(" ")} - {""})) if text else [] for text in some.to_pylist()]
            out = np.zeros((len(lists), width), np.uint8)
            out[np.repeat(np.arange(len(lists)), [len(p) for p in lists]), np.array([x for p in lists for x in p], np.int64)] = 1
            words = np.packbits(out, axis=1).view(">i8").astype("<i8")
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1) * (width // 64), pa.int32()), pa.array(words.ravel()))

    run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "array<long>")


def keys(df: DataFrame, patterns: list[str], id: str, text: str) -> DataFrame:
    """A bit for each pattern (RLIKE) that text holds: structural keys."""
    found = F.array(*[F.when(F.col(text).rlike(p), F.lit(i)) for i, p in enumerate(patterns)])
    return from_positions(df, id, F.filter(found, lambda p: p.isNotNull()), -(-len(patterns) // 64))


# ------------------------------------------------------------------- molecules


def molecule_format(text: str) -> str:
    """molfile, inchi or smiles, by what the text looks like."""
    # Fixed value: the end of a molfile's counts line.
    if re.search(r" [vV][23]000$", text, re.MULTILINE):
        return "molfile"
    return "inchi" if text.startswith("InChI=") else "smiles"


def _chemistry():
    try:
        import rdkit
    except ImportError as missing:
        raise ImportError("fingerprints of molecules need the rdkit package") from missing
    return rdkit


def molecule(text: str, format: str | None = None, full_sanitization: bool = True):
    """An rdkit molecule, None if it cannot be parsed; without full sanitization only
    valences are updated and rings found."""
    _chemistry()
    from rdkit import Chem

    format = format or molecule_format(text)
    if format not in ("smiles", "inchi", "molfile"):
        raise ValueError(f"{format} is not a molecule format")
    parse = {"smiles": Chem.MolFromSmiles, "inchi": Chem.MolFromInchi, "molfile": Chem.MolFromMolBlock}[format]
    mol = parse(text, sanitize=full_sanitization)
    if mol is not None and not full_sanitization:
        mol.UpdatePropertyCache(strict=False)
        Chem.FastFindRings(mol)
    return mol


def molecule_words(mol, fp_type: str, params: dict) -> list[int]:
    from rdkit.Chem import rdFingerprintGenerator, rdMolDescriptors
    from rdkit.Chem.rdmolops import PatternFingerprint

    if fp_type == "MACCSKeys":
        made = rdMolDescriptors.GetMACCSKeysFingerprint(mol)
    elif fp_type == "RDKitPattern":
        made = PatternFingerprint(mol)
    else:
        name = {"Morgan": "GetMorganGenerator", "TopologicalTorsion": "GetTopologicalTorsionGenerator", "AtomPair": "GetAtomPairGenerator", "RDKit": "GetRDKitFPGenerator"}[fp_type]
        made = getattr(rdFingerprintGenerator, name)(**params).GetFingerprint(mol)
    return bits.pack_string(made.ToBitString())


def molecules(df: DataFrame, fp_type: str, params: dict | None = None, format: str | None = None, full_sanitization: bool = True) -> DataFrame:
    """Fingerprints of (mol_id, mol); molecules that cannot be parsed are left out."""
    import pandas as pd

    params = with_defaults(fp_type, params)
    _chemistry()

    def run(batches):
        for batch in batches:
            rows = []
            for i, text in zip(batch["mol_id"], batch["mol"]):
                mol = molecule(text, format, full_sanitization) if text is not None else None
                if mol is not None:
                    words = molecule_words(mol, fp_type, params)
                    rows.append((i, words, sum((w & (1 << 64) - 1).bit_count() for w in words)))
            yield pd.DataFrame(rows, columns=["mol_id", "words", "popcnt"])

    return df.select("mol_id", "mol").mapInPandas(run, SCHEMA)


def chemistry_version() -> str | None:
    try:
        return _chemistry().__version__
    except ImportError:
        return None


def warn_if_other_version(recorded: str | None) -> None:
    now = chemistry_version()
    if recorded and now and recorded != now:
        warnings.warn(f"the table was made with rdkit {recorded}; this is {now}", stacklevel=2)
