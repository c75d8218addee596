"""A search engine over one fingerprint dataset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievefp.functions import bits
from sievefp.operators import isim, search
from sievefp.sources import featurize, store


class FingerprintEngine:
    """Searches a dataset (a path of sievefp.sources.store), a JDBC table or a DataFrame.

    in_memory keeps the table in Spark's cache; otherwise each search scans the files.
    Queries are words, ids of rows (query_of) or molecules (needs rdkit).
    """

    def __init__(self, spark: SparkSession, path: str | None = None, in_memory: bool = True, fps: DataFrame | None = None, config: dict | None = None, jdbc: dict | None = None):
        self.spark, self.in_memory = spark, in_memory
        if path is not None:
            self.config = store.read_config(spark, path)
            store.check_versions(self.config)
            self._table = store.load(spark, path)
        elif jdbc is not None:
            if not in_memory:
                raise ValueError("a JDBC table is searched in memory only")
            config = config or store.jdbc_config(spark, jdbc["url"], jdbc["table"], jdbc.get("properties"))
            if config is None:
                raise ValueError("a JDBC table needs its configuration")
            self.config = config
            store.check_versions(self.config)
            self._table = store.read_jdbc(spark, words=config["words"], **jdbc)
        elif fps is not None and config is not None:
            self.config, self._table = config, fps
        else:
            raise ValueError("a path, a JDBC table or a DataFrame with its configuration is needed")
        if in_memory:
            self._table = self._table.persist()

    def __str__(self) -> str:
        return f"FingerprintEngine({self.fp_type}, {self.fp_params}, {self.words} words)"

    @property
    def fps(self) -> DataFrame:
        if not self.in_memory:
            raise ValueError("the fingerprints are not in memory")
        return self._table

    @property
    def table(self) -> DataFrame:
        return self._table

    @property
    def fp_type(self) -> str:
        return self.config["fp_type"]

    @property
    def fp_params(self) -> dict:
        return dict(self.config["fp_params"])

    @property
    def words(self) -> int:
        return self.config["words"]

    @property
    def rdkit_version(self) -> str | None:
        """The version of rdkit that the fingerprints were made with, if any."""
        return self.config.get("rdkit_version")

    @property
    def version(self) -> str | None:
        """The version of this package that wrote the dataset."""
        return self.config.get("version")

    @property
    def popcount_bins(self) -> DataFrame:
        return store.popcount_bins(self._table)

    def query_of(self, mol_id: int) -> list[int]:
        """The words of a stored row."""
        row = self._table.filter(F.col("mol_id") == mol_id).select("words").first()
        if row is None:
            raise KeyError(mol_id)
        return list(row["words"])

    def load_query(self, query, full_sanitization: bool = True) -> list[int]:
        """Words, checked against the table's width, of words, a bit vector or a molecule."""
        if isinstance(query, str) or hasattr(query, "GetNumAtoms"):
            mol = featurize.molecule(query, None, full_sanitization) if isinstance(query, str) else query
            if mol is None:
                raise ValueError("the query molecule cannot be parsed")
            words = featurize.molecule_words(mol, self.fp_type, self.config["fp_params"])
        elif hasattr(query, "ToBitString"):
            words = bits.pack_string(query.ToBitString())
        else:
            words = [bits.signed(int(w) & (1 << 64) - 1) for w in query]
        if len(words) != self.words:
            raise ValueError(f"the query has {len(words)} words, the table {self.words}")
        return words

    def similarity(self, query, threshold: float, metric: str = "tanimoto", full_sanitization: bool = True) -> DataFrame:
        return search.similarity(self._table, self.load_query(query, full_sanitization), threshold, metric)

    def top_k(self, query, k: int, threshold: float = 0.0, metric: str = "tanimoto", full_sanitization: bool = True) -> DataFrame:
        return search.top_k(self._table, self.load_query(query, full_sanitization), k, threshold, metric)

    def tversky(self, query, threshold: float, a: float, b: float, full_sanitization: bool = True) -> DataFrame:
        return search.tversky(self._table, self.load_query(query, full_sanitization), threshold, a, b)

    def substructure(self, query, full_sanitization: bool = True) -> DataFrame:
        return search.substructure(self._table, self.load_query(query, full_sanitization))

    def device_similarity(self, query, threshold: float, full_sanitization: bool = True) -> DataFrame:
        return search.device_similarity(self._table, self.load_query(query, full_sanitization), threshold)

    # the same plans without the cache: build the engine with in_memory=False
    on_disk_similarity, on_disk_top_k, on_disk_tversky, on_disk_substructure = similarity, top_k, tversky, substructure

    def _asked(self, queries) -> DataFrame:
        if isinstance(queries, DataFrame):
            return queries
        queries = self.spark.createDataFrame([(i, self.load_query(w)) for i, w in queries], "query_id long, words array<long>")
        return queries.withColumn("popcnt", bits.popcount(F.col("words")))

    def batch_similarity(self, queries: Sequence[tuple[int, Sequence[int]]] | DataFrame, threshold: float, metric: str = "tanimoto") -> DataFrame:
        return search.batch_similarity(self._table, self._asked(queries), threshold, metric, self.words)

    def batch_top_k(self, queries: Sequence[tuple[int, Sequence[int]]] | DataFrame, k: int, threshold: float, metric: str = "tanimoto") -> DataFrame:
        queries = self._asked(queries)
        return search.batch_top_k(self._table, queries, k, threshold, metric, self.words)

    def symmetric_distance_matrix(self, threshold: float, metric: str = "tanimoto") -> DataFrame:
        return search.distance_matrix(self.fps, threshold, metric, self.words)

    def set_similarity(self, k: int = 1) -> DataFrame:
        return isim.set_similarity(self._table, self.words, k)

    def complementary(self, index: str = "RR") -> DataFrame:
        return isim.complementary(self._table, self.words, index)

    def medoid(self, index: str = "RR") -> DataFrame:
        return isim.medoid(self._table, self.words, index)

    def outlier(self, index: str = "RR") -> DataFrame:
        return isim.outlier(self._table, self.words, index)

    def append(self, fps: DataFrame, path: str) -> None:
        store.append(fps, path)

    def save(self, path: str) -> None:
        """Writes the table in memory as a dataset."""
        store.create(self.fps, path, self.config)
