"""Registered queries of the fingerprint engine, and DuckDB SQL for them.

The tables hold no molecules, so fingerprints come from embeddings (sign and thermometer
bits), documents (hashed tokens) and parts (structural keys).  The SQL works on lists of set
bits, not on packed words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievefp import paths
from sievefp.engine import FingerprintEngine
from sievefp.functions import bits, sql
from sievefp.operators import isim, search
from sievefp.sources import featurize, molecules, store
from sievefp.streaming import ingest

#: The query of every search: the row with this id.
QUERY = 7
#: RLIKE patterns of the part keys.
PART_KEYS = ["red", "blue", "green", "steel", "brass", "copper", "nickel", "tin", "small", "large", "medium", "economy", "standard", "promo", "polished", "brushed", "plated", "anodized", "burnished", "a", "e", "i", "o", "u"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _signs(spark, sf_dir) -> DataFrame:
    return featurize.sign_bits(_table(spark, sf_dir, "embeddings"))


def _levels(spark, sf_dir) -> DataFrame:
    return featurize.thermometer(_table(spark, sf_dir, "embeddings"))


def _tokens(spark, sf_dir) -> DataFrame:
    texts, cores = _table(spark, sf_dir, "documents").select("doc_id", "text"), spark.sparkContext.defaultParallelism
    if texts.rdd.getNumPartitions() < cores:  # a table of few files would leave most cores idle
        texts = texts.repartition(cores)
    return featurize.hashed_tokens(texts)


def _engine(spark, sf_dir, fps=_signs, words: int = 1, in_memory: bool = False) -> FingerprintEngine:
    return FingerprintEngine(spark, in_memory=in_memory, fps=fps(spark, sf_dir), config=store.make_config("bits", {"fpSize": 64 * words}, words))


def _search(run, fps=_signs, words: int = 1):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = _engine(spark, sf_dir, fps, words)
        return run(engine, engine.query_of(QUERY))

    return query


def _on_disk(run):
    """The same search over a stored dataset that is scanned, not cached."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = _dataset(spark, _signs(spark, sf_dir))
        engine = FingerprintEngine(spark, path, in_memory=False)
        return run(engine, engine.query_of(QUERY))

    return query


def _dataset(spark: SparkSession, fps: DataFrame, sort: bool = True) -> str:
    path = paths.scratch(spark, "dataset")
    store.create(fps, path, store.make_config("bits", {"fpSize": 64}, 1), sort)
    return path


def _hex(fps: DataFrame) -> DataFrame:
    """mol_id, words in hexadecimal, popcnt."""
    text = F.array_join(F.transform("words", lambda w: F.lpad(F.lower(F.hex(w)), 16, "0")), "")
    return fps.select("mol_id", text.alias("words"), F.col("popcnt").cast("int").alias("popcnt"))


def _sorted(spark, sf_dir):
    path = _dataset(spark, _signs(spark, sf_dir), sort=False)
    store.sort(spark, path)
    return _hex(store.load(spark, path))


def _appended(spark, sf_dir):
    fps = _signs(spark, sf_dir)
    path = _dataset(spark, fps.filter("mol_id % 2 = 0"))
    store.append(fps.filter("mol_id % 2 = 1"), path)
    return _hex(store.load(spark, path))


def _deleted(spark, sf_dir):
    fps = _signs(spark, sf_dir)
    path = _dataset(spark, fps)
    store.delete(spark, path, fps.filter("popcnt > 32").select("mol_id"))
    return _hex(store.load(spark, path))


def _merged(spark, sf_dir):
    fps = _signs(spark, sf_dir)
    one, two, both = _dataset(spark, fps), _dataset(spark, fps.filter("popcnt <= 32")), paths.scratch(spark, "merged")
    store.merge(spark, [one, two], both)
    return store.load(spark, both).groupBy("mol_id").agg(F.count("*").alias("copies"))


def _migrated(spark, sf_dir):
    old, new = paths.scratch(spark, "old"), paths.scratch(spark, "new")
    store.create(_signs(spark, sf_dir), old, store.make_config("bits", {"nBits": 64}, 1))
    store.migrate(spark, old, new)
    size = store.read_config(spark, new)["fp_params"]["fpSize"]
    return store.load(spark, new).select("mol_id", F.lit(int(size)).alias("fp_size"))


def _exported(spark, sf_dir):
    path = paths.scratch(spark, "export")
    _engine(spark, sf_dir, in_memory=True).save(path)
    return _hex(store.load(spark, path))


def _matrix(metric: str, threshold: float = 0.5):
    return lambda spark, sf_dir: search.distance_matrix(_signs(spark, sf_dir), threshold, metric)


def _batch(spark, sf_dir):
    fps = _signs(spark, sf_dir)
    asked = fps.select(F.col("mol_id").alias("query_id"), "words", "popcnt")
    return search.batch_top_k(fps, asked, 3, 0.4).select("query_id", "mol_id", "coeff", F.col("rank").cast("int").alias("rank"))


def _batch_similarity(metric: str):
    """Every row whose id is divisible by 20 as a query, against all rows."""

    def query(spark, sf_dir):
        fps = _signs(spark, sf_dir)
        asked = fps.filter("mol_id % 20 = 0").select(F.col("mol_id").alias("query_id"), "words", "popcnt")
        return _engine(spark, sf_dir).batch_similarity(asked, 0.45, metric)

    return query


def _batch_levels(spark, sf_dir):
    fps = _levels(spark, sf_dir)
    asked = fps.filter("mol_id % 20 = 0").select(F.col("mol_id").alias("query_id"), "words", "popcnt")
    return search.batch_top_k(fps, asked, 5, 0.0, words=4).select("query_id", "mol_id", "coeff", F.col("rank").cast("int").alias("rank"))


def _part_lines(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("mol_id"), F.col("p_name").alias("mol"))


def _read_smiles(spark, sf_dir):
    """Parts written as a file of lines "text id" and read as a SMILES file."""
    path = f"{paths.scratch(spark, 'parts')}.smi"
    _part_lines(spark, sf_dir).select(F.concat_ws(" ", "mol", "mol_id")).write.text(path)
    return molecules.molecules(spark, path)


def _read_sdf(spark, sf_dir):
    """Parts written as SD records and read back; the name is the block's first line."""
    path = f"{paths.scratch(spark, 'parts')}.sdf"
    record = F.concat(F.col("mol"), F.lit("\n  x\n\n  0  0  0     0  0            999 V2000\nM  END\n>  <mol_id>\n"), F.col("mol_id").cast("string"), F.lit("\n\n"))
    _part_lines(spark, sf_dir).select(record).write.option("lineSep", "$$$$\n").text(path)
    return molecules.molecules(spark, path).select("mol_id", F.substring_index("mol", "\n", 1).alias("mol"))


def _read_rows(spark, sf_dir):
    """Nations as an iterable of (text, id)."""
    nations = _table(spark, sf_dir, "nation").select("n_name", "n_nationkey").collect()  # 25 rows at every size
    return molecules.molecules(spark, [(r[0], r[1]) for r in nations])


def _configured(spark, sf_dir):
    """What a dataset records about itself, beside its number of rows."""
    path = _dataset(spark, _signs(spark, sf_dir))
    engine = FingerprintEngine(spark, path, in_memory=False)
    return engine.table.agg(F.count("*").alias("mols")).select("mols", F.lit(engine.fp_type).alias("fp_type"), F.lit(engine.words).alias("words"), F.lit(int(engine.fp_params["fpSize"])).alias("fp_size"))


def _streamed(spark, sf_dir):
    """Half the rows stored, the other half added by a stream."""
    fps = _signs(spark, sf_dir)
    path, source = _dataset(spark, fps.filter("mol_id % 2 = 0")), paths.scratch(spark, "stream-source")
    fps.filter("mol_id % 2 = 1").write.parquet(source)
    rows = spark.readStream.schema(featurize.SCHEMA).parquet(source)
    ingest.ingest(rows, lambda df: df, path, paths.scratch(spark, "stream-state")).awaitTermination()
    return _hex(store.load(spark, path))


def _stream_matched(spark, sf_dir):
    """A stream of queries against the table, written to files and read back."""
    fps = _signs(spark, sf_dir)
    source, out = paths.scratch(spark, "query-source"), paths.scratch(spark, "matches")
    fps.filter("mol_id % 20 = 0").write.parquet(source)
    asked = spark.readStream.schema(featurize.SCHEMA).parquet(source).select(F.col("mol_id").alias("query_id"), "words", "popcnt")
    found = ingest.match(asked, fps, 0.45)
    found.writeStream.format("parquet").option("path", out).option("checkpointLocation", paths.scratch(spark, "query-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("query_id long, mol_id long, coeff float").parquet(out)


def _keys(spark, sf_dir):
    lower = _table(spark, sf_dir, "part").withColumn("key_text", F.lower(F.concat_ws(" ", "p_name", "p_type")))
    fps = featurize.keys(lower, PART_KEYS, "p_partkey", "key_text")
    return fps.select("mol_id", "popcnt")


def _bits_set(spark, sf_dir):
    return _levels(spark, sf_dir).select("mol_id", F.explode(bits.on_bits(F.col("words"))).alias("bit"))


def _sql(spark, sf_dir):
    sql.register(spark)
    name = "sievefp_signs"
    _signs(spark, sf_dir).createOrReplaceTempView(name)
    return spark.sql(
        f"SELECT f.mol_id, fp_tanimoto(f.words, q.words) AS coeff, fp_contains(f.words, q.words) AS contains FROM {name} f CROSS JOIN (SELECT words FROM {name} WHERE mol_id = {QUERY}) q"
    )


def queries() -> dict:
    per_metric = ("tanimoto", "dice", "cosine")
    out = {f"sim_{m}": _search(lambda e, q, m=m: e.similarity(q, 0.45, m)) for m in per_metric}
    out |= {f"top_k_{m}": _search(lambda e, q, m=m: e.top_k(q, 10, 0.0, m)) for m in per_metric}
    out |= {f"dist_matrix_{m}": _matrix(m) for m in per_metric}
    out |= {f"isim_comp_{i.lower()}": lambda s, d, i=i: isim.complementary(_levels(s, d), 4, i).select("mol_id", F.round("index", 9).alias("index")) for i in ("RR", "JT", "SM")}
    return out | {
        "sim_tversky": _search(lambda e, q: e.tversky(q, 0.55, 0.7, 0.2)),
        "substructure": _search(lambda e, q: e.substructure(q), _levels, 4),
        "top_k_threshold": _search(lambda e, q: e.top_k(q, 10, 0.42)),
        "top_k_unlimited": _search(lambda e, q: e.top_k(q, 0, 0.42)),
        "sim_t0": _search(lambda e, q: e.similarity(q, 0.0)),
        "sim_empty": _search(lambda e, q: e.similarity(q, 1.1)),
        "sim_multiword": _search(lambda e, q: e.similarity(q, 0.4), _levels, 4),
        "sim_docs_2048": _search(lambda e, q: e.similarity(q, 0.25), _tokens, 32),
        "gpu_semantics_tanimoto": _search(lambda e, q: e.device_similarity(q, 0.0)),
        "on_disk_similarity": _on_disk(lambda e, q: e.on_disk_similarity(q, 0.45)),
        "on_disk_top_k": _on_disk(lambda e, q: e.on_disk_top_k(q, 10)),
        "on_disk_tversky": _on_disk(lambda e, q: e.on_disk_tversky(q, 0.55, 0.7, 0.2)),
        "on_disk_substructure": _on_disk(lambda e, q: e.on_disk_substructure(q)),
        "popcount": lambda s, d: _tokens(s, d).select("mol_id", "popcnt"),
        "pack_words": lambda s, d: _hex(_levels(s, d)),
        "on_bits": _bits_set,
        "popcnt_bins": lambda s, d: store.popcount_bins(_signs(s, d)),
        "sort_by_popcnt": _sorted,
        "append": _appended,
        "delete": _deleted,
        "merge": _merged,
        "migrate": _migrated,
        "export": _exported,
        "part_keys": _keys,
        "batch_top_k": _batch,
        "batch_top_k_levels": _batch_levels,
        "batch_sim_tanimoto": _batch_similarity("tanimoto"),
        "batch_sim_dice": _batch_similarity("dice"),
        "batch_sim_cosine": _batch_similarity("cosine"),
        "read_smiles": _read_smiles,
        "read_sdf": _read_sdf,
        "read_rows": _read_rows,
        "dataset_config": _configured,
        "stream_ingest": _streamed,
        "stream_match": _stream_matched,
        "sql_functions": _sql,
        "isim_counters": lambda s, d: isim.counters(_levels(s, d), 4),
        "isim_dict": lambda s, d: isim.set_similarity(_levels(s, d), 4).select(*[F.round(c, 9).alias(c) for c in ("jt", "rr", "sm")]),
        "isim_medoid": lambda s, d: isim.medoid(_levels(s, d), 4),
        "isim_outlier": lambda s, d: isim.outlier(_levels(s, d), 4),
    }


# ------------------------------------------------------------------- DuckDB SQL

_SIGN_BITS = "f as (select vec_id as mol_id, list_filter(range(0, 64), lambda i: embedding[i + 1] > 0) as b from embeddings)"
_LEVEL_BITS = (
    "f as (select vec_id as mol_id, list_filter(range(0, 256), lambda i: embedding[i % 64 + 1]::double > "
    "[-0.1::double, 0.0::double, 0.1::double, 0.2::double][(i // 64 + 1)::int]) as b from embeddings)"
)
_TOKEN_BITS = "f as (select doc_id as mol_id, list_distinct(list_transform(list_filter(string_split(coalesce(text, ''), ' '), lambda t: t <> ''), lambda t: ('0x' || substr(md5(t), 1, 4))::int % 2048)) as b from documents)"
_PAIR = "x as (select f.mol_id, len(list_intersect(f.b, q.b)) as c, len(q.b) as q, len(f.b) as d from f, f as q where q.mol_id = {id})"
_COEFF = {
    "tanimoto": "(c::double / nullif(q + d - c, 0))::float",
    "dice": "(2 * c::double / nullif(q + d, 0))::float",
    "cosine": "(c::double / nullif(sqrt(q::double * d), 0))::float",
    "tversky": "(case when c::float + 0.7::float * (q - c)::float + 0.2::float * (d - c)::float = 0 then 0 else c::float / (c::float + 0.7::float * (q - c)::float + 0.2::float * (d - c)::float) end)::float",
}


def _oracle(source: str, coeff: str, threshold: float, rest: str = "") -> str:
    pair = _PAIR.format(id=QUERY)
    return f"with {source}, {pair}, y as (select mol_id, {coeff} as coeff from x) select mol_id, coeff from y where coeff >= {threshold}::float {rest}"


def _hex_oracle(source: str, words: int, where: str = "true") -> str:
    words_of = "array_to_string(list_transform(range(0, %d), lambda w: lower(lpad(hex(coalesce(list_sum(list_transform(list_filter(b, lambda p: p // 64 = w), lambda p: 1::hugeint << (63 - p %% 64)::hugeint)), 0)::ubigint), 16, '0'))), '')" % words
    return f"with {source} select mol_id, {words_of} as words, len(b)::int as popcnt from f where {where}"


def _batch_oracle(metric: str) -> str:
    pairs = "x as (select g.mol_id as query_id, f.mol_id, len(list_intersect(f.b, g.b)) as c, len(g.b) as q, len(f.b) as d from f, f as g where g.mol_id % 20 = 0)"
    return f"with {_SIGN_BITS}, {pairs}, y as (select query_id, mol_id, {_COEFF[metric]} as coeff from x) select query_id, mol_id, coeff from y where coeff >= 0.45::float"


_SUMS = f"with {_LEVEL_BITS}, n as (select count(*)::double as n from f), c as (select i.i, count(f.mol_id)::double as c from range(0, 256) i(i) left join (select mol_id, unnest(b) as i from f) f on f.i = i.i group by 1)"
_COUNTERS = "t as (select any_value(n) as n, sum(c * (c - 1) / 2) as a, sum((n - c) * (n - c - 1) / 2) as d, sum(c * (n - c)) as dis from c, n)"
_LEFT_OUT = f"{_SUMS}, o as (select f.mol_id, len(b) as popcnt, c.c - list_contains(b, i)::int as k, n - 1 as m from f, c, n), v as (select mol_id, any_value(popcnt) as popcnt, sum(k * (k - 1) / 2) as a, sum(k * (m - k)) as x, sum((m - k) * (m - k - 1) / 2) as d from o group by mol_id)"
_INDEX = {"rr": "a / (a + d + x)", "jt": "a / (a + x)", "sm": "(a + d) / (a + d + x)"}


def _matrix_oracle(metric: str) -> str:
    pairs = "x as (select f.mol_id as i, g.mol_id as j, len(list_intersect(f.b, g.b)) as c, len(f.b) as q, len(g.b) as d from f, f as g where f.mol_id <> g.mol_id)"
    return f"with {_SIGN_BITS}, {pairs}, y as (select i, j, {_COEFF[metric]} as coeff from x) select i, j, (1::float - coeff)::float as dist from y where coeff >= 0.5::float"


def oracle_sql() -> dict[str, str]:
    best = "order by coeff desc, mol_id limit 10"
    contains = "select mol_id from x where c = q and q > 0"
    out = {f"sim_{m}": _oracle(_SIGN_BITS, _COEFF[m], 0.45) for m in ("tanimoto", "dice", "cosine")}
    out |= {f"top_k_{m}": _oracle(_SIGN_BITS, _COEFF[m], 0.0, best) for m in ("tanimoto", "dice", "cosine")}
    out |= {f"dist_matrix_{m}": _matrix_oracle(m) for m in ("tanimoto", "dice", "cosine")}
    out |= {f"isim_comp_{i}": f"{_LEFT_OUT} select mol_id, round({e}, 9) as index from v" for i, e in _INDEX.items()}
    signs = _hex_oracle(_SIGN_BITS, 1)
    keys = ", ".join(f"'{k}'" for k in PART_KEYS)
    return out | {
        "sim_tversky": _oracle(_SIGN_BITS, _COEFF["tversky"], 0.55),
        "substructure": f"with {_LEVEL_BITS}, {_PAIR.format(id=QUERY)} {contains}",
        "top_k_threshold": _oracle(_SIGN_BITS, _COEFF["tanimoto"], 0.42, best),
        "top_k_unlimited": _oracle(_SIGN_BITS, _COEFF["tanimoto"], 0.42),
        "sim_t0": _oracle(_SIGN_BITS, _COEFF["tanimoto"], 0.0),
        "sim_empty": _oracle(_SIGN_BITS, _COEFF["tanimoto"], 1.1),
        "sim_multiword": _oracle(_LEVEL_BITS, _COEFF["tanimoto"], 0.4),
        "sim_docs_2048": _oracle(_TOKEN_BITS, _COEFF["tanimoto"], 0.25),
        "gpu_semantics_tanimoto": _oracle(_SIGN_BITS, _COEFF["tanimoto"], 0.0, "and coeff > 0"),
        "on_disk_similarity": _oracle(_SIGN_BITS, _COEFF["tanimoto"], 0.45),
        "on_disk_top_k": _oracle(_SIGN_BITS, _COEFF["tanimoto"], 0.0, best),
        "on_disk_tversky": _oracle(_SIGN_BITS, _COEFF["tversky"], 0.55),
        "on_disk_substructure": f"with {_SIGN_BITS}, {_PAIR.format(id=QUERY)} {contains}",
        "popcount": f"with {_TOKEN_BITS} select mol_id, len(b)::int as popcnt from f",
        "pack_words": _hex_oracle(_LEVEL_BITS, 4),
        "on_bits": f"with {_LEVEL_BITS} select mol_id, unnest(b)::int as bit from f",
        "popcnt_bins": f'with {_SIGN_BITS}, n as (select len(b)::int as popcnt, count(*) as n from f group by 1) select popcnt, (sum(n) over (order by popcnt) - n)::bigint as start, (sum(n) over (order by popcnt))::bigint as "end" from n',
        "sort_by_popcnt": signs,
        "append": signs,
        "export": signs,
        "delete": _hex_oracle(_SIGN_BITS, 1, "len(b) <= 32"),
        "merge": f"with {_SIGN_BITS} select mol_id, case when len(b) <= 32 then 2 else 1 end::bigint as copies from f",
        "migrate": "select vec_id as mol_id, 64 as fp_size from embeddings",
        "part_keys": f"select p_partkey as mol_id, len(list_filter([{keys}], lambda k: contains(lower(concat_ws(' ', p_name, p_type)), k)))::int as popcnt from part",
        "batch_top_k": f"with {_SIGN_BITS}, x as (select g.mol_id as query_id, f.mol_id, len(list_intersect(f.b, g.b)) as c, len(g.b) as q, len(f.b) as d from f, f as g), y as (select query_id, mol_id, {_COEFF['tanimoto']} as coeff from x), z as (select *, (row_number() over (partition by query_id order by coeff desc, mol_id))::int as rank from y where coeff >= 0.4::float) select query_id, mol_id, coeff, rank from z where rank <= 3",
        "batch_top_k_levels": f"with {_LEVEL_BITS}, x as (select g.mol_id as query_id, f.mol_id, len(list_intersect(f.b, g.b)) as c, len(g.b) as q, len(f.b) as d from f, f as g where g.mol_id % 20 = 0), y as (select query_id, mol_id, {_COEFF['tanimoto']} as coeff from x), z as (select *, (row_number() over (partition by query_id order by coeff desc, mol_id))::int as rank from y where coeff >= 0) select query_id, mol_id, coeff, rank from z where rank <= 5",
        "batch_sim_tanimoto": _batch_oracle("tanimoto"),
        "batch_sim_dice": _batch_oracle("dice"),
        "batch_sim_cosine": _batch_oracle("cosine"),
        "stream_match": _batch_oracle("tanimoto"),
        "read_smiles": "select p_partkey::bigint as mol_id, p_name as mol from part",
        "read_sdf": "select p_partkey::bigint as mol_id, p_name as mol from part",
        "read_rows": "select n_nationkey::bigint as mol_id, n_name as mol from nation",
        "dataset_config": "select count(*) as mols, 'bits' as fp_type, 1::int as words, 64::int as fp_size from embeddings",
        "stream_ingest": signs,
        "sql_functions": f"with {_SIGN_BITS}, {_PAIR.format(id=QUERY)} select mol_id, {_COEFF['tanimoto']} as coeff, c = q as contains from x",
        "isim_counters": f"{_SUMS}, {_COUNTERS} select n, a, d, dis, a + d + dis as p from t",
        "isim_dict": f"{_SUMS}, {_COUNTERS} select round(a / (a + dis), 9) as jt, round(a / (a + d + dis), 9) as rr, round((a + d) / (a + d + dis), 9) as sm from t",
        "isim_medoid": f"{_LEFT_OUT} select mol_id from v order by a / (a + d + x), popcnt, mol_id limit 1",
        "isim_outlier": f"{_LEFT_OUT} select mol_id from v order by a / (a + d + x) desc, popcnt, mol_id limit 1",
    }
