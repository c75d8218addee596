"""Archives, vectors, the classifier, components and the pipeline."""

import gzip
import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from helpers import alnum_words, components, documents

from sievefp.llm import covertree, graph, quality, warc
from sievefp.llm.common import new_path


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, payload_digest string")


def test_archives(spark):
    long = "<p>é</p>" * 90_000
    rows = [(3, "http://a\r\nX: y", long), (1, None, long), (2, "u", "y" * 99), (4, "u", "y" * 99), (5, "u", None), (6, "u", ""), (7, "u", "WARC/1.1\r\n\r\n" * 20), (8, "u", "z" * 100), (8, "u", "z" * 100), (9, "u", "z" * 100), (None, "u", "z" * 100)]
    want = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        first = min((j for j, _, g in rows if g == h and j is not None), default=None) if len(b) >= 100 else i
        again = first is not None and first != i
        want[i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first if again else None] += 1
    assert Counter(map(tuple, warc.archive_digests(pages(spark, rows)).collect())) == want
    assert warc.archive_digests(pages(spark, []).filter("false")).count() == 0


def test_archives_of_odd_ids(spark):
    ids = ["null", "a>b\r\nX", "#1", "%20 é", "", None]
    df = spark.createDataFrame([(i, "u", "x" * 200) for i in ids], "page_id string, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.archive_digests(df).collect()}
    assert got == {"": ("response", None)} | {i: ("revisit", "") for i in ids if i != ""}


def test_a_revisit_of_another_payload_fails(spark, monkeypatch):
    read = warc.read_chunks
    from pyspark.sql import functions as F

    wrong = F.when(F.col("record_type") == "revisit", F.lit("0" * 64)).otherwise(F.col("header_digest"))
    monkeypatch.setattr(warc, "read_chunks", lambda *a: read(*a).withColumn("header_digest", wrong))
    with pytest.raises(Exception, match="differs from its response"):
        warc.archive_digests(pages(spark, [(1, "u", "x" * 200), (2, "u", "x" * 200)])).collect()


def test_archive_digests_read_the_chunk_rows(spark, monkeypatch):
    read, tables = warc.read_chunks, []
    monkeypatch.setattr(warc, "read_chunks", lambda *a, **b: tables.append(read(*a, **b)) or tables[-1])
    text = "0123456789" * 100_000
    assert warc.archive_digests(pages(spark, [(1, "u", text)])).count() == 1
    assert b"".join(bytes(r.chunk) for r in tables[0].orderBy("chunk_no").collect()) == text.encode()


def test_chunks_carry_digests(spark):
    text = "0123456789" * 100_000
    marked = warc.mark_revisits(pages(spark, [(1, "u", text)]))
    segments = warc.write_archives(marked, new_path(spark, "chunks"))
    path = segments.first().path
    raw = gzip.open(path.removeprefix("file:")).read()
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and raw.endswith(b"9\r\n\r\n")
    rows = warc.read_chunks(spark, segments).orderBy("chunk_no").collect()
    assert len(rows) > 3 and [r.last for r in rows] == [False] * (len(rows) - 1) + [True]
    so_far = b""
    for r in rows:
        so_far += bytes(r.chunk)
        assert len(r.chunk) <= warc.CHUNK and r.bytes_so_far == len(so_far) and r.sha256_so_far == hashlib.sha256(so_far).hexdigest()
    assert so_far == text.encode()


def vectors(seed=3, size=8):
    r = np.random.default_rng(seed)
    base = r.normal(size=(60, size))
    near = np.concatenate([base[i] + r.normal(size=(12, size)) * s for i, s in ((0, 0.01), (1, 0.2), (2, 0.1))])
    chain = np.array([[np.cos(a), np.sin(a)] + [0] * (size - 2) for a in np.arange(0, 3, 0.25)])
    found = [list(map(float, np.float32(x))) for x in [*base, *near, *chain, base[4], base[4], base[4] * 3]]
    return list(enumerate(found))


@pytest.mark.parametrize("block", [2048, 6])
def test_cover_tree(spark, block, monkeypatch):
    monkeypatch.setattr(covertree, "BLOCK", block)
    rows = vectors()
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.95
    comp = components(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i) if linked[i, j]])
    want = {i: (int(linked[i].sum()) - 1, comp[i], comp[i] == i) for i in comp}
    odd = [(1000, None), (1001, [0.0] * 8), (1002, [1.0] * 7 + [None]), (1003, [1.0] * 7 + [float("nan")]), (1004, []), (1005, [float("inf")] * 8), (1006, [3.0]), (1007, [5.0])]
    want |= {i: (0, i, True) for i, _ in odd if i < 1006} | {1006: (1, 1006, True), 1007: (1, 1006, False)}
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + odd], "vec_id long, embedding array<float>, links int").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in covertree.near_vectors(df).collect()}
    assert got == want
    if block == 6:
        monkeypatch.setattr(covertree, "BROADCAST_BYTES", 0)
        assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in covertree.near_vectors(df).collect()} == want
    assert covertree.near_vectors(df.filter("false")).count() == 0


def test_nets_are_nested_and_lose_no_pair():
    r = np.random.default_rng(6)
    base = r.normal(size=(12, 16))
    x = covertree.unit(np.concatenate([b + r.normal(size=(60, 16)) * 0.03 for b in base]))
    y = covertree.unit(np.concatenate([b + r.normal(size=(40, 16)) * 0.03 for b in base[:6]]))
    a, b = covertree.Nets.build(x), covertree.Nets.read(covertree.Nets.build(y).data())
    assert len(a.levels) > 1 and len(b.levels) > 1
    for (up, *_), (nodes, parents, own, cover) in zip(a.levels, a.levels[1:]):
        assert len(nodes) >= len(up) and (a.levels[0][2][nodes] >= 0).all()
    for k, (nodes, parents, own, cover) in enumerate(a.levels):
        assert (covertree._apart((x * x[nodes[own]]).sum(1)) <= cover[own] + 1e-9).all() and cover.max() <= covertree.RADII[k]
        if k:
            assert (parents[own] == a.levels[k - 1][2]).all()
    found = {(i, j) for rows, cols in zip(*covertree._compare(x, y, a, b, 0.95, False)) for i, j in [(rows, cols)]}
    assert found == set(zip(*np.nonzero(x @ y.T >= 0.95)))
    left = sum(len(rows) * len(cols) for rows, cols in covertree._descend(x, y, a, b, np.sqrt(0.1)))
    assert left < 0.3 * len(x) * len(y)


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(40), r.randrange(40)) for _ in range(25)] + [(100 + i, 101 + i) for i in range(20)]
    want = components({x for e in edges for x in e}, edges)
    got = graph.components(spark.createDataFrame(edges, "a long, b long"))
    assert {x.node: x.comp for x in got.collect()} == want


def labelled(spark, n=300):
    r = random.Random(4)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(r.randrange(20, 120))]
        kind = i % 5
        if kind == 1:
            for w in ("vile", "scum", "moron"):
                words.insert(r.randrange(len(words)), w)
        if kind == 2:
            words = [w + "%%%" for w in words]
        rows.append((i, " ".join(words)))
        if i % 2:
            labels.append((i, int(kind != 2), int(kind == 1)))
    rows += [(n, None), (n + 1, ""), (None, " ".join(vocabulary[:30]))]
    return documents(spark, rows), spark.createDataFrame(labels + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int"), n


def test_classifier(spark):
    docs, labels, n = labelled(spark)
    got = {r.doc_id: r.accepted for r in quality.classify(docs, labels).collect()}
    good = [got[i] for i in range(n) if i % 5 not in (1, 2)]
    bad = [got[i] for i in range(n) if i % 5 in (1, 2)]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.05
    assert got[n] and got[n + 1] and got[None]
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, ok in got.items() if ok}


def test_classifier_is_brute_force(spark):
    """Weights and the chosen rows, from sets of n-grams and counts in plain Python."""
    import math

    docs, labels, n = labelled(spark)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    table = quality._labels(labels, "doc_id", quality.LABELLED).collect()
    grams = {}
    for i, t in texts.items():
        data = np.frombuffer(t.encode(), np.uint8)
        grams[i] = set(quality.ngram_slots(data, np.array([0, len(data)]))[1].tolist())
    fit = {r._lid: r._good for r in table if r._fit and r._lid in texts}
    count = lambda ids: Counter(g for i in ids for g in grams[i])
    raw, good, bad = count(texts), count(i for i in fit if fit[i]), count(i for i in fit if not fit[i])
    n_good, n_bad, n_raw = sum(r._good for r in table if r._fit), sum(not r._good for r in table if r._fit), len(texts)
    share = {g: raw[g] * n_good / n_raw for g in raw}
    often = sorted((math.log(good[g] / share[g]), g) for g in raw if share[g] > 5 and good[g])
    half, run = sum(good[g] for _, g in often) / 2, 0
    for middle, g in often:
        run += good[g]
        if run >= half:
            break

    def ratio(g):
        odds = lambda x: math.log((x + 1) / (n_good - x + 1))
        total, both = n_good + n_bad, good[g] + bad[g]
        cells = ((good[g], both * n_good), (bad[g], both * n_bad), (n_good - good[g], (total - both) * n_good), (n_bad - bad[g], (total - both) * n_bad))
        stat = sum(x * math.log(x * total / e) for x, e in cells if x)
        return (odds(good[g]) - odds(min(share[g] * math.exp(middle), n_good))) / (1 + math.exp(math.log(total) - stat))

    rows = quality.classify(docs, labels).collect()
    want = {i: sum(map(ratio, grams[i])) for i in texts}
    assert all(math.isclose(r.log_weight, want[r.doc_id], rel_tol=1e-4, abs_tol=1e-3) for r in rows)
    assert len({round(r.log_weight, 6) for r in rows}) > 0.95 * n
    weighed = quality.weigh(docs, quality.fit(docs, labels)).select("doc_id", "log_weight", "sample_key").collect()
    noise = [r.sample_key - r.log_weight for r in weighed]
    assert abs(np.mean(noise) - 0.5772) < 0.25 and abs(np.std(noise) - 1.2825) < 0.25
    best = {r.doc_id for r in sorted(weighed, key=lambda r: -r.sample_key)[:25]}
    assert {r.doc_id for r in quality.classify(docs, labels, k=25).collect() if r.accepted} == best
    assert quality.accepted(docs, labels, k=25).count() == 25


def test_columns_of_any_name_stay(spark):
    """Internal names as extra columns come back as they were."""
    import corpus_pipeline
    from sievefp.llm import jaccard, lines

    docs, labels, _ = labelled(spark, 60)
    extra = ["_key", "_gone", "_gid", "_lines", "_dkey", "_sid", "_weight", "_sample", "_good", "_lid", "a.b", "log_weight", "n_removed_", "id"]
    wide = docs.select("*", *[docs.doc_id.cast("string").alias(c) for c in extra])
    for df in (quality.accepted(wide, labels), lines.line_dedup(wide).select(*[f"`{c}`" for c in wide.columns]), jaccard.one_of_each(wide), corpus_pipeline.dedup_lines(spark, wide.withColumn("n_lines", wide.doc_id), "")):
        rows = df.collect()
        assert df.columns[: len(wide.columns)] == wide.columns and len(rows) > 10
        assert all(r[c] == (None if r.doc_id is None else str(r.doc_id)) for r in rows for c in extra)


def test_classifier_with_few_labels(spark):
    """Telling words too few for a fixed likelihood ratio statistic of 20 still part the texts."""
    r = random.Random(3)
    rows, labels = [], []
    for i in range(90):
        words = [f"w{r.randrange(400)}" for _ in range(30)]
        if i % 6 == 1:
            for k in (i // 6 % 5, (i // 6 + 1) % 5):
                words.insert(r.randrange(30), f"slur{k}")
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 6 == 1)))
    docs, labels = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {x.doc_id: x.accepted for x in quality.classify(docs, labels).collect()}
    assert np.mean([got[i] for i in range(90) if i % 6 == 1]) < 0.3
    assert np.mean([got[i] for i in range(90) if i % 6 != 1]) > 0.97


def test_classifier_without_labels(spark):
    docs, labels, n = labelled(spark, 20)
    assert quality.classify(docs, labels.filter("false")).filter("accepted").count() == docs.count()
    assert quality.classify(docs.filter("false"), labels).count() == 0


@pytest.mark.parametrize("k", [1, 7, 250, 499, 500])
def test_kth_largest(spark, k):
    r = random.Random(k)
    values = [r.gauss(0, 1) ** 3 for _ in range(400)] + [0.5] * 100
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert quality.kth_largest(df, "x", k, bins=8, small=3) == sorted(values, reverse=True)[k - 1]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs, labels, n = labelled(spark)
    base = [(i, t) for i, t in ((r.doc_id, r.text) for r in docs.collect()) if i is not None]
    texts = dict(base)
    texts[0] = "l1 aa\nl2 bb\nl3 cc\n" + texts[0]
    texts[3] = texts[3] + "\nl1 aa\nl2 bb\nl3 cc"
    texts[10] = texts[4] + " tail"
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in texts.items()]
    item = " ".join(alnum_words(texts[9])[3:13])
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    accepted = {r.doc_id for r in quality.classify(table, labels).collect() if r.accepted}
    assert {0, 3, 4, 9, 10} <= accepted
    want = accepted - {10, 9}
    kept = dict(texts) | {3: texts[3].removesuffix("\nl1 aa\nl2 bb\nl3 cc")}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == want
    for i, r in got.items():
        assert r.decoded_sha256 == hashlib.sha256((kept[i] or "").encode()).hexdigest()
        ids = np.frombuffer(bytes(r.ids), "<u4")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest()
    clash = spark.read.parquet(str(tmp_path / "documents.parquet")).selectExpr("*", "doc_id as _key", "doc_id as _hit_id")
    kept = corpus_pipeline.remove_contaminated(spark, clash, str(tmp_path))
    assert kept.columns == clash.columns and {r.doc_id for r in kept.collect()} == {i for i in texts if i != 9} and all(r._key == r.doc_id for r in kept.collect())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near copies", "decontamination", "bpe"]


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Nulls in every column, empty texts, repeated rows; then tables without rows."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (None, "", None, None, 0), (1, None, "en", None, None), (2, "", "en", "s", 0), (3, "a b c", None, "s", 5), (3, "a b c", None, "s", 5), (4, "x\nx\nx\nx\nx\nx\nx", "en", "s", 13)]
    for name, some in (("odd", rows), ("none", [])):
        folder = tmp_path / name
        spark.createDataFrame(some, schema).write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([(None, None, None), (3, None, 1)] if some else [], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
        spark.createDataFrame([(None, None), (1, "")] if some else [], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
        got = corpus_pipeline.run(spark, str(folder)).collect()
        assert Counter(r.doc_id for r in got) == (Counter({None: 2, 1: 1, 2: 1, 3: 1, 4: 1}) if some else Counter())
