"""Document operators against plain versions on tables with every awkward row."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import DOCS, alnum_words, blank_words, components, corpus, documents

from sievefp.llm import bpe, brown, common, decontaminate, jaccard, lines, registry, suffixes, tokenfile


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return documents(spark, rows).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text, size):
    w = blank_words(text)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80), (2, 50)])
def test_jaccard_join(docs, rows, size, percent):
    sets = [shingles(t, size) for _, t in rows]
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    comp = components(range(len(rows)), edges)
    members = defaultdict(list)
    for i in comp:
        members[comp[i]].append(rows[i][0])
    least = {c: min((m for m in ids if m is not None), default=None) for c, ids in members.items()}
    want = Counter((rows[i][0], len(sets[i]), least[comp[i]]) for i in range(len(rows)))
    got = jaccard.jaccard_components(docs, size, percent).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want


def test_jaccard_keeps_one_of_each(docs, rows, none):
    kept = jaccard.one_of_each(docs, 3, 90)
    assert kept.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    found = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, 3, 90).collect()}
    stay = {i for i, n, c in found if i == c or not n}
    assert set(got) == {(i, t) for i, t in rows if i in stay and (not blank_words(t) or (i, len(shingles(t, 3)), i) in found)}
    assert max(got.values()) == 1
    assert jaccard.one_of_each(none).count() == 0


def test_many_near_copies_take_the_last_round(spark):
    """Copies of which no two are similar, and chains, share all their rare shingles."""
    base = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(40):
        words = list(base)
        for j in range(3):
            words[(k * 7 + j * 19) % 60] = f"n{k}x{j}"
        rows.append((k, " ".join(words)))
    for k in range(20):
        rows.append((100 + k, " ".join(f"c{i}" for i in range(k, k + 60))))
    sets = [shingles(t, 3) for _, t in rows]
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])]
    comp = components(range(len(rows)), edges)
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(documents(spark, rows), 3, 90).collect()}
    assert got == {rows[i][0]: rows[c][0] for i, c in comp.items()}


def test_suffix_bound():
    r = np.random.default_rng(1)
    for _ in range(200):
        x, y = (np.unique(r.integers(0, 60, r.integers(1, 50)).astype(np.uint64)) for _ in range(2))
        both, every = len(np.intersect1d(x, y)), len(np.union1d(x, y))
        assert jaccard._bound(x, y) >= both
        assert jaccard.similar(x, y, 60) == (100 * both >= 60 * every)


def benchmark(spark, rows):
    texts = [" ".join(alnum_words(rows[3][1])[2:16]), " ".join(alnum_words(rows[5][1])[:10]).upper(), "a b", "", None, "-- !!", "one", "never to be found in any document whatever it may be"]
    items = [(i, t) for i, t in enumerate(texts)] + [(3, "one"), (0, texts[0]), (None, "one")]
    return spark.createDataFrame(items, "item_id long, text string")


def test_decontamination(spark, docs, rows):
    items = benchmark(spark, rows)
    windows = defaultdict(set)
    for r in items.collect():
        w = alnum_words(r.text)
        for i in range(max(len(w) - 9, 1) if w else 0):
            windows[tuple(w[i : i + 10])].add(r.item_id)
    want = Counter()
    for doc_id, text in rows:
        w, hit, found = alnum_words(text), set(), set()
        for win, ids in windows.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found |= ids
        names = sorted(str(i) for i in found if i is not None)
        want[doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)] += 1
    got = decontaminate.contamination(docs, items)
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()) == want
    assert sum(k[5] for k in want) > 3


def test_decontamination_without_items(docs, none, spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs, items).filter("contaminated or n_hit > 0").count() == 0
    assert decontaminate.contamination(none, items).count() == 0


def test_decontamination_without_broadcast(spark, docs, rows, monkeypatch):
    items = benchmark(spark, rows)
    want = sorted(map(str, decontaminate.contamination(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    assert sorted(map(str, decontaminate.contamination(docs, items).collect())) == want


def test_proximity(spark):
    docs = documents(spark, [(1, "z a x b y c z"), (2, "c b a"), (3, "a b q q q q q q c"), (4, "a a b"), (5, None)])
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    got = {r.doc_id for r in decontaminate.proximity_matches(docs, items, slop=2).collect()}
    assert got == {1, 2}
    twice = spark.createDataFrame([(1, "a a b")], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.proximity_matches(docs, twice, slop=0).collect()} == {4}


def brute_spans(rows, length):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    for doc_id, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(c for c, g in zip(b, gone) if not g)
        yield doc_id, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("length", [50, 200])
def test_suffix_dedup(docs, rows, length):
    got = suffixes.removed_digests(docs, length)
    assert Counter(map(tuple, got.collect())) == Counter(brute_spans(rows, length))


def test_suffix_dedup_of_a_passage_in_many_contexts(spark):
    """One passage of 230 bytes with other bytes on both sides each time, some of them alike
    for a while; many rows share each digit."""
    r = np.random.default_rng(2)
    letters = lambda n: "".join(map(chr, r.integers(97, 123, n)))
    passage, sides = letters(230), [letters(90) for _ in range(4)]
    rows = []
    for i in range(3000):
        left, right = (s[: r.integers(0, 90)] if i % 3 else "" for s in (sides[r.integers(4)], sides[r.integers(4)]))
        rows.append((i, letters(30) + left[::-1] + passage[: 230 if i % 7 else 205] + right + letters(30)))
    got = suffixes.removed_digests(documents(spark, rows))
    assert Counter(map(tuple, got.collect())) == Counter(brute_spans(rows, 200))


def test_steps_end_at_single_offsets():
    assert suffixes.steps(168) == [64, 16, 4, 1] and suffixes.steps(0) == [1] and suffixes.steps(3) == [1]


def test_suffix_dedup_texts(docs, rows, none):
    got = Counter((r.doc_id, r.text) for r in suffixes.without_repeats(docs, 5000).collect())
    assert got == Counter(rows)
    assert suffixes.removed_digests(none).count() == 0


def test_anchors_in_pieces(monkeypatch):
    data = np.random.default_rng(0).integers(97, 99, 5000).astype(np.uint8)
    whole = suffixes.anchors(data, 60, 16)
    monkeypatch.setattr(suffixes, "_PIECE", 512)
    parts = suffixes.anchors(data, 60, 16)
    cover = lambda a: [(int(x), s) for x, f, l in zip(*a[:3]) for s in range(int(f), int(l) + 1)]
    assert cover(whole) == cover(parts)


def brute_lines(rows):
    first, marks = {}, []
    key = lambda i, t: (i is not None, i if i is not None else 0)
    docs = {}
    for i, t in rows:
        docs.setdefault((i, t), None)
    order = sorted((d for d in docs if d[1] is not None), key=lambda d: key(*d))
    for d in order:
        ls = d[1].split("\n")
        for p in range(len(ls) - 2):
            win = "\n".join(ls[p : p + 3])
            if win.strip(" \t\r\n"):
                first.setdefault(win, (d, p))
                marks.append((win, d, p))
    gone = defaultdict(set)
    for win, d, p in marks:
        fd, fp = first[win]
        if (d, p) != (fd, fp):
            gone[d] |= {x for x in range(p, p + 3) if not (d == fd and x < fp + 3)}
    for i, t in rows:
        ls = [] if t is None else t.split("\n")
        g = gone[i, t]
        yield i, len(ls), len(g), t if t is None else "\n".join(x for k, x in enumerate(ls) if k not in g)


def test_line_dedup(docs, rows, none):
    # two texts under one id would tie for the first occurrence; the plain version has no hash order
    some = [r for r in rows if r != (6, "another text under an id that is taken")]
    got = lines.line_dedup(docs.filter("text is null or text <> 'another text under an id that is taken'"))
    assert Counter((r.doc_id, r.n_lines, r.n_removed, r.text) for r in got.collect()) == Counter(brute_lines(some))
    assert "rid" in got.columns and lines.line_dedup(none).count() == 0


def test_line_dedup_takes_time_in_proportion(spark):
    """Two documents of 100,000 lines, one of which loses nearly all of them."""
    body = "\n".join(f"line {i}" for i in range(100_000))
    got = {r.doc_id: r for r in lines.line_dedup(documents(spark, [(1, body), (2, "first\n" + body + "\nlast")])).collect()}
    assert got[1].text == body and (got[2].n_removed, got[2].text) == (100_000, "first\nlast")


def test_very_long_words_and_texts(spark):
    """Texts longer than what is worked on at once, and words longer than that."""
    word, long = "w" * 400_000, " ".join(f"x{i}" for i in range(120_000))
    rows = [(1, f"a {word} b c"), (2, f"a {word} b c"), (3, f"a {word}v b c"), (4, long), (5, long + " tail"), (6, "short text here")]
    df = documents(spark, rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, 3, 90).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 3), 4: (119_998, 4), 5: (119_999, 4), 6: (1, 6)}
    spans = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffixes.removed_digests(df).collect()}
    assert spans[1] == (len(rows[0][1]), len(rows[0][1])) and spans[6] == (15, 0)
    assert spans[4] == (len(long), len(long)) and spans[5] == (len(long) + 5, len(long))


def test_bpe(docs, rows, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(registry.vocabulary())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))] += 1
    assert Counter(map(tuple, bpe.bpe_digests(docs, registry.vocabulary()).collect())) == want
    coded = bpe.encode_documents(docs, registry.vocabulary())
    again = bpe.decode_documents(coded.drop("text"), registry.vocabulary())
    assert Counter((r.doc_id, r.text) for r in again.collect()) == Counter(rows)
    assert bpe.bpe_digests(none, registry.vocabulary()).count() == 0


def test_bpe_on_odd_texts():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(registry.vocabulary()), bpe.coder(registry.vocabulary())
    texts = ["<|endoftext|>", " <|endoftext|>  a", "a  b\n \n c", "\n\n x", "it's 're ", "   x", "日本語 テスト", "😀😀 👍🏽", "1234½ 5", "-" * 300, "ab" * 900, "  ", "a\x00b", "x \n"]
    for text, ids in zip(texts, own.encode_batch(texts)):
        assert own.listed(ids) == library.encode(text, add_special_tokens=False).ids
        assert own.decode(own.listed(ids)) == text


def test_bpe_in_small_parts_that_keep_little(docs, rows):
    """Parts and a memo that is cut between partitions change no row, and little is kept."""
    import pyarrow as pa

    want = Counter(map(tuple, bpe.bpe_digests(docs, registry.vocabulary()).collect()))
    assert Counter(map(tuple, bpe.bpe_digests(docs, registry.vocabulary(), part=64, lean=True).collect())) == want
    texts = pa.RecordBatch.from_pydict({"text": pa.array([t for _, t in rows], pa.string())})
    cut = list(common.parts(texts, 0, 300))
    assert pa.Table.from_batches(cut).column(0).to_pylist() == [t for _, t in rows]
    size = lambda b: [len((t or "").encode()) for t in b.column(0).to_pylist()]
    assert len(cut) > 5 and all(sum(size(b)) <= 300 or b.num_rows == 1 for b in cut)
    own = bpe.TrieBpe(registry.vocabulary(), memo=100)
    texts = [t for _, t in rows]
    once = list(own.encode_batch(texts))
    own.rest(10)
    assert len(own.chunks) + len(own.old) <= 10 and list(own.encode_batch(texts)) == once


def test_token_files(docs, rows, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(registry.vocabulary())
    got = tokenfile.token_file_digests(docs, registry.vocabulary()).orderBy("start").collect()
    ids = {(i, t): library.encode(t or "", add_special_tokens=False).ids + [0] for i, t in rows}
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, len(ids[i, t]), crc(ids[i, t])) for i, t in rows)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    assert tokenfile.token_file_digests(none, registry.vocabulary()).count() == 0


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000])
def test_coder_round_trip(n):
    r = np.random.default_rng(n)
    for ids in (r.integers(0, 50257, n), r.integers(0, 3, n), np.full(n, 50256), (r.pareto(1, n) * 5).astype(np.int64) % 50257, r.integers(0, 1 << 32, n)):
        prior, blocks = tokenfile.pack(ids.astype(np.int64), 64)
        assert (tokenfile.unpack(prior, blocks) == ids).all()
    if n:
        prior, [(k, crc, data)] = tokenfile.pack(np.arange(n), 1000)
        with pytest.raises(ValueError, match="damaged"):
            tokenfile.unpack(prior, [(k, crc ^ 1, data)])


def test_coder_holds_many_ids_and_states_its_bound():
    ids = np.random.default_rng(0).permutation(90_000).astype(np.int64) * 40_000
    assert (tokenfile.unpack(*tokenfile.pack(ids)) == ids).all()
    for bad in (1 << 32, -1):
        with pytest.raises(ValueError, match="4294967295"):
            tokenfile.pack(np.array([5, bad]))


def test_damaged_blocks_are_found():
    ids = np.random.default_rng(0).integers(0, 300, 5000)
    prior, blocks = tokenfile.pack(ids, 1000)
    for at in (0, 5, 100, 900):
        k, crc, data = blocks[1]
        broken = data[:at] + bytes([data[at] ^ 0x41]) + data[at + 1 :]
        with pytest.raises(ValueError, match="damaged"):
            tokenfile.unpack(prior, [blocks[0], (k, crc, broken), *blocks[2:]])


def test_coder_learns():
    ids = np.tile(np.array([5, 900, 17, 40000]), 1000)
    prior, blocks = tokenfile.pack(ids)
    assert len(prior) + sum(len(d) for _, _, d in blocks) < 400


def test_coder_beats_zlib_and_entropy_on_documents():
    """On the ids of documents, with the prior's bytes: less than zlib on each block, and less
    than the order-0 entropy of all ids."""
    import duckdb
    import pyarrow as pa

    rows = duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet' order by doc_id").fetchall()
    ids, _ = tokenfile.WordTokens(registry.vocabulary()).encode(pa.array([r[0] for r in rows]))
    ids = ids.astype(np.int64)
    prior, blocks = tokenfile.pack(ids)
    ours = len(prior) + sum(len(d) + 12 for _, _, d in blocks)
    plain = sum(min(len(zlib.compress(ids[i : i + tokenfile.BLOCK].astype(kind).tobytes(), 9)) for kind in ("<u2", "<u4")) for i in range(0, len(ids), tokenfile.BLOCK))
    share = np.bincount(ids)[np.unique(ids)] / len(ids)
    assert ours < 0.85 * plain and ours * 8 < -(share * np.log2(share)).sum() * len(ids)


def test_word_tokens_on_odd_texts():
    import pyarrow as pa
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(registry.vocabulary())
    odd = ["", None, " ", "a", " a", "a ", "a  b c", "x\ny z", "\nq w", "w\n q", "<|endoftext|> a b", "a b<|endoftext|>", "é ñ 日本", "a\u00a0 b", "a b c"]
    for texts in (odd, odd[3:7], odd[:1], []):
        ids, ends = tokenfile.WordTokens(registry.vocabulary()).encode(pa.array(texts, pa.string()))
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == [library.encode(t or "", add_special_tokens=False).ids for t in texts] or not texts


def test_jvm_coder_writes_the_same_bytes(spark):
    from pyspark.sql import functions as F

    from sievefp.llm import jvm

    r = np.random.default_rng(3)
    cases = [r.integers(0, 50257, 9000), r.integers(0, 3, 5000), np.full(4097, 50256), r.integers(0, 1 << 32, 9000), np.tile(np.array([5, 900, 17, 40000]), 2000), np.array([(1 << 32) - 1, 0])]
    packed = [(ids.astype("<u4").tobytes(), *tokenfile.pack(ids.astype(np.int64))) for ids in cases]
    table = spark.createDataFrame([(bytearray(ids), bytearray(prior), bytearray(tokenfile.group(prior, blocks))) for ids, prior, blocks in packed], "ids binary, prior binary, data binary")
    code = jvm.function(spark, "TokenCoder")
    got = table.select(code("ids", "prior") == F.col("data"), code("data", F.lit(None).cast("binary")) == F.col("ids")).collect()
    assert [tuple(x) for x in got] == [(True, True)] * len(cases)
    for _, prior, blocks in packed:
        assert tokenfile.ungroup(tokenfile.group(prior, blocks)) == (prior, blocks)
    ids, prior, [(k, crc, data), *more] = packed[0]
    for at in (0, 5, 100, len(data) - 9):
        broken = data[:at] + bytes([data[at] ^ 0x41]) + data[at + 1 :]
        bad = spark.createDataFrame([(bytearray(tokenfile.group(prior, [(k, crc, broken), *more])),)], "data binary")
        with pytest.raises(Exception, match="block 0 is damaged"):
            bad.select(code("data", F.lit(None).cast("binary"))).collect()


def test_token_files_of_spark_are_read_without_it(docs, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(registry.vocabulary())
    files = tokenfile.write_token_files(docs, common.new_path(docs.sparkSession, "tokens"), registry.vocabulary())
    got = Counter()
    for f in files.collect():
        with open(f.path.removeprefix("file:"), "rb") as source:
            found = [(name, tuple(ids.tolist())) for name, ids in tokenfile.read_documents(source)]
        assert (len(found), sum(len(ids) for _, ids in found)) == (f.docs, f.tokens)
        got.update(found)
    assert got == Counter((None if i is None else str(i), (*library.encode(t or "", add_special_tokens=False).ids, 0)) for i, t in rows)


def test_token_groups_over_documents(spark, monkeypatch):
    """Documents that lie across groups of blocks, and files of several groups."""
    monkeypatch.setattr(tokenfile, "LANES", 2)
    import io

    r = np.random.default_rng(0)
    out = io.BytesIO()
    writer = tokenfile.Writer(out)
    want = [(str(i), r.integers(0, 900, n).tolist()) for i, n in enumerate((5, 20_000, 0, 3000, 8192, 1))]
    for name, ids in want:
        writer.add([name], [len(ids)], np.array(ids, np.int64))
    writer.close()
    assert len(list(tokenfile.read_groups(out))) == 4
    assert [(name, ids.tolist()) for name, ids in tokenfile.read_documents(out)] == want
    path = common.new_path(spark, "tokens") + ".tok"
    with open(path.removeprefix("file:"), "wb") as f:
        f.write(out.getvalue())
    files = spark.createDataFrame([(0, path, 6, 31198), (1, path, 6, 31198)], "part long, path string, docs long, tokens long")
    got = tokenfile.read_token_files(files).collect()
    starts = np.cumsum([0, *[len(ids) for _, ids in want] * 2])[:-1].tolist()
    assert sorted((r.start, r.n_tokens, r.id, r.ids_crc32) for r in got) == sorted((s, len(ids), name, zlib.crc32(np.array(ids, "<u4").tobytes())) for s, (name, ids) in zip(starts, want * 2))


def test_word_tokens_ask_the_library_for_joined_words():
    """Distinct words go to the library many at a time; marks behind words, a small memo and
    words that cannot be told apart by bytes change no id."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(registry.vocabulary())
    r = np.random.default_rng(0)
    word = lambda: "".join(r.choice(list("abcdefgh9é'-日"), r.integers(1, 8))) + r.choice(["", "", ".", ",", "!?", "...", "'s,", ":x;", "9.", "\u00a0"])
    texts = [" ".join(word() for _ in range(300)) for _ in range(30)]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for memo in (1_000_000, 10, 0):
        own = tokenfile.WordTokens(registry.vocabulary(), memo=memo)
        asked = []
        plain = own._ids
        own._ids = lambda x: asked.extend(x) or plain(x)
        for some in (texts[:10], texts[10:], texts):
            ids, ends = own.encode(pa.array(some))
            at = texts.index(some[0])
            assert [x.tolist() for x in np.split(ids, ends[:-1])] == want[at : at + len(some)]
    clean = [" ".join(f"w{i}x{j}." for j in range(100)) for i in range(64)]
    own = tokenfile.WordTokens(registry.vocabulary())
    asked = []
    plain = own._ids
    own._ids = lambda x: asked.extend(x) or plain(x)
    ids, ends = own.encode(pa.array(clean))
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [library.encode(t, add_special_tokens=False).ids for t in clean]
    assert len(asked) < 300  # 6,336 distinct words behind blanks: 99 texts, and 64 first words
    own.bytes_of[:] = 1
    assert own.encode(pa.array(["a new1 word2 here3"]))[0].tolist() == library.encode("a new1 word2 here3", add_special_tokens=False).ids


def test_brown(docs, rows, none, monkeypatch):
    monkeypatch.setattr(brown, "HEAD", 40)
    crc = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5
    counts = Counter()
    for i, t in rows:
        if crc(i) != 1:
            counts.update([*blank_words(t), None])
    total, distinct = sum(counts.values()), len(counts)
    want = []
    for i, t in rows:
        w = [*blank_words(t), None]
        want.append((str(i), crc(i) == 1, len(w), sum(counts[x] > 0 for x in w), round(sum(np.log10((counts[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in w), 6)))
    got = brown.score(docs).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == sorted(want)
    assert {r.train_tokens for r in got} == {total} and all(r.score < 0 for r in got)
    assert brown.score(none).count() == 0


def test_brown_score_is_brute_force(docs, rows, monkeypatch):
    """The score from the classes that training gives, by plain counts of words and classes."""
    monkeypatch.setattr(brown, "HEAD", 40)
    hashed = lambda w: int(brown.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]), brown._inside)[0][0])
    chunks = brown.stored(brown._chunks(docs, "doc_id", "text", 4), "chunks")
    vocabulary = brown.train(chunks, brown.stored(brown._vocabulary(chunks, 4), "vocabulary"), 4)
    known = {r["word"] & (2**64 - 1): (r["n"], r["class"]) for r in brown._words(vocabulary).collect()}
    kind = lambda w: known[w][1] if w in known else int(brown.spread(np.array([w], np.uint64))[0])
    sentences = [(i, [*map(hashed, blank_words(t)), brown.END]) for i, t in rows]
    steps, mass, members = Counter(), Counter(), Counter(k for _, k in known.values())
    for i, words in sentences:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1:
            kinds = [kind(w) for w in words]
            steps.update(zip([kind(brown.END), *kinds], kinds))
            mass.update(kinds)
    of = Counter(a for (a, _), n in steps.items() for _ in range(n))
    want = []
    for i, words in sentences:
        total, before = 0.0, kind(brown.END)
        for w in words:
            k = kind(w)
            total += np.log10((steps[before, k] + 0.5) / (of[before] + 0.5 * brown.CLASSES)) + np.log10((known.get(w, (0,))[0] + 0.5) / (mass[k] + 0.5 * (members[k] + 1)))
            before = k
        want.append((str(i), round(total, 5)))
    assert sorted((str(r.doc_id), round(r.score, 5)) for r in brown.score(docs).collect()) == sorted(want)


def test_brown_classes_belong_to_words(spark, monkeypatch):
    """Words are parted by what they stand beside, also where their hashes agree in the low
    bits, and where they are too rare for the words that move one after another."""
    low = {}
    for i in range(4000):  # many pairs of one word of each kind that agree in 14 bits
        for kind in "ab":
            word = f"{kind}{i}"
            low.setdefault(int(brown.word_hashes(np.frombuffer(word.encode(), np.uint8), np.array([0, len(word)]), brown._inside)[0][0]) & (brown.SLOTS - 1), {})[kind] = word
    pairs = [(x["a"], x["b"]) for x in low.values() if len(x) == 2][:200]
    assert len(pairs) == 200
    r = np.random.default_rng(1)
    of = lambda k: [pairs[i][k] for i in r.permutation(200)]
    texts = [" ".join(f"the {x} runs" for x in of(0)) if n % 2 else " ".join(f"to {x} it" for x in of(1)) for n in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for most in (6, 1 << 14):
        monkeypatch.setattr(brown, "HEAD", most)
        chunks = brown.stored(brown._chunks(docs, "doc_id", "text", 4), "chunks")
        vocabulary = brown.train(chunks, brown.stored(brown._vocabulary(chunks, 4), "vocabulary"), 4)
        classes = {np.uint64(r["word"] & (2**64 - 1)): r["class"] for r in brown._words(vocabulary).collect()}
        assert len(classes) == 405
        hashed = lambda w: brown.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]), brown._inside)[0][0]
        kinds = [{classes[hashed(p[k])] for p in pairs} for k in (0, 1)]
        assert not kinds[0] & kinds[1] and max(map(len, kinds)) <= 3


def test_exchange_parts_what_stands_apart():
    """Two sets of slots that only follow their own kind end in different classes."""
    before, after = np.zeros((brown.SLOTS, brown.CLASSES), np.int64), np.zeros((brown.SLOTS, brown.CLASSES), np.int64)
    for s in range(20):
        before[s, s % 2], after[s, s % 2] = 50, 50
    classes = brown.exchange(before, after, np.arange(brown.SLOTS) % 3)
    assert not set(classes[0:20:2]) & set(classes[1:20:2])
