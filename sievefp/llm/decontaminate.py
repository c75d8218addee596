"""Benchmark decontamination over a positional inverted index, in DataFrame operations only.

A first pass counts the benchmark's terms in the corpus.  Each window of benchmark words is
looked up from its rarest term: the index stores postings (term, document, position) of the
two rarest terms of every window; postings of the rarest, moved back by the term's offset in
the window, give possible starts, the second rarest term's postings are intersected with
them, and what is left is compared word by word with the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievefp.llm.common import drop, named, stored, text_key, told

#: A table of terms or windows is broadcast up to this many bytes, as its rows are in memory;
#: beyond it the same joins are shuffled ones.
BROADCAST_BYTES = 32 << 20
_ROW_BYTES = 64
_UPPER = "".join(map(chr, range(65, 91)))


def words(text: str) -> Column:
    """Words of ASCII digits, letters (lower-cased) and any non-ASCII character; null has none."""
    low = F.translate(F.coalesce(named(text), F.lit("")), _UPPER, _UPPER.lower())
    return F.regexp_extract_all(low, F.lit("([0-9a-z\\x{80}-\\x{10FFFF}]+)"), F.lit(1))


def _kept(df: DataFrame, name: str) -> DataFrame:
    """A stored table that knows the bytes of its rows in memory."""
    texts = [F.octet_length(c) for c, kind in df.dtypes if kind == "string"]
    texts += [F.octet_length(F.array_join(c, " ")) + 16 * F.size(c) for c, kind in df.dtypes if kind == "array<string>"]
    size = sum((F.coalesce(t, F.lit(0)) for t in texts), F.lit(_ROW_BYTES + 8 * len(df.columns)))
    return stored(df, name, F.coalesce(F.sum(size.cast("long")), F.lit(0)).alias("bytes"))


def _fits(df: DataFrame) -> bool:
    return told(df, "bytes") <= BROADCAST_BYTES


def _small(df: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """df, to be broadcast if its rows, or those of the stored table it is a part of, fit."""
    return F.broadcast(df) if _fits(source or df) else df


def item_windows(items: DataFrame, size: int, id: str, text: str) -> DataFrame:
    """item_id, win: size consecutive words, blank-joined; shorter items are one window."""
    listed = items.select(named(id).alias("item_id"), words(text).alias("w")).filter("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - size + 1))
    return listed.select("item_id", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, size), " "))).alias("win")).distinct()


def term_counts(docs: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """term, n: how often each wanted term stands in the corpus (terms it lacks are left out).
    A common term's occurrences are counted before anything is shuffled."""
    tokens = docs.select(F.explode(words(text)).alias("term"))
    if _fits(wanted):
        return tokens.join(F.broadcast(wanted), "term").groupBy("term").agg(F.count("*").alias("n"))
    return tokens.groupBy("term").agg(F.count("*").alias("n")).join(wanted, "term")


def postings(docs: DataFrame, wanted: DataFrame, id: str, text: str) -> DataFrame:
    """term, _id, _key, pos of every occurrence of the wanted terms."""
    tokens = docs.select(named(id).alias("_id"), text_key(text).alias("_key"), F.posexplode(words(text)).alias("pos", "term"))
    return tokens.join(_small(wanted), "term")


def _plans(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """win, terms and its two rarest (term, offset); windows with a term that never occurs go."""
    spots = windows.select("win", F.posexplode(F.split("win", " ")).alias("off", "term"))
    known = spots.join(counts, "term", "left").groupBy("win").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "off", "term"))).alias("by")
    )
    first, second = F.get("by", F.lit(0)), F.get("by", F.lit(1))
    return known.filter(F.get("by", F.lit(0))["n"] > 0).select(
        "win", F.split("win", " ").alias("terms"), first["term"].alias("term1"), first["off"].alias("off1"), second["term"].alias("term2"), second["off"].alias("off2")
    )


def _starts(docs: DataFrame, windows: DataFrame, id: str, text: str, slop: int) -> tuple[DataFrame, DataFrame]:
    """(possible starts (_id, _key, start, terms, win) after intersecting two lists, plans)."""
    wanted = _kept(windows.select(F.explode(F.split("win", " ")).alias("term")).distinct(), "terms")
    counted = stored(term_counts(docs, wanted, text), "terms-counted")
    plans = _kept(_plans(windows, counted), "windows-planned")
    rare = _kept(plans.select(F.explode(F.array("term1", "term2")).alias("term")).filter("term is not null").distinct(), "terms-rare")
    index = stored(postings(docs, rare, id, text), "postings")
    drop(wanted, counted, rare)
    from_rarest = index.join(_small(plans.withColumnRenamed("term1", "term"), plans), "term").select(
        "_id", "_key", "win", "terms", "term2", "off1", "off2", F.col("pos").alias("pos1"), (F.col("pos") - F.col("off1")).alias("start")
    )
    if slop == 0:
        from_rarest = from_rarest.filter("start >= 0")
    single = from_rarest.filter("term2 is null").select("_id", "_key", "win", "terms", "start", "pos1")
    other = index.select(F.col("_id").alias("_id2"), F.col("_key").alias("_key2"), F.col("pos").alias("pos2"), F.col("term").alias("t2"))
    near = F.col("start") + F.col("off2") == F.col("pos2")
    left = from_rarest.filter("term2 is not null")
    same = F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_key") == F.col("_key2")) & (F.col("term2") == F.col("t2"))
    if slop:
        # both lists in cells as wide as a match; a match's terms lie in neighbouring cells
        width = F.size("terms") + slop
        left = left.withColumn("cell", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: (F.col("pos1") / width).cast("int") + d))).withColumn("width", width)
        widths = _small(plans.filter("term2 is not null").select(F.col("term2").alias("t2"), (F.size("terms") + slop).alias("width2")).distinct(), plans)
        other = other.join(widths, "t2").withColumn("cell2", (F.col("pos2") / F.col("width2")).cast("int"))
        same = same & (F.col("cell") == F.col("cell2")) & (F.col("width") == F.col("width2"))
        near = (F.abs(F.col("pos1") - F.col("pos2")) < F.col("width")) & (F.col("pos1") != F.col("pos2"))
    both = left.join(other, same & near, "left_semi").select("_id", "_key", "win", "terms", "start", "pos1")
    return both.unionByName(single), plans


def phrase_matches(docs: DataFrame, items: DataFrame, size: int = 10, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """_id, _key, n_words, matches (array of win and start) for every document.

    A match is an occurrence of a window of size consecutive words of an item; an item of
    fewer words, but not none, is one window.  Null and empty texts have no words.  Rows that
    repeat id and text are one document: each such row is listed, with the same matches.
    """
    windows = stored(item_windows(items, size, item_id, item_text).select("win").distinct(), "windows")
    starts, _ = _starts(docs, windows, id, text, 0)
    found = starts.groupBy("_id", "_key").agg(F.collect_set(F.struct("win", "start")).alias("maybe"))
    found = stored(found, "starts").withColumnsRenamed({"_id": "_fid", "_key": "_fkey"})
    listed = docs.select(named(id).alias("_id"), text_key(text).alias("_key"), named(text).alias("_text"))
    both = listed.hint("merge").join(found, F.col("_id").eqNullSafe(F.col("_fid")) & (F.col("_key") == F.col("_fkey")), "left")
    both = both.withColumn("w", words("_text"))
    is_there = lambda m: F.slice(F.col("w"), m["start"] + 1, F.size(F.split(m["win"], " "))) == F.split(m["win"], " ")
    return both.select("_id", "_key", F.size("w").cast("long").alias("n_words"), F.filter("maybe", is_there).alias("matches"))


def proximity_matches(docs: DataFrame, items: DataFrame, size: int = 10, slop: int = 5, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """id, item_id, win: documents that hold all words of a window, each as often as the
    window has it, in any order within len(window) + slop consecutive words."""
    by_item = stored(item_windows(items, size, item_id, item_text), "windows")
    windows = stored(by_item.select("win").distinct(), "windows-distinct")
    starts, _ = _starts(docs, windows, id, text, slop)
    found = stored(starts.select("_id", "_key", "win", "pos1").distinct(), "near").withColumnsRenamed({"_id": "_fid", "_key": "_fkey"})
    found = found.groupBy("_fid", "_fkey").agg(F.collect_list(F.struct("win", "pos1")).alias("maybe"))
    listed = docs.select(named(id).alias("_id"), text_key(text).alias("_key"), named(text).alias("_text"))
    both = listed.join(found, F.col("_id").eqNullSafe(F.col("_fid")) & (F.col("_key") == F.col("_fkey"))).withColumn("w", words("_text"))

    def is_there(m):
        terms = F.split(m["win"], " ")
        width = F.size(terms) + slop
        around = F.sequence(F.greatest(F.lit(0), m["pos1"] - width + 1), m["pos1"])
        count = lambda a, t: F.size(F.filter(a, lambda x: x == t))
        holds = lambda s: F.forall(F.array_distinct(terms), lambda t: count(F.slice(F.col("w"), s + 1, width), t) >= count(terms, t))
        return F.exists(around, holds)

    hits = both.select("_id", F.explode(F.filter("maybe", is_there)).alias("m")).select("_id", F.col("m.win").alias("win")).distinct()
    return hits.join(by_item, "win").select(F.col("_id").alias(id), "item_id", "win").distinct()


def contamination(docs: DataFrame, items: DataFrame, size: int = 10, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, _key, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs.

    A document word inside any match is hit.  n_items counts distinct non-null item ids with
    a window that occurs.  Without items, or without words, nothing is hit.
    """
    cover = F.flatten(F.transform("matches", lambda m: F.sequence(m["start"], m["start"] + F.size(F.split(m["win"], " ")) - 1)))
    n_hit = F.when(F.size("matches") > 0, F.size(F.array_distinct(cover))).otherwise(0)
    wins = F.when(F.size("matches") > 0, F.array_distinct(F.transform("matches", lambda m: m["win"])))
    per_doc = stored(
        phrase_matches(docs, items, size, id, text, item_id, item_text).select("_id", "_key", "n_words", n_hit.cast("long").alias("n_hit"), wins.alias("wins")),
        "matched",
    )
    listed_windows = item_windows(items, size, item_id, item_text)
    ids = (
        per_doc.filter("wins is not null").select("_id", "_key", F.explode("wins").alias("win")).distinct()
        .join(_small(_kept(listed_windows, "items")), "win")
        .groupBy("_id", "_key").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
    )
    ids = stored(ids, "items-found").withColumnsRenamed({"_id": "_iid", "_key": "_ikey"})
    both = per_doc.hint("merge").join(ids, F.col("_id").eqNullSafe(F.col("_iid")) & (F.col("_key") == F.col("_ikey")), "left")
    listed = F.coalesce("ids", F.array().cast("array<string>"))
    return both.select(
        F.col("_id").alias("doc_id"), "_key", "n_words", "n_hit",
        F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


#: DuckDB SQL of contamination over documents and benchmark.
ORACLE = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as w from benchmark),
iw as (select distinct item_id, least(len(w), 10) as n, array_to_string(w[i + 1 : i + 10], ' ') as win
       from (select item_id, w, unnest(range(0, greatest(len(w) - 9, 1))) as i from b where len(w) > 0)),
dw as (select doc_id, i, n, array_to_string(w[i + 1 : i + n], ' ') as win
       from (select doc_id, w, n, unnest(range(0, greatest(len(w) - n + 1, 0))) as i from d, (select distinct n from iw))),
m as (select doc_id, i, dw.n, item_id from dw join iw using (win)),
h as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from m) group by doc_id),
t as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from m group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h using (doc_id) left join t using (doc_id)
"""
