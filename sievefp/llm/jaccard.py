"""N-gram Jaccard self-join: documents whose sets of word shingles are similar.

Sets are ordered rarest shingle first, by counts over all documents in two tables of fixed
size, one of shingles and one of words (whose slots many share: any order that all sets agree
on is right, a rarer-first one is fast).  Shingles that stand out from what a slot of their
table holds by chance come last, by how far they do; all others are as rare as their rarest
word.  Equal sets are one: they are told apart by 64-bit digests.  Two similar sets share a shingle among the first few of both (prefix
filter); a pair that shares one is looked at only if lengths (length filter) and the shared
shingle's places (positional filter) leave enough room for the overlap, and if the sizes of
the sets' parts in the hash range do (suffix filter).  Pairs are verified once each on the
whole sets, made again from the texts.

What is returned are components, so a pair whose documents are known to be connected need not
be verified: those near one another in the links found so far.  Of the documents that share a prefix shingle, each round compares one, the hub,
with all others and then leaves it out: the one with the fewest rarer shingles, which is the
one with the fewest changes where the others are its copies; shingles whose documents are connected, or of which
one document is left, drop out.  After HUB_ROUNDS all pairs of what is left that are still
between different components are verified.  A large group of near copies thus takes few
comparisons a document, and no link between components is missed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievefp.llm.common import SPACES, U64, byte_table, drop, fresh, mix, named, shuffles, slabs, stored, summed_counts, text_key, tidy, told, with_documents, word_hashes
from sievefp.llm.graph import components, labels

RARITY_SLOTS = 1 << 20
HUB_ROUNDS = 2
#: Parts of the hash range whose sizes bound an overlap.
PARTS = 64
_K = U64(0xD6E8FEB86659FD93)
_inside = byte_table(SPACES)


def _shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of size words, over the borders of texts too."""
    to = len(hashes) - size + 1
    rolled = hashes[:to].copy()
    for j in range(1, size):
        rolled = rolled * _K + hashes[j : to + j]
    return mix(rolled, size)


class Rarity:
    """Ranks of shingles, the rarest first: how far the slot of a shingle stands out in steps of
    two standard deviations of what chance would put there, then the count of its rarest word."""

    def __init__(self, words: np.ndarray, shingles: np.ndarray):
        self.words = np.minimum(words, (1 << 32) - 1).astype(np.uint32)
        usual = float(np.median(shingles))
        self.apart = np.clip((shingles - usual) / (2 * np.sqrt(usual) + 1), 0, 255).astype(np.uint8)

    def of(self, shingles: np.ndarray, rarest: np.ndarray) -> np.ndarray:
        return self.apart[(shingles & U64(len(self.apart) - 1)).astype(np.int64)].astype(U64) << U64(32) | rarest


def shingle_sets(column: pa.Array, size: int, rarity: Rarity | None = None):
    """The sorted distinct shingle hashes of each text, one array a row; with rarity, (hashes,
    the rank of each)."""
    for _, _, data, offsets in slabs(column):
        hashes, words = word_hashes(data, offsets, _inside)
        seen = None if rarity is None else rarity.words[(hashes & U64(len(rarity.words) - 1)).astype(np.int64)]
        if len(hashes) >= size:
            rolled = _shingles(hashes, size)
            if seen is not None:
                rarest = seen[: len(rolled)].copy()
                for j in range(1, size):
                    np.minimum(rarest, seen[j : len(rolled) + j], out=rarest)
                ranks = rarity.of(rolled, rarest)
        start = 0
        for n in words.tolist():
            if n >= size:
                own = slice(start, start + n - size + 1)
                if rarity is None:
                    yield np.unique(rolled[own])
                else:
                    found, first = np.unique(rolled[own], return_index=True)
                    yield found, ranks[own][first]
            elif n:
                value = hashes[start : start + 1]
                for j in range(1, n):
                    value = value * _K + hashes[start + j : start + j + 1]
                value = mix(value, n)  # the whole sequence, with its own seed for each length
                yield value if rarity is None else (value, rarity.of(value, seen[start : start + n].min(keepdims=True)))
            else:
                yield np.empty(0, U64) if rarity is None else (np.empty(0, U64), np.empty(0, U64))
            start += n


def _rarity(docs: DataFrame, text: str, size: int) -> Rarity:
    """How often words and shingles of each slot stand in all documents."""

    def count(batches):
        held, n = {"words": [], "shingles": []}, 0
        tally = lambda: {k: np.bincount(np.concatenate(v), minlength=RARITY_SLOTS) for k, v in held.items()}
        for batch in batches:
            for _, _, data, offsets in slabs(batch.column(0)):
                hashes, _ = word_hashes(data, offsets, _inside)
                held["words"].append((hashes & U64(RARITY_SLOTS - 1)).astype(np.int32))
                # those over the border of two texts count, too: they are few, and only ranks depend on it
                held["shingles"].append((_shingles(hashes, size) & U64(RARITY_SLOTS - 1)).astype(np.int32) if len(hashes) >= size else np.empty(0, np.int32))
                n += len(hashes)
                if n > 1 << 21:
                    yield tally()
                    held, n = {"words": [], "shingles": []}, 0
        if n:
            yield tally()

    sums = summed_counts(docs.select(named(text)), count, RARITY_SLOTS, ["words", "shingles"])
    return Rarity(sums["words"], sums["shingles"])


def least_overlap(n: int, percent: int) -> int:
    """The least number of a set's n members that a similar set must share."""
    return -(-n * percent // 100)


def _signatures(docs: DataFrame, rarity: Rarity, size: int, percent: int) -> DataFrame:
    """For docs (id, _key, text): id, _key, n, rid (a digest of the set; null if it is empty),
    prefix (its rarest shingles, rarest first) and parts (how many members fall in each part
    of the hash range).  prefix and parts are null where the task gave the same set before."""
    shared = docs.sparkSession.sparkContext.broadcast(rarity)

    def run(batches):
        before: set[int] = set()
        for batch in batches:
            n, digests, ends, prefix, parts = [], [], [], [np.empty(0, np.int64)], []
            at = 0
            for s, seen in shingle_sets(batch.column(2), size, shared.value):
                n.append(len(s))
                digest = int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else None
                digests.append(digest)
                if len(s) and digest not in before:
                    before.add(digest)
                    keep = len(s) - least_overlap(len(s), percent) + 1
                    prefix.append(s[np.lexsort((s, seen))[:keep]].view(np.int64))
                    ends.append(at)
                    at += keep
                    parts.append(np.minimum(np.bincount((s >> U64(58)).astype(np.int64), minlength=PARTS), 32767).astype(np.int16))
                else:
                    ends.append(None)
                    parts.append(None)
            lists = pa.ListArray.from_arrays(pa.array([*ends, at], pa.int32()), pa.array(np.concatenate(prefix)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digests, pa.int64()), lists, pa.array(parts, pa.list_(pa.int16()))],
                ["id", "_key", "n", "rid", "prefix", "parts"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(tidy(run), f"id {kind}, _key long, n long, rid long, prefix array<long>, parts array<short>")


def _bound(x: np.ndarray, y: np.ndarray, cuts: int = 16) -> int:
    """No more can be in both: the sum of the smaller parts when both are cut alike."""
    at = x[len(x) // cuts :: max(1, len(x) // cuts)]
    a = np.diff(np.searchsorted(x, at), prepend=0, append=len(x))
    b = np.diff(np.searchsorted(y, at), prepend=0, append=len(y))
    return int(np.minimum(a, b).sum())


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 |x and y| >= percent |x or y|, for sorted distinct arrays."""
    total = len(x) + len(y)
    enough = lambda both: 100 * both >= percent * (total - both)
    if not enough(_bound(x, y)):
        return False
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return enough(int((y[at] == x).sum()))


def _verified(docs: DataFrame, pairs: DataFrame, where: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar, from docs (id, _key, text) and where a set stands
    (rid, id, _key).  The texts of all b stream past that of their a, in shares of some
    hundred, so that no a gathers more than that in one place."""
    share = F.pmod(F.xxhash64("b"), F.greatest(F.lit(1), (F.col("many") / 256).cast("long")))
    many = pairs.groupBy("a").agg(F.count("*").alias("many"))
    dealt = pairs.join(many, "a").select("a", "b", share.alias("share"))
    own = dealt.select("a", "share").distinct().select("a", "share", F.col("a").alias("b"))
    roles = own.unionByName(dealt.select("a", "share", "b")).join(where, F.col("b") == F.col("rid"))
    roles = stored(roles.select("a", "share", (F.col("a") != F.col("b")).alias("other"), "b", F.col("id").alias("_wid"), F.col("_key").alias("_wkey")), "roles")
    texts = with_documents(docs, roles).select("a", "share", "other", "b", "text")
    spread = texts.repartition(shuffles(pairs.sparkSession), "a", "share").sortWithinPartitions("a", "share", "other")

    def run(batches):
        own = None
        for batch in batches:
            a, b = [], []
            for x, y, other, made in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(2).to_pylist(), shingle_sets(batch.column(4), size)):
                if not other:
                    own = made
                elif similar(own, made, percent):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    found = stored(spread.mapInArrow(tidy(run), "a long, b long").distinct(), "links")
    drop(roles)
    return found


def _roomy(n1, at1, n2, at2, percent: int):
    """Length and positional filters for a shingle at at1 of n1 and at2 of n2."""
    small, large = F.least(n1, n2), F.greatest(n1, n2)
    overlap = F.lit(1) + F.least(n1 - at1 - 1, n2 - at2 - 1)
    # with so much in both, the union is n1 + n2 - overlap
    return (small * 100 >= large * percent) & (overlap * 100 >= (n1 + n2 - overlap) * percent)


def _parts_agree(n1, parts1, n2, parts2, percent: int):
    """Suffix filter on part sizes: members of different parts differ, so the sizes' differences
    are a lower bound on what only one of the sets has."""
    apart = F.aggregate(F.zip_with(parts1, parts2, lambda a, b: F.abs(a.cast("int") - b.cast("int"))), F.lit(0), lambda s, d: s + d)
    overlap = F.floor((n1 + n2 - apart) / 2)
    return overlap * 100 >= (n1 + n2 - overlap) * percent


def _open(pairs: DataFrame, tried: DataFrame | None, shapes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that were not verified yet and that part sizes do not rule out."""
    pairs = pairs.distinct()
    pairs = pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")
    of = lambda p: shapes.select(F.col("rid").alias(p), F.col("n").alias(f"n_{p}"), F.col("parts").alias(f"parts_{p}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    return stored(both.filter(_parts_agree(F.col("n_a"), F.col("parts_a"), F.col("n_b"), F.col("parts_b"), percent)).select("a", "b").distinct(), "pairs")


def _connected(docs: DataFrame, signed: DataFrame, where: DataFrame, size: int, percent: int) -> DataFrame | None:
    """node, comp: the components of all rids that link with any other; None if none does."""
    given = signed.filter("prefix is not null")
    shapes = given.select("rid", "n", "parts")
    postings = given.select("rid", "n", F.posexplode("prefix").alias("at", "shingle"))
    common = stored(postings.groupBy("shingle").agg(F.min("rid").alias("lo"), F.max("rid").alias("hi")).filter("lo <> hi").select("shingle"), "shingles-shared")
    places = stored(postings.hint("merge").join(common, "shingle").select("rid", "n", "at", "shingle"), "places")
    drop(common)
    comp, tried, links = None, None, None
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    for step in range(HUB_ROUNDS + 1):
        here = places.select("rid", "n", "at", "shingle")
        if comp is None:
            here = here.withColumn("comp", F.col("rid"))
        else:
            here = here.join(comp.withColumnRenamed("node", "rid"), "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))
        hub = F.min(F.struct(F.col("at").alias("hub_at"), F.xxhash64("rid", F.lit(step)).alias("h"), F.col("rid").alias("hub"), F.col("n").alias("hub_n"), F.col("comp").alias("hub_comp")))
        hubs = here.groupBy("shingle").agg(hub.alias("x"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("shingle", "x.*").drop("h")
        met = stored(here.hint("merge").join(hubs, "shingle").filter("rid <> hub"), "met")
        drop(places)
        if step < HUB_ROUNDS:
            found = met.filter("comp <> hub_comp").filter(_roomy(F.col("n"), F.col("at"), F.col("hub_n"), F.col("hub_at"), percent)).select(*pair("rid", "hub"))
        else:  # all pairs of what is left, the hubs' among them
            everyone = met.select("shingle", "rid", "n", "at", "comp").unionByName(met.select("shingle", F.col("hub").alias("rid"), F.col("hub_n").alias("n"), F.col("hub_at").alias("at"), F.col("hub_comp").alias("comp")).distinct())
            other = everyone.select("shingle", F.col("rid").alias("rid2"), F.col("n").alias("n2"), F.col("at").alias("at2"), F.col("comp").alias("comp2"))
            fits = (F.col("rid") < F.col("rid2")) & (F.col("comp") != F.col("comp2")) & _roomy(F.col("n"), F.col("at"), F.col("n2"), F.col("at2"), percent)
            found = everyone.join(other, (everyone["shingle"] == other["shingle"]) & fits).select(*pair("rid", "rid2"))
        pairs = _open(found, tried, shapes, percent)
        if told(pairs):
            tried = pairs if tried is None else tried.unionByName(pairs)
            new = _verified(docs, pairs, where, size, percent)
            if told(new):
                links = new if links is None else links.unionByName(new)
                if step < HUB_ROUNDS:
                    drop(comp)
                    comp = stored(labels(links), "labels")
        places = met
        if not told(met):
            break
    drop(places, comp)
    return links if links is None else stored(components(links), "components")


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, _key, n_shingles, component_id for every row of docs.

    A document's set holds its distinct shingles of ``size`` words (ASCII-lower-cased, parted
    by ASCII white space); with fewer words the whole sequence is its only shingle.  Two link
    when 100 |x and y| >= percent |x or y|; component_id is the smallest id reachable.  Null,
    empty and blank texts have an empty set and link with nothing.  Rows that repeat an id
    are documents of their own; a null id counts as larger than all others.
    """
    plain = docs.select(named(id).alias("id"), text_key(text).alias("_key"), named(text).alias("text"))
    signed = stored(_signatures(plain, _rarity(docs, text, size), size, percent), "signatures")
    sets = signed.filter("rid is not null").groupBy("rid")
    where = stored(sets.agg(F.min(F.struct("id", "_key")).alias("one"), F.min("id").alias("least")).select("rid", "one.*", "least"), "sets")
    comp = _connected(plain, signed, where.select("rid", "id", "_key"), size, percent)
    if comp is None:
        by_set = where.select("rid", F.col("least").alias("component_id"))
    else:
        at = where.select("rid", "least").join(comp.withColumnRenamed("node", "rid"), "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))
        lowest = at.groupBy("comp").agg(F.min("least").alias("component_id"))
        by_set = stored(at.join(lowest, "comp").select("rid", "component_id"), "set-components")
        drop(comp, where)
    rows = stored(signed.select("id", "_key", "n", "rid"), "documents-signed")
    drop(signed)
    return rows.join(by_set, "rid", "left").select(
        F.col("id").alias(id), "_key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id")
    )


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, with its columns, that stay when of each component only the smallest
    id does.

    Rows without words all stay; of rows that repeat id and text one stays."""
    found = jaccard_components(docs, size, percent, id, text)
    key, sid, skey = fresh(docs, "_dkey", "_sid", "_skey")
    stay = found.filter((named(id).eqNullSafe(F.col("component_id"))) | (F.col("n_shingles") == 0)).select(named(id).alias(sid), F.col("_key").alias(skey)).distinct()
    keyed = docs.withColumn(key, text_key(text))
    joined = keyed.join(stored(stay, "staying"), named(id).eqNullSafe(named(sid)) & (named(key) == named(skey)), "left_semi")
    return joined.dropDuplicates([id, key]).drop(key)


#: DuckDB SQL of jaccard_components with three-word shingles at 90 percent, for small tables.
ORACLE = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\f\r]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[i + 1 : i + 3], ' ') as g
      from (select doc_id, w, unnest(range(0, greatest(len(w) - 2, least(len(w), 1)))) as i from d)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
e as (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * c >= 90 * (nx.n + ny.n - c)),
b as (select x, y from e union all select y, x from e),
r as (select doc_id as x, doc_id as y from d union select r.x, b.y from r join b on r.y = b.x)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, m.component_id
from d left join n using (doc_id) join (select x as doc_id, min(y) as component_id from r group by x) m using (doc_id)
"""
