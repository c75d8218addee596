"""Line dedup by overlapping three-line windows, in DataFrame operations only.

Every run of three consecutive lines is hashed; a window that occurs anywhere else in the
corpus keeps its first occurrence (smallest doc_id, then position), and the lines that later
occurrences cover are removed, overlapping ones merged.  A later occurrence that overlaps
its own first one in the same document leaves the lines of that first one alone, so that a
line repeated many times keeps one window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievefp.llm.common import drop, fresh, named, stored, text_key


def line_dedup(docs: DataFrame, text: str = "text", id: str = "doc_id", window: int = 3) -> DataFrame:
    """Every row of docs with its text after removal, and n_lines, n_removed (both long).

    Lines end at line feeds.  Texts of fewer lines than a window, null and empty ones stay
    as they are (a null text has no lines); windows of blank lines only are not counted.
    Rows that repeat id and text are one document and share its result; a null id sorts
    first.  A text whose lines all go becomes empty.  All other columns are kept, whatever
    their names; those called n_lines or n_removed are replaced.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed", text)]
    keyed = docs.select(named(id).alias("_id"), text_key(text).alias("_key"), F.split(named(text), "\n", -1).alias("_lines"))
    starts = F.sequence(F.lit(0), F.size("_lines") - window)
    joined = lambda i: F.array_join(F.slice(F.col("_lines"), i + 1, F.lit(window)), "\n")
    windows = (
        keyed.filter(F.size("_lines") >= window)
        .select("_id", "_key", F.posexplode(F.transform(starts, joined)).alias("_at", "_window"))
        .filter(F.col("_window").rlike(r"[^ \t\r\n]"))
        .select("_id", "_key", "_at", F.unhex(F.md5(F.col("_window").cast("binary"))).alias("_hash"))
    )
    repeated = stored(
        windows.groupBy("_hash")
        .agg(F.min(F.struct("_id", "_key", "_at")).alias("_first"), F.count("*").alias("_n"))
        .filter("_n > 1")
        .select("_hash", "_first"),
        "lines-repeated",
    )
    same = F.col("_id").eqNullSafe(F.col("_first._id")) & (F.col("_key") == F.col("_first._key"))
    # where the first occurrence ends, if it stands in the same document and overlaps
    after = F.when(same, F.greatest("_at", F.col("_first._at") + window)).otherwise(F.col("_at"))
    covered = (
        windows.join(repeated, "_hash")
        .filter(~(same & (F.col("_at") == F.col("_first._at"))))
        .select("_id", "_key", after.alias("_from"), (F.col("_at") + window).alias("_to"))
        .filter("_from < _to")
        .select("_id", "_key", F.explode(F.sequence("_from", F.col("_to") - 1)).alias("_line"))
        .groupBy("_id", "_key")
        .agg(F.sort_array(F.collect_set("_line")).alias("_lost"))
    )
    # a byte for each line up to the last that goes, so that looking one up takes no search
    run = lambda line, k: F.concat(F.repeat(F.lit("0"), line - F.coalesce(F.get("_lost", k - 1), F.lit(-1)) - 1), F.lit("1"))
    masks = covered.select("_id", "_key", F.size("_lost").alias("_many"), F.array_join(F.transform("_lost", run), "").cast("binary").alias("_gone"))
    gid, gkey, many, gone, key = fresh(docs, "_gid", "_gkey", "_many", "_gone", "_key")
    marked = stored(masks, "lines-gone").withColumnsRenamed({"_id": gid, "_key": gkey, "_many": many, "_gone": gone})
    drop(repeated)
    every = docs.withColumn(key, text_key(text))
    # always shuffled: the same plan at every size, with no broadcast that works for small corpora only
    matched = every.hint("merge").join(marked, named(id).eqNullSafe(named(gid)) & (named(key) == named(gkey)), "left")
    lines = F.split(named(text), "\n", -1)
    n = F.when(named(text).isNull(), 0).otherwise(F.size(lines))
    # the lambda takes each line and its place, so the text is split once
    rest = F.array_join(F.filter(lines, lambda line, i: named(gone).substr(i + 1, F.lit(1)) != F.lit(b"1")), "\n")
    return matched.select(
        *[named(c) for c in kept],
        F.when(named(gone).isNull(), named(text)).otherwise(rest).alias(text),
        n.cast("long").alias("n_lines"),
        F.coalesce(named(many), F.lit(0)).cast("long").alias("n_removed"),
    )


#: DuckDB SQL of line_dedup over the table documents: doc_id, n_lines, n_removed, text.
ORACLE = """
with l as (select doc_id, text, string_split(text, chr(10)) as ls from documents),
w as (select doc_id, i, array_to_string(ls[i + 1 : i + 3], chr(10)) as win
      from (select doc_id, ls, unnest(range(0, greatest(len(ls) - 2, 0))) as i from l)),
v as (select doc_id, i, md5(win) as h from w where regexp_matches(win, '[^ \\t\\r\\n]')),
f as (select h, doc_id as fd, i as fi from v
      qualify row_number() over (partition by h order by doc_id, i) = 1 and count(*) over (partition by h) > 1),
c as (select v.doc_id, unnest(range(case when v.doc_id = fd then greatest(v.i, fi + 3) else v.i end, v.i + 3)) as line
      from v join f using (h) where not (v.doc_id = fd and v.i = fi)),
g as (select doc_id, list(distinct line) as gone from c group by doc_id),
k as (select l.doc_id, string_agg(l.ls[n + 1], chr(10) order by n) as rest
      from (select doc_id, ls, unnest(range(0, len(ls))) as n from l where doc_id in (select doc_id from g)) l
      join g using (doc_id) where not list_contains(g.gone, l.n) group by l.doc_id)
select l.doc_id, case when l.text is null then 0 else len(l.ls) end::bigint as n_lines,
       coalesce(len(g.gone), 0)::bigint as n_removed,
       case when g.gone is null then l.text else coalesce(k.rest, '') end as text
from l left join g using (doc_id) left join k using (doc_id)
"""
