"""Embedding near-duplicates by dual traversal of cover trees.

Unit vectors of cosine >= c are at most tau = sqrt(2 - 2 c) apart.  Equal vectors are one
point with a weight.  The upper tree is built in the DataFrame: a node of more than BLOCK
points chooses centres among a hashed share of its points and each point goes to the nearest
one, until nodes are blocks; a block that cannot be parted (its points are alike) is cut by
hash.  Inside a block, nested nets of halving radii cover its points; they are made once a
block.  Every node knows the true greatest distance from its centre to a point under it.

Both trees are descended at once: a pair of nodes whose centres are further apart than their
covering radii and tau is dropped with all below it; a pair of blocks that lies within tau as
a whole is linked as a whole; other block pairs descend through their nets and end in exact
double-precision cosines.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievefp.llm.common import named, stored, told
from sievefp.llm.graph import components

BLOCK = 2048
FAN = 64
RADII = (1.0, 0.5, 0.25, 0.125)
SLACK = 1e-9
#: Tables of nodes go to every task up to this many bytes, as their rows are in memory; beyond,
#: they are joined.
BROADCAST_BYTES = 32 << 20


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    values = column.flatten().cast(pa.float64()).to_numpy()
    return values.reshape(-1, size)


def _apart(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cosine, 0))


def _small(nodes: DataFrame, more: int = 0) -> DataFrame:
    """A stored table of nodes, to be broadcast if its rows, with more bytes in all, fit."""
    return F.broadcast(nodes) if 200 * told(nodes) + more <= BROADCAST_BYTES else nodes


def _split(points: DataFrame, big: DataFrame, level: int) -> DataFrame:
    """Children of the points (rid, vec, node) of the big nodes (node, size): rid, child."""
    inside = points.join(_small(big), "node")
    fan = F.least(F.lit(FAN), F.ceil(F.col("size") / BLOCK) + 1)
    share = (fan / F.col("size") * float(1 << 30)).cast("long")
    picked = inside.filter(F.pmod(F.xxhash64("rid", F.lit(level)), F.lit(1 << 30)) < share)
    # a node's centres are about FAN rows at most
    numbers = F.sum(F.aggregate("centres", F.lit(0).cast("long"), lambda s, c: s + F.size(c))).alias("numbers")
    centres = stored(picked.groupBy("node").agg(F.collect_list("vec").alias("centres")), "centres", numbers)
    joined = inside.join(_small(centres, 8 * (told(centres, "numbers") or 0)), "node").select("rid", "node", "vec", "centres")

    def nearest(batches):
        for batch in batches:
            nodes = batch.column(1).to_pylist()
            out = np.zeros(batch.num_rows, np.int64)
            lists = batch.column(3)
            order = np.argsort(np.array(nodes, dtype=object).astype(str), kind="stable")
            vecs = batch.column(2).take(pa.array(order))
            names = [nodes[i] for i in order]
            start = 0
            while start < len(names):
                stop = start
                while stop < len(names) and names[stop] == names[start]:
                    stop += 1
                mine = vecs.slice(start, stop - start)
                size = len(mine[0])
                c = unit(np.array(lists[int(order[start])].as_py(), dtype=np.float64).reshape(-1, size))
                out[order[start:stop]] = np.argmax(unit(_matrix(mine, size)) @ c.T, axis=1)
                start = stop
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], ["rid", "node", "part"])

    parted = stored(joined.mapInArrow(nearest, "rid long, node string, part long"), "parted")
    sizes = parted.groupBy("node", "part").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("node").agg(F.max("n").alias("most"), F.sum("n").alias("all"))
    # where one child keeps nearly all, centres do not part the node: it is cut by hash
    alike = stored(largest.select("node", (F.col("most") > 0.9 * F.col("all")).alias("alike"), F.ceil(F.col("all") / BLOCK).alias("cuts")), "alike")
    cut = F.concat(F.lit("h"), F.pmod(F.xxhash64("rid", F.lit("cut")), F.col("cuts")).cast("string"))
    child = F.concat("node", F.lit("/"), F.when(F.col("alike"), cut).otherwise(F.col("part").cast("string")))
    return parted.join(_small(alike), "node").select("rid", child.alias("child"))


def _tree(points: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(rid, vec, weight, node) with the block of each point; (parent, child) of each level."""
    at = points.withColumn("node", F.concat(F.lit("d"), F.size("vec").cast("string")))
    levels = []
    for level in range(40):
        sizes = at.groupBy("node").agg(F.count("*").alias("size"))
        big = stored(sizes.filter((F.col("size") > 2 * BLOCK) & ~F.col("node").rlike("/h[0-9]+$")), "big")
        if big.isEmpty():
            break
        moved = stored(_split(at, big, level), "moved")
        new = stored(at.join(moved, "rid", "left").withColumn("to", F.coalesce("child", "node")).drop("child"), "points")
        levels.append(stored(new.select(F.col("node").alias("parent"), F.col("to").alias("child")).distinct(), "children"))
        at = new.drop("node").withColumnRenamed("to", "node")
    return at, levels


class Nets:
    """Nested nets of halving radii over the points of a block.

    Each level has nodes (points), the node of the level above that each lies under, the node
    of each point, and each node's covering radius: the greatest distance to a point under it.
    A node's points all lie under its own parent.  Levels that hardly group anything are left
    out."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
        self.levels = levels

    @classmethod
    def build(cls, x: np.ndarray) -> "Nets":
        levels, above = [], [np.arange(len(x))]
        for radius in RADII:
            nodes, parents, members, covers = [], [], [], []
            for parent, inside in enumerate(above):
                left = inside
                while len(left):
                    # the point that leads the parent leads its first child, too
                    d = _apart(x[left] @ x[left[0]])
                    near = d <= radius
                    nodes.append(int(left[0]))
                    parents.append(parent)
                    members.append(left[near])
                    covers.append(float(d[near].max()))
                    left = left[~near]
                if len(nodes) > max(1, len(x) // 4):
                    return cls(levels)
            own = np.zeros(len(x), np.int32)
            for node, under in enumerate(members):
                own[under] = node
            levels.append((np.array(nodes, np.int32), np.array(parents, np.int32), own, np.array(covers)))
            above = members
        return cls(levels)

    def data(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{f"{k}-{i}": part for k, level in enumerate(self.levels) for i, part in enumerate(level)})
        return out.getvalue()

    @classmethod
    def read(cls, data: bytes) -> "Nets":
        held = np.load(io.BytesIO(data))
        return cls([tuple(held[f"{k}-{i}"] for i in range(4)) for k in range(len(held.files) // 4)])


def _narrow(raw: np.ndarray) -> np.ndarray:
    """In single precision if nothing is lost."""
    with np.errstate(over="ignore"):
        single = raw.astype(np.float32)
    return single if (single == raw).all() else raw


def _points(data: bytes, rows: int, size: int) -> np.ndarray:
    kind = np.float32 if len(data) == 4 * rows * size else np.float64
    return unit(np.frombuffer(data, kind).reshape(rows, size))


_BLOCK = "node string, size long, centre array<double>, radius double, rids binary, weights binary, vecs binary, nets binary"


def _pack(key, table: pa.Table) -> pa.Table:
    table = table.sort_by("rid")
    rids, weights = table["rid"].to_numpy(), table["weight"].to_numpy()
    size = len(table["vec"][0])
    raw = _matrix(table["vec"].combine_chunks(), size)
    x = unit(raw)
    middle = x.mean(axis=0)
    centre = x[int(np.argmax(x @ middle))]
    radius = float(_apart(x @ centre).max())
    return pa.table(
        {"node": [key[0].as_py()], "size": [len(rids)], "centre": [centre.tolist()], "radius": [radius], "rids": [rids.tobytes()], "weights": [weights.tobytes()], "vecs": [_narrow(raw).tobytes()], "nets": [Nets.build(x).data()]}
    )


def _descend(x: np.ndarray, y: np.ndarray, own: Nets, other: Nets, tau: float):
    """(rows of x, columns of y) that dual descent through both nets leaves to compare: pairs
    of nodes that covering radii hold apart go, with all pairs below them."""
    near, last = np.ones((1, 1), bool), None
    for (na, pa_, own_a, cover_a), (nb, pb, own_b, cover_b) in zip(own.levels, other.levels):
        near = near[pa_][:, pb] & (_apart(x[na] @ y[nb].T) <= cover_a[:, None] + cover_b[None] + tau + SLACK)
        last = own_a, own_b
        if not near.any():
            return
    if last is None:
        yield np.arange(len(x)), np.arange(len(y))
        return
    own_a, own_b = last
    order_a, order_b = np.argsort(own_a, kind="stable"), np.argsort(own_b, kind="stable")
    ends = np.searchsorted(own_a[order_a], np.arange(len(near) + 1))
    # nodes with the same partners are compared together
    kinds, which = np.unique(near, axis=0, return_inverse=True)
    for kind, partners in enumerate(kinds):
        if partners.any():
            rows = np.concatenate([order_a[ends[i] : ends[i + 1]] for i in np.flatnonzero(which.ravel() == kind)])
            yield rows, order_b[partners[own_b[order_b]]]


def _compare(x: np.ndarray, y: np.ndarray, own: Nets, other: Nets, cosine: float, same: bool):
    """(row, column) of all links between x and y; with same, both are one block."""
    tau = float(np.sqrt(2 - 2 * cosine))
    at_r, at_c = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for rows, cols in _descend(x, y, own, other, tau):
        for start in range(0, len(rows), 1024):
            some = rows[start : start + 1024]
            linked = x[some] @ y[cols].T >= cosine
            if same:
                linked &= some[:, None] != cols[None]
            r, c = np.nonzero(linked)
            at_r.append(some[r])
            at_c.append(cols[c])
    return np.concatenate(at_r), np.concatenate(at_c)


def _forest(r: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """A label for each of n points: the least point its links (r, c) lead to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[r], label[c])
        new = label.copy()
        np.minimum.at(new, r, low)
        np.minimum.at(new, c, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


_FOUND = "rid long, links long, other long"


def _visit(cosine: float):
    tau = float(np.sqrt(2 - 2 * cosine))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                same = row["a_node"] == row["b_node"]
                a, b = np.frombuffer(row["a_rids"], np.int64), np.frombuffer(row["b_rids"], np.int64)
                wa, wb = np.frombuffer(row["a_weights"], np.int64), np.frombuffer(row["b_weights"], np.int64)
                apart = float(_apart(np.dot(row["a_centre"], row["b_centre"])))
                if apart + row["a_radius"] + row["b_radius"] <= tau - SLACK:  # all link with all
                    if same:
                        rid, links, other = a, wa.sum() - wa, np.full(len(a), a[0])
                    else:
                        rid = np.concatenate([a, b])
                        links = np.concatenate([np.full(len(a), wb.sum()), np.full(len(b), wa.sum())])
                        other = np.concatenate([np.full(len(a), b[0]), np.full(len(b), a[0])])
                else:
                    x = _points(row["a_vecs"], len(a), len(row["a_centre"]))
                    y = _points(row["b_vecs"], len(b), len(row["b_centre"]))
                    r, c = _compare(x, y, Nets.read(row["a_nets"]), Nets.read(row["b_nets"]), cosine, same)
                    if not len(r):
                        continue
                    if same:
                        links, ids = np.bincount(r, wb[c], len(a)).astype(np.int64), a
                        label = _forest(r, c, len(a))
                    else:
                        links = np.concatenate([np.bincount(r, wb[c], len(a)), np.bincount(c, wa[r], len(b))]).astype(np.int64)
                        ids = np.concatenate([a, b])
                        label = _forest(r, c + len(a), len(ids))
                    hit = links > 0
                    rid, links, other = ids[hit], links[hit], ids[label[hit]]
                yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(links), pa.array(other)], ["rid", "links", "other"])

    return run


def _far(a: str, b: str):
    return F.sqrt(F.aggregate(F.zip_with(f"{a}centre", f"{b}centre", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def _block_pairs(blocks: DataFrame, levels: list[DataFrame], tau: float) -> DataFrame:
    """(a, b), a <= b, of blocks that bounds do not part, by descending level by level."""
    shape = blocks.select("node", "centre", "radius")
    tiers = [shape]  # centre and radius of the nodes of each level, from the blocks up
    for step in reversed(levels):
        below = step.join(tiers[-1].withColumnsRenamed({"node": "child"}), "child")
        lead = below.groupBy("parent").agg(F.min_by("centre", "child").alias("up"))
        over = below.join(lead, "parent").groupBy("parent").agg(
            F.first("up").alias("centre"), F.max(F.sqrt(F.aggregate(F.zip_with("up", "centre", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)) + F.col("radius")).alias("radius")
        )
        tiers.append(stored(over.withColumnRenamed("parent", "node"), "tier"))
    pairs = tiers[-1].select(F.col("node").alias("a"), F.col("node").alias("b"))  # roots: one for each length of vectors
    for step, tier in zip(levels, tiers[-2::-1]):
        down = step.join(tier.withColumnRenamed("node", "child"), "child")
        left = down.select(F.col("parent").alias("a"), F.col("child").alias("na"), F.col("centre").alias("a_centre"), F.col("radius").alias("a_radius"))
        right = down.select(F.col("parent").alias("b"), F.col("child").alias("nb"), F.col("centre").alias("b_centre"), F.col("radius").alias("b_radius"))
        met = pairs.join(left, "a").join(right, "b").filter("a <> b or na <= nb")
        met = met.filter(_far("a_", "b_") <= F.col("a_radius") + F.col("b_radius") + tau + SLACK)
        pairs = stored(met.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct(), "node-pairs")
    return pairs


def near_vectors(vectors: DataFrame, cosine: float = 0.95, id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """id, n_links, component_id, kept of every row of vectors.

    Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing and are kept.  Vectors of different lengths do not link.  Rows that repeat an id
    are vectors of their own; a null id counts as larger than all others.
    """
    value = named(vec).cast("array<double>")
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    sound = F.coalesce((F.size(value) > 0) & finite & F.exists(value, lambda x: x != 0), F.lit(False))
    keyed = vectors.select(named(id).alias("id"), F.when(sound, F.xxhash64(value)).alias("h1"), F.when(sound, F.xxhash64(F.lit("second"), value)).alias("h2"), F.when(sound, value).alias("vec"))
    reps = keyed.filter("h1 is not null").groupBy("h1", "h2").agg(F.first("vec").alias("vec"), F.count("*").alias("weight"), F.min("id").alias("least"))
    reps = stored(reps.withColumn("rid", F.monotonically_increasing_id()), "vectors")
    at, levels = _tree(reps.select("rid", "vec", "weight"))
    blocks = stored(at.select("node", "rid", "vec", "weight").groupBy("node").applyInArrow(lambda key, rows: _pack(key, rows), _BLOCK), "blocks")
    pairs = stored(_block_pairs(blocks, levels, float(np.sqrt(2 - 2 * cosine))), "block-pairs")
    sided = lambda p: blocks.select(*[F.col(c).alias(f"{p}_{c}") for c in ("node", "centre", "radius", "rids", "weights", "vecs", "nets")])
    met = pairs.join(sided("a"), F.col("a") == F.col("a_node")).join(sided("b"), F.col("b") == F.col("b_node")).drop("a", "b")
    found = stored(met.mapInArrow(_visit(cosine), _FOUND), "links")
    degree = found.groupBy("rid").agg(F.sum("links").alias("links"))
    comp = components(found.filter("rid <> other").select(F.col("rid").alias("a"), F.col("other").alias("b")).distinct())
    both = reps.select("rid", "h1", "h2", "weight", "least").join(degree, "rid", "left").join(comp.withColumnRenamed("node", "rid"), "rid", "left")
    both = stored(both.withColumn("comp", F.coalesce("comp", "rid")), "components")
    lowest = both.groupBy("comp").agg(F.min("least").alias("component_id"))
    both = stored(both.join(lowest, "comp").select("h1", "h2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "by-vector")
    out = keyed.drop("vec").join(both, ["h1", "h2"], "left")
    out = out.select(F.col("id").alias(id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("h1").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col(id).eqNullSafe(F.col("component_id")))


#: DuckDB SQL of near_vectors over embeddings of 64 sound components each, for small tables.
ORACLE = """
with recursive v as (select vec_id, embedding::double[64] as e from embeddings),
l as (select a.vec_id as x, b.vec_id as y from v a join v b on a.vec_id <> b.vec_id and array_cosine_similarity(a.e, b.e) >= 0.95),
r as (select vec_id as x, vec_id as y from v union select r.x, l.y from r join l on r.y = l.x),
m as (select x, min(y) as component_id from r group by x),
n as (select x, count(*) as n from l group by x)
select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from v join m on m.x = vec_id left join n on n.x = vec_id
"""
