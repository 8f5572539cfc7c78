"""Exact cosine-threshold links between vectors by cover trees: nested levels of halving radii and a dual traversal."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestore.operators.components import connected_components
from lodestore.plans.staging import stage

THRESHOLD = 0.9
#: Vectors of one leaf block, sampled vectors that the upper tree is built from, and its leaves at most.
BLOCK, SAMPLE, CELLS = 2048, 8192, 2048
#: Node pairs of at most this many vectors a side are compared by one matrix product.
DIRECT = 256
#: Slack of the bounds for rounding, in chord distance.
SLACK = 1e-6


def chord(cosine: float) -> float:
    """The distance of unit vectors at this cosine; what a metric tree can bound."""
    return float(np.sqrt(max(0.0, 2 - 2 * cosine)))


def unit(flat: np.ndarray, n: int) -> np.ndarray:
    x = flat.reshape(n, -1).astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def nested_centres(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Farthest-first centres and the distance at which each came in: those that came in above a radius are that level's net."""
    near = np.full(len(x), np.inf)
    picked, radius, at = [], [], 0
    for _ in range(min(most, len(x))):
        picked.append(at)
        radius.append(near[at])
        near = np.minimum(near, np.sqrt(np.maximum(2 - 2 * (x @ x[at]), 0)))
        at = int(near.argmax())
        if near[at] <= SLACK:
            break
    return x[picked], np.array(radius)


class Node:
    """Vectors `members` within `radius` of `centre`, and finer nodes that share them out."""

    __slots__ = ("children", "centre", "members", "radius")

    def __init__(self, members: np.ndarray, centre: np.ndarray, radius: float, children: list):
        self.members, self.centre, self.radius, self.children = members, centre, radius, children


def grow(x: np.ndarray, members: np.ndarray, centre: np.ndarray) -> Node:
    """A cover tree: each level's centres lie apart by half the radius above, and cover what is theirs by its own radius.

    A node that would break up into nearly single vectors, or is small, stays a leaf.
    """
    far = np.sqrt(np.maximum(2 - 2 * (x[members] @ centre), 0))
    node = Node(members, centre, float(far.max(initial=0)), [])
    if len(members) <= DIRECT or node.radius <= 4 * SLACK:
        return node
    half, left, nets = node.radius / 2, members, []
    while len(left):
        if len(nets) > 16:
            break
        d = np.sqrt(np.maximum(2 - 2 * (x[left] @ x[left[0]]), 0))
        nets.append((left[0], left[d <= half]))
        left = left[d > half]
    if len(left) > len(members) // 2:
        return node
    node.children = [grow(x, m, x[c]) for c, m in nets]
    if len(left):
        node.children.append(Node(left, centre, float(far[np.isin(members, left)].max()), []))
    return node


class Links:
    """Link counts by weight and a running union of two sides' vectors."""

    def __init__(self, x: tuple, y: tuple, same: bool, cosine: float):
        (self.x, self.wx, self.idx), (self.y, self.wy, self.idy) = x, y
        self.same, self.cosine = same, cosine
        self.reach = chord(cosine)
        self.nx, self.ny = np.zeros(len(self.x), np.int64), np.zeros(len(self.y), np.int64)
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []

    def visit(self, a: Node, b: Node) -> None:
        """Dual traversal: apart for sure, linked for sure, or descend into the wider node; leaves are compared."""
        d = float(np.sqrt(max(0.0, ((a.centre - b.centre) ** 2).sum())))
        if d > a.radius + b.radius + self.reach + SLACK:
            return
        if d + a.radius + b.radius < self.reach - SLACK:
            self.all(a.members, b.members)
        elif self.same and a is b:
            if not a.children:
                self.compare(a.members, a.members)
            for i, c in enumerate(a.children):
                for e in a.children[i:]:
                    self.visit(c, e)
        elif a.children and (not b.children or a.radius >= b.radius):
            for c in a.children:
                self.visit(c, b)
        elif b.children:
            for c in b.children:
                self.visit(a, c)
        else:
            self.compare(a.members, b.members)

    def all(self, p: np.ndarray, q: np.ndarray) -> None:
        mine = self.same and p is q
        self.nx[p] += self.wy[q].sum()
        if mine:
            self.nx[p] -= self.wx[p]
        elif self.same:
            self.nx[q] += self.wx[p].sum()
        else:
            self.ny[q] += self.wx[p].sum()
        self.edges += [(self.idx[p], np.full(len(p), self.idy[q[0]])), (np.full(len(q), self.idx[p[0]]), self.idy[q])]

    def compare(self, p: np.ndarray, q: np.ndarray) -> None:
        mine = self.same and p is q
        for i in range(0, len(p), 1024):
            r = p[i : i + 1024]
            hit = self.x[r] @ self.y[q].T >= self.cosine
            if mine:
                hit[np.arange(len(r)), np.arange(i, i + len(r))] = False
            if not hit.any():
                continue
            rows, columns = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
            hit = hit[np.ix_(rows, columns)]
            self.nx[r[rows]] += hit @ self.wy[q[columns]]
            if not mine:
                (self.nx if self.same else self.ny)[q[columns]] += self.wx[r[rows]] @ hit
            # links enough to join what is linked: each row's and column's first, and each row's to the first row that it reaches
            label_r, label_c = np.arange(len(rows)), np.full(len(columns), len(rows))
            while True:
                new_c = np.minimum(label_c, np.where(hit, label_r[:, None], len(rows)).min(axis=0))
                new_r = np.minimum(label_r, np.where(hit, new_c[None], len(rows)).min(axis=1))
                if (new_c == label_c).all() and (new_r == label_r).all():
                    break
                label_c, label_r = new_c, new_r
            of_r, of_c = self.idx[r[rows]], self.idy[q[columns]]
            self.edges += [(of_r, of_r[label_r]), (of_r, of_c[hit.argmax(axis=1)]), (of_r[hit.argmax(axis=0)], of_c)]


def _block_pair(cosine: float):
    def run(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        side, ids, w = t.column("side").to_numpy(), t.column("id").to_numpy(), t.column("w").to_numpy()
        lists = t.column("x").combine_chunks()
        x = unit((lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists).flatten().to_numpy(zero_copy_only=False), len(t))
        p, q = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        same = not len(q)
        q = p if same else q
        links = Links((x[p], w[p], ids[p]), (x[q], w[q], ids[q]), same, cosine)
        a = grow(links.x, np.arange(len(p)), x[p[0]])
        links.visit(a, a if same else grow(links.y, np.arange(len(q)), x[q[0]]))
        n = np.concatenate([links.nx, [] if same else links.ny]).astype(np.int64)
        who = np.concatenate([ids[p], [] if same else ids[q]]).astype(np.int64)
        u, v = (np.concatenate([np.empty(0, np.int64), *(e[k] for e in links.edges)]) for k in (0, 1))
        edges = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)], axis=1), axis=0) if len(u) else np.empty((0, 2), np.int64)
        edges = edges[edges[:, 0] != edges[:, 1]]
        some = n > 0
        return pa.table({"id": np.concatenate([who[some], edges[:, 0]]), "n": np.concatenate([n[some], np.zeros(len(edges), np.int64)]), "peer": pa.array(np.concatenate([np.zeros(int(some.sum()), np.int64), edges[:, 1]]), mask=np.concatenate([np.ones(int(some.sum()), bool), np.zeros(len(edges), bool)]))})

    return run


def _cells(centres: np.ndarray):
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = unit(b.column(2).flatten().to_numpy(zero_copy_only=False), b.num_rows)
            s = x @ centres.T
            cell = s.argmax(axis=1)
            far = np.sqrt(((x - centres[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(cell.astype(np.int32)), pa.array(far)], names=["id", "w", "x", "cell", "far"])

    return run


def _upper_pairs(centres: np.ndarray, entered: np.ndarray, radius: np.ndarray, reach: float) -> list[tuple[int, int]]:
    """Pairs of leaf cells that the covering radii can't rule out, by descending the nested levels from the root pair.

    At a level of radius r its nodes are the centres that entered above r; a leaf hangs under the nearest of them, and
    a node's covering radius is measured over its leaves.
    """
    d = np.sqrt(np.maximum(2 - 2 * (centres @ centres.T), 0))
    r, pairs, up = 2.0, None, None
    while True:
        nodes = np.flatnonzero(entered > r)
        nodes = nodes if len(nodes) else np.array([0])
        of = nodes[d[:, nodes].argmin(axis=1)]
        if r < entered.min() or r < 0.05 or len(nodes) == len(centres):
            nodes = of = np.arange(len(centres))
        cover = np.zeros(len(centres))
        np.maximum.at(cover, of, d[np.arange(len(centres)), of] + radius)
        if pairs is None:
            u, v = np.meshgrid(nodes, nodes)
            pairs = np.stack([u.ravel(), v.ravel()], axis=1)
        else:
            children = {k: np.unique(of[up == k]) for k in np.unique(up)}
            pairs = np.unique(np.concatenate([np.stack([g.ravel() for g in np.meshgrid(children[a], children[b])], axis=1) for a, b in pairs.tolist()] or [np.empty((0, 2), np.int64)]), axis=0)
        pairs = pairs[d[pairs[:, 0], pairs[:, 1]] <= cover[pairs[:, 0]] + cover[pairs[:, 1]] + reach + SLACK]
        up = of
        if len(nodes) == len(centres):
            return [(a, b) for a, b in pairs.tolist() if a <= b]
        r /= 2


def links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; neither do vectors of
    different lengths, nor rows with a null id (kept, with a null component). Rows that repeat id and vector are one
    vector. Vectors of the same components become one class with a weight first, so copies cost no pairs.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("x"))
    sound = F.col("x").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    good = rows.where(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False))).distinct()
    classes = stage(good.groupBy("x").agg(F.min("vec_id").alias("id"), F.count("*").alias("w")).select("id", "w", "x"), "classes")
    found = None
    for (dim,) in classes.select(F.size("x")).distinct().collect():
        part = _pairs(classes.where(F.size("x") == dim), cosine, block)
        found = part if found is None else found.union(part)
    if found is None:
        found = classes.sparkSession.createDataFrame([], "id long, n long, peer long")
    found = stage(found, "found")
    n = found.groupBy("id").agg(F.sum("n").alias("n"))
    member = good.join(classes.select("x", "id", "w"), "x").select("vec_id", "id", "w")
    member = stage(member, "members")
    edges = found.where("peer is not null").select(F.col("id").alias("a"), F.col("peer").alias("b")).union(member.where("vec_id <> id").select("vec_id", "id"))
    label = connected_components(edges).withColumnRenamed("node", "vec_id")
    count = member.join(n, "id", "left").groupBy("vec_id").agg(F.sum(F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"))
    out = rows.select("vec_id").join(count, "vec_id", "left").join(label, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _pairs(classes: DataFrame, cosine: float, block: int) -> DataFrame:
    """(id, n, peer): weights of linked classes by class, and links enough to join all that are linked."""
    spark, n = classes.sparkSession, classes.count()
    some = classes.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("x").toArrow().column(0).combine_chunks()
    some = some.chunk(0) if isinstance(some, pa.ChunkedArray) else some
    centres, entered = nested_centres(unit(some.flatten().to_numpy(zero_copy_only=False), len(some)), max(1, min(CELLS, -(-n // block))))
    placed = stage(classes.mapInArrow(_cells(centres), f"id long, w long, x {classes.schema['x'].dataType.simpleString()}, cell int, far double"), "cells")
    size = {r[0]: (r[1], r[2]) for r in placed.groupBy("cell").agg(F.count("*"), F.max("far")).collect()}
    radius = np.array([size[c][1] if c in size else 0.0 for c in range(len(centres))])
    pairs = [(a, b) for a, b in _upper_pairs(centres, entered, radius, chord(cosine)) if a in size and b in size]
    split = [(c, -(-k // block)) for c, (k, _) in size.items()]
    cells = spark.createDataFrame(split, "cell int, parts int")
    placed = placed.join(F.broadcast(cells), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    wide = spark.createDataFrame([(a, b) for a, b in pairs], "a int, b int")
    parts_a, parts_b = cells.select(F.col("cell").alias("a"), F.col("parts").alias("na")), cells.select(F.col("cell").alias("b"), F.col("parts").alias("nb"))
    wide = wide.join(parts_a, "a").join(parts_b, "b").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("na") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    wide = wide.where("a < b or i <= j").select("a", "i", "b", "j", F.xxhash64("a", "i", "b", "j").alias("pair"))
    left = placed.join(wide.select(F.col("a").alias("cell"), F.col("i").alias("part"), "pair"), ["cell", "part"]).select("pair", F.lit(0).alias("side"), "id", "w", "x")
    right = placed.join(wide.where("a < b or i < j").select(F.col("b").alias("cell"), F.col("j").alias("part"), "pair"), ["cell", "part"]).select("pair", F.lit(1).alias("side"), "id", "w", "x")
    return left.union(right).groupBy("pair").applyInArrow(_block_pair(cosine), "id long, n long, peer long")


def op1_covertree(spark, sf_dir: str) -> DataFrame:
    return links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP1_SQL = """
with recursive v as (
  select vec_id, list_transform(embedding, lambda x: x::double) as x from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), u as (select vec_id, x, sqrt(list_dot_product(x, x)) as n from v
), e as (
  select a.vec_id as p, b.vec_id as q from u a join u b on a.vec_id <> b.vec_id and len(a.x) = len(b.x) and list_dot_product(a.x, b.x) >= 0.9 * a.n * b.n
), reach as (select vec_id as node, vec_id as root from u union select e.q, r.root from reach r join e on e.p = r.node
), comp as (select node, min(root) as c from reach group by 1
), deg as (select p, count(*) as n from e group by 1)
select d.vec_id, coalesce(deg.n, 0)::bigint as n_links, coalesce(comp.c, d.vec_id) as component_id, coalesce(comp.c, d.vec_id) = d.vec_id as kept
from embeddings d left join deg on deg.p = d.vec_id left join comp on comp.node = d.vec_id
"""
