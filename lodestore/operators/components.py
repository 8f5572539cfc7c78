"""Connected components of an edge table of any size."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestore.staging import stage, unstage


def _forest(batches):
    """Union-find over one partition's edges; emits (u, v) with v the smallest node that u reaches in it."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root.setdefault(top, top) != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    pairs = [(x, t) for x in list(root) if (t := find(x)) != x]
    for i in range(0, len(pairs), 100_000):
        part = pairs[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in part], pa.int64()), pa.array([p[1] for p in part], pa.int64())], names=["u", "v"])


#: Edges that one task may join by union-find (about 100 MB of nodes); more go through star rounds.
ONE_TASK = 400_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component) for every node of an edge whose component has two nodes or more, itself its smallest.

    Self-loops and null ends are ignored; an empty table gives an empty result. Each partition first contracts its
    edges to a forest by union-find (memory: the partition's nodes). Forests of at most `one_task` edges in all are joined
    by one more union-find; beyond that bound large-star and small-star rounds run until the edges stay as they are: O(log n) rounds, each two aggregations with map-side combine and two joins that AQE
    may split, so a hub node is never gathered in one task. The driver sees a count and a checksum a round.
    """
    pairs = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    now, before = stage(pairs.mapInArrow(_forest, "u long, v long"), "forest"), None
    if now.limit(one_task + 1).count() <= one_task:
        done = stage(now.coalesce(1).mapInArrow(_forest, "u long, v long"), "stars")
        unstage(now)
        return done.select(F.col("u").alias("node"), F.col("v").alias("component")).union(done.select("v", "v").distinct())
    for _ in range(max_rounds):
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).union(now.select("v", "u"))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stage(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).distinct()
        after = stage(small, "small-star")
        unstage(large)
        unstage(now)
        now = after
        mark = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if tuple(mark) == before:
            break
        before = tuple(mark)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
