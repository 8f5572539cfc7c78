"""Clustering around centroids by equal-average equal-variance search, in exact integers."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestore.staging import stage

SIZE, CENTROIDS, ROUNDS, SCALE = 64, 40, 5, 256
#: Integer components must be smaller than this, so that squared distances of up to 128 components fit in 64 bits.
LARGEST = 1 << 27
#: Vectors that are searched for at once.
ROWS = 4096
#: Bounds are taken in double precision, so much wider than they are.
SLACK = 1e-9


class Codebook:
    """Centroids sorted by the sum of their components, with what the two inequalities need."""

    def __init__(self, centroids: np.ndarray):
        total = centroids.sum(1)
        self.order = np.argsort(total, kind="stable")
        self.x = centroids[self.order]
        self.total = total[self.order].astype(np.float64)
        self.spread = _spread(self.x)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """For each row of x the centroid's number and squared distance (ties: the smaller number), and how many distances were taken.

        With k components, sums S and lengths V of the deviations from the mean, the squared distance of two vectors is
        at least (S - S')²/k, and at least that plus (V - V')². Each row goes outward from its own sum, the nearer side
        first. Once the first bound exceeds the best distance, so it does for all that lie further out.
        """
        n, k, dim = len(x), len(self.x), x.shape[1]
        total, spread = x.sum(1).astype(np.float64), _spread(x)
        right = np.searchsorted(self.total, total)
        left = right - 1
        best, number = np.full(n, np.iinfo(np.int64).max), np.full(n, k, np.int64)
        alive, taken = np.arange(n), 0
        while len(alive):
            lo, hi = left[alive], right[alive]
            below = np.where(lo >= 0, total[alive] - self.total[np.maximum(lo, 0)], np.inf)
            above = np.where(hi < k, self.total[np.minimum(hi, k - 1)] - total[alive], np.inf)
            down = below <= above
            gap = np.minimum(below, above)
            bound = gap * gap / dim
            near = bound <= best[alive] * (1 + SLACK) + 1  # infinite where both sides are used up
            alive, down, bound = alive[near], down[near], bound[near]
            if not len(alive):
                break
            at = np.where(down, left[alive], right[alive])
            left[alive[down]] -= 1
            right[alive[~down]] += 1
            apart = spread[alive] - self.spread[at]
            near = bound + apart * apart * (1 - SLACK) <= best[alive] * (1 + SLACK) + 1
            rows, at = alive[near], at[near]
            away = x[rows] - self.x[at]
            distance, name = np.einsum("ij,ij->i", away, away), self.order[at]
            taken += len(rows)
            closer = (distance < best[rows]) | ((distance == best[rows]) & (name < number[rows]))
            best[rows[closer]], number[rows[closer]] = distance[closer], name[closer]
        return number, best, taken


def _spread(x: np.ndarray) -> np.ndarray:
    """The length of each row's deviation from its mean."""
    away = x - x.mean(1, dtype=np.float64)[:, None]
    return np.sqrt(np.einsum("ij,ij->i", away, away))


def integers(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """(vec_id, x array<long>): floor(scale * component) of the vectors with exactly `size` components, none null or not finite.

    Vectors with a component of LARGEST or more after scaling are left out too: their squared distances don't fit in a long.
    """
    raw = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("raw"))
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * scale) < LARGEST)
    return raw.where((F.size("raw") == size) & F.forall("raw", fine)).select("vec_id", F.transform("raw", lambda v: F.floor(v * scale)).alias("x"))


def first_centroids(kept: DataFrame, count: int = CENTROIDS, seed: int = 2) -> np.ndarray:
    """The `count` vectors with the smallest hex SHA-256 of seed and id, in that order; the same hash by components. A null id counts as no digits."""
    name: Column = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = kept.orderBy(name, "x").limit(count).select("x").collect()
    return np.array([r.x for r in rows], np.int64)


def _rows(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _sums(centroids: np.ndarray):
    def run(batches):
        """One row for each centroid a task has vectors of: how many, and the sums of their components."""
        book, dim = Codebook(centroids), centroids.shape[1]
        count, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            x = _rows(batch, dim)
            for a in range(0, len(x), ROWS):
                number, _, _ = book.nearest(x[a : a + ROWS])
                count += np.bincount(number, minlength=len(count))
                np.add.at(total, number, x[a : a + ROWS])
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(count[at]), pa.array(total[at].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    return run


def _placed(centroids: np.ndarray):
    def run(batches):
        book, dim = Codebook(centroids), centroids.shape[1]
        for batch in batches:
            x = _rows(batch, dim)
            for a in range(0, len(x), ROWS):
                number, distance, _ = book.nearest(x[a : a + ROWS])
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").slice(a, len(number)), pa.array(number.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return run


def moved(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floor(sum / count) of their vectors' components; those without vectors stay.

    Each task sends a row for each centroid, so a round's shuffle is tasks times centroids, however many vectors there
    are; the totals, in decimals, are one row a centroid on the driver.
    """
    dim = centroids.shape[1]
    parts = kept.mapInArrow(_sums(centroids), "cluster int, n long, total array<long>")
    sums = [F.sum(F.col("total")[k].cast("decimal(20,0)")).alias(f"t{k}") for k in range(dim)]
    out = centroids.copy()
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *sums).collect():
        out[r.cluster] = [int(r[f"t{k}"]) // r.n for k in range(dim)]
    return out


def cluster(vectors: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: int = 2, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row a kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Null vectors and those of another length or with a null or non-finite component aren't kept (see integers()).
    Rows with a null or repeated id are vectors of their own. Fewer vectors than centroids give as many centroids as
    there are vectors; none give no rows. Equal distances go to the smaller number. A sum of distances that doesn't fit
    in a long is null. Other columns aren't read. Integer vectors are staged once, and only counts, sums and the
    `count` centroids move between tasks and the driver.
    """
    kept = stage(integers(vectors, id_col, vec_col, size, scale), "integers")
    centroids = first_centroids(kept, count, seed)
    if not len(centroids):
        return kept.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = moved(kept, centroids)
    placed = stage(kept.mapInArrow(_placed(centroids), "vec_id long, cluster int, distance long"), "placed")
    per = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()
    whole = sum(int(r.s) for r in per)
    fits = lambda v: v if v < 1 << 63 else None
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(r.cluster, fits(int(r.s)), fits(whole), names[r.cluster]) for r in per]
    facts = kept.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_nearest(spark, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _op12_sql() -> str:
    """The rounds as a chain of tables: places(k) from centroids(k), centroids(k + 1) from both."""
    head = """with v as materialized (
  select row_number() over (order by vec_id) as r, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as x from embeddings
  where embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), l as materialized (select r, unnest(range(1, 65)) as i, unnest(x) as x from v
), c0 as materialized (
  select c, unnest(range(1, 65)) as i, unnest(x) as x from (select row_number() over (order by sha256('2:' || vec_id), vec_id) - 1 as c, x from v qualify c < 40)
)"""
    for k in range(ROUNDS + 1):
        head += f""", d{k} as materialized (select l.r, c.c, sum((l.x - c.x) * (l.x - c.x))::bigint as d from l join c{k} c on l.i = c.i group by 1, 2
), p{k} as materialized (select r, c, d from d{k} qualify row_number() over (partition by r order by d, c) = 1
)"""
        if k < ROUNDS:
            head += f""", m{k} as materialized (select p.c, l.i, sum(l.x)::bigint as s, count(*) as n from p{k} p join l on l.r = p.r group by 1, 2
), c{k + 1} as materialized (select c.c, c.i, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, c.x)::bigint as x from c{k} c left join m{k} m on m.c = c.c and m.i = c.i
)"""
    return (
        head
        + f""", name as (select c, sha256(string_agg(x::varchar, ',' order by i)) as centroid_sha256 from c{ROUNDS} group by 1)
select v.vec_id, p.c::int as cluster, p.d as distance, (sum(p.d) over (partition by p.c))::bigint as cluster_inertia, (sum(p.d) over ())::bigint as inertia, centroid_sha256
from p{ROUNDS} p join v on v.r = p.r join name on name.c = p.c
"""
    )


OP12_SQL = _op12_sql()
