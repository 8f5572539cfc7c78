"""Vectors as array columns: products, norms, centroids and checks, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(json: Column, width: int | None = None) -> Column:
    """A JSON array of finite numbers, of the width if one is given; null otherwise."""
    v = F.from_json(json, "array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(sound & (F.size(v) == width if width else F.lit(True)), v)


def fault(json: Column, width: int) -> Column:
    """Why a vector in JSON won't do: missing, no list of numbers, a value that isn't finite, or another width; null if it will."""
    v = F.from_json(json, "array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    listed = F.from_json(json, "array<string>")
    numbers = F.forall(listed, lambda x: x.isNull() | F.try_to_number(x, F.lit("S" + "9" * 15 + "D" + "9" * 15)).isNotNull() | x.rlike("^-?[0-9.]+([eE][-+]?[0-9]+)?$"))
    return F.when(json.isNull(), "missing").when(listed.isNull() | ~numbers, "container").when(v.isNull() | ~sound, "value").when(F.size(v) != width, "width")


def dot(a: Column, b: Column) -> Column:
    """Product over the shorter length, summed in double precision."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))


def normalised(v: Column) -> Column:
    """The unit vector; a zero vector stays zero."""
    n = F.coalesce(F.nullif(norm(v), F.lit(0.0)), F.lit(1.0))
    return F.transform(v, lambda x: x.cast("double") / n)


def is_zero(v: Column) -> Column:
    return F.forall(v, lambda x: x == 0)


def running_centroid(ordered: Column) -> Column:
    """The centroid after each vector in turn has been averaged in and the mean made a unit vector: depends on order."""
    first = F.transform(F.get(ordered, F.lit(0)), lambda x: x.cast("double"))
    start = F.struct(normalised(first).alias("v"), F.lit(1).alias("n"))

    def step(acc: Column, v: Column) -> Column:
        mean = F.zip_with(acc["v"], v, lambda x, y: (x * acc["n"] + y) / (acc["n"] + 1))
        return F.struct(normalised(mean).alias("v"), (acc["n"] + 1).alias("n"))

    return F.aggregate(F.slice(ordered, F.lit(2), F.greatest(F.size(ordered) - 1, F.lit(0))), start, step, lambda acc: acc["v"])


def merged_centroid(a: Column, na: Column, b: Column, nb: Column) -> Column:
    """Support-weighted mean of two centroids as a unit vector; no support counts as one."""
    total = F.coalesce(F.nullif(na + nb, F.lit(0)), F.lit(1))
    return normalised(F.zip_with(a, b, lambda x, y: (x * na + y * nb) / total))
