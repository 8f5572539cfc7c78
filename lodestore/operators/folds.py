"""Folds whose result depends on order, over groups of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _unit(v: np.ndarray) -> np.ndarray:
    length = float(np.sqrt(v @ v))
    return v / length if length else v


def _centroids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last centroid of each key, in sorted rows (key, vector): only the current key's mean and count are kept."""
    key, n, mean, done = None, 0, None, ([], [])
    schema = None
    for batch in batches:
        schema = schema or pa.schema([batch.schema.field(0).with_name("key"), ("centroid", pa.list_(pa.float64()))])
        values, ends = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(batch.column(1).value_lengths().to_numpy(zero_copy_only=False))
        for k, end, start in zip(batch.column(0).to_pylist(), ends.tolist(), [0, *ends[:-1].tolist()], strict=True):
            v = values[start:end]
            if n and k == key:
                mean, n = _unit((mean * n + v) / (n + 1)), n + 1
                continue
            if n:
                done[0].append(key)
                done[1].append(mean)
            key, n, mean = k, 1, _unit(v)
        if done[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(done, schema, strict=True)], schema=schema)
            done = ([], [])
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([key], schema.field(0).type), pa.array([mean], schema.field(1).type)], schema=schema)


def running_centroids(rows: DataFrame, key: str, order: list[str], vector: str) -> DataFrame:
    """(key, centroid) of rows with a vector each: a key's centroid after each vector in turn has been averaged in and the mean made a unit vector.

    Rows are dealt by key and sorted in their partitions, which spills; a task then carries one mean over its batches,
    so a key's number of vectors doesn't matter. Null vectors and keys are left out; a key's vectors are of one width.
    """
    t = rows.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    dealt = t.repartition("key").sortWithinPartitions("key", *[f"o{i}" for i in range(len(order))])
    return dealt.select("key", "v").mapInArrow(_centroids, f"key {rows.schema[key].dataType.simpleString()}, centroid array<double>").withColumnRenamed("key", key)
