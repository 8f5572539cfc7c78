"""Words, hashes and shingles of whole texts, for the operators that read them in Arrow batches.

A word is a run of bytes other than space and \\t-\\r. bytes.split() cuts at exactly those, and bytes.lower() lowers
exactly A-Z, so UTF-8 texts are handled as bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

U = np.uint64
GOLDEN = 0x9E3779B97F4A7C15
#: Bytes of text that are taken apart at once; a longer text is taken alone and whole.
SLICE_BYTES = 1 << 20


def as_bytes(column: str) -> Column:
    """The text as UTF-8 bytes; null is the empty text."""
    return F.coalesce(F.col(column).cast("string").cast("binary"), F.lit(b""))


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id long, text binary): all that an operator reads of a table, whatever else it holds."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(text_col).alias("text"))


def slices(batches: Iterator[pa.RecordBatch], column: int = 1, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a slice holds one row or at most so many bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        held = batch.column(column)
        wide = pa.types.is_large_string(held.type) or pa.types.is_large_binary(held.type)
        ends = np.frombuffer(held.buffers()[1], np.int64 if wide else np.int32)[held.offset :][: batch.num_rows + 1].astype(np.int64)
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + most, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop
    pa.default_memory_pool().release_unused()  # workers are used again by other stages


class Memory:
    """What a worker remembers of pieces of text: two generations of at most `most` entries, so that what recurs stays."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def recall(self, keys: list) -> list:
        """What is known of each key, None for the others."""
        out = list(map(self.young.get, keys))
        if self.old:
            old = self.old
            for i, v in enumerate(out):
                if v is None and (v := old.get(keys[i])) is not None:
                    out[i] = self.young[keys[i]] = v
        return out

    def keep(self, new: dict) -> None:
        if len(self.young) + len(new) > self.most:
            self.old, self.young = self.young, {}
        if len(new) <= self.most:
            self.young.update(new)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts in order, and where each text's words begin (one more at the end)."""
    words = [t.split() for t in texts]
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(w) for w in words], out=at[1:])
    return np.fromiter((h for w in words for h in map(xxhash.xxh3_64_intdigest, w)), U, int(at[-1])), at


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words, over text ends as well: callers keep those that lie in one text."""
    n = max(0, len(h) - k + 1)
    s = np.full(n, U(k * GOLDEN % 2**64))
    for j in range(k):
        s = (s ^ (s >> U(32))) * U(0xD6E8FEB86659FD93) + h[j : j + n]
    return mix(s)


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted distinct k-word shingles of each text as 64-bit hashes; fewer words than k are one shingle."""
    h, at = word_hashes(texts)
    all_of = windows(h, k)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        out.append(np.unique(all_of[a : b - k + 1]) if b - a >= k else windows(h[a:b], b - a) if b > a else np.empty(0, U))
    return out


def longs(parts: list[np.ndarray]) -> pa.Array:
    """A list<int64> array of unsigned 64-bit arrays."""
    at = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=at[1:])
    flat = np.concatenate(parts) if parts else np.empty(0, U)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat.view(np.int64)))
