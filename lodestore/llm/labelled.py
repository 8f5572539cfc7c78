"""Bounded samples of labelled documents, for the models that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestore.llm.text import as_bytes

#: Texts above this many bytes aren't learned from (they are scored whole).
LONGEST = 200_000


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text has the remainder; a null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == remainder, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, each: tuple[int, int], id_col: str = "doc_id", text_col: str = "text") -> tuple[list[bytes], list[int]]:
    """Texts and labels of at most each[label] training rows of either label, the first by a hash of the id.

    Rows whose label is neither 0 nor 1 and texts longer than LONGEST are left out. An id with both labels counts as 1;
    of an id's texts the least is taken, in the tasks that hold them. At most sum(each) ids are broadcast and as many
    texts come to the driver.
    """
    train = labels.where(~held_out(id_col, modulus, remainder) & F.col(label).isin(0, 1)).select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    train = train.groupBy("doc_id").agg(F.max("label").alias("label"))
    ids = [train.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each[v]) for v in (0, 1)]
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(text_col).alias("text")).where(F.length("text") <= LONGEST)
    one = texts.join(F.broadcast(ids[0].union(ids[1])), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    rows = one.select("doc_id", "text", "label").toArrow()
    rows = sorted(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(2).to_pylist(), strict=True))
    return [t for _, t, _ in rows], [v for *_, v in rows]
