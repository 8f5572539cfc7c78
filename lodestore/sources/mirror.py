"""Snapshots of a table as JSON with a digest and a generation, and the check of a reader."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.sources.commit import create_once, names, remove, text_of


def state_hash(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """sha256 of each group's rows as sorted JSON; groups are bounded entries of a snapshot, such as a stage's rules."""
    t = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("s"))
    return t.select(*by, F.sha2(F.to_json("s").cast("binary"), 256).alias("digest"), F.size("s").cast("long").alias("rows"))


#: Control characters whose escapes have a letter among their digits, which stands in lower case here.
LETTERED = ("000B", "000E", "000F", "001A", "001B", "001C", "001D", "001E", "001F")


def canonical_json(value: Column) -> Column:
    """JSON without blanks, fields in the order they have, nulls written, escapes with lower-case digits."""
    out = F.to_json(value, {"ignoreNullFields": "false"})
    for code in LETTERED:
        out = F.regexp_replace(out, rf"(?<!\\)((?:\\\\)*)\\u{code}", rf"$1\\u{code.lower()}")
    return out


def skeleton_hash(members: DataFrame, by: list[str]) -> DataFrame:
    """(by, digest, members): sha256 of each group's members (concept_id, body, breadth) as canonical JSON, in the order of the ids' UTF-16 code units. Groups are bounded: a skeleton's members."""
    row = F.struct(F.encode("concept_id", "UTF-16BE").alias("at"), F.struct(F.col("concept_id").alias("conceptId"), "body", "breadth").alias("m"))
    t = members.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["m"]).alias("s"))
    return t.select(*by, F.sha2(canonical_json(F.col("s")).cast("binary"), 256).alias("digest"), F.size("s").cast("long").alias("members"))


def _lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def table_digest(rows: DataFrame) -> str:
    """A digest of the whole table that doesn't depend on order: two sums of hashes of the rows as JSON, so that equal rows count, and the count."""
    return _digest(_lines(rows))


def _digest(lines: DataFrame) -> str:
    one, two = (F.sum(F.xxhash64("value", F.lit(i)).cast("decimal(20,0)")) for i in (1, 2))
    a, b, n = lines.agg(one, two, F.count("*")).first()
    return f"{int(a or 0) % 2**64:x}-{int(b or 0) % 2**64:x}-{n}"


def write_mirror(rows: DataFrame, path: str, generation: int) -> str:
    """Write a snapshot under a generation: written, unchanged (the content is there), stale (a later one is), or conflict (this one holds something else).

    Rows go to a folder of their own first. The header, a file named by the generation that tells folder and digest, is
    created only where there is none: of two writers of one generation one has it, and the other learns of it. Readers
    take the latest header, so they never see rows of another generation or a part of them.
    """
    spark, digest = rows.sparkSession, table_digest(rows)
    said = _verdict(header(spark, path), generation, digest)
    if said:
        return said
    folder = f"rows/{generation}-{uuid.uuid4().hex}"
    _lines(rows).write.text(f"{path}/{folder}")
    made = {"generation": generation, "digest": _digest(spark.read.text(f"{path}/{folder}")), "folder": folder}
    if made["digest"] == digest and create_once(spark, f"{path}/header/{generation:019d}.json", json.dumps(made)):
        return "written" if header(spark, path)["generation"] == generation else "stale"
    remove(spark, f"{path}/{folder}")
    if made["digest"] != digest:
        raise ValueError("the rows changed while they were written")
    return _verdict(header(spark, path), generation, digest) or "conflict"


def _verdict(have: dict | None, generation: int, digest: str) -> str | None:
    if have and have["generation"] > generation:
        return "stale"
    if have and have["digest"] == digest:
        return "unchanged"
    return "conflict" if have and have["generation"] == generation else None


def header(spark: SparkSession, path: str) -> dict | None:
    """The latest header."""
    held = names(spark, f"{path}/header")
    return json.loads(text_of(spark, f"{path}/header/{held[-1]}")) if held else None


def read_mirror(spark: SparkSession, path: str, schema: str, generation: int | None = None) -> tuple[str, DataFrame | None]:
    """fresh, stale (of an older generation than asked for), missing (no header) or damaged (rows are gone or don't have the header's digest), with the rows but for the last two."""
    have = header(spark, path)
    if not have:
        return "missing", None
    if not names(spark, f"{path}/{have['folder']}") or _digest(spark.read.text(f"{path}/{have['folder']}")) != have["digest"]:
        return "damaged", None
    rows = spark.read.schema(schema).json(f"{path}/{have['folder']}")
    return ("fresh" if generation is None or have["generation"] >= generation else "stale"), rows
