"""Exports of a store: markdown topics with an index, JSON rows, and a manifest of digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.functions.text import redact, slug, summary


def topics(concepts: DataFrame) -> DataFrame:
    """(topic, markdown) of each component's concepts (component, title, body), by title; an `# ` heading each."""
    part = F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), F.coalesce("body", F.lit("")), F.lit("\n"))
    t = concepts.groupBy("component").agg(F.array_sort(F.collect_list(F.struct("title", part.alias("part")))).alias("p"))
    return t.select(F.concat_ws("-", slug(redact(F.col("p")[0]["title"])), "component").alias("topic"), F.array_join(F.transform("p", lambda x: redact(x["part"])), "\n").alias("markdown"))


def index(topic_rows: DataFrame) -> DataFrame:
    """(line) of an index: a link and a one-line summary for each topic."""
    return topic_rows.select(F.concat(F.lit("- ["), F.col("topic"), F.lit("]("), F.col("topic"), F.lit(".md): "), summary(F.regexp_replace("markdown", "^# [^\n]*\n\n", ""))).alias("line"))


def chunks(topic_rows: DataFrame) -> DataFrame:
    """(topic, n, text): sections at headings; a topic without one is cut at blank lines."""
    cut = F.when(F.col("markdown").rlike("(?m)^# "), F.split("markdown", "(?m)(?=^# )")).otherwise(F.split("markdown", "\n\\s*\n"))
    t = topic_rows.select("topic", F.posexplode(F.filter(cut, lambda x: F.trim(x) != "")).alias("n", "text"))
    return t.withColumn("text", F.trim("text"))


def write(topic_rows: DataFrame, path: str) -> None:
    topic_rows.select("markdown", "topic").write.mode("overwrite").partitionBy("topic").text(f"{path}/topics")
    index(topic_rows).sort("line").coalesce(1).write.mode("overwrite").text(f"{path}/index")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha256, bytes) of every file under a path."""
    t = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return t.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def unverified(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """Manifest rows that no file under the path meets."""
    return expected.join(manifest(spark, path), ["file", "sha256", "bytes"], "left_anti")
