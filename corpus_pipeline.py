"""A training corpus from raw documents: quality, line rules, near copies, repeated passages, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.llm import minhash, packing, quality, rules, substring
from lodestore.plans.staging import stage


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, doesn't predict as bad."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.with_score(docs, model, "__score").where(F.col("__score") >= quality.THRESHOLD).drop("__score")


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that keep enough after their failing lines are gone, without those lines."""
    good = rules.assess(docs).where("kept")
    now = {"text": F.col("cleaned"), "n_chars": F.length("cleaned").cast("long")}
    return good.select(*[now[c].alias(c) if c in now else F.col("row")[c].alias(c) for c in docs.columns])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id; of rows equal in id and text, one.

    Rows are told apart by a hash of id and text, so different texts under one id, or under none, stand for themselves.
    """
    keyed = docs.withColumn("__key", F.xxhash64("doc_id", "text"))
    ids = keyed.groupBy(F.col("__key").alias("doc_id")).agg(F.min("doc_id").alias("id"), F.count("*").alias("rows"))
    groups = minhash.near_duplicates(keyed, id_col="__key").dropDuplicates(["doc_id"]).join(ids, "doc_id")
    first = groups.groupBy("component_id").agg(F.min_by(F.struct("doc_id", "rows"), F.struct(F.col("id").isNull(), "id", "doc_id")).alias("f"))
    kept = stage(first.select(F.col("f.doc_id").alias("__key"), F.col("f.rows").alias("__rows")), "kept")
    once = keyed.join(kept.where("__rows = 1"), "__key", "left_semi")
    again = keyed.join(kept.where("__rows > 1"), "__key", "left_semi").dropDuplicates(["__key"])
    return once.unionByName(again).select(*docs.columns)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that stand elsewhere too."""
    out = substring.without_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality_stage), ("rules", rules_stage), ("near_dedup", near_dedup_stage), ("substring", substring_stage), ("packing", packing_stage)]

#: The classifier and the genetic packing aren't expressible in SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
