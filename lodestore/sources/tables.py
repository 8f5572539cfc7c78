"""The driver's tables in the shapes of the memory model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


#: Rows that a task of a shuffle takes where its table has grown.
TASK_ROWS = 500_000


def parts_of(table: DataFrame, rows_each: int = 1) -> int | None:
    """Partitions for a shuffle of a table's rows, each making `rows_each`, that keep a task at about TASK_ROWS; none if what Spark deals does.

    Of the session's partitions, adaptive execution leaves as many as there are cores only, or those of 64 MB: some four million rows of two keys.
    """
    spark = table.sparkSession
    parts = -(-table.count() * rows_each // TASK_ROWS)
    return parts if parts > min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism) else None


def dealt(table: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """The table dealt by the keys into so many partitions, which what follows by these keys keeps; as it is if none are named."""
    return table.repartition(parts, *keys) if parts else table


def day_millis(column: str) -> Column:
    """Milliseconds since 1970 of a timestamp's day, whatever the session's time zone."""
    return F.unix_date(F.to_date(column)).cast("long") * 86_400_000


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with a vector; the label is the concept."""
    (e,) = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("observation_id"), F.col("label").alias("concept_id"), "embedding")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with a text; the source is the concept, the language the circle."""
    (d,) = read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("observation_id"), F.col("source").alias("concept_id"), F.col("lang").alias("circle"), F.coalesce("text", F.lit("")).alias("content"))


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts met in sessions: an order is a session, its priority the circle, a line's part the concept."""
    o, li = read(spark, sf_dir, "orders", "lineitem")
    parts = parts_of(li)
    return dealt(li, parts, "l_orderkey").join(dealt(o, parts, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("session_id"), F.col("o_orderpriority").alias("circle"), F.col("l_partkey").alias("concept_id"), F.struct("l_linenumber", "l_suppkey", "l_partkey").alias("at"), F.lit(False).alias("is_checkpoint")
    )


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of concepts: a part's brand and size as identifiers, its type and the words of its name as nouns."""
    (p,) = read(spark, sf_dir, "part")
    ids = F.array(F.struct(F.lit("id").alias("kind"), F.concat_ws("-", "p_brand", "p_size").alias("key"), F.lit(3).alias("weight")), F.struct(F.lit("lib").alias("kind"), F.col("p_brand").alias("key"), F.lit(2).alias("weight")))
    nouns = F.transform(F.array_distinct(F.split(F.col("p_name"), " ")), lambda w: F.struct(F.lit("noun").alias("kind"), w.alias("key"), F.lit(1).alias("weight")))
    return p.select(F.col("p_partkey").alias("concept_id"), F.explode(F.concat(ids, nouns)).alias("e")).select("concept_id", "e.*")


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as concepts: the segment is the circle; kind, status and dirtiness follow from the nation."""
    (c,) = read(spark, sf_dir, "customer")
    n = F.col("c_nationkey")
    kind = F.when(n % 5 == 0, "workstream").when(n % 5 == 1, "rule").otherwise("fact")
    status = F.when(n % 7 == 0, "retired").when(n % 7 == 1, "disputed").otherwise("active")
    return c.select(F.col("c_custkey").alias("concept_id"), F.col("c_name").alias("title"), F.lower("c_mktsegment").alias("circle"), kind.alias("kind"), status.alias("status"), ((F.col("c_acctbal") + 1000) / 11000).alias("confidence"), (n % 2 == 1).alias("dirty"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as observations of their customer's concept: those in progress are corrections, cheap ones are superseded."""
    (o,) = read(spark, sf_dir, "orders")
    at, cheap = day_millis("o_orderdate"), F.col("o_totalprice") < 20000
    return o.select(
        F.col("o_orderkey").alias("observation_id"), F.col("o_custkey").alias("concept_id"), F.col("o_orderpriority").alias("session_id"), at.alias("created_at"), F.when(F.col("o_orderstatus") == "P", "correction").otherwise("statement").alias("kind"),
        F.concat_ws(" ", F.lit("order"), "o_orderstatus", "o_orderpriority").alias("content"), F.when(cheap, F.col("o_orderkey") + 1).alias("superseded_by"), F.when(cheap, at).alias("superseded_at"), F.col("o_totalprice").alias("weight"),
    )


#: The same as DuckDB expressions.
CONCEPTS_SQL = """con as (select c_custkey as concept_id, c_name as title, lower(c_mktsegment) as circle, case c_nationkey % 5 when 0 then 'workstream' when 1 then 'rule' else 'fact' end as kind,
  case c_nationkey % 7 when 0 then 'retired' when 1 then 'disputed' else 'active' end as status, (c_acctbal + 1000) / 11000 as confidence, c_nationkey % 2 = 1 as dirty from customer)"""
OBSERVATIONS_SQL = """obs as (select o_orderkey as observation_id, o_custkey as concept_id, o_orderpriority as session_id, epoch_ms(o_orderdate) as created_at, case when o_orderstatus = 'P' then 'correction' else 'statement' end as kind,
  'order ' || o_orderstatus || ' ' || o_orderpriority as content, o_totalprice < 20000 as superseded, o_totalprice as weight from orders)"""
