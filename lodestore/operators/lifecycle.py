"""Changes of the memory's state as functions from tables to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Which verdict may follow which (null: the first).
LEGAL_VERDICTS = [(None, "approve"), (None, "reject"), ("approve", "retire"), ("retire", "re-ratify"), ("re-ratify", "retire"), ("reject", "approve")]
# End of fixed values.


def synthesis(observations: DataFrame) -> DataFrame:
    """(concept_id, body, title): distinct trimmed contents in order of first appearance, a line each; the first is the title."""
    t = observations.select("concept_id", F.trim("content").alias("c"), "created_at", "observation_id").where("c <> ''")
    first = t.groupBy("concept_id", "c").agg(F.min(F.struct("created_at", "observation_id")).alias("at"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("at", "c"))), lambda x: x["c"])
    return first.groupBy("concept_id").agg(F.array_join(lines, "\n").alias("body"), F.substring(F.min_by("c", "at"), 1, 80).alias("title"))


def merge(concepts: DataFrame, into: DataFrame) -> DataFrame:
    """Concepts after merges (src, dst): usefulness and support summed, arousal and times at their largest, aliases united; merged ones gone."""
    t = concepts.join(into.select(F.col("src").alias("concept_id"), "dst"), "concept_id", "left").withColumn("concept_id", F.coalesce("dst", "concept_id"))
    return t.groupBy("concept_id").agg(
        F.sum("support_count").alias("support_count"), F.sum("usefulness_score").alias("usefulness_score"), F.max("arousal_score").alias("arousal_score"),
        F.max("last_confirmed_at").alias("last_confirmed_at"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("aliases", F.array().cast("array<string>")))))).alias("aliases"),
    )


def detach(observations: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Observations after moves (observation_id, to_concept), and moves refused because they would leave their source empty."""
    t = observations.join(moves, "observation_id", "left")
    left = t.groupBy("concept_id").agg(F.count_if(F.col("to_concept").isNull()).alias("stay"))
    t = t.join(left, "concept_id")
    refused = t.where("to_concept is not null and stay = 0").select("observation_id", "to_concept")
    moved = t.withColumn("concept_id", F.when(F.col("to_concept").isNotNull() & (F.col("stay") > 0), F.col("to_concept")).otherwise(F.col("concept_id")))
    return moved.select(*observations.columns), refused


def evidence(observations: DataFrame) -> DataFrame:
    """What a concept's remaining observations say of it: support and last confirmation."""
    return observations.groupBy("concept_id").agg(F.count("*").alias("support_count"), F.max("created_at").alias("last_confirmed_at"))


def visible(concepts: DataFrame, archived: DataFrame, circle: str | None = None) -> DataFrame:
    """Concepts that aren't retired; archived circles show only when asked for by name."""
    t = concepts.where("status <> 'retired' and kind <> 'workstream'")
    return t.where(F.col("circle") == circle) if circle else t.join(archived.select("circle"), "circle", "left_anti")


def renamed(table: DataFrame, old: str, new: str) -> DataFrame:
    """A table with one circle under another name."""
    return table.withColumn("circle", F.when(F.col("circle") == old, new).otherwise(F.col("circle")))


def reassigned(table: DataFrame, moves: DataFrame, key: str = "concept_id") -> DataFrame:
    """A table with some rows in other circles (key, to_circle)."""
    t = table.join(moves.select(key, "to_circle"), key, "left")
    return t.withColumn("circle", F.coalesce("to_circle", "circle")).select(*table.columns)


def restored(archived: DataFrame, circle: str) -> DataFrame:
    """Archived circles without one that is brought back."""
    return archived.where(F.col("circle") != circle)


def circles(concepts: DataFrame, entities: DataFrame, activity: DataFrame, aliases: DataFrame, archived: DataFrame, exclude: str | None = None) -> DataFrame:
    """Circles by their final names: concepts that aren't workstreams, distinct entities (a set's union, not a sum), last activity, and whether archived.

    entities: (concept_id, key); activity: (concept_id, last); aliases: (from_name, to_name), already final.
    """
    t = concepts.join(aliases, F.col("circle") == F.col("from_name"), "left").select("concept_id", "kind", F.coalesce("to_name", "circle").alias("circle"))
    t = t if exclude is None else t.where(F.col("circle") != exclude)
    n = t.where("kind <> 'workstream'").groupBy("circle").agg(F.count("*").alias("concepts"))
    e = t.join(entities, "concept_id").groupBy("circle").agg(F.count_distinct("key").alias("entities"))
    a = t.join(activity, "concept_id").groupBy("circle").agg(F.max("last").alias("last_activity"))
    all_ = t.select("circle").distinct().join(n, "circle", "left").join(e, "circle", "left").join(a, "circle", "left").join(archived.withColumn("archived", F.lit(True)), "circle", "left")
    return all_.select("circle", F.coalesce("concepts", F.lit(0)).alias("concepts"), F.coalesce("entities", F.lit(0)).alias("entities"), "last_activity", F.coalesce("archived", F.lit(False)).alias("archived"))


def illegal_verdicts(ratifications: DataFrame) -> DataFrame:
    """Verdicts that may not follow the subject's verdict before."""
    w = Window.partitionBy("subject_concept_id").orderBy("created_at", "id")
    legal = ratifications.sparkSession.createDataFrame(LEGAL_VERDICTS, "before string, verdict string")
    t = ratifications.withColumn("before", F.lag("verdict").over(w))
    legal = F.broadcast(legal.withColumnsRenamed({"before": "b", "verdict": "v"}))
    return t.join(legal, F.col("before").eqNullSafe(F.col("b")) & (F.col("verdict") == F.col("v")), "left_anti").select("id", "subject_concept_id", "before", "verdict")


def skeleton(concepts: DataFrame, ratifications: DataFrame, circle: str) -> DataFrame:
    """Concepts whose latest verdict grants them, in the circle or everywhere, each once, by the time of the grant."""
    last = ratifications.groupBy("subject_concept_id").agg(F.max(F.struct("created_at", "id", "verdict")).alias("r"))
    granted = last.where(F.col("r.verdict").isin("approve", "re-ratify"))
    t = concepts.where((F.col("status") == "active") & F.col("circle").isin(circle, "*")).join(granted, F.col("concept_id") == F.col("subject_concept_id"))
    return t.select("concept_id", "circle", F.col("r.created_at").alias("granted_at")).dropDuplicates(["concept_id"]).orderBy("granted_at", "concept_id")


def workstreams(events: DataFrame) -> DataFrame:
    """One row per slug from its events (slug, at, item, state): open items, and whether it may be done: not while one is open."""
    last = events.groupBy("slug", "item").agg(F.max_by("state", "at").alias("state"), F.max("at").alias("at"))
    return last.groupBy("slug").agg(F.array_sort(F.collect_list(F.when(F.col("state") == "open", F.col("item")))).alias("open_items"), F.max("at").alias("updated_at"), (F.count_if(F.col("state") == "open") == 0).alias("may_close"))


def purge(tables: dict[str, DataFrame], doomed: DataFrame, key: str = "concept_id") -> dict[str, DataFrame]:
    """Every table that has the key, without the rows of doomed concepts."""
    return {n: t.join(doomed.select(key), key, "left_anti") if key in t.columns else t for n, t in tables.items()}


def induced(edges: DataFrame, nodes: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Edges with both ends among the nodes (column node)."""
    kept = edges.join(nodes.select(F.col("node").alias(a)), a, "left_semi")
    return kept.join(nodes.select(F.col("node").alias(b)), b, "left_semi")
