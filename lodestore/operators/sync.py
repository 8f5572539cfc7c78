"""Merging of replicas' deltas: any order, any number of times, one outcome."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestore.operators.graph import on_cycles


def delta(rows: DataFrame, since: int, at: str = "updated_at") -> DataFrame:
    """Rows at or after the watermark."""
    return rows.where(F.col(at) >= since)


def last_writer(rows: DataFrame, key: str, revision: str = "sync_revision", writer: str = "writer_id") -> DataFrame:
    """One row per key: the highest revision, then the larger writer id."""
    rest = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max(F.struct(revision, writer, *[c for c in rest if c not in (revision, writer)])).alias("w"))
    return best.select(key, *[F.col("w")[c].alias(c) for c in rest])


def grow_only(components: DataFrame, key: list[str], writer: str = "writer_id", value: str = "count") -> DataFrame:
    """Counters by key: the largest of each writer's, summed over writers."""
    return components.groupBy(*key, writer).agg(F.max(value).alias(value)).groupBy(*key).agg(F.sum(value).alias(value))


def set_union(rows: DataFrame, key: str, column: str) -> DataFrame:
    return rows.select(key, F.explode(column).alias("x")).groupBy(key).agg(F.array_sort(F.collect_set("x")).alias(column))


def alive(events: DataFrame, key: str) -> DataFrame:
    """Keys whose latest event isn't a deletion; at equal times a deletion wins."""
    last = events.groupBy(key).agg(F.max(F.struct("at", (F.col("kind") == "delete").alias("gone"))).alias("e"))
    return last.where("not e.gone").select(key)


def graft(local: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming rows that aren't there yet: a second graft inserts none."""
    return incoming.join(local.select(key), key, "left_anti")


def dismissed(edges: DataFrame, key: list[str]) -> DataFrame:
    """Edges by key, dismissed if any replica dismissed them: the earliest dismissal, and by whom."""
    at = F.when(F.col("dismissed_at").isNotNull(), F.struct("dismissed_at", "dismissed_by"))
    return edges.groupBy(*key).agg(F.min(at).alias("d")).select(*key, F.col("d.dismissed_at").alias("dismissed_at"), F.col("d.dismissed_by").alias("dismissed_by"))


def marked_dirty(concepts: DataFrame, inserted: DataFrame) -> DataFrame:
    """Concepts, dirty where a graft brought new evidence (concept_id)."""
    new = inserted.select("concept_id").distinct().withColumn("fresh", F.lit(True))
    return concepts.join(new, "concept_id", "left").withColumn("dirty", F.col("dirty") | F.coalesce("fresh", F.lit(False))).drop("fresh")


def rejected(protocol: Column, embedder: Column, widths: Column, malformed: Column, own_protocol: int, own_embedder: str, own_width: int) -> Column:
    """Why a payload can't be grafted: a newer protocol, another embedder, malformed vectors, or widths that aren't one's own; null if it can."""
    return (
        F.when(protocol > own_protocol, "protocol")
        .when(embedder != own_embedder, "embedder")
        .when(malformed > 0, "malformed")
        .when(F.size(widths) > 1, "mixed-width")
        .when(~F.coalesce(F.array_contains(widths, own_width), F.lit(True)) & (F.size(widths) > 0), "width")
    )


def payload(tables: dict[str, tuple[DataFrame, str]], since: int, protocol: int, embedder: str) -> DataFrame:
    """A delta as rows (protocol, embedder, since, table, id, row as JSON) of every table's rows at or after the watermark."""
    head = [F.lit(protocol).alias("protocol"), F.lit(embedder).alias("embedder"), F.lit(since).cast("long").alias("since")]
    parts = [delta(t, since).select(*head, F.lit(name).alias("table"), F.col(key).cast("string").alias("id"), F.to_json(F.struct("*")).alias("row")) for name, (t, key) in tables.items()]
    return reduce(DataFrame.union, parts)


_PAYLOAD = "protocol int, embedder string, since long, `table` string, id string, row string"


def write_payload(rows: DataFrame, path: str) -> None:
    """A payload as files of JSON lines, a folder a table."""
    rows.withColumn("part", F.col("table")).write.partitionBy("part").json(path)


def read_payload(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a payload's files."""
    return spark.read.schema(_PAYLOAD).json(path).select("protocol", "embedder", "since", "table", "id", "row")


def graft_payload(rows: DataFrame, held: dict[str, DataFrame], key: str, protocol: int, embedder: str) -> DataFrame:
    """What becomes of each of a payload's rows for the tables that a replica holds, which have one schema.

    (table, verdict, and the row's columns): inserted, there (its key is held), repeated (not the first row of its key
    in the payload), malformed (no JSON of the schema, or without a key), or refused (a newer protocol, another embedder).
    """
    parts = []
    for name, table in held.items():
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema)
        t = rows.where(F.col("table") == name).select("table", "protocol", "embedder", F.from_json("row", f"{kinds}, `__bad` string", {"columnNameOfCorruptRecord": "__bad"}).alias("r"))
        t = t.select("table", "protocol", "embedder", "r.*")
        bad = F.col("__bad").isNotNull() | F.col(key).isNull()
        refused = (F.col("protocol") > protocol) | (F.col("embedder") != embedder)
        one = F.row_number().over(Window.partitionBy(key, bad).orderBy(F.to_json(F.struct(*table.columns)))) > 1
        t = t.withColumn("__again", one).join(table.select(key, F.lit(True).alias("__held")).distinct(), key, "left")
        verdict = F.when(refused, "refused").when(bad, "malformed").when(F.col("__held"), "there").when(F.col("__again"), "repeated").otherwise("inserted")
        parts.append(t.withColumn("verdict", verdict).select("table", "verdict", *table.columns))
    return reduce(DataFrame.unionByName, parts)


def acyclic(edges: DataFrame) -> DataFrame:
    """Of supersessions (id, src, dst, created_at; one dst a src) those that can be grafted in order of time and id without closing a circle.

    Every circle loses its last edge; nothing else closes one, since each src has one dst.
    """
    ring = on_cycles(edges)
    last = edges.join(ring.select(F.col("node").alias("src"), "cycle").hint("merge"), "src").groupBy("cycle").agg(F.max(F.struct("created_at", "id"))["id"].alias("id"))
    return edges.join(last.select("id").hint("merge"), "id", "left_anti")


def migrated(edges: DataFrame, related: DataFrame) -> DataFrame:
    """Edges after re-embedding: `related` ones made anew, all others as they were."""
    return edges.where("type <> 'related'").unionByName(related.withColumn("type", F.lit("related")).select(*edges.columns))
