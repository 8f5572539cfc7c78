"""Threshold-band resolution of new observations, confirmations and corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Attach and ambiguity thresholds, and the least similarity of a `related` edge, by embedder profile.
PROFILES = {
    "hashing": (0.55, 0.40, 0.40),
    "multilingual-minilm": (0.70, 0.50, 0.45),
    "all-minilm": (0.72, 0.50, 0.45),
    "bge-small": (0.78, 0.50, 0.70),
    "bge-m3": (0.70, 0.50, 0.60),
}
# End of fixed values.


def nominate(scored: DataFrame) -> DataFrame:
    """One row per query: its best concept, ties to the smaller concept id. Scores are (query_id, concept_id, observation_id, score)."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "concept_id")
    return scored.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def decide(observation: Column, centroid: Column, top_centroid: Column, attach: float, ambiguous: float) -> Column:
    """(action, mode, weight) by the bands: the nominated concept's best observation and centroid, and the best centroid of all."""

    def made(action: str, mode: str, weight: Column) -> Column:
        return F.struct(F.lit(action).alias("action"), F.lit(mode).alias("mode"), weight.cast("double").alias("weight"))

    none = F.lit(None)
    return (
        F.when((observation >= attach) & (centroid >= ambiguous), made("attached", "attach", none))
        .when(observation >= attach, made("ambiguous", "fork-signal", observation))
        .when(observation >= ambiguous, made("ambiguous", "ambiguous-fork", observation))
        .when(top_centroid >= attach, made("ambiguous", "blur-duplicate", top_centroid))
        .otherwise(made("created", "new", none))
    )


def _made(action: str, mode: str) -> Column:
    return F.struct(F.lit(action).alias("action"), F.lit(mode).alias("mode"))


def overridden(action: Column, mode: Column, kind: Column, home_kind: Column, stage: Column, home_stage: Column, compatible: list[tuple[str, str]]) -> Column:
    """(action, mode) after the bands: what would attach founds a concept of its own if its kind doesn't go with the nominee's, or if it is a rule bound to another stage.

    compatible: pairs (kind, nominee's kind) that go together; the reference's matrix is unknown, so it is a parameter.
    """
    together = F.array(*(F.lit(f"{a}/{b}") for a, b in compatible))
    other = ~F.array_contains(together, F.concat_ws("/", kind, home_kind)) & kind.isNotNull() & home_kind.isNotNull()
    elsewhere = (kind == "rule") & (stage != home_stage)
    attached = action == "attached"
    return F.when(attached & other, _made("created", "species-fork")).when(attached & elsewhere, _made("created", "stage-fork")).otherwise(F.struct(action.alias("action"), mode.alias("mode")))


def directed(action: Column, mode: Column, attach_to: Column, force_new: Column) -> Column:
    """(action, mode) where the writer says what is to happen; both at once is refused."""
    return (
        F.when(attach_to.isNotNull() & force_new, _made("refused", "exclusive"))
        .when(attach_to.isNotNull(), _made("attached", "attach-to"))
        .when(force_new, _made("created", "force-new"))
        .otherwise(F.struct(action.alias("action"), mode.alias("mode")))
    )


def first_by_operation(events: DataFrame) -> DataFrame:
    """The first receipt of each operation id; replays return it."""
    w = Window.partitionBy("operation_id").orderBy("created_at", "id")
    return events.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def confirmations(observations: DataFrame, step: float = 0.1, start: float = 0.6, most: float = 0.95) -> DataFrame:
    """Per concept: support, confidence, last confirmation and arousal, from its observations in time order.

    An observation of another session than the last one known before it confirms: confidence rises by `step`, up to
    `most`. Observations without a session neither confirm nor hide the session before them.
    """
    w = Window.partitionBy("concept_id").orderBy("created_at", "observation_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last("session_id", True).over(w)
    t = observations.withColumn("confirms", F.coalesce(before != F.col("session_id"), F.lit(False)))
    return t.groupBy("concept_id").agg(
        F.count("*").alias("support_count"),
        F.round(F.least(F.lit(most), F.lit(start) + step * F.count_if("confirms")), 6).alias("confidence"),
        F.max(F.when(F.col("confirms"), F.col("created_at"))).alias("last_confirmed_at"),
        F.count_if("confirms").alias("arousal_gain"),
    )
