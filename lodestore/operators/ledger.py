"""The governed-moment ledger as a batch fold: idempotent, in any order of arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gaps(records: DataFrame) -> DataFrame:
    """(run_id, gap_from, gap_to): missing sequence numbers of each run, from 0 up to its largest."""
    w = Window.partitionBy("run_id").orderBy("seq")
    t = records.select("run_id", "seq").distinct().withColumn("before", F.coalesce(F.lag("seq").over(w), F.lit(-1)))
    return t.where("seq > before + 1").select("run_id", (F.col("before") + 1).alias("gap_from"), (F.col("seq") - 1).alias("gap_to"))


def first_values(records: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Per key the first non-null value of each column in the given order: later records fill in, never overwrite."""
    at = F.struct(*order)
    return records.groupBy(key).agg(*[F.min(F.when(F.col(c).isNotNull(), F.struct(at.alias("at"), F.col(c).alias("v"))))["v"].alias(c) for c in columns])


def reads(records: DataFrame, moments: DataFrame) -> DataFrame:
    """First read of each (moment, rule), with whether it came late: after the moment's outcome, whenever that arrived.

    Reads of no moment, or of a rule that doesn't apply to it, aren't joined.
    """
    first = records.dropDuplicates(["run_id", "seq"]).where("moment_id is not null").groupBy("moment_id", "rule_id").agg(F.min("read_at").alias("read_at"))
    t = first.join(moments.select("moment_id", "rule_ids", "outcome_at"), "moment_id").where(F.array_contains("rule_ids", F.col("rule_id")))
    return t.select("moment_id", "rule_id", "read_at", F.coalesce(F.col("read_at") > F.col("outcome_at"), F.lit(False)).alias("late"))


def unjoinable(records: DataFrame, moments: DataFrame) -> DataFrame:
    """Reads, each (run, sequence) once, that meet no moment or none their rule applies to; the stage that one names still counts as read."""
    t = records.dropDuplicates(["run_id", "seq"]).join(moments.select("moment_id", "rule_ids"), "moment_id", "left")
    return t.where(F.col("moment_id").isNull() | F.col("rule_ids").isNull() | ~F.array_contains(F.coalesce("rule_ids", F.array().cast("array<string>")), F.coalesce("rule_id", F.lit(""))))


def stage_reads(records: DataFrame) -> DataFrame:
    """Reads of each stage that is named, joinable or not, each (run, sequence) once."""
    return records.dropDuplicates(["run_id", "seq"]).where("named_stage_id is not null").groupBy("named_stage_id").agg(F.count("*").alias("reads"))


def conformance(moments: DataFrame, reads_of: DataFrame, lost: DataFrame) -> DataFrame:
    """One row of six counts: asked moments followed, not followed and unanswered, moments with rules never asked, late reads, reads that can't be joined."""
    governed = F.size("rule_ids") > 0
    a = moments.agg(
        F.count_if(F.col("answer") == "followed").alias("followed"), F.count_if(F.col("answer") == "not-followed").alias("not_followed"),
        F.count_if(F.col("asked") & F.col("answer").isNull()).alias("unanswered"), F.count_if(governed & ~F.col("asked")).alias("not_asked"),
    )
    return a.crossJoin(reads_of.agg(F.count_if("late").alias("read_late"))).crossJoin(lost.agg(F.count("*").alias("unjoinable_reads")))


def answers(records: DataFrame) -> DataFrame:
    """(moment_id, asked, answer, conflict): the first ask and the first answer of each moment by sequence; a later different answer changes nothing and is told."""
    first = records.groupBy("moment_id").agg(F.min(F.when(F.col("kind") == "ask", F.col("seq"))).alias("asked_at"), F.min(F.when(F.col("kind") == "answer", F.struct("seq", "answer")))["answer"].alias("answer"), F.count_distinct(F.when(F.col("kind") == "answer", F.col("answer"))).alias("n"))
    return first.select("moment_id", F.col("asked_at").isNotNull().alias("asked"), "answer", (F.col("n") > 1).alias("conflict"))


def owing(moments: DataFrame, cap: int) -> DataFrame:
    """Moments that were asked and not answered, the oldest first."""
    return moments.where("asked and answer is null").orderBy("at", "moment_id").limit(cap)


def losses(gap_rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Gaps with what is known of their runs; a run nothing else is known of keeps its gaps."""
    return gap_rows.join(runs, "run_id", "left")


def outcomes(moments: DataFrame, results: DataFrame) -> DataFrame:
    """Moments joined with results by tool use, either arriving first; results of no moment are losses."""
    return moments.join(results, "tool_use_id", "full_outer").select(
        "moment_id", "tool_use_id", "outcome_status", F.when(F.col("moment_id").isNull(), "orphan").when(F.col("outcome_status").isNull(), "open").otherwise("closed").alias("state")
    )


def counts(disposition: Column, rule_ids: Column) -> list[Column]:
    """Counts of moments where rules applied, none did, or it isn't known: null isn't the empty list."""
    return [
        F.count_if(F.size(rule_ids) > 0).alias("fires"),
        F.count_if(F.size(rule_ids) == 0).alias("silences"),
        F.count_if(rule_ids.isNull()).alias("unattributed"),
        F.count_if(disposition == "ungoverned").alias("ungoverned"),
        F.count("*").alias("total"),
    ]


def circle_counts(moments: DataFrame) -> DataFrame:
    """Per circle the counts of its opened moments by what the gate did: null rules weren't evaluated, an empty list is silence.

    moments: (opened, circle, rule_ids, delivered_rule_ids). Moments of no circle stand in the row of the null circle,
    whose total is the unattributed; in it too, since they have no circle either, those never opened.
    """
    opened, rules, given = F.col("opened"), F.size("rule_ids"), F.size("delivered_rule_ids")
    t = moments.withColumn("circle", F.when(opened, F.col("circle")))
    return t.groupBy("circle").agg(
        F.count_if(opened & F.col("rule_ids").isNotNull() & (rules > 0)).alias("fires"), F.count_if(opened & F.col("rule_ids").isNotNull() & (rules == 0)).alias("silences"), F.count_if(opened & F.col("rule_ids").isNull()).alias("ungoverned"),
        F.count_if(opened & F.col("delivered_rule_ids").isNotNull() & (given > 0)).alias("delivered"), F.count_if(opened).alias("total"), F.count_if(~opened).alias("unopened"),
    )
