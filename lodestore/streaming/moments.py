"""The governed-moment ledger as keyed state: what records say of a moment, whatever order they come in and however they are split into batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.staging import stage
from lodestore.streaming import spool

#: What an interception says of its moment; for each the first value by (run, sequence) stands.
FIELDS = {"at": "at", "session_id": "sessionId", "tool_use_id": "toolUseId", "circle": "circle", "stage_id": "stageId", "rule_ids": "ruleIds", "disposition": "disposition", "delivered_rule_ids": "deliveredRuleIds"}
OUTCOME = ("outcome_at", "outcome_status", "outcome_sha256")
#: What facts are of: a moment or a tool use, its id, and the rule of a read, the answer of an answer or the moment of a tool use's interception.
FACT = ("of", "id", "what", "name")


def keyed(records: DataFrame) -> DataFrame:
    """Valid records in the columns that the ledger reads; `key` is their moment, null where they name none."""
    return records.where("status = 'ok'").select(
        F.col("momentId").alias("key"), "kind", "run_id", "seq", *[F.col(c).alias(n) for n, c in FIELDS.items()], F.col("ruleId").alias("rule_id"), F.col("readAt").alias("read_at"),
        F.col("outcomeAt").alias("outcome_at"), F.col("outcomeStatus").alias("outcome_status"), F.col("outcomeSha256").alias("outcome_sha256"), "answer",
    )


def _held() -> dict[str, Column]:
    """The columns of a fact's state, each a least or greatest value over its records, so that order, repeats and splits change nothing.

    Fields and outcome: the first non-null by (run, sequence) and by time. Reads: of each rule the first. Answers: of each the first.
    """
    said, opens = F.struct("run_id", "seq"), F.col("what") == "interception"
    first = {n: F.min(F.when(opens & F.col(n).isNotNull(), F.struct("run_id", "seq", F.col(n).alias("v")))) for n in FIELDS}
    outcome = F.min(F.when(F.col("what") == "outcome", F.struct("outcome_at", "run_id", "seq", "outcome_status", "outcome_sha256")))
    return first | {"outcome": outcome, "read_at": F.min(F.when(F.col("what") == "read", F.col("read_at"))), "said": F.min(F.when(F.col("what") == "answer", said))}


def held(records: DataFrame) -> DataFrame:
    """What is known of each fact from keyed records: one row for each (of, id, what, name). An interception by tool use is a fact of that too; what a record of another kind says is that there is its moment."""
    kind, key, tool = F.col("kind"), F.col("key"), F.col("tool_use_id")
    fact = lambda of, id_, what, name: F.struct(F.lit(of).alias("of"), id_.alias("id"), what.alias("what"), name.alias("name"))
    none = F.lit(None).cast("string")
    reads = (kind == "read") & F.col("rule_id").isNotNull() & F.col("read_at").isNotNull()
    what = F.when(reads, "read").when(kind.isin("interception", "outcome", "ask", "answer"), kind).otherwise("seen")
    of_moment = F.when(key.isNotNull() & (kind != "run-start"), fact("moment", key, what, F.when(reads, F.col("rule_id")).when(kind == "answer", F.col("answer"))))
    of_tool = F.when(tool.isNotNull() & (kind == "interception") & key.isNotNull(), fact("tool", tool, F.lit("link"), key)).when(tool.isNotNull() & (kind == "outcome") & key.isNull(), fact("tool", tool, F.lit("outcome"), none))
    t = records.select("*", F.explode(F.array_compact(F.array(of_moment, of_tool))).alias("__f")).select("*", "__f.*")
    return t.groupBy(*FACT).agg(*[c.alias(n) for n, c in _held().items()])


def _told(rows: DataFrame) -> DataFrame:
    """Moments as they are read: reads that count, split by the outcome, and the state. A late outcome moves reads."""
    counts = lambda rule: F.col("rule_ids").isNull() | F.array_contains("rule_ids", rule)
    late = lambda at: F.col("outcome_at").isNotNull() & (at > F.col("outcome_at"))
    timely, after = F.map_filter("reads", lambda k, v: counts(k) & ~late(v)), F.map_filter("reads", lambda k, v: counts(k) & late(v))
    state = F.when(~F.col("opened"), "unopened").when(F.col("outcome_at").isNull(), "pending").otherwise("closed")
    return rows.select("moment_id", *FIELDS, *OUTCOME, timely.alias("reads"), after.alias("late_reads"), "asked", "answer", "conflict", state.alias("state"))


def ledger(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Moments as told and losses, (tool_use_id, outcome_at, outcome_status) of outcomes that no interception has met, from facts, each once.

    A tool use's first outcome goes to each moment that it was intercepted as.
    """
    tools = facts.where("of = 'tool'")
    results, links = tools.where("what = 'outcome'").select("id", "outcome"), tools.where("what = 'link'").select("id", "name")
    met = results.join(links, "id").select(F.lit("moment").alias("of"), F.col("name").alias("id"), F.lit("outcome").alias("what"), "outcome")
    what, name = F.col("what"), F.col("name")
    answers = what == "answer"
    reads = F.array_sort(F.collect_list(F.when(what == "read", F.struct("name", "read_at"))))
    t = facts.where("of = 'moment'").unionByName(met, allowMissingColumns=True).groupBy(F.col("id").alias("moment_id")).agg(
        *[F.min(n)["v"].alias(n) for n in FIELDS], F.min("outcome").alias("o"), F.map_from_entries(reads).alias("reads"), F.max(what == "interception").alias("opened"), F.max(what == "ask").alias("asked"),
        F.min(F.when(answers, F.struct("said", "name")))["name"].alias("answer"), (F.count_if(answers & name.isNotNull()) > 1).alias("conflict"),
    )
    lost = results.join(links, "id", "left_anti").select(F.col("id").alias("tool_use_id"), "outcome.outcome_at", "outcome.outcome_status")
    return _told(t.select("*", *[F.col("o")[c].alias(c) for c in OUTCOME])), lost


def batch(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ledger of all records at once: moments and losses."""
    return ledger(held(stage(keyed(records).dropDuplicates(["run_id", "seq"]), "ledger")))


def run(spark: SparkSession, path: str, folder: str, version: int = spool.VERSION) -> tuple[DataFrame, DataFrame]:
    """Bring the ledger in `folder` up to what the spool holds; gives its moments and losses.

    Each fact is a state of Spark's streaming aggregation, kept in RocksDB without a time limit, since the other half
    of a moment may always come. Every batch tells the states that it touched; a later one is never greater in any
    least value. Another folder is another ledger, from the spool's start.
    """

    def write(rows: DataFrame, where: str) -> dict:
        rows.write.parquet(where)
        return {}

    name = "spark.sql.streaming.stateStore.providerClass"
    before, out, state = spark.conf.get(name, None), f"{folder}/facts", f"{folder}/state"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        facts = held(keyed(spool.once(spool.read_spool(spark, path, version, f"{state}-cursor"))))
        stream = facts.writeStream.outputMode("update").foreachBatch(spool.commit_batches(spark, out, state, write))
        stream.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
    folders = [f"{out}/{c['folder']}" for c in spool.commits(spark, out).values()]
    told = spark.read.schema(facts.schema).parquet(*folders) if folders else spark.createDataFrame([], facts.schema)
    return ledger(told.groupBy(*FACT).agg(*[F.min(c).alias(c) for c in told.columns if c not in FACT]))
