"""The moment spool as a stream: JSON lines in, records folded once whatever is replayed."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestore.sources.commit import create_once, names, remove, text_of
from lodestore.streaming.tail import read_tail

VERSION = 1
ENVELOPE = """v double, runId string, seq double, kind string, writerRole string, at string, momentId string, ruleId string, toolUseId string, sessionId string, circle string,
 stageId string, ruleIds array<string>, disposition string, deliveredRuleIds array<string>, namedStageId string, readAt string, outcomeStatus string, outcomeAt string,
 outcomeSha256 string, askedAt string, answer string, answeredAt string, _corrupt string"""
RECORD = "run_id string, seq long, kind string, status string, value string"


def parse(lines: DataFrame, version: int = VERSION) -> DataFrame:
    """Records of JSON lines (column value, others stay) with a status: ok, malformed (not JSON, or without version, run, sequence or kind), or future version."""
    r = F.from_json("value", ENVELOPE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    t = lines.withColumn("__r", r).select(*lines.columns, "__r.*")
    none = F.col("_corrupt").isNotNull() | F.col("v").isNull()
    bad = F.col("runId").isNull() | (F.col("runId") == "") | F.col("seq").isNull() | (F.col("seq") < 0) | (F.col("seq") != F.floor("seq")) | F.col("kind").isNull()
    status = F.when(none, "malformed").when(F.col("v") > version, "future").when(bad, "malformed").otherwise("ok")
    return t.withColumn("status", status).withColumn("seq", F.col("seq").cast("long")).drop("_corrupt")


def read_spool(spark: SparkSession, path: str, version: int = VERSION, cursor: str | None = None) -> DataFrame:
    """The parsed lines of all files in the folder as they grow; the checkpoint holds how far each is read."""
    return parse(read_tail(spark, path, version, cursor), version).withColumnRenamed("runId", "run_id")


def append(records: DataFrame, path: str) -> None:
    """Append records to a spool as JSON lines."""
    records.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)


def once(records: DataFrame) -> DataFrame:
    """Each (run, sequence) once over the whole stream; lines without them once by their place. State is kept without a limit, since a record may always come again."""
    ok = F.col("status") == "ok"
    keyed = records.withColumn("__a", F.when(ok, F.col("run_id")).otherwise(F.col("file"))).withColumn("__b", F.when(ok, F.col("seq")).otherwise(F.col("byte")))
    return keyed.dropDuplicates(["status", "__a", "__b"]).drop("__a", "__b")


def commit_batches(spark: SparkSession, out: str, state: str, write: Callable[[DataFrame, str], dict]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: `write` puts a batch into a folder of its own and gives what is known of it; the batch counts once its commit file is there.

    Commits are named by the query's id, which its checkpoint keeps, and the batch. A batch that is tried again finds
    its commit and does nothing; another checkpoint has another id, so none replaces another's. What a failed try left
    has no commit and is never read.
    """

    def apply(batch: DataFrame, n: int) -> None:
        name = f"{out}/commits/{json.loads(text_of(spark, f'{state}/metadata'))['id']}-{n:09d}.json"
        if text_of(spark, name) is None:
            folder = f"rows/{uuid.uuid4().hex}"
            facts = write(batch, f"{out}/{folder}")
            if not create_once(spark, name, json.dumps(facts | {"folder": folder})):
                remove(spark, f"{out}/{folder}")

    return apply


def commits(spark: SparkSession, out: str, but: str = "-") -> dict[str, dict]:
    """The commits of a fold by name, without those that begin with `but`."""
    return {n: json.loads(text_of(spark, f"{out}/commits/{n}")) for n in names(spark, f"{out}/commits") if not n.startswith(but)}


def folded(spark: SparkSession, out: str, but: str = "-") -> DataFrame:
    """The records that a fold holds: (run_id, seq, kind), of its whole batches."""
    folders = [f"{out}/{c['folder']}" for c in commits(spark, out, but).values()]
    rows = spark.read.schema(RECORD).parquet(*folders) if folders else spark.createDataFrame([], RECORD)
    return rows.where("status = 'ok'").select("run_id", "seq", "kind")


def fold_once(spark: SparkSession, path: str, out: str, state: str, version: int = VERSION) -> dict[str, int]:
    """Fold what the spool holds now into `out`, each (run, sequence) once over all calls; returns how many lines of this call were malformed or of a newer version.

    Each file is folded up to its first record of a newer version and no further, in this batch or a later one; a
    reader that knows it goes on there, with this checkpoint or its own. Repeats are told by the stream's state; against
    what other checkpoints folded, by a join with their batches alone.
    """
    before = set(names(spark, f"{out}/commits"))

    def write(batch: DataFrame, folder: str) -> dict:
        own = json.loads(text_of(spark, f"{state}/metadata"))["id"]
        t = batch.select("run_id", "seq", "kind", "status", "value")
        if any(not n.startswith(own) for n in names(spark, f"{out}/commits")):
            others = folded(batch.sparkSession, out, own).select("run_id", "seq", F.lit("ok").alias("status"))
            t = t.join(others, ["run_id", "seq", "status"], "left_anti").select("run_id", "seq", "kind", "status", "value")
        t.withColumn("value", F.when(F.col("status") != "ok", F.col("value"))).write.parquet(folder)
        return {"counts": {r.status: r["count"] for r in spark.read.schema(RECORD).parquet(folder).groupBy("status").count().collect()}}

    stream = once(read_spool(spark, path, version, f"{state}-cursor"))
    stream.writeStream.foreachBatch(commit_batches(spark, out, state, write)).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    new = [c["counts"] for n, c in commits(spark, out).items() if n not in before]
    return {s: sum(c.get(s, 0) for c in new) for s in ("malformed", "future")}


def _ranges(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Open gaps of one run: a late sequence number shrinks or splits the range it falls into."""
    last, lows, highs = state.get if state.exists else (-1, [], [])
    gaps = list(zip(lows, highs, strict=True))
    for pdf in batches:
        for seq in sorted(set(pdf.seq)):
            if seq > last:
                if seq > last + 1:
                    gaps.append((last + 1, int(seq) - 1))
                last = int(seq)
                continue
            at = next((g for g in gaps if g[0] <= seq <= g[1]), None)
            if at:
                gaps.remove(at)
                gaps += [g for g in ((at[0], int(seq) - 1), (int(seq) + 1, at[1])) if g[0] <= g[1]]
    gaps.sort()
    state.update((last, [g[0] for g in gaps], [g[1] for g in gaps]))
    yield pd.DataFrame({"run_id": [key[0]], "last": [last], "open_gaps": [len(gaps)], "missing": [sum(b - a + 1 for a, b in gaps)], "low": [[g[0] for g in gaps]], "high": [[g[1] for g in gaps]]})


def gap_states(records: DataFrame) -> DataFrame:
    """Streaming gaps of (run_id, seq): after each batch, the open ranges of the runs it touched. State is kept per run without a timeout, since a late record may always come."""
    return records.groupBy("run_id").applyInPandasWithState(
        _ranges, "run_id string, last long, open_gaps long, missing long, low array<long>, high array<long>", "last long, low array<long>, high array<long>", "update", GroupStateTimeout.NoTimeout
    )


def run_gaps(spark: SparkSession, path: str, out: str, state: str, version: int = VERSION) -> DataFrame:
    """Bring the gaps of each run under `out` up to what the spool holds; gives (run_id, last, open_gaps, missing, low, high) as they stand.

    A repeated record changes nothing, so the records go to the runs' states as they come.
    """

    def write(batch: DataFrame, folder: str) -> dict:
        batch.write.parquet(folder)
        return {}

    records = read_spool(spark, path, version, f"{state}-cursor").where("status = 'ok'").select("run_id", "seq")
    stream = gap_states(records).writeStream.outputMode("update").foreachBatch(commit_batches(spark, out, state, write))
    stream.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    rows, kinds = None, "run_id string, last long, open_gaps long, missing long, low array<long>, high array<long>"
    for n, c in enumerate(commits(spark, out).values()):
        part = spark.read.schema(kinds).parquet(f"{out}/{c['folder']}").withColumn("n", F.lit(n))
        rows = part if rows is None else rows.union(part)
    if rows is None:
        return spark.createDataFrame([], kinds)
    return rows.groupBy("run_id").agg(F.max_by(F.struct("last", "open_gaps", "missing", "low", "high"), "n").alias("r")).select("run_id", "r.*")
