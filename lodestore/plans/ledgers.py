"""The ledger fold over the event table, its streaming twin, and replica merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestore.operators import ledger, sync
from lodestore.plans.staging import shared_dir
from lodestore.sources.tables import day_millis, read
from lodestore.streaming import moments, spool


def _records(spark, sf):
    """Events as records: the user is the run and every four events of it are one moment."""
    (e,) = read(spark, sf, "events")
    return e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.concat_ws("-", "user_id", F.floor(F.col("event_id") / 1000)).alias("moment_id"), "event_type", "ts", "value", "props")


def ledger_gaps(spark, sf):
    return ledger.gaps(_records(spark, sf))


def gap_totals(spark, sf):
    g = ledger.gaps(_records(spark, sf))
    return g.groupBy("run_id").agg(F.count("*").alias("gaps"), F.sum(F.col("gap_to") - F.col("gap_from") + 1).alias("missing"))


def first_fields(spark, sf):
    """Per moment the first click's, purchase's and error's value, in order of sequence."""
    t = _records(spark, sf)
    for kind in ("click", "purchase", "error"):
        t = t.withColumn(kind, F.when(F.col("event_type") == kind, F.col("value")))
    return ledger.first_values(t, "moment_id", ["seq"], ["click", "purchase", "error"])


def late_reads(spark, sf):
    """Views as reads of the rule their payload names, against the moment's first purchase as its outcome."""
    t = _records(spark, sf)
    rule = (F.get_json_object("props", "$.k").cast("int") % 5).cast("string")
    reads = t.where("event_type = 'view'").select("run_id", "seq", "moment_id", rule.alias("rule_id"), F.col("seq").alias("read_at"))
    moments = t.groupBy("moment_id").agg(F.min(F.when(F.col("event_type") == "purchase", F.col("seq"))).alias("outcome_at")).withColumn("rule_ids", F.array(F.lit("0"), F.lit("1"), F.lit("2")))
    return ledger.reads(reads, moments)


def outcome_states(spark, sf):
    """Clicks as moments and purchases as outcomes of the same user's same payload, either first."""
    t = _records(spark, sf).withColumn("tool_use_id", F.concat_ws(":", "run_id", F.get_json_object("props", "$.k")))
    m = t.where("event_type = 'click'").groupBy("tool_use_id").agg(F.min("moment_id").alias("moment_id"))
    r = t.where("event_type = 'purchase'").groupBy("tool_use_id").agg(F.min("seq").alias("outcome_status"))
    return ledger.outcomes(m, r).groupBy("state").agg(F.count("*").alias("n"))


def moment_counts(spark, sf):
    """Three-valued rule lists: signups have none recorded, views an empty list, the others one."""
    t = _records(spark, sf).withColumn("rule_ids", F.when(F.col("event_type") == "signup", F.lit(None).cast("array<string>")).when(F.col("event_type") == "view", F.array().cast("array<string>")).otherwise(F.array("event_type")))
    d = F.when(F.col("value") > 50, "ungoverned").otherwise("advised")
    return t.groupBy("run_id").agg(*ledger.counts(d, F.col("rule_ids")))


def loss_report(spark, sf):
    """Gaps and orphaned outcomes in one table."""
    g = ledger.gaps(_records(spark, sf)).groupBy("run_id").agg(F.count("*").alias("n")).select(F.lit("gap").alias("kind"), "n")
    o = outcome_states(spark, sf).where("state = 'orphan'").select(F.lit("orphan").alias("kind"), "n")
    return g.union(o).groupBy("kind").agg(F.sum("n").alias("n"))


def stream_counts(spark, sf):
    """The events written as JSON lines twice over, streamed once: duplicates by (run, seq) count once, in any order."""
    import uuid

    base = f"{shared_dir(spark)}/spool-{uuid.uuid4().hex}"
    r = _records(spark, sf).select(F.to_json(F.struct(F.lit(1).alias("v"), F.col("run_id").cast("string").alias("runId"), "seq", F.col("event_type").alias("kind"))).alias("value"))
    r.write.text(f"{base}/in")
    r.write.mode("append").text(f"{base}/in")
    spool.fold_once(spark, f"{base}/in", f"{base}/out", f"{base}/state")
    return spool.folded(spark, f"{base}/out").groupBy("kind").agg(F.count("*").alias("records"), F.count_distinct("run_id").alias("runs"))


def _spool_lines(spark, sf):
    """Events as spool records: clicks are interceptions, views reads, purchases outcomes by tool use, errors outcomes by moment, signups answers."""
    (e,) = read(spark, sf, "events")
    k, kind = F.get_json_object("props", "$.k").cast("int"), F.col("event_type")
    user, at = F.col("user_id").cast("string"), F.lpad(F.col("event_id").cast("string"), 12, "0")
    moment, tool = F.concat_ws("-", "user_id", F.floor(F.col("event_id") / 1000)), F.concat_ws(":", "user_id", k)
    rules = F.when(k % 3 == 1, F.array().cast("array<string>")).when(k % 3 == 2, F.array(F.lit("0"), F.lit("1"), F.lit("2")))
    status = F.when(F.col("value") > 50, "ok").otherwise("failed")
    return e.select(F.to_json(F.struct(
        F.lit(1).alias("v"), user.alias("runId"), F.col("event_id").alias("seq"),
        F.when(kind == "click", "interception").when(kind == "view", "read").when(kind.isin("purchase", "error"), "outcome").otherwise("answer").alias("kind"),
        F.when(kind != "purchase", moment).alias("momentId"), F.when(kind.isin("click", "purchase"), tool).alias("toolUseId"), at.alias("at"), rules.alias("ruleIds"),
        F.when(F.col("user_id") % 10 != 0, F.concat(F.lit("c"), F.col("user_id") % 3)).alias("circle"), F.when(k % 4 == 1, F.array().cast("array<string>")).when(k % 4 > 1, F.array(F.lit("0"))).alias("deliveredRuleIds"), F.lit("advised").alias("disposition"),
        (k % 5).cast("string").alias("ruleId"), at.alias("readAt"), at.alias("outcomeAt"), status.alias("outcomeStatus"), F.lit("s").alias("outcomeSha256"),
        F.when(F.col("value") > 50, "followed").otherwise("not-followed").alias("answer"),
    )).alias("value"))


def _moments_told(t):
    return t.select("moment_id", "state", "outcome_at", "outcome_status", "tool_use_id", F.array_join("rule_ids", "|").alias("rules"), F.size("reads").cast("long").alias("reads"), F.size("late_reads").cast("long").alias("late"), "answer", "conflict")


def moment_states(spark, sf):
    """Every moment of the events' ledger at once: first fields, outcome by tool use or moment, reads in time and late, answer, state."""
    return _moments_told(moments.batch(spool.parse(_spool_lines(spark, sf)).withColumnRenamed("runId", "run_id"))[0])


def stream_moments(spark, sf):
    """The same ledger from keyed state: the spool's lines in two parts, the later ones first, and some of them twice."""
    import uuid

    base = f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    lines = _spool_lines(spark, sf)
    late = F.get_json_object("value", "$.seq").cast("long") % 2 == 1
    lines.where(late).write.text(f"{base}/in")
    moments.run(spark, f"{base}/in", f"{base}/ledger")
    lines.where(~late).write.mode("append").text(f"{base}/in")
    lines.where(late).limit(1000).write.mode("append").text(f"{base}/in")
    return _moments_told(moments.run(spark, f"{base}/in", f"{base}/ledger")[0])


def stream_gaps(spark, sf):
    """Each run's gaps from keyed state, the spool's lines in two parts, the later ones first."""
    import uuid

    base = f"{shared_dir(spark)}/gaps-{uuid.uuid4().hex}"
    lines = _spool_lines(spark, sf)
    late = F.get_json_object("value", "$.seq").cast("long") % 3 == 1
    lines.where(late).write.text(f"{base}/in")
    spool.run_gaps(spark, f"{base}/in", f"{base}/out", f"{base}/state")
    lines.where(~late).union(lines.where(late).limit(100)).write.mode("append").text(f"{base}/in")
    return spool.run_gaps(spark, f"{base}/in", f"{base}/out", f"{base}/state").where("open_gaps > 0").select(F.col("run_id").cast("long").alias("run_id"), F.col("open_gaps").alias("gaps"), "missing")


def circle_moments(spark, sf):
    """Each circle's moments by what the gate did, with those of no circle and those never opened in a row of their own."""
    t = moments.batch(spool.parse(_spool_lines(spark, sf)).withColumnRenamed("runId", "run_id"))[0]
    return ledger.circle_counts(t.withColumn("opened", F.col("state") != "unopened"))


def unmet_outcomes(spark, sf):
    """Outcomes by tool use that no interception has met, in the batch fold."""
    return moments.batch(spool.parse(_spool_lines(spark, sf)).withColumnRenamed("runId", "run_id"))[1]


def last_writers(spark, sf):
    """Customers' rows as replicas wrote them, an order each: the highest day wins, then the larger writer."""
    (o,) = read(spark, sf, "orders")
    t = o.select(F.col("o_custkey").alias("id"), day_millis("o_orderdate").alias("sync_revision"), F.col("o_orderkey").alias("writer_id"), F.col("o_orderstatus").alias("status"))
    return sync.last_writer(t, "id")


def grow_only_counts(spark, sf):
    (li,) = read(spark, sf, "lineitem")
    t = li.select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("writer_id"), F.col("l_linenumber").alias("count"))
    return sync.grow_only(t, ["id"])


def union_refs(spark, sf):
    (o,) = read(spark, sf, "orders")
    t = o.groupBy(F.col("o_custkey").alias("id"), "o_orderstatus").agg(F.collect_set("o_orderpriority").alias("refs"))
    return sync.set_union(t, "id", "refs").select("id", F.array_join("refs", "|").alias("refs"))


def alive_keys(spark, sf):
    """Users whose last event isn't an error, which stands for a deletion."""
    (e,) = read(spark, sf, "events")
    t = e.select("user_id", F.col("event_id").alias("at"), F.when(F.col("event_type") == "error", "delete").otherwise("restore").alias("kind"))
    return sync.alive(t, "user_id")


def delta_graft(spark, sf):
    """Orders at or after a day, grafted onto those of priority 5: what is new, by status; a second graft adds none."""
    (o,) = read(spark, sf, "orders")
    day = 867715200000
    part = sync.delta(o.withColumn("updated_at", day_millis("o_orderdate")), day)
    new = sync.graft(o.where("o_orderpriority = '5-LOW'"), part, "o_orderkey")
    again = sync.graft(o.where("o_orderpriority = '5-LOW'").select("o_orderkey").union(new.select("o_orderkey")), part, "o_orderkey")
    a = new.groupBy("o_orderstatus").agg(F.count("*").alias("inserted"))
    return a.crossJoin(again.agg(F.count("*").alias("inserted_again")))


def payload_grafted(spark, sf):
    """A payload of orders and customers written to files, read back and grafted onto a replica that has some of them: new rows by table, and none when it is grafted again."""
    import uuid

    o, c = read(spark, sf, "orders", "customer")
    o = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), day_millis("o_orderdate").alias("updated_at"))
    c = c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("status"), (F.lit(867715200000) + F.col("c_nationkey") - 12).alias("updated_at"))
    path = f"{shared_dir(spark)}/payload-{uuid.uuid4().hex}"
    sync.write_payload(sync.payload({"orders": (o, "id"), "customers": (c, "id")}, 867715200000, 2, "own"), path)
    held = {"orders": o.where("id % 4 = 0"), "customers": c.where("id % 3 = 0")}
    return sync.graft_payload(sync.read_payload(spark, path), held, "id", 2, "own").groupBy("table", "verdict").agg(F.count("*").alias("rows"), F.sum(F.length("status")).alias("chars"))


def merged_activity(spark, sf):
    """Customers merged by nation: balances summed, the latest order and the largest total carried."""
    c, o = read(spark, sf, "customer", "orders")
    a = o.groupBy("o_custkey").agg(F.max(day_millis("o_orderdate")).alias("last"), F.max("o_totalprice").alias("top"))
    return c.join(a, c.c_custkey == a.o_custkey, "left").groupBy("c_nationkey").agg(F.round(F.sum("c_acctbal"), 2).alias("usefulness"), F.max("last").alias("last"), F.round(F.max("top"), 2).alias("arousal"))


_R = "r as (select user_id as run_id, event_id as seq, user_id || '-' || floor(event_id / 1000)::bigint as moment_id, event_type, value, (props::json->>'k')::int as k from events)"
_G = f"{_R}, b as (select run_id, seq, coalesce(lag(seq) over (partition by run_id order by seq), -1) as before from r), g as (select run_id, before + 1 as gap_from, seq - 1 as gap_to from b where seq > before + 1)"
_OUT = f"{_R}, m as (select run_id || ':' || k as t, min(moment_id) as m from r where event_type = 'click' group by 1), p as (select run_id || ':' || k as t, min(seq) as s from r where event_type = 'purchase' group by 1), o as (select case when m is null then 'orphan' when s is null then 'open' else 'closed' end as state, count(*) as n from m full join p using (t) group by 1)"

_MOMENTS = f"""with {_R}, x as (select *, lpad(seq::varchar, 12, '0') as w, run_id || ':' || k as tool, case when value > 50 then 'ok' else 'failed' end as status from r
), i as (select moment_id, arg_min(tool, seq) as tool_use_id, arg_min(case k % 3 when 1 then [] else ['0', '1', '2'] end, seq) filter (k % 3 <> 0) as rule_ids from x where event_type = 'click' group by 1
), tools as (select distinct moment_id, tool from x where event_type = 'click'
), oo as (select moment_id, w, seq, status from x where event_type = 'error' union all select t.moment_id, w, seq, status from x join tools t using (tool) where event_type = 'purchase'
), o as (select moment_id, min(w) as outcome_at, arg_min(status, (w, seq)) as outcome_status from oo group by 1
), f as (select moment_id, (k % 5)::varchar as rule, min(w) as w from x where event_type = 'view' group by 1, 2
), rd as (select f.moment_id, count(*) filter (outcome_at is null or w <= outcome_at) as reads, count(*) filter (w > outcome_at) as late from f left join i using (moment_id) left join o using (moment_id) where rule_ids is null or list_contains(rule_ids, rule) group by 1
), a as (select moment_id, arg_min(case when value > 50 then 'followed' else 'not-followed' end, seq) as answer, count(distinct value > 50) > 1 as conflict from x where event_type = 'signup' group by 1
), m as (select distinct moment_id from x where event_type <> 'purchase')
select m.moment_id, case when i.moment_id is null then 'unopened' when outcome_at is null then 'pending' else 'closed' end as state, outcome_at, outcome_status, tool_use_id, array_to_string(rule_ids, '|') as rules,
  coalesce(reads, 0)::bigint as reads, coalesce(late, 0)::bigint as late, answer, coalesce(conflict, false) as conflict from m left join i using (moment_id) left join o using (moment_id) left join rd using (moment_id) left join a using (moment_id)"""
QUERIES = {f.__name__: f for f in (ledger_gaps, gap_totals, first_fields, late_reads, outcome_states, moment_counts, loss_report, stream_counts, moment_states, stream_moments, stream_gaps, circle_moments, unmet_outcomes, last_writers, grow_only_counts, union_refs, alive_keys, delta_graft, payload_grafted, merged_activity)}
ORACLE = {
    "ledger_gaps": f"with {_G} select * from g",
    "gap_totals": f"with {_G} select run_id, count(*) as gaps, sum(gap_to - gap_from + 1)::bigint as missing from g group by 1",
    "first_fields": f"with {_R} select moment_id, {', '.join(f'''arg_min(value, seq) filter (event_type = '{k}') as {k}''' for k in ('click', 'purchase', 'error'))} from r group by 1",
    "late_reads": f"""with {_R}, o as (select moment_id, min(seq) filter (event_type = 'purchase') as outcome from r group by 1), f as (select moment_id, (k % 5)::varchar as rule_id, min(seq) as read_at from r where event_type = 'view' group by 1, 2)
select moment_id, rule_id, read_at, coalesce(read_at > outcome, false) as late from f join o using (moment_id) where rule_id in ('0', '1', '2')""",
    "outcome_states": f"with {_OUT} select * from o",
    "moment_counts": f"""with {_R} select run_id, count(*) filter (event_type in ('click', 'purchase', 'error')) as fires, count(*) filter (event_type = 'view') as silences, count(*) filter (event_type = 'signup') as unattributed,
  count(*) filter (value > 50) as ungoverned, count(*) as total from r group by 1""",
    "loss_report": f"with {_OUT}, {_G[len(_R) + 2 :]} select 'gap' as kind, count(*) as n from g union all select 'orphan', n from o where state = 'orphan'",
    "stream_counts": "select event_type as kind, count(*) as records, count(distinct user_id) as runs from events group by 1",
    "stream_gaps": f"with {_G} select run_id, count(*) as gaps, sum(gap_to - gap_from + 1)::bigint as missing from g group by 1",
    "moment_states": _MOMENTS,
    "stream_moments": _MOMENTS,
    "circle_moments": f"""with {_R}, i as (select moment_id, any_value(case when run_id % 10 <> 0 then 'c' || run_id % 3 end) as circle, arg_min(case k % 3 when 1 then 0 else 3 end, seq) filter (k % 3 <> 0) as rules, arg_min(case k % 4 when 1 then 0 else 1 end, seq) filter (k % 4 <> 0) as given from r where event_type = 'click' group by 1
), m as (select distinct moment_id from r where event_type <> 'purchase'), t as (select i.moment_id is not null as opened, circle, rules, given from m left join i using (moment_id))
select circle, count(*) filter (opened and rules > 0) as fires, count(*) filter (opened and rules = 0) as silences, count(*) filter (opened and rules is null) as ungoverned, count(*) filter (opened and given > 0) as delivered, count(*) filter (opened) as total, count(*) filter (not opened) as unopened from t group by 1""",
    "unmet_outcomes": f"with {_R} select run_id || ':' || k as tool_use_id, lpad(min(seq)::varchar, 12, '0') as outcome_at, arg_min(case when value > 50 then 'ok' else 'failed' end, seq) as outcome_status from r where event_type = 'purchase' and run_id || ':' || k not in (select run_id || ':' || k from r where event_type = 'click') group by 1",
    "last_writers": "select o_custkey as id, max(epoch_ms(o_orderdate)) as sync_revision, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as writer_id, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) as status from orders group by 1",
    "grow_only_counts": "select id, sum(n)::bigint as count from (select l_partkey as id, l_suppkey, max(l_linenumber) as n from lineitem group by 1, 2) group by 1",
    "union_refs": "select o_custkey as id, array_to_string(list_sort(list(distinct o_orderpriority)), '|') as refs from orders group by 1",
    "alive_keys": "select user_id from events group by 1 having arg_max(event_type, event_id) <> 'error'",
    "delta_graft": "select o_orderstatus, count(*) as inserted, 0::bigint as inserted_again from orders where epoch_ms(o_orderdate) >= 867715200000 and o_orderpriority <> '5-LOW' group by 1",
    "payload_grafted": """select 'orders' as "table", 'inserted' as verdict, count(*) as rows, sum(length(o_orderstatus))::bigint as chars from orders where epoch_ms(o_orderdate) >= 867715200000 and o_orderkey % 4 <> 0
union all select 'orders', 'there', count(*), sum(length(o_orderstatus))::bigint from orders where epoch_ms(o_orderdate) >= 867715200000 and o_orderkey % 4 = 0
union all select 'customers', case when c_custkey % 3 = 0 then 'there' else 'inserted' end, count(*), sum(length(c_mktsegment))::bigint from customer where c_nationkey >= 12 group by 2""",
    "merged_activity": "select c_nationkey, round(sum(c_acctbal), 2) as usefulness, max(last) as last, round(max(top), 2) as arousal from customer left join (select o_custkey, max(epoch_ms(o_orderdate)) as last, max(o_totalprice) as top from orders group by 1) on o_custkey = c_custkey group by 1",
}
