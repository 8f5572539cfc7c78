"""Gates composed from patterns, rules and caps; their offline twin, reports and checks; conformance of the moment ledger."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from lodestore.operators import gates, ledger, lifecycle
from lodestore.plans import ledgers, rules
from lodestore.sources import mirror
from lodestore.sources.tables import day_millis, read
from lodestore.staging import shared_dir

OVERFLOW, CAP, BODY, REASON = 400, 3, 24, 6


def _stage_id():
    return F.concat_ws("/", F.lower(F.element_at(F.split("p_name", " "), -1)), F.lower("p_brand"), F.lower("p_type"))


def _rules(spark, sf):
    """Parts as rules at the stage of their name, brand and type; those of every seventh size are retired, some superseded."""
    (p,) = read(spark, sf, "part")
    z = F.col("p_size")
    r = p.select(
        F.col("p_partkey").alias("concept_id"), _stage_id().alias("stage_id"), F.when(z % 10 == 0, "blocking").otherwise("advice").alias("severity"), z.cast("long").alias("created_at"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("body"),
        F.when(z % 9 == 0, F.lit(None)).when(z % 9 == 1, "  ").when(z % 9 == 2, F.concat("p_name", F.lit("\n"), "p_type")).otherwise(F.concat_ws(" ", "p_brand", z.cast("string"))).alias("reason"),
        F.when(z % 4 == 0, "agent").otherwise("circle").alias("scope"), F.when(z % 8 == 0, "m").when(z % 8 == 4, "n").alias("model_tag"), F.lower("p_type").alias("circle"),
    )
    concepts = p.select(F.col("p_partkey").alias("concept_id"), F.when(z % 7 == 0, "retired").otherwise("active").alias("status"))
    return r, gates.live_rules(r, concepts, p.where("p_size % 11 = 0").select(F.col("p_partkey").alias("dst_concept_id")))


def _stages(spark, sf):
    """Stages with their patterns as JSON: the sound one, beside an empty one at brands of two digits."""
    (p,) = read(spark, sf, "part")
    t = p.select(_stage_id().alias("stage_id"), F.lower("p_type").alias("circle"), F.lower(F.element_at(F.split("p_name", " "), -1)).alias("w"), F.lower("p_brand").alias("b")).distinct()
    one = F.when(F.length("b") == 7, F.to_json(F.array(F.struct(F.col("circle").alias("tool"), F.array("w", "b").alias("tokens"))))).otherwise(
        F.to_json(F.array(F.struct(F.lit(None).cast("string").alias("tool"), F.array("w", "b").alias("tokens")), F.struct(F.lit(None).cast("string").alias("tool"), F.array().cast("array<string>").alias("tokens"))))
    )
    return t.select("stage_id", "circle", F.when(F.col("w") == "gadget", "no list").otherwise(one).alias("patterns"), (F.length("b") == 7).alias("verified"))


def pattern_reads(spark, sf):
    """Stages' patterns as read, and how many weren't sound."""
    r = gates.read_patterns(_stages(spark, sf))
    return r.select("stage_id", F.size("patterns").alias("patterns"), F.array_join(F.get("patterns", F.lit(0))["tokens"], " ").alias("first"), "n_malformed")


def _digest(ids):
    return F.md5(F.array_join(ids, ","))


def gate_query(spark, sf):
    """What every action meets: its primary stage, severity, rules, and whether their bodies overflow."""
    return gates.gate(rules._actions(spark, sf), rules._patterns(spark, sf), _rules(spark, sf)[1], OVERFLOW, _digest)


def gate_offline(spark, sf):
    """The same over a mirrored snapshot of the live rules."""
    path = f"{shared_dir(spark)}/mirror-{uuid.uuid4().hex}"
    live = _rules(spark, sf)[1].select("concept_id", "stage_id", "severity", "created_at", "body")
    mirror.write_mirror(live, path, 1)
    state, held = mirror.read_mirror(spark, path, "concept_id long, stage_id string, severity string, created_at long, body string", 1)
    if state != "fresh":
        raise RuntimeError(f"the mirror just written is {state}")
    return gates.gate(rules._actions(spark, sf), rules._patterns(spark, sf), held, OVERFLOW, _digest)


def stage_lookup(spark, sf):
    """Each stage's first rules with clipped bodies and reasons, and how many it has beyond them."""
    return gates.stage_lookup(_rules(spark, sf)[1], CAP, BODY, REASON)


def disputed_parents(spark, sf):
    """Rules whose parents were last rejected or retired: the orders of a part are its parents."""
    li = read(spark, sf, "lineitem")[0]
    parents = li.select(F.col("l_partkey").alias("concept_id"), F.col("l_orderkey").alias("parent_id"))
    o = read(spark, sf, "orders")[0].select(F.col("o_orderkey").alias("subject_concept_id"), F.when(F.col("o_orderstatus") == "F", "reject").when(F.col("o_orderstatus") == "P", "retire").otherwise("approve").alias("verdict"))
    t = gates.disputed_parents(_rules(spark, sf)[1], parents, o)
    return t.select("concept_id", F.array_join("parent_ids", ",").alias("parent_ids"), "more")


def model_rules(spark, sf):
    """Live rules by stage for all models, for one, and for another."""
    live = _rules(spark, sf)[1]
    parts = [gates.for_model(live, m).groupBy(F.lit(m or "all").alias("model"), "circle").agg(F.count("*").alias("n")) for m in (None, "m", "n")]
    return reduce(lambda a, b: a.union(b), parts)


def gate_reports(spark, sf):
    """Five reports on the gates' coverage, the first five lines of each and the rest counted."""
    r, live = _rules(spark, sf)
    s = _stages(spark, sf)
    s = s.join(gates.read_patterns(s).select("stage_id", "n_malformed"), "stage_id")
    bindings = r.withColumn("stage_id", F.when(F.col("created_at") == 4, "gone").otherwise(F.col("stage_id")))
    denies = r.where("severity = 'blocking'").select("stage_id", F.when(F.col("created_at") == 20, F.array("concept_id")).otherwise(F.array().cast("array<bigint>")).alias("rule_ids"))
    parts = gates.coverage(s, bindings, live.where("created_at > 15"), denies, 5)
    return reduce(lambda a, b: a.union(b), [t.select(F.lit(n).alias("report"), "key", "n", "place", "omitted") for n, t in parts.items()])


def mirror_listing(spark, sf):
    alias = read(spark, sf, "part")[0].select(F.concat(F.lower("p_type"), F.lit("-"), F.length("p_brand")).alias("from_name"), F.lower("p_type").alias("to_name"))
    t = gates.mirror_rows(_stages(spark, sf).select("stage_id", "circle"), _rules(spark, sf)[1], alias)
    return t.select("stage_id", F.array_join("circles", ",").alias("circles"), F.array_join("rule_ids", ",").alias("rule_ids"))


def stage_names(spark, sf):
    """The first 2,000 distinct stage names."""
    return _stages(spark, sf).select("stage_id").distinct().orderBy("stage_id").limit(2000)


def refused_bindings(spark, sf):
    return gates.refused_bindings(_rules(spark, sf)[0], _stages(spark, sf).where("verified"))


def edge_violations(spark, sf):
    """Orders as lifecycle edges to their customers: several successors, spans without provenance, edges onto themselves."""
    (o,) = read(spark, sf, "orders")
    e = o.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("src"), F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderkey")).otherwise(F.col("o_custkey")).alias("dst"),
        F.when(F.col("o_orderstatus") == "O", "supersedes").when(F.col("o_orderstatus") == "F", "provenance").otherwise("derivation").alias("family"), F.when(F.col("o_totalprice") > 250000, "span://h/s#a").alias("dst_span"), F.col("o_orderdate").alias("created_at"),
    )
    return gates.edge_violations(e).groupBy("broken").agg(F.count("*").alias("n"))


def shared_reasons(spark, sf):
    return gates.extraction_candidates(_rules(spark, sf)[1])


def action_seeds(spark, sf):
    """A pattern from every turn taken as a shell command, by the tokeniser in Arrow batches and array functions."""
    (c,) = read(spark, sf, "conversations")
    t = c.select("conv_id", "turn", gates.parse_actions(F.concat(F.lit("Bash: run --turn "), F.coalesce("text", F.lit("")))).alias("a"))
    return t.select("conv_id", "turn", "a.tool", F.size("a.tokens").alias("tokens"), F.array_join(gates.seed_pattern(F.col("a.tokens")), " ").alias("seed"))


def verdict_breaks(spark, sf):
    """Verdicts that may not follow the one before: a part's lines in order of shipping."""
    (li,) = read(spark, sf, "lineitem")
    verdict = F.when(F.col("l_returnflag") == "A", "approve").when(F.col("l_returnflag") == "R", "retire").otherwise("re-ratify")
    t = li.select(F.struct("l_orderkey", "l_linenumber", "l_suppkey").alias("id"), F.col("l_partkey").alias("subject_concept_id"), verdict.alias("verdict"), F.col("l_shipdate").alias("created_at"))
    return lifecycle.illegal_verdicts(t).groupBy("before", "verdict").agg(F.count("*").alias("n"))


def skeletons(spark, sf):
    """The skeleton of the building circle and of what holds everywhere, by the time of the grant."""
    o, c = read(spark, sf, "orders", "customer")
    concepts = c.select(F.col("c_custkey").alias("concept_id"), F.when(F.col("c_nationkey") == 3, "*").otherwise(F.lower("c_mktsegment")).alias("circle"), F.when(F.col("c_nationkey") % 7 == 0, "retired").otherwise("active").alias("status"))
    verdict = F.when(F.col("o_orderstatus") == "O", "approve").when(F.col("o_orderstatus") == "F", "reject").otherwise("re-ratify")
    r = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("subject_concept_id"), verdict.alias("verdict"), day_millis("o_orderdate").alias("created_at"))
    return lifecycle.skeleton(concepts, r, "building")


def _moments(spark, sf):
    """Events as a ledger: clicks ask, purchases answer, views read; moments have rules, none, or no record of them."""
    t = ledgers._records(spark, sf)
    k = F.get_json_object("props", "$.k").cast("int")
    said = F.when(k % 3 == 0, "not-followed").otherwise("followed")
    r = t.withColumns({"kind": F.when(F.col("event_type") == "click", "ask").when((F.col("event_type") == "purchase") & (k % 20 == 0), "answer").when(F.col("event_type") == "view", "read"), "answer": F.when((F.col("event_type") == "purchase") & (k % 20 == 0), said), "k": k})
    a = ledger.answers(r)
    m = t.groupBy("moment_id").agg(F.min("seq").alias("at"), F.min(F.when(F.col("event_type") == "error", F.col("seq"))).alias("outcome_at"))
    listed = F.when(F.col("at") % 5 == 0, F.lit(None).cast("array<string>")).when(F.col("at") % 5 == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("0"), F.lit("1"), F.lit("2")))
    reads = r.where("kind = 'read'").select("run_id", "seq", F.when(F.col("k") % 10 > 0, F.col("moment_id")).alias("moment_id"), (F.col("k") % 5).cast("string").alias("rule_id"), F.col("seq").alias("read_at"), F.when(F.col("k") % 4 == 0, F.concat(F.lit("stage-"), F.col("k") % 7)).alias("named_stage_id"))
    return m.join(a, "moment_id").withColumn("rule_ids", listed), reads


def moment_conformance(spark, sf):
    m, reads = _moments(spark, sf)
    return ledger.conformance(m, ledger.reads(reads, m), ledger.unjoinable(reads, m))


def moment_answers(spark, sf):
    """First asks and answers of every moment, and answers that contradict the first."""
    return _moments(spark, sf)[0].select("moment_id", "asked", "answer", "conflict")


def owing_questions(spark, sf):
    """The eight oldest moments that were asked and not answered."""
    return ledger.owing(_moments(spark, sf)[0], 8).select("moment_id", "at")


def stage_reads(spark, sf):
    return ledger.stage_reads(_moments(spark, sf)[1])


def gap_losses(spark, sf):
    """Gaps with what is known of their runs: those of odd users have a record."""
    t = ledgers._records(spark, sf)
    runs = t.where("run_id % 2 = 1").groupBy("run_id").agg(F.min("seq").alias("first_seq"), F.count("*").alias("records"))
    return ledger.losses(ledger.gaps(t), runs)


def spool_statuses(spark, sf):
    """Events as spool lines of which some are broken and some of a newer version: how many of either."""
    from lodestore.streaming import spool

    (e,) = read(spark, sf, "events")
    i = F.col("event_id")
    line = F.to_json(F.struct(F.when(i % 13 == 0, 2).otherwise(1).alias("v"), F.col("user_id").cast("string").alias("runId"), i.alias("seq"), F.col("event_type").alias("kind")))
    return spool.parse(e.select(F.when(i % 11 == 0, F.substring(line, 1, 10)).otherwise(line).alias("value"))).groupBy("status").agg(F.count("*").alias("n"))


_SID = "split_part(lower(p_name), ' ', -1) || '/' || lower(p_brand) || '/' || lower(p_type)"
_RULES = f"""ru as (select p_partkey as concept_id, {_SID} as stage_id, case when p_size % 10 = 0 then 'blocking' else 'advice' end as severity, p_size::bigint as created_at, p_name || ' ' || p_brand || ' ' || p_type as body,
  case p_size % 9 when 0 then null when 1 then '  ' when 2 then p_name || chr(10) || p_type else p_brand || ' ' || p_size end as reason, p_size % 4 = 0 as agent, case p_size % 8 when 0 then 'm' when 4 then 'n' end as tag, lower(p_type) as circle, p_size from part
), lv as (select * from ru where p_size % 7 <> 0 and p_size % 11 <> 0)"""
_STAGES = f"""st as (select distinct {_SID} as stage_id, lower(p_type) as circle, length(p_brand) = 7 as verified, split_part(lower(p_name), ' ', -1) as w, lower(p_brand) as b from part
), sm as (select *, case when w = 'gadget' then 1 when verified then 0 else 1 end as n_malformed from st)"""
_GATE = f"""with {_RULES}, a as (select p_partkey as action_id, lower(p_type) as tool, ' ' || lower(p_name) || ' ' || lower(p_brand) || ' ' as t from part), s as (select distinct split_part(lower(p_name), ' ', -1) as w, lower(p_brand) as b, lower(p_type) as tool from part
), hit as (select distinct action_id, w || '/' || b || '/' || s.tool as stage_id from a join s on contains(a.t, ' ' || w || ' ' || b || ' ') and (length(b) <> 7 or s.tool = a.tool)
), met as (select action_id, lv.* from hit join lv using (stage_id))
select action_id, arg_min(stage_id, (severity <> 'blocking', created_at, concept_id)) as primary_stage, case when count(*) filter (severity = 'blocking') > 0 then 'blocking' else 'advice' end as severity, count(distinct stage_id) as stages, count(distinct concept_id) as rules,
  md5(array_to_string(list_sort(list(distinct concept_id)), ',')) as rule_ids, sum(length(body)) > {OVERFLOW} as overflow from met group by 1"""
_MOMENTS = f"""{ledgers._R}, mo as (select moment_id, min(seq) as at0, min(case when event_type = 'error' then seq end) as outcome, count(*) filter (event_type = 'click') > 0 as asked, arg_min(case when k % 3 = 0 then 'not-followed' else 'followed' end, seq) filter (event_type = 'purchase' and k % 20 = 0) as answer,
  count(distinct case when event_type = 'purchase' and k % 20 = 0 then k % 3 = 0 end) > 1 as conflict from r group by 1
), rd as (select run_id, seq, case when k % 10 > 0 then moment_id end as moment_id, (k % 5)::varchar as rule_id, case when k % 4 = 0 then 'stage-' || (k % 7) end as named from r where event_type = 'view'
), jn as (select rd.*, at0, outcome, coalesce(at0 % 5 > 1 and rule_id in ('0', '1', '2'), false) as fits from rd left join mo using (moment_id)
), lt as (select moment_id, rule_id, min(seq) > any_value(outcome) as late from jn where fits group by 1, 2)"""

QUERIES = {
    f.__name__: f
    for f in (
        pattern_reads, gate_query, gate_offline, stage_lookup, disputed_parents, model_rules, gate_reports, mirror_listing, stage_names, refused_bindings, edge_violations, shared_reasons, action_seeds, verdict_breaks, skeletons, moment_conformance,
        moment_answers, owing_questions, stage_reads, gap_losses, spool_statuses,
    )
}
ORACLE = {
    "pattern_reads": f"with {_STAGES} select stage_id, case when w = 'gadget' then 0 else 1 end as patterns, case when w <> 'gadget' then w || ' ' || b end as first, n_malformed from sm",
    "gate_query": _GATE,
    "gate_offline": _GATE,
    "stage_lookup": f"""with {_RULES}, k as (select *, row_number() over (partition by stage_id order by severity <> 'blocking', created_at, concept_id) as place, count(*) over (partition by stage_id) as n from lv)
select stage_id, place::int as place, concept_id, severity, left(body, {BODY}) as body, length(body) > {BODY} as body_cut, left(reason, {REASON}) as reason, length(reason) > {REASON} as reason_cut, greatest(n - {CAP}, 0) as omitted from k where place <= {CAP}""",
    "disputed_parents": f"""with {_RULES}, p as (select distinct concept_id, o_orderkey as parent from lv join lineitem on l_partkey = concept_id join orders on o_orderkey = l_orderkey where o_orderstatus in ('F', 'P'))
select concept_id, array_to_string(list_slice(list_sort(list(parent)), 1, 8), ',') as parent_ids, count(*) > 8 as more from p group by 1""",
    "model_rules": f"with {_RULES} select m.model, circle, count(*) as n from lv, (values ('all'), ('m'), ('n')) as m(model) where m.model = 'all' or not agent or tag = m.model group by 1, 2",
    "gate_reports": f"""with {_RULES}, {_STAGES}, l as (select stage_id, count(*) as n from lv where p_size > 15 group by 1), rep as (
  select 'live' as report, stage_id as key, n from l
  union all select 'unverified', stage_id, n_malformed from sm where not verified or n_malformed > 0
  union all select 'retirement', stage_id, 0 from sm where stage_id not in (select stage_id from l)
  union all select 'agents', case when p_size = 4 then '?' else stage_id end, count(*) from ru where agent group by 1, 2
  union all select 'unexplained', stage_id, count(*) from ru where severity = 'blocking' and p_size <> 20 group by 1, 2
), k as (select *, row_number() over (partition by report order by n desc, key) as place, count(*) over (partition by report) as c from rep)
select report, key, n, place::int as place, greatest(c - 5, 0) as omitted from k where place <= 5""",
    "mirror_listing": f"""with {_RULES}, {_STAGES}, al as (select lower(p_type) as circle, array_to_string(list_sort(list(distinct lower(p_type) || '-' || length(p_brand))), ',') as names from part group by 1
), o as (select stage_id, string_agg(concept_id::varchar, ',' order by severity <> 'blocking', created_at, concept_id) as rule_ids from lv group by 1)
select stage_id, circle || ',' || names as circles, rule_ids from st join o using (stage_id) join al using (circle)""",
    "stage_names": f"with {_STAGES} select stage_id from st order by 1 limit 2000",
    "refused_bindings": f"""with {_RULES}, {_STAGES}, w as (select concept_id, stage_id in (select stage_id from st where verified) as known, case when reason is null then 'missing' when trim(reason) = '' then 'blank' when contains(reason, chr(10)) then 'line-break' end as why from ru)
select concept_id, case when not known then 'unknown-stage' else 'reason-' || why end as refused from w where not known or why is not null""",
    "edge_violations": """with e as (select o_orderkey as id, o_custkey as c, o_orderpriority = '1-URGENT' as self, o_orderstatus as f, o_totalprice > 250000 as span, o_orderdate as made, case when o_orderpriority = '1-URGENT' then o_orderkey else o_custkey end as dst from orders), v as (
  select 'provenance-needs-span' as broken from e where (f = 'F') <> span union all select 'self-edge' from e where id = dst union all select 'second-successor' from (select row_number() over (partition by dst order by made, id) as k from e where f = 'O') where k > 1)
select broken, count(*) as n from v group by 1""",
    "shared_reasons": f"with {_RULES}, t as (select lower(trim(regexp_replace(reason, '\\s+', ' ', 'g'))) as reason, stage_id from lv) select reason, count(distinct stage_id) as stages, count(*) as rules from t where reason <> '' group by 1 having count(distinct stage_id) > 1",
    "verdict_breaks": """with t as (select case l_returnflag when 'A' then 'approve' when 'R' then 'retire' else 're-ratify' end as verdict, l_partkey as p, l_shipdate as made, l_orderkey as o, l_linenumber as n, l_suppkey as s from lineitem
), b as (select verdict, lag(verdict) over (partition by p order by made, o, n, s) as before from t) select before, verdict, count(*) as n from b
where not (before is null and verdict = 'approve' or coalesce(before, '') = 'approve' and verdict = 'retire' or coalesce(before, '') = 'retire' and verdict = 're-ratify' or coalesce(before, '') = 're-ratify' and verdict = 'retire') group by 1, 2""",
    "skeletons": """with c as (select c_custkey as concept_id, case when c_nationkey = 3 then '*' else lower(c_mktsegment) end as circle from customer where c_nationkey % 7 <> 0
), l as (select o_custkey as concept_id, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) as v, max(epoch_ms(o_orderdate)) as granted_at from orders group by 1)
select concept_id, circle, granted_at from c join l using (concept_id) where v <> 'F' and circle in ('building', '*')""",
    "moment_conformance": f"""with {_MOMENTS} select count(*) filter (answer = 'followed') as followed, count(*) filter (answer = 'not-followed') as not_followed, count(*) filter (asked and answer is null) as unanswered, count(*) filter (at0 % 5 > 1 and not asked) as not_asked,
  (select count(*) from lt where late) as read_late, (select count(*) from jn where not fits) as unjoinable_reads from mo""",
    "moment_answers": f"with {_MOMENTS} select moment_id, asked, answer, conflict from mo",
    "owing_questions": f"with {_MOMENTS} select moment_id, at0 as at from mo where asked and answer is null order by at0, moment_id limit 8",
    "stage_reads": f"with {_MOMENTS} select named as named_stage_id, count(*) as reads from rd where named is not null group by 1",
    "gap_losses": f"with {ledgers._G}, u as (select run_id, min(seq) as first_seq, count(*) as records from r where run_id % 2 = 1 group by 1) select g.*, first_seq, records from g left join u using (run_id)",
    "spool_statuses": "select case when event_id % 11 = 0 then 'malformed' when event_id % 13 = 0 then 'future' else 'ok' end as status, count(*) as n from events group by 1",
}
