"""Gate queries: patterns met by actions, rules in order, constraints and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestore.operators import gates
from lodestore.sources import mirror
from lodestore.sources.tables import day_millis, read


def _actions(spark, sf):
    """Parts as actions: the type is the tool, name and brand the words."""
    (p,) = read(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("action_id"), F.lower("p_type").alias("tool"), F.concat(F.split(F.lower("p_name"), " "), F.array(F.lower("p_brand"))).alias("tokens"))


def _patterns(spark, sf):
    """Stages: each last word of a name followed by its brand, by type; those of brands of one digit are for one tool."""
    (p,) = read(spark, sf, "part")
    t = p.select(F.lower(F.element_at(F.split("p_name", " "), -1)).alias("w"), F.lower("p_brand").alias("b"), F.lower("p_type").alias("tool")).distinct()
    return t.select(F.concat_ws("/", "w", "b", "tool").alias("stage_id"), F.when(F.length("b") == 7, F.col("tool")).alias("tool"), F.array("w", "b").alias("tokens"))


def gate_matches(spark, sf):
    return gates.matches(_actions(spark, sf), _patterns(spark, sf))


def _bindings(spark, sf):
    """Orders as rule bindings at their customer's stage."""
    (o,) = read(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("concept_id"), F.col("o_custkey").alias("stage_id"), F.when(F.col("o_orderpriority") == "1-URGENT", "blocking").otherwise("advice").alias("severity"),
        F.when(F.col("o_orderstatus") == "F", "declaration").otherwise("correction").alias("origin"), F.when(F.col("o_totalprice") > 400000, "agent").otherwise("circle").alias("scope"),
        F.when(F.col("o_totalprice") > 450000, "m").alias("model_tag"), F.lit("c").alias("circle"), day_millis("o_orderdate").alias("created_at"),
    )


def stage_rules(spark, sf):
    """The first three live rules of each stage: blocking first, then oldest; retired and superseded ones left out."""
    o = read(spark, sf, "orders")[0]
    concepts = o.select(F.col("o_orderkey").alias("concept_id"), F.when(F.col("o_orderstatus") == "P", "retired").otherwise("active").alias("status"))
    superseded = o.where("o_totalprice < 20000").select(F.col("o_orderkey").alias("dst_concept_id"))
    r = gates.ordered_rules(gates.live_rules(_bindings(spark, sf), concepts, superseded))
    return r.where("place <= 3").select("stage_id", "place", "concept_id", "severity")


def gate_coverage(spark, sf):
    b = _bindings(spark, sf)
    return b.groupBy("severity").agg(F.count_distinct("stage_id").alias("stages"), F.count("*").alias("rules"), F.count_if(F.col("model_tag").isNull()).alias("untagged"))


def constraint_violations(spark, sf):
    return gates.violations(_bindings(spark, sf)).groupBy("broken").agg(F.count("*").alias("n"))


def verdicts(spark, sf):
    """The latest verdict on each part: its last line's flag by ship date, then order."""
    (li,) = read(spark, sf, "lineitem")
    return gates.latest_verdict(li.select(F.col("l_partkey").alias("subject_concept_id"), F.col("l_returnflag").alias("verdict"), F.col("l_shipdate").alias("created_at"), F.struct("l_orderkey", "l_linenumber", "l_suppkey").alias("id")))


def snapshot_hash(spark, sf):
    """A digest of each stage's sorted state, and of none of its order of arrival."""
    return mirror.state_hash(_bindings(spark, sf), ["stage_id"], ["concept_id", "severity"])


def skeleton_hashes(spark, sf):
    """Orders as their customer's skeleton: a digest of its canonical JSON."""
    (o,) = read(spark, sf, "orders")
    body = F.concat("o_orderpriority", F.lit('\n"\\'), "o_orderstatus")
    t = o.select(F.col("o_custkey").alias("circle"), F.col("o_orderkey").cast("string").alias("concept_id"), body.alias("body"), F.when(F.col("o_orderstatus") != "P", F.lit("global")).alias("breadth"))
    return mirror.skeleton_hash(t, ["circle"])


_B = "b as (select o_orderkey as id, o_custkey as stage_id, case when o_orderpriority = '1-URGENT' then 'blocking' else 'advice' end as severity, o_orderstatus as st, o_totalprice as p, o_orderdate as made from orders)"
QUERIES = {f.__name__: f for f in (gate_matches, stage_rules, gate_coverage, constraint_violations, verdicts, snapshot_hash, skeleton_hashes)}
ORACLE = {
    "gate_matches": """with a as (select p_partkey as action_id, lower(p_type) as tool, ' ' || lower(p_name) || ' ' || lower(p_brand) || ' ' as t from part), s as (
  select distinct split_part(lower(p_name), ' ', -1) as w, lower(p_brand) as b, lower(p_type) as tool from part)
select distinct action_id, w || '/' || b || '/' || s.tool as stage_id from a join s on contains(a.t, ' ' || w || ' ' || b || ' ') and (length(b) <> 7 or s.tool = a.tool)""",
    "stage_rules": f"with {_B}, k as (select *, row_number() over (partition by stage_id order by severity <> 'blocking', made, id) as place from b where st <> 'P' and p >= 20000) select stage_id, place::int as place, id as concept_id, severity from k where place <= 3",
    "gate_coverage": f"with {_B} select severity, count(distinct stage_id) as stages, count(*) as rules, count(*) filter (not p > 450000) as untagged from b group by 1",
    "constraint_violations": f"with {_B}, v as (select 'blocking-needs-declaration' as broken from b where severity = 'blocking' and st <> 'F' union all select 'agent-needs-model' from b where (p > 400000) <> (p > 450000)) select broken, count(*) as n from v group by 1",
    "verdicts": "select l_partkey as subject_concept_id, arg_max(l_returnflag, (l_shipdate, l_orderkey, l_linenumber, l_suppkey)) as verdict from lineitem group by 1",
    "skeleton_hashes": r"""select o_custkey as circle, sha256('[' || string_agg('{"conceptId":"' || o_orderkey || '","body":"' || o_orderpriority || '\n\"\\' || o_orderstatus || '","breadth":' || case when o_orderstatus <> 'P' then '"global"' else 'null' end || '}', ',' order by o_orderkey::varchar) || ']') as digest, count(*) as members from orders group by 1""",
    "snapshot_hash": f"with {_B} select stage_id, sha256('[' || string_agg('{{\"concept_id\":' || id || ',\"severity\":\"' || severity || '\"}}', ',' order by id) || ']') as digest, count(*) as rows from b group by 1",
}
