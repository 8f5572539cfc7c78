"""The memory's own queries: composed search, resolution with its overrides, contradictions, queues and overviews."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestore.functions.segments import segment_budget
from lodestore.functions.text import lexical_tokens
from lodestore.operators import graph, lifecycle, queues, ranking, resolution, retrieval
from lodestore.plans import search
from lodestore.sources.tables import CONCEPTS_SQL, OBSERVATIONS_SQL, concepts, memberships, observations, read, vectors
from lodestore.staging import stage

NOW_MS, STALE_MS = 1_100_000_000_000, 40_000_000_000
#: Characters of an overview: room for most, for some, and for hardly any of it.
BUDGETS = (900, 500, 120)
CAPS = {"living": 5, "duplicates": 10, "contradictions": 5, "dirty": 5, "stale": 5}


def _store(spark, sf):
    """Vectors as observations with texts: every third has two segments, every eleventh is superseded; concepts lie in four circles."""
    d = read(spark, sf, "documents")[0].select(F.col("doc_id").alias("observation_id"), F.coalesce("text", F.lit("")).alias("content"))
    i = F.col("observation_id")
    v = vectors(spark, sf).join(d, "observation_id", "left").withColumns({"superseded_by": F.when(i % 11 == 0, i + 1), "superseded_at": F.lit(None).cast("long"), "circle": F.concat(F.lit("c"), F.col("concept_id") % 4)})
    cut = v.where(i % 3 == 0)
    return v, cut.select("observation_id", "embedding").union(cut.select("observation_id", F.reverse("embedding")))


def search_composed(spark, sf):
    """Search as one call, for every stated query: live observations by segment, circles that aren't archived, the lexical arm, the floor, the home circle first at equal ranks."""
    v, parts = _store(spark, sf)
    archived = F.col("circle") == "c3"
    v = v.where(~archived)
    q = search._queries(vectors(spark, sf))
    b = read(spark, sf, "benchmark")[0].select((F.col("item_id") * 50).alias("query_id"), F.explode(lexical_tokens(F.coalesce("text", F.lit("")))).alias("token"))
    texts = retrieval.live(v).select("observation_id", "concept_id", F.coalesce("content", F.lit("")).alias("content"))
    return retrieval.search(retrieval.scorable(v, parts), texts, q.select("query_id", "embedding"), b, v.select("concept_id", "circle").distinct(), "c1", 5).select("query_id", "concept_id", "observation_id", F.round("score", 6).alias("score"), F.round("rank", 6).alias("rank"), "place")


def _decided(spark, sf):
    """Decisions on every stated query, and what it and its nominee are."""
    d = search._resolved(spark, sf).join(search.nominate_loo(spark, sf).select("query_id", "concept_id"), "query_id", "left")
    return d.withColumns({"kind": F.when(F.col("query_id") % 100 == 0, "rule").otherwise("fact"), "home_kind": F.when(F.col("concept_id") % 2 == 0, "rule").otherwise("fact"), "stage": F.col("query_id") % 3, "home_stage": F.col("concept_id") % 3})


def fork_overrides(spark, sf):
    """Attachments refused because kinds don't go together, or a rule is bound to another stage."""
    t = _decided(spark, sf).withColumns({"action": F.lit("attached"), "mode": F.lit("attach")})
    d = resolution.overridden(F.col("action"), F.col("mode"), F.col("kind"), F.col("home_kind"), F.col("stage"), F.col("home_stage"), [("fact", "fact"), ("rule", "rule")])
    return t.select("query_id", d["action"].alias("action"), d["mode"].alias("mode"))


def _profiled(spark, sf):
    d = search._resolved(spark, sf, *resolution.PROFILES["hashing"][:2]).join(search.nominate_loo(spark, sf).select("query_id", "concept_id"), "query_id", "left")
    return d.withColumns({"kind": F.when(F.col("query_id") % 100 == 0, "rule").otherwise("fact"), "home_kind": F.when(F.col("concept_id") % 2 == 0, "rule").otherwise("fact"), "stage": F.col("query_id") % 3, "home_stage": F.col("concept_id") % 3})


def resolved_by_profile(spark, sf):
    """Every stated query by the hashing embedder's bands, then by kind and stage: decision and override as one chain."""
    t = _profiled(spark, sf)
    d = resolution.overridden(F.col("action"), F.col("mode"), F.col("kind"), F.col("home_kind"), F.col("stage"), F.col("home_stage"), [("fact", "fact"), ("rule", "rule")])
    return t.select("query_id", F.col("mode").alias("band"), d["action"].alias("action"), d["mode"].alias("mode"))


def directed_ingest(spark, sf):
    """attachTo and forceNew go before the bands, and exclude each other."""
    t = search._resolved(spark, sf)
    i = F.col("query_id")
    d = resolution.directed(F.col("action"), F.col("mode"), F.when(i % 200 == 0, i % 7), i % 300 == 0)
    return t.select("query_id", d["action"].alias("action"), d["mode"].alias("mode"))


def first_receipts(spark, sf):
    """The first receipt of each operation: a user's events of one kind are one operation, replayed."""
    (e,) = read(spark, sf, "events")
    t = e.select(F.concat_ws("-", "user_id", "event_type").alias("operation_id"), F.col("event_id").alias("created_at"), F.col("event_id").alias("id"))
    return resolution.first_by_operation(t).select("operation_id", "id")


def contradiction_queue(spark, sf):
    """Each circle's five oldest contradictions, and how many more there are."""
    c = queues.contradictions(observations(spark, sf)).join(concepts(spark, sf).select("concept_id", "circle"), "concept_id")
    return queues.capped(c, ["circle"], ["opened_at", "observation_id"], 5).select("circle", "concept_id", "observation_id", "priors", "contradicted", "place", "omitted")


def contradictions_resolved(spark, sf):
    """All contradictions closed one way or another: by id they are accepted, kept or dismissed; every fifth brings a body."""
    i = F.col("observation_id")
    action = F.when(i % 3 == 0, "accept-new").when(i % 3 == 1, "keep-current").otherwise("dismiss")
    return queues.resolved(queues.contradictions(observations(spark, sf)), action, F.when(i % 5 == 0, F.lit("body")))


def disputes(spark, sf):
    d = queues.disputed(concepts(spark, sf), queues.contradictions(observations(spark, sf)), 0.8)
    return d.withColumn("confidence", F.round("confidence", 9))


def _pairs(spark, sf):
    """Possible duplicates of each customer: the customer of the same nation with the next id, weighted by their balances; every seventh pair was dismissed."""
    c = read(spark, sf, "customer")[0]
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    t = c.select(F.col("c_custkey").alias("src"), F.lead("c_custkey").over(w).alias("dst"), F.round((F.col("c_acctbal") + 1000) / 11000, 6).alias("weight")).where("dst is not null")
    both = t.union(t.select("dst", "src", F.col("weight") / 2))
    return queues.duplicates(both, t.where("src % 7 = 0"))


def duplicate_queue(spark, sf):
    """Each circle's ten surest possible duplicates, and how many more there are."""
    p = _pairs(spark, sf).join(concepts(spark, sf).select(F.col("concept_id").alias("a"), "circle"), "a")
    return queues.capped(p, ["circle"], [F.col("weight").desc(), "a", "b"], 10).select("circle", "a", "b", "weight", "place", "omitted")


def dirty_worklist(spark, sf):
    """Concepts to synthesise, with the body and title that their live evidence gives."""
    o = observations(spark, sf)
    done = o.where("observation_id % 3 = 0").groupBy("concept_id").agg(F.max("created_at").alias("at"))
    t = queues.dirty(concepts(spark, sf), o, done)
    body = lifecycle.synthesis(retrieval.live(o))
    return t.join(body, "concept_id", "left").select("concept_id", "circle", "newest", F.md5("body").alias("body_md5"), "title")


def overview(spark, sf):
    """All sections of every circle's overview."""
    parts = queues.overview(concepts(spark, sf), observations(spark, sf), _pairs(spark, sf), NOW_MS, STALE_MS, CAPS)
    return reduce(lambda a, b: a.unionByName(b), [t.select(F.lit(name).alias("section"), "*") for name, t in parts.items()])


def _sections(spark, sf):
    """Every circle's overview as texts, with a skeleton of its first five concepts."""
    o = overview(spark, sf).select("circle", "section", "place", F.concat_ws("/", "section", "concept_id", "place", "omitted").alias("text"))
    w = Window.partitionBy("circle").orderBy("concept_id")
    k = concepts(spark, sf).where("status <> 'retired' and kind <> 'workstream'").withColumn("place", F.row_number().over(w)).where("place <= 5")
    return o.union(k.select("circle", F.lit("skeleton").alias("section"), "place", F.repeat(F.concat_ws("-", "circle", "concept_id"), F.col("place") * 4).alias("text")))


def overview_envelopes(spark, sf):
    """How every circle's overview is brought within three budgets: rungs dropped, then the skeleton clipped."""
    s = stage(_sections(spark, sf), "sections")
    parts = [queues.fitted(s, b)[0].select(F.lit(b).alias("budget"), "*") for b in BUDGETS]
    return reduce(lambda a, b: a.union(b), parts)


def stale_concepts(spark, sf):
    """Concepts whose last confirmation is too long ago, whatever came after it."""
    o = retrieval.live(observations(spark, sf)).groupBy("concept_id").agg(F.max("created_at").alias("confirmed"))
    return concepts(spark, sf).join(o, "concept_id").where(ranking.stale(F.col("confirmed"), F.lit(NOW_MS), STALE_MS)).select("concept_id", "confirmed")


def entity_concepts(spark, sf):
    """The concepts of each structural entity."""
    return graph.concepts_of(memberships(spark, sf).where("kind <> 'noun'")).select("kind", "key", "concept_id")


def lifecycle_hops(spark, sf):
    """Each concept's derivations one hop either way, in order of time and id: orders derive from their customers."""
    (o,) = read(spark, sf, "orders")
    e = o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("o"), F.col("o_orderkey")).alias("src"), F.concat(F.lit("c"), F.col("o_custkey")).alias("dst"), F.when(F.col("o_orderpriority") < "3", "derived-from").otherwise("supersedes").alias("family"), F.col("o_orderdate").alias("created_at"))
    return graph.one_hop(e, "derived-from").select("node", "direction", "peer", "place")


def circle_fold(spark, sf):
    """Circles under their final names, each archived or not: concepts that aren't workstreams, distinct entities and the last activity; one circle left out."""
    m = memberships(spark, sf).where("kind = 'lib'").select("concept_id", "key")
    last = observations(spark, sf).groupBy("concept_id").agg(F.max("created_at").alias("last"))
    alias = spark.createDataFrame([("machinery", "building"), ("household", "building")], "from_name string, to_name string")
    archived = spark.createDataFrame([("furniture",)], "circle string")
    return lifecycle.circles(concepts(spark, sf), m, last, alias, archived, exclude="automobile")


def detached(spark, sf):
    """Every fifth observation moved to the next concept: what its source keeps, and the moves refused."""
    o = observations(spark, sf)
    moved, refused = lifecycle.detach(o, o.where("observation_id % 5 = 0").select("observation_id", (F.col("concept_id") + 1).alias("to_concept")))
    e = lifecycle.evidence(moved).join(lifecycle.synthesis(moved).select("concept_id", "title"), "concept_id")
    r = o.join(refused.select("observation_id"), "observation_id", "left_semi").groupBy("concept_id").agg(F.count("*").alias("refused"))
    return e.join(r, "concept_id", "left").select("concept_id", "support_count", "last_confirmed_at", "title", F.coalesce("refused", F.lit(0)).alias("refused"))


def merged_concepts(spark, sf):
    """Concepts of odd id merged into the one before: sums, maxima and united aliases."""
    c = concepts(spark, sf).join(observations(spark, sf).groupBy("concept_id").agg(F.count("*").alias("support_count"), F.max("created_at").alias("last_confirmed_at")), "concept_id", "left")
    t = c.select("concept_id", "support_count", F.col("confidence").alias("usefulness_score"), F.col("confidence").alias("arousal_score"), "last_confirmed_at", F.array("circle").alias("aliases"))
    into = c.where("concept_id % 2 = 1 and concept_id > 1").select(F.col("concept_id").alias("src"), (F.col("concept_id") - 1).alias("dst"))
    return lifecycle.merge(t, into).select("concept_id", "support_count", F.round("usefulness_score", 9).alias("usefulness_score"), F.round("arousal_score", 9).alias("arousal_score"), "last_confirmed_at", F.array_join("aliases", "|").alias("aliases"))


def circle_changes(spark, sf):
    """A circle renamed, another archived and one brought back; what shows store-wide after that."""
    c = lifecycle.renamed(concepts(spark, sf), "building", "works")
    archived = lifecycle.restored(spark.createDataFrame([("furniture",), ("household",)], "circle string"), "household")
    moved = lifecycle.reassigned(c, c.where("concept_id % 10 = 0").select("concept_id", F.lit("machinery").alias("to_circle")))
    return lifecycle.visible(moved, archived).groupBy("circle").agg(F.count("*").alias("n"))


def segment_budgets(spark, sf):
    (s,) = read(spark, sf, "supplier")
    b = segment_budget(F.when(F.col("s_nationkey") % 3 > 0, F.col("s_nationkey") * 50), F.when(F.col("s_nationkey") % 2 > 0, F.lit(512)))
    return s.select("s_suppkey", b.cast("long").alias("budget"))


_BASE = f"{CONCEPTS_SQL}, {OBSERVATIONS_SQL}"
_CONTRA = f"""{_BASE}, pri as (select c.concept_id, c.observation_id, c.created_at as opened_at, count(p.observation_id) as priors, arg_max(p.observation_id, (p.created_at, p.observation_id)) as lastp
  from obs c join obs p on p.concept_id = c.concept_id and p.created_at < c.created_at and p.kind = 'statement' and not p.superseded where c.kind = 'correction' group by 1, 2, 3
), contra as (select concept_id, observation_id, opened_at, priors, case when priors = 1 then lastp end as contradicted from pri)"""
_PAIRS = """nx as (select c_custkey as a, lead(c_custkey) over (partition by c_nationkey order by c_custkey) as b, round((c_acctbal + 1000) / 11000, 6) as weight from customer
), dup as (select a, b, weight from nx where b is not null and a % 7 <> 0)"""
_BODY = "body as (select concept_id, string_agg(content, chr(10) order by made, oid) as body, substr(arg_min(content, (made, oid)), 1, 80) as title from (select concept_id, content, min(created_at) as made, arg_min(observation_id, (created_at, observation_id)) as oid from {src} group by 1, 2) group by 1)"
_LAST = "last as (select concept_id, max(created_at) as confirmed, count(*) as support from obs where not superseded group by 1)"
_DAY14 = 14.0 * 86_400_000

QUERIES = {
    f.__name__: f
    for f in (
        search_composed, fork_overrides, resolved_by_profile, directed_ingest, first_receipts, contradiction_queue, contradictions_resolved, disputes, duplicate_queue, dirty_worklist, overview, overview_envelopes, stale_concepts, entity_concepts, lifecycle_hops, circle_fold, detached,
        merged_concepts, circle_changes, segment_budgets,
    )
}
ORACLE = {
    "search_composed": f"""with v as (select vec_id as o, label as c, list_transform(embedding, lambda x: x::double) as x, 'c' || (label % 4) as circle, vec_id % 11 = 0 as old from embeddings
), kept as (select * from v where circle <> 'c3' and not old
), parts as (select o, c, x from kept union all select o, c, list_reverse(x) from kept where o % 3 = 0
), s as (select q.o as query_id, p.c, p.o, list_dot_product(q.x, p.x) as score from v q, parts p where q.o % 50 = 0
), best as (select query_id, c, o, score from (select *, row_number() over (partition by query_id, c order by score desc, o) as r from s where score > 0) where r = 1
), ix as (select c, o, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9][a-z0-9_-]{{2,}}'))) as token from kept left join documents on doc_id = o
), pr as (select item_id * 50 as query_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9][a-z0-9_-]{{2,}}'))) as token from benchmark
), df as (select token, count(distinct c) as df from ix where token in (select token from pr) group by 1
), idf as (select pr.query_id, pr.token, greatest(0, ln((select count(distinct c) from v where circle <> 'c3')::double / (1 + coalesce(df.df, 0)))) as idf from pr left join df using (token)
), tot as (select query_id, sum(idf) as total from idf group by 1
), hit as (select query_id, c, o, sum(idf) as h from ix join idf using (token) group by 1, 2, 3
), ov as (select query_id, c, case when any_value(total) > 0 then max(h) / any_value(total) else 0 end as overlap from hit join tot using (query_id) group by 1, 2
), k as (select b.*, score * (1 + coalesce(overlap, 0)) as rank from best b left join ov using (query_id, c) where score >= 0.12
), p as (select *, row_number() over (partition by query_id order by round(rank, 9) desc, c % 4 <> 1, c) as place from k)
select query_id, c as concept_id, o as observation_id, round(score, 6) as score, round(rank, 6) as rank, place::int as place from p where place <= 5""",
    "fork_overrides": f"""with {search._RES}, w as (select r.query_id, n.concept_id as c from r left join nom n using (query_id))
select query_id, case when (query_id % 100 = 0) <> (c % 2 = 0) or (query_id % 100 = 0 and query_id % 3 <> c % 3) then 'created' else 'attached' end as action,
  case when (query_id % 100 = 0) <> (c % 2 = 0) then 'species-fork' when query_id % 100 = 0 and query_id % 3 <> c % 3 then 'stage-fork' else 'attach' end as mode from w""",
    "resolved_by_profile": f"""with {search._RES.replace("0.55", "0.55::double").replace("0.25", "0.40::double")}, w as (select r.query_id, r.action, r.mode, n.concept_id as c from r left join nom n using (query_id)), x as (
  select *, action = 'attached' and (query_id % 100 = 0) <> (c % 2 = 0) as other, action = 'attached' and query_id % 100 = 0 and query_id % 3 <> c % 3 as away from w)
select query_id, mode as band, case when other or away then 'created' else action end as action, case when other then 'species-fork' when away then 'stage-fork' else mode end as mode from x""",
    "directed_ingest": f"""with {search._RES} select query_id, case when query_id % 600 = 0 then 'refused' when query_id % 200 = 0 then 'attached' when query_id % 300 = 0 then 'created' else action end as action,
  case when query_id % 600 = 0 then 'exclusive' when query_id % 200 = 0 then 'attach-to' when query_id % 300 = 0 then 'force-new' else mode end as mode from r""",
    "first_receipts": "select user_id || '-' || event_type as operation_id, min(event_id) as id from events group by 1",
    "contradiction_queue": f"""with {_CONTRA}, k as (select circle, c.*, row_number() over (partition by circle order by opened_at, observation_id) as place, count(*) over (partition by circle) as n from contra c join con using (concept_id))
select circle, concept_id, observation_id, priors, contradicted, place::int as place, greatest(n - 5, 0) as omitted from k where place <= 5""",
    "contradictions_resolved": f"""with {_CONTRA}, t as (select *, case observation_id % 3 when 0 then 'accept-new' when 1 then 'keep-current' else 'dismiss' end as action from contra
), u as (select *, action = 'accept-new' and priors > 1 and observation_id % 5 <> 0 as refused from t)
select concept_id, observation_id, action, case when refused then 'refused' when action = 'dismiss' then 'dismissed' else 'resolved' end as status,
  case when refused then null when action = 'accept-new' then contradicted when action = 'keep-current' then observation_id end as superseded, case when refused or action = 'dismiss' then 0 else 1 end as arousal_gain from u""",
    "disputes": f"with {_CONTRA}, n as (select concept_id, count(*) as open from contra group by 1) select concept_id, 'disputed' as status, round(confidence * 0.8::double ** open, 9) as confidence, open * 3 as arousal_gain, open from con join n using (concept_id)",
    "duplicate_queue": f"""with {CONCEPTS_SQL}, {_PAIRS}, k as (select circle, a, b, weight, row_number() over (partition by circle order by weight desc, a, b) as place, count(*) over (partition by circle) as n from dup join con on a = concept_id)
select circle, a, b, weight, place::int as place, greatest(n - 10, 0) as omitted from k where place <= 10""",
    "dirty_worklist": f"""with {_BASE}, live as (select * from obs where not superseded), {_BODY.format(src='live')}, nw as (select concept_id, max(created_at) as newest from live group by 1), dn as (select concept_id, max(created_at) as done from obs where observation_id % 3 = 0 group by 1)
select concept_id, circle, newest, md5(body) as body_md5, body.title from con left join nw using (concept_id) left join dn using (concept_id) left join body using (concept_id) where status <> 'retired' and (dirty or newest > coalesce(done, -1))""",
    "overview": f"""with {_CONTRA}, {_PAIRS}, {_LAST}, seen as (select * from con where status <> 'retired' and kind <> 'workstream'), t as (select * from seen left join last using (concept_id)), rowsq as (
  select 'living' as section, circle, concept_id, round(ln(confidence * exp(-({NOW_MS} - confirmed) / {_DAY14}::double)), 6) as value, null::bigint as x, null::bigint as y from t where {NOW_MS} - confirmed <= {STALE_MS}
  union all select 'duplicates', circle, concept_id, weight, a, b from dup join seen on a = concept_id
  union all select 'contradictions', circle, concept_id, opened_at::double, opened_at, observation_id from contra join seen using (concept_id)
  union all select 'dirty', circle, concept_id, support::double, concept_id, null from t where dirty
  union all select 'stale', circle, concept_id, confirmed::double, confirmed, concept_id from t where {NOW_MS} - confirmed > {STALE_MS}
), k as (select *, row_number() over (partition by section, circle order by case when section in ('living', 'duplicates') then value end desc nulls last, x, y, concept_id) as place, count(*) over (partition by section, circle) as n, case section when 'duplicates' then 10 else 5 end as cap from rowsq)
select section, circle, concept_id, value, place::int as place, greatest(n - cap, 0) as omitted from k where place <= cap""",
    "overview_envelopes": """with ov as ({overview}), sk as (select circle, concept_id, row_number() over (partition by circle order by concept_id) as place from ({concepts}) where status <> 'retired' and kind <> 'workstream'
), tx as (select circle, section, section || '/' || concept_id || '/' || place || '/' || omitted as text from ov union all select circle, 'skeleton', repeat(circle || '-' || concept_id, place * 4) from sk where place <= 5
), rg as (select circle, section, length(text) as n, case section when 'dirty' then 1 when 'stale' then 1 when 'duplicates' then 2 when 'living' then 3 when 'contradictions' then 4 else 0 end as rung from tx
), bb as (select unnest([900, 500, 120]) as budget), kk as (select unnest(range(0, 6)) as k
), lf as (select circle, budget, k, sum(n) filter (rung = 0 or rung > k) as rest, count(*) filter (rung between 1 and k) as dropped, sum(n) as chars, coalesce(sum(n) filter (section = 'skeleton'), 0) as skel, max(n) filter (section = 'skeleton') as longest from rg, bb, kk group by 1, 2, 3
), fi as (select circle, budget, coalesce(min(k) filter (rest <= budget), 5) as rungs from lf group by 1, 2
), ch as (select lf.* from lf join fi on fi.circle = lf.circle and fi.budget = lf.budget and lf.k = fi.rungs
), hv as (select ch.circle, ch.budget, i, floor(longest / pow(2, i))::int as most, (select sum(case when n <= floor(longest / pow(2, i)) then n else greatest(floor(longest / pow(2, i)), 1) end) from rg where rg.circle = ch.circle and section = 'skeleton') as clip from ch, (select unnest(range(1, 41)) as i) where rest > ch.budget and skel > 0
), mo as (select ch.circle, ch.budget, arg_min(hv.most, hv.i) filter (ch.rest - ch.skel + clip <= ch.budget) as most from ch join hv on hv.circle = ch.circle and hv.budget = ch.budget group by 1, 2)
select ch.budget, ch.circle, ch.chars::bigint as chars, k::int as rungs, case when rest > ch.budget and skel > 0 then coalesce(most, -1) end as most, dropped, rest <= ch.budget or coalesce(most is not null or (skel > 0 and rest - skel <= ch.budget), false) as fits from ch left join mo on mo.circle = ch.circle and mo.budget = ch.budget""",
    "stale_concepts": f"with {_BASE}, {_LAST} select concept_id, confirmed from con join last using (concept_id) where {NOW_MS} - confirmed > {STALE_MS}",
    "entity_concepts": "select 'id' as kind, p_brand || '-' || p_size as key, p_partkey as concept_id from part union all select 'lib', p_brand, p_partkey from part",
    "lifecycle_hops": """with e as (select o_orderkey as id, 'o' || o_orderkey as src, 'c' || o_custkey as dst, o_orderdate as made from orders where o_orderpriority < '3'), b as (select src as node, 'out' as direction, dst as peer, made, id from e union all select dst, 'in', src, made, id from e)
select node, direction, peer, row_number() over (partition by node, direction order by made, id)::int as place from b""",
    "circle_fold": f"""with {_BASE}, f as (select *, case when circle in ('machinery', 'household') then 'building' else circle end as name from con), l as (select concept_id, max(created_at) as last from obs group by 1)
select name as circle, count(distinct case when kind <> 'workstream' then concept_id end) as concepts, count(distinct p_brand) as entities, max(last) as last_activity, name = 'furniture' as archived from f left join l using (concept_id) left join part on p_partkey = concept_id where name <> 'automobile' group by 1""",
    "detached": f"""with {_BASE}, st as (select concept_id, count(*) filter (observation_id % 5 <> 0) as stay from obs group by 1), m as (
  select o.* exclude (concept_id), case when observation_id % 5 = 0 and stay > 0 then concept_id + 1 else concept_id end as concept_id, observation_id % 5 = 0 and stay = 0 as no, concept_id as was from obs o join st using (concept_id)
), {_BODY.format(src='m')}, rf as (select was as concept_id, count(*) as refused from m where no group by 1)
select concept_id, count(*) as support_count, max(created_at) as last_confirmed_at, any_value(title) as title, coalesce(any_value(refused), 0) as refused from m join body using (concept_id) left join rf using (concept_id) group by 1""",
    "merged_concepts": f"""with {_BASE}, s as (select concept_id, count(*) as n, max(created_at) as last from obs group by 1), t as (select case when concept_id % 2 = 1 and concept_id > 1 then concept_id - 1 else concept_id end as concept_id, n, confidence, last, circle from con left join s using (concept_id))
select concept_id, sum(n)::bigint as support_count, round(sum(confidence), 9) as usefulness_score, round(max(confidence), 9) as arousal_score, max(last) as last_confirmed_at, array_to_string(list_sort(list(distinct circle)), '|') as aliases from t group by 1""",
    "circle_changes": f"""with {CONCEPTS_SQL}, t as (select case when concept_id % 10 = 0 then 'machinery' when circle = 'building' then 'works' else circle end as circle from con where status <> 'retired' and kind <> 'workstream')
select circle, count(*) as n from t where circle <> 'furniture' group by 1""",
    "segment_budgets": "select s_suppkey, least(case when s_nationkey % 3 > 0 then s_nationkey * 50 end, case when s_nationkey % 2 > 0 then 512 end)::bigint as budget from supplier",
}
ORACLE["overview_envelopes"] = ORACLE["overview_envelopes"].replace("{overview}", ORACLE["overview"]).replace("{concepts}", f"with {CONCEPTS_SQL} select * from con")
