"""Grafts between replicas, and what is published of a store."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestore.functions import text as T
from lodestore.functions import vectors as V
from lodestore.functions.segments import segmented
from lodestore.operators import folds, graph, lifecycle, publishing, resolution, retrieval, sync
from lodestore.plans import search
from lodestore.sources import export
from lodestore.sources.tables import CONCEPTS_SQL, OBSERVATIONS_SQL, concepts, memberships, observations, read, vectors
from lodestore.staging import stage

DAY = 867_715_200_000


def dismissals(spark, sf):
    """Edges from customers to clerks' priorities as replicas hold them, an order each: a dismissal in any of them stays."""
    (o,) = read(spark, sf, "orders")
    gone = F.col("o_totalprice") > 300000
    t = o.select(F.col("o_custkey").alias("src"), F.col("o_orderpriority").alias("dst"), F.when(gone, F.col("o_orderkey")).alias("dismissed_at"), F.when(gone, F.col("o_orderstatus")).alias("dismissed_by"))
    return sync.dismissed(t, ["src", "dst"])


def dirty_marks(spark, sf):
    """Concepts after a graft of the observations since a day."""
    new = sync.delta(observations(spark, sf), DAY, "created_at")
    return sync.marked_dirty(concepts(spark, sf), new).groupBy("circle", "dirty").agg(F.count("*").alias("n"))


def payload_rejects(spark, sf):
    """Customers as payloads of another store: protocols, embedders and widths that don't fit."""
    (c,) = read(spark, sf, "customer")
    n = F.col("c_nationkey")
    widths = F.when(n % 6 == 0, F.array().cast("array<int>")).when(n % 6 == 1, F.array(F.lit(64), F.lit(128))).when(n % 6 == 2, F.array(F.lit(128))).otherwise(F.array(F.lit(64)))
    why = sync.rejected(F.when(n % 11 == 0, 3).otherwise(2), F.when(n % 7 == 0, "other").otherwise("own"), widths, F.when(n % 5 == 0, 1).otherwise(0), 2, "own", 64)
    return c.select(F.coalesce(why, F.lit("accepted")).alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))


def delta_payload(spark, sf):
    """A delta of two tables as rows of JSON."""
    o = observations(spark, sf).select("observation_id", "concept_id", F.col("created_at").alias("updated_at"))
    c = read(spark, sf, "customer")[0].select(F.col("c_custkey").alias("concept_id"), (F.lit(DAY) + F.col("c_nationkey") - 12).alias("updated_at"))
    return sync.payload({"observations": (o, "observation_id"), "concepts": (c, "concept_id")}, DAY, 2, "own")


def _supersessions(spark, sf):
    """Each part supersedes another, by a rule that makes circles."""
    (p,) = read(spark, sf, "part")
    n = p.agg(F.max("p_partkey").alias("n"))
    t = p.crossJoin(n).select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("src"), ((F.col("p_partkey") * 7 + F.col("p_size") * 13) % F.col("n") + 1).alias("dst"), F.col("p_size").cast("long").alias("created_at"))
    return t.where("src <> dst")


def supersession_circles(spark, sf):
    """The circles among supersessions: their least node and their length."""
    return graph.on_cycles(_supersessions(spark, sf)).groupBy("cycle").agg(F.count("*").alias("length"))


def supersession_paths(spark, sf):
    """The circles among supersessions, node by node from the least."""
    return graph.cycle_paths(_supersessions(spark, sf))


def _proposed(spark, sf):
    """Supersessions without circles, and new ones proposed: those that would close them, and others."""
    s = stage(_supersessions(spark, sf), "supersessions")
    kept = stage(sync.acyclic(s).select("src", "dst"), "kept")
    others = s.where("src % 3 = 0").select("src", (F.col("src") * 11 % 97 + 1).alias("dst"))
    return kept, s.select("src", "dst").join(kept.hint("merge"), ["src", "dst"], "left_anti").union(others)


def supersession_verdicts(spark, sf):
    """Whether a proposed supersession would close a circle, within the cap on a walk."""
    kept, new = _proposed(spark, sf)
    return graph.cycle_verdicts(kept, new)[0]


def proposed_circles(spark, sf):
    """The circles that proposed supersessions would close, node by node, however long."""
    kept, new = _proposed(spark, sf)
    return graph.cycle_verdicts(kept, new)[1]


def acyclic_graft(spark, sf):
    """Supersessions that a graft takes: all but the last of each circle."""
    return sync.acyclic(_supersessions(spark, sf)).select("id", "dst")


def migrated_edges(spark, sf):
    """Edges after re-embedding (vectors read backwards): related ones made anew, the others untouched."""
    v = vectors(spark, sf).withColumn("embedding", F.reverse("embedding"))
    labels = v.select("concept_id").distinct()
    old = labels.select(F.col("concept_id").alias("a"), (F.col("concept_id") + 1).alias("b"), F.lit(1.0).alias("weight"), F.when(F.col("concept_id") % 2 == 0, "related").otherwise("follows").alias("type"))
    return sync.migrated(old, search.related_of(search._centroids(v)).select("a", "b", "weight")).select("a", "b", F.round("weight", 6).alias("weight"), "type")


def grafted_duplicates(spark, sf):
    """Grafted vectors (the stated ones) beside the local concepts that they resemble: linked, never merged."""
    v = vectors(spark, sf)
    best = resolution.nominate(retrieval.best_observations(v.where("observation_id % 50 <> 0"), search._queries(v)))
    return best.where("score >= 0.25").select("query_id", "concept_id", F.round("score", 6).alias("weight"))


def kept_observations(spark, sf):
    """Observations of concepts in the set, without those of concepts in another."""
    (c,) = read(spark, sf, "customer")
    o = observations(spark, sf).join(c.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("concept_id")), "concept_id", "left_semi")
    return o.join(c.where("c_nationkey < 10").select(F.col("c_custkey").alias("concept_id")), "concept_id", "left_anti").select("observation_id", "concept_id")


def source_rows(spark, sf):
    """Names under the escaped prefix `source_`; the underscore is no wildcard."""
    (s,) = read(spark, sf, "supplier")
    t = s.select("s_suppkey", F.concat(F.when(F.col("s_suppkey") % 2 == 0, "source_").otherwise("sourceX"), F.col("s_suppkey")).alias("name"))
    return t.where(F.col("name").like("source\\_%"))


def bounded_texts(spark, sf):
    """Documents' first 100 characters, and whether there are more."""
    from lodestore.operators.gates import clipped

    return read(spark, sf, "documents")[0].select("doc_id", clipped(F.col("text"), 100).alias("c")).select("doc_id", F.md5("c.text").alias("head"), "c.truncated")


def parsed_vectors(spark, sf):
    """Vectors from JSON: sound ones of the width, and why the others are put aside."""
    (o,) = read(spark, sf, "orders")
    i = F.col("o_orderkey")
    text = (
        F.when(i % 7 == 0, "no list").when(i % 7 == 1, "[1, null, 2]").when(i % 7 == 2, "[0.5]").when(i % 7 == 3, '[1, 2, "x"]').when(i % 7 == 4, F.lit(None)).otherwise(F.concat(F.lit("["), F.col("o_custkey"), F.lit(", 2, 3]")))
    )
    t = o.select("o_orderkey", text.alias("json"))
    t = t.select("o_orderkey", V.parse(F.col("json"), 3).alias("v"), V.fault(F.col("json"), 3).alias("fault"))
    return t.select("o_orderkey", F.round(V.norm(F.col("v")), 6).alias("norm"), "fault")


def weighted_merges(spark, sf):
    """Centroids of neighbouring labels merged by their support."""
    v = vectors(spark, sf)
    c = search._centroids(v).join(v.groupBy("concept_id").agg(F.count("*").alias("n")), "concept_id")
    b = c.select((F.col("concept_id") - 1).alias("concept_id"), F.col("centroid").alias("cb"), F.col("n").alias("nb"))
    t = c.join(b, "concept_id").select("concept_id", F.posexplode(V.merged_centroid(F.col("centroid"), F.col("n"), F.col("cb"), F.col("nb"))).alias("i", "x"))
    return t.select("concept_id", "i", F.round("x", 6).alias("x"))


def running_centroids(spark, sf):
    """Each label's centroid as it grew, vector by vector in order of id."""
    v = folds.running_centroids(vectors(spark, sf), "concept_id", ["observation_id"], "embedding")
    return v.select("concept_id", F.posexplode("centroid").alias("i", "x")).select("concept_id", "i", F.round("x", 5).alias("x"))


def scrubbed_records(spark, sf):
    """Nested records scrubbed throughout: a struct with a text, a list and a map."""
    (c,) = read(spark, sf, "conversations")
    mail = F.concat(F.lit("mail a"), "turn", F.lit("@b.org "), "text")
    secret = F.concat(F.lit("see http://10.1.2."), "turn", F.lit(":80/x, tenant acme and /Users/me/work/keep/a.txt or ~/x"))
    r = c.select("conv_id", "turn", F.struct(mail.alias("t"), F.array(secret, mail).alias("list"), F.create_map(F.lit("k"), secret).alias("map"), F.col("turn").alias("n")).alias("r"))
    s = T.redact_nested(F.col("r"), r.schema["r"].dataType, own=("keep",))
    return r.select("conv_id", "turn", s.alias("s")).select("conv_id", "turn", F.md5("s.t").alias("t"), F.col("s.list")[0].alias("first"), F.md5(F.col("s.map")["k"]).alias("map"), F.col("s.n").alias("n"))


def _pages_of(spark, sf):
    """Parts as concepts with slugs, some of them with addresses in or like what an address becomes, and bodies that refer to each other."""
    (p,) = read(spark, sf, "part")
    z = F.col("p_size")
    i = F.col("p_partkey")
    slug = F.when(i % 11 == 3, F.concat(F.lit("redacted-email-"), i - 1)).when(z % 5 == 0, F.concat(F.lit("a"), z % 10, F.lit("@x.org"))).otherwise(F.regexp_replace("p_name", " ", "-"))
    body = F.concat(F.lit("Of "), "p_name", F.lit(" supersedes: #"), F.regexp_replace("p_name", " ", "-"), F.lit(" and ~/p"), i)
    return p.select(i.alias("concept_id"), F.floor(i / 500).alias("circle"), slug.alias("slug"), body.alias("body"))


def scrubbed_slugs(spark, sf):
    return publishing.renamed_slugs(_pages_of(spark, sf)).select("concept_id", "new")


def scrubbed_bodies(spark, sf):
    """Bodies scrubbed, their references under the slugs' new names."""
    c = _pages_of(spark, sf)
    names = publishing.renamed_slugs(c).withColumn("new", F.when(F.col("old") == "small-bolt", "tiny-bolt").otherwise(F.col("new")))
    return publishing.rewritten(c, names)


def kept_entities(spark, sf):
    """Entities that the scrubbed bodies still hold, with their new frequencies."""
    c = _pages_of(spark, sf)
    t = publishing.kept_entities(memberships(spark, sf), publishing.rewritten(c, publishing.renamed_slugs(c)))
    return t.select("concept_id", "kind", "key", "df")


def published_tables(spark, sf):
    """How many rows of each table a published store holds, and a digest of its ids."""
    c = _pages_of(spark, sf).where("concept_id % 9 <> 0")
    (p,) = read(spark, sf, "part")
    edges = p.select(F.col("p_partkey").alias("src"), (F.col("p_partkey") + F.col("p_size")).alias("dst"))
    out = publishing.published(c, c.select("concept_id", "body"), edges, memberships(spark, sf))
    ids = {"concepts": "concept_id", "revisions": "concept_id", "edges": "src * 3 + dst", "entities": "concept_id + df"}
    rows = [t.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.expr(ids[n])), F.lit(0)).alias("ids")).select(F.lit(n).alias("table"), "rows", "ids") for n, t in out.items()]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


def publishable_rows(spark, sf):
    """Rows fit to publish as JSON: live concepts' bodies, scrubbed."""
    c = _pages_of(spark, sf).where("concept_id % 9 <> 0")
    t = publishing.rewritten(c, publishing.renamed_slugs(c))
    return t.select("concept_id", F.to_json(F.struct("concept_id", "body")).alias("row"))


def purge_report(spark, sf):
    """Customers of one nation purged, with all that names them."""
    o, c = observations(spark, sf), concepts(spark, sf)
    doomed = read(spark, sf, "customer")[0].where("c_nationkey = 3").select(F.col("c_custkey").alias("concept_id"))
    e = read(spark, sf, "customer")[0].select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 1).alias("b"))
    return publishing.purged({"concepts": (c, ["concept_id"]), "observations": (o.select("observation_id", "concept_id"), ["concept_id"]), "edges": (e, ["a", "b"])}, doomed)[1]


def induced_edges(spark, sf):
    """Edges with both ends in the sample."""
    (c,) = read(spark, sf, "customer")
    e = c.select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + F.col("c_nationkey")).alias("b"))
    return lifecycle.induced(e, c.where("c_nationkey < 15").select(F.col("c_custkey").alias("node")))


def topic_pages(spark, sf):
    """Topics of ten customers each as markdown, with their index lines and chunks counted."""
    (c,) = read(spark, sf, "customer")
    t = export.topics(c.select(F.floor(F.col("c_custkey") / 10).alias("component"), F.col("c_name").alias("title"), F.concat_ws(" ", "c_mktsegment", "c_nationkey").alias("body")))
    n = export.chunks(t).groupBy("topic").agg(F.count("*").alias("chunks"))
    return t.join(n, "topic").select("topic", F.md5("markdown").alias("markdown"), "chunks")


def topic_index(spark, sf):
    (c,) = read(spark, sf, "customer")
    return export.index(export.topics(c.select(F.floor(F.col("c_custkey") / 10).alias("component"), F.col("c_name").alias("title"), F.concat_ws(" ", "c_mktsegment", "c_nationkey").alias("body"))))


def asserted_edges(spark, sf):
    """Edges that bodies assert, from the concept to the first one of the slug named."""
    c = _pages_of(spark, sf)
    first = c.groupBy(F.col("slug").alias("to")).agg(F.min("concept_id").alias("dst"))
    r = c.select(F.col("concept_id").alias("src"), F.explode(T.references(F.col("body"))).alias("r")).select("src", "r.relation", F.col("r.slug").alias("to"))
    return r.join(first, "to").select("src", "dst", "relation")


def session_states(spark, sf):
    """Conversations as workstreams: a turn is an item, opened by a user and closed by an assistant."""
    (c,) = read(spark, sf, "conversations")
    t = c.select(F.col("conv_id").alias("slug"), F.col("turn").alias("at"), (F.col("turn") % 3).cast("string").alias("item"), F.when(F.col("role") == "user", "open").otherwise("done").alias("state"))
    return lifecycle.workstreams(t).select("slug", F.array_join("open_items", ",").alias("open_items"), "updated_at", "may_close")


def segment_sizes(spark, sf):
    """Documents in segments of at most 280 tokens: how many, and a digest of them."""
    d = read(spark, sf, "documents")[0].select("doc_id", segmented(F.coalesce("text", F.lit("")), 280).alias("s"))
    return d.select("doc_id", F.size("s").alias("segments"), F.md5(F.array_join("s", "\n")).alias("digest"))


_REL = f"""{search._V.replace('list_transform(embedding, lambda x: x::double)', 'list_reverse(list_transform(embedding, lambda x: x::double))')}, {search._MEAN}, p as (select a.c as src, b.c as dst, round(list_dot_product(a.x, b.x), 6) as score from centroid a join centroid b on a.c <> b.c
), k as (select *, row_number() over (partition by src order by score desc, dst) as r from p where score >= -0.05 and score < 0.9)"""
_SUP = "e as (select * from (select p_partkey as id, p_partkey as src, (p_partkey * 7 + p_size * 13) % (select max(p_partkey) from part) + 1 as dst, p_size as made from part) where src <> dst), walk as (select src, dst as node from e union select w.src, e.dst from walk w join e on e.src = w.node), ring as (select src as node, (select min(w2.node) from walk w2 where w2.src = w.src) as cycle from walk w where w.src = w.node)"
_NEW = """lost as (select arg_max(id, (made, id)) as id from e join ring on src = ring.node group by cycle), k as (select src, dst from e where id not in (select id from lost)
), pr as (select src, dst from e where id in (select id from lost) union select src, src * 11 % 97 + 1 from e where src % 3 = 0
), wk as (select src, dst, dst as node, 0::bigint as up from pr union all select w.src, w.dst, k.dst, w.up + 1 from wk w join k on k.src = w.node where w.up < 1000
), m as (select src, dst, min(up) as up from wk where node = src and up < 1000 group by 1, 2)"""
_PG = """pg as (select p_partkey as concept_id, p_partkey // 500 as circle, p_name, case when p_partkey % 11 = 3 then 'redacted-email-' || (p_partkey - 1) when p_size % 5 = 0 then 'a' || (p_size % 10) || '@x.org' else replace(p_name, ' ', '-') end as slug from part{where}
), nm as (select *, case when slug like 'a%@x.org' then 'redacted-email' else slug end as base from pg
), kk as (select *, row_number() over (partition by circle, base order by concept_id) = 1 as plain, rtrim(left(base, 51), '-') || '-' || left(concept_id::varchar, 8) as longer from nm
), gv as (select circle, longer as base, min(concept_id) as before from kk where not plain group by 1, 2
), sl as (select concept_id, slug, case when plain and not coalesce(before < concept_id, false) then base else longer end as new from kk left join gv using (circle, base))"""
_ALL = _PG.format(where="")
_KEPT = _PG.format(where=" where p_partkey % 9 <> 0")
_SPACED = "' ' || trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+', ' ', 'g')) || ' '"
_MEMBERS = "m as (select p_partkey as concept_id, 'id' as kind, p_brand || '-' || p_size as key from part union all select p_partkey, 'lib', p_brand from part union all select p_partkey, 'noun', unnest(string_split(p_name, ' ')) from part)"
_BODY_TEXT = "'Of ' || p_name || ' supersedes: #' || {to} || ' and [redacted-path]'"

QUERIES = {
    f.__name__: f
    for f in (
        dismissals, dirty_marks, payload_rejects, delta_payload, supersession_circles, supersession_paths, supersession_verdicts, proposed_circles, acyclic_graft, migrated_edges, grafted_duplicates, kept_observations, source_rows, bounded_texts, parsed_vectors, weighted_merges, running_centroids, scrubbed_records,
        scrubbed_slugs, scrubbed_bodies, kept_entities, published_tables, publishable_rows, purge_report, induced_edges, topic_pages, topic_index, asserted_edges, session_states, segment_sizes,
    )
}
ORACLE = {
    "dismissals": "select o_custkey as src, o_orderpriority as dst, min(case when o_totalprice > 300000 then o_orderkey end) as dismissed_at, arg_min(o_orderstatus, o_orderkey) filter (o_totalprice > 300000) as dismissed_by from orders group by 1, 2",
    "dirty_marks": f"with {CONCEPTS_SQL}, {OBSERVATIONS_SQL} select circle, dirty or concept_id in (select concept_id from obs where created_at >= {DAY}) as dirty, count(*) as n from con group by 1, 2",
    "payload_rejects": """select case when c_nationkey % 11 = 0 then 'protocol' when c_nationkey % 7 = 0 then 'embedder' when c_nationkey % 5 = 0 then 'malformed' when c_nationkey % 6 = 1 then 'mixed-width' when c_nationkey % 6 = 2 then 'width' else 'accepted' end as verdict,
  count(*) as n from customer group by 1""",
    "delta_payload": f"""with {OBSERVATIONS_SQL}, t as (select 'observations' as "table", observation_id as id, '{{"observation_id":' || observation_id || ',"concept_id":' || concept_id || ',"updated_at":' || created_at || '}}' as row from obs where created_at >= {DAY}
  union all select 'concepts', c_custkey, '{{"concept_id":' || c_custkey || ',"updated_at":' || ({DAY} + c_nationkey - 12) || '}}' from customer where c_nationkey >= 12) select 2 as protocol, 'own' as embedder, {DAY}::bigint as since, "table", id::varchar as id, row from t""",
    "supersession_circles": f"with recursive {_SUP} select cycle, count(*) as length from ring group by 1",
    "supersession_paths": f"with recursive {_SUP}, along as (select cycle, cycle as node, 0::bigint as place from (select distinct cycle from ring) union all select a.cycle, e.dst, a.place + 1 from along a join e on e.src = a.node where e.dst <> a.cycle) select cycle, place, node from along",
    "supersession_verdicts": f"with recursive {_SUP}, {_NEW} select p.src, p.dst, case when m.up is not null then 'cycle' when w.last >= 1000 then 'cap' else 'safe' end as verdict, m.up + 1 as hops from pr p left join m using (src, dst) left join (select src, dst, max(up) as last from wk group by 1, 2) w using (src, dst)",
    "proposed_circles": f"with recursive {_SUP}, {_NEW.replace(' where w.up < 1000', '').replace(' and up < 1000', '')} select wk.src, wk.dst, wk.up + 1 as place, wk.node from wk join m using (src, dst) where wk.up <= m.up union all select src, dst, 0, src from m",
    "acyclic_graft": f"with recursive {_SUP}, lost as (select arg_max(id, (made, id)) as id from e join ring on src = ring.node group by cycle) select id, dst from e where id not in (select id from lost)",
    "migrated_edges": f"with {_REL} select least(src, dst) as a, greatest(src, dst) as b, max(score) as weight, 'related' as type from k where r <= 3 group by 1, 2 union all select distinct c, c + 1, 1.0::double, 'follows' from v where c % 2 = 1",
    "grafted_duplicates": f"""with {search._V}, s as (select q.o as query_id, v.c as concept_id, list_dot_product(q.x, v.x) as score from v q, v where q.o % 50 = 0 and v.o % 50 <> 0), b as (select query_id, concept_id, max(score) as score from s where score > 0 group by 1, 2
), k as (select *, row_number() over (partition by query_id order by score desc, concept_id) as r from b) select query_id, concept_id, round(score, 6) as weight from k where r = 1 and score >= 0.25""",
    "kept_observations": "select o_orderkey as observation_id, o_custkey as concept_id from orders join customer on c_custkey = o_custkey where c_mktsegment = 'BUILDING' and o_custkey not in (select c_custkey from customer where c_nationkey < 10)",
    "source_rows": "select s_suppkey, 'source_' || s_suppkey as name from supplier where s_suppkey % 2 = 0",
    "bounded_texts": "select doc_id, md5(left(text, 100)) as head, length(text) > 100 as truncated from documents",
    "parsed_vectors": "select o_orderkey, case when o_orderkey % 7 > 4 then round(sqrt(o_custkey * o_custkey + 13.0::double), 6) end as norm, case o_orderkey % 7 when 0 then 'container' when 1 then 'value' when 2 then 'width' when 3 then 'container' when 4 then 'missing' end as fault from orders",
    "weighted_merges": f"""with {search._V}, {search._MEAN}, n as (select c, count(*) as n from v group by 1), m as (select a.c, list_transform(list_zip(a.x, b.x), lambda z: z[1] * na.n + z[2] * nb.n) as r from centroid a join centroid b on b.c = a.c + 1 join n na on na.c = a.c join n nb on nb.c = b.c)
select c as concept_id, (generate_subscripts(r, 1) - 1)::int as i, round(unnest(list_transform(r, lambda e: e / sqrt(list_dot_product(r, r)))), 6) as x from m""",
    "running_centroids": f"""with recursive {search._V}, o as (select c, x, row_number() over (partition by c order by o) as k from v), g as (
  select c, k, list_transform(x, lambda e: e / sqrt(list_dot_product(x, x))) as m from o where k = 1
  union all select g.c, o.k, list_transform(r, lambda e: e / sqrt(list_dot_product(r, r))) from (select g.c, g.k, list_transform(list_zip(g.m, o.x), lambda z: (z[1] * g.k + z[2]) / (g.k + 1)) as r from g join o on o.c = g.c and o.k = g.k + 1) g join o on o.c = g.c and o.k = g.k + 1
), l as (select c, arg_max(m, k) as m from g group by 1) select c as concept_id, (generate_subscripts(m, 1) - 1)::int as i, round(unnest(m), 5) as x from l""",
    "scrubbed_records": """with r as (select conv_id, turn, 'see [redacted-private-endpoint], tenant [redacted-tenant] and keep/a.txt or [redacted-path]' as s, text from conversations)
select conv_id, turn, md5('mail [redacted-email] ' || text) as t, s as first, md5(s) as map, turn as n from r""",
    "scrubbed_slugs": f"with {_ALL} select concept_id, new from sl",
    "scrubbed_bodies": f"""with {_ALL}, f as (select slug as old, case when slug = 'small-bolt' then 'tiny-bolt' else arg_min(new, concept_id) end as new from sl group by 1)
select concept_id, {_BODY_TEXT.format(to="coalesce(f.new, replace(p_name, ' ', '-'))")} as body from pg left join f on f.old = replace(p_name, ' ', '-')""",
    "kept_entities": f"""with {_ALL}, {_MEMBERS}, b as (select concept_id, {_SPACED.format(_BODY_TEXT.format(to="coalesce(f.new, replace(p_name, ' ', '-'))"))} as body from pg left join (select slug as old, arg_min(new, concept_id) as new from sl group by 1) f on f.old = replace(p_name, ' ', '-')
), k as (select m.* from m join b using (concept_id) where contains(body, {_SPACED.format("key")})) select concept_id, kind, key, count(*) over (partition by kind, key) as df from k""",
    "published_tables": f"""with {_KEPT}, {_MEMBERS}, b as (select concept_id, {_SPACED.format(_BODY_TEXT.format(to="coalesce(f.new, replace(p_name, ' ', '-'))"))} as body from pg left join (select slug as old, arg_min(new, concept_id) as new from sl group by 1) f on f.old = replace(p_name, ' ', '-')
), k as (select m.concept_id, count(*) over (partition by kind, key) as df from m join b using (concept_id) where contains(body, {_SPACED.format("key")})), e as (select p_partkey as src, p_partkey + p_size as dst from part where p_partkey % 9 <> 0 and (p_partkey + p_size) % 9 <> 0 and p_partkey + p_size <= (select max(p_partkey) from part))
select 'concepts' as "table", count(*) as rows, sum(concept_id)::bigint as ids from pg union all select 'revisions', 0, 0 union all select 'edges', count(*), sum(src * 3 + dst)::bigint from e union all select 'entities', count(*), sum(concept_id + df)::bigint from k""",
    "publishable_rows": f"""with {_KEPT}, f as (select slug as old, arg_min(new, concept_id) as new from sl group by 1) select concept_id, '{{"concept_id":' || concept_id || ',"body":"' || {_BODY_TEXT.format(to="coalesce(f.new, replace(p_name, ' ', '-'))")} || '"}}' as row from pg left join f on f.old = replace(p_name, ' ', '-')""",
    "purge_report": """with d as (select c_custkey as k from customer where c_nationkey = 3), t as (select 'concepts' as "table", c_custkey in (select k from d) as gone from customer union all select 'observations', o_custkey in (select k from d) from orders
  union all select 'edges', c_custkey in (select k from d) or c_custkey + 1 in (select k from d) from customer) select "table", count(*) filter (gone) as purged, count(*) filter (not gone) as kept from t group by 1""",
    "induced_edges": "with n as (select c_custkey as k from customer where c_nationkey < 15) select c_custkey as a, c_custkey + c_nationkey as b from customer where c_custkey in (select k from n) and c_custkey + c_nationkey in (select k from n)",
    "topic_pages": """with t as (select floor(c_custkey / 10)::bigint as g, string_agg('# ' || c_name || chr(10) || chr(10) || c_mktsegment || ' ' || c_nationkey || chr(10), chr(10) order by c_name) as m, min(c_name) as f, count(*) as n from customer group by 1)
select lower(replace(f, '#', '-')) || '-' || g as topic, md5(m) as markdown, n as chunks from t""",
    "topic_index": r"""with t as (select floor(c_custkey / 10)::bigint as g, string_agg('# ' || c_name || chr(10) || chr(10) || c_mktsegment || ' ' || c_nationkey || chr(10), chr(10) order by c_name) as m, min(c_name) as f from customer group by 1
), b as (select lower(replace(f, '#', '-')) || '-' || g as topic, trim(regexp_replace(regexp_replace(m, '^# [^\n]*\n\n', ''), '\s+', ' ', 'g')) as s from t)
select '- [' || topic || '](' || topic || '.md): ' || case when length(s) <= 160 then s else rtrim(substr(s, 1, 159)) || '…' end as line from b""",
    "asserted_edges": f"with {_ALL}, f as (select slug, min(concept_id) as dst from pg group by 1) select concept_id as src, dst, 'supersedes' as relation from pg join f on f.slug = replace(p_name, ' ', '-')",
    "session_states": """with l as (select conv_id, turn % 3 as item, arg_max(role, turn) = 'user' as open, max(turn) as t from conversations group by 1, 2)
select conv_id as slug, coalesce(string_agg(item::varchar, ',' order by item) filter (open), '') as open_items, max(t) as updated_at, count(*) filter (open) = 0 as may_close from l group by 1""",
}
