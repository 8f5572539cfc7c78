"""Retrieval, resolution and evaluation queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestore.functions.text import lexical_tokens
from lodestore.functions.vectors import is_zero, normalised
from lodestore.operators import evaluation, graph, postings, resolution, retrieval
from lodestore.sources.tables import read, texts, vectors
from lodestore.staging import stage

TAUS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]


def _queries(v):
    """The stated query set: every vector whose id is divisible by 50."""
    return v.where("observation_id % 50 = 0").select(F.col("observation_id").alias("query_id"), "embedding", F.col("concept_id").alias("home"))


def search_topk(spark, sf):
    """The five best concepts of every stated query."""
    v = vectors(spark, sf)
    best = retrieval.best_observations(v, _queries(v))
    return retrieval.top_k(best, 5).select("query_id", "concept_id", "observation_id", F.round("score", 6).alias("score"), "place")


def search_topk_stated(spark, sf):
    return search_topk(spark, sf)


def _replayed(spark, sf):
    v = vectors(spark, sf)
    q = _queries(v)
    return v, q, retrieval.best_observations(v, q, exclude_self=True)


def nominate_loo(spark, sf):
    _, q, best = _replayed(spark, sf)
    n = resolution.nominate(best).join(q.select("query_id", "home"), "query_id")
    return n.select("query_id", "concept_id", "observation_id", F.round("score", 6).alias("score"), (F.col("concept_id") == F.col("home")).alias("correct"))


def search_recall_loo(spark, sf):
    """Recall at 1, 3, 5 and 10 and mean reciprocal rank of the home concept, each vector searched without itself."""
    _, q, best = _replayed(spark, sf)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "concept_id")
    ranked = best.withColumn("r", F.row_number().over(w)).join(q.select("query_id", "home"), "query_id")
    own = ranked.groupBy("query_id").agg(F.min(F.when(F.col("concept_id") == F.col("home"), F.col("r"))).alias("r"))
    cols = [F.round(F.avg(F.coalesce(F.col("r") <= k, F.lit(False)).cast("double")), 6).alias(f"recall_at_{k}") for k in (1, 3, 5, 10)]
    return own.agg(F.count("*").alias("queries"), *cols, F.round(F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))), 6).alias("mrr"))


def tau_sweep(spark, sf):
    _, q, best = _replayed(spark, sf)
    n = resolution.nominate(best).join(q.select("query_id", "home"), "query_id")
    return evaluation.sweep(n, "score", F.col("concept_id") == F.col("home"), TAUS)


def _centroids(v):
    mean = v.select("concept_id", F.posexplode("embedding").alias("i", "x")).groupBy("concept_id", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return mean.groupBy("concept_id").agg(normalised(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"])).alias("centroid"))


def concept_centroids(spark, sf):
    return _centroids(vectors(spark, sf)).select("concept_id", F.posexplode("centroid").alias("i", "x")).select("concept_id", "i", F.round("x", 6).alias("x"))


def _resolved(spark, sf, attach=0.55, ambiguous=0.25):
    v, q, best = _replayed(spark, sf)
    c = _centroids(v)
    n = resolution.nominate(best)
    scores = retrieval.best_observations(c.select(F.col("concept_id").cast("long").alias("observation_id"), "concept_id", F.col("centroid").alias("embedding")), q, positive=False)
    own = scores.groupBy("query_id").agg(F.max("score").alias("top_centroid"))
    n = n.join(scores.select("query_id", "concept_id", F.col("score").alias("centroid_score")), ["query_id", "concept_id"], "left")
    t = q.select("query_id").join(n, "query_id", "left").join(own, "query_id")
    d = resolution.decide(F.round("score", 9), F.round("centroid_score", 9), F.round("top_centroid", 9), attach, ambiguous)
    return t.select("query_id", d.alias("d")).select("query_id", "d.action", "d.mode", F.round("d.weight", 6).alias("weight"))


def resolution_bands(spark, sf):
    return _resolved(spark, sf)


def resolution_stats(spark, sf):
    return _resolved(spark, sf).groupBy("mode").agg(F.count("*").alias("n"), F.count_if(F.col("action") == "ambiguous").alias("n_ambiguous"))


def nomination_auc(spark, sf):
    _, q, best = _replayed(spark, sf)
    t = best.join(q.select("query_id", "home"), "query_id").withColumn("s", F.round("score", 9))
    return evaluation.auc(t, "s", F.col("concept_id") == F.col("home")).select(F.round("auc", 6).alias("auc"), "n_pos", "n_neg")


def score_quantiles(spark, sf):
    _, q, best = _replayed(spark, sf)
    t = best.join(q.select("query_id", "home"), "query_id").select((F.col("concept_id") == F.col("home")).alias("same"), F.round("score", 6).alias("s"))
    return evaluation.index_quantiles(t, "s", [0.05, 0.5, 0.95, 0.99], ["same"])


def related_of(c, least=-0.05, below=0.9, k=3):
    """Related edges of concepts (concept_id, centroid): the k nearest of each in a band, picked by either."""
    asked = c.select(F.col("concept_id").cast("long").alias("query_id"), F.col("centroid").alias("embedding"))
    found = retrieval.best_observations(c.select(F.col("concept_id").cast("long").alias("observation_id"), "concept_id", F.col("centroid").alias("embedding")), asked, exclude_self=True, positive=False)
    pairs = found.select(F.col("query_id").cast(c.schema["concept_id"].dataType).alias("src"), F.col("concept_id").alias("dst"), F.round("score", 6).alias("score"))
    return graph.nearest_union(pairs, least, below, k)


def related_edges(spark, sf):
    return related_of(_centroids(vectors(spark, sf)))


def related_by_profile(spark, sf):
    """Related edges by every profile's own band, six nearest, of the vectors themselves as concepts."""
    bands = {name: (edge, attach) for name, (attach, _, edge) in resolution.PROFILES.items()}
    found = retrieval.nearest_in_bands(vectors(spark, sf), bands, 6)
    made = [graph.nearest_union(found.where(F.col("band") == name), *band, 6).select(F.lit(name).alias("profile"), "*") for name, band in bands.items()]
    return reduce(lambda a, b: a.union(b), made)


def _probes(spark, sf):
    (b,) = read(spark, sf, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.explode(lexical_tokens(F.coalesce("text", F.lit("")))).alias("token"))


def lexical_rank(spark, sf):
    """The five sources whose best document holds most of each benchmark text's tokens, by idf."""
    t, probes = texts(spark, sf), _probes(spark, sf)
    index = postings.build(t.select(F.col("observation_id").alias("doc_id"), F.col("concept_id").alias("label"), F.col("content").alias("text")), postings.lexical)
    o = postings.overlap(index, probes, t.agg(F.count_distinct("concept_id")).first()[0]).withColumnRenamed("label", "concept_id")
    w = Window.partitionBy("query_id").orderBy(F.round("overlap", 9).desc(), "concept_id")
    return o.withColumn("place", F.row_number().over(w)).where("place <= 5").select("query_id", "concept_id", F.round("overlap", 6).alias("overlap"), "place")


def _words(c):
    return F.array_remove(F.split(F.regexp_replace(F.lower(c), "[^a-z0-9\\s]", " "), "\\s+"), "")


def bm25_top(spark, sf):
    """The ten best documents of each benchmark text by BM25, from a stored index."""
    t = texts(spark, sf).select(F.col("observation_id").alias("doc_id"), F.lit(None).alias("label"), F.col("content").alias("text"))
    (b,) = read(spark, sf, "benchmark")
    probes = b.select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(_words(F.coalesce("text", F.lit(""))))).alias("token"))
    return postings.top_bm25(postings.build(t), probes, 10)


def embedding_population(spark, sf):
    (e,) = read(spark, sf, "embeddings")
    fine = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x))
    return e.agg(F.count("*").alias("live"), F.count_if(fine & ~is_zero(F.col("embedding"))).alias("scored"), F.count_if(is_zero(F.col("embedding"))).alias("zero"), F.count_if(~fine).alias("malformed"), F.min(F.size("embedding")).alias("least_width"), F.max(F.size("embedding")).alias("most_width"))


def embedding_inspection(spark, sf):
    """The population of vectors of which some are made malformed or zero: counts, the widths that occur, and the first twenty malformed ids."""
    (e,) = read(spark, sf, "embeddings")
    i = F.col("vec_id")
    v = F.when(i % 13 == 5, F.lit(None)).when(i % 17 == 3, F.transform("embedding", lambda x: x * float("nan"))).when(i % 19 == 2, F.slice("embedding", 1, 32)).when(i % 23 == 1, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding"))
    return evaluation.population(e.select(i.alias("id"), v.alias("embedding")))


_V = "v as (select vec_id as o, label as c, list_transform(embedding, lambda x: x::double) as x from embeddings)"
_BEST = f"""{_V}, s as (
  select q.o as query_id, q.c as home, v.c as concept_id, v.o as observation_id, list_dot_product(q.x, v.x) as score from v q join v on q.o <> v.o where q.o % 50 = 0
), best as (
  select query_id, home, concept_id, observation_id, score from (
    select *, row_number() over (partition by query_id, concept_id order by score desc, observation_id) as r from s where score > 0) where r = 1
), nom as (select * from (select *, row_number() over (partition by query_id order by score desc, concept_id) as r from best) where r = 1)"""
_MEAN = "mean as (select c, i, avg(e) as x from (select c, unnest(x) as e, generate_subscripts(x, 1) as i from v) group by 1, 2), cent as (select c, list(x order by i) as raw from mean group by 1), centroid as (select c, list_transform(raw, lambda e: e / sqrt(list_dot_product(raw, raw))) as x from cent)"
_RES = f"""{_BEST}, {_MEAN}, cs as (
  select q.o as query_id, centroid.c, list_dot_product(q.x, centroid.x) as s from v q, centroid where q.o % 50 = 0
), t as (
  select q.query_id, round(n.score, 9) as o, round(own.s, 9) as c, round(q.top, 9) as top from (select query_id, max(s) as top from cs group by 1) q
  left join nom n using (query_id) left join cs own on own.query_id = n.query_id and own.c = n.concept_id
), d as (
  select query_id, case when o >= 0.55 and c >= 0.25 then 'attach' when o >= 0.55 then 'fork-signal' when o >= 0.25 then 'ambiguous-fork' when top >= 0.55 then 'blur-duplicate' else 'new' end as mode, o, top from t
), r as (
  select query_id, case mode when 'attach' then 'attached' when 'new' then 'created' else 'ambiguous' end as action, mode,
    round(case when mode in ('fork-signal', 'ambiguous-fork') then o when mode = 'blur-duplicate' then top end, 6) as weight from d)"""

_STATED = f"""with {_V}, s as (
  select q.o as query_id, v.c as concept_id, v.o as observation_id, list_dot_product(q.x, v.x) as score from v q, v where q.o % 50 = 0
), best as (select * from (select *, row_number() over (partition by query_id, concept_id order by score desc, observation_id) as r from s where score > 0) where r = 1
), k as (select *, row_number() over (partition by query_id order by round(score, 9) desc, concept_id) as place from best where score >= 0.12)
select query_id, concept_id, observation_id, round(score, 6) as score, place::int as place from k where place <= 5"""

QUERIES = {f.__name__: f for f in (search_topk, search_topk_stated, nominate_loo, search_recall_loo, tau_sweep, concept_centroids, resolution_bands, resolution_stats, nomination_auc, score_quantiles, related_edges, related_by_profile, lexical_rank, bm25_top, embedding_population, embedding_inspection)}
ORACLE = {
    "search_topk": _STATED,
    "search_topk_stated": _STATED,
    "nominate_loo": f"with {_BEST} select query_id, concept_id, observation_id, round(score, 6) as score, concept_id = home as correct from nom",
    "search_recall_loo": f"""with {_BEST}, k as (select *, row_number() over (partition by query_id order by score desc, concept_id) as p from best), f as (
  select query_id, min(case when concept_id = home then p end) as p from k group by 1)
select count(*) as queries, round(avg((coalesce(p, 99) <= 1)::int), 6) as recall_at_1, round(avg((coalesce(p, 99) <= 3)::int), 6) as recall_at_3, round(avg((coalesce(p, 99) <= 5)::int), 6) as recall_at_5,
  round(avg((coalesce(p, 99) <= 10)::int), 6) as recall_at_10, round(avg(coalesce(1.0::double / p, 0)), 6) as mrr from f""",
    "tau_sweep": f"""with {_BEST} select tau, round(avg((score >= tau and concept_id = home)::int), 6) as correct, round(avg((score >= tau and concept_id <> home)::int), 6) as wrong, round(avg((score < tau)::int), 6) as fork
from nom, (select unnest([{", ".join(f"{t}::double" for t in TAUS)}]) as tau) group by tau""",
    "concept_centroids": f"with {_V}, {_MEAN} select c as concept_id, (generate_subscripts(x, 1) - 1)::int as i, round(unnest(x), 6) as x from centroid",
    "resolution_bands": f"with {_RES} select * from r",
    "resolution_stats": f"with {_RES} select mode, count(*) as n, count(*) filter (action = 'ambiguous') as n_ambiguous from r group by 1",
    "nomination_auc": f"""with {_BEST}, p as (select round(score, 9) as s, concept_id = home as y from best)
select round(sum(case when a.s > b.s then 1.0::double when a.s = b.s then 0.5 else 0 end) / count(*), 6) as auc, (select count(*) from p where y) as n_pos, (select count(*) from p where not y) as n_neg
from p a, p b where a.y and not b.y""",
    "score_quantiles": f"""with {_BEST}, p as (select concept_id = home as same, list(round(score, 6) order by score) as l from best group by 1)
select same, len(l)::bigint as n, l[1] as least, {", ".join(f"l[least(floor(len(l) * {q})::int, len(l) - 1)::int + 1] as {n}" for q, n in ((0.05, "p05"), (0.5, "p50"), (0.95, "p95"), (0.99, "p99")))} from p""",
    "related_edges": f"""with {_V}, {_MEAN}, p as (select a.c as src, b.c as dst, round(list_dot_product(a.x, b.x), 6) as score from centroid a join centroid b on a.c <> b.c
), k as (select *, row_number() over (partition by src order by score desc, dst) as r from p where score >= -0.05 and score < 0.9)
select least(src, dst) as a, greatest(src, dst) as b, max(score) as weight from k where r <= 3 group by 1, 2""",
    "related_by_profile": f"""with {_V}, p as (select a.o as src, b.o as dst, round(list_dot_product(a.x, b.x), 6) as score from v a join v b on a.o <> b.o
), b as (select * from (values ('hashing', 0.55, 0.40), ('multilingual-minilm', 0.70, 0.45), ('all-minilm', 0.72, 0.45), ('bge-small', 0.78, 0.70), ('bge-m3', 0.70, 0.60)) as t(profile, attach, edge)
), k as (select *, row_number() over (partition by profile, src order by score desc, dst) as r from p join b on score >= edge and score < attach)
select profile, least(src, dst) as a, greatest(src, dst) as b, max(score) as weight from k where r <= 6 group by 1, 2, 3""",
    "embedding_inspection": """with t as (select vec_id as id, case when vec_id % 13 = 5 then 'bad' when vec_id % 17 = 3 then 'bad' when vec_id % 19 = 2 then 'half' when vec_id % 23 = 1 then 'zero' else 'fine' end as s, len(embedding) as n from embeddings)
select count(*) as live, count(*) filter (s in ('half', 'fine')) as scored, count(*) filter (s = 'zero') as zero, (select string_agg(w::varchar, ',' order by w) from (select distinct case s when 'half' then 32 else n end as w from t where s <> 'bad')) as widths,
  count(*) filter (s = 'bad') as malformed, (select string_agg(id::varchar, ',' order by id) from (select id from t where s = 'bad' order by id limit 20)) as first_malformed from t""",
    "lexical_rank": """with ix as (select source as c, doc_id as o, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9][a-z0-9_-]{2,}'))) as token from documents
), pr as (select item_id as query_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9][a-z0-9_-]{2,}'))) as token from benchmark
), df as (select token, count(distinct c) as df from ix where token in (select token from pr) group by 1
), idf as (select pr.query_id, pr.token, greatest(0, ln((select count(distinct source) from documents)::double / (1 + coalesce(df.df, 0)))) as idf from pr left join df using (token)
), tot as (select query_id, sum(idf) as total from idf group by 1
), hit as (select query_id, c, o, sum(idf) as h from ix join idf using (token) group by 1, 2, 3
), best as (select query_id, c, max(h) as h from hit group by 1, 2
), ov as (select query_id, c as concept_id, case when total > 0 then h / total else 0 end as overlap from best join tot using (query_id)
), k as (select *, row_number() over (partition by query_id order by round(overlap, 9) desc, concept_id) as place from ov)
select query_id, concept_id, round(overlap, 6) as overlap, place::int as place from k where place <= 5""",
    "bm25_top": r"""with d as (select doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda x: x <> '') as w from documents
), n as (select count(*)::double as n, avg(len(w)) as m from d), tf as (select doc_id, token, count(*) as tf from (select doc_id, unnest(w) as token from d) group by 1, 2
), pr as (select distinct item_id as query_id, unnest(list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda x: x <> '')) as token from benchmark
), df as (select token, count(*) as df from tf where token in (select token from pr) group by 1
), sc as (select pr.query_id, tf.doc_id, round(sum(ln((n.n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len(d.w) / n.m))), 6) as score from pr join tf using (token) join df using (token) join d using (doc_id), n group by 1, 2
), k as (select *, row_number() over (partition by query_id order by score desc, doc_id) as place from sc where score > 0)
select query_id, doc_id, score, place::int as place from k where place <= 10""",
    "embedding_population": """select count(*) as live, count(*) filter (len(list_filter(embedding, lambda x: x <> 0)) > 0) as scored, count(*) filter (len(list_filter(embedding, lambda x: x <> 0)) = 0) as zero,
  count(*) filter (embedding is null or len(list_filter(embedding, lambda x: x is null or isnan(x))) > 0) as malformed, min(len(embedding))::int as least_width, max(len(embedding))::int as most_width from embeddings""",
}
