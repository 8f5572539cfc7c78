"""Joins, latest-per-group, pages and counts over the relational tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestore.operators import ranking, resolution
from lodestore.sources.tables import day_millis, read

NOW_MS = 1_100_000_000_000


def latest_order(spark, sf):
    """Each customer's last order, by date then key."""
    (o,) = read(spark, sf, "orders")
    return o.groupBy(F.col("o_custkey").alias("custkey")).agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("status"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("orderkey"))


def earliest_parent(spark, sf):
    """Every customer with its first order, null without one."""
    c, o = read(spark, sf, "customer", "orders")
    first = o.groupBy("o_custkey").agg(F.min(F.struct("o_orderdate", "o_orderkey")).alias("f"))
    return c.join(first, c.c_custkey == first.o_custkey, "left").select("c_custkey", F.col("f.o_orderkey").alias("first_order"))


def unmatched_customers(spark, sf):
    """Customers without an urgent order."""
    c, o = read(spark, sf, "customer", "orders")
    o = o.where("o_orderpriority = '1-URGENT' and o_totalprice > 200000")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey", "c_nationkey")


def live_semi(spark, sf):
    """Suppliers of a nation with customers in the building segment, semi-joined, without those that no line names."""
    s, c, li = read(spark, sf, "supplier", "customer", "lineitem")
    kept = s.join(c.where("c_mktsegment = 'BUILDING'"), s.s_nationkey == c.c_nationkey, "left_semi")
    return kept.join(li, kept.s_suppkey == li.l_suppkey, "left_semi").select("s_suppkey", "s_nationkey")


def capped_parents(spark, sf):
    """The first four distinct parts of each order, sorted, and whether there are more."""
    (li,) = read(spark, sf, "lineitem")
    t = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("p"))
    return t.select("l_orderkey", F.array_join(F.slice("p", 1, 4), ",").alias("parts"), (F.size("p") > 4).alias("truncated"), F.size("p").alias("n"))


def null_safe_scope(spark, sf):
    """Lines whose flag isn't R, nulls included, by status: null-safe inequality, and the mean of a conditional input."""
    (li,) = read(spark, sf, "lineitem")
    return li.where(~F.col("l_returnflag").eqNullSafe("R")).groupBy("l_linestatus").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("l_discount") > 0.05, F.col("l_quantity"))), 6).alias("avg_discounted"))


def keyset_page(spark, sf):
    """The page after a cursor (date, key), oldest first."""
    (o,) = read(spark, sf, "orders")
    after = F.expr("o_orderdate > timestamp'1996-06-01' or (o_orderdate = timestamp'1996-06-01' and o_orderkey > 100)")
    return o.where(after).orderBy("o_orderdate", "o_orderkey").limit(20).select("o_orderkey", "o_orderdate")


def offset_page(spark, sf):
    (o,) = read(spark, sf, "orders")
    return o.orderBy(F.col("o_orderdate").desc(), "o_orderkey").offset(40).limit(20).select("o_orderkey", "o_custkey")


def circle_counts(spark, sf):
    """Documents, sources, newest id and share of labelled ones by language: independent counts joined after grouping."""
    d, lab = read(spark, sf, "documents", "labels")
    a = d.groupBy("lang").agg(F.count("*").alias("documents"), F.count_distinct("source").alias("sources"), F.max("doc_id").alias("last_id"))
    b = d.join(lab, "doc_id").groupBy("lang").agg(F.count("*").alias("labelled"), F.count_if(F.col("toxic") == 1).alias("toxic"))
    return a.join(b, "lang", "left").select("lang", "documents", "sources", "last_id", F.coalesce("labelled", F.lit(0)).alias("labelled"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def overview_counts(spark, sf):
    """One row of store-wide counts and averages, each table aggregated on its own."""
    o, c, li = read(spark, sf, "orders", "customer", "lineitem")
    one = o.agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "O").alias("open_orders"), F.count_distinct("o_custkey").alias("buyers"))
    two = c.agg(F.count("*").alias("customers"), F.round(F.avg("c_acctbal"), 4).alias("avg_balance"))
    three = li.agg(F.count("*").alias("lines"))
    return one.crossJoin(two).crossJoin(three).withColumn("density", F.round(F.col("lines") / F.nullif(F.col("orders"), F.lit(0)), 4))


def size_buckets(spark, sf):
    (o,) = read(spark, sf, "orders")
    n = o.groupBy("o_custkey").count()
    k = F.col("count")
    bucket = F.when(k == 1, "1").when(k < 5, "2-4").when(k < 10, "5-9").when(k < 20, "10-19").otherwise("20+")
    return n.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("concepts"), F.sum("count").alias("observations"))


def revision_counts(spark, sf):
    (li,) = read(spark, sf, "lineitem")
    return li.groupBy("l_partkey").agg(F.count("*").alias("revisions"), F.max("l_linenumber").alias("max_version"), F.round(F.min("l_extendedprice"), 2).alias("least"))


def duplicate_slugs(spark, sf):
    (p,) = read(spark, sf, "part")
    return p.groupBy("p_name").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first")).where("n > 1")


def session_stats(spark, sf):
    (e,) = read(spark, sf, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("sessions"), F.round(F.corr("value", F.log(F.col("event_id") + 1.0)), 6).alias("r"))


def budget_prefix(spark, sf):
    """The turns of each conversation that fit 2,000 characters from its start."""
    (c,) = read(spark, sf, "conversations")
    return ranking.within_budget(c, "conv_id", ["turn"], "text", 2000).select("conv_id", "turn", "used")


def living_model(spark, sf):
    """Customers as concepts: balance as confidence, orders as usefulness, decayed to a fixed now; the ten highest."""
    c, o = read(spark, sf, "customer", "orders")
    a = o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max(day_millis("o_orderdate")).alias("last"), F.min(day_millis("o_orderdate")).alias("first"))
    t = c.join(a, c.c_custkey == a.o_custkey)
    score = ranking.living_score((F.col("c_acctbal") + 1000) / 11000, F.col("n") / 10, F.when(F.col("n") > 5, F.col("last")), F.col("last"), F.col("n").cast("double"), F.col("first"), F.lit(NOW_MS))
    t = t.withColumn("score", F.round(F.log(score), 6))
    return t.orderBy(F.col("score").desc_nulls_last(), "c_custkey").limit(10).select("c_custkey", "score")


def confirmations(spark, sf):
    """Orders as observations of the customer's concept: another clerk's priority than before confirms it."""
    (o,) = read(spark, sf, "orders")
    t = o.select(F.col("o_custkey").alias("concept_id"), F.col("o_orderpriority").alias("session_id"), day_millis("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("observation_id"))
    return resolution.confirmations(t)


def stratified_sample(spark, sf):
    """Documents by language and third of length (ceil(n/3) rows each), the three of each stratum that come first by digest."""
    (d,) = read(spark, sf, "documents")
    # a row's rank in its language is the number of shorter texts, from counts by length, and its place among those of its length
    each = d.groupBy("lang", "n_chars").agg(F.count("*").alias("c"))
    w = Window.partitionBy("lang").orderBy("n_chars").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select("lang", "n_chars", F.coalesce(F.sum("c").over(w), F.lit(0)).alias("shorter"), F.sum("c").over(Window.partitionBy("lang")).alias("n"))
    t = d.withColumn("r", F.row_number().over(Window.partitionBy("lang", "n_chars").orderBy("doc_id"))).join(each, ["lang", "n_chars"]).withColumn("r", F.col("r") + F.col("shorter"))
    t = t.withColumn("third", F.when(F.col("n") < 3, 0).otherwise(F.floor((F.col("r") - 1) / F.ceil(F.col("n") / 3))).cast("int"))
    pick = Window.partitionBy("lang", "third").orderBy(F.md5(F.col("doc_id").cast("string")))
    return t.withColumn("k", F.row_number().over(pick)).where("k <= 3").select("lang", "third", "doc_id")


_LIVE = f"""with a as (select o_custkey, count(*) as n, max(epoch_ms(o_orderdate)) as last, min(epoch_ms(o_orderdate)) as first from orders group by 1), t as (
  select c_custkey, (c_acctbal + 1000) / 11000 * (1 + n / 10.0::double * exp(-(({NOW_MS} - last) / 86400000.0::double) / 60)) * exp(-(({NOW_MS} - last) / 86400000.0::double) / 14)
    * (1 + 0.5 * greatest(n * 0.1, n * exp(-(({NOW_MS} - first) / 86400000.0::double) / 120))) as s from customer join a on a.o_custkey = c_custkey)
select c_custkey, round(case when s > 0 then ln(s) end, 6) as score from t order by score desc nulls last, c_custkey limit 10"""

QUERIES = {
    f.__name__: f
    for f in (latest_order, earliest_parent, unmatched_customers, live_semi, capped_parents, null_safe_scope, keyset_page, offset_page, circle_counts, overview_counts, size_buckets, revision_counts, duplicate_slugs, session_stats, budget_prefix, living_model, confirmations, stratified_sample)
}
ORACLE = {
    "latest_order": "select o_custkey as custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) as status, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as orderkey from orders group by 1",
    "earliest_parent": "select c_custkey, (select o_orderkey from orders where o_custkey = c_custkey order by o_orderdate, o_orderkey limit 1) as first_order from customer",
    "unmatched_customers": "select c_custkey, c_nationkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT' and o_totalprice > 200000)",
    "live_semi": "select s_suppkey, s_nationkey from supplier where s_nationkey in (select c_nationkey from customer where c_mktsegment = 'BUILDING') and s_suppkey in (select l_suppkey from lineitem)",
    "capped_parents": "select l_orderkey, array_to_string(list_slice(list_sort(list(distinct l_partkey)), 1, 4), ',') as parts, count(distinct l_partkey) > 4 as truncated, count(distinct l_partkey)::int as n from lineitem group by 1",
    "null_safe_scope": "select l_linestatus, count(*) as n, round(avg(case when l_discount > 0.05 then l_quantity end), 6) as avg_discounted from lineitem where l_returnflag is distinct from 'R' group by 1",
    "keyset_page": "select o_orderkey, o_orderdate from orders where (o_orderdate, o_orderkey) > (timestamp '1996-06-01', 100) order by o_orderdate, o_orderkey limit 20",
    "offset_page": "select o_orderkey, o_custkey from orders order by o_orderdate desc, o_orderkey limit 20 offset 40",
    "circle_counts": """select a.lang, documents, sources, last_id, coalesce(labelled, 0) as labelled, coalesce(toxic, 0) as toxic from (select lang, count(*) as documents, count(distinct source) as sources, max(doc_id) as last_id from documents group by 1) a
left join (select lang, count(*) as labelled, count(*) filter (toxic = 1) as toxic from documents join labels using (doc_id) group by 1) b on a.lang = b.lang""",
    "overview_counts": """select (select count(*) from orders) as orders, (select count(*) from orders where o_orderstatus = 'O') as open_orders, (select count(distinct o_custkey) from orders) as buyers, (select count(*) from customer) as customers,
  (select round(avg(c_acctbal), 4) from customer) as avg_balance, (select count(*) from lineitem) as lines, round((select count(*) from lineitem)::double / (select count(*) from orders), 4) as density""",
    "size_buckets": "select case when k = 1 then '1' when k < 5 then '2-4' when k < 10 then '5-9' when k < 20 then '10-19' else '20+' end as bucket, count(*) as concepts, sum(k)::bigint as observations from (select count(*) as k from orders group by o_custkey) group by 1",
    "revision_counts": "select l_partkey, count(*) as revisions, max(l_linenumber) as max_version, round(min(l_extendedprice), 2) as least from lineitem group by 1",
    "duplicate_slugs": "select p_name, count(*) as n, min(p_partkey) as first from part group by 1 having count(*) > 1",
    "session_stats": "select event_type, count(*) as events, count(distinct user_id) as sessions, round(corr(value, ln(event_id + 1.0::double)), 6) as r from events group by 1",
    "budget_prefix": "select * from (select conv_id, turn, (sum(length(text)) over (partition by conv_id order by turn rows unbounded preceding))::bigint as used from conversations) where used <= 2000",
    "living_model": _LIVE,
    "confirmations": """with t as (select o_custkey as c, epoch_ms(o_orderdate) as made, o_orderpriority as s, lag(o_orderpriority) over (partition by o_custkey order by o_orderdate, o_orderkey) as b from orders)
select c as concept_id, count(*) as support_count, round(least(0.95, 0.6 + 0.1 * count(*) filter (b is not null and b <> s)), 6)::double as confidence, max(case when b is not null and b <> s then made end) as last_confirmed_at, count(*) filter (b is not null and b <> s) as arousal_gain from t group by 1""",
    "stratified_sample": """with t as (select doc_id, lang, row_number() over (partition by lang order by n_chars, doc_id) as r, count(*) over (partition by lang) as n from documents
), b as (select doc_id, lang, (case when n < 3 then 0 else floor((r - 1) / ceil(n / 3.0)) end)::int as third from t
), k as (select *, row_number() over (partition by lang, third order by md5(doc_id::varchar)) as k from b) select lang, third, doc_id from k where k <= 3""",
}
