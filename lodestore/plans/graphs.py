"""Edges, components and chains over the model tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestore.operators import graph
from lodestore.operators.components import connected_components
from lodestore.sources.tables import dealt, memberships, parts_of, read, visits


def _lines(spark, sf, each=1):
    """Partitions for shuffles of so many rows a line."""
    return parts_of(read(spark, sf, "lineitem")[0], each)


def co_occurrence_edges(spark, sf):
    return graph.co_occurrences(visits(spark, sf), _lines(spark, sf, 3))


def follow_edges(spark, sf):
    return graph.follows(visits(spark, sf), _lines(spark, sf))


def about_edges(spark, sf):
    n = read(spark, sf, "part")[0].count()
    return graph.about_edges(memberships(spark, sf), n)


def entity_hubs(spark, sf):
    n = read(spark, sf, "part")[0].count()
    return graph.hubs(memberships(spark, sf), n).select("kind", "key", "members")


def concept_degrees(spark, sf):
    parts = _lines(spark, sf, 3)
    return graph.degrees(graph.co_occurrences(visits(spark, sf), parts), parts)


def session_components(spark, sf):
    """Components of suppliers and customers' nations that trade lines of the highest quantity."""
    o, li = read(spark, sf, "orders", "lineitem")
    e = li.where("l_quantity >= 50 and l_discount >= 0.09").join(o, li.l_orderkey == o.o_orderkey).select((F.col("l_suppkey") * 2).alias("a"), (F.col("o_custkey") * 2 + 1).alias("b")).distinct()
    return connected_components(e)


def component_sizes(spark, sf):
    return session_components(spark, sf).groupBy("component").agg(F.count("*").alias("members"))


def trade_components(spark, sf):
    """Components of suppliers and customers over every order line."""
    o, li = read(spark, sf, "orders", "lineitem")
    parts = parts_of(li)
    t = dealt(li, parts, "l_orderkey").join(dealt(o, parts, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    e = t.select((F.col("l_suppkey") * 2).alias("a"), (F.col("o_custkey") * 2 + 1).alias("b"))
    return connected_components(dealt(e, parts, "a", "b").distinct())


def trade_component_sizes(spark, sf):
    return trade_components(spark, sf).groupBy("component").agg(F.count("*").alias("members"))


def two_hop_reach(spark, sf):
    """Parts reached from every fiftieth part over follow edges seen at least once, in at most two hops."""
    e = graph.follows(visits(spark, sf), _lines(spark, sf)).select("src", "dst")
    seeds = read(spark, sf, "part")[0].where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("node"))
    return graph.reach(e, seeds, parts=_lines(spark, sf, 2)).groupBy("seed", "hop").agg(F.count("*").alias("nodes"))


def alias_chains(spark, sf):
    """Each order points at its customer's next one; the end of each chain and its length."""
    (o,) = read(spark, sf, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    links = o.select(F.col("o_orderkey").alias("src"), F.lead("o_orderkey").over(w).alias("dst")).where("dst is not null")
    return graph.chain_ends(links).select("src", "end", "hops", "cyclic")


def unsupported_edges(spark, sf):
    """Co-occurrences in low-priority orders whose parts share neither brand and size, brand, nor a word of their names."""
    e = graph.co_occurrences(visits(spark, sf).where("circle = '5-LOW'")).select("a", "b")
    return graph.without_support(e, memberships(spark, sf).where("kind <> 'noun'"))


def unsupported_edges_all(spark, sf):
    """Co-occurrences in all orders whose parts share neither brand and size, brand, nor a word of their names."""
    parts = _lines(spark, sf, 6)
    e = graph.co_occurrences(visits(spark, sf), parts).select("a", "b")
    return graph.without_support(e, memberships(spark, sf).where("kind <> 'noun'"), parts)


def undirected_counts(spark, sf):
    e = graph.follows(visits(spark, sf), _lines(spark, sf))
    pairs = e.select((F.col("times") > 1).alias("repeated"), F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    return dealt(pairs, _lines(spark, sf), "a", "b").distinct().groupBy("repeated").agg(F.count("*").alias("edges"))


def dangling_edges(spark, sf):
    """Follow edges with an endpoint that is no live part (large parts are retired), and which ends are missing."""
    e = graph.follows(visits(spark, sf), _lines(spark, sf)).select("src", "dst")
    live = read(spark, sf, "part")[0].where("p_size < 45").select(F.col("p_partkey").alias("k"), F.lit(True).alias("is"))
    parts = _lines(spark, sf)
    t = dealt(e, parts, "src").join(live.withColumnsRenamed({"k": "src", "is": "s"}), "src", "left")
    t = dealt(t, parts, "dst").join(live.withColumnsRenamed({"k": "dst", "is": "d"}), "dst", "left")
    missing = F.array_compact(F.array(F.when(F.col("s").isNull(), "src"), F.when(F.col("d").isNull(), "dst")))
    return t.withColumn("missing", F.array_join(missing, ",")).where("missing <> ''").groupBy("missing").agg(F.count("*").alias("edges"))


_VISIT = "v as (select l_orderkey as s, o_orderpriority as c, l_partkey as p, l_linenumber as n, l_suppkey as k from lineitem join orders on l_orderkey = o_orderkey)"
_CO = f"{_VISIT}, d as (select distinct s, c, p from v), co as (select x.p as a, y.p as b, count(*) as times from d x join d y on x.s = y.s and x.c = y.c and x.p < y.p group by 1, 2)"
_FO = f"{_VISIT}, l as (select lag(p) over (partition by s, c order by n, k, p) as src, p as dst from v), fo as (select src, dst, count(*) as times from l where src is not null and src <> dst group by 1, 2)"
_MEM = "m as (select p_partkey as c, 'id' as kind, p_brand || '-' || p_size as key, 3 as weight from part union all select p_partkey, 'lib', p_brand, 2 from part union all select distinct p_partkey, 'noun', unnest(string_split(p_name, ' ')), 1 from part)"
_COMP = "e as (select distinct l_suppkey * 2 as a, o_custkey * 2 + 1 as b from lineitem join orders on l_orderkey = o_orderkey where l_quantity >= 50 and l_discount >= 0.09), s as (select a, b from e union select b, a from e), reach as (select a as node, a as root from s union select s.b, r.root from reach r join s on s.a = r.node), comp as (select node, min(root) as component from reach group by 1)"

QUERIES = {f.__name__: f for f in (co_occurrence_edges, follow_edges, about_edges, entity_hubs, concept_degrees, session_components, component_sizes, trade_components, trade_component_sizes, two_hop_reach, alias_chains, unsupported_edges, unsupported_edges_all, undirected_counts, dangling_edges)}
ORACLE = {
    "co_occurrence_edges": f"with {_CO} select * from co",
    "follow_edges": f"with {_FO} select * from fo",
    "about_edges": f"""with {_MEM}, n as (select count(*) as n from part), df as (select kind, key, count(distinct c) as df from m group by 1, 2), g as (
  select m.* from m join df using (kind, key), n where df <= 50 and (not (df > 50 or df / n.n::double > 0.1) or (kind <> 'noun' and df <= 5)))
select x.c as a, y.c as b, count(*) as shared, sum(x.weight)::bigint as weight from g x join g y on x.kind = y.kind and x.key = y.key and x.c < y.c group by 1, 2""",
    "entity_hubs": f"with {_MEM} select kind, key, count(distinct c) as members from m group by 1, 2 having count(distinct c) >= 2 and count(distinct c) <= 0.5 * (select count(*) from part)",
    "concept_degrees": f"with {_CO} select node, count(distinct peer) as degree from (select a as node, b as peer from co union all select b, a from co) group by 1",
    "session_components": f"with recursive {_COMP} select node, component from comp",
    "component_sizes": f"with recursive {_COMP} select component, count(*) as members from comp group by 1",
    "two_hop_reach": f"""with {_FO}, z as (select p_partkey as seed, p_partkey as node, 0 as hop from part where p_partkey % 50 = 0), o as (select distinct seed, dst as node, 1 as hop from z join fo on src = node
), t as (select distinct seed, dst as node, 2 as hop from o join fo on src = node), a as (select seed, node, min(hop) as hop from (select * from z union all select * from o union all select * from t) group by 1, 2)
select seed, hop, count(*) as nodes from a group by 1, 2""",
    "alias_chains": """with t as (select o_custkey, o_orderkey, row_number() over w as r, count(*) over (partition by o_custkey) as n, last_value(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and unbounded following) as e
from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)) select o_orderkey as src, e as "end", n - r as hops, false as cyclic from t where r < n""",
    "unsupported_edges": f"""with {_CO.replace("l_orderkey = o_orderkey)", "l_orderkey = o_orderkey and o_orderpriority = '5-LOW')")}, {_MEM}
select a, b from co where not exists (select 1 from m x join m y on x.kind = y.kind and x.key = y.key and x.kind <> 'noun' where x.c = co.a and y.c = co.b)""",
    "undirected_counts": f"with {_FO} select times > 1 as repeated, count(distinct (least(src, dst), greatest(src, dst))) as edges from fo group by 1",
    "dangling_edges": f"""with {_FO}, k as (select p_partkey as p from part where p_size < 45), t as (select src not in (select p from k) as s, dst not in (select p from k) as d from fo)
select case when s and d then 'src,dst' when s then 'src' else 'dst' end as missing, count(*) as edges from t where s or d group by 1""",
}
