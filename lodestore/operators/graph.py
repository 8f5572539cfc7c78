"""Edges between concepts and what is derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestore.sources.tables import dealt
from lodestore.staging import stage, unstage

#: An entity is a hub, and links nothing, in more concepts than this or in more than this share of them.
HUB_CONCEPTS, HUB_SHARE, EXEMPT = 50, 0.1, 5
#: Fixed value: links that a walk along supersessions goes at most before its verdict.
WALK_CAP = 1000
#: Members of a group that a task pairs with one another or with as many others; steps of a path that are one row's array.
GROUP_BLOCK = 1000


def hub_gate(memberships: DataFrame, concepts: int) -> DataFrame:
    """Memberships (concept_id, kind, key) of entities that aren't hubs: the gate stands before the self-join, so no key of it has over HUB_CONCEPTS rows.

    Memberships are exploded from few columns, so the optimizer's estimate of their size is far too low: no side of such a join is broadcast by it.
    """
    df = memberships.groupBy("kind", "key").agg(F.count_distinct("concept_id").alias("df"))
    hub = (F.col("df") > HUB_CONCEPTS) | (F.col("df") / F.lit(max(concepts, 1)) > HUB_SHARE)
    kept = df.where(~hub | ((F.col("kind") != "noun") & (F.col("df") <= EXEMPT))).select("kind", "key", "df")
    return memberships.join(kept.hint("merge"), ["kind", "key"])


def about_edges(memberships: DataFrame, concepts: int) -> DataFrame:
    """(a, b, shared, weight): pairs of concepts (a < b) that share entities which aren't hubs."""
    m = hub_gate(memberships, concepts).where(F.col("df") <= HUB_CONCEPTS)
    a, b = (m.select("kind", "key", "weight", F.col("concept_id").alias(n)) for n in "ab")
    pairs = a.join(b.drop("weight").hint("merge"), ["kind", "key"]).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("shared"), F.sum("weight").alias("weight"))


def paired(members: DataFrame, keys: list[str], member: str, block: int = GROUP_BLOCK, parts: int | None = None) -> DataFrame:
    """(keys, a, b): every two members (a < b) of a group, once, from distinct (keys, member).

    Groups of over `block` members are dealt into parts of about that size, and each two parts are a key of their own:
    a task meets two parts at a time, however large a group is, at the cost of a copy of a member for each part.
    """
    members = dealt(members, parts, *keys)
    large = members.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > block).select(*keys, F.ceil(F.col("n") / block).cast("int").alias("parts"))
    t = members.join(large, keys, "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64(member), F.col("parts")).cast("int"))
    left = t.select(*keys, F.col(member).alias("x"), F.col("part").alias("i"), F.explode(F.sequence(F.col("part"), F.col("parts") - 1)).alias("j"))
    right = t.select(*keys, F.col(member).alias("y"), F.explode(F.sequence(F.lit(0), F.col("part"))).alias("i"), F.col("part").alias("j"))
    at = [*keys, "i", "j"]
    met = dealt(left, parts, *at).join(dealt(right, parts, *at), at).where("(i < j and x <> y) or x < y")
    return met.select(*keys, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def co_occurrences(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """(a, b, times) of concepts (a < b) in one session of one circle, from (session_id, circle, concept_id); shuffled in `parts` if named."""
    d = rows.select("session_id", "circle", "concept_id").distinct()
    return dealt(paired(d, ["session_id", "circle"], "concept_id", parts=parts), parts, "a", "b").groupBy("a", "b").agg(F.count("*").alias("times"))


def follows(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """(src, dst, times): consecutive different concepts of a session and circle; checkpoints don't break the chain."""
    w = Window.partitionBy("session_id", "circle").orderBy("at")
    t = rows.where("not is_checkpoint").withColumn("src", F.lag("concept_id").over(w))
    t = t.where("src is not null and src <> concept_id").select("src", F.col("concept_id").alias("dst"))
    return dealt(t, parts, "src", "dst").groupBy("src", "dst").agg(F.count("*").alias("times"))


def nearest_union(scored: DataFrame, least: float, below: float, k: int = 6) -> DataFrame:
    """(a, b, weight): each concept's k nearest in the band [least, below), pairs that either side picks, once."""
    w = Window.partitionBy("src").orderBy(F.col("score").desc(), "dst")
    picked = scored.where((F.col("src") != F.col("dst")) & (F.col("score") >= least) & (F.col("score") < below)).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    return picked.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max("score").alias("weight"))


def hubs(memberships: DataFrame, concepts: int, share: float = 0.5) -> DataFrame:
    """Entities of two members or more and at most the share of concepts; structural kinds before nouns, then by members."""
    m = memberships.groupBy("kind", "key").agg(F.count_distinct("concept_id").alias("members"))
    return m.where((F.col("members") >= 2) & (F.col("members") <= share * concepts)).orderBy(F.col("kind") == "noun", F.col("members").desc(), "key")


def concepts_of(memberships: DataFrame, concepts: DataFrame | None = None, kind: str | None = None, key: str | None = None) -> DataFrame:
    """Memberships of one entity, or of all, among the given concepts or all."""
    t = memberships
    for column, value in (("kind", kind), ("key", key)):
        t = t if value is None else t.where(F.col(column) == value)
    return t if concepts is None else t.join(concepts.select("concept_id"), "concept_id", "left_semi")


def one_hop(edges: DataFrame, family: str) -> DataFrame:
    """(node, direction, peer, place): a family's edges (id, src, dst, family, created_at) seen from either end, one hop, by time then id."""
    t = edges.where(F.col("family") == family)
    both = t.select(F.col("src").alias("node"), F.lit("out").alias("direction"), F.col("dst").alias("peer"), "created_at", "id").union(t.select("dst", F.lit("in"), "src", "created_at", "id"))
    return both.withColumn("place", F.row_number().over(Window.partitionBy("node", "direction").orderBy("created_at", "id")))


def top_thread(components: DataFrame) -> DataFrame:
    """The members (node) of the largest component (node, component), the smaller id among equals; none if all stand alone."""
    size = components.groupBy("component").agg(F.count("*").alias("n")).where("n > 1")
    return components.join(size.orderBy(F.col("n").desc(), "component").limit(1), "component").select("node", "component", "n")


def degrees(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """(node, degree): distinct neighbours over edges (a, b), either way."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("peer")).union(edges.select("b", "a")).where("node <> peer")
    return dealt(both, parts, "node").groupBy("node").agg(F.count_distinct("peer").alias("degree"))


def reach(edges: DataFrame, seeds: DataFrame, hops: int = 2, parts: int | None = None) -> DataFrame:
    """(seed, node, hop): nodes within so many directed hops (src, dst) of each seed, at their least hop."""
    seen = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("hop"))
    front, edges = seen, dealt(edges, parts, "src")
    for h in range(1, hops + 1):
        met = dealt(front, parts, "node").join(edges, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node"), F.lit(h).alias("hop"))
        front = dealt(met, parts, "seed", "node").distinct()
        seen = seen.union(front)
    return dealt(seen, parts, "seed", "node").groupBy("seed", "node").agg(F.min("hop").alias("hop"))


def chain_ends(links: DataFrame) -> DataFrame:
    """(src, end, hops, cyclic) of a table where each src has one dst: the end of its chain, by doubling the pointers.

    Joins of pointers, here and in what follows, are merged: broadcast, each round would send a table to the driver again.
    After k rounds a pointer spans 2^k links. Pointers that have stopped are set aside and only looked up; one that
    hasn't after more links than there are rows runs in a circle and has no end.
    """
    no = F.lit(False)
    going = links.select("src", F.col("dst").alias("end"), F.lit(1).cast("long").alias("hops"), no.alias("still"))
    n, span, done = links.count(), 1, links.select("src", F.col("dst").alias("end"), F.lit(1).cast("long").alias("hops"), no.alias("still")).limit(0)
    while span <= n:
        nxt = going.union(done).select(F.col("src").alias("mid"), F.col("end").alias("far"), F.col("hops").alias("more"), F.col("still").alias("rests"))
        met = going.join(nxt.hint("merge"), going.end == nxt.mid, "left")
        met = met.select("src", F.coalesce("far", "end").alias("end"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.coalesce("rests", F.lit(True)).alias("still"))
        now = stage(met, "chain")
        done, going, span = done.union(now.where("still")), now.where("not still"), span * 2
        if going.isEmpty():
            break
    circle = going.select("src", F.lit(None).cast(links.schema["dst"].dataType).alias("end"), F.lit(None).cast("long").alias("hops"), F.lit(True).alias("cyclic"))
    return done.select("src", "end", "hops", no.alias("cyclic")).union(circle)


def on_cycles(links: DataFrame) -> DataFrame:
    """(node, cycle): the nodes of circles in a table where each src has one dst, and the least node of their circle.

    Pointers double until they are longer than the table: then they end in a circle, if they haven't stopped, and all
    of a circle's nodes are ends. Each carries the least node on its way.
    """
    now = stage(links.select("src", F.col("dst").alias("end"), F.least("src", "dst").alias("low")), "rings")
    n, span = now.count(), 1
    while span <= n:
        nxt = now.select(F.col("src").alias("mid"), F.col("end").alias("far"), F.col("low").alias("under"))
        then = stage(now.join(nxt.hint("merge"), now.end == nxt.mid).select("src", F.col("far").alias("end"), F.least("low", "under").alias("low")), "rings")
        unstage(now)
        now, span = then, span * 2
    ends = now.select(F.col("end").alias("src")).distinct()
    return now.join(ends.hint("merge"), "src", "left_semi").select(F.col("src").alias("node"), F.col("low").alias("cycle"))


def cycle_paths(links: DataFrame) -> DataFrame:
    """(cycle, place, node): each circle's nodes in order from its least one, by ranking them with doubled pointers."""
    rings = on_cycles(links)
    back = links.join(rings.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node"), F.col("src").alias("prev"))
    starts = F.col("node") == F.col("cycle")
    now = stage(rings.join(back, "node").select("node", "cycle", F.when(~starts, F.col("prev")).alias("prev"), F.when(starts, 0).otherwise(1).cast("long").alias("place")), "ranks")
    while not now.where("prev is not null").isEmpty():
        far = now.select(F.col("node").alias("prev"), F.col("prev").alias("far"), F.col("place").alias("more"))
        then = stage(now.join(far, "prev", "left").select("node", "cycle", F.col("far").alias("prev"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place")), "ranks")
        unstage(now)
        now = then
    return now.select("cycle", "place", "node")


def jumps(links: DataFrame, most: int) -> list[DataFrame]:
    """Links (src, dst) where each src has one dst, and what they make of 2, 4, 8 and so on, while a walk of `most` needs them."""
    out = [stage(links.select("src", "dst"), "jumps")]
    for _ in range(1, most.bit_length()):
        out.append(stage(out[-1].join(out[-1].select(F.col("src").alias("dst"), F.col("dst").alias("far")).hint("merge"), "dst").select("src", F.col("far").alias("dst")), "jumps"))
    return out


def ancestors(doubled: list[DataFrame], asked: DataFrame) -> DataFrame:
    """`asked` (node, up, and more) with `found`: the node that lies `up` links on from each, null past an end. Doubled pointers (`jumps`) are taken where `up` has a bit."""
    t = asked.withColumn("found", F.col("node"))
    for bit, jump in enumerate(doubled):
        step = jump.select(F.col("src").alias("found"), F.col("dst").alias("__next"))
        t = t.join(step.hint("merge"), "found", "left").withColumn("found", F.when(F.col("up").bitwiseAND(F.lit(1 << bit)) == 0, F.col("found")).otherwise(F.col("__next"))).drop("__next")
    return t


def cycle_verdicts(links: DataFrame, proposals: DataFrame, cap: int = WALK_CAP) -> tuple[DataFrame, DataFrame]:
    """What each proposed link (src, dst) would do to links where each src has one dst, and the circles' paths.

    (src, dst, verdict, hops): `cycle` if fewer than `cap` links lead from dst to src, else `cap` if the walk from dst
    doesn't end within them (a circle never does), else `safe`; hops of a circle count the proposed link. The paths
    (src, dst, place, node) begin and end with src; they are those of all circles, however long, the cap bounds verdicts only.
    """
    ends = chain_ends(links)
    depth = lambda name: ends.select(F.col("src").alias(name), F.col("hops").alias(f"{name}_hops"), F.col("cyclic").alias(f"{name}_cyclic"))
    t = proposals.select("src", "dst").distinct().join(depth("src").hint("merge"), "src", "left").join(depth("dst").hint("merge"), "dst", "left").na.fill({"src_hops": 0, "dst_hops": 0, "src_cyclic": False, "dst_cyclic": False})
    apart = F.when(F.col("dst_cyclic") | F.col("src_cyclic"), F.lit(-1)).otherwise(F.col("dst_hops") - F.col("src_hops"))
    t = stage(t.withColumn("up", F.when(F.col("src") == F.col("dst"), F.lit(0)).otherwise(apart).cast("long")), "proposals")
    doubled = jumps(links, max(t.agg(F.max("up")).first()[0] or 0, 0))
    near = ancestors(doubled, t.where("up >= 0").select("src", "dst", "up", F.col("dst").alias("node")))
    met = stage(near.where("found = src").select("src", "dst", "up", F.lit(True).alias("met")), "met")
    ring = F.coalesce("met", F.lit(False)) & (F.col("up") < cap)
    verdict = F.when(ring, "cycle").when(F.col("dst_cyclic") | (F.col("dst_hops") >= cap), "cap").otherwise("safe")
    said = t.join(met.drop("up").hint("merge"), ["src", "dst"], "left").select("src", "dst", verdict.alias("verdict"), F.when(ring, F.col("up") + 1).alias("hops"))
    runs = met.select("src", "dst", "up", F.explode(F.sequence(F.lit(0).cast("long"), F.col("up"), F.lit(GROUP_BLOCK).cast("long"))).alias("run"))
    steps = runs.select("src", "dst", F.col("dst").alias("node"), F.explode(F.sequence("run", F.least(F.col("up"), F.col("run") + (GROUP_BLOCK - 1)))).alias("up"))
    path = ancestors(doubled, steps).select("src", "dst", (F.col("up") + 1).alias("place"), F.col("found").alias("node"))
    return said, path.union(met.select("src", "dst", F.lit(0).cast("long").alias("place"), F.col("src").alias("node")))


def without_support(edges: DataFrame, memberships: DataFrame, parts: int | None = None) -> DataFrame:
    """Edges (a, b) whose concepts no longer share an entity.

    Edges meet a's entities, then those of b are looked up: what is joined grows with edges times entities a concept,
    never with the pairs of an entity's members.
    """
    m = memberships.select("kind", "key", "concept_id").distinct()
    at = lambda t, *keys: dealt(t, parts, *keys).hint("merge")
    mine = dealt(edges.select("a", "b").distinct(), parts, "a").join(at(m.withColumnRenamed("concept_id", "a"), "a"), "a")
    by = ["b", "kind", "key"]
    held = dealt(dealt(mine, parts, *by).join(at(m.withColumnRenamed("concept_id", "b"), *by), by, "left_semi").select("a", "b"), parts, "a", "b").distinct()
    return edges.join(held, ["a", "b"], "left_anti")
