"""Measures of retrieval and resolution quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestore.staging import stage


def recall_at(retrieved: Column, gold: Column, k: int) -> Column:
    """Share of the gold ids among the first k retrieved."""
    return F.size(F.array_intersect(F.slice(retrieved, 1, k), gold)) / F.size(gold)


def reciprocal_rank(retrieved: Column, gold: Column) -> Column:
    """Mean over gold ids of one by their place; 0 for one that isn't there."""
    each = F.transform(gold, lambda g: F.coalesce(F.lit(1.0) / F.nullif(F.array_position(retrieved, g), F.lit(0)), F.lit(0.0)))
    return F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / F.size(gold)


def auc(rows: DataFrame, score: str, positive: Column, by: list[str] | None = None, buckets: int = 256) -> DataFrame:
    """Area under the ROC curve by tie-averaged ranks; null without both classes.

    Rows are counted per distinct score. Scores lie in buckets between approximate quantiles of the distinct ones, so
    that outliers don't crowd the rest; the running count goes inside each, and over the buckets' few sums, so no task
    orders all scores.
    """
    by = by or []
    each = rows.groupBy(*by, score).agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    edges = each.agg(F.percentile_approx(score, [i / buckets for i in range(1, buckets)], buckets * 40).alias("edges")).first()[0] or []
    each = each.withColumn("bucket", F.size(F.filter(F.array(*map(F.lit, edges)).cast("array<double>"), lambda e: e < F.col(score))))
    sums = each.groupBy(*by, "bucket").agg(F.sum("neg").alias("n"))
    before = Window.partitionBy(*by, F.lit(0)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy(*by, "bucket").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    t = each.withColumn("below", F.coalesce(F.sum("neg").over(inside), F.lit(0))).join(sums, [*by, "bucket"])
    wins = F.sum(F.col("pos") * (F.col("earlier") + F.col("below") + F.col("neg") / 2))
    return t.groupBy(*by).agg(F.try_divide(wins, (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))


def share_at_least(value: Column, threshold: float) -> Column:
    """The share of rows at or above a threshold."""
    return F.avg((value >= threshold).cast("double"))


#: Distinct values among which a rank is looked up by one window, and ranges that a longer stretch is cut into.
LEAF, RANGES = 10_000, 256


def index_quantiles(rows: DataFrame, value: str, shares: list[float], by: list[str]) -> DataFrame:
    """Quantiles at index floor(share * n) of the sorted values (not interpolated), per class of `by`, exactly.

    Each quantile is a rank. Counts of equal values are cut into ranges at approximate quantiles, counted exactly, and
    only the range that holds the rank is looked at again, until it has LEAF distinct values at most: so no task orders
    a class. There are few classes and shares: their ranges are broadcast.
    """
    each = stage(rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("c")), "values")
    whole = each.groupBy(*by).agg(F.sum("c").alias("n"), F.min("v").alias("least"), F.max("v").alias("high"), F.count("*").alias("values"))
    ranks = F.explode(F.array(*[F.struct(F.lit(i).alias("q"), F.least(F.floor(F.col("n") * p), F.col("n") - 1).alias("rank")) for i, p in enumerate(shares)])).alias("r")
    at = [*by, "q"]
    open_ = stage(whole.select(*by, "least", "high", "values", ranks).select(*by, F.col("least").alias("low"), "high", "values", "r.*"), "ranks")
    found = None
    while True:
        small = open_.where(F.col("values") <= LEAF)
        inside = _between(each, small, by).withColumn("upto", F.sum("c").over(Window.partitionBy(*at).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
        here = inside.where(F.col("upto") > F.col("rank")).groupBy(*at).agg(F.min("v").alias("v"))
        found = here if found is None else found.union(here)
        wide = open_.where(F.col("values") > LEAF)
        if wide.isEmpty():
            break
        part = _between(each, wide, by)
        edges = part.groupBy(*at).agg(F.array_distinct(F.percentile_approx("v", [i / RANGES for i in range(1, RANGES)], RANGES * 40)).alias("edges"))
        cell = F.size(F.filter("edges", lambda e: e < F.col("v")))
        cells = part.join(F.broadcast(edges), at).groupBy(*at, "rank", cell.alias("cell")).agg(F.sum("c").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("values"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy(*at).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        cells = cells.withColumn("before", before).where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n")))
        open_ = stage(cells.select(*by, "low", "high", "values", "q", (F.col("rank") - F.col("before")).alias("rank")), "ranks")
    names = [f"p{round(p * 100):02d}" for p in shares]
    wide = found.groupBy(*by).agg(*[F.max(F.when(F.col("q") == i, F.col("v"))).alias(n) for i, n in enumerate(names)])
    return whole.select(*by, "n", "least").join(F.broadcast(wide), by).select(*by, "n", "least", *names)


def _between(each: DataFrame, ranges: DataFrame, by: list[str]) -> DataFrame:
    return each.join(F.broadcast(ranges), by).where((F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high"))).select(*by, "q", "rank", "v", "c")


def sweep(scored: DataFrame, score: str, right: Column, taus: list[float]) -> DataFrame:
    """Share attached rightly, wrongly and forked at each threshold, in one pass: every row meets every tau inside its task."""
    t = scored.select(F.col(score).alias("s"), right.alias("right"), F.explode(F.array(*map(F.lit, taus))).alias("tau"))
    return t.groupBy("tau").agg(
        F.round(F.avg(((F.col("s") >= F.col("tau")) & F.col("right")).cast("double")), 6).alias("correct"),
        F.round(F.avg(((F.col("s") >= F.col("tau")) & ~F.col("right")).cast("double")), 6).alias("wrong"),
        F.round(F.avg((F.col("s") < F.col("tau")).cast("double")), 6).alias("fork"),
    )


def bm25(hits: DataFrame, probes: DataFrame, documents: int, mean_length: float, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score) above 0 from hits (doc_id, token, tf, dl), which need hold only tokens of the probes (query_id, token)."""
    df = hits.groupBy("token").agg(F.count("*").alias("df"))
    idf = F.log((F.lit(float(documents)) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / float(mean_length or 1)))
    asked = probes.join(df, "token").select("query_id", "token", idf.alias("idf"))
    return hits.join(asked, "token").groupBy("query_id", "doc_id").agg(F.sum(F.col("idf") * part).alias("score")).where("score > 0")


def bm25_own(texts: DataFrame, probes: DataFrame, df: DataFrame, documents: int, mean_length: float, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, score) of each query's own document by bm25(): texts (doc_id, words) meet the probes (query_id, token) of their id alone."""
    words = texts.select(F.col("doc_id").alias("query_id"), F.size("words").alias("dl"), F.explode("words").alias("token")).groupBy("query_id", "dl", "token").agg(F.count("*").alias("tf"))
    idf = F.log((F.lit(float(documents)) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / float(mean_length or 1)))
    return words.join(probes, ["query_id", "token"]).join(df, "token").groupBy("query_id").agg(F.sum(idf * part).alias("score"))


def by_category(ranked: DataFrame, category: str) -> DataFrame:
    """Per category of (ids retrieved, gold, category): queries, missed ones, mean recall at 5 and mean reciprocal rank."""
    found = F.size(F.array_intersect("ids", "gold"))
    return ranked.groupBy(category).agg(
        F.count("*").alias("queries"), F.round(F.avg((found == 0).cast("double")), 6).alias("miss_rate"),
        F.round(F.avg(recall_at(F.col("ids"), F.col("gold"), 5)), 6).alias("recall_at_5"), F.round(F.avg(reciprocal_rank(F.col("ids"), F.col("gold"))), 6).alias("mrr"),
    )


def audit(observations: DataFrame) -> DataFrame:
    """Per scenario of (scenario, concept_id, gold): gold observations, the concepts that hold them, those that also hold background, and whether gold ones fell together."""
    c = observations.groupBy("scenario", "concept_id").agg(F.count_if("gold").alias("gold"), F.count_if(~F.col("gold")).alias("other")).where("gold > 0")
    return c.groupBy("scenario").agg(F.sum("gold").alias("gold"), F.count("*").alias("concepts"), F.count_if(F.col("other") > 0).alias("merged"), (F.count("*") < F.sum("gold")).alias("collapsed"))


def signal_accuracy(scores: DataFrame, signals: list[str]) -> DataFrame:
    """How often each signal's best concept (ties to the smaller) is the home, over (query_id, concept_id, home, signals)."""
    best = scores.groupBy("query_id", "home").agg(*(F.max(F.struct(F.round(s, 9), (-F.col("concept_id")).alias("c"))).alias(s) for s in signals))
    one = F.explode(F.array(*(F.struct(F.lit(s).alias("signal"), (-F.col(s)["c"] == F.col("home")).alias("right")) for s in signals)))
    return best.select(one.alias("x")).groupBy("x.signal").agg(F.count("*").alias("queries"), F.round(F.avg(F.col("x.right").cast("double")), 6).alias("accuracy"))


def band_sweep(pairs: DataFrame, nodes: DataFrame, floors: list[float]) -> DataFrame:
    """Per floor over scored pairs (a < b): pairs linked, the largest degree, and nodes (node) left alone."""
    linked = pairs.select("a", "b", "score", F.explode(F.array(*map(F.lit, floors))).alias("floor")).where("score >= floor")
    ends = linked.select("floor", F.explode(F.array("a", "b")).alias("node")).groupBy("floor", "node").agg(F.count("*").alias("degree"))
    d = ends.groupBy("floor").agg((F.sum("degree") / 2).cast("long").alias("pairs"), F.max("degree").alias("max_degree"), F.count("*").alias("joined"))
    return d.crossJoin(nodes.agg(F.count("*").alias("n"))).select("floor", "pairs", "max_degree", (F.col("n") - F.col("joined")).alias("isolated"))


def floor_calibration(scores: DataFrame, floors: list[float]) -> DataFrame:
    """Per floor over (group, score): the share of gold kept, and of junk and other cards dropped."""
    t = scores.select("group", "score", F.explode(F.array(*map(F.lit, floors))).alias("floor"))
    share = lambda g, kept: F.round(F.avg(F.when(F.col("group") == g, (F.col("score") >= F.col("floor") if kept else F.col("score") < F.col("floor")).cast("double"))), 6)
    return t.groupBy("floor").agg(share("gold", True).alias("gold_kept"), share("other", False).alias("other_dropped"), share("junk", False).alias("junk_dropped"))


def quotas(sizes: DataFrame, total: int) -> DataFrame:
    """(stratum, size, quota): a sample of `total` dealt by size with largest remainders, none over its stratum's size.

    Strata are few (they come to one task). What a full stratum can't take is dealt again among the others.
    """
    rows = [(r["stratum"], r["size"]) for r in sizes.select("stratum", "size").collect()]
    got = dict.fromkeys((s for s, _ in rows), 0)
    room, left = dict(rows), min(total, sum(n for _, n in rows))
    while left > 0:
        open_ = [s for s in room if got[s] < room[s]]
        whole = sum(room[s] for s in open_)
        exact = {s: left * room[s] / whole for s in open_}
        give = {s: min(int(exact[s]), room[s] - got[s]) for s in open_}
        rest = left - sum(give.values())
        for s in sorted(open_, key=lambda s: (-(exact[s] - int(exact[s])), s)):
            if rest and got[s] + give[s] < room[s]:
                give[s], rest = give[s] + 1, rest - 1
        for s, n in give.items():
            got[s] += n
        left = rest
    return sizes.sparkSession.createDataFrame([(s, room[s], got[s]) for s in room], sizes.select("stratum", "size", F.lit(0).cast("long").alias("quota")).schema)


def pin_verdict(population: DataFrame, width: int) -> DataFrame:
    """What a pinned width makes of a population (one row: scored, malformed, least_width, most_width)."""
    w = F.when(F.col("scored") == 0, "empty").when(F.col("malformed") > 0, "malformed").when(F.col("least_width") != F.col("most_width"), "mixed").when(F.col("most_width") != width, "other-width")
    return population.select("scored", "malformed", F.coalesce(w, F.lit("sound")).alias("verdict"))


def population(rows: DataFrame, first: int = 20) -> DataFrame:
    """One row on (id, embedding): live rows, scored, zero ones, the widths of whole vectors, malformed ones (null, or with a null or not finite component) and the first ids of those."""
    sound = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    t = rows.select("id", F.coalesce(sound, F.lit(False)).alias("sound"), F.forall("embedding", lambda x: x == 0).alias("zero"), F.size("embedding").alias("width"))
    good = F.col("sound")
    widths = F.array_join(F.array_sort(F.collect_set(F.when(good, F.col("width")))), ",")
    whole = t.agg(F.count("*").alias("live"), F.count_if(good & ~F.col("zero")).alias("scored"), F.count_if(good & F.col("zero")).alias("zero"), widths.alias("widths"), F.count_if(~good).alias("malformed"))
    few = t.where(~good).orderBy("id").limit(first).agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("first_malformed"))
    return whole.crossJoin(few)
