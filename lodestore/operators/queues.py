"""Capped lists that tell exactly how much they leave out, and the overview made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestore.operators import ranking
from lodestore.operators.retrieval import live


def capped(rows: DataFrame, by: list[str], order: list[Column | str], cap: int) -> DataFrame:
    """The first `cap` rows of each group, with their place and how many more the group has.

    Spark keeps the best `cap` rows of a group before the shuffle where the window's filter allows; the exact count is
    a sum of its own, combined on the map side.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    first = rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= cap)
    total = rows.groupBy(*by).agg(F.count("*").alias("total"))
    return first.join(total, by).withColumn("omitted", F.greatest(F.col("total") - cap, F.lit(0))).drop("total")


def contradictions(observations: DataFrame) -> DataFrame:
    """Corrections of concepts that held something before: (concept_id, observation_id, opened_at, priors, contradicted).

    Priors are live statements from strictly before the correction. Only a single one is named as contradicted. A
    correction that comes first founds its concept and contradicts nothing.
    """
    w = Window.partitionBy("concept_id").orderBy("created_at").rangeBetween(Window.unboundedPreceding, -1)
    said = (F.col("kind") == "statement") & F.col("superseded_by").isNull()
    t = observations.withColumn("priors", F.count_if(said).over(w)).withColumn("last", F.max(F.when(said, F.struct("created_at", "observation_id"))).over(w))
    t = t.where((F.col("kind") == "correction") & (F.col("priors") > 0))
    return t.select("concept_id", "observation_id", F.col("created_at").alias("opened_at"), "priors", F.when(F.col("priors") == 1, F.col("last.observation_id")).alias("contradicted"))


def resolved(open_: DataFrame, action: Column, body: Column) -> DataFrame:
    """What becomes of contradictions by accept-new, keep-current or dismiss.

    accept-new supersedes the single prior; where there are several it needs a body and is refused without one.
    keep-current supersedes the correction. The first two rouse the concept by one.
    """
    t = open_.withColumn("action", action)
    refused = (F.col("action") == "accept-new") & (F.col("priors") > 1) & body.isNull()
    loser = F.when(F.col("action") == "accept-new", F.col("contradicted")).when(F.col("action") == "keep-current", F.col("observation_id"))
    return t.select("concept_id", "observation_id", "action", F.when(refused, "refused").when(F.col("action") == "dismiss", "dismissed").otherwise("resolved").alias("status"), F.when(~refused, loser).alias("superseded"), F.when(~refused & (F.col("action") != "dismiss"), 1).otherwise(0).alias("arousal_gain"))


def disputed(concepts: DataFrame, open_: DataFrame, decay: float, arousal: int = 3) -> DataFrame:
    """Concepts with open contradictions: disputed, less trusted by `decay` for each (a parameter: the reference value is unknown), roused on each."""
    n = open_.groupBy("concept_id").agg(F.count("*").alias("open"))
    return concepts.join(n, "concept_id").select("concept_id", F.lit("disputed").alias("status"), (F.col("confidence") * F.pow(F.lit(decay), F.col("open"))).alias("confidence"), (F.col("open") * arousal).alias("arousal_gain"), "open")


def duplicates(edges: DataFrame, dismissed: DataFrame) -> DataFrame:
    """(a, b, weight): possible duplicates once a pair, by their largest weight; a dismissed pair stays away however often it is found again."""
    pair = [F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")]
    found = edges.groupBy(*pair).agg(F.max("weight").alias("weight"))
    return found.join(dismissed.select(*pair).distinct(), ["a", "b"], "left_anti")


def dirty(concepts: DataFrame, observations: DataFrame, synthesised: DataFrame) -> DataFrame:
    """Concepts to synthesise: marked dirty, or with evidence newer than their last synthesis (concept_id, at)."""
    newest = live(observations).groupBy("concept_id").agg(F.max("created_at").alias("newest"))
    t = concepts.where("status <> 'retired'").join(newest, "concept_id", "left").join(synthesised.select("concept_id", "at"), "concept_id", "left")
    return t.where(F.col("dirty") | (F.col("newest") > F.coalesce("at", F.lit(-1)))).select("concept_id", "circle", "newest")


def overview(concepts: DataFrame, observations: DataFrame, pairs: DataFrame, now_ms: int, stale_ms: int, caps: dict[str, int]) -> dict[str, DataFrame]:
    """The sections of each circle's overview: (circle, concept_id, value, place, omitted), never a body.

    living: by decayed confidence, stale concepts left out; duplicates, the surest first; contradictions, the oldest
    first; dirty and stale ones by id. Workstreams and retired concepts are in none.
    """
    seen = concepts.where("status <> 'retired' and kind <> 'workstream'")
    last = live(observations).groupBy("concept_id").agg(F.max("created_at").alias("confirmed"), F.count("*").alias("support"))
    t = seen.join(last, "concept_id", "left")
    old = ranking.stale(F.col("confirmed"), F.lit(now_ms), stale_ms)
    score = F.col("confidence") * F.exp(-(F.lit(now_ms) - F.col("confirmed")) / (ranking.CONFIRM_DAYS * ranking.DAY_MS))
    where = seen.select("concept_id", "circle")
    rows = {
        "living": (t.where(~old).withColumn("value", F.round(F.log(score), 6)), [F.col("value").desc_nulls_last(), "concept_id"]),
        "duplicates": (pairs.join(where, pairs.a == where.concept_id).withColumn("value", F.round("weight", 6)), [F.col("value").desc(), "a", "b"]),
        "contradictions": (contradictions(observations).join(where, "concept_id").withColumn("value", F.col("opened_at").cast("double")), ["opened_at", "observation_id"]),
        "dirty": (t.where("dirty").withColumn("value", F.col("support").cast("double")), ["concept_id"]),
        "stale": (t.where(old).withColumn("value", F.col("confirmed").cast("double")), ["confirmed", "concept_id"]),
    }
    return {name: capped(r, ["circle"], order, caps[name]).select("circle", "concept_id", "value", "place", "omitted") for name, (r, order) in rows.items()}


#: What an overview that is too large drops, one rung after the other; the skeleton's contents are clipped last.
DROPS = (("dirty", "stale"), ("duplicates",), ("living",), ("contradictions",), ("retirement", "denies", "unread"))


def fitted(rows: DataFrame, budget: int, drops: tuple[tuple[str, ...], ...] = DROPS, clipped: str = "skeleton") -> tuple[DataFrame, DataFrame]:
    """Each circle's overview within `budget` characters, from its sections' rows (circle, section, place, text).

    The first table has (circle, chars, rungs, most, dropped, fits): the size as it was, how many rungs of `drops` it
    takes until the rest fits, the length to which texts of the `clipped` section are then halved (null if they stay; an
    ellipsis stands for what is gone, and at last nothing), the rows dropped, and whether that was enough. The second
    has the rows that stay. Only sizes are aggregated; a circle's clipped section is bounded, as the sections are.
    """
    rung = F.lit(0)
    for i, names in enumerate(drops, 1):
        rung = F.when(F.col("section").isin(*names), i).otherwise(rung)
    t = rows.withColumns({"chars": F.coalesce(F.length("text"), F.lit(0)), "rung": rung})
    parts = [F.sum(F.when(F.col("rung") == i, F.col("chars")).otherwise(0)) for i in range(len(drops) + 1)]
    counts = [F.count_if(F.col("rung") == i) for i in range(len(drops) + 1)]
    c = t.groupBy("circle").agg(F.sum("chars").alias("chars"), F.array(*parts).alias("parts"), F.array(*counts).alias("counts"), F.collect_list(F.when(F.col("section") == clipped, F.col("chars"))).alias("lengths"))
    gone = lambda k: F.aggregate(F.slice("parts", F.lit(2), k), F.lit(0).cast("long"), lambda x, y: x + y)
    enough = F.filter(F.sequence(F.lit(0), F.lit(len(drops))), lambda k: F.col("chars") - gone(k) <= budget)
    c = c.withColumn("rungs", F.coalesce(F.get(enough, F.lit(0)), F.lit(len(drops)))).withColumn("left", F.col("chars") - gone(F.col("rungs")))
    at = lambda most: F.aggregate("lengths", F.lit(0).cast("long"), lambda x, n: x + F.when(n <= most, n).otherwise(F.greatest(most, F.lit(1))))
    bare = F.col("left") - F.aggregate("lengths", F.lit(0).cast("long"), lambda x, n: x + n)
    halves = F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.floor(F.array_max("lengths") / F.pow(F.lit(2), i)).cast("int"))
    fits = F.get(F.filter(halves, lambda m: bare + at(m) <= budget), F.lit(0))
    over = F.col("left") > budget
    c = c.withColumn("most", F.when(over & (F.size("lengths") > 0), F.coalesce(fits, F.lit(-1)))).withColumn("fits", ~over | F.coalesce(F.when(F.col("most") >= 0, F.lit(True)).otherwise(bare <= budget), F.lit(False)))
    dropped = F.aggregate(F.slice("counts", F.lit(2), F.col("rungs")), F.lit(0).cast("long"), lambda x, y: x + y)
    told = c.select("circle", "chars", "rungs", "most", dropped.alias("dropped"), "fits")
    kept = t.join(told.select("circle", "rungs", "most"), "circle").where("rung = 0 or rung > rungs")
    short = F.when((F.col("section") != clipped) | F.col("most").isNull() | (F.col("chars") <= F.col("most")), F.col("text")).when(F.col("most") < 0, "").otherwise(F.concat(F.substring(F.col("text"), F.lit(1), F.greatest(F.col("most") - 1, F.lit(0))), F.lit("…")))
    return told, kept.select("circle", "section", "place", short.alias("text"))
