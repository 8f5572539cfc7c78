"""Making a store fit to publish: scrubbed texts and slugs, references that follow, entities that still stand in the texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestore.functions import text as T
from lodestore.staging import stage


#: The length of a slug, and of the part of an id that tells equal slugs of a circle apart.
SLUG_CHARS, ID_CHARS = 60, 8


def renamed_slugs(concepts: DataFrame) -> DataFrame:
    """(concept_id, circle, old, new) of concepts (concept_id, circle, slug): slugs without what may not be published, no two of a circle alike.

    In order of id the first concept of a slug keeps it; the others have the start of their id behind, within
    SLUG_CHARS, and so has a first one whose slug was given so to a concept before it. First ones are found by a
    minimum, without a window over a slug that many share; the last rule by joins until none clashes.
    """
    t = stage(concepts.select("concept_id", "circle", F.col("slug").alias("old"), T.slug(T.redact(F.col("slug"), skip=(T.SECRETS,))).alias("base")), "slugs")
    lead = t.groupBy("circle", "base").agg(F.min("concept_id").alias("lead"))
    cut = F.regexp_replace(F.substring("base", 1, SLUG_CHARS - ID_CHARS - 1), "-+$", "")
    longer = F.regexp_replace(F.concat(cut, F.lit("-"), F.substring(F.col("concept_id").cast("string"), 1, ID_CHARS)), "^-+", "")
    t = stage(t.join(lead, ["circle", "base"]).withColumn("longer", longer).withColumn("plain", F.col("concept_id") == F.col("lead")).drop("lead"), "slugs")
    while True:
        given = t.where("not plain").groupBy("circle", F.col("longer").alias("base")).agg(F.min("concept_id").alias("before"))
        clash = stage(t.where("plain").join(given, ["circle", "base"]).where("before < concept_id").select("concept_id", F.lit(True).alias("clash")), "clashes")
        if clash.isEmpty():
            break
        t = stage(t.join(clash, "concept_id", "left").withColumn("plain", F.col("plain") & F.col("clash").isNull()).drop("clash"), "slugs")
    return t.select("concept_id", "circle", "old", F.when(F.col("plain"), F.col("base")).otherwise(F.col("longer")).alias("new"))


def rewritten(concepts: DataFrame, names: DataFrame) -> DataFrame:
    """(concept_id, body): bodies scrubbed, with references (of the first concept of a slug) under its new slug.

    References are joined by slug; a body meets only the names that it refers to.
    """
    first = names.groupBy("old").agg(F.min_by("new", "concept_id").alias("new")).where("old <> new")
    asked = concepts.select("concept_id", F.explode(T.references(F.col("body"))).alias("r")).select("concept_id", F.col("r.slug").alias("old")).distinct()
    found = asked.join(first, "old").groupBy("concept_id").agg(F.map_from_entries(F.collect_list(F.struct("old", "new"))).alias("names"))
    t = concepts.join(found, "concept_id", "left")
    return t.select("concept_id", T.redact(T.renamed_references(F.col("body"), F.coalesce("names", F.create_map().cast("map<string,string>")))).alias("body"))


def _words(text) -> Column:
    """A text's runs of letters, digits and marks in lower case, a blank around each."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}\\p{M}]+", " "), F.lit(" "))


def kept_entities(memberships: DataFrame, bodies: DataFrame) -> DataFrame:
    """Memberships (concept_id, kind, key) whose key still stands in the scrubbed body as whole words, with their new document frequency."""
    key = F.regexp_replace(F.concat(F.lit(" "), F.trim(_words(F.col("key"))), F.lit(" ")), "^ +$", "")
    t = memberships.join(bodies, "concept_id").where(F.contains(_words(F.col("body")), key) & (key != "")).drop("body")
    return t.join(t.groupBy("kind", "key").agg(F.count_distinct("concept_id").alias("df")), ["kind", "key"])


def published(concepts: DataFrame, revisions: DataFrame, edges: DataFrame, memberships: DataFrame) -> dict[str, DataFrame]:
    """The store to publish: concepts with new slugs and bodies, entities that these still hold, edges (src, dst) between published concepts, and no revisions: they keep what bodies were scrubbed of."""
    names = stage(renamed_slugs(concepts), "names")
    bodies = stage(rewritten(concepts, names), "bodies")
    told = concepts.drop("slug", "body").join(names.select("concept_id", F.col("new").alias("slug")), "concept_id").join(bodies, "concept_id")
    ends = lambda side: concepts.select(F.col("concept_id").alias(side))
    return {"concepts": told, "revisions": revisions.limit(0), "edges": edges.join(ends("src"), "src", "left_semi").join(ends("dst"), "dst", "left_semi"), "entities": kept_entities(memberships, bodies)}


def purged(tables: dict[str, tuple[DataFrame, list[str]]], doomed: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Every table (with the columns that hold concept ids) without the rows that name a doomed concept, and how many each lost and keeps."""
    kept, report = {}, None
    for name, (t, keys) in tables.items():
        left = t
        for k in keys:
            left = left.join(doomed.select(F.col("concept_id").alias(k)), k, "left_anti")
        kept[name] = left.select(*t.columns)
        row = t.agg(F.count("*").alias("was")).crossJoin(left.agg(F.count("*").alias("kept"))).select(F.lit(name).alias("table"), (F.col("was") - F.col("kept")).alias("purged"), "kept")
        report = row if report is None else report.union(row)
    return kept, report
