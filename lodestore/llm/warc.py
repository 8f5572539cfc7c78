"""WARC records, and a Merkle audit that finds where two replicas of an archive differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestore.plans.staging import stage

#: Page ids of one archive file, and children of a tree node.
ARCHIVE_IDS, FANOUT = 1000, 16
#: Equal records of one id that are placed at once.
COPIES = 10_000


def record(page_id: Column, url: Column, html: Column) -> Column:
    """The bytes of one WARC response record, as text."""
    body = F.coalesce(html, F.lit(""))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), page_id.cast("string"), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")))
    return F.concat(head, F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def leaves(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, archive, place, start, end, digest): records in id order in archive files, with their byte ranges.

    A record is hashed where it is read, whatever its length; only digests and lengths are shuffled. Rows with a null id
    go to an archive of their own, -1; rows of one id are ordered by digest; null urls and pages are empty. Other
    columns aren't read, and a table without rows has no record. Equal records of an id are counted before they are
    placed. Places and ranges are running sums over an archive's (id, first digits of the digest), and inside each of
    those: so an id, or the lack of one, that a third of all rows share is spread over 256 parts.
    """
    t = pages.select(F.col(id_col).cast("long").alias("page_id"), record(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(url_col), F.col(html_col)).alias("r"))
    t = t.select("page_id", F.coalesce(F.floor(F.col("page_id") / ARCHIVE_IDS), F.lit(-1)).alias("archive"), F.octet_length("r").cast("long").alias("size"), F.sha2(F.col("r").cast("binary"), 256).alias("digest"))
    keys = ["archive", "page", "part"]
    one = t.groupBy("archive", F.coalesce("page_id", F.lit(0)).alias("page"), F.substring("digest", 1, 2).alias("part"), "digest").agg(F.max("page_id").alias("page_id"), F.max("size").alias("size"), F.count("*").alias("n"))
    one = stage(one, "records")
    bytes_ = F.col("size") * F.col("n")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts, inside = before(Window.partitionBy("archive").orderBy("page", "part")), before(Window.partitionBy(*keys).orderBy("digest"))
    sums = one.groupBy(*keys).agg(F.sum(bytes_).alias("b"), F.sum("n").alias("r"))
    sums = sums.select(*keys, F.coalesce(F.sum("b").over(parts), F.lit(0)).alias("b"), F.coalesce(F.sum("r").over(parts), F.lit(0)).alias("r"))
    t = one.withColumn("start", F.coalesce(F.sum(bytes_).over(inside), F.lit(0))).withColumn("place", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(sums, keys)
    t = t.select("page_id", "archive", (F.col("r") + F.col("place")).alias("place"), (F.col("b") + F.col("start")).alias("start"), "size", "digest", "n")
    run = t.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))))
    run = run.where(F.col("n") <= COPIES).union(run.where(F.col("n") > COPIES).repartition("c"))  # copies of one record are made by many tasks
    each = run.withColumn("k", F.explode(F.sequence(F.col("c") * COPIES, F.least(F.col("n"), (F.col("c") + 1) * COPIES) - 1)))
    start = F.col("start") + F.col("k") * F.col("size")
    return each.select("page_id", "archive", (F.col("place") + F.col("k")).alias("place"), start.alias("start"), (start + F.col("size")).alias("end"), "digest")


def parents(nodes: DataFrame) -> DataFrame:
    """The level above: a node hashes its children's digests and ranges in order."""
    child = F.concat_ws(":", "digest", "start", "end")
    made = nodes.groupBy("archive", F.floor(F.col("place") / FANOUT).alias("up")).agg(
        F.array_sort(F.collect_list(F.struct("place", child.alias("c")))).alias("cs"), F.min("start").alias("start"), F.max("end").alias("end")
    )
    return made.select("archive", F.col("up").alias("place"), "start", "end", F.sha2(F.array_join(F.transform("cs", lambda x: x["c"]), "|").cast("binary"), 256).alias("digest"))


def tree(level: DataFrame) -> list[DataFrame]:
    """Levels from records up to one node an archive, each above the first staged for the next and for the audit."""
    most = level.agg(F.max("place")).first()[0] or 0
    out = [level.select("archive", "place", "start", "end", "digest")]
    while most:
        out.append(stage(parents(out[-1]), "level"))
        most //= FANOUT
    return out


def _differ(a: DataFrame, b: DataFrame) -> DataFrame:
    b = b.select("archive", "place", F.struct("start", "end", "digest").alias("b"))
    a = a.select("archive", "place", F.struct("start", "end", "digest").alias("a"))
    return a.join(b, ["archive", "place"], "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("archive", "place")


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """(archive, place) of records of leaves() tables that are changed, moved or missing between replicas a and b.

    Roots are compared first; below, only children of nodes that differ are compared. Equal or empty replicas give no rows.
    """
    one, two = tree(a), tree(b)
    while len(one) < len(two):
        one.append(parents(one[-1]))
    while len(two) < len(one):
        two.append(parents(two[-1]))
    off = _differ(one[-1], two[-1])
    for x, y in zip(one[-2::-1], two[-2::-1], strict=True):
        branch = off.select("archive", F.col("place").alias("up"))
        up = F.floor(F.col("place") / FANOUT)
        x, y = (t.withColumn("up", up).join(branch, ["archive", "up"], "left_semi") for t in (x, y))
        off = _differ(x, y)
    return off


def op2_warc(spark, sf_dir: str) -> DataFrame:
    """Audits all pages' records against a replica in which some pages end in another byte: those whose length leaves 7 by 101."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    worn = F.when(F.length("html") % 101 == 7, F.regexp_replace("html", "[ -}]$", "~")).otherwise(F.col("html"))
    a, b = stage(leaves(pages), "leaves"), stage(leaves(pages.withColumn("html", worn)), "leaves")
    off = audit(a, b).withColumn("off", F.lit(True))
    return a.join(off, ["archive", "place"], "left").select("page_id", "archive", "start", "end", "digest", F.coalesce(~F.col("off"), F.lit(True)).alias("intact"))


def _sql_record(html: str) -> str:
    line = "chr(13) || chr(10)"
    return (
        f"'WARC/1.0' || {line} || 'WARC-Type: response' || {line} || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::varchar, '') || '>' || {line} || 'WARC-Target-URI: ' || coalesce(url, '')"
        f" || {line} || 'Content-Length: ' || strlen({html})::varchar || {line} || {line} || {html} || {line} || {line}"
    )


OP2_SQL = f"""
with p as (
  select page_id, url, coalesce(html, '') as html, case when length(html) % 101 = 7 then regexp_replace(html, '[ -}}]$', '~') else coalesce(html, '') end as worn from pages
), r as (
  select page_id, coalesce(floor(page_id / {ARCHIVE_IDS})::bigint, -1) as archive, {_sql_record('html')} as a, {_sql_record('worn')} as b from p
), d as (select page_id, archive, strlen(a) as size, sha256(a) as digest, a = b as intact from r
), o as (select *, (sum(size) over (partition by archive order by page_id, digest rows unbounded preceding))::bigint as stop from d)
select page_id, archive, stop - size as start, stop as "end", digest, intact from o
"""
