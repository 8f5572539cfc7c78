"""Text feature, redaction and reference queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestore.functions import text as T
from lodestore.operators import retrieval
from lodestore.sources.tables import dealt, memberships, parts_of, read, texts

DIM = 256


def token_counts(spark, sf):
    t = texts(spark, sf)
    c = F.col("content")
    return t.select(F.col("observation_id").alias("doc_id"), T.count_tokens(c, False).alias("n_ascii"), T.count_tokens(c).alias("n_unicode"), F.size(T.lexical_tokens(c)).alias("n_lexical"))


def fnv_hashes(spark, sf):
    (p,) = read(spark, sf, "part")
    return p.select("p_partkey", T.fnv1a(F.concat(F.lit("w:"), F.col("p_name"))).alias("h"))


def hashing_embedding(spark, sf):
    """Sparse rows (p_partkey, idx, value) of the hashed, signed, unit-length feature vector of each part's name."""
    (p,) = read(spark, sf, "part")
    f = dealt(p, parts_of(p, 40), "p_partkey").select("p_partkey", F.explode(T.features(F.col("p_name"))).alias("f")).select("p_partkey", "f.weight", T.fnv1a(F.col("f.name")).alias("h"))
    v = f.groupBy("p_partkey", (F.col("h") % DIM).cast("int").alias("idx")).agg(F.sum(F.when(F.col("h") % 2 == 0, F.col("weight")).otherwise(-F.col("weight"))).alias("x"))
    norm = v.groupBy("p_partkey").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    return v.where("x <> 0").join(norm, "p_partkey").select("p_partkey", "idx", F.round(F.col("x") / F.col("n"), 6).alias("value"))


def foreign_share(spark, sf):
    return texts(spark, sf).select(F.col("observation_id").alias("doc_id"), F.round(T.foreign_share(F.col("content")), 6).alias("share"), (T.foreign_share(F.col("content")) > 0.2).alias("flagged"))


def slugs(spark, sf):
    t = texts(spark, sf)
    return t.select(F.col("observation_id").alias("doc_id"), T.slug(T.composed(F.col("content"))).alias("slug"), T.summary(F.col("content")).alias("summary"))


def redactions(spark, sf):
    t = texts(spark, sf).select(F.col("observation_id").alias("doc_id"), "content", T.redact(F.col("content")).alias("clean"))
    return t.select("doc_id", F.md5("clean").alias("digest"), (F.col("content") != F.col("clean")).alias("changed"))


def reference_edges(spark, sf):
    (p,) = read(spark, sf, "part")
    content = F.concat(F.lit("see this. Supersedes: #"), F.regexp_replace("p_name", " ", "-"), F.lit(" and derived-from:#"), F.lower(F.regexp_replace("p_brand", "#", "")))
    t = p.select("p_partkey", F.explode(T.references(content)).alias("r"))
    return t.select("p_partkey", "r.relation", "r.slug")


def span_ranges(spark, sf):
    (c,) = read(spark, sf, "customer")
    uri = F.concat(F.lit("span://host-"), F.col("c_nationkey"), F.lit("/"), F.regexp_replace("c_name", "#", "%23"), F.lit("#L"), F.col("c_nationkey"), F.lit("-L"), F.col("c_custkey"))
    t = c.select("c_custkey", T.span_parts(uri).alias("s")).select("c_custkey", "s.*")
    r = T.line_range(F.col("anchor"))
    return t.select("c_custkey", "host", "session", r["start"].alias("start_line"), r["end"].alias("end_line"))


def rendered_actions(spark, sf):
    (c,) = read(spark, sf, "conversations")
    t = c.select("conv_id", "turn", T.rendered(F.col("text"), 200).alias("r")).select("conv_id", "turn", "r.*")
    return t.select("conv_id", "turn", "sha256", F.md5("rendering").alias("rendering_md5"), "chars", "clipped")


def circles(spark, sf):
    (s,) = read(spark, sf, "supplier")
    return s.select("s_suppkey", T.circle_of(F.concat(F.lit("/work/"), F.col("s_nationkey"), F.lit("/"), F.col("s_name"))).alias("circle"), T.stage_name(F.concat(F.lit("  "), F.col("s_name"), F.lit("   Gate "))).alias("stage"))


def content_manifest(spark, sf):
    (d,) = read(spark, sf, "documents")
    return d.select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha256"), F.octet_length(F.coalesce("text", F.lit(""))).alias("bytes"))


def text_entities(spark, sf):
    """Entities by kind in the pages' addresses and their frequencies: paths, identifiers and nouns."""
    (p,) = read(spark, sf, "pages")
    e = p.select("page_id", F.explode(T.entities(F.coalesce("url", F.lit("")), ["http", "https", "com", "net", "www"], ["node", "react"])).alias("e"))
    return e.select("e.kind", "e.surface").groupBy("kind", "surface").agg(F.count("*").alias("df"))


def structural_entities(spark, sf):
    """Paths, error names and identifiers of every document with a few put before it: how many, and a digest of them in order."""
    t = texts(spark, sf).withColumn("c", F.concat(F.lit("see src/a-b.ts, éE_NOT_OK errHandler("), F.col("observation_id"), F.lit(") snake_case and a.b.c: "), F.col("content")))
    found, _ = T.structural(F.col("c"))
    e = t.select(F.col("observation_id").alias("doc_id"), F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["surface"])).alias("e"))
    return e.select("doc_id", F.size("e").cast("long").alias("n"), F.md5(F.array_join("e", "|")).alias("digest"))


def entity_df(spark, sf):
    return memberships(spark, sf).groupBy("kind", "key").agg(F.count_distinct("concept_id").alias("df"))


def token_df(spark, sf):
    """In how many sources each lexical token stands, for tokens of three sources or more."""
    ix = retrieval.token_index(texts(spark, sf))
    return ix.groupBy("token").agg(F.count_distinct("concept_id").alias("df")).where("df >= 3")


def _h(text: str) -> str:
    return f"list_reduce(list_concat([{T.FNV_SEED}::bigint], list_transform(string_split({text}, ''), lambda c: ascii(c)::bigint)), lambda h, c: (xor(h, c) * {T.FNV_PRIME}) % 4294967296)"


def _ws(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


_CONTENT = "coalesce(text, '')"


def _redacted() -> str:
    out = _CONTENT
    for pattern, to in T.REDACTIONS:
        out = f"regexp_replace({out}, '{pattern.replace(chr(39), chr(39) * 2)}', '{to.replace('$1', chr(92) + '1')}', 'g')"
    return out


def _structural_sql() -> str:
    """Each pattern's finds, and the text without them for the next."""
    step = f"select doc_id, 'see src/a-b.ts, éE_NOT_OK errHandler(' || doc_id || ') snake_case and a.b.c: ' || {_CONTENT} as c, []::varchar[] as e from documents"
    for kind, pattern in T.ENTITY_PATTERNS:
        step = f"select doc_id, regexp_replace(c, '{pattern}', ' ', 'g') as c, list_concat(e, list_transform(regexp_extract_all(c, '{pattern}'), lambda x: '{kind}:' || x)) as e from ({step})"
    return f"select doc_id, len(e) as n, md5(array_to_string(e, '|')) as digest from ({step})"


QUERIES = {f.__name__: f for f in (token_counts, fnv_hashes, hashing_embedding, foreign_share, slugs, redactions, reference_edges, span_ranges, rendered_actions, circles, content_manifest, text_entities, structural_entities, entity_df, token_df)}
ORACLE = {
    "token_counts": rf"""select doc_id, len(list_filter(regexp_split_to_array(regexp_replace(lower({_CONTENT}), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda x: x <> ''))::int as n_ascii,
  len(list_filter(regexp_split_to_array(regexp_replace(lower({_CONTENT}), '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\s+'), lambda x: x <> ''))::int as n_unicode,
  len(list_distinct(regexp_extract_all(lower({_CONTENT}), '[a-z0-9][a-z0-9_-]{{2,}}')))::int as n_lexical from documents""",
    "fnv_hashes": f"select p_partkey, {_h(chr(39) + 'w:' + chr(39) + ' || p_name')} as h from part",
    "hashing_embedding": f"""with w as (select p_partkey, unnest(string_split(p_name, ' ')) as w from part), f as (
  select p_partkey, 'w:' || w as name, 1.0::double as weight from w
  union all select p_partkey, 't:' || substr('^' || w || '$', i::int, 3), 0.5 from w, unnest(range(1, length(w) + 1)) as u(i)
), names as (select name, {_h('name')} as h from (select distinct name from f)
), v as (select p_partkey, (h % {DIM})::int as idx, sum(case when h % 2 = 0 then weight else -weight end) as x from f join names using (name) group by 1, 2
), n as (select p_partkey, sqrt(sum(x * x)) as n from v group by 1)
select p_partkey, idx, round(x / n, 6) as value from v join n using (p_partkey) where x <> 0""",
    "foreign_share": rf"""with t as (select doc_id, length(regexp_replace({_CONTENT}, '[^\p{{L}}]', '', 'g')) as l, length(regexp_replace(regexp_replace({_CONTENT}, '[^\p{{L}}]', '', 'g'), '[^\p{{Latin}}]', '', 'g')) as a from documents)
select doc_id, round(case when l > 0 then (l - a)::double / l else 0 end, 6) as share, case when l > 0 then (l - a)::double / l else 0 end > 0.2 as flagged from t""",
    "slugs": rf"""with t as (select doc_id, {_CONTENT} as c from documents), f as (select doc_id, {_ws('c')} as flat, c from t), s as (
  select doc_id, c, case when regexp_extract(flat, '^(.*?[.!?])( |$)', 1) = '' then flat else regexp_extract(flat, '^(.*?[.!?])( |$)', 1) end as line from f)
select doc_id, substr(regexp_replace(regexp_replace(nfc_normalize(lower(c)), '[^\p{{L}}\p{{N}}\p{{M}}]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) as slug,
  case when length(line) <= 160 then line else rtrim(substr(line, 1, 159)) || '…' end as summary from s""",
    "structural_entities": _structural_sql(),
    "redactions": f"with t as (select doc_id, {_CONTENT} as c, {_redacted()} as clean from documents) select doc_id, md5(clean) as digest, c <> clean as changed from t",
    "reference_edges": "select p_partkey, 'supersedes' as relation, replace(p_name, ' ', '-') as slug from part union all select p_partkey, 'derived-from', lower(replace(p_brand, '#', '')) from part",
    "span_ranges": """select c_custkey, 'host-' || c_nationkey as host, c_name as session, case when c_nationkey >= 1 and c_custkey >= c_nationkey then c_nationkey::bigint end as start_line,
  case when c_nationkey >= 1 and c_custkey >= c_nationkey then c_custkey::bigint end as end_line from customer""",
    "rendered_actions": "select conv_id, turn, sha256(text) as sha256, md5(substr(text, 1, 200)) as rendering_md5, length(text)::int as chars, length(text) > 200 as clipped from conversations",
    "circles": "select s_suppkey, s_name || '-' || left(sha1('/work/' || s_nationkey || '/' || s_name), 8) as circle, lower(s_name) || ' gate' as stage from supplier",
    "content_manifest": f"select doc_id, sha256({_CONTENT}) as sha256, strlen({_CONTENT})::int as bytes from documents",
    "entity_df": """select kind, key, count(distinct p_partkey) as df from (
  select p_partkey, 'id' as kind, p_brand || '-' || p_size as key from part union all select p_partkey, 'lib', p_brand from part union all select p_partkey, 'noun', unnest(string_split(p_name, ' ')) from part) group by 1, 2""",
    "token_df": f"select token, count(distinct source) as df from (select source, unnest(list_distinct(regexp_extract_all(lower({_CONTENT}), '[a-z0-9][a-z0-9_-]{{2,}}'))) as token from documents) group by 1 having count(distinct source) >= 3",
}
