"""Text features as column expressions; all stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable
from unicodedata import normalize

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

#: Where a word of ASCII letters, digits and underscores begins or ends, whatever other letters stand beside it: what \\b means in the patterns.
EDGE = "(?:(?<=\\w)(?!\\w)|(?<!\\w)(?=\\w))"
FNV_SEED, FNV_PRIME, MASK = 2166136261, 16777619, 4294967295

# Redaction patterns and their replacements, in the order they apply.
REDACTIONS = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[redacted-email]"),
    (
        r"\b(sk-[A-Za-z0-9_-]{10,}|ghp_[A-Za-z0-9]{20,}|gho_[A-Za-z0-9]{20,}|ghs_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|AKIA[A-Z0-9]{12,}|xox[baprs]-[A-Za-z0-9-]{10,}|Bearer\s+[A-Za-z0-9._-]{20,})\b",
        "[redacted-secret]",
    ),
    (r"(?i)([?&](?:key|api_key|apikey|token|secret|auth)=)([A-Za-z0-9_-]{12,})", "$1[redacted-secret]"),
    (r"\bkey_[A-Za-z0-9]{10,}\b", "[redacted-secret]"),
    (
        r"(?i)\b(?:https?://)?(?:10(?:\.\d{1,3}){3}|172\.(?:1[6-9]|2\d|3[01])(?:\.\d{1,3}){2}|192\.168(?:\.\d{1,3}){2})(?::\d{1,5})?(?:/[^\s`'\"),\]]*)?,[^\S\n]*tenant[^\S\n]+[A-Za-z][A-Za-z0-9-]*",
        "[redacted-private-endpoint], tenant [redacted-tenant]",
    ),
    (r"(?i)\b(?:https?://)?(?:10(?:\.\d{1,3}){3}|172\.(?:1[6-9]|2\d|3[01])(?:\.\d{1,3}){2}|192\.168(?:\.\d{1,3}){2})(?::\d{1,5})?(?:/[^\s`'\"),\]]*)?", "[redacted-private-endpoint]"),
    (r"/Users/[^\s`'\")\]]+", "[redacted-path]"),
    (r"~/[^\s`'\")\]]*", "[redacted-path]"),
]
# End of fixed values.


def tokens(text: Column, unicode: bool = True) -> Column:
    """Words of the lower-cased text: letters, digits and spaces stay (of ASCII or of any script), all else parts words."""
    keep = "[^\\p{L}\\p{N}\\s]" if unicode else "[^a-z0-9\\s]"
    return F.array_remove(F.split(F.regexp_replace(F.lower(text), keep, " "), "\\s+"), "")


def count_tokens(text: Column, unicode: bool = True) -> Column:
    """How many words tokens() gives, counted without making them."""
    return F.regexp_count(F.lower(text), F.lit("[\\p{L}\\p{N}]+" if unicode else "[a-z0-9]+"))


def lexical_tokens(text: Column) -> Column:
    """Distinct lexical tokens: a letter or digit, then two or more of those, underscores or hyphens."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9][a-z0-9_-]{2,}"), F.lit(0)))


def fnv1a(word: Column) -> Column:
    """32-bit FNV-1a over the UTF-16 code units of a text: a character beyond the basic plane counts as its two surrogates."""

    def unit(c: Column) -> Column:
        code, over = F.ascii(c).cast("long"), F.ascii(c).cast("long") - 65536
        return F.when(over < 0, F.array(code)).otherwise(F.array(F.shiftright(over, 10) + 55296, over.bitwiseAND(F.lit(1023).cast("long")) + 56320))

    units = F.flatten(F.transform(F.filter(F.split(word, ""), lambda c: c != ""), unit))
    return F.aggregate(units, F.lit(FNV_SEED).cast("long"), lambda h, c: h.bitwiseXOR(c) * F.lit(FNV_PRIME).cast("long") % F.lit(MASK + 1).cast("long"))


def features(text: Column) -> Column:
    """Weighted features of a text: each word, and each character trigram of the word between ^ and $."""
    words = tokens(text)
    whole = F.transform(words, lambda w: F.struct(F.concat(F.lit("w:"), w).alias("name"), F.lit(1.0).alias("weight")))

    def grams(w: Column) -> Column:
        framed = F.concat(F.lit("^"), w, F.lit("$"))
        return F.transform(F.sequence(F.lit(1), F.length(framed) - 2), lambda i: F.struct(F.concat(F.lit("t:"), F.substring(framed, i, F.lit(3))).alias("name"), F.lit(0.5).alias("weight")))

    return F.concat(whole, F.flatten(F.transform(words, grams)))


#: Endings that stay, that lose es, and the shortest word that has a plural.
KEEPS, LOSES_ES, SHORTEST_PLURAL = "(us|is|os|as|ss)$", "(sses|shes|ches|xes|zes)$", 4


def singular(word: Column) -> Column:
    """A plural's singular by its ending; short words and those in us, is, os, as, ss stay."""
    return (
        F.when((F.length(word) < SHORTEST_PLURAL) | word.rlike(KEEPS), word)
        .when(word.endswith("ies"), F.regexp_replace(word, "ies$", "y"))
        .when(word.rlike(LOSES_ES), F.regexp_replace(word, "es$", ""))
        .otherwise(F.regexp_replace(word, "s$", ""))
    )


def slug(text: Column) -> Column:
    """Letters, digits and marks in lower case, all else one hyphen, at most 60 characters, of a text that is composed (see composed())."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}\\p{M}]+", "-"), "^-+|-+$", ""), 1, 60)


@F.arrow_udf(StringType())
def composed(text: pa.Array) -> pa.Array:
    """The text in lower case and in Unicode's normal form C, an Arrow batch at a time: the one step of a slug without a built-in function. Texts in ASCII are composed already."""
    plain = pc.string_is_ascii(text)
    held = [t if p or t is None else normalize("NFC", t.lower()) for t, p in zip(text.to_pylist(), plain.to_pylist(), strict=True)]
    return pc.if_else(pc.fill_null(plain, True), pc.ascii_lower(text), pa.array(held, pa.string()))


def summary(text: Column, most: int = 160) -> Column:
    """The first sentence with its blanks collapsed, cut with an ellipsis beyond `most` characters."""
    flat = F.trim(F.regexp_replace(text, "\\s+", " "))
    first = F.regexp_extract(flat, "^(.*?[.!?])( |$)", 1)
    line = F.when(first == "", flat).otherwise(first)
    return F.when(F.length(line) <= most, line).otherwise(F.concat(F.rtrim(F.substring(line, 1, most - 1)), F.lit("…")))


def foreign_share(text: Column) -> Column:
    """Share of letters that aren't Latin; 0 without letters."""
    letters = F.length(F.regexp_replace(text, "[^\\p{L}]", ""))
    latin = F.length(F.regexp_replace(text, "[^\\p{IsLatin}&&\\p{L}]", ""))
    return F.when(letters > 0, (letters - latin) / letters).otherwise(F.lit(0.0))


#: The pass for secrets by prefix, which may also meet the hyphenated words of a slug.
SECRETS = 1


def redact(text: Column, skip: tuple[int, ...] = (), own: tuple[str, ...] = ()) -> Column:
    """Addresses, secrets, private endpoints and home paths replaced, pattern by pattern; `skip` leaves passes out.

    Of a path under /Users that leads through one of the `own` directories, what starts there stays.
    """
    for name in own:
        text = F.regexp_replace(text, f"/Users/(?:[^\\s`'\\\")\\]]*?/)?({name}(?:/[^\\s`'\\\")\\]]*)?)(?=[\\s`'\\\")\\]]|$)", "$1")
    for i, (pattern, to) in enumerate(REDACTIONS):
        if i not in skip:
            text = F.regexp_replace(text, pattern.replace("\\b", EDGE), to)
    return text


def redact_nested(value: Column, kind: DataType, **how) -> Column:
    """The same value with every text in it redacted, through structs, arrays and the values of maps."""
    if isinstance(kind, StringType):
        return redact(value, **how)
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: redact_nested(x, kind.elementType, **how))
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda _, x: redact_nested(x, kind.valueType, **how))
    if isinstance(kind, StructType):
        made = F.struct(*(redact_nested(value[f.name], f.dataType, **how).alias(f.name) for f in kind))
        return F.when(value.isNotNull(), made)
    return value


#: An asserted reference, as verb, colon, optional hash and token.
ASSERTED = "(?i)\\b(resolves|supersedes|derived-from|supports|contradicts)(\\s*:\\s*)(#?)([\\p{L}\\p{N}\\p{M}_:-]+)"


def renamed_references(text: Column, names: Column) -> Column:
    """The text with asserted references under new slugs, by a map from old to new.

    The text is split at its references and put together again with each token looked up once, so that a new name isn't
    renamed in turn; tokens that the map lacks stay, as does all else.
    """
    pattern = ASSERTED.replace("\\b", EDGE)
    group = lambda i: F.regexp_extract_all(text, F.lit(pattern), F.lit(i))
    between = F.split(text, pattern, -1)
    both = lambda a, b: F.concat(a, b)
    found = F.zip_with(F.zip_with(group(1), group(2), both), F.zip_with(group(3), group(4), lambda h, t: F.concat(h, F.coalesce(F.try_element_at(names, t), t))), both)
    return F.array_join(F.zip_with(between, found, lambda x, r: F.concat(x, F.coalesce(r, F.lit("")))), "")


def references(text: Column) -> Column:
    """Asserted references `relation: #slug` as an array of (relation, slug)."""
    group = lambda i: F.regexp_extract_all(text, F.lit(ASSERTED.replace("\\b", EDGE)), F.lit(i))
    return F.arrays_zip(F.transform(group(1), F.lower).alias("relation"), group(4).alias("slug"))


#: Fixed value: a span's address, as host, session and anchor.
SPAN = "^span://([a-z0-9][a-z0-9.-]*)/([^/#]+)#([^#]+)$"


def span_parts(uri: Column) -> Column:
    """(host, session, anchor) of a canonical `span://host/session#anchor`; null for anything else."""
    pattern = SPAN
    raw = F.struct(*(F.regexp_extract(uri, pattern, i).alias(n) for i, n in ((1, "host"), (2, "session"), (3, "anchor"))))

    def decoded(c: Column) -> Column:
        return F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))

    def encoded(c: Column) -> Column:
        out = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
        for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
            out = F.replace(out, F.lit(code), F.lit(char))
        return out

    session, anchor = decoded(raw["session"]), decoded(raw["anchor"])
    sound = uri.rlike(pattern) & (encoded(session) == raw["session"]) & (encoded(anchor) == raw["anchor"])
    return F.when(sound, F.struct(raw["host"].alias("host"), session.alias("session"), anchor.alias("anchor")))


def line_range(anchor: Column) -> Column:
    """(start, end) of an anchor `L1-L9`; null where it isn't one or runs backwards."""
    start, end = (F.try_to_number(F.nullif(F.regexp_extract(anchor, "^L(\\d{1,15})-L(\\d{1,15})$", i), F.lit("")), F.lit("9" * 15)).cast("long") for i in (1, 2))
    return F.when((start >= 1) & (end >= start), F.struct(start.alias("start"), end.alias("end")))


def rendered(action: Column, most: int = 2048) -> Column:
    """Digest, clipped rendering, length and whether it was clipped; all null for a null action."""
    return F.when(action.isNotNull(), F.struct(F.sha2(action, 256).alias("sha256"), F.substring(action, 1, most).alias("rendering"), F.length(action).alias("chars"), (F.length(action) > most).alias("clipped")))


def circle_of(path: Column) -> Column:
    """A namespace from a path: its last part and eight hex digits of the path's digest."""
    return F.concat_ws("-", F.element_at(F.split(path, "/"), -1), F.left(F.sha1(path), F.lit(8)))


def stage_name(name: Column) -> Column:
    """Blanks trimmed and collapsed, lower case."""
    return F.lower(F.trim(F.regexp_replace(name, "\\s+", " ")))


# Korean particles.
PARTICLES = [
    "으로서", "으로써", "에게서", "에서는", "이라고", "라고", "으로", "에서", "에게", "한테", "부터", "까지", "보다", "처럼", "마다", "조차", "이나", "라는", "이란", "에는",
    "은", "는", "이", "가", "을", "를", "에", "의", "와", "과", "도", "만", "랑",
]
# End of fixed values.


def without_particle(word: Column) -> Column:
    """A Hangul word without the longest particle at its end, if two syllables are left; null if it is a particle itself."""
    by_length = sorted(set(map(len, PARTICLES)), reverse=True)
    out = word
    for n in reversed(by_length):
        ends = F.right(word, F.lit(n)).isin([p for p in PARTICLES if len(p) == n]) & (F.length(word) - n >= 2)
        out = F.when(ends, F.left(word, F.length(word) - n)).otherwise(out)
    return F.when(~word.isin(PARTICLES), out)


def root(word: Column) -> Column:
    """What a noun is known by: without its particle in Hangul, else in the singular."""
    return F.when(word.rlike("^\\p{IsHangul}+$"), without_particle(word)).otherwise(singular(word))


# Names of libraries and tools.
LIBRARIES = [
    "jose", "jsonwebtoken", "pnpm", "npm", "yarn", "sqlite", "better-sqlite3", "vite", "postgres", "postgresql", "pgvector", "sqlite-vec", "drizzle", "turbo", "turborepo", "eslint", "prettier", "hono", "stripe", "fts5", "redis",
    "playwright", "vitest", "zod", "react", "nextjs", "node", "typescript", "argon2id", "bullmq", "pino", "sentry", "s3", "grafana", "opentelemetry", "codecov", "postmark", "keycloak", "minilm", "onnx", "next-intl",
]
# End of fixed values.

# Structural entity patterns, in the order they are taken out of the text.
ENTITY_PATTERNS = [
    ("path", r"\b[\w./-]*\w[\w-]*\.(?:ts|tsx|js|jsx|mjs|cjs|json|sql|md|sh|ya?ml|py|go|rs|toml|css)\b"),
    ("path", r"\b\w[\w-]*(?:/[\w.-]+)+\b"),
    ("err", r"\b(?:E[A-Z]{3,}|[A-Z][A-Z0-9]{2,}(?:_[A-Z0-9]+)+|E\d{2,})\b"),
    ("id", r"\b[A-Za-z][a-z0-9]*[A-Z]\w*\b"),
    ("id", r"\b[a-z0-9]+_[a-z0-9_]+\b"),
    ("id", r"\b[a-zA-Z_]\w*(?:\.[a-zA-Z_]\w+)+\b"),
]
# End of fixed values.


def _entities_of(surfaces: Column, kind: str, weight: int) -> Column:
    return F.transform(surfaces, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("surface"), F.lit(weight).alias("weight")))


#: A whole run of the characters that the patterns take, if it holds what at least one of them asks for: no other run has an entity, and none reaches over two.
MARKED = r"(?<![\w./-])(?=[\w./-]*?(?:[_/]|\.\w|\w[A-Z]|E\d))[\w./-]+"


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """What `then` makes of a value that is evaluated once, however often `then` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def structural(text: Column) -> tuple[Column, Column]:
    """Structural entities as (kind, surface, weight), pattern by pattern, and what is left of the text.

    The patterns read the text's marked runs alone, a line each, and each reads what the ones before it have left once.
    """

    def taken(kind: str, pattern: str) -> Callable[[Column], Column]:
        found = lambda s: _entities_of(F.regexp_extract_all(s["rest"], F.lit(pattern), F.lit(0)), kind, 3)
        return lambda s: F.struct(F.concat(s["found"], found(s)).alias("found"), F.regexp_replace(s["rest"], pattern, " ").alias("rest"))

    runs = F.array_join(F.regexp_extract_all(text, F.lit(MARKED), F.lit(0)), "\n")
    out = F.struct(F.array().cast("array<struct<kind: string, surface: string, weight: int>>").alias("found"), runs.alias("rest"))
    for kind, pattern in ENTITY_PATTERNS:
        out = bound(out, taken(kind, pattern.replace("\\b", EDGE)))
    left = F.zip_with(F.split(text, MARKED, -1), F.split(out["rest"], "\n", -1), lambda between, run: F.concat(between, F.coalesce(run, F.lit(""))))
    return F.when(text.isNotNull(), out["found"]), F.array_join(left, "")


def entities(text: Column, stopwords: list[str] | None = None, libraries: list[str] | None = None) -> Column:
    """Entities of a text as (kind, surface, weight): structural ones, known libraries (LIBRARIES if none are given), then nouns of what is left.

    Words are runs of letters, digits and marks; scripts written without spaces aren't segmented. Stop words are the
    caller's list.
    """
    libraries = LIBRARIES if libraries is None else libraries
    structure, rest = structural(text)
    found = [structure]
    known = F.array(*map(F.lit, libraries)) if libraries else F.array().cast("array<string>")
    stop = F.array(*map(F.lit, stopwords)) if stopwords else F.array().cast("array<string>")
    libs = F.array_intersect(F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z0-9]*"), F.lit(0)), known)
    found.append(_entities_of(libs, "lib", 2))
    words = F.array_except(F.array_remove(F.split(F.lower(rest), "[^\\p{L}\\p{N}\\p{M}]+"), ""), F.concat(stop, known))
    words = F.filter(words, lambda w: (F.length(w) >= 2) & w.rlike("\\p{L}"))
    found.append(_entities_of(F.array_compact(F.transform(words, root)), "noun", 1))
    return F.array_distinct(F.concat(*found))
