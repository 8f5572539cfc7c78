"""Line-first quality rules in DataFrame functions only: drop failing lines, then reject documents that lose too much."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: A document goes if its kept lines hold less than this share (in hundredths) of the characters in its words.
LEAST_KEPT = 50
#: Phrases of site furniture; a line of at most BOILERPLATE_WORDS words that holds one is dropped.
BOILERPLATE = "all rights reserved|terms of (use|service)|privacy policy|cookie policy|use cookies|enable javascript|lorem ipsum|click here|sign up|log in|subscribe to|follow us|share this|skip to content|powered by"
BOILERPLATE_WORDS = 12
#: A sentence of any script may end so, with closing quotes or brackets after it; the line's last CLOSE characters are looked at.
CLOSE = 12
TERMINAL = "[.!?…:;。！？：；｡।॥؟؛۔։።፧។៕။།]['\"\\p{Pe}\\p{Pf}]*$"


def _ink(text: Column) -> Column:
    """Characters (code points) that stand in words."""
    return F.length(F.translate(text, BLANKS, ""))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")


def _measured(line: Column) -> Column:
    return F.struct(line.alias("line"), F.size(_words(line)).alias("n"), _ink(line).alias("ink"))


def line_passes(x: Column) -> Column:
    """True for a line (measured: line, n words, ink) that breaks no rule.

    navigation: three bars or more, and one for four words at least; symbols: over a tenth of its characters are of
    #*$%&|<>; shouting: three words or more, two capital letters at least and no small one; boilerplate: a short line
    with a furniture phrase; punctuation: a line of over six words ends as a sentence does.
    """
    line, n = x["line"], x["n"]
    bars = F.length(line) - F.length(F.translate(line, "|", ""))
    marks = F.length(line) - F.length(F.translate(line, SYMBOLS, ""))
    navigation = (bars >= 3) & (bars * 4 >= n)
    shouting = (n >= 3) & ~line.rlike("\\p{Ll}") & line.rlike("(?s)\\p{Lu}.*\\p{Lu}")
    furniture = (n <= BOILERPLATE_WORDS) & line.rlike(f"(?i)({BOILERPLATE})")
    unended = (n > 6) & ~F.right(F.rtrim(F.translate(line, BLANKS, " ")), F.lit(CLOSE)).rlike(TERMINAL)
    return ~((marks * 10 > x["ink"]) | navigation | unended | furniture | shouting)


def _windows(words: Column) -> Column:
    """A 64-bit hash of each five consecutive words, by the window's first word."""
    n = F.size(words)

    def at(i: Column) -> list[Column]:
        return [F.get(words, i + j) for j in range(5)]

    return F.when(n >= 5, F.transform(F.sequence(F.lit(0), F.greatest(n - 5, F.lit(0))), lambda i: F.xxhash64(*at(i)))).otherwise(F.array().cast("array<long>"))


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text, the counts, base_failed, kept and cleaned (the lines left, joined by \\n).

    A line that stands in the document again counts as lost after its first time, as furniture does that a page
    repeats; blank lines go as well.

    Null and empty texts count as no words and fail. Very long texts are handled whole in their row: every step is
    linear in the text but one sort of its 5-word windows, run only for texts that repeat one. Repeated rows give
    repeated results; other columns are not read, whatever their names.
    """
    t = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    t = t.select("doc_id", "text", "row", _words(F.col("text")).alias("words"), F.filter(F.split("text", "\n"), lambda x: _ink(x) > 0).alias("lines"))
    t = t.select(
        "doc_id",
        "text",
        "row",
        F.size("words").cast("long").alias("n_words"),
        _ink(F.col("text")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _windows(F.col("words")).alias("spans"),
        F.filter(F.transform(F.array_distinct("lines"), _measured), line_passes).alias("good"),
    )
    # positions of windows that repeat: sorted by (hash, place), those with an equal neighbour
    pairs = F.when(F.size("spans") > F.size(F.array_distinct("spans")), F.sort_array(F.transform("spans", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    t = t.withColumn("pairs", pairs).drop("spans")
    twin = lambda x, i: F.coalesce((F.get("pairs", i - 1)["h"] == x["h"]) | (F.get("pairs", i + 1)["h"] == x["h"]), F.lit(False))
    hits = F.sort_array(F.transform(F.filter("pairs", twin), lambda x: x["i"]))
    t = t.withColumn("hits", hits).drop("pairs")
    covered = F.aggregate("hits", F.struct(F.lit(0).alias("n"), F.lit(-5).alias("end")), lambda a, i: F.struct((a["n"] + F.least(F.lit(5), i - a["end"])).alias("n"), i.alias("end")), lambda a: a["n"])
    # a filter on what follows mustn't be pushed below these steps: each uses the last several times, so inlined they'd grow without end
    t = t.withColumns({"n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"), "place": F.monotonically_increasing_id()}).drop("hits")
    ink = F.aggregate("good", F.lit(0), lambda a, x: a + x["ink"])
    t = t.withColumn("base_failed", (F.col("place") < 0) | (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)).drop("place")
    t = t.withColumn("kept", ~F.col("base_failed") & (ink * 100 >= F.col("word_chars") * LEAST_KEPT))
    return t.withColumn("cleaned", F.array_join(F.transform("good", lambda x: x["line"]), "\n")).drop("good")


def op6_rules(spark, sf_dir: str) -> DataFrame:
    out = assess(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _duck(expr: str) -> str:
    """The expression's count of characters outside blanks."""
    return f"length(translate({expr}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))"


OP6_SQL = rf"""
with t as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: {_duck('l')} > 0) as lines
  from documents
), win as (
  select doc_id, text, words, lines, case when len(words) >= 5 then list_transform(range(1, len(words) - 3), lambda i: array_to_string(list_slice(words, i, i + 4), ' ')) else [] end as spans from t
), hit as (
  select doc_id, words, w.i, count(*) over (partition by doc_id, w.s) as n
  from win, unnest(list_transform(spans, lambda s, i: struct_pack(s := s, i := i))) as u(w)
), rep as (
  select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest(range(i, i + 5)) as p from hit where n > 1) group by 1
), line as (
  select doc_id, l, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) as n, length(l) - length(translate(l, '|', '')) as bars,
    length(l) - length(translate(l, '{SYMBOLS}', '')) as marks, {_duck('l')} as ink
  from (select doc_id, unnest(list_distinct(lines)) as l from t)
), good as (
  select doc_id, sum(ink) as ink from line
  where not ((bars >= 3 and bars * 4 >= n) or marks * 10 > ink or (n >= 3 and regexp_matches(l, '(?s)\p{{Lu}}.*\p{{Lu}}') and not regexp_matches(l, '\p{{Ll}}'))
    or (n <= {BOILERPLATE_WORDS} and regexp_matches(l, '(?i)({BOILERPLATE})')) or (n > 6 and not regexp_matches(right(rtrim(translate(l, chr(9) || chr(11) || chr(12) || chr(13), '    ')), {CLOSE}), '{TERMINAL.replace("'", "''")}')))
  group by 1
), a as (
  select t.doc_id, len(words)::bigint as n_words, {_duck('text')}::bigint as word_chars, (length(text) - length(translate(text, '{SYMBOLS}', '')))::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(rep.n_repeat_words, 0)::bigint as n_repeat_words, coalesce(good.ink, 0) as ink
  from t left join rep using (doc_id) left join good using (doc_id)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and ink * 100 >= word_chars * {LEAST_KEPT} as kept
from a
"""
