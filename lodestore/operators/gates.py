"""Rules at stages, and which of them an action meets."""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestore.functions.text import bound
from lodestore.staging import stage

BOUNDARY, MOST_TOKENS, MOST_PATTERNS = "\n", 12, 32
_PARTS = ("&&", "||", ";", "|")


#: What a command line consists of, from left to right; what is none of the named groups parts words.
_LEXEMES = re.compile(
    r"""[ \t]+|(?P<line>[\r\n])|(?P<part>&&|\|\||[;|])|(?P<plain>(?:[^ \t\r\n;|&\\"'#]|&(?!&))+)|(?P<hash>\#)|\\(?P<joined>\r\n|[\r\n])|\\(?P<escaped>.)|"(?P<double>[^"]*)"?|'(?P<single>[^']*)'?|(?P<last>\\)""", re.DOTALL
)
_COMMENT = re.compile(r"[^\n]*")


def shell_words(command: str) -> list[str]:
    """Words of a command line in lower case: quotes and backslashes join, separators and line ends are words of their own, comments go."""
    out, word, i, n = [], None, 0, len(command)
    while i < n:
        met = _LEXEMES.match(command, i)
        kind, i = met.lastgroup, met.end()
        if kind == "hash" and word is None:
            i = _COMMENT.match(command, i).end()
        elif kind not in (None, "line", "part"):
            if kind != "joined":
                word = (word or "") + met[kind]
        else:
            if word is not None:
                out.append(word.lower())
                word = None
            if kind == "part":
                out.append(met[kind])
            elif kind and out[-1:] != [BOUNDARY]:
                out.append(BOUNDARY)
    if word is not None:
        out.append(word.lower())
    return out


def parse_actions(action: Column) -> Column:
    """(tool, tokens) of a raw action, in Arrow batches."""
    return F.pandas_udf(_parsed, "struct<tool: string, tokens: array<string>>")(action)


def _parsed(action: pd.Series) -> pd.DataFrame:
    """`Tool: command` as its tool in lower case, null if the start isn't a bare name, and its words."""
    tools, words = [], []
    for text in action.fillna(""):
        head, colon, rest = text.strip().partition(":")
        named = bool(colon) and head.replace("_", "").replace("-", "").replace(".", "").isalnum() and head[:1].isalpha()
        tools.append(head.lower() if named else None)
        words.append(shell_words(rest if named else text.strip()))
    return pd.DataFrame({"tool": tools, "tokens": words})


def seed_pattern(tokens: Column) -> Column:
    """A pattern from one action's tokens: its longest command (the first of equals) up to its last flag, else two words.

    It reaches its first plain word at least and MOST_TOKENS words at most; a command of flags alone gives none.
    The tokens are gone through once, whatever number of commands they are.
    """
    parts = F.array(*(F.lit(p) for p in (*_PARTS, BOUNDARY)))

    def longest(tokens: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(0), F.size(tokens)), lambda i: (i == F.size(tokens)) | F.array_contains(parts, F.get(tokens, i)))
        state = lambda start, best, n: F.struct(start.alias("start"), best.alias("best"), n.alias("n"))

        def longer(s: Column, end: Column) -> Column:
            more = end - s["start"] > s["n"]
            return state(end + 1, F.when(more, s["start"]).otherwise(s["best"]), F.when(more, end - s["start"]).otherwise(s["n"]))

        return F.aggregate(ends, state(F.lit(0), F.lit(0), F.lit(0)), longer, lambda s: F.slice(tokens, s["best"] + 1, s["n"]))

    def kept(command: Column) -> Column:
        places = lambda of: F.transform(command, lambda t, i: F.when(of(t), i + 1))
        flag = lambda t: t.rlike("^-+[^-0-9]")
        last_flag, first_plain = F.array_max(places(flag)), F.array_min(places(lambda t: ~flag(t)))
        keep = F.least(F.lit(MOST_TOKENS), F.greatest(F.coalesce(last_flag, F.lit(2)), first_plain))
        return F.when(first_plain.isNotNull(), F.slice(command, F.lit(1), keep)).otherwise(F.array().cast("array<string>"))

    return bound(tokens, lambda t: bound(longest(t), kept))


def contains_run(tokens: Column, needle: Column) -> Column:
    """Whether the needle stands in the tokens as one run; an empty needle never does."""
    n, m = F.size(tokens), F.size(needle)
    starts = F.when((m > 0) & (n >= m), F.sequence(F.lit(1), n - m + 1)).otherwise(F.array().cast("array<int>"))
    return F.exists(starts, lambda i: F.slice(tokens, i, m) == needle)


#: Tokens of all patterns that an automaton may have: it is sent to every task. More patterns are joined.
AUTOMATON_TOKENS = 500_000


class Automaton:
    """Patterns of tokens as a tree whose nodes know where to go on after a mismatch: a text's tokens are read once, whatever the patterns."""

    def __init__(self, patterns: list[list[str]]):
        self.after: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        for number, tokens in enumerate(patterns):
            at = 0
            for t in tokens:
                if t not in self.after[at]:
                    self.after[at][t] = len(self.after)
                    self.after.append({})
                    self.ends.append([])
                at = self.after[at][t]
            if tokens:
                self.ends[at].append(number)
        self.back, self.shorter = [0] * len(self.after), [0] * len(self.after)
        level = list(self.after[0].values())
        while level:
            deeper = []
            for node in level:
                for t, child in self.after[node].items():
                    at = self.back[node]
                    while at and t not in self.after[at]:
                        at = self.back[at]
                    self.back[child] = self.after[at].get(t, 0)
                    deeper.append(child)
                back = self.back[node]  # the longest end that is a tail of this node, without walking through nodes that end nothing
                self.shorter[node] = back if self.ends[back] else self.shorter[back]
            level = deeper

    def found(self, tokens: list[str]) -> set[int]:
        """The numbers of the patterns that stand in the tokens as runs."""
        out, at, seen = set(), 0, set()
        for t in tokens:
            while at and t not in self.after[at]:
                at = self.back[at]
            at = end = self.after[at].get(t, 0)
            while end and end not in seen:
                seen.add(end)
                out.update(self.ends[end])
                end = self.shorter[end]
        return out


def matches(actions: DataFrame, patterns: DataFrame) -> DataFrame:
    """(action_id, stage_id) of actions (action_id, tool, tokens) that hold a pattern (stage_id, tool, tokens) as a run.

    Patterns of up to AUTOMATON_TOKENS tokens in all go to every task as one automaton, which reads each action once.
    More are joined: a pattern meets the actions that hold its first token, by id and tool alone, and the run is
    verified where an action's tokens are fetched.
    """
    p = patterns.where(F.size("tokens") > 0).select("stage_id", "tool", "tokens")
    if (p.agg(F.sum(F.size("tokens"))).first()[0] or 0) <= AUTOMATON_TOKENS:
        held = p.distinct().toArrow().combine_chunks()
        kinds = f"action_id {actions.schema['action_id'].dataType.simpleString()}, stage_id {patterns.schema['stage_id'].dataType.simpleString()}"
        return actions.select("action_id", "tool", "tokens").mapInArrow(_scan(held), kinds).distinct()
    heads = actions.select("action_id", F.col("tool").alias("action_tool"), F.explode(F.array_distinct("tokens")).alias("head"))
    met = heads.join(p.withColumn("head", F.get("tokens", F.lit(0))), "head").where("tool is null or tool = action_tool").select("action_id", "stage_id", "tokens")
    hit = met.join(actions.select("action_id", F.col("tokens").alias("action_tokens")), "action_id").where(contains_run(F.col("action_tokens"), F.col("tokens")))
    return hit.select("action_id", "stage_id").distinct()


def _scan(patterns: pa.Table):
    tools, stages = patterns.column("tool").to_pylist(), patterns.column("stage_id")
    tokens = patterns.column("tokens").to_pylist()

    def run(batches):
        automaton = Automaton(tokens)
        for batch in batches:
            rows, numbers = [], []
            for i, (tool, words) in enumerate(zip(batch.column("tool").to_pylist(), batch.column("tokens").to_pylist(), strict=True)):
                for k in automaton.found(words or []):
                    if tools[k] is None or tools[k] == tool:
                        rows.append(i)
                        numbers.append(k)
            stage = stages.take(pa.array(numbers, pa.int64())).combine_chunks()
            stage = stage if isinstance(stage, pa.Array) else pa.concat_arrays(stage.chunks) if stage.num_chunks else pa.array([], stages.type)
            yield pa.RecordBatch.from_arrays([batch.column("action_id").take(pa.array(rows, pa.int64())), stage], names=["action_id", "stage_id"])

    return run


def live_rules(bindings: DataFrame, concepts: DataFrame, supersessions: DataFrame) -> DataFrame:
    """Bindings whose concept isn't retired and that no edge supersedes."""
    kept = bindings.join(concepts.where("status <> 'retired'").select("concept_id"), "concept_id", "left_semi")
    return kept.join(supersessions.select(F.col("dst_concept_id").alias("concept_id")), "concept_id", "left_anti")


def ordered_rules(rules: DataFrame, by: str = "stage_id") -> DataFrame:
    """Blocking rules first, then by age and id; adds `place`."""
    w = Window.partitionBy(by).orderBy(F.col("severity") != "blocking", "created_at", "concept_id")
    return rules.withColumn("place", F.row_number().over(w))


def latest_verdict(ratifications: DataFrame) -> DataFrame:
    """The last verdict on each subject, by time then id."""
    return ratifications.groupBy("subject_concept_id").agg(F.max_by("verdict", F.struct("created_at", "id")).alias("verdict"))


def read_patterns(stages: DataFrame, json: str = "patterns", most: int = MOST_PATTERNS) -> DataFrame:
    """(stage_id, pattern, n_malformed) of stages whose patterns are JSON lists of {tool, tokens}: the first `most` sound ones.

    A pattern is sound with one token at least, none of them null or empty. JSON that is no list counts as one malformed.
    """
    t = stages.withColumn("list", F.from_json(json, "array<struct<tool: string, tokens: array<string>>>"))
    sound = lambda p: p.isNotNull() & (F.size(p["tokens"]) > 0) & F.forall(p["tokens"], lambda x: x.isNotNull() & (x != ""))
    good = F.filter("list", lambda p: F.coalesce(sound(p), F.lit(False)))
    bad = F.when(F.col("list").isNull(), F.when(F.col(json).isNull(), 0).otherwise(1)).otherwise(F.size("list") - F.size(good))
    return t.select("stage_id", F.slice(F.coalesce(good, F.array().cast("array<struct<tool: string, tokens: array<string>>>")), 1, most).alias("patterns"), bad.alias("n_malformed"))


def gate(actions: DataFrame, patterns: DataFrame, rules: DataFrame, most_chars: int, told=lambda ids: ids) -> DataFrame:
    """What each action meets: (action_id, primary_stage, severity, stages, rules, rule_ids, overflow).

    rules are live ones (concept_id, stage_id, severity, created_at, body). The primary stage is that of the first rule
    in order, a blocking one if there is any. Bodies beyond `most_chars` in all make an overflow, told apart from the
    verdict, which never changes by it. Actions that meet no stage with a live rule aren't listed.

    What is met follows from the set of stages alone, so rules are put together once for each set that occurs, never
    for each action; `told` says how a set's rule_ids go to its actions.
    """
    hit = matches(actions, patterns).groupBy("action_id").agg(F.array_sort(F.collect_set("stage_id")).alias("met"))
    held = stage(hit.select("action_id", "met"), "met")
    sets = held.select("met").distinct().select("met", F.explode("met").alias("stage_id"))
    order = F.struct((F.col("severity") != "blocking").alias("advice"), "created_at", "concept_id", "stage_id")
    t = sets.join(rules.distinct(), "stage_id").groupBy("met").agg(
        F.min(order).alias("first"), F.count_distinct("stage_id").alias("stages"), F.count_distinct("concept_id").alias("rules"), F.sum(F.length("body")).alias("chars"),
        F.array_sort(F.collect_set("concept_id")).alias("rule_ids"),
    )
    t = t.select("met", F.col("first.stage_id").alias("primary_stage"), F.when(F.col("first.advice"), "advice").otherwise("blocking").alias("severity"), "stages", "rules", told(F.col("rule_ids")).alias("rule_ids"), (F.col("chars") > most_chars).alias("overflow"))
    return held.join(stage(t, "sets"), "met").drop("met")


def clipped(text: Column, most: int) -> Column:
    """(text, truncated): the text's first `most` characters; one more is looked at to tell."""
    head = F.substring(text, 1, most + 1)
    return F.struct(F.substring(head, 1, most).alias("text"), (F.length(head) > most).alias("truncated"))


def disputed_parents(rules: DataFrame, parents: DataFrame, verdicts: DataFrame, most: int = 8) -> DataFrame:
    """(concept_id, parent_ids, more): rules with parents (concept_id, parent_id) whose latest verdict is a rejection or retirement, the first `most` of them."""
    off = verdicts.where(F.col("verdict").isin("reject", "retire")).select(F.col("subject_concept_id").alias("parent_id"))
    t = rules.select("concept_id").distinct().join(parents, "concept_id").join(off, "parent_id", "left_semi").groupBy("concept_id").agg(F.array_sort(F.collect_set("parent_id")).alias("p"))
    return t.select("concept_id", F.slice("p", 1, most).alias("parent_ids"), (F.size("p") > most).alias("more"))


def stage_lookup(rules: DataFrame, cap: int, body: int, reason: int) -> DataFrame:
    """Each stage's first rules in order, with clipped bodies and reasons, and how many more it has."""
    first = ordered_rules(rules).where(F.col("place") <= cap)
    total = rules.groupBy("stage_id").agg(F.count("*").alias("total"))
    t = first.join(total, "stage_id").withColumns({"b": clipped(F.col("body"), body), "r": clipped(F.col("reason"), reason)})
    return t.select("stage_id", "place", "concept_id", "severity", F.col("b.text").alias("body"), F.col("b.truncated").alias("body_cut"), F.col("r.text").alias("reason"), F.col("r.truncated").alias("reason_cut"), F.greatest(F.col("total") - cap, F.lit(0)).alias("omitted"))


def for_model(bindings: DataFrame, model: str | None) -> DataFrame:
    """Bindings that hold for a model: all without one, else those of no agent or of this model."""
    return bindings if model is None else bindings.where((F.col("scope") != "agent") | (F.col("model_tag") == model))


def coverage(stages: DataFrame, bindings: DataFrame, rules: DataFrame, denies: DataFrame, cap: int) -> dict[str, DataFrame]:
    """The reports on how well gates are covered, each (key, n, place, omitted): the first `cap` and the rest counted.

    live: stages with live rules; unverified: stages whose patterns nobody confirmed or some of which are malformed;
    retirement: stages no live rule is at; agents: agent-scoped bindings by stage, with or without such a stage;
    unexplained: denied actions for which no rule is recorded. stages: (stage_id, verified, n_malformed).
    """
    live = rules.groupBy("stage_id").agg(F.count("*").alias("n"))
    reports = {
        "live": live.join(stages.select("stage_id"), "stage_id", "left_semi").select(F.col("stage_id").alias("key"), "n"),
        "unverified": stages.where(~F.col("verified") | (F.col("n_malformed") > 0)).select(F.col("stage_id").alias("key"), F.col("n_malformed").cast("long").alias("n")),
        "retirement": stages.join(live, "stage_id", "left_anti").select(F.col("stage_id").alias("key"), F.lit(0).cast("long").alias("n")),
        "agents": bindings.where("scope = 'agent'").join(stages.select("stage_id", F.col("stage_id").alias("known")), "stage_id", "left").groupBy(F.coalesce("known", F.lit("?")).alias("key")).agg(F.count("*").alias("n")),
        "unexplained": denies.where("size(rule_ids) = 0 or rule_ids is null").groupBy(F.col("stage_id").alias("key")).agg(F.count("*").alias("n")),
    }
    w = Window.partitionBy(F.lit(0)).orderBy(F.col("n").desc(), "key")
    out = {}
    for name, t in reports.items():
        first = t.orderBy(F.col("n").desc(), "key").limit(cap).withColumn("place", F.row_number().over(w))
        out[name] = first.crossJoin(t.agg(F.greatest(F.count("*") - cap, F.lit(0)).alias("omitted")))
    return out


def mirror_rows(stages: DataFrame, rules: DataFrame, aliases: DataFrame) -> DataFrame:
    """What a snapshot holds of each stage: its rules' ids in order, and all names that lead to its circle."""
    names = aliases.groupBy(F.col("to_name").alias("circle")).agg(F.array_sort(F.collect_set("from_name")).alias("names"))
    r = ordered_rules(rules).groupBy("stage_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "concept_id"))), lambda x: x["concept_id"]).alias("rule_ids"))
    t = stages.join(r, "stage_id").join(names, "circle", "left")
    return t.select("stage_id", F.concat(F.array("circle"), F.coalesce("names", F.array().cast("array<string>"))).alias("circles"), "rule_ids")


def blank_reason(reason: Column) -> Column:
    """Why a reason won't do: missing, blank, or with a line break; null if it will."""
    return F.when(reason.isNull(), "missing").when(F.trim(F.regexp_replace(reason, "\\s+", " ")) == "", "blank").when(reason.rlike("[\\n\\r\\x{2028}\\x{2029}]"), "line-break")


def violations(bindings: DataFrame) -> DataFrame:
    """(concept_id, broken): bindings that break a constraint."""
    rules = [
        ("blocking-needs-declaration", (F.col("severity") == "blocking") & (F.col("origin") != "declaration")),
        ("agent-needs-model", (F.col("scope") == "agent") != F.col("model_tag").isNotNull()),
        ("everywhere-needs-origin", (F.col("circle") == "*") & ~F.col("origin").isin("declaration", "correction")),
    ]
    return bindings.select("concept_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))).alias("broken"))


def edge_violations(edges: DataFrame) -> DataFrame:
    """(id, broken): lifecycle edges (id, src, dst, family, dst_span) that break a constraint: spans belong to provenance alone, no edge ends where it starts, nothing has two successors."""
    own = [("provenance-needs-span", (F.col("family") == "provenance") != F.col("dst_span").isNotNull()), ("self-edge", F.col("src") == F.col("dst"))]
    one = edges.select("id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in own]))).alias("broken"))
    w = Window.partitionBy("dst").orderBy("created_at", "id")
    again = edges.where("family = 'supersedes'").withColumn("k", F.row_number().over(w)).where("k > 1")
    return one.union(again.select("id", F.lit("second-successor")))


def refused_bindings(bindings: DataFrame, stages: DataFrame) -> DataFrame:
    """(concept_id, refused): bindings that may not be made: of an unknown stage, or with a reason that won't do."""
    t = bindings.join(stages.select("stage_id", F.lit(True).alias("known")), "stage_id", "left").withColumn("why", blank_reason(F.col("reason")))
    return t.withColumn("refused", F.when(F.col("known").isNull(), "unknown-stage").otherwise(F.concat(F.lit("reason-"), "why"))).where("refused is not null").select("concept_id", "refused")


def extraction_candidates(rules: DataFrame) -> DataFrame:
    """(reason, stages, rules) of reasons that live rules of two stages or more share. The reference's own likeness is unknown: here reasons are equal in their normal form."""
    normal = F.lower(F.trim(F.regexp_replace("reason", "\\s+", " ")))
    t = rules.where(normal != "").groupBy(normal.alias("reason")).agg(F.count_distinct("stage_id").alias("stages"), F.count("*").alias("rules"))
    return t.where("stages > 1")
