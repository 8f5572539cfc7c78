"""What a query makes on the way grows with its input, not with pairs of its rows."""

import random
import re
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import GroupedData
from pyspark.sql import functions as F

from lodestore.functions import text
from lodestore.functions.text import lexical_tokens
from lodestore.operators import evaluation, gates, graph, postings, retrieval
from lodestore.plans import catalog, ledgers
from lodestore.sources import tables
from lodestore.sources.tables import read
from lodestore.streaming import moments, spool
from tests.oracle import same
from tests.test_postings import corpus, plain


def test_groups_rank_by_their_best_document(spark):
    texts = corpus()
    table = spark.createDataFrame([(i, None, t) for i, t in enumerate(texts)], "doc_id long, label string, text string").repartition(3)
    queries = {1: ["w1", "w5", "w9"], 2: ["w2"], 3: ["w1", "w30", "w31"]}
    probes = spark.createDataFrame([(q, t) for q, ts in queries.items() for t in ts], "query_id long, token string")
    got = {(r.query_id, r.place): (r.doc_id, round(r.score, 5)) for r in postings.top_bm25(postings.build(table, shard_docs=50, block=4), probes, 5, group=7).collect()}
    want = {}
    for q, found in plain(texts, queries, len(texts)).items():
        best = {}
        for i, s in found:
            best[i // 7] = max(best.get(i // 7, 0), s)
        want |= {(q, k + 1): (g, round(s, 5)) for k, (g, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:5])}
    assert got == want


def test_cues_make_no_row_for_every_hit(spark, sf, monkeypatch):
    def refuse(*_):
        raise AssertionError("every hit of every cue is joined")

    monkeypatch.setattr(postings, "hits", refuse)
    monkeypatch.setattr(evaluation, "bm25", refuse)
    for name in ("cue_recall", "file_ranking"):
        same(spark, sf, catalog.queries()[name], catalog.oracle_sql()[name])


def test_rules_are_put_together_by_set_of_stages(spark):
    actions = spark.createDataFrame([(i, "t", ["a", "b"] if i % 2 else ["c"]) for i in range(200)], "action_id long, tool string, tokens array<string>")
    patterns = spark.createDataFrame([("s1", None, ["a", "b"]), ("s2", "t", ["b"]), ("s3", None, ["c"])], "stage_id string, tool string, tokens array<string>")
    rows = [(i, f"s{i % 4 + 1}", "blocking" if i % 40 == 5 else "advice", i % 7, "x" * (i % 3)) for i in range(100)]
    rules = spark.createDataFrame(rows, "concept_id long, stage_id string, severity string, created_at long, body string")
    made = spark.sparkContext.accumulator(0)

    def counted(ids):
        return F.udf(lambda x: made.add(1) or ",".join(map(str, x)))(ids)

    got = {(r.action_id, r.primary_stage, r.severity, r.stages, r.rules, r.rule_ids, r.overflow) for r in gates.gate(actions, patterns, rules, 40, counted).collect()}
    want = set()
    for i in range(200):
        mine = [r for r in rows if r[1] in (("s1", "s2") if i % 2 else ("s3",))]
        first = min((r[2] != "blocking", r[3], r[0], r[1]) for r in mine)
        want.add((i, first[3], "advice" if first[0] else "blocking", len({r[1] for r in mine}), len(mine), ",".join(str(r[0]) for r in sorted(mine)), sum(len(r[4]) for r in mine) > 40))
    assert got == want
    assert made.value == 2


def test_a_vector_leaves_k_neighbours_a_band(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 16)
    monkeypatch.setattr(retrieval, "ROW_BLOCK", 8)
    x = np.random.default_rng(3).integers(-2, 3, (90, 4)) / 4.0
    bands, k = {"low": (0.0, 0.5), "high": (0.25, 2.0)}, 3
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(90, None), (91, [float("nan")] * 4), (92, [])], "observation_id long, embedding array<double>")
    got = sorted(tuple(r) for r in retrieval.nearest_in_bands(v, bands, k).collect())
    want = []
    for band, (least, below) in bands.items():
        for i in range(90):
            near = sorted((-round(float(x[i] @ x[j]), 6), j) for j in range(90) if j != i and least <= round(float(x[i] @ x[j]), 6) < below)
            want += [(band, i, j, -s) for s, j in near[:k]]
    assert got == sorted(want)


def test_memberships_are_not_broadcast_by_estimate(spark, sf):
    plan = catalog.queries()["about_edges"](spark, sf)._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan
    edges = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    m = spark.createDataFrame([(1, "id", "x"), (2, "id", "x"), (3, "id", "y")], "concept_id long, kind string, key string")
    assert [tuple(r) for r in graph.without_support(edges, m).collect()] == [(2, 3)]


def test_a_shard_in_the_making_holds_numbers(monkeypatch):
    class Here:
        get = staticmethod(lambda: Here)
        partitionId = staticmethod(lambda: 0)

    monkeypatch.setattr(postings, "TaskContext", Here)
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{x}" for x in rng.choice(5000, 400, replace=False)) for _ in range(1500)]
    batch = pa.RecordBatch.from_pydict({"doc_id": range(1500), "label": pa.nulls(1500, pa.string()), "text": texts})
    seen = []

    def shard(*_):
        seen.append(tracemalloc.get_traced_memory()[0])

    monkeypatch.setattr(postings, "_shard", shard)
    tracemalloc.start()
    list(postings._built(postings.words, 10_000, 8)([batch]))
    tracemalloc.stop()
    assert seen[0] < 15e6  # 600,000 postings
    assert postings.SHARD_POSTINGS <= 1_000_000


def test_headroom_makes_no_row_for_a_pair(spark, sf, monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("pairs are rows")

    monkeypatch.setattr(retrieval, "best_observations", refuse)
    monkeypatch.setattr(retrieval, "ROW_BLOCK", 16)
    same(spark, sf, catalog.queries()["threshold_headroom"], catalog.oracle_sql()["threshold_headroom"])


def test_the_ledger_asks_no_state_from_python(spark, sf, monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("a state is asked over a socket")

    monkeypatch.setattr(GroupedData, "transformWithStateInPandas", refuse)
    same(spark, sf, catalog.queries()["stream_moments"], catalog.oracle_sql()["stream_moments"])


def test_the_batch_ledger_parses_its_lines_once(spark, sf):
    for t in moments.batch(spool.parse(ledgers._spool_lines(spark, sf)).withColumnRenamed("runId", "run_id")):
        assert "from_json" not in t._jdf.queryExecution().optimizedPlan().toString()


def test_signals_shuffle_no_row_for_a_hit(spark, sf):
    (d,) = read(spark, sf, "documents")
    plan = catalog.queries()["nomination_signals"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan
    texts = d.limit(40).select("doc_id", (F.col("doc_id") % 3).alias("concept_id"), "text")
    ix = texts.select("doc_id", "concept_id", F.explode(lexical_tokens(F.coalesce("text", F.lit("")))).alias("token")).toPandas()
    held = {i: set(g.token) for i, g in ix.groupby("doc_id")}
    concept, df = dict(zip(ix.doc_id, ix.concept_id, strict=True)), ix.groupby("token").concept_id.nunique()
    w = lambda ts: sum(3 if len(t) >= 8 else 1 for t in ts)
    rows = texts.toPandas()
    t = spark.createDataFrame([(int(r.doc_id), int(r.concept_id), w(held.get(r.doc_id, ())), r.text) for r in rows.itertuples()], "doc_id long, concept_id long, weight long, text string")
    asked = sorted(held)[:4]
    probes = spark.createDataFrame([(int(q), x) for q in asked for x in held[q]], "query_id long, token string")
    got = {(r.query_id, r.concept_id): (round(r.lexical, 9), round(r.entities, 9)) for r in postings.signals(t, probes, 3).collect()}
    want = {}
    for q in asked:
        idf = {x: np.log(3 / (1 + df[x])) for x in held[q]}
        for i in set(held) - {q}:
            both = held[q] & held[i]
            if both:
                new = sum(idf[x] for x in both) / sum(idf.values()), w(both) / w(held[q] | held[i])
                old = want.get((q, concept[i]), new)
                want[q, concept[i]] = max(new[0], old[0]), max(new[1], old[1])
    assert got == {k: (round(a, 9), round(b, 9)) for k, (a, b) in want.items()}


def test_pointers_are_not_broadcast(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20)], "src long, dst long")
    said, path = graph.cycle_verdicts(links, spark.createDataFrame([(5, 2), (2, 5)], "src long, dst long"))
    assert {(r.src, r.dst): (r.verdict, r.hops) for r in said.collect()} == {(5, 2): ("cycle", 4), (2, 5): ("safe", None)}
    assert [r.node for r in path.orderBy("place").collect()] == [5, 2, 3, 4, 5]
    for t in (said, path):
        assert "BroadcastHashJoin" not in t._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["follow_edges", "undirected_counts", "dangling_edges", "two_hop_reach", "hashing_embedding", "co_occurrence_edges", "unsupported_edges_all", "concept_degrees"])
def test_a_task_of_a_shuffle_stays_small_as_tables_grow(spark, sf, monkeypatch, name):
    monkeypatch.setattr(tables, "TASK_ROWS", 300)
    query = catalog.queries()[name]
    plan = query(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert max(int(n) for n in re.findall(r"Exchange hashpartitioning\(.*, (\d+)\)", plan)) > 4
    sql = catalog.oracle_sql()
    same(spark, sf, query, sql[name] if name in sql else sql["unsupported_edges"].replace(" and o_orderpriority = '5-LOW'", ""))


def test_entity_patterns_read_marked_runs_once(spark, sf):
    plan = catalog.queries()["structural_entities"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ya?ml|py|go|rs|toml|css") == 2  # found once, taken out once
    rng = random.Random(7)
    pieces = ["a", "b1", "E", "ERR", "E12", "_", ".", "/", "-", " ", "\n", "é", "A", "fooBar", ".ts", ".yml", "x/y", "💥", "中"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randrange(40)))) for i in range(1500)] + [(1500, ""), (1501, "a-b.ts"), (1502, None)]
    found, rest = text.structural(F.col("t"))
    t = spark.createDataFrame(rows, "i long, t string").select("i", F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["surface"])).alias("e"), rest.alias("rest"))
    got = {r.i: (r.e, r.rest) for r in t.collect()}
    assert got.pop(1502) == (None, None)
    for i, left in rows[:-1]:
        e = []
        for kind, pattern in text.ENTITY_PATTERNS:
            e += [f"{kind}:{m.group()}" for m in re.finditer(pattern, left, re.ASCII)]
            left = re.sub(pattern, " ", left, flags=re.ASCII)
        assert got[i] == (e, left)


def test_seeds_go_through_the_tokens_once(spark, sf):
    plan = catalog.queries()["action_seeds"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sequence(") == 1
    tokens = [t for i in range(2000) for t in (f"c{i}", "x", "-f", ";")] + ["last", "of", "-v", "-w", "all"]
    t = spark.createDataFrame([(tokens,)], "t array<string>")
    assert t.select(gates.seed_pattern(F.col("t")).alias("p")).first().p == ["last", "of", "-v", "-w"]


def test_a_quote_that_stays_open_keeps_its_word():
    assert gates.shell_words("echo 'it is") == ["echo", "it is"]
    assert gates.shell_words('a;b"') == ["a", ";", "b"]
    assert gates.shell_words("a & b&c # d'\n\r\n\\\r\n#e\ne\\ f \\") == ["a", "&", "b&c", "\n", "e f", "\\"]


@pytest.fixture
def many_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("name", ["undirected_counts", "dangling_edges", "two_hop_reach"])
def test_a_task_stays_small_where_adaptive_execution_joins_partitions(spark, sf, monkeypatch, many_partitions, name):
    monkeypatch.setattr(tables, "TASK_ROWS", 300)
    query = catalog.queries()[name]
    out = query(spark, sf)
    same(spark, sf, lambda *_: out, catalog.oracle_sql()[name])
    assert len(re.findall(r"REPARTITION_BY_NUM", out._jdf.queryExecution().executedPlan().toString())) >= 3


def test_a_long_circle_has_its_path(spark, tmp_path):
    n = 1100
    parts = spark.createDataFrame([(k, -6 * k * pow(13, -1, n) % n) for k in range(1, n + 1)], "p_partkey long, p_size int")  # each part supersedes the next one
    parts.write.parquet(f"{tmp_path}/part.parquet")
    got = catalog.queries()["proposed_circles"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    want = con.execute(catalog.oracle_sql()["proposed_circles"]).fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert max(r[2] for r in want) > graph.WALK_CAP


@pytest.mark.parametrize("group", [1, 7])
def test_a_query_is_scored_above_its_floor_only(spark, monkeypatch, group):
    monkeypatch.setattr(postings, "RANKED_PAIRS", 30)
    monkeypatch.setattr(postings, "RANKED_WORK", 40)
    monkeypatch.setattr(postings, "DENSE", 60)
    texts = corpus()
    table = spark.createDataFrame([(i, None, t) for i, t in enumerate(texts)], "doc_id long, label string, text string").repartition(3)
    rng = random.Random(11)
    queries = {q: sorted({f"w{rng.randrange(1, 300)}" for _ in range(9)} | {"w1"}) for q in range(12)} | {50: ["w1"], 51: ["w1", "w2", "absent"]}
    probes = spark.createDataFrame([(q, t) for q, ts in queries.items() for t in ts], "query_id long, token string")
    out = postings.top_bm25(postings.build(table, shard_docs=50, block=4), probes, 5, group=group)
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()  # a shard is a task, however few bytes it has
    got = {(r.query_id, r.place): (r.doc_id, round(r.score, 5)) for r in out.collect()}
    want = {}
    for q, found in plain(texts, queries, len(texts)).items():
        best = {}
        for i, x in found:
            best[i // group] = max(best.get(i // group, 0), x)
        want |= {(q, n + 1): (g, round(x, 5)) for n, (g, x) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:5])}
    assert got == want
