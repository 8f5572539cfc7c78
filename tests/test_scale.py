"""Operators that split what is large: automaton, pairs of a hot group, ordered folds, ranks, canonical JSON."""

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestore.operators import evaluation, folds, gates, graph
from lodestore.sources import mirror


def holds(tokens, needle):
    return any(tokens[i : i + len(needle)] == needle for i in range(len(tokens) - len(needle) + 1))


def test_the_automaton_finds_what_stands_in_a_text():
    rng = random.Random(3)
    for _ in range(300):
        patterns = [[rng.choice("abc") for _ in range(rng.randrange(1, 5))] for _ in range(12)] + [[]]
        tokens = [rng.choice("abcd") for _ in range(rng.randrange(30))]
        assert gates.Automaton(patterns).found(tokens) == {i for i, p in enumerate(patterns) if p and holds(tokens, p)}


@pytest.mark.parametrize("most", [gates.AUTOMATON_TOKENS, 0])
def test_a_long_action_meets_its_stages_by_automaton_and_by_join(spark, monkeypatch, most):
    monkeypatch.setattr(gates, "AUTOMATON_TOKENS", most)
    rng = random.Random(4)
    actions = [(i, rng.choice(["bash", "edit", None]), [f"t{rng.randrange(30)}" for _ in range(n)]) for i, n in enumerate([4000, 0, 1, 50, 200])] + [(9, "bash", None)]
    patterns = [(f"s{k // 2}", rng.choice(["bash", None]), [f"t{rng.randrange(30)}" for _ in range(rng.randrange(0, 4))]) for k in range(200)]
    a = spark.createDataFrame(actions, "action_id long, tool string, tokens array<string>")
    p = spark.createDataFrame(patterns, "stage_id string, tool string, tokens array<string>")
    want = {(i, s) for i, tool, tokens in actions for s, wanted, needle in patterns if tokens and needle and wanted in (None, tool) and holds(tokens, needle)}
    assert {tuple(r) for r in gates.matches(a, p).collect()} == want and len(want) > 50
    assert gates.matches(a, p.limit(0)).count() == 0


def test_pairs_of_a_group_are_the_same_however_it_is_split(spark):
    rows = [("hot", i) for i in range(230)] + [("small", i) for i in range(0, 30, 3)] + [("one", 5)]
    t = spark.createDataFrame(rows, "g string, m long")
    want = {("hot", a, b) for a in range(230) for b in range(a + 1, 230)} | {("small", a, b) for a in range(0, 30, 3) for b in range(a + 3, 30, 3)}
    for block in (7, 50, 1000):
        got = [tuple(r) for r in graph.paired(t, ["g"], "m", block).collect()]
        assert len(got) == len(want) and set(got) == want


def test_a_hot_group_of_twenty_thousand_is_paired_whole(spark):
    t = spark.range(20_000).select(F.lit("hot").alias("g"), F.col("id").alias("m"))
    assert graph.paired(t, ["g"], "m", 2000).count() == 20_000 * 19_999 // 2


def test_running_centroids_fold_in_order_with_one_carry(spark):
    rng = np.random.default_rng(5)
    rows = [(k, i, rng.normal(size=3).tolist()) for k, n in (("a", 500), ("b", 1), ("c", 40)) for i in range(n)] + [("d", 0, [0.0, 0.0, 0.0]), ("d", 1, [2.0, 0.0, 0.0]), (None, 1, [1.0, 0.0, 0.0]), ("e", 1, None)]
    want = {}
    for k, _, v in rows:
        if k and v:
            m, n = want.get(k, (np.zeros(3), 0))
            r = (m * n + np.array(v)) / (n + 1)
            want[k] = (r / (np.linalg.norm(r) or 1), n + 1)
    random.Random(1).shuffle(rows)
    t = spark.createDataFrame(rows, "k string, at long, v array<double>").repartition(5)
    got = {r.k: r.centroid for r in folds.running_centroids(t, "k", ["at"], "v").collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k][0].tolist()) for k in want)


@pytest.mark.parametrize("leaf", [evaluation.LEAF, 20])
def test_quantiles_are_exact_whatever_the_leaf(spark, monkeypatch, leaf):
    monkeypatch.setattr(evaluation, "LEAF", leaf)
    rng = random.Random(6)
    rows = [("x", rng.gauss(0, 1)) for _ in range(3000)] + [("x", 1e300), ("x", -1e300)] + [("y", float(rng.randrange(4))) for _ in range(500)] + [("z", 7.0), ("z", None)]
    t = spark.createDataFrame(rows, "k string, v double")
    shares = [0.05, 0.5, 0.95, 0.99]
    got = {r.k: r for r in evaluation.index_quantiles(t, "v", shares, ["k"]).collect()}
    for k in "xyz":
        s = sorted(v for g, v in rows if g == k and v is not None)
        assert [got[k][f"p{round(p * 100):02d}"] for p in shares] == [s[min(int(len(s) * p), len(s) - 1)] for p in shares]
        assert (got[k].n, got[k].least) == (len(s), s[0])
    assert evaluation.index_quantiles(t.limit(0), "v", shares, ["k"]).count() == 0


def test_skeleton_digests_are_those_of_canonical_json(spark):
    rows = [("￮", "b", None), ("\U0001f600", 'q" \\ \\u000B \x0b \x1f \n \x01 / ', "global"), ("a", "", "local")]
    t = spark.createDataFrame([("c", *r) for r in rows], "circle string, concept_id string, body string, breadth string")
    order = sorted(rows, key=lambda r: r[0].encode("utf-16-be"))
    assert [r[0] for r in order] == ["a", "\U0001f600", "￮"]
    want = json.dumps([{"conceptId": i, "body": b, "breadth": x} for i, b, x in order], ensure_ascii=False, separators=(",", ":"))
    got = mirror.skeleton_hash(t, ["circle"]).first()
    assert got.digest == hashlib.sha256(want.encode()).hexdigest() and got.members == 3


def test_queries_in_files_find_what_queries_in_a_plan_find(spark, monkeypatch):
    from lodestore.operators import retrieval

    rng = np.random.default_rng(8)
    rows = [(i, f"c{i % 7}", rng.normal(size=5 if i % 9 else 3).tolist()) for i in range(200)] + [(500, "c1", [0.0] * 5), (501, "c1", None)]
    v = spark.createDataFrame(rows, "observation_id long, concept_id string, embedding array<float>").repartition(3)
    q = v.where("observation_id % 4 = 0").select(F.col("observation_id").alias("query_id"), "embedding")
    want = sorted(retrieval.best_observations(v, q, exclude_self=True).collect())
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 8)
    monkeypatch.setattr(retrieval, "ROW_BLOCK", 16)
    got = sorted(retrieval.best_observations(v, q, exclude_self=True).collect())
    assert [r[:3] for r in got] == [r[:3] for r in want] and [r[3] for r in got] == pytest.approx([r[3] for r in want])
    assert retrieval.best_observations(v, q.limit(0)).count() == 0


def test_proposed_links_are_judged_within_the_cap(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100)], "src long, dst long")
    asked = [(40, 1), (40, 31), (40, 32), (9, 5), (50, 1), (50, 35), (60, 100), (7, 7), (70, 71)]
    said, paths = graph.cycle_verdicts(links, spark.createDataFrame(asked, "src long, dst long"), cap=9)
    assert {(r.src, r.dst): (r.verdict, r.hops) for r in said.collect()} == {
        (40, 1): ("cap", None), (40, 31): ("cap", None), (40, 32): ("cycle", 9), (9, 5): ("cycle", 5), (50, 1): ("cap", None), (50, 35): ("safe", None), (60, 100): ("cap", None), (7, 7): ("cycle", 1), (70, 71): ("safe", None),
    }
    got = sorted((r.place, r.node) for r in paths.where("src = 9").collect())
    assert got == [(0, 9), (1, 5), (2, 6), (3, 7), (4, 8), (5, 9)]
    ring = spark.createDataFrame([(3, 9), (9, 4), (4, 7), (7, 3), (1, 3), (20, 20)], "src long, dst long")
    assert sorted(tuple(r) for r in graph.cycle_paths(ring).collect()) == [(3, 0, 3), (3, 1, 9), (3, 2, 4), (3, 3, 7), (20, 0, 20)]


def test_an_overview_drops_its_rungs_in_order_and_clips_last(spark):
    from lodestore.operators import queues

    sections = {"living": ["l" * 10] * 3, "duplicates": ["d" * 8] * 2, "dirty": ["x" * 4], "stale": ["y" * 4], "contradictions": ["c" * 6], "counts": ["n" * 5], "skeleton": ["s" * 40, "t" * 10]}
    rows = [("a", s, i, t) for s, ts in sections.items() for i, t in enumerate(ts)] + [("b", "counts", 0, "n"), ("b", "living", 0, None)]
    t = spark.createDataFrame(rows, "circle string, section string, place int, text string")
    want = {115: (0, None, 0), 110: (1, None, 2), 95: (2, None, 4), 70: (3, None, 7), 60: (4, None, 8), 40: (5, 20, 8), 12: (5, 2, 8), 7: (5, 1, 8), 6: (5, -1, 8)}
    for budget, (rungs, most, dropped) in want.items():
        told, kept = queues.fitted(t, budget)
        a = told.where("circle = 'a'").first()
        assert (a.chars, a.rungs, a.most, a.dropped, a.fits) == (115, rungs, most, dropped, True), budget
        left = kept.where("circle = 'a'").collect()
        assert sum(len(r.text) for r in left) <= budget and {r.section for r in left} >= {"counts", "skeleton"}
        assert told.where("circle = 'b'").first().rungs == 0
    assert not queues.fitted(t, 4)[0].where("circle = 'a'").first().fits
    assert queues.fitted(t.limit(0), 5)[0].count() == 0


def test_an_observation_without_a_session_hides_none(spark):
    from lodestore.operators import resolution

    rows = [("a", 1, "s1"), ("a", 2, None), ("a", 3, "s2"), ("a", 4, "s2"), ("a", 5, "s1"), ("b", 1, None), ("b", 2, "s1"), ("b", 3, "s1")]
    t = spark.createDataFrame([(c, k, k, s) for k, (c, k2, s) in enumerate(rows)], "concept_id string, observation_id int, created_at int, session_id string")
    got = {r.concept_id: (r.support_count, r.arousal_gain, r.last_confirmed_at) for r in resolution.confirmations(t).collect()}
    assert got == {"a": (5, 2, 4), "b": (3, 0, None)}
