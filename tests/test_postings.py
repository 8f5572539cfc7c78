"""The inverted index against scores taken one by one."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from lodestore.operators import postings


def corpus(n=300):
    rng = random.Random(5)
    word = lambda: f"w{min(int(rng.paretovariate(0.7)), 400)}"
    texts = [" ".join(word() for _ in range(rng.randrange(1, 60))) for _ in range(n)]
    return [*texts, texts[3], texts[3], None, "", "!!", "Ünï wörd W1 w1"]


def plain(texts, queries, k, k1=1.5, b=0.75):
    counts = [Counter(t.decode() for t in postings.words(t or "")) for t in texts]
    mean = sum(c.total() for c in counts) / len(texts)
    df = Counter(t for c in counts for t in c)
    out = {}
    for q, tokens in queries.items():
        score = {}
        for i, c in enumerate(counts):
            s = sum(math.log((len(texts) - df[t] + 0.5) / (df[t] + 0.5) + 1) * c[t] * (k1 + 1) / (c[t] + k1 * (1 - b + b * c.total() / mean)) for t in tokens if c[t])
            if s > 0:
                score[i] = round(s, 6)
        out[q] = [(i, s) for i, s in sorted(score.items(), key=lambda r: (-r[1], r[0]))[:k]]
    return out


@pytest.mark.parametrize("asked", [postings.ASKED, 7])
def test_the_index_gives_the_best_documents(spark, monkeypatch, asked):
    monkeypatch.setattr(postings, "ASKED", asked)
    texts = corpus()
    table = spark.createDataFrame([(i, f"l{i % 3}", t) for i, t in enumerate(texts)], "doc_id long, label string, text string").repartition(3)
    rng = random.Random(6)
    queries = {q: sorted({f"w{rng.randrange(1, 60)}" for _ in range(12)}) for q in range(9)} | {9: ["absent"], 10: ["w1"]}
    probes = spark.createDataFrame([(q, t) for q, ts in queries.items() for t in [*ts, ts[0], ""]], "query_id long, token string")
    index = postings.build(table, shard_docs=50, block=4)
    assert index.documents == len(texts)
    got = {}
    for r in sorted(postings.top_bm25(index, probes, 7).collect(), key=lambda r: r.place):
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    want = plain(texts, queries, 7)
    assert {q: v for q, v in want.items() if v} == {q: [(i, pytest.approx(s, abs=2e-6)) for i, s in v] for q, v in got.items()}
    held = {(r.doc_id, r.label, r.token, r.tf, r.dl) for r in postings.hits(index, probes.where("query_id = 10")).collect()}
    assert held == {(i, f"l{i % 3}", "w1", c["w1"], c.total()) for i, c in enumerate(Counter(t.decode() for t in postings.words(t or "")) for t in texts) if c["w1"]}


def test_an_empty_table_has_an_index(spark):
    index = postings.build(spark.createDataFrame([], "doc_id long, label string, text string"))
    assert index.documents == 0
    assert postings.top_bm25(index, spark.createDataFrame([(1, "a")], "query_id long, token string"), 3).count() == 0


def test_blocks_whose_bound_is_too_low_are_not_scored():
    rng = np.random.default_rng(7)
    ids, block = np.arange(40_000), 8
    asked = []
    for size in (200, 3000, 30_000):
        docs = np.sort(rng.choice(40_000, size, replace=False))
        gives = rng.random(size) / size * 1000
        begin = np.flatnonzero(np.diff(docs // block, prepend=-1))
        asked.append((docs, gives, docs[begin] // block, np.maximum.reduceat(gives, begin)))
    best, scored = postings.best_of_shard(asked, ids, 10, block, 6)
    every = np.round(sum(np.bincount(d, g, len(ids)) for d, g, _, _ in asked), 6)
    assert best == [(int(i), every[i]) for i in sorted(range(len(ids)), key=lambda i: (-every[i], i))[:10]]
    assert scored < len(ids) / block / 4
