import hashlib

import numpy as np
import pytest

from lodestore.llm import covertree, minhash, substring
from tests.llm import brute

ROWS = brute.corpus()


def table(spark, rows, parts=3):
    """Documents with columns whose names the operators also use."""
    extra = [(i, t, 1, "x", None, 5) for i, t in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, n int, bucket string, cls long, component_id long").repartition(parts)


def test_near_duplicates_match_brute_force(spark):
    sizes, comp = brute.near(ROWS)
    got = minhash.near_duplicates(table(spark, ROWS)).collect()
    assert {r.doc_id: r.n_shingles for r in got} == sizes
    assert {r.doc_id: r.component_id for r in got} == comp
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_edges(spark):
    rows = [(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, "A b C"), (3, None)]
    got = minhash.near_duplicates(table(spark, rows))
    assert got.count() == 5
    assert {r.doc_id: r.component_id for r in got.collect()} == {1: 1, None: None, 2: 1, 3: 3}
    assert minhash.near_duplicates(table(spark, [])).count() == 0


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 1000).astype(np.uint64)
    s = minhash.superminhash([x[:800], x[200:], x[:3]], 128)
    assert np.isfinite(s).all() and abs((s[0] == s[1]).mean() - 0.6) < 0.15


def test_block_links_need_no_leader():
    sets = [np.arange(a, a + 100, dtype=np.uint64) for a in (0, 10, 20, 500)]
    bands = np.zeros((4, 2), np.int64) + np.arange(2)
    sign = np.zeros((4, 128), np.uint8)
    out = minhash._join_links(np.array([1, 2, 3, 4]), np.array([1, 2, 3, 4]), np.zeros(4, int), bands, sign, sets, 75)
    assert set(zip(out["a"].to_pylist(), out["b"].to_pylist(), strict=True)) == {(1, 2), (2, 3)}


@pytest.mark.parametrize("group", [150_000, 60, 1])
def test_substring_matches_brute_force(spark, group):
    """Whole prefixes in one subtree; some grown; all grown to whole windows."""
    got = substring.remove_repeats(table(spark, ROWS), group=group).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute.substring(ROWS)


def test_halves_of_a_run_hold_all_its_windows():
    rng = np.random.default_rng(5)
    for _ in range(30):
        count = int(rng.integers(1, 29))
        offset = int(rng.integers(count - 1, 28))
        words = rng.integers(-(2**62), 2**62, count + 34)
        todo, seen = [{"key0": 1, "content0": 2, "place": 0, "low": 0, "high": 27, "offset": offset, "count": count, "words": words.tolist()}], []
        while todo:
            row = todo.pop()
            if row["low"] == row["high"]:
                seen.append(row["place"])
                assert row["count"] == 1 and row["offset"] == row["low"]
                continue
            for x in substring.halved(row, 35):
                part = dict(zip(("key0", "content0", "place", "low", "high", "key", "content", "offset", "count", "words"), x, strict=True))
                part["words"] = part["words"].view(np.int64).tolist()
                assert part["words"] == words[part["place"] : part["place"] + part["count"] + 34].tolist()
                todo.append(part)
        assert sorted(seen) == list(range(count))


def test_substring_refuses_windows_beyond_its_bits(spark):
    with pytest.raises(ValueError):
        substring.remove_repeats(table(spark, ROWS), window=80, prefix=8)


def test_substring_edges(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (1, text), (None, text), (2, None), (3, "a")]
    got = substring.remove_repeats(table(spark, rows)).collect()
    assert len(got) == 5 and sum(r.n_removed for r in got) == 120
    assert {r.kept_text for r in got if r.doc_id == 3} == {"a"} and substring.remove_repeats(table(spark, [])).count() == 0


def test_substring_text_keeps_lines(spark):
    p = " ".join(f"p{i}" for i in range(40))
    rows = [(1, f"first line.\n{p}\nlast line."), (2, f"{p} end"), (3, "alone\nhere")]
    got = {r.doc_id: r.text for r in substring.without_repeats(table(spark, rows)).collect()}
    assert got == {1: "first line.\nlast line.", 2: "end", 3: "alone\nhere"}


def test_runs_cover_all_windows():
    texts = [(t or "").encode() for _, t in ROWS]
    text, start, count, offset, *_ = substring.runs_of(texts, 35, 8)
    for k, t in enumerate(texts):
        seen = [s + i for s, c in zip(start[text == k], count[text == k], strict=True) for i in range(c)]
        assert seen == list(range(max(0, len(t.split()) - 34)))
    assert (offset >= 0).all() and (offset <= 27).all()


def vectors():
    rng = np.random.default_rng(3)
    c = rng.normal(size=(6, 16))
    near = [c[i % 3] / np.linalg.norm(c[i % 3]) + rng.normal(size=16) * s for i, s in enumerate(np.linspace(0, 0.12, 400))]
    return [v.astype(np.float32) for v in [*near, *near[:5], *rng.normal(size=(150, 16))]]


def test_cover_tree_matches_brute_force(spark):
    x = vectors()
    rows = [(i, v.tolist(), 7, "z") for i, v in enumerate(x)]
    odd = [(9001, None, 1, "z"), (9002, [0.0] * 16, 1, "z"), (9003, [float("nan")] * 16, 1, "z"), (9004, [None] + [1.0] * 15, 1, "z"), (9005, [], 1, "z"), (9006, [1.0, 2.0], 1, "z"), (None, [1.0] * 16, 1, "z")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, n int, id string").repartition(3)
    u = np.array(x, np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    hit = u @ u.T >= 0.9
    np.fill_diagonal(hit, False)
    comp = brute.components(range(len(x)), list(zip(*np.nonzero(hit), strict=True)))
    got = {r.vec_id: r for r in covertree.links(df, block=64).collect()}
    assert len(got) == len(x) + len(odd)
    assert {i: got[i].n_links for i in range(len(x))} == dict(enumerate(hit.sum(axis=1).tolist()))
    assert {i: got[i].component_id for i in range(len(x))} == comp
    assert all(got[i].n_links == 0 and got[i].kept for i in (9001, 9002, 9003, 9004, 9005, 9006, None))
    assert covertree.links(df.limit(0)).count() == 0


def test_digest_of_nothing(spark):
    got = substring.remove_repeats(table(spark, [(1, None)])).first()
    assert got.kept_sha256 == hashlib.sha256(b"").hexdigest()
