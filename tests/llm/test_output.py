"""Simple-8b shards, clustering around centroids and fill-in-the-middle, against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestore.llm import middle, nearest, shards, words
from tests.llm import brute

JSON = P.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "it's  two", "<|endoftext|> no", "ÀÉ 漢字かな 😀😀 é", "a" * 3000, "<P> a", "b <S>", "<M", "x<M>y", "<" * 50, "P>S>M><", "two\nlines\n", "漢" * 40_000]


def docs(spark, texts, ids=None):
    rows = [(i, t, "en", 1, "x", 0.5) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int, output string, part double").repartition(3)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 1 << 17), st.integers(0, (1 << 64) - 1)), max_size=400), st.sampled_from([1, 5, 64, 1024]))
def test_any_values_come_back_from_their_words(values, block):
    held = np.array(values, np.uint64)
    coded, sizes = words.encode(held, block)
    assert words.decode(coded, sizes).tolist() == values
    assert sizes.sum() == len(coded)
    at = 0
    for k, (n, extra) in enumerate(sizes.tolist()):  # each block by itself
        part = words.decode(coded[at : at + n + extra], sizes[k : k + 1])
        assert part.tolist() == values[k * block : (k + 1) * block]
        at += n + extra


def test_words_are_as_full_as_their_selectors_allow():
    for count, bits in words.SELECTORS[:15]:
        if words.BLOCK % count == 0:
            held = np.full(words.BLOCK, (1 << bits) - 1, np.uint64)
            assert len(words.encode(held)[0]) == words.BLOCK // count


def plain_digests(rows):
    tok, at, out = Tokenizer.from_file(JSON), 0, {}
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        out.setdefault(i, []).append((at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("shard_ids", [shards.SHARD_IDS, 300])
def test_shards_give_back_every_document(spark, shard_ids):
    texts = TEXTS + [t for _, t in brute.corpus()]
    ids = list(range(len(texts)))
    random.Random(4).shuffle(ids)
    folder = shards.write_tokens(docs(spark, texts, ids), JSON, shard_ids=shard_ids)
    want = plain_digests(sorted(zip(ids, texts, strict=True)))
    got = shards.read_digests(spark, folder).collect()
    assert {r.doc_id: [(r.start, r.n_tokens, r.ids_crc32)] for r in got} == want
    tok = Tokenizer.from_file(JSON)
    whole = []
    for i, t in sorted(zip(ids, texts, strict=True)):
        whole += [*tok.encode(t or "", add_special_tokens=False).ids, 2]
    read = {r.doc_id: (r.start, list(r.ids)) for r in shards.read_tokens(spark, folder).collect()}
    assert all(whole[a : a + len(v)] == v for a, v in read.values()) and sum(len(v) for _, v in read.values()) == len(whole)
    for a, b in ((0, 1), (1000, 9000), (len(whole) - 5, len(whole)), (7, 7)):
        parts = sorted((r.start, list(r.ids)) for r in shards.span(spark, folder, a, b).collect())
        assert [v for _, p in parts for v in p] == whole[a:b]


def test_shards_of_null_repeated_and_wide_ids(spark):
    texts = ["one two", "one two", None, "three", "four " * 30]
    folder = shards.write_tokens(docs(spark, texts, [5, 5, None, None, -3]), JSON)
    got = sorted((r.start, -1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in shards.read_digests(spark, folder).collect())
    assert [i for _, i, _ in got] == [-1, -1, -3, 5, 5]
    assert [a for a, _, _ in got] == [0, *np.cumsum([n for _, _, n in got])[:-1].tolist()]
    assert shards.read_digests(spark, shards.write_tokens(docs(spark, [], []), JSON)).count() == 0
    held = [[1 << 63, 5, (1 << 60) - 1, 1 << 60], [], [7] * 5000]
    rows = [(i, len(v), np.array(v, "<u8").tobytes()) for i, v in enumerate(held)]
    folder = shards.write_ids(spark.createDataFrame(rows, "doc_id long, n_tokens long, ids binary"))
    assert {r.doc_id: [v % (1 << 64) for v in r.ids] for r in shards.read_tokens(spark, folder).collect()} == dict(enumerate(held))


def test_a_shard_that_breaks_off_is_an_error(spark, tmp_path):
    folder = shards.write_tokens(docs(spark, ["one two three"], [1]), JSON, folder=f"file://{tmp_path}/t")
    (file,) = (tmp_path / "t/shards").glob("*.s8b")
    file.write_bytes(file.read_bytes()[:-3])
    with pytest.raises(Exception, match="not a whole shard"):
        shards.read_digests(spark, folder).collect()


def test_a_stretch_of_blocks_may_end_inside_a_document(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(shards, "CODED", 2048)
    from pyarrow import fs

    where, rng = fs.LocalFileSystem(), np.random.default_rng(3)
    held = [rng.integers(0, 50_000, n).astype(np.uint64) for n in (10, 5000, 0, 2038, 2048, 1, 9000)]
    shard = shards._Shard(where, f"{tmp_path}/a/x.s8b")
    for i, v in enumerate(held):
        shard.add(i, v)
    shard.close()
    reader, got = shards._Reader(where, f"{tmp_path}/a/x.s8b"), {}
    for doc, _, ids, _ in reader.documents():
        got.setdefault(doc, []).extend(ids.tolist())
    assert got == {i: v.tolist() for i, v in enumerate(held)}


def plain_clusters(rows, count, rounds, size):
    kept = [(i, [int(np.floor(256 * float(c))) for c in v]) for i, v in rows if v is not None and len(v) == size and all(c is not None and np.isfinite(c) for c in v)]
    at = [x for _, x in sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:count]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(at))
    for _ in range(rounds):
        homes = [near(x)[1] for _, x in kept]
        for k in range(len(at)):
            mine = [x for (_, x), h in zip(kept, homes, strict=True) if h == k]
            if mine:
                at[k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    last = [(i, *near(x)[::-1]) for i, x in kept]
    sums = {k: sum(d for _, h, d in last if h == k) for k in range(len(at))}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted((-1 if i is None else i, k, d, sums[k], sum(sums.values()), names[k]) for i, k, d in last)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 3, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, label int, x string, cluster int").repartition(3)


def clustered(spark, rows, **how):
    out = nearest.cluster(vectors(spark, rows), **how).collect()
    return sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in out)


def test_clusters_equal_plain_ones_with_ties_nulls_and_repeats(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice((-0.25, 0.0, 0.25, 0.5)) for _ in range(6)]) for i in range(120)]  # many ties
    rows += [(7, rows[7][1]), (7, [0.1] * 6), (None, [0.3] * 6), (None, [-1.0] * 6), (200, None), (201, []), (202, [1.0] * 5), (203, [0.0] * 5 + [None]), (204, [0.0] * 5 + [float("nan")]), (205, [float("inf")] * 6)]
    assert clustered(spark, rows, size=6, count=9) == plain_clusters(rows, 9, 5, 6)
    few = rows[:4]
    assert clustered(spark, few, size=6, count=9) == plain_clusters(few, 9, 5, 6)
    assert clustered(spark, [], size=6) == []
    huge = [(1, [3e38] * 6), (2, [1.0] * 6), (3, [500_000.0] * 6)]
    assert [r[0] for r in clustered(spark, huge, size=6, count=1)] == [2, 3]


def test_search_is_exact_and_takes_fewer_distances():
    rng = np.random.default_rng(6)
    for spread in (1, 40):
        centres = rng.integers(-200, 200, (50, 1)) * spread + rng.integers(-60, 60, (50, 16))
        x = centres[rng.integers(0, 50, 4000)] + rng.integers(-30, 30, (4000, 16))
        number, distance, taken = nearest.Codebook(centres).nearest(x)
        every = ((x[:, None] - centres) ** 2).sum(2)
        assert (number == every.argmin(1)).all() and (distance == every.min(1)).all()
        assert taken < 4000 * 50 / 4
    same = np.full((6, 4), 5)
    assert nearest.Codebook(same).nearest(same)[0].tolist() == [0] * 6


def plain_middle(doc, t):
    t = t or ""
    h = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return "plain", None, None, t
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    p, m, s = t[:a], t[a:b], t[b:]
    spm = h4 % 100 < 20
    return "spm" if spm else "psm", a, b - a, f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_middles_equal_plain_ones_and_come_back(spark):
    texts = (TEXTS + [t for _, t in brute.corpus()]) * 3
    ids = [None if i % 17 == 0 else i // 2 * 3 for i in range(len(texts))]
    table = docs(spark, texts, ids)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = sorted((repr(d), len(t or ""), *map(repr, plain_middle(d, t)[:3]), sha(plain_middle(d, t)[3]), sha(t or "")) for d, t in zip(ids, texts, strict=True))
    got = sorted((repr(r.doc_id), r.n, repr(r.form), repr(r.prefix_chars), repr(r.middle_chars), r.output_sha256, r.restored_sha256) for r in middle.digests(table).collect())
    assert got == want
    assert {w[2] for w in want} == {"'plain'", "'psm'", "'spm'"}
    made = middle.transform(table)
    assert sorted(sha(bytes(r.output).decode()) for r in made.collect()) == sorted(w[5] for w in want)
    assert sorted(bytes(r.text).decode() for r in middle.restore(made).collect()) == sorted(t or "" for t in texts)
    assert middle.digests(docs(spark, [], [])).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="<>PSM a漢", max_size=60), st.integers(0, 60), st.integers(0, 60), st.sampled_from(["psm", "spm"]))
def test_descriptors_permute_back_whatever_stands_at_the_cuts(text, a, b, form):
    if any(m in text for m in ("<P>", "<S>", "<M>")):
        return
    a, b = sorted((min(a, len(text)), min(b, len(text))))
    out = "".join(middle.streamed(middle.arranged(middle.thirds(len(text), a, b), form), (text, middle.SENTINELS)))
    assert "".join(middle.streamed(middle.restored(out, form), (out, middle.SENTINELS))) == text
