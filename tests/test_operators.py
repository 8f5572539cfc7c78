from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lodestore.operators import gates, graph, ledger, resolution, sync
from lodestore.operators.components import connected_components
from lodestore.plans import graphs
from lodestore.sources import mirror
from lodestore.streaming import spool


def test_components_small_and_star_rounds_agree(spark):
    edges = [(i, i + 1) for i in range(0, 50)] + [(100, 101), (101, 100), (7, 7), (200, 100)] + [(300, x) for x in range(301, 320)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(4)
    want = {n: 0 for n in range(51)} | {100: 100, 101: 100, 200: 100} | {n: 300 for n in range(300, 320)}
    for most in (10**6, 0):
        assert {r.node: r.component for r in connected_components(df, one_task=most).collect()} == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_all_order_lines_equal_brute_force(spark, tmp_path):
    lines = [(o, s, p, n, 1.0, 0.0) for o, parts in ((1, [(1, 10), (2, 11)]), (2, [(2, 12)]), (3, [(3, 13), (4, 14)]), (4, [(9, 10)])) for n, (s, p) in enumerate(parts)]
    orders = [(1, 7, "1-URGENT"), (2, 8, "5-LOW"), (3, 9, "2-HIGH"), (4, 6, "5-LOW")]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_partkey long, l_linenumber int, l_quantity double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    customer = {o: c for o, c, _ in orders}
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for o, s, *_ in lines:
        a, b = find(s * 2), find(customer[o] * 2 + 1)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in graphs.trade_components(spark, str(tmp_path)).collect()}
    assert got == {x: find(x) for x in root} and len(set(got.values())) == 3
    sizes = {r.component: r.members for r in graphs.trade_component_sizes(spark, str(tmp_path)).collect()}
    assert sizes == Counter(got.values())


def test_unsupported_edges_of_all_orders_equal_brute_force(spark, sf):
    li, o, part = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("lineitem", "orders", "part"))
    brand = {r.p_partkey: r.p_brand for r in part.collect()}
    known, held = {r.o_orderkey for r in o.collect()}, defaultdict(set)
    for r in li.collect():
        if r.l_orderkey in known:
            held[r.l_orderkey].add(r.l_partkey)
    want = {(a, b) for x in held.values() for a in x for b in x if a < b and (a not in brand or b not in brand or brand[a] != brand[b])}
    got = [(r.a, r.b) for r in graphs.unsupported_edges_all(spark, sf).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_gaps_worked_example(spark):
    df = spark.createDataFrame([("r", s) for s in (0, 1, 2, 6, 7, 7)], "run_id string, seq long")
    assert [tuple(r) for r in ledger.gaps(df).collect()] == [("r", 3, 5)]


def test_bands(spark):
    rows = [(0.8, 0.6, 0.6), (0.8, 0.4, 0.4), (0.6, 0.1, 0.1), (0.1, 0.1, 0.8), (None, None, 0.1), (0.7, 0.5, 0.0)]
    df = spark.createDataFrame(rows, "o double, c double, t double")
    got = [r.d.mode for r in df.select(resolution.decide(F.col("o"), F.col("c"), F.col("t"), 0.7, 0.5).alias("d")).collect()]
    assert got == ["attach", "fork-signal", "ambiguous-fork", "blur-duplicate", "new", "attach"]


def test_counters_converge_in_any_order(spark):
    rows = [("k", "w1", 2), ("k", "w2", 3), ("k", "w1", 1)]
    for order in (rows, rows[::-1], rows + rows):
        df = spark.createDataFrame(order, "id string, writer_id string, count long")
        assert sync.grow_only(df, ["id"]).first()["count"] == 5


def test_cycles_have_no_end(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (10, 11), (11, 12)], "src long, dst long")
    got = {r.src: (r.end, r.cyclic) for r in graph.chain_ends(df).collect()}
    assert got[10] == (12, False) and got[11] == (12, False) and all(got[i] == (None, True) for i in (1, 2, 3))


def test_shell_words():
    assert gates.shell_words('git "push  x" --force') == ["git", "push  x", "--force"]
    assert gates.shell_words("a&&b # c\nd") == ["a", "&&", "b", "\n", "d"]
    assert gates.shell_words("git \\\npush a#b") == ["git", "push", "a#b"]
    assert gates.shell_words("x ''") == ["x", ""]


def test_seed_patterns(spark):
    cases = [
        (gates.shell_words("cd x && git push --force origin main"), ["git", "push", "--force"]),
        (["--force"], []),
        ([], []),
        (["--force", "rm"], ["--force", "rm"]),
        (["ls", ";", "a", "b", "c"], ["a", "b"]),
        (["x", "-1", "y", "|", "p", "q", "r"], ["x", "-1"]),
        (["a"] * 20 + ["-v"], ["a"] * 12),
    ]
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t array<string>").select("i", gates.seed_pattern(F.col("t")).alias("p"))
    assert {r.i: r.p for r in got.collect()} == {i: p for i, (_, p) in enumerate(cases)}


def test_actions_meet_patterns(spark):
    a = spark.createDataFrame([(1, "Bash:git push --force origin"), (2, "git status"), (3, "echo # git push --force")], "action_id long, raw string")
    a = a.select("action_id", gates.parse_actions(F.col("raw")).alias("p")).select("action_id", "p.*")
    p = spark.createDataFrame([("s", "bash", ["push", "--force"]), ("t", None, ["git"]), ("u", None, [])], "stage_id string, tool string, tokens array<string>")
    assert {tuple(r) for r in gates.matches(a, p).collect()} == {(1, "s"), (1, "t"), (2, "t")}


def test_spool_replays_once_and_stops_at_a_newer_version(spark, tmp_path):
    lines = ['{"v":1,"runId":"r","seq":0,"kind":"ask"}', '{"v":1,"runId":"r","seq":1,"kind":"read"}', "nonsense"]
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(f"{tmp_path}/in")
    for _ in range(2):
        spool.fold_once(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state")
        spark.createDataFrame([(x,) for x in lines[:1]], "value string").write.mode("append").text(f"{tmp_path}/in")
    assert spool.folded(spark, f"{tmp_path}/out").count() == 2
    more = [f'{{"v":{v},"runId":"r","seq":{n},"kind":"ask"}}' for n, v in ((2, 1), (3, 2), (4, 1))]
    spark.createDataFrame([(x,) for x in ["{", *more]], "value string").coalesce(1).write.mode("append").text(f"{tmp_path}/in")
    assert spool.fold_once(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state") == {"malformed": 1, "future": 1}
    assert sorted(r.seq for r in spool.folded(spark, f"{tmp_path}/out").collect()) == [0, 1, 2]
    spool.fold_once(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/other")
    assert sorted(r.seq for r in spool.folded(spark, f"{tmp_path}/out").collect()) == [0, 1, 2]
    bad = spark.createDataFrame([('{"v":2,"runId":"r","seq":2,"kind":"ask"}',), ("{",)], "value string")
    assert [r.status for r in spool.parse(bad).collect()] == ["future", "malformed"]


def test_mirror_generations(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string")
    path = str(tmp_path / "m")
    assert mirror.write_mirror(df, path, 1) == "written"
    assert mirror.write_mirror(df, path, 2) == "unchanged"
    assert mirror.write_mirror(df.limit(1), path, 0) == "stale"
    assert mirror.write_mirror(df.limit(1), path, 1) == "conflict"
    twice = df.union(df)
    assert mirror.table_digest(twice) != mirror.table_digest(df.limit(0)) and mirror.table_digest(df) == mirror.table_digest(df.orderBy(F.col("id").desc()))
    state, rows = mirror.read_mirror(spark, path, "id long, x string", 1)
    assert state == "fresh" and rows.count() == 2
    assert mirror.read_mirror(spark, str(tmp_path / "none"), "id long")[0] == "missing"


def test_top_thread_is_the_largest_component(spark):
    c = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 4), (5, 4), (6, 4)], "node long, component long")
    assert sorted(r.node for r in graph.top_thread(c).collect()) == [4, 5, 6]
    assert graph.top_thread(c.where("component = 3")).count() == 0


def test_circles_of_pointers(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 6), (7, 8), (8, 7)], "src long, dst long")
    assert {tuple(r) for r in graph.on_cycles(links).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)}
    assert graph.on_cycles(links.limit(0)).count() == 0


def test_acyclic_graft_drops_the_edge_that_closes_a_circle(spark):
    e = spark.createDataFrame([(10, 1, 2, 1), (11, 2, 3, 2), (12, 3, 1, 3), (13, 4, 1, 9)], "id long, src long, dst long, created_at long")
    assert sorted(r.id for r in sync.acyclic(e).collect()) == [10, 11, 13]


def test_auc_equals_pairs(spark):
    import random

    from lodestore.operators import evaluation

    rng = random.Random(2)
    rows = [(round(rng.random(), 2), rng.random() < 0.4) for _ in range(200)]
    wins = [1.0 if a > b else 0.5 if a == b else 0.0 for a, y in rows if y for b, z in rows if not z]
    got = evaluation.auc(spark.createDataFrame(rows, "s double, y boolean"), "s", F.col("y"), buckets=7).first()
    assert abs(got.auc - sum(wins) / len(wins)) < 1e-12
    assert evaluation.auc(spark.createDataFrame([(1.0, True)], "s double, y boolean"), "s", F.col("y")).first().auc is None


def test_quotas_fill_the_sample(spark):
    from lodestore.operators import evaluation

    t = spark.createDataFrame([("a", 1), ("b", 50), ("c", 49)], "stratum string, size long")
    got = {r.stratum: r.quota for r in evaluation.quotas(t, 10).collect()}
    assert sum(got.values()) == 10 and got["a"] <= 1 and got["b"] == 5
    assert sum(r.quota for r in evaluation.quotas(t, 1000).collect()) == 100


def test_search_widths_and_blocks(spark, monkeypatch):
    from lodestore.operators import retrieval

    v = spark.createDataFrame([(1, 1, [1.0, 0.0, 9.0]), (2, 1, [0.6, 0.8]), (3, 2, [0.0, 1.0]), (4, 2, None), (5, 3, [0.0, 0.0])], "observation_id long, concept_id long, embedding array<float>")
    q = spark.createDataFrame([(i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(7)], "query_id long, embedding array<float>")
    want = {(i, 1, 1 if i % 2 else 2) for i in range(7)} | {(i, 2, 3) for i in range(0, 7, 2)}
    for block in (4096, 2):
        monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
        assert {(r.query_id, r.concept_id, r.observation_id) for r in retrieval.best_observations(v, q).collect()} == want


def test_segments_cut_at_paragraphs_sentences_and_spaces():
    from lodestore.functions.segments import segments

    assert segments("a b c.\n\nd e f.", 4) == ["a b c.", "d e f."]
    assert segments("a b c. d e f.", 4) == ["a b c.", "d e f."]
    assert segments("a b. c d. e f.", 7) == ["a b.\nc d.", "e f."]
    assert segments("a b c d e f g h", 3) == ["a b c", "d e f", "g h"]
    assert segments("abcdefghij k", 5, ".") == ["abcde", "fghij", "k"]


def test_segments_fit_and_keep_all_words():
    from lodestore.functions.segments import Measured, segments

    text = "One two three. Four five six!\n\n" + "word " * 40 + "\n\nEnd."
    parts = segments(text, 10)
    assert all(len(Measured(p).begin) <= 10 for p in parts) and " ".join(parts).split() == text.split()
    assert segments(text, None) == [text.strip()] and segments(" ", 5) == [] and segments("x" * 30, 1, ".") == ["x"] * 30


def test_lifecycle_changes(spark):
    from lodestore.operators import lifecycle

    obs = spark.createDataFrame([(1, "A", " b ", 5), (2, "A", "a", 3), (3, "A", "b", 7), (4, "B", "x", 1)], "observation_id long, concept_id string, content string, created_at long")
    body = {r.concept_id: (r.body, r.title) for r in lifecycle.synthesis(obs).collect()}
    assert body == {"A": ("a\nb", "a"), "B": ("x", "x")}
    moved, refused = lifecycle.detach(obs, spark.createDataFrame([(1, "C"), (4, "C")], "observation_id long, to_concept string"))
    assert {r.observation_id: r.concept_id for r in moved.collect()} == {1: "C", 2: "A", 3: "A", 4: "B"} and refused.first().observation_id == 4
    rat = spark.createDataFrame([(1, "s", "approve", 1), (2, "s", "retire", 2), (3, "s", "approve", 3), (4, "t", "retire", 1)], "id long, subject_concept_id string, verdict string, created_at long")
    assert {r.id for r in lifecycle.illegal_verdicts(rat).collect()} == {3, 4}
    con = spark.createDataFrame([("s", "active", "*"), ("t", "active", "c")], "concept_id string, status string, circle string")
    assert [r.concept_id for r in lifecycle.skeleton(con, rat, "c").collect()] == ["s"]
    ws = spark.createDataFrame([("w", 1, "i", "open"), ("w", 2, "i", "done"), ("v", 1, "j", "open")], "slug string, at long, item string, state string")
    assert {r.slug: (r.open_items, r.may_close) for r in lifecycle.workstreams(ws).collect()} == {"w": ([], True), "v": (["j"], False)}


def test_export_and_manifest(spark, tmp_path):
    from lodestore.sources import export

    con = spark.createDataFrame([(1, "Beta", "mail x@y.org now. More."), (1, "Alpha", "first. second."), (2, "Solo", None)], "component long, title string, body string")
    t = export.topics(con)
    assert {r.topic for r in t.collect()} == {"alpha-1", "solo-2"}
    assert export.chunks(t).where("topic = 'alpha-1'").count() == 2 and t.where("markdown like '%redacted-email%'").count() == 1
    export.write(t, str(tmp_path / "md"))
    m = export.manifest(spark, str(tmp_path / "md" / "topics"))
    assert export.unverified(spark, str(tmp_path / "md" / "topics"), m).count() == 0
    assert export.unverified(spark, str(tmp_path / "md" / "topics"), m.selectExpr("file", "'0' as sha256", "bytes")).count() == m.count()


def test_equal_slugs_of_a_circle_are_told_apart_by_their_ids(spark):
    from lodestore.operators import publishing

    def new(rows):
        t = spark.createDataFrame(rows, "concept_id string, circle string, slug string")
        got = {r.concept_id: r.new for r in publishing.renamed_slugs(t).collect()}
        return [got[i] for i, *_ in rows]

    assert new([("1", "c", "foo"), ("2", "c", "foo"), ("3", "c", "foo-2"), ("4", "d", "foo"), ("5", "c", "foo-2-3")]) == ["foo", "foo-2", "foo-2-3", "foo", "foo-2-3-5"]
    long = "x" * 50 + "-" + "y" * 9
    a, b = new([("0123456789", "c", long), ("1123456789", "c", long)])
    assert a == long and b == "x" * 50 + "-11234567" and len(b) <= 60
    assert new([("7", "c", "..."), ("8", "c", "!!")]) == ["", "8"]
