"""The spool source, the fold, the keyed ledger and the files that are made once."""

import json
import random
import threading

import pytest

from lodestore.sources import commit, mirror
from lodestore.streaming import moments, spool, tail


def line(seq, run="r", v=1, kind="ask", **more):
    return json.dumps({"v": v, "runId": run, "seq": seq, "kind": kind} | more) + "\n"


def seqs(spark, out):
    return sorted(r.seq for r in spool.folded(spark, str(out)).collect())


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    return tmp_path


def fold(spark, at, state="state", version=1):
    return spool.fold_once(spark, str(at / "in"), str(at / "out"), str(at / state), version)


def test_what_is_appended_to_a_file_is_read_and_a_part_of_a_line_waits(spark, folder):
    f = folder / "in/a.jsonl"
    f.write_text(line(0) + line(1) + "nonsense\n\n" + line(2)[:10])
    assert fold(spark, folder) == {"malformed": 1, "future": 0}
    assert seqs(spark, folder / "out") == [0, 1]
    with f.open("a") as more:
        more.write(line(2)[10:] + line(3) + line(1))
    (folder / "in/b.jsonl").write_text(line(9))
    assert fold(spark, folder) == {"malformed": 0, "future": 0}
    assert seqs(spark, folder / "out") == [0, 1, 2, 3, 9]
    assert fold(spark, folder) == {"malformed": 0, "future": 0}


def test_a_file_cut_short_is_read_from_its_start(spark, folder):
    f = folder / "in/a.jsonl"
    f.write_text(line(0) + line(1) + line(2))
    fold(spark, folder)
    f.write_text(line(5))
    fold(spark, folder)
    assert seqs(spark, folder / "out") == [0, 1, 2, 5]


def test_the_stop_before_a_newer_version_lasts_over_batches_until_a_reader_knows_it(spark, folder):
    (folder / "in/a.jsonl").write_text(line(0) + line(1) + line(2, v=2) + line(3))
    assert fold(spark, folder) == {"malformed": 0, "future": 1}
    with (folder / "in/a.jsonl").open("a") as f:
        f.write(line(4) + line(5))
    (folder / "in/b.jsonl").write_text(line(7))
    assert fold(spark, folder) == {"malformed": 0, "future": 0}
    assert seqs(spark, folder / "out") == [0, 1, 7]
    fold(spark, folder, version=2)
    assert seqs(spark, folder / "out") == [0, 1, 2, 3, 4, 5, 7]


def test_a_new_checkpoint_keeps_what_another_folded(spark, folder):
    (folder / "in/a.jsonl").write_text(line(0) + line(1))
    fold(spark, folder)
    (folder / "in/a.jsonl").unlink()
    (folder / "in/b.jsonl").write_text(line(1) + line(2))
    fold(spark, folder, "other")
    assert seqs(spark, folder / "out") == [0, 1, 2]


def test_a_batch_tried_again_repeats_nothing(spark, folder):
    (folder / "state").mkdir()
    (folder / "state/metadata").write_text('{"id":"q"}')
    tries = []

    def write(batch, where):
        tries.append(where)
        batch.write.parquet(where)
        if len(tries) == 1:
            raise RuntimeError("lost")
        return {}

    apply = spool.commit_batches(spark, str(folder / "out"), str(folder / "state"), write)
    batch = spark.createDataFrame([("r", 1, "ask", "ok", None)], spool.RECORD)
    with pytest.raises(RuntimeError):
        apply(batch, 0)
    apply(batch, 0)
    apply(batch, 0)
    assert len(tries) == 2 and seqs(spark, folder / "out") == [1]


def test_stretches_share_lines_out_whatever_their_size(tmp_path):
    from pyarrow import fs

    where, path = fs.LocalFileSystem(), f"{tmp_path}/x"
    text = b"".join(b"y" * n + b"\n" for n in (0, 5, 1, 40, 0, 3, 17))
    (tmp_path / "x").write_bytes(text + b"rest")
    whole = [(0, 0), (1, 5), (7, 1), (9, 40), (50, 0), (51, 3), (55, 17)]
    for step in (1, 2, 7, 30, 500):
        got = []
        with where.open_input_file(path) as f:
            for x in range(0, len(text), step):
                got += [(at, len(line)) for at, line in tail.lines(f, tail.Stretch("x", x, min(x + step, len(text)), 0, len(text)))]
        assert got == whole
    size = len(text) + 4
    assert tail.advanced(where, path, tail._START, size, 1, None)["at"] == len(text)
    assert tail.newer(b'{"v": 1}\n{"a": {"v": 3}, "v": 1}\n["v", 2]\n{"v":2.5}\n', 1) == 42


def test_of_racing_writers_one_creates_the_file(spark, tmp_path):
    won, path = [], f"{tmp_path}/a/x.json"
    racers = [threading.Thread(target=lambda k=k: won.append(k) if commit.create_once(spark, path, str(k)) else None) for k in range(8)]
    for t in racers:
        t.start()
    for t in racers:
        t.join()
    assert len(won) == 1 and commit.text_of(spark, path) == str(won[0]) and commit.names(spark, f"{tmp_path}/a") == ["x.json"]


def test_of_racing_mirrors_of_a_generation_one_learns_of_the_conflict(spark, tmp_path):
    said = []
    frames = [spark.createDataFrame([(k,)], "id long") for k in range(2)]
    racers = [threading.Thread(target=lambda d=d: said.append(mirror.write_mirror(d, str(tmp_path / "m"), 4))) for d in frames]
    for t in racers:
        t.start()
    for t in racers:
        t.join()
    assert sorted(said) == ["conflict", "written"]
    state, rows = mirror.read_mirror(spark, str(tmp_path / "m"), "id long")
    assert state == "fresh" and rows.count() == 1
    for f in (tmp_path / "m/rows").glob("*/part-*"):
        f.write_text('{"id":9}\n')
    for f in (tmp_path / "m/rows").glob("*/.part-*.crc"):
        f.unlink()
    assert mirror.read_mirror(spark, str(tmp_path / "m"), "id long")[0] == "damaged"


def ledger_records():
    rng, rows = random.Random(8), []
    for k in range(30):
        m, t, run = f"m{k}", f"t{k // 2}", f"r{k % 3}"
        if k % 7 != 6:
            for _ in range(rng.randrange(1, 3)):
                rows.append((run, "interception", {"momentId": m, "at": f"a{k}", "toolUseId": rng.choice([t, None]), "circle": rng.choice(["c", None]), "ruleIds": rng.choice([["x", "y"], [], None]), "stageId": None, "disposition": "advised"}))
        for _ in range(rng.randrange(4)):
            rows.append((run, "read", {"momentId": m, "ruleId": rng.choice("xyz"), "readAt": f"2024-01-{rng.randrange(10, 28)}"}))
        if rng.random() < 0.6:
            by = {"momentId": m, "toolUseId": None} if rng.random() < 0.3 else {"momentId": None, "toolUseId": t}
            rows.append((run, "outcome", by | {"outcomeAt": f"2024-01-{rng.randrange(10, 28)}", "outcomeStatus": rng.choice(["ok", "failed", None]), "outcomeSha256": f"s{k}"}))
        if rng.random() < 0.5:
            rows += [(run, "ask", {"momentId": m, "askedAt": "x"})] + [(run, "answer", {"momentId": m, "answer": rng.choice(["followed", "not-followed"]), "answeredAt": "y"}) for _ in range(rng.randrange(3))]
    rows.append(("r0", "outcome", {"momentId": None, "toolUseId": "never", "outcomeAt": "2024-01-11", "outcomeStatus": "ok", "outcomeSha256": "n"}))
    rows.append(("r0", "read", {"momentId": None, "ruleId": None, "readAt": "2024"}))
    rng.shuffle(rows)
    return [line(n, run, 1, kind, **more) for n, (run, kind, more) in enumerate(rows)]


def plain(frame):
    return sorted(json.dumps({k: sorted(v.items()) if isinstance(v, dict) else v for k, v in r.asDict().items()}, sort_keys=True, default=str) for r in frame.collect())


@pytest.mark.parametrize(("seed", "splits"), [(1, 1), (2, 3)])
def test_the_keyed_ledger_equals_the_batch_fold_in_any_order_and_split(spark, folder, seed, splits):
    rows = ledger_records()
    held = spark.createDataFrame([(r.strip(),) for r in rows], "value string")
    want = [plain(f) for f in moments.batch(spool.parse(held).withColumnRenamed("runId", "run_id"))]
    assert {json.loads(w)["state"] for w in want[0]} == {"unopened", "pending", "closed"} and any(json.loads(w)["late_reads"] for w in want[0]) and want[1]
    random.Random(seed).shuffle(rows)
    for k in range(splits):
        with (folder / "in/a.jsonl").open("a") as f:
            f.write("".join(rows[k::splits] + rows[:3]))
        got = moments.run(spark, str(folder / "in"), str(folder / "ledger"))
    assert [plain(f) for f in got] == want


def test_gaps_of_runs_open_shrink_and_split_as_records_come(spark, folder):
    f = folder / "in/a.jsonl"
    f.write_text("".join(line(n) for n in (0, 1, 2, 6, 7)) + line(3, run="q"))
    run = lambda: {r.run_id: (r.last, list(zip(r.low, r.high))) for r in spool.run_gaps(spark, str(folder / "in"), str(folder / "gaps"), str(folder / "gap-state")).collect()}  # noqa: E731, B905
    assert run() == {"r": (7, [(3, 5)]), "q": (3, [(0, 2)])}
    with f.open("a") as more:
        more.write(line(4) + line(2) + line(9) + line(0, run="q"))
    assert run() == {"r": (9, [(3, 3), (5, 5), (8, 8)]), "q": (3, [(1, 2)])}
    assert run() == {"r": (9, [(3, 3), (5, 5), (8, 8)]), "q": (3, [(1, 2)])}
