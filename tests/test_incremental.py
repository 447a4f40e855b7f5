import random
from datetime import datetime, timedelta

from terrane.operators.incremental import CommitLog, changed_files, due_files

T0 = datetime(2025, 6, 1)


def tables(spark, files, states, runs):
    f = spark.createDataFrame(files, "id long, scan_root string, kind string, size long, mtime_ns long, content_hash string, indexed_at_ns long, model string, run_id long")
    s = spark.createDataFrame(states, "file_id long, run_id long, size long, mtime_ns long, content_hash string, model string, committed_at timestamp, status string")
    r = spark.createDataFrame(runs, "run_id long, scan_root string, model string, started_at timestamp, status string, file_id long")
    return f, s, r


def run(n, root="r", model="m", status="succeeded"):
    return (n, root, model, T0 + timedelta(days=n), status, 1)


def file(i, h="AA", size=1, mtime=1, at=1, root="r", kind="file"):
    return (i, root, kind, size, mtime, h, at, "x", 5)


def state(i, n, h="aa", size=1, mtime=1, model="m"):
    return (i, n, size, mtime, h, model, T0, "x")


def due(spark, files, states, runs):
    return {r.file_id: r.reason for r in changed_files(*tables(spark, files, states, runs)).collect()}


def test_rules(spark):
    runs = [run(1), run(2), run(3, status="failed"), run(4, status="running"), run(9, root="q")]
    files = [
        file(1), file(2), file(3, h="BB"), file(4), file(5, h=None), file(6, h="", size=2), file(7, h=None, mtime=9), file(8), file(9, kind="dir"), file(10, root="q"), file(11, h="new", at=5), file(11, h="AA", at=2), file(12),
        (None, "r", "file", 1, 1, "AA", 1, "x", 5),
    ]
    states = [
        state(1, 1), state(3, 1), state(4, 1, model="old"), state(5, 1), state(6, 1), state(7, 1), state(8, 3), state(10, 9, h="zz"), state(11, 1),
        state(12, 1, h="zz"), state(12, 2), state(12, 2),
    ]
    assert due(spark, files, states, runs) == {2: "new", 3: "content", 4: "model", 6: "content", 7: "content", 8: "new", 11: "content"}


def test_repeated_runs_and_empty_tables(spark):
    args = ([file(1), file(2)], [state(1, 1)], [run(1), run(1), run(4, status="running"), run(5, status="running", model="n")])
    assert due(spark, *args) == due(spark, *args) == {1: "model", 2: "new"}
    assert due(spark, [], [], []) == {} and due(spark, [file(1)], [], []) == {}
    assert due(spark, [file(1)], [], [run(4, status="running")]) == {1: "new"}


def test_commit_log(spark, tmp_path):
    log = CommitLog(spark, f"file://{tmp_path}/log")
    source = spark.createDataFrame([(i, f"v{i}") for i in range(1, 6)] + [(None, "not committed yet")], "seq long, v string")
    assert log.watermark() is None and log.output() is None
    first = log.begin(source, "seq")
    # records that arrive after the start wait for the next run
    more = source.unionByName(spark.createDataFrame([(6, "v6")], "seq long, v string"))
    assert log.commit(log.read(more, "seq", first), first) and log.watermark() == 5
    # a run that failed before its commit leaves nothing
    lost = log.begin(more, "seq")
    log.read(more, "seq", lost).write.parquet(f"{tmp_path}/log/data/died/output")
    assert log.output().count() == 5
    second = log.begin(more, "seq")
    assert second == lost and log.commit(log.read(more, "seq", second), second)
    # the same run again is told that it was done
    assert not log.commit(log.read(more, "seq", lost), lost)
    assert sorted(r.seq for r in log.output().collect()) == [1, 2, 3, 4, 5, 6]
    third = log.begin(more, "seq")
    assert third.empty and log.read(more, "seq", third).count() == 0
    assert CommitLog(spark, f"file://{tmp_path}/log").watermark() == 6
    assert CommitLog(spark, f"file://{tmp_path}/other").begin(source.limit(0), "seq").empty


def test_a_watermark_never_falls_and_old_commits_can_be_dropped(spark, tmp_path):
    log = CommitLog(spark, f"{tmp_path}/log")
    source = spark.createDataFrame([(i,) for i in range(3)], "seq long")
    for part in (source, source.filter("seq < 1"), source.limit(0)):
        bounds = log.begin(part, "seq")
        assert log.commit({"a": log.read(part, "seq", bounds), "b": part}, bounds) and log.watermark() == 2
    assert log.output("a").count() == 3 and log.last("b").count() == 0
    assert log.vacuum(keep=1) == 2 and log.watermark() == 2 and log.output("a").count() == 0


def test_runs_over_a_log_equal_one_look_at_all_tables(spark, tmp_path):
    """Records come in bit by bit, late, of runs that end later; each run must find what a look at everything finds."""
    rng = random.Random(4)
    files = [file(i, h=rng.choice(["AA", "BB", None])) for i in range(40)]
    status = {1: "succeeded", 2: "failed", 3: "running", 4: "succeeded"}
    states = []
    log = CommitLog(spark, f"{tmp_path}/log")
    for step in range(4):
        for k in range(30):
            when = None if rng.random() < 0.1 else T0 + timedelta(days=step, seconds=k)
            n = rng.randrange(1, 5)
            states.append((rng.randrange(45), n, 1, 1, rng.choice(["aa", "bb"]), rng.choice(["m", "n"]), when, "x"))
        if step == 2:
            status[3] = "succeeded"
        runs = [run(n, status=s) for n, s in status.items()] + [run(9, status="running")]
        tables_ = tables(spark, files, states, runs)
        want = {(r.file_id, r.reason) for r in changed_files(*tables_).collect()}
        assert {(r.file_id, r.reason) for r in due_files(log, *tables_).collect()} == want
        # twice, with nothing new
        assert {(r.file_id, r.reason) for r in due_files(log, *tables_).collect()} == want
    assert log.last("records").count() < len({(s[0], s[1]) for s in states})


def test_a_run_that_another_was_faster_than_gets_its_result(spark, tmp_path):
    log = CommitLog(spark, f"{tmp_path}/log")
    tables_ = tables(spark, [file(1), file(2)], [state(1, 1)], [run(1), run(4, status="running")])
    class Slow(CommitLog):
        def begin(self, source, sequence):
            bounds = super().begin(source, sequence)
            due_files(log, *tables_)
            return bounds
    assert {r.file_id for r in due_files(Slow(spark, log.path), *tables_).collect()} == {2} and log._numbers() == [0]
