import json
import os

import pytest

from terrane import journal as J
from terrane.errors import EngineError, IncompatibleSchema
from terrane.snapshot import Store


@pytest.fixture
def log(tmp_path):
    return J.Journal(str(tmp_path / "journal"))


def run(log):
    done = []
    J.recover(log, lambda a, b: done.append(("rename", a, b)), lambda p: done.append(("remove", p)))
    return done


def test_rename_that_never_began(log, tmp_path):
    (tmp_path / "a").write_text("x")
    log.begin("rename", str(tmp_path / "a"), str(tmp_path / "b"))
    assert run(log) == [] and log.entries()[0].state == "rolled_back" and run(log) == []


@pytest.mark.parametrize("state", ["prepared", "fs_applied"])
def test_rename_that_stopped_half_way(log, tmp_path, state):
    (tmp_path / "b").write_text("x")
    log.advance(log.begin("rename", str(tmp_path / "a"), str(tmp_path / "b")), state)
    assert run(log) == [("rename", str(tmp_path / "a"), str(tmp_path / "b"))] and log.entries()[0].state == "done"


@pytest.mark.parametrize("state", ["prepared", "fs_applied", "db_applied"])
def test_removal_that_stopped_half_way(log, tmp_path, state):
    path = str(tmp_path / "a")
    stage = J.tombstone(path)
    os.mkdir(stage)
    log.advance(log.begin("remove", path, stage_path=stage), state)
    assert run(log) == ([] if state == "db_applied" else [("remove", path)])
    assert log.entries()[0].state == "done" and not os.path.exists(stage)


def test_what_could_lose_files_is_refused(log, tmp_path):
    (tmp_path / "a").write_text("x")
    (tmp_path / "b").write_text("y")
    log.begin("rename", str(tmp_path / "a"), str(tmp_path / "b"))
    with pytest.raises(EngineError, match="ambiguous"):
        run(log)
    with pytest.raises(EngineError):
        J.delete(str(tmp_path / "a"), str(tmp_path / "b"))
    assert (tmp_path / "a").exists()


def test_versions(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    assert store.current() is None
    one = store.publish({"a": spark.range(3), "b": spark.range(1)})
    two = store.publish({"a": spark.range(5)}, one, {"r": 7})
    assert store.read("a").count() == 5 and store.read("b").count() == 1 and store.read("a", one).count() == 3
    assert store.current() == two and two.batches == {"r": 7}
    with pytest.raises(RuntimeError):
        store.publish({"a": spark.range(9)}, one)
    assert store.read("a").count() == 5
    store.vacuum(1)
    assert store.read("b").count() == 1
    with open(tmp_path / f"s/versions/{3:020d}", "w") as f:
        json.dump({"number": 3, "tables": {}, "schema": 99}, f)
    with pytest.raises(IncompatibleSchema):
        store.current()


def test_a_change_writes_only_its_own_rows(spark, tmp_path):
    store = Store(spark, str(tmp_path / "parts"))
    rows = lambda *x: spark.createDataFrame(x, "file_id long, v string")
    one = store.publish({"a": rows((1, "x"), (2, "x"), (3, "x")), "b": rows((1, "y"), (2, "y"))})
    two = store.publish({}, one, added={"a": rows((2, "new"), (4, "new"))}, replaced={None: rows((2, "")), ("b",): rows((1, ""))})
    read = lambda n, v: {tuple(r) for r in store.read(n, v, "file_id").collect()}
    assert read("a", one) == {(1, "x"), (2, "x"), (3, "x")} and read("b", one) == {(1, "y"), (2, "y")}
    assert read("a", two) == {(1, "x"), (2, "new"), (3, "x"), (4, "new")} and read("b", two) == set()
    assert [len(two.tables[n]) for n in ("a", "b")] == [2, 1] and two.tables["a"][0] == one.tables["a"][0]
    # a table that is written as a whole needs none of what was replaced before
    three = store.publish({"a": store.read("a", two, "file_id"), "b": store.read("b", two, "file_id")}, two)
    assert three.replaced == [] and read("a", three) == read("a", two) and read("b", three) == set()
    assert store.vacuum(1) == 5 and read("a", three) == {(1, "x"), (2, "new"), (3, "x"), (4, "new")}
