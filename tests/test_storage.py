"""Committed state: whole versions only, one writer at a time, nothing between data and commit."""

import pytest

from callscope.sources import storage


def test_commits_are_numbered_and_whole(spark, tmp_path):
    root = f"file://{tmp_path}/state"
    assert storage.latest(spark, root) == (0, {})
    with pytest.raises(FileNotFoundError):
        storage.read_current(spark, root)
    storage.swap_in(spark.range(3), root, "a", note="ü")
    before = storage.read_current(spark, root)
    storage.swap_in(spark.range(5), root, "b")
    # A reader that opened the state before the swap still has its version.
    assert before.count() == 3 and storage.read_current(spark, root).count() == 5
    number, says = storage.latest(spark, root)
    assert number == 2 and "note" not in says


def test_of_two_writers_one_gets_through(spark, tmp_path):
    root = f"file://{tmp_path}/state"
    storage.swap_in(spark.range(1), root, "a")
    number, _ = storage.latest(spark, root)
    storage.swap_in(spark.range(2), root, "b", number)
    with pytest.raises(storage.Conflict):
        storage.swap_in(spark.range(9), root, "c", number)
    assert storage.read_current(spark, root).count() == 2 and storage.latest(spark, root)[0] == 2


def test_a_failure_between_data_and_commit_changes_nothing(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/state"
    storage.swap_in(spark.range(4), root, "a")
    with monkeypatch.context() as m:
        m.setattr(storage, "commit", lambda *a: (_ for _ in ()).throw(OSError("stopped")))
        with pytest.raises(OSError):
            storage.swap_in(spark.range(9), root, "b")
    assert storage.read_current(spark, root).count() == 4 and storage.latest(spark, root)[0] == 1
    storage.swap_in(spark.range(9), root, "b")
    assert storage.read_current(spark, root).count() == 9
