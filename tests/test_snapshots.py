"""Snapshots of vector stores: stopped changes, several writers, versions and upkeep."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from quillstream.sources.snapshots import SnapshotStore
from tests.test_stores import rows


class Stopped(Exception):
    pass


class Stopping(SnapshotStore):
    """A store that is stopped the first time it comes to a step, or calls something there."""

    def __init__(self, spark, path, step, call=None):
        super().__init__(spark, path)
        self.step, self.call = step, call

    def _step(self, name):
        if name == self.step:
            self.step = None
            if self.call is None:
                raise Stopped
            self.call()


CHANGES = {
    "add": (lambda s, spark: s.add(rows(spark, [(2, "a"), (9, "a"), (9, "c")])), {"a": {"1", "2", "9"}, "b": {"3", "4"}, "c": {"9"}}),
    "delete": (lambda s, spark: s.delete("a", where=F.col("chunk_index") == 1), {"a": {"2"}, "b": {"3", "4"}}),
    "replace": (lambda s, spark: s.replace("a", rows(spark, [(7, "x")])), {"a": {"7"}, "b": {"3", "4"}}),
    "drop": (lambda s, spark: s.drop("a"), {"b": {"3", "4"}}),
    "compact": (lambda s, spark: s.compact(), {"a": {"1", "2"}, "b": {"3", "4"}}),
    "reset": (lambda s, spark: s.reset(), {}),
}
BEFORE = {"a": {"1", "2"}, "b": {"3", "4"}}


def seen(store):
    out = {}
    for r in store.read().collect():
        assert r["embedding"] == [float(r["id"])] * 3
        out.setdefault(r["knowledge_base_id"], set()).add(r["id"])
    return out


def start(spark, path):
    store = SnapshotStore(spark, path)
    store.add(rows(spark, [(1, "a"), (3, "b")]))
    store.add(rows(spark, [(2, "a"), (4, "b"), (5, "b")]))
    store.delete("b", where=F.col("id") == "5")
    assert seen(store) == BEFORE
    return store


@pytest.mark.parametrize("change", CHANGES)
def test_a_change_that_is_stopped_loses_nothing(spark, tmp_path, change):
    """Stopped between any two steps: all is as before, and the change can be made again."""
    work, after = CHANGES[change]
    store = start(spark, str(tmp_path / "v"))
    n = len(store.versions())
    for step in ("written", "staged", "ready", "drafted"):
        stopping = Stopping(spark, store.path, step)
        if change in ("drop", "reset") and step in ("written", "staged") or (change, step) == ("delete", "written"):
            continue
        with pytest.raises(Stopped):
            work(stopping, spark)
        assert seen(store) == BEFORE and len(store.versions()) == n
    work(store, spark)
    assert seen(store) == after and len(store.versions()) == n + 1
    assert store.vacuum(older_than=-1) >= 0 and seen(store) == after and len(store.versions()) == 1


#: What is in view when the first change finds the second one committed before it.
BOTH = {
    ("add", "add"): {"a": {"1", "2", "8", "9"}, "b": {"3", "4"}, "c": {"9"}},
    ("add", "drop"): {"a": {"2", "9"}, "b": {"3", "4"}, "c": {"9"}},
    ("delete", "add"): {"a": {"2", "8", "9"}, "b": {"3", "4"}},
    ("replace", "add"): {"a": {"7"}, "b": {"3", "4"}},
    ("compact", "delete"): {"a": {"2"}, "b": {"3", "4"}},
    ("delete", "compact"): {"a": {"2"}, "b": {"3", "4"}},
    ("add", "reset"): {"a": {"2", "9"}, "c": {"9"}},
    ("drop", "delete"): {"b": {"3", "4"}},
    ("reset", "add"): {},
}


@pytest.mark.parametrize("first,second", BOTH)
def test_two_writers(spark, tmp_path, first, second):
    """The second commits while the first is about to: neither is lost, each is as if alone."""
    # Once right before the snapshot is put in place; adds also before they look for the newest one.
    for step in ("ready", "drafted") if (first, second) == ("add", "add") else ("drafted",):
        store = start(spark, str(tmp_path / step))
        other = (lambda s: s.add(rows(spark, [(8, "a"), (9, "a")]))) if second == "add" else (lambda s: CHANGES[second][0](s, spark))
        racing = Stopping(spark, store.path, step, lambda: other(store))
        CHANGES[first][0](racing, spark)
        assert seen(store) == BOTH[first, second]
        assert store.count() == sum(map(len, BOTH[first, second].values()))


def test_writers_on_other_bases_do_not_work_anew(spark, tmp_path):
    store = start(spark, str(tmp_path / "v"))
    racing = Stopping(spark, store.path, "ready", lambda: store.add(rows(spark, [(9, "z")])))
    staged = []
    inner = racing._stage
    racing._stage = lambda df: staged.append(1) or inner(df)
    racing.add(rows(spark, [(8, "a")]))
    assert len(staged) == 1 and seen(store) == {"a": {"1", "2", "8"}, "b": {"3", "4"}, "z": {"9"}}


def test_many_writers_at_once(spark, tmp_path):
    path = str(tmp_path / "v")
    work = lambda i: SnapshotStore(spark, path).add(rows(spark, [(i, "ab"[i % 2]), (100, "a")]))
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(work, range(8)))
    store = SnapshotStore(spark, path)
    assert seen(store) == {"a": {"0", "2", "4", "6", "100"}, "b": {"1", "3", "5", "7"}}
    assert store.count() == 9 and store.versions() == list(range(1, 9))


def test_versions_stay_readable(spark, tmp_path):
    store = start(spark, str(tmp_path / "v"))
    old = store.versions()[-1]
    store.delete("a", ids=spark.createDataFrame([("1",)], "id string"))
    store.add(rows(spark, [(1, "a")]))
    assert seen(store) == BEFORE and store.read("a", old + 1).count() == 1 and store.read(version=old).count() == 4
    store.drop("a")
    store.add(rows(spark, [(1, "a")]))
    assert store.count("a") == 1 and store.dimension("a") == 3
    store.compact()
    assert len(store.snapshot()["segments"]) == 1 and store.count() == 3


def test_an_add_takes_one_look_at_all_bases(spark, tmp_path):
    """The check of dimensions is one job however many knowledge bases there are."""
    store = SnapshotStore(spark, str(tmp_path / "v"))
    many = rows(spark, [(i, f"kb{i}") for i in range(40)])
    calls, real = [], store.dimension
    store.dimension = lambda kb: calls.append(kb) or real(kb)
    store.add(many)
    bad = rows(spark, [(99, "kb7")]).withColumn("embedding", F.array(F.lit(1.0).cast("float")))
    with pytest.raises(ValueError, match="kb7"):
        store.add(many.unionByName(bad))
    assert not calls and store.count() == 40
