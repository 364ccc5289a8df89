"""Snapshot stores: readers beside writers, dead writers, stale leases; the model registry on top."""

import threading
import time
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmart.operators import policy
from quillmart.sources import simulated, tables, writers
from quillmart.sources.models import COLD, Models, Refused
from quillmart.sources.snapshots import Conflict, Snapshots


def rows(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v int")


def test_readers_never_fail_beside_writers(spark, tmp_path):
    """Two tables that change together are seen together, in every read, while one of them is set anew each time."""
    store = Snapshots(spark, f"{tmp_path}/s")
    store.change(lambda at: {"a": ("set", rows(spark, 0)), "b": ("add", rows(spark, 0))})
    stop, seen = threading.Event(), []

    def read():
        mine = Snapshots(spark, f"{tmp_path}/s")
        while not stop.is_set():
            at = mine.version()
            a, b = mine.read("a", at=at).first().v, mine.read("b", at=at).agg(F.max("v"), F.count("*")).first()
            seen.append((at.number, a, b[0], b[1]))

    def write(k):
        mine = Snapshots(spark, f"{tmp_path}/s")

        def work(at):
            n = mine.read("a", at=at).first().v + 1
            return {"a": ("set", rows(spark, n)), "b": ("add", rows(spark, n))}

        mine.change(work)

    with ThreadPoolExecutor(4) as pool:
        readers = [pool.submit(read) for _ in range(2)]
        list(pool.map(write, range(6)))
        stop.set()
        [r.result() for r in readers]
    assert all(a == b == number - 1 and n == number for number, a, b, n in seen) and len(seen) > 4
    assert store.read("a").first().v == 6 and store.version().number == 7


def test_a_dead_writer_blocks_nobody_beyond_its_lease(spark, tmp_path):
    store = Snapshots(spark, f"{tmp_path}/s", lease=1.0)
    store.files.create("leases/000000000001", "a writer that is gone")
    store.write(rows(spark, 99))  # and what it had written
    began = time.monotonic()
    with pytest.raises(TimeoutError):
        with store.turn(wait=0.3):
            pass
    store.change(lambda at: {"t": ("add", rows(spark, 1))})
    assert 0.9 < time.monotonic() - began < 20
    assert [r.v for r in store.read("t").collect()] == [1] and store.version().fence >= 2


def test_a_slow_writer_renews_and_a_stale_one_is_refused(spark, tmp_path):
    store = Snapshots(spark, f"{tmp_path}/s", lease=0.6)
    with store.turn() as held:
        time.sleep(1.5)
        with pytest.raises(TimeoutError), store.turn(wait=0.5):
            pass
        assert held.check() > 1
        base = store.version()
        held._over.set()  # stops giving signs of life
        store.change(lambda at: {"t": ("add", rows(spark, 1))})
        with pytest.raises(Conflict, match="taken over"):
            store.commit(base, {"t": [store.write(rows(spark, 2))]}, held)
    assert [r.v for r in store.read("t").collect()] == [1]
    with store.turn() as held:
        with pytest.raises(Conflict, match="another writer"):
            store.commit(base, {"t": []}, held)


def test_work_is_asked_again_after_a_conflict(spark, tmp_path):
    store, asked = Snapshots(spark, f"{tmp_path}/s"), []

    def work(at):
        asked.append(at.number)
        if len(asked) == 1:  # somebody without a lease
            store.files.create("versions/000000000001", '{"fence": 0, "tables": {}}')
        return {"t": ("add", rows(spark, at.number))}

    assert store.change(work).number == 2 and asked == [0, 1]
    assert [r.v for r in store.read("t").collect()] == [1]
    assert store.change(lambda at: {}).number == 2
    with pytest.raises(ZeroDivisionError):
        store.change(lambda at: 1 / 0)
    assert store.change(lambda at: {"t": ("add", rows(spark, 5))}).number == 3


def test_compaction_and_expiry(spark, tmp_path):
    store = Snapshots(spark, f"{tmp_path}/s")
    for i in range(4):
        store.change(lambda at, i=i: {"t": ("add", rows(spark, i))})
    orphan = store.write(rows(spark, 9))
    assert store.compact("t", above=5).number == 4
    assert store.compact("t", above=3).number == 5
    old = store.version(3)
    assert store.read("t", at=old).count() == 3
    store.expire(keep=2)
    assert len(store.files.names("versions")) == 2 and len(store.files.names("data")) == 6
    assert sorted(r.v for r in store.read("t").collect()) == [0, 1, 2, 3] and store.read("t", at=store.version(4)).count() == 4
    store.expire(keep=1, orphans_after=0)
    assert len(store.files.names("data")) == 1 and orphan not in store.files.names("data")
    assert store.read("none", "v int").count() == 0


def test_insert_of_an_empty_batch_makes_no_version(spark, tmp_path):
    store = Snapshots(spark, f"{tmp_path}/s")
    assert writers.insert_new(rows(spark), store, "t", ["v"]) == 0 and store.version().number == 0


@pytest.fixture(scope="module")
def log(spark):
    panel = tables.panel(tables.Tables(spark, "/root/testdata/sf0.001"))
    return simulated.log(panel, simulated.World(seed=2)).where(F.col("problem") == "차별화").cache()


def test_models_are_promoted_by_rule_and_rolled_back(spark, tmp_path, log):
    models, context = Models(spark, f"{tmp_path}/m"), ["x4"]
    arms = ["매장 리뉴얼", "신메뉴 출시", "배달채널 확대"]
    assert not models.load("차별화", context, arms).active
    learned = policy.Bandit.learn(log, context, arms)
    for v in ("v1", "v2", "backfill-v1"):
        models.save("차별화", v, learned)
    with pytest.raises(Refused, match="exists"):
        models.save("차별화", "v1", learned)
    assert models.latest("차별화") == "backfill-v1" and models.latest("관찰") is None
    how = {"approved_by": "somebody", "log": log, "context": context, "arms": arms}
    for version, change, reason in (("v1", {"approved_by": ""}, "approval"), ("backfill-v1", {}, "shadow"), ("v9", {}, "candidate"), ("v1", {"log": log.limit(50)}, "rows"), ("v1", {"arms": [*arms, "none"]}, "support"), ("v1", {"expected": "v0"}, "nothing is active")):
        with pytest.raises(Refused, match=reason):
            models.promote("차별화", version, **(how | change))
    with pytest.raises(Refused, match="before"):
        models.rollback("차별화", approved_by="somebody")
    assert models.promote("차별화", "v1", **how) == ""
    got = models.load("차별화", context, arms)
    assert got.active and got.version == "v1" and all(np.array_equal(got.model.a[a], learned.a[a]) and np.array_equal(got.model.b[a], learned.b[a]) for a in arms)
    for other in ((context, arms[::-1]), (context, arms[:2]), (["x4", "x5"], arms)):
        cold = models.load("차별화", *other)
        assert not cold.active and cold.version == COLD and len(cold.model.b[other[1][0]]) == len(other[0]) + 1
    with pytest.raises(Refused, match="before"):
        models.rollback("차별화", approved_by="somebody")
    assert models.promote("차별화", "v2", **how, expected="v1") == "v1" and models.load("차별화", context, arms).version == "v2"
    with pytest.raises(Refused, match="v2 is active"):
        models.promote("차별화", "v1", **how, expected="v1")
    assert models.rollback("차별화", approved_by="somebody") == "v1" and models.load("차별화", context, arms).version == "v1"
    assert models.rollback("차별화", approved_by="somebody") == "v1"
    assert [r.kind for r in models.store.read("active").orderBy("n").collect()] == ["promotion", "promotion", "rollback"]


def test_of_two_promotions_from_one_state_one_is_refused(spark, tmp_path, log):
    arms = ["매장 리뉴얼", "신메뉴 출시", "배달채널 확대"]
    models = Models(spark, f"{tmp_path}/m")
    for v in ("v1", "v2"):
        models.save("차별화", v, policy.Bandit.learn(log, ["x4"], arms))

    def promote(v):
        try:
            return Models(spark, f"{tmp_path}/m").promote("차별화", v, approved_by="x", log=log, context=["x4"], arms=arms, expected="")
        except Refused as e:
            return str(e)

    with ThreadPoolExecutor(2) as pool:
        got = list(pool.map(promote, ("v1", "v2")))
    assert sorted(x == "" for x in got) == [False, True] and any("is active" in x for x in got)
