from concurrent.futures import ThreadPoolExecutor

import pytest

from quillmart.llm import queries
from quillmart.llm.common import scratch
from quillmart.llm.shards import Conflict, Run, Store, sharded

DOCS = "doc_id long, text string, _version string, run string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS)


def test_op3_keeps_every_row(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = queries.op3_size_tiered_shards(spark, sf).collect()
    assert sorted((r.doc_id, r.n_bytes) for r in got) == sorted((r.doc_id, len((r.text or "").encode())) for r in docs.collect())
    assert len({r.version for r in got}) == 1


def test_tiers_versions_and_old_readers(spark):
    store = Store(spark, scratch(spark, "store"), target_bytes=1500, least_bytes=400, fan_in=2)
    for i in range(7):
        store.append(frame(spark, [(10 * i + k, "x" * 50) for k in range(6)]))
        store.compact()
        version, runs = store.manifest()
        tiers = [store.tier(r.n_bytes) for r in runs]
        assert len(tiers) == len(set(tiers))  # as a binary counter
        assert sum(r.n_rows for r in runs) == 6 * (i + 1)
        assert all(r.n_shards >= r.n_bytes // 1500 for r in runs)
    rows = store.read()
    assert rows.count() == 42 and rows.select("doc_id").distinct().count() == 42
    assert store.read(1).count() == 6 and store.manifest(3)[0] == 3  # superseded runs are still there
    assert len(runs) == 3


def test_only_one_writer_commits_a_version(spark):
    store = Store(spark, scratch(spark, "store"))
    store.append(frame(spark, [(1, "a")]))
    version, runs = store.manifest()
    done = 0
    for _ in range(6):
        try:
            store.commit(version + 1, [*runs, Run("other", 0, 0, 0)])
            done += 1
        except Conflict:
            pass
    assert done == 1 and len(store.manifest()[1]) == 2


def test_of_writers_at_one_time_one_wins_and_stays(spark):
    store = Store(spark, scratch(spark, "store"))
    store.append(frame(spark, [(1, "a")]))

    def write(i):
        try:
            store._claim(2, f"token{i}")
            return i
        except Conflict:
            return None

    with ThreadPoolExecutor(8) as pool:
        won = [i for i in pool.map(write, range(16)) if i is not None]
    assert len(won) == 1 and store._claimed(2) == f"token{won[0]}"


def test_expired_runs_go_and_the_rest_reads(spark):
    store = Store(spark, scratch(spark, "store"), least_bytes=10, fan_in=2)
    for i in range(5):
        store.append(frame(spark, [(i, "x" * 50)]))
        store.compact()
    before = sorted(r.doc_id for r in store.read().collect())
    assert len(store.expire()) >= 3 and store.expire() == []
    assert sorted(r.doc_id for r in store.read().collect()) == before == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError, match="no rows"):
        store.read(1)


def test_a_failed_write_leaves_the_version_alone(spark):
    store = Store(spark, scratch(spark, "store"))
    store.append(frame(spark, [(1, "a")]))
    with pytest.raises(Exception, match="(?i)no way|raise"):
        store.append(frame(spark, [(2, "b")]).selectExpr("raise_error('no way') as doc_id", "text"))
    assert store.manifest()[0] == 1 and store.read().count() == 1


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "same"), (3, "same"), (None, "x"), (4, "y" * 300_000)]
    store = sharded(frame(spark, rows), scratch(spark, "store"), 5, least_bytes=100, target_bytes=1000, fan_in=2)
    out = store.read().drop("_version")
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == sorted((i or 0, t or "") for i, t in rows)
    empty = sharded(frame(spark, []), scratch(spark, "store"), 3, fan_in=2)
    assert empty.read().count() == 0 and {"doc_id", "text"} <= set(empty.read().columns)
