"""Keyed state held against plain loops, with files in any order and cut into any batches."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmart.streaming import keyed, windows

START = dt.datetime(2024, 1, 1)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def streamed(spark, folder, batches, schema):
    """A stream that reads one batch a file, in the order given."""
    import os

    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/part{i}")
        name = next(f for f in os.listdir(f"{folder}/part{i}") if f.endswith(".parquet"))
        os.makedirs(f"{folder}/in", exist_ok=True)
        os.rename(f"{folder}/part{i}/{name}", f"{folder}/in/{i:03d}.parquet")
        os.utime(f"{folder}/in/{i:03d}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return windows.files(spark, f"{folder}/in", "*.parquet", schema)


def stale_by_hand(rows, limits, mark):
    found, jobs = set(), {}
    for job, when, state in rows:
        jobs.setdefault(job, []).append((when, state))
    for job, events in jobs.items():
        events = [e for e in sorted(events) if e[0] <= mark]
        for i, (when, state) in enumerate(events):
            if state not in limits:
                continue
            deadline = when + dt.timedelta(minutes=limits[state])
            if deadline <= mark and (i + 1 == len(events) or events[i + 1][0] > deadline):
                found.add((job, state, when, deadline))
    return found


JOB = "job string, ts timestamp, state string"
LIMITS = {"queued": 30, "running": 60}


def found(spark, folder, batches, delay="20 minutes"):
    s = streamed(spark, folder, batches, JOB)
    rows = keyed.run(keyed.stale(s, "job", "ts", F.col("state"), LIMITS, delay), "stale").collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


def test_jobs_fail_without_a_row_of_their_own(spark, tmp_path):
    rows = [("waits", at(0), "queued"), ("runs", at(0), "queued"), ("runs", at(10), "running"), ("done", at(5), "queued"), ("done", at(35), "running"), ("done", at(40), "done"), ("late", at(1), "queued")]
    batches = [rows, [("late", at(31), "running")], [("clock", at(60), "done")], [("clock", at(95), "done")]]
    # watermark 75: the running ones' time was up at 70; "late" moved on at its deadline and has until 91
    assert found(spark, str(tmp_path), batches) == {("waits", "queued", at(0), at(30)), ("runs", "running", at(10), at(70))}


@pytest.mark.parametrize("cut", [1, 5])
def test_any_cut_into_batches_gives_the_same(spark, tmp_path, cut):
    r = np.random.default_rng(4)
    rows = [(f"j{r.integers(8)}", at(float(m) + 0.000217), str(r.choice(["queued", "running", "done"]))) for m in np.sort(r.uniform(0, 900, 120))]
    rows += [rows[7], (None, at(3), "queued"), (None, at(4), "done"), ("odd", at(5), None)]
    # moved by less than the delay, so none is late
    moved = sorted(rows, key=lambda x: x[1] + dt.timedelta(minutes=float(r.uniform(0, 15))))
    size = -(-len(moved) // cut)
    batches = [moved[i : i + size] for i in range(0, len(moved), size)]
    newest = max(x[1] for x in rows)
    mark = (newest - dt.timedelta(minutes=20)).replace(microsecond=(newest.microsecond // 1000) * 1000)
    assert found(spark, str(tmp_path), batches) == stale_by_hand([x for x in rows if x[2] is not None], LIMITS, mark)


def test_no_event_and_late_events(spark, tmp_path):
    batches = [[("a", at(0), "queued")], [("b", at(200), "done")], [("b", at(205), "done")], [("a", at(10), "done"), ("b", at(210), "done")]]
    # when the last event of "a" comes, its time has been passed in a batch before
    assert found(spark, str(tmp_path / "x"), batches) == {("a", "queued", at(0), at(30))}
    assert found(spark, str(tmp_path / "y"), [[]]) == set()


LOG = "arm string, reward double, x double"


@pytest.mark.parametrize("cut", [1, 4])
def test_models_after_every_batch(spark, tmp_path, cut):
    r = np.random.default_rng(1)
    rows = [(str(r.choice(["a", "a", "a", "b", "c"])), float(r.normal()), float(r.normal())) for _ in range(200)]
    rows += [(None, 1.0, 2.0), ("a", None, 1.0), ("b", 1.0, None)]
    size = -(-len(rows) // cut)
    batches = [rows[i : i + size] for i in range(0, len(rows), size)]
    updates = keyed.run(keyed.arm_models(streamed(spark, str(tmp_path), batches, LOG), ["x"], 0.5), "models")
    assert updates.where("arm = 'a'").count() == cut
    got = {m.arm: m for m in keyed.latest_models(updates).collect()}
    known = [x for x in rows if x[1] is not None and x[2] is not None]
    for arm in ("a", "b", "c", None):
        z = np.array([[1.0, x[2]] for x in known if x[0] == arm])
        y = np.array([x[1] for x in known if x[0] == arm])
        assert got[arm].n == len(y) and got[arm].a == pytest.approx((z.T @ z).ravel()) and got[arm].b == pytest.approx(z.T @ y)
        assert got[arm].theta == pytest.approx(np.linalg.solve(z.T @ z + 0.5 * np.eye(2), z.T @ y))
    assert spark.conf.get(keyed.STORE) != keyed.ROCKS
