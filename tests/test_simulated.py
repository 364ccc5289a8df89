"""The simulated log: the same at any partitioning, and what estimators recover of its planted truth."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmart.operators import policy
from quillmart.plans.simulations import WORLD
from quillmart.sources import simulated, tables
from quillmart.sources.simulated import Draws, World

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def panel(spark):
    return tables.panel(tables.Tables(spark, SF)).select("district", "industry", "quarter", "sales").cache()


@pytest.fixture(scope="module")
def drawn(panel):
    return simulated.log(panel, WORLD).cache()


def test_the_same_rows_at_any_partitioning(panel):
    a = simulated.log(panel.repartition(7, "quarter"), World(seed=3))
    b = simulated.log(panel.coalesce(1), World(seed=3))
    cols = [F.xxhash64(*a.columns).alias("h")]
    assert sorted(r.h for r in a.select(cols).collect()) == sorted(r.h for r in b.select(cols).collect())
    other = simulated.log(panel, World(seed=4))
    assert other.select("x4").exceptAll(b.select("x4")).count() > 0.99 * b.count()
    assert b.select("decision_id").distinct().count() == b.count()


def test_draws_have_their_distribution(spark):
    d = Draws(1, F.col("id"))
    f = spark.range(40_000).select(d.uniform("u").alias("u"), d.uniform("v").alias("v"), d.normal("n", 2.0, 3.0).alias("n"), d.place("p", 5).alias("p")).toPandas()
    assert 0 < f.u.min() and f.u.max() < 1 and abs(f.u.mean() - 0.5) < 0.01 and abs(f.u.var() - 1 / 12) < 0.002
    assert abs(np.corrcoef(f.u, f.v)[0, 1]) < 0.02
    assert abs(f.n.mean() - 2) < 0.06 and abs(f.n.std() - 3) < 0.06 and abs(((f.n - 2) / 3 > 1.96).mean() - 0.025) < 0.004
    assert np.abs(f.p.value_counts(normalize=True) - 0.2).max() < 0.01


def test_a_log_is_whole_and_drawn_from_its_propensities(panel, drawn):
    cells = simulated.target_cells(panel).count()
    arms = sum(map(len, WORLD.effects.values()))
    assert drawn.count() == cells * len(WORLD.effects) * WORLD.per_cell + arms * panel.select("industry").distinct().count()
    f = drawn.toPandas()
    assert np.allclose([sum(p) for p in f.probabilities], 1) and (f.propensity == [p[list(c).index(a)] for p, c, a in zip(f.probabilities, f.candidates, f.arm, strict=True)]).all()
    f = f[~f.forced]
    for problem, g in f.groupby("problem"):
        high = g.propensity > 0.5
        want = 1 - WORLD.epsilon + WORLD.epsilon / len(WORLD.effects[problem])
        assert high.mean() == pytest.approx(want, abs=4 * math.sqrt(want * (1 - want) / len(g)))
    assert np.allclose(f.cost_before, f.sales_before * 0.4) and (f.treated_quarter > f.quarter).all()


def test_plain_means_are_biased_and_estimators_are_not(spark, drawn):
    truth = WORLD.truth(spark)
    rows = {(r.problem, r.arm): r for r in policy.recovered(drawn, truth).collect()}
    robust = {(r.problem, r.arm): r for r in policy.recovered_robustly(drawn, truth, ["x4"]).collect()}
    assert rows.keys() == robust.keys() == {(p, a) for p, arms in WORLD.effects.items() for a in arms}
    assert all(r.recovered for r in rows.values()) and all(r.recovered for r in robust.values())
    bias = max(abs(r.plain - r.truth) / r.se for r in rows.values())
    assert bias > 8  # the truth is far outside of what a plain mean would say
    assert np.mean([robust[k].se < rows[k].se for k in rows]) > 0.9
    assert np.abs([(rows[k].snips - rows[k].truth) / rows[k].se for k in rows]).mean() < 1.6
    assert np.abs([(robust[k].dr - robust[k].truth) / robust[k].se for k in rows]).mean() < 1.6
    assert np.abs([rows[k].ips - rows[k].snips for k in rows]).max() < 0.02


def test_recovered_sums_against_the_rowwise_estimators(spark, drawn):
    problem = "차별화"
    log = drawn.where(F.col("problem") == problem)
    got = {r.arm: r for r in policy.recovered(log, WORLD.truth(spark).where(F.col("problem") == problem)).collect()}
    for arm, r in got.items():
        one = policy.importance_estimates(log, policy.always(arm)).first()
        assert (r.ips, r.snips, r.ess, r.n) == (pytest.approx(one.ips), pytest.approx(one.snips), pytest.approx(one.ess), one.n)
    robust = {r.arm: r for r in policy.recovered_robustly(log, WORLD.truth(spark).where(F.col("problem") == problem), ["x4", "x5"]).collect()}
    f = log.select("arm", "propensity", "reward", "x4", "x5", policy.even_fold(5).alias("fold")).toPandas()
    z = np.column_stack([np.ones(len(f)), f.x4, f.x5])

    def ridge(rows):
        return np.linalg.solve(z[rows].T @ z[rows] + 0.1 * np.eye(3), z[rows].T @ f.reward[rows])

    for arm, r in robust.items():
        mine = (f.arm == arm).to_numpy()
        dm = z @ ridge(mine)
        logged = np.zeros(len(f))
        for k in range(5):
            logged[f.fold == k] = z[f.fold == k] @ ridge(mine & (f.fold != k).to_numpy())
        dr = dm + mine / f.propensity * (f.reward - logged)
        assert (r.dm, r.dr, r.se, r.n) == (pytest.approx(dm.mean()), pytest.approx(dr.mean()), pytest.approx(dr.std(ddof=1) / math.sqrt(len(f))), len(f))


def test_floored_truth_and_safety(spark, panel):
    world = World(seed=11, per_cell=2)
    log = simulated.log(panel, world)
    assert log.agg(F.min("reward")).first()[0] == pytest.approx(world.floor)
    rows = policy.recovered(log, world.truth(spark)).collect()
    assert all(r.recovered for r in rows)
    with pytest.raises(ValueError, match="closed form"):
        World(gain=1.0).expected("관찰", "웰컴 프로모션")
    world = World(seed=5, floor=None)
    one = simulated.log(panel, world).where(F.col("problem") == "고객_회복")
    arms = list(world.effects["고객_회복"])
    best, worst = (policy.safety(one, ["x4"], arms, a).first() for a in ("즉시할인", "배달채널 확대"))
    assert best.verdict == "usable" and best.low > 0 and worst.verdict == "blocked"
    assert best.low < 0.08 - np.mean(list(world.effects["고객_회복"].values())) < best.high


def test_poisson_counts(spark):
    f = spark.range(200_000).select(policy.poisson(F.col("id"), F.lit(1), 0).alias("k")).groupBy("k").count().toPandas().set_index("k")["count"] / 200_000
    for k in range(6):
        assert f[k] == pytest.approx(math.exp(-1) / math.factorial(k), abs=0.004)
