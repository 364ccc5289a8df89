"""Estimators against NumPy, and against data whose truth is known."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillmart.operators import anomaly, counterfactual, policy, regression, survival

ARMS = ["a", "b"]
X = ["x1", "x2"]


def log_of(n=1500, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 2))
    p = np.where(x[:, 0] > 0, 0.7, 0.3)
    arm = np.where(r.random(n) < p, "a", "b")
    reward = np.where(arm == "a", 1 + x @ [0.5, 0.0], 0.2 + x @ [0.0, -0.3]) + r.normal(0, 0.1, n)
    return pd.DataFrame({"cluster": r.integers(0, 60, n), "arm": arm, "propensity": np.where(arm == "a", p, 1 - p), "reward": reward, "x1": x[:, 0], "x2": x[:, 1]})


def ridge(f, arm, alpha=0.1):
    g = f[f.arm == arm]
    z = np.column_stack([np.ones(len(g)), g[X]])
    return np.linalg.solve(z.T @ z + alpha * np.eye(3), z.T @ g.reward)


def test_direct_and_doubly_robust(spark):
    f = log_of()
    df = spark.createDataFrame(f)
    z = np.column_stack([np.ones(len(f)), f[X]])
    dm = z @ ridge(f, "a")
    logged = np.where(f.arm == "a", z @ ridge(f, "a"), z @ ridge(f, "b"))
    dr = dm + (f.arm == "a") / f.propensity * (f.reward - logged)
    got = policy.estimates(df, X, "a", cross_fit=0).first()
    assert got.dm == pytest.approx(dm.mean())
    assert got.dr == pytest.approx(dr.mean())
    fitted = policy.estimates(df, X, "a").first()
    assert fitted.dr == pytest.approx(1.0, abs=0.05)  # the truth
    snips = policy.importance_estimates(df, policy.always("a")).first()
    assert snips.ips == pytest.approx(np.mean((f.arm == "a") / f.propensity * f.reward))
    assert snips.snips == pytest.approx(1.0, abs=0.1)


def test_cross_fitting_leaves_the_fold_out(spark):
    f = log_of(400)
    df = spark.createDataFrame(f)
    folds = {r.cluster: r.k for r in df.select("cluster", policy.fold(5).alias("k")).distinct().collect()}
    fits = policy.cross_fitted(df, X, 5)
    k = f.cluster.map(folds)
    for fold in range(5):
        assert fits["a", fold] == pytest.approx(ridge(f[k != fold], "a"))


def test_bootstrap_covers_the_mean(spark):
    df = spark.createDataFrame(log_of())
    ci = policy.bootstrap(df, F.col("reward"), 200).first()
    mean = df.agg(F.avg("reward")).first()[0]
    assert ci.low < mean < ci.high
    assert ci.high - ci.low < 0.3
    assert policy.bootstrap(df, F.col("reward"), 200).first() == ci


def test_safety_verdicts(spark):
    df = spark.createDataFrame(log_of())
    assert policy.safety(df, X, ARMS, "a").first().verdict == "usable"
    assert policy.safety(df, X, ARMS, "b").first().verdict == "blocked"
    assert policy.safety(df.limit(5), X, ARMS, "a").first().verdict == "too_few_rows"


def test_bandit_scores_and_batches(spark):
    f = log_of(300)
    df = spark.createDataFrame(f)
    whole = policy.Bandit.learn(df, X, ARMS)
    parts = policy.Bandit.learn(df.where("cluster < 30"), X, ARMS).add(df.where("cluster >= 30"), X)
    assert whole.a["a"] == pytest.approx(parts.a["a"])
    rows = spark.createDataFrame([(1, 0.5, -1.0)], "k int, x1 double, x2 double")
    got = {r.arm: r for r in whole.scored(rows, "k", X).collect()}
    z = np.array([1, 0.5, -1.0])
    inv = np.linalg.inv(whole.a["a"])
    assert got["a"].expected == pytest.approx(z @ inv @ whole.b["a"])
    assert got["a"].uncertainty == pytest.approx(np.sqrt(z @ inv @ z))
    assert sum(r.propensity for r in got.values()) == pytest.approx(1)
    assert sum(r.best for r in got.values()) == 1


def test_epsilon_greedy_sums_to_one(spark):
    s = spark.createDataFrame([(1, a, e) for a, e in (("a", 1.0), ("b", 3.0), ("c", 2.0))], "k int, arm string, expected double")
    got = {r.arm: r.probability for r in policy.epsilon_greedy(s, "k", 0.1, ["b"]).collect()}
    assert got == {"a": pytest.approx(0.05), "b": 0.0, "c": pytest.approx(0.95)}
    assert {r.arm: r.probability for r in policy.epsilon_greedy(s, "k", 0.1, ["a", "b", "c"]).collect()} == {"a": 0.0, "b": 1.0, "c": 0.0}


def clustered(n=1200, seed=3):
    r = np.random.default_rng(seed)
    g, c = r.integers(0, 6, n), r.integers(0, 30, n)
    x = r.normal(size=(n, 2)) + g[:, None] * 0.3
    y = x @ [0.5, -0.2] + g * 0.7 + r.normal(size=30)[c] * 0.5 + r.normal(0, 0.3, n)
    return pd.DataFrame({"g": g, "c": c, "x1": x[:, 0], "x2": x[:, 1], "y": y})


def test_regression_equals_dummies(spark):
    f = clustered()
    d = pd.get_dummies(f.g, dtype=float).to_numpy()
    z = np.column_stack([f[X], d])
    b = np.linalg.lstsq(z, f.y, rcond=None)[0]
    u = f.y - z @ b
    scores = np.array([z[f.c == k].T @ u[f.c == k] for k in sorted(f.c.unique())])
    bread = np.linalg.inv(z.T @ z)
    n, k, m = len(f), z.shape[1], f.c.nunique()
    v = bread @ (scores.T @ scores) @ bread * m / (m - 1) * (n - 1) / (n - k)
    got = regression.fit(spark.createDataFrame(f), "y", X, "g", "c")
    assert got.coef == pytest.approx(b[:2])
    assert got.se == pytest.approx(np.sqrt(np.diag(v))[:2])
    without = f[f.g != 2]
    z2 = np.column_stack([without[X], pd.get_dummies(without.g, dtype=float)])
    left = regression.Moments.of(spark.createDataFrame(f), "y", X, "g").fit(2)
    assert left == pytest.approx(np.linalg.lstsq(z2, without.y, rcond=None)[0][:2])
    assert regression.fit(spark.createDataFrame(f), "y", X, "g", "c", min_rows=10_000) is None


def test_simplex_weights():
    r = np.random.default_rng(4)
    x = r.normal(size=(24, 6)).cumsum(0)
    w = np.array([0.5, 0.3, 0.2, 0, 0, 0])
    got = counterfactual.simplex_weights(x, x @ w)
    assert got == pytest.approx(w, abs=1e-3)
    assert got.sum() == pytest.approx(1)
    assert (got >= 0).all()


def donors_by_hand(f, targets, k):
    """Pool, whole series and correlation target by target."""
    out = set()
    for target, industry, as_of in targets:
        g = f[(f.industry == industry) & (f.q <= as_of)]
        own = g[g.district == target].set_index("q").sales
        counts = g[g.district != target].groupby("district").q.nunique()
        pool = list(counts[counts >= 6].index)
        kinds = f.groupby("district").district_type.max()
        same = [d for d in pool if kinds[d] == kinds[target]]
        pool = same if len(same) >= 20 else pool
        if len(own) < 6:
            continue
        scored = []
        for d in pool:
            x = g[g.district == d].set_index("q").sales.reindex(own.index)
            if not x.isna().any():
                y, z = np.log1p(own), np.log1p(x)
                scored.append((-round(np.corrcoef(y, z)[0, 1], 9) if z.std() > 1e-12 and y.std() > 1e-12 else 1.0, d))
        out |= {(target, industry, as_of, d) for _, d in sorted(scored)[:k]}
    return out


def test_donors_from_blocks_are_those_of_every_pair(spark, monkeypatch):
    r = np.random.default_rng(8)
    rows = []
    for industry, n in (("x", 60), ("y", 14)):
        for d in range(n):
            level = 10 + r.normal(0, 0.2, 12).cumsum() if d % 9 else np.full(12, 10.0)
            rows += [(d, d % 2, industry, 8000 + q, float(np.expm1(level[q]))) for q in range(12) if d % 7 or q % 5 != 3]
    f = pd.DataFrame(rows, columns=["district", "district_type", "industry", "q", "sales"])
    targets = [(d, i, q) for i, n in (("x", 60), ("y", 14)) for d in range(n) for q in (8004, 8008, 8011) if (d + q) % 3]
    panel, asked = spark.createDataFrame(f), spark.createDataFrame(targets, "district long, industry string, as_of long")
    for block in (7, 256):
        monkeypatch.setattr(counterfactual, "BLOCK", block)
        got = counterfactual.similar_donors(panel, asked, k=5).collect()
        assert {(x.target, x.industry, x.as_of, x.donor) for x in got} == donors_by_hand(f, targets, 5)
    assert counterfactual.similar_donors(panel, asked.limit(0)).count() == 0
    assert counterfactual.similar_donors(panel.limit(0), asked).count() == 0


def test_mean_effect_by_cell_or_industry(spark):
    found = spark.createDataFrame([(d, "x", 8000 + k, 0.1 * d + 0.01 * k, k % 2 == 0) for d in (1, 2) for k in range(30)], "district int, industry string, as_of int, effect double, good boolean")
    one = counterfactual.mean_effect(found, F.col("district") == 1).first()
    assert (one.scope, one.n, one.good_share) == ("cell", 30, 0.5) and one.mean == pytest.approx(0.1 + 0.145)
    assert one.low < one.mean < one.high and one.high - one.low == pytest.approx(4 * 0.01 * np.std(range(30)) / np.sqrt(30), rel=0.3)
    every = counterfactual.mean_effect(found, F.col("district") == 9).first()
    assert (every.scope, every.n) == ("industry", 60) and every.mean == pytest.approx(0.295)


def test_counterfactual_of_a_mixture(spark):
    r = np.random.default_rng(5)
    logs = 10 + r.normal(0, 0.1, (9, 5)).cumsum(0)
    target = logs @ [0.6, 0.4, 0, 0, 0]
    rows = [(d + 1, 1, "x", 8000 + q, float(np.expm1(logs[q, d]))) for q in range(9) for d in range(5)] + [(0, 1, "x", 8000 + q, float(np.expm1(target[q]))) for q in range(9)]
    panel = spark.createDataFrame(rows, "district int, district_type int, industry string, q int, sales double")
    got = counterfactual.baseline(panel, spark.createDataFrame([(0, "x", 8007)], "district int, industry string, as_of int")).first()
    assert got.good
    assert got.expected == pytest.approx(np.expm1(target[8]), rel=1e-2)
    cases = spark.createDataFrame([(0, "x", 8007, float(np.expm1(target[8]) * 1.2))], "district int, industry string, as_of int, after double")
    assert counterfactual.effects(panel, cases).first().effect == pytest.approx(0.2, abs=0.02)


def test_cox_recovers_the_hazard(spark):
    r = np.random.default_rng(6)
    rows = []
    for cell in range(600):
        a = r.normal()
        for t in range(12):
            dead = int(r.random() < min(0.9, 0.05 * np.exp(0.8 * a)))
            rows.append((cell, "x", t, t + 1, dead, a, r.normal()))
            if dead:
                break
    df = spark.createDataFrame(rows, "district int, industry string, start int, stop int, event int, a double, b double")
    m = survival.cox(df, ["a", "b"], ridge=1e-6)
    assert m["beta"] / m["sd"] == pytest.approx([0.8, 0.0], abs=0.15)
    cells = survival.cells(survival.risk(df, m))
    assert survival.concordance(cells).first().c_index > 0.65
    last = {b.bucket: b.survival for b in survival.survival_curves(cells).groupBy("bucket").agg(F.min("survival").alias("survival")).collect()}
    assert last[1] > last[5]
    assert survival.contributions(df.limit(5), m).count() >= 0


def test_trees_draw_from_all_rows_the_same_way(spark):
    r = np.random.default_rng(2)
    df = spark.createDataFrame(pd.DataFrame(r.normal(size=(5000, 2)), columns=["a", "b"]).assign(k=range(5000)))
    for n, trees, sample in ((5000, 8, 64), (5000, 40, 256), (300, 20, 256), (100, 5, 256)):
        rows = df.where(f"k < {n}")
        got = anomaly.drawn(rows, ["a", "b"], trees, sample, 1).toPandas()
        assert got.groupby("tree").size().tolist() == [min(n, sample)] * trees
        again = anomaly.drawn(rows.repartition(7), ["a", "b"], trees, sample, 1).toPandas()
        key = ["tree", "_r"]
        assert got.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))
        assert not got.duplicated(["tree", "a", "b"]).any()
    wide = anomaly.drawn(df, ["a", "b"], 40, 256, 1).toPandas()
    assert wide.drop_duplicates(["a", "b"]).shape[0] > 4000 and abs(wide.a.mean()) < 0.05
    copies = spark.range(3000).select((F.col("id") < 1000).cast("double").alias("a"), F.col("id"))
    share = anomaly.drawn(copies, ["a"], 30, 128, 3).agg(F.avg("a")).first()[0]
    assert share == pytest.approx(1 / 3, abs=0.04)
    one, two = anomaly.fit(df, ["a", "b"], 10, 64), anomaly.fit(df.repartition(5), ["a", "b"], 10, 64)
    assert all(np.array_equal(getattr(one, c), getattr(two, c)) for c in ("roots", "feature", "cut", "left", "depth"))
    assert len(anomaly.fit(df.limit(0), ["a", "b"], 10, 64).roots) == 0


def factor_days(n=200, seed=6):
    r = np.random.default_rng(seed)
    day = pd.date_range("2024-01-01", periods=n)
    g, h = r.choice(["a", "b", None], n), r.choice(["a", "b", None], n)
    x, rain = r.normal(100, 20, n), r.integers(0, 2, n)
    base = np.array([hash_of(i, j) for i, j in zip(g, h, strict=True)])
    y = np.expm1(8 + 0.01 * x - 0.2 * rain + base + r.normal(0, 0.05, n))
    return pd.DataFrame({"day": day.date, "traffic": x, "rain": rain, "g": g, "h": h, "revenue": y})


def hash_of(i, j):
    return {"a": 0.0, "b": 0.7, None: -0.4}[i] + {"a": 0.0, "b": -0.9, None: 0.3}[j] * 1.3


def frame_of(spark, f):
    rows = [tuple(None if v is None else v for v in r) for r in f.astype(object).where(f.notna(), None).itertuples(index=False)]
    return spark.createDataFrame(rows, "day date, traffic double, rain int, g string, h string, revenue double")


def dummies(f):
    return pd.get_dummies(f.g.fillna("-") + "|" + f.h.fillna("-"), dtype=float)


def test_factor_effect_against_dummies(spark):
    f = factor_days()
    df = frame_of(spark, f)
    d = dummies(f).to_numpy()
    for name, x, unit in (("rain", f.rain.to_numpy(float), "binary"), ("traffic", ((f.traffic - f.traffic.mean()) / f.traffic.std(ddof=0)).to_numpy(), "deviation")):
        z = np.column_stack([x, d])
        want = np.linalg.lstsq(z, np.log1p(f.revenue), rcond=None)[0][0]
        got = regression.factor_effect(df, name, "revenue", ["g", "h"])
        assert got["coef"] == pytest.approx(want) and got["unit"] == unit and got["n"] == len(f) and got["effect_pct"] == pytest.approx(np.expm1(want) * 100)
        assert got["low_pct"] < got["effect_pct"] < got["high_pct"]
    assert regression.factor_effect(df.limit(20), "rain", "revenue", ["g"]) is None
    assert regression.factor_effect(df.where("rain = 1"), "rain", "revenue", []) is None


def gain_by_hand(f, factor, splits=3):
    y, x, d = np.log1p(f.revenue.to_numpy()), f[factor].to_numpy(float), (f.g.fillna("-") + "|" + f.h.fillna("-")).to_numpy()
    size, n = len(f) // (splits + 1), len(f)
    base, full = [], []
    for k in range(splits):
        a = n - (splits - k) * size
        train, test = np.arange(a), np.arange(a, a + size)
        my, mx = {}, {}
        for g in set(d[train]):
            my[g], mx[g] = y[train][d[train] == g].mean(), x[train][d[train] == g].mean()
        cy, cx = (np.array([m.get(g, v[train].mean()) for g in d]) for m, v in ((my, y), (mx, x)))
        beta = ((x - cx)[train] @ (y - cy)[train]) / ((x - cx)[train] @ (x - cx)[train])
        base.append(np.abs(y - cy)[test].mean())
        full.append(np.abs(y - cy - beta * (x - cx))[test].mean())
    return (np.mean(base) - np.mean(full)) / np.mean(base) * 100


def test_validation_gain_against_a_loop(spark):
    f = factor_days()
    df = frame_of(spark, f)
    for factor in ("traffic", "rain"):
        assert regression.validation_gain(df, factor, "revenue", ["g", "h"]) == pytest.approx(gain_by_hand(f, factor))
    assert regression.validation_gain(df, "traffic", "revenue", ["g", "h"]) > 20
    assert regression.validation_gain(df.limit(59), "traffic", "revenue", ["g"]) == 0.0


def test_factors_together_are_the_factors_one_by_one(spark):
    f = factor_days(160, 11)
    f.loc[::7, "traffic"] = None
    df = frame_of(spark, f).withColumns({"flat": F.lit(3), "by_group": (F.col("g") == "a").cast("int"), "none": F.lit(None).cast("double")})
    known = f[f.traffic.notna()]
    d = pd.get_dummies(known.g.fillna("-") + "|" + known.h.fillna("-"), dtype=float).to_numpy()
    raw = known.traffic.astype(float)
    z, y = np.column_stack([(raw - raw.mean()) / raw.std(ddof=0), d]), np.log1p(known.revenue).to_numpy()
    b = np.linalg.lstsq(z, y, rcond=None)[0]
    bread, u = np.linalg.inv(z.T @ z), z * (y - z @ b)[:, None]
    n, k = len(y), z.shape[1]
    se = np.sqrt((bread @ (u.T @ u) @ bread)[0, 0] * n / (n - 1) * (n - 1) / (n - k))
    got = {r["factor"]: r for r in regression.factor_fits(df, ["traffic", "rain", "flat", "by_group", "none"], "revenue", ["g", "h"])}
    # one value, one within every combination, nothing known: left out
    assert set(got) == {"traffic", "rain"} and got["traffic"]["n"] == n
    assert got["traffic"]["coef"] == pytest.approx(b[0]) and got["traffic"]["se"] == pytest.approx(se)
    assert got["traffic"]["gain_pct"] == pytest.approx(gain_by_hand(known.reset_index(drop=True), "traffic"))
    for name in got:
        one = regression.factor_effect(df.repartition(7), name, "revenue", ["g", "h"])
        assert all(one[c] == (pytest.approx(v) if isinstance(v, float) else v) for c, v in got[name].items())
    assert regression.factor_fits(df.limit(0), ["traffic", "rain"], "revenue", ["g", "h"]) == []


def test_clusters_may_span_blocks_of_days(spark):
    df = frame_of(spark, factor_days()).withColumn("team", F.dayofmonth("day") % 9)
    got = regression.factor_effect(df, "rain", "revenue", ["g", "h"], "team")
    rows = df.select(F.log1p("revenue").alias("y"), F.col("rain").cast("double").alias("x"), regression._combination(["g", "h"]).alias("c"), "team")
    want = regression.fit(rows, "y", ["x"], "c", "team")
    assert (got["coef"], got["se"], got["p"]) == (pytest.approx(want.coef[0]), pytest.approx(want.se[0]), pytest.approx(want.p[0]))


def test_period_attribution_of_planted_factors(spark):
    f = factor_days()
    f["traffic"] += np.where(np.arange(len(f)) >= 150, 15.0, 0.0)
    f["revenue"] *= np.exp(0.01 * np.where(np.arange(len(f)) >= 150, 15.0, 0.0))
    df = frame_of(spark, f)
    cut = F.lit(f.day[150])
    got = {r.factor: r for r in regression.period_attribution(df, ["traffic", "rain"], F.col("day") < cut, F.col("day") >= cut, ["g", "h"]).collect()}
    r, e = got["traffic"], regression.factor_effect(df, "traffic", "revenue", ["g", "h"])
    before, after = f.traffic[:150].mean(), f.traffic[150:].mean()
    effect = np.expm1(e["coef"] * (after - before) / f.traffic.std(ddof=0))
    assert (r.before, r.after, r.effect_pct) == (pytest.approx(before), pytest.approx(after), pytest.approx(effect * 100))
    assert r.amount == pytest.approx(f.revenue[:150].sum() * effect) and r.direction == "positive" and r.join_rate == 1 and r.p < 1e-6
    assert r.effect_pct == pytest.approx(np.expm1(0.01 * (after - before)) * 100, rel=0.15)
    assert r.gain_pct == pytest.approx(gain_by_hand(f, "traffic")) and max(x.adjusted_p for x in got.values()) == pytest.approx(max(x.p for x in got.values()))


def test_verdicts_tell_a_cause_from_what_follows_it(spark):
    r = np.random.default_rng(12)
    rows = []
    for cell in range(40):
        x, noise = r.normal(size=14), r.normal(size=14)
        late = np.concatenate([[0.0], noise[:-1]])  # noise's next value moves with today's sales
        for q in range(14):
            rows.append((cell, "i", q, float(x[q]), float(late[q]), float(r.normal()), float(0.5 * x[q] + 0.5 * noise[q] + 0.1 * r.normal())))
    df = spark.createDataFrame(rows, "district int, industry string, q int, cause double, follows double, nothing double, y double")
    how = ([], "q", "district", ["district", "industry"], "q")
    got = {n: regression.verdicts(df, "y", [n], *how, min_rows=30).first() for n in ("cause", "follows", "nothing")}
    assert got["cause"].usable and got["cause"].coef == pytest.approx(0.5, abs=0.06) and got["cause"].placebo_p > 0.05 and got["cause"].sign_stability == 1
    assert not got["follows"].usable and got["follows"].placebo_p < 0.01
    assert not got["nothing"].usable and got["nothing"].p > 0.05
    few = regression.verdicts(df.limit(20), "y", ["cause"], *how, min_rows=30).first()
    assert few.coef is None and not few.usable and few.n == 20


def test_risk_position_counts_lower_risks(spark):
    r = np.random.default_rng(3)
    risk = [float(x) for x in r.integers(0, 12, 150)] + [0.5]
    got = survival.risk_position(spark.createDataFrame(list(enumerate(risk)), "cell int, risk double")).collect()
    assert all(x.safer_pct == pytest.approx(100 * sum(y < risk[x.cell] for y in risk) / len(risk)) for x in got) and len(got) == len(risk)


def test_isolation_finds_planted_rows(spark):
    r = np.random.default_rng(7)
    x = r.normal(size=(800, 3))
    x[:8] += 9
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"]).assign(k=range(800)))
    got = anomaly.anomalies(df, ["a", "b", "c"], trees=50).orderBy(F.col("score").desc()).limit(8).collect()
    assert {r.k for r in got} == set(range(8))
    assert all(r.odd for r in got)
    shocked = df.withColumn("a", F.col("a") + 12)
    assert anomaly.detection_rate(df, ["a", "b", "c"], shocked, trees=50) > 0.7
