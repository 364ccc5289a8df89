"""Off-policy evaluation and contextual bandits over a log of decisions.

A log has ``arm``, ``propensity``, ``reward``, a context of numeric columns and a ``cluster`` (the store). A target
policy is a column: the probability with which it would have taken the logged arm, and for the model-based estimators
a map from arm to probability. Models are per-arm ridge regressions on an intercept and the context; their moments are
sums by arm (and fold), so only arms x folds small matrices reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmart.functions.columns import ratio

#: What an activation and a safety verdict need.
MIN_ROWS, MIN_PER_ARM, MIN_ESS, MAX_BAD_CONTEXT = 100, 20, 10.0, 0.05
SAFE_ROWS = 20


def always(arm: str) -> Column:
    """The probability of the logged arm under the policy that always takes ``arm``."""
    return (F.col("arm") == arm).cast("double")


def uniform(arms: list[str]) -> Column:
    return F.when(F.col("arm").isin(*arms), 1.0 / len(arms)).otherwise(0.0)


def weighted(log: DataFrame, target: Column) -> DataFrame:
    """The log with ``weight``, the target's probability over the logged propensity."""
    return log.withColumn("weight", target / F.col("propensity"))


def importance_estimates(log: DataFrame, target: Column, by: list[str] | None = None) -> DataFrame:
    """n, ips, snips (null without weight), ess: one aggregate."""
    w, wr = F.col("weight"), F.col("weight") * F.col("reward")
    return weighted(log, target).groupBy(*(by or [])).agg(
        F.count("*").alias("n"), F.avg(wr).alias("ips"), ratio(F.sum(wr), F.sum(w)).alias("snips"),
        F.coalesce(ratio(F.sum(w) * F.sum(w), F.sum(w * w)), F.lit(0.0)).alias("ess"),
    )


def support(log: DataFrame, arms: DataFrame) -> DataFrame:
    """arm, n for every arm, 0 for those never taken."""
    return arms.select("arm").join(log.groupBy("arm").agg(F.count("*").alias("n")), "arm", "left").select("arm", F.coalesce("n", F.lit(0)).alias("n"))


def _z(context: list[str]) -> list[Column]:
    return [F.lit(1.0), *map(F.col, context)]


def arm_moments(log: DataFrame, context: list[str], by: list[str], weight: Column | None = None) -> DataFrame:
    """Per group: n, the upper triangle of sum(w z z'), sum(w r z), with z = (1, context)."""
    w = F.lit(1.0) if weight is None else weight
    z, d = _z(context), len(context) + 1
    a = [F.sum(w * z[i] * z[j]).alias(f"a{i}_{j}") for i in range(d) for j in range(i, d)]
    b = [F.sum(w * F.col("reward") * z[i]).alias(f"b{i}") for i in range(d)]
    return log.groupBy(*by).agg(F.count("*").alias("n"), *a, *b)


def _matrices(row, d: int) -> tuple[np.ndarray, np.ndarray]:
    a = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            a[i, j] = a[j, i] = row[f"a{i}_{j}"]
    return a, np.array([row[f"b{i}"] for i in range(d)])


def ridge(log: DataFrame, context: list[str], alpha: float = 0.1) -> dict[str, np.ndarray]:
    """Coefficients per arm; arms and context are few, so their moments are gathered."""
    d = len(context) + 1
    out = {}
    for row in arm_moments(log, context, ["arm"]).collect():
        a, b = _matrices(row, d)
        out[row["arm"]] = np.linalg.solve(a + alpha * np.eye(d), b)
    return out


def cross_fitted(log: DataFrame, context: list[str], folds: int = 5, alpha: float = 0.1) -> dict[tuple[str, int], np.ndarray]:
    """Coefficients per (arm, fold) from the other folds: the total's moments less the fold's, in one pass."""
    d = len(context) + 1
    sums: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
    for row in arm_moments(log.withColumn("_fold", fold(folds)), context, ["arm", "_fold"]).collect():
        sums[row["arm"], row["_fold"]] = _matrices(row, d)
    out = {}
    for arm in {a for a, _ in sums}:
        total = [sum(s[i] for (a, _), s in sums.items() if a == arm) for i in (0, 1)]
        for f in range(folds):
            mine = sums.get((arm, f), (0, 0))
            out[arm, f] = np.linalg.solve(total[0] - mine[0] + alpha * np.eye(d), total[1] - mine[1])
    return out


def fold(folds: int) -> Column:
    """A cluster's fold: all its rows stay together."""
    return F.pmod(F.xxhash64("cluster"), F.lit(folds)).cast("int")


def _predicted(models: dict, key: Column, context: list[str]) -> Column:
    """theta . z by a literal map of the few models; 0 for an arm without one."""
    entries = [x for k, theta in models.items() for x in (F.lit(k), F.array(*(F.lit(float(v)) for v in theta)))]
    if not entries:
        return F.lit(0.0)
    theta = F.element_at(F.create_map(*entries), key)
    return F.coalesce(sum((theta[i] * z for i, z in enumerate(_z(context))), F.lit(0.0)), F.lit(0.0))


def direct(models: dict[str, np.ndarray], policy: dict[str, float] | str, context: list[str]) -> Column:
    """What the model expects of the target policy in each row; ``policy`` is a distribution over arms or one arm."""
    dist = {policy: 1.0} if isinstance(policy, str) else policy
    return sum((F.lit(p) * _predicted(models, F.lit(a), context) for a, p in dist.items() if p and a in models), F.lit(0.0))


def influence(log: DataFrame, context: list[str], policy: dict[str, float] | str, *, cross_fit: int = 5, alpha: float = 0.1, out: str = "influence") -> DataFrame:
    """The log with each row's doubly robust term: model value of the policy plus the weighted residual of the logged arm.

    Residuals come from models that haven't seen the row's cluster (``cross_fit`` folds; below 2 the model itself).
    The mean is the doubly robust estimate, and sums by cluster are all a bootstrap needs.
    """
    models = ridge(log, context, alpha)
    dist = {policy: 1.0} if isinstance(policy, str) else policy
    prob = F.coalesce(F.element_at(F.create_map(*(x for a, p in dist.items() for x in (F.lit(a), F.lit(float(p))))), F.col("arm")), F.lit(0.0))
    if cross_fit >= 2:
        fits = cross_fitted(log, context, cross_fit, alpha)
        logged = _predicted({f"{a}|{f}": v for (a, f), v in fits.items()}, F.concat_ws("|", "arm", fold(cross_fit).cast("string")), context)
    else:
        logged = _predicted(models, F.col("arm"), context)
    return log.withColumn(out, direct(models, policy, context) + prob / F.col("propensity") * (F.col("reward") - logged))


def estimates(log: DataFrame, context: list[str], policy: dict[str, float] | str, **how) -> DataFrame:
    """dm, dr: one row."""
    rows = influence(log, context, policy, **how).withColumn("_dm", direct(ridge(log, context, how.get("alpha", 0.1)), policy, context))
    return rows.agg(F.avg("_dm").alias("dm"), F.avg("influence").alias("dr"))


def recovered(log: DataFrame, truth: DataFrame, errors: float = 4.0) -> DataFrame:
    """The value of always taking each action of ``truth(problem, arm, truth)``, as the log's weights have it.

    Returns problem, arm, truth, n (decisions on the problem), taken, plain (mean reward where taken), ips, snips, ess, se
    (of snips) and whether the truth lies within so many ``errors`` of snips. Each action's sums come from its own rows,
    so the log is read once and no row is multiplied by the actions.
    """
    r, w = F.col("reward"), 1 / F.col("propensity")
    own = log.groupBy("problem", "arm").agg(
        F.count("*").alias("taken"), F.avg(r).alias("plain"), F.sum(w).alias("w"), F.sum(w * w).alias("ww"), F.sum(w * r).alias("wr"), F.sum(w * w * r).alias("wwr"), F.sum(w * w * r * r).alias("wwrr"),
    )
    total = own.groupBy("problem").agg(F.sum("taken").alias("n"))
    rows = truth.join(own, ["problem", "arm"], "left").join(total, "problem", "left").withColumn("snips", ratio(F.col("wr"), F.col("w")))
    spread = F.greatest(F.lit(0.0), F.col("wwrr") - 2 * F.col("snips") * F.col("wwr") + F.col("snips") * F.col("snips") * F.col("ww"))
    rows = rows.withColumn("se", F.sqrt(spread) / F.col("w"))
    return rows.select(
        "problem", "arm", "truth", "n", F.coalesce("taken", F.lit(0)).alias("taken"), "plain", (F.col("wr") / F.col("n")).alias("ips"), "snips", (F.col("w") * F.col("w") / F.col("ww")).alias("ess"), "se",
        (F.abs(F.col("snips") - F.col("truth")) <= errors * F.col("se")).alias("recovered"),
    )


def even_fold(folds: int) -> Column:
    """A cluster's fold by a hash that other engines have too."""
    return F.pmod(F.conv(F.substring(F.md5(F.col("cluster").cast("string")), 1, 8), 16, 10).cast("long"), F.lit(folds)).cast("int")


def recovered_robustly(log: DataFrame, truth: DataFrame, context: list[str], folds: int = 5, alpha: float = 0.1, errors: float = 4.0) -> DataFrame:
    """Direct and doubly robust value of always taking each action of ``truth(problem, arm, truth)``.

    Returns problem, arm, truth, n, dm, dr, se (of dr) and whether the truth lies within so many ``errors`` of dr. Residuals
    come from models that haven't seen the row's cluster. A row adds to another action's estimate its modelled value
    only, and that is linear in (1, context): its sum and sum of squares follow from the moments, so two passes over the log
    serve all actions of all problems, and each row is counted with its own action alone.
    """
    d = len(context) + 1
    sums: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
    for row in arm_moments(log.withColumn("_fold", even_fold(folds)), context, ["problem", "arm", "_fold"]).collect():
        sums[row["problem"], row["arm"], row["_fold"]] = _matrices(row, d)
    total, whole = {}, {}
    for (p, a, _), (m, v) in sums.items():
        total[p, a] = [x + y for x, y in zip(total.get((p, a), (0, 0)), (m, v), strict=True)]
        whole[p] = whole.get(p, 0) + m
    eye = alpha * np.eye(d)
    models = {f"{p}|{a}": np.linalg.solve(m + eye, v) for (p, a), (m, v) in total.items()}
    fits = {}
    for (p, a), (m, v) in total.items():
        for f in range(folds):
            mine = sums.get((p, a, f), (0, 0))
            fits[f"{p}|{a}|{f}"] = np.linalg.solve(m - mine[0] + eye, v - mine[1])
    key = F.concat_ws("|", "problem", "arm")
    rest = (F.col("reward") - _predicted(fits, F.concat_ws("|", key, even_fold(folds).cast("string")), context)) / F.col("propensity")
    own = log.select("problem", "arm", rest.alias("r"), _predicted(models, key, context).alias("v")).groupBy("problem", "arm")
    own = own.agg(F.sum("r").alias("r"), F.sum(F.col("r") * F.col("r")).alias("rr"), F.sum(F.col("r") * F.col("v")).alias("rv"))
    known = [(*k.split("|"), float(m[0, 0]), float(t @ m[0]), float(t @ m @ t)) for k, t in models.items() for m in [whole[k.split("|")[0]]]]
    known = log.sparkSession.createDataFrame(known, "problem string, arm string, n double, v double, vv double")
    n, mean = F.col("n"), (F.col("v") + F.col("r")) / F.col("n")
    rows = truth.join(known, ["problem", "arm"], "left").join(own, ["problem", "arm"], "left")
    spread = F.greatest(F.lit(0.0), (F.col("vv") + 2 * F.col("rv") + F.col("rr") - n * mean * mean) / (n - 1))
    rows = rows.withColumns({"dm": F.col("v") / n, "dr": mean, "se": F.sqrt(spread / n)})
    return rows.select("problem", "arm", "truth", n.cast("long").alias("n"), "dm", "dr", "se", (F.abs(F.col("dr") - F.col("truth")) <= errors * F.col("se")).alias("recovered"))


def poisson(cluster: Column, draw: Column, seed: int) -> Column:
    """A Poisson(1) count for a cluster and draw, from a hash: the same wherever and however often it is computed."""
    u = (F.pmod(F.xxhash64(F.lit(seed), draw, cluster), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    steps, p, total = [], float(np.exp(-1)), 0.0
    for k in range(16):  # beyond 15 no step of u is left
        total += p
        steps.append(total)
        p /= k + 1
    return sum((F.when(u > s, 1).otherwise(0) for s in steps), F.lit(0))


def bootstrap(rows: DataFrame, value: Column, draws: int = 200, seed: int = 0) -> DataFrame:
    """low, high: the 2.5 and 97.5 percentiles of the mean of ``value`` over resampled clusters.

    Rows are summed by cluster first; each draw then weighs clusters by Poisson counts, so no cluster's rows are gathered.
    """
    sums = rows.groupBy("cluster").agg(F.sum(value).alias("_s"), F.count("*").alias("_n"))
    drawn = sums.select("*", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("_d")).withColumn("_w", poisson(F.col("cluster"), F.col("_d"), seed))
    means = drawn.where("_w > 0").groupBy("_d").agg((F.sum(F.col("_w") * F.col("_s")) / F.sum(F.col("_w") * F.col("_n"))).alias("_m"))
    both = means.agg(F.percentile("_m", F.array(F.lit(0.025), F.lit(0.975))).alias("p"))  # one row a draw
    return both.select(F.col("p")[0].alias("low"), F.col("p")[1].alias("high"))


def safety(log: DataFrame, context: list[str], arms: list[str], candidate: str, *, draws: int = 200, seed: int = 0, min_rows: int = SAFE_ROWS) -> DataFrame:
    """n, ess, support, value, baseline, low, high, verdict for always taking ``candidate`` against the uniform policy.

    Blocked where the whole interval of the difference is below 0; unknown with too few rows, weight or support.
    """
    baseline = {a: 1.0 / len(arms) for a in arms}
    rows = influence(influence(log, context, candidate, out="_candidate"), context, baseline, out="_baseline")
    ci = bootstrap(rows, F.col("_candidate") - F.col("_baseline"), draws, seed)
    one = rows.withColumn("weight", always(candidate) / F.col("propensity")).agg(
        F.count("*").alias("n"), F.coalesce(ratio(F.sum("weight") * F.sum("weight"), F.sum(F.col("weight") * F.col("weight"))), F.lit(0.0)).alias("ess"),
        F.count(F.when(F.col("arm") == candidate, 1)).alias("support"), F.avg("_candidate").alias("value"), F.avg("_baseline").alias("baseline"),
    ).join(ci)  # fmt: skip  # one row each
    enough = (F.col("n") >= min_rows) & (F.col("ess") >= min_rows / 2) & (F.col("support") >= max(3, min_rows // 10))
    verdict = F.when(~enough, "too_few_rows").when(F.col("high") < 0, "blocked").otherwise("usable")
    return one.select(F.lit(candidate).alias("arm"), "n", "ess", "support", "value", "baseline", "low", "high", verdict.alias("verdict"))


def bad_context(context: list[str], low: float = -10.0, high: float = 10.0) -> Column:
    """Whether a feature is missing, not finite or out of range."""
    out = F.lit(False)
    for c in context:
        x = F.col(c).cast("double")
        out = out | F.coalesce(F.isnan(x) | (x < low) | (x > high), F.lit(True))
    return out


def activation(log: DataFrame, context: list[str], arms: DataFrame) -> DataFrame:
    """n, least_support, ess, bad_context, reasons, active: whether a log is enough to let a policy act."""
    n_arms = arms.select("arm").distinct().count()
    one = weighted(log, F.lit(1.0 / max(n_arms, 1))).agg(
        F.count("*").alias("n"), F.coalesce(ratio(F.sum("weight") * F.sum("weight"), F.sum(F.col("weight") * F.col("weight"))), F.lit(0.0)).alias("ess"),
        F.coalesce(F.avg(bad_context(context).cast("double")), F.lit(0.0)).alias("bad_context"),
    ).join(support(log, arms).agg(F.min("n").alias("least_support")))  # fmt: skip  # one row each
    checks = [(F.col("n") < MIN_ROWS, "rows"), (F.col("least_support") < MIN_PER_ARM, "support"), (F.col("ess") < MIN_ESS, "ess"), (F.col("bad_context") > MAX_BAD_CONTEXT, "context")]
    reasons = F.array_compact(F.array(*(F.when(c, F.lit(r)) for c, r in checks)))
    return one.select("n", "least_support", "ess", "bad_context", F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) == 0).alias("active"))


# contextual bandit


@dataclass
class Bandit:
    """Per-arm statistics A = ridge I + sum w z z' and b = sum w r z, and what scoring needs of them."""

    arms: list[str]
    a: dict[str, np.ndarray]
    b: dict[str, np.ndarray]
    alpha: float = 1.0
    temperature: float = 1.0
    prior: dict[str, float] | None = None

    @classmethod
    def learn(cls, log: DataFrame, context: list[str], arms: list[str], ridge: float = 1.0, weight: Column | None = None, **how) -> Bandit:
        """From a whole log in one aggregate; ``weight`` discounts rows, as synthetic ones are when a model is warmed up."""
        d = len(context) + 1
        bandit = cls(arms, {x: ridge * np.eye(d) for x in arms}, {x: np.zeros(d) for x in arms}, **how)
        bandit.add(log, context, weight)
        return bandit

    def add(self, log: DataFrame, context: list[str], weight: Column | None = None) -> Bandit:
        """Add a batch's moments; batches in any order give one model."""
        for row in arm_moments(log.where(F.col("arm").isin(*self.arms)), context, ["arm"], weight).collect():
            a, b = _matrices(row, len(context) + 1)
            self.a[row["arm"]] = self.a[row["arm"]] + a
            self.b[row["arm"]] = self.b[row["arm"]] + b
        return self

    def scored(self, rows: DataFrame, key: str, context: list[str]) -> DataFrame:
        """key, arm, expected, uncertainty, score, propensity, best: the few arms are literals, rows are exploded over them."""
        per_arm = []
        z = _z(context)
        for arm in self.arms:
            inv = np.linalg.inv(self.a[arm])
            theta = inv @ self.b[arm]
            mean = sum((F.lit(float(t)) * x for t, x in zip(theta, z, strict=True)), F.lit(float((self.prior or {}).get(arm, 0.0))))
            spread = sum((F.lit(float(inv[i, j])) * z[i] * z[j] for i in range(len(z)) for j in range(len(z))), F.lit(0.0))
            per_arm.append(F.struct(F.lit(arm).alias("arm"), mean.alias("expected"), (self.alpha * F.sqrt(F.greatest(spread, F.lit(0.0)))).alias("uncertainty")))
        arms = F.transform(F.array(*per_arm), lambda x: x.withField("score", x["expected"] + x["uncertainty"]))
        wide = rows.select(key, arms.alias("_arms"))
        top = F.array_max(F.transform("_arms", lambda x: x["score"]))
        wide = wide.withColumn("_top", top).withColumn("_sum", F.aggregate("_arms", F.lit(0.0), lambda s, x: s + F.exp((x["score"] - F.col("_top")) / self.temperature)))
        first = F.element_at(F.filter("_arms", lambda x: x["score"] == F.col("_top")), 1)["arm"]
        flat = wide.withColumn("_first", first).select(key, "_top", "_sum", "_first", F.explode("_arms").alias("r"))
        return flat.select(key, "r.arm", "r.expected", "r.uncertainty", "r.score", (F.exp((F.col("r.score") - F.col("_top")) / self.temperature) / F.col("_sum")).alias("propensity"), (F.col("r.arm") == F.col("_first")).alias("best"))


def epsilon_greedy(scored: DataFrame, key: str, epsilon: float, excluded: list[str], explore: bool = True) -> DataFrame:
    """key, arm, probability, served: the best expected arm gets the rest of 1 - epsilon, others share it; excluded arms get none.

    Where every arm is excluded, or without ``explore``, the best of all is served for certain.
    """
    w = Window.partitionBy(key)
    order = w.orderBy(F.col("expected").desc(), F.col("arm"))
    out = F.col("arm").isin(*excluded) if excluded else F.lit(False)
    rows = scored.withColumns({"_out": out, "_k": F.count(F.when(~out, 1)).over(w), "_all": F.row_number().over(order), "_in": F.row_number().over(w.orderBy(out, F.col("expected").desc(), F.col("arm")))})
    trial = F.when(F.col("_out"), 0.0).when(F.col("_in") == 1, 1 - epsilon + epsilon / F.col("_k")).otherwise(epsilon / F.col("_k"))
    sure = (F.col("_all") == 1).cast("double")
    p = F.when(F.lit(explore) & (F.col("_k") > 0), trial).otherwise(sure)
    return rows.select(key, "arm", p.alias("probability"), (F.col("_all") == 1).alias("served"))


def agreement(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, first, second, agree: the best arms of two policies' scores, ties to the smaller name."""
    best = lambda df, name: df.groupBy(key).agg(F.min(F.struct(-F.col("score"), F.col("arm"))).alias("_m")).select(key, F.col("_m.arm").alias(name))
    return best(a, "first").join(best(b, "second"), key).withColumn("agree", F.col("first") == F.col("second"))


def stop_rule(rows: DataFrame, rules: DataFrame, by: str) -> DataFrame:
    """(by, action): stop where the blocked share is too high; wait below the least days or stores; else go on."""
    both = rows.join(rules, by)
    action = F.when(F.col("blocked") / F.nullif(F.col("n"), F.lit(0)) > F.col("max_blocked"), "stop").when((F.col("days") < F.col("min_days")) | (F.col("stores") < F.col("min_stores")), "wait").otherwise("continue")
    return both.select(by, action.alias("action"))
