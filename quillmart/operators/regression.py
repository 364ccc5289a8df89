"""Least squares with group dummies and cluster-robust errors, from moments.

Dummies are never made: within-group centring gives the same coefficients, and centred moments follow from sums by
group, a few small matrices. Leaving a group out takes its matrices away, so every refit comes from one pass.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmart.operators.panel import at_lag

#: Fixed values of the verdict: rows needed, significance, stability of the sign over left-out groups.
MIN_ROWS, SIGNIFICANT, STABLE = 1_000, 0.05, 0.7


@dataclass
class Moments:
    """Sums by group: n, sums and products of (y, x...)."""

    names: list[str]
    by: dict[object, tuple[int, np.ndarray, np.ndarray]] = field(default_factory=dict)

    @classmethod
    def of(cls, df: DataFrame, y: str, xs: list[str], group: str) -> Moments:
        cols = [y, *xs]
        d = len(cols)
        sums = [F.sum(c).alias(f"s{i}") for i, c in enumerate(cols)]
        products = [F.sum(F.col(cols[i]) * F.col(cols[j])).alias(f"p{i}_{j}") for i in range(d) for j in range(i, d)]
        out = cls(xs)
        for row in df.groupBy(group).agg(F.count("*").alias("n"), *sums, *products).collect():
            p = np.zeros((d, d))
            for i in range(d):
                for j in range(i, d):
                    p[i, j] = p[j, i] = row[f"p{i}_{j}"]
            out.by[row[group]] = (row["n"], np.array([row[f"s{i}"] for i in range(d)]), p)
        return out

    def centred(self, without: object = None) -> np.ndarray:
        parts = [p - np.outer(s, s) / n for g, (n, s, p) in self.by.items() if g != without]
        return sum(parts, np.zeros((len(self.names) + 1,) * 2))

    def fit(self, without: object = None) -> np.ndarray:
        c = self.centred(without)
        return np.linalg.lstsq(c[1:, 1:], c[1:, 0], rcond=None)[0]

    def rows(self, without: object = None) -> int:
        return sum(n for g, (n, _, _) in self.by.items() if g != without)


@dataclass
class Fit:
    names: list[str]
    coef: np.ndarray
    se: np.ndarray
    n: int
    clusters: int
    sign_stability: np.ndarray

    @property
    def p(self) -> np.ndarray:
        """Two-sided, normal."""
        z = np.divide(self.coef, self.se, out=np.full(len(self.coef), np.nan), where=self.se > 0)
        return np.array([math.erfc(abs(v) / math.sqrt(2)) if np.isfinite(v) else np.nan for v in z])


def fit(df: DataFrame, y: str, xs: list[str], group: str, cluster: str, min_rows: int = 1) -> Fit | None:
    """y on xs with a dummy a group, errors clustered; rows with a null take no part; None below ``min_rows`` rows.

    Two passes: moments by group, then scores by cluster, of which again only sums of products reach the driver.
    """
    known = df.where(" and ".join(f"`{c}` is not null" for c in (y, *xs, group, cluster))).select(group, cluster, *(F.col(c).cast("double").alias(c) for c in (y, *xs)))
    m = Moments.of(known, y, xs, group)
    n = m.rows()
    if n < min_rows or not n:
        return None
    beta = m.fit()
    means = F.create_map(*(v for g, (k, s, _) in m.by.items() for v in (F.lit(g), F.array(*(F.lit(float(a)) for a in s / k)))))
    mu = F.element_at(means, F.col(group))
    xc = [F.col(c) - mu[i + 1] for i, c in enumerate(xs)]
    residual = F.col(y) - mu[0] - sum((F.lit(float(b)) * x for b, x in zip(beta, xc, strict=True)), F.lit(0.0))
    scores = known.groupBy(cluster).agg(*(F.sum(residual * x).alias(f"u{i}") for i, x in enumerate(xc)))
    d = len(xs)
    row = scores.agg(F.count("*").alias("g"), *(F.sum(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"m{i}_{j}") for i in range(d) for j in range(i, d))).first()
    meat = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            meat[i, j] = meat[j, i] = row[f"m{i}_{j}"]
    bread = np.linalg.pinv(m.centred()[1:, 1:])
    g, k = row["g"], d + len(m.by)
    scale = g / (g - 1) * (n - 1) / (n - k) if g > 1 and n > k else np.nan
    se = np.sqrt(np.maximum(np.diag(bread @ meat @ bread) * scale, 0))
    kept = [q for q in m.by if m.rows(q) >= min_rows and len(m.by) > 1]
    stable = np.mean([np.sign(m.fit(q)) == np.sign(beta) for q in kept], axis=0) if kept else np.zeros(d)
    return Fit(xs, beta, se, n, g, stable)


def verdicts(df: DataFrame, y: str, xs: list[str], controls: list[str], group: str, cluster: str, cell: list[str], serial: str, min_rows: int = MIN_ROWS) -> DataFrame:
    """name, coef, se, p, placebo_p, sign_stability, n, usable of each x.

    The placebo puts next quarter's value in its place. Usable: significant, the placebo isn't, and the sign holds
    whichever group is left out. With too few rows every figure is null and ``usable`` false.
    """
    spark = df.sparkSession
    schema = "name string, coef double, se double, p double, placebo_p double, sign_stability double, n long, usable boolean"
    found = fit(df, y, [*xs, *controls], group, cluster, min_rows)
    if found is None:
        return spark.createDataFrame([(x, None, None, None, None, None, df.count(), False) for x in xs], schema)
    order = Window.partitionBy(*cell).orderBy(serial)
    moved = df.withColumns({f"_next_{x}": F.lead(x).over(order) for x in xs})
    placebo = fit(moved, y, [*(f"_next_{x}" for x in xs), *controls], group, cluster, min_rows)
    out = []
    for i, x in enumerate(xs):
        p, q = float(found.p[i]), float(placebo.p[i]) if placebo else None
        usable = p < SIGNIFICANT and (q is None or q >= SIGNIFICANT) and found.sign_stability[i] >= STABLE
        out.append((x, float(found.coef[i]), float(found.se[i]), p, q, float(found.sign_stability[i]), found.n, bool(usable)))
    return spark.createDataFrame(out, schema)


def log_difference(value: str, cell: list[str], serial: str, floor: bool = True) -> Column:
    """log1p change against exactly the quarter before."""
    x, before = F.col(value), at_lag(value, cell, serial, 1)
    hold = (lambda c: F.greatest(c, F.lit(0.0))) if floor else (lambda c: c)
    return F.when(x.isNotNull() & before.isNotNull(), F.log1p(hold(x.cast("double"))) - F.log1p(hold(before.cast("double"))))


def _combination(controls: list[str]) -> Column:
    """One text for each combination of values, nulls among them."""
    return F.to_json(F.struct(*controls), {"ignoreNullFields": "false"}) if controls else F.lit("")


def factor_fits(days: DataFrame, factors: list[str], target: str, controls: list[str], cluster: str = "day", splits: int = 3) -> list[dict]:
    """coef, se, p, effect_pct, low_pct, high_pct, n, unit, sd, gain_pct of log1p(target) on each factor by itself, with dummies for the combinations of ``controls``.

    A factor of 0 and 1 is used as it is, any other in standard deviations. ``gain_pct``: by how many percent the factor
    lowers the absolute error on later days, over expanding splits; 0 with fewer than 60 days. Factors with fewer than
    30 rows, one value, or none that varies within a combination are left out, and rows without target, factor, day or
    cluster take no part.

    Factors are rows, so all of them share two passes: moments by factor, combination and block of days, whose prefix
    sums are every split's model and, over all blocks, the whole one; then scores by cluster and errors by block. One
    row a factor reaches the driver.
    """
    from quillmart.operators.storage import stored

    each = F.array(*(F.struct(F.lit(f).alias("factor"), F.col(f).cast("double").alias("_x")) for f in factors))
    long = days.select(F.log1p(target).alias("_y"), _combination(controls).alias("_g"), F.col(cluster).alias("_c"), F.col("day").alias("_day"), F.explode(each).alias("_f"))
    long = long.select("_f.factor", "_f._x", "_y", "_g", "_c", "_day").where("_x is not null and _y is not null and _c is not null and _day is not null")
    long = stored(long, "factors")
    other = F.sum((~F.col("_x").isin(0, 1)).cast("int"))
    stats = long.groupBy("factor").agg(F.count("*").alias("rows"), F.stddev_pop("_x").alias("sd"), (other == 0).alias("binary")).where("rows >= 30 and sd > 0")

    # one row a factor and day
    by_day = Window.partitionBy("factor")
    dates = long.select("factor", "_day").distinct().withColumns({"_r": F.row_number().over(by_day.orderBy("_day")) - 1, "_days": F.count("*").over(by_day)})
    size = F.greatest(F.lit(1), F.floor(F.col("_days") / (splits + 1)))
    block = F.greatest(F.lit(0), splits - F.floor((F.col("_days") - 1 - F.col("_r")) / size)).cast("int")
    rows = long.join(dates.select("factor", "_day", "_days", block.alias("_block")), ["factor", "_day"])

    x, y, whole = F.col("_x"), F.col("_y"), splits + 1
    moments = rows.groupBy("factor", "_g", "_block").agg(F.count("*").alias("n"), F.sum(y).alias("y"), F.sum(x).alias("x"), F.sum(x * y).alias("xy"), F.sum(x * x).alias("xx"))
    models = moments.withColumn("k", F.explode(F.sequence(F.col("_block") + 1, F.lit(whole)))).groupBy("factor", "k", "_g").agg(*(F.sum(c).alias(c) for c in ("n", "y", "x", "xy", "xx")))
    n = F.col("n")
    sxx, sxy = F.sum(F.col("xx") - F.col("x") ** 2 / n), F.sum(F.col("xy") - F.col("x") * F.col("y") / n)
    beta = F.when(sxx > 1e-12 * F.sum("xx"), sxy / sxx)
    slopes = models.groupBy("factor", "k").agg(beta.alias("beta"), sxx.alias("sxx"), F.sum("n").alias("n"), F.count("*").alias("groups"), (F.sum("y") / F.sum("n")).alias("y"), (F.sum("x") / F.sum("n")).alias("x"))
    keyed = lambda *value: F.map_from_entries(F.collect_list(F.struct("k", F.struct(*value))))
    slopes = slopes.groupBy("factor").agg(keyed("beta", "sxx", "n", "groups", "y", "x").alias("_fit"))
    means = models.groupBy("factor", "_g").agg(keyed((F.col("y") / n).alias("y"), (F.col("x") / n).alias("x")).alias("_mean"))

    at = lambda column, k: F.element_at(column, k)
    total, mean = at("_fit", F.lit(whole)), at("_mean", F.lit(whole))
    xc = x - mean["x"]
    score = (y - mean["y"] - total["beta"] * xc) * xc
    model, seen = at("_fit", F.col("_block")), at("_mean", F.col("_block"))
    my, mx = F.coalesce(seen["y"], model["y"]), F.coalesce(seen["x"], model["x"])
    plain, fitted = F.abs(y - my), F.abs(y - my - F.coalesce(model["beta"], F.lit(0.0)) * (x - mx))
    scored = rows.join(means, ["factor", "_g"]).join(slopes, "factor").withColumns({"_u": score, "_plain": plain, "_fitted": fitted})
    within = lambda k, value: F.sum(F.when(F.col("_block") == k, value))
    ks = range(1, whole)
    errors = [e.alias(f"{name}{k}") for k in ks for name, e in (("n", within(k, 1)), ("p", within(k, F.col("_plain"))), ("f", within(k, F.col("_fitted"))))]
    clusters = scored.groupBy("factor", "_c").agg(F.sum("_u").alias("u"), F.first("_fit").alias("_fit"), F.first("_days").alias("_days"), *errors)
    sums = [F.sum(f"{name}{k}").alias(f"{name}{k}") for k in ks for name in "npf"]
    result = clusters.groupBy("factor").agg(F.count("*").alias("clusters"), F.sum(F.col("u") ** 2).alias("meat"), F.first("_fit").alias("_fit"), F.first("_days").alias("days"), *sums)
    result = result.join(stats, "factor").select("*", total.alias("_all")).drop("_fit")

    found = {}
    for r in result.collect():
        a, g = r["_all"], r["clusters"]
        if a["beta"] is None:
            continue
        unit = 1.0 if r["binary"] else r["sd"]
        k = 1 + a["groups"]
        scale = g / (g - 1) * (a["n"] - 1) / (a["n"] - k) if g > 1 and a["n"] > k else math.nan
        b, se = a["beta"] * unit, math.sqrt(max(r["meat"] * scale, 0.0)) / a["sxx"] * unit if scale == scale else math.nan
        gain = 0.0
        if r["days"] >= 60:
            before, after = (float(np.mean([r[f"{name}{k}"] / r[f"n{k}"] for k in ks])) for name in "pf")
            gain = (before - after) / before * 100 if before else 0.0
        p = math.erfc(abs(b / se) / math.sqrt(2)) if se > 0 else math.nan
        percent = lambda v: math.expm1(v) * 100
        reach = 1.959963984540054 * se
        found[r["factor"]] = {"factor": r["factor"], "coef": b, "se": se, "p": p, "effect_pct": percent(b), "low_pct": percent(b - reach), "high_pct": percent(b + reach), "n": a["n"], "unit": "binary" if r["binary"] else "deviation", "sd": r["sd"], "gain_pct": gain}
    return [found[f] for f in factors if f in found]


def factor_effect(days: DataFrame, factor: str, target: str, controls: list[str], cluster: str = "day") -> dict | None:
    """The one factor's row of ``factor_fits``, or None."""
    return next(iter(factor_fits(days, [factor], target, controls, cluster)), None)


def validation_gain(days: DataFrame, factor: str, target: str, controls: list[str], splits: int = 3) -> float:
    """The one factor's ``gain_pct`` of ``factor_fits``; 0 where it is left out."""
    return next((r["gain_pct"] for r in factor_fits(days, [factor], target, controls, "day", splits)), 0.0)


def period_attribution(days: DataFrame, factors: list[str], base: Column, current: Column, controls: list[str]) -> DataFrame:
    """factor, before, after, effect_pct, amount, p, adjusted_p, join_rate, gain_pct, confidence, direction: what a factor's move between two stretches goes along with.

    Associations, not causes. All factors' means come from one aggregate and their fits from the passes of ``factor_fits``.
    """
    from quillmart.functions.classify import effect_confidence
    from quillmart.operators.ranking import adjusted_p

    means = [m for i, f in enumerate(factors) for m in (F.avg(F.when(base, F.col(f).cast("double"))).alias(f"b{i}"), F.avg(F.when(current, F.col(f).cast("double"))).alias(f"c{i}"), F.avg(F.col(f).isNotNull().cast("double")).alias(f"j{i}"))]
    row = days.agg(F.sum(F.when(base, F.col("revenue"))).cast("double").alias("revenue"), *means).first()
    fits = {r["factor"]: r for r in factor_fits(days, factors, "revenue", controls)}
    out = []
    for i, f in enumerate(factors):
        got, before, after = fits.get(f), row[f"b{i}"], row[f"c{i}"]
        if got is None or before is None or after is None:
            continue
        delta = (after - before) / (1.0 if got["unit"] == "binary" else got["sd"])
        effect = math.expm1(got["coef"] * delta) * 100
        out.append((f, before, after, effect, (row["revenue"] or 0.0) * effect / 100, got["p"], row[f"j{i}"], got["gain_pct"]))
    df = days.sparkSession.createDataFrame(out, "factor string, before double, after double, effect_pct double, amount double, p double, join_rate double, gain_pct double")
    a = F.col("amount")
    return adjusted_p(df, "p", "factor", "adjusted_p").withColumns({"confidence": effect_confidence(F.col("adjusted_p"), F.col("join_rate"), F.col("gain_pct")), "direction": F.when(a > 0, "positive").when(a < 0, "negative").otherwise("neutral")})
