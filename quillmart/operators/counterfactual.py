"""Synthetic control: what a cell's sales would have been, from a weighted mix of cells it moves with."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmart.functions.columns import ratio
from quillmart.operators.panel import MIN_PEERS, MIN_QUARTERS
from quillmart.operators.storage import stored

#: Donors kept, donors needed, and the error in logs up to which a fit is good.
MAX_DONORS, MIN_DONORS, GOOD_RMSE = 30, 3, 0.15
#: Districts of an industry that meet in one task, on either side; correlations equal to so many digits are ties.
BLOCK, TIED = 256, 12


def donor_pool(panel: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, industry, as_of, donor): other districts of the industry with six quarters up to ``as_of``, of the same type where that has twenty.

    ``targets(district, industry, as_of)``.
    """
    kinds = panel.groupBy("district").agg(F.max("district_type").alias("kind"))
    t = targets.join(kinds, "district").select(F.col("district").alias("target"), "industry", "as_of", F.col("kind").alias("_kind"))
    p = panel.join(t, "industry").where((F.col("district") != F.col("target")) & (F.col("q") <= F.col("as_of")))
    n = p.groupBy("target", "industry", "as_of", F.col("district").alias("donor")).agg(F.count_distinct("q").alias("_n"), (F.max("district_type") == F.max("_kind")).alias("_same"))
    w = Window.partitionBy("target", "industry", "as_of")
    near = n.withColumn("_peers", F.count(F.when(F.col("_same"), 1)).over(w))
    return near.where((F.col("_n") >= MIN_QUARTERS) & ((F.col("_peers") < MIN_PEERS) | F.col("_same"))).select("target", "industry", "as_of", "donor")


def series(panel: DataFrame) -> DataFrame:
    """(industry, district, kind, s): each cell's quarters and log sales as one array in order; ``kind`` is the district's type."""
    kinds = panel.groupBy("district").agg(F.max("district_type").alias("kind"))
    cells = panel.groupBy("industry", "district").agg(F.sort_array(F.collect_list(F.struct("q", F.log1p("sales").alias("v")))).alias("s"))
    return cells.join(kinds, "district").select("industry", "district", "kind", "s")


def _matrix(f: pd.DataFrame, place: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Which of the quarters in ``place`` each row of ``qs`` has, and its values there, 0 elsewhere."""
    row = np.repeat(np.arange(len(f)), f["qs"].map(len))
    at = np.array([place.get(q, -1) for qs in f["qs"] for q in qs], np.int64)
    v = np.array([x for vs in f["vs"] for x in vs])
    row, at, v = row[at >= 0], at[at >= 0], v[at >= 0]
    has, value = np.zeros((len(f), len(place))), np.zeros((len(f), len(place)))
    has[row, at], value[row, at] = 1.0, v
    return has, value


def correlations(t: pd.DataFrame, d: pd.DataFrame) -> np.ndarray:
    """Targets by donors: the correlation over the target's quarters, -1 for a donor that doesn't vary, NaN for one that lacks a quarter.

    Rows have ``qs`` and ``vs``. Sums over each target's own quarters are products of masked matrices, of series less
    their common mean.
    """
    place = {q: i for i, q in enumerate(sorted({q for qs in t["qs"] for q in qs}))}
    (mask, y), (has, x) = _matrix(t, place), _matrix(d, place)
    shared = y.sum() / max(mask.sum(), 1.0)
    y, x = (y - shared) * mask, (x - shared) * has
    n, own = mask.sum(1)[:, None], y.sum(1)[:, None]
    sx, sxx, sxy = mask @ x.T, mask @ (x * x).T, y @ x.T
    vx, vy = n * sxx - sx * sx, n * (y * y).sum(1)[:, None] - own * own
    still = vx <= 1e-12 * n * sxx
    with np.errstate(all="ignore"):
        r = np.where(still | (vy <= 1e-12 * n * (y * y).sum(1)[:, None]), -1.0, (n * sxy - own * sx) / np.sqrt(vx * vy))
    return np.where(mask @ has.T == n, np.clip(r, -1.0, 1.0), np.nan)


def similar_donors(panel: DataFrame, targets: DataFrame, k: int = MAX_DONORS) -> DataFrame:
    """(target, industry, as_of, donor, r): of each target's pool the ``k`` that correlate most with it over its quarters up to ``as_of``.

    The pool is that of ``donor_pool``; donors that lack one of the target's quarters go, and so do targets with fewer
    than six. No row is made of a target, a donor and a quarter: a cell's series is one row, targets and donors of
    an industry meet in blocks of some ``BLOCK`` by ``BLOCK``, each block pair keeps ``k`` donors a target, and the
    best of those are taken. So an industry with a third of all cells is dealt over tasks like any other.
    """
    key = ["industry", "as_of"]
    cells = stored(series(panel), "series")
    upto = cells.join(targets.select(*key).distinct(), "industry").withColumn("s", F.filter("s", lambda x: x["q"] <= F.col("as_of")))
    upto = stored(upto.select(*key, "district", "kind", F.col("s.q").alias("qs"), F.col("s.v").alias("vs")).where(F.size("s") > 0), "series")
    donors = upto.where(F.size(F.array_distinct("qs")) >= MIN_QUARTERS)
    peers = donors.where(F.col("kind").isNotNull()).groupBy(*key, "kind").agg(F.count("*").alias("_peers"))
    mine = upto.join(targets.select("district", *key).distinct(), ["district", *key]).where(F.size("qs") >= MIN_QUARTERS).join(peers, [*key, "kind"], "left")
    own = F.when(F.size(F.array_distinct("qs")) >= MIN_QUARTERS, 1).otherwise(0)
    mine = mine.withColumn("narrow", F.coalesce(F.col("_peers") - own >= MIN_PEERS, F.lit(False))).drop("_peers")
    blocks = lambda rows: F.ceil(F.count("*") / BLOCK).cast("int")  # noqa: E731, ARG005
    sizes = donors.groupBy(*key).agg(blocks(donors).alias("_d")).join(mine.groupBy(*key).agg(blocks(mine).alias("_t")), key)
    deal = lambda n: F.pmod(F.xxhash64("district"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = mine.join(sizes, key).select(*key, "district", "kind", "narrow", "qs", "vs", deal("_t").alias("a"), each("_d").alias("b"))
    right = donors.join(sizes, key).select(*key, "district", "kind", "qs", "vs", deal("_d").alias("b"), each("_t").alias("a"))
    right = right.select(*(F.col(c).alias(c) for c in right.columns))  # columns of their own beside the targets'

    def best(t: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if not len(t) or not len(d):
            return pd.DataFrame({c: [] for c in ("target", *key, "donor", "r")})
        r = correlations(t, d)
        names, kinds = d["district"].to_numpy(), d["kind"].to_numpy()
        out = []
        for i, (name, kind, narrow) in enumerate(zip(t["district"], t["kind"], t["narrow"], strict=True)):
            ok = np.flatnonzero(~np.isnan(r[i]) & (names != name) & ((kinds == kind) | (not narrow)))
            score = np.round(r[i, ok], TIED)
            top = np.lexsort((names[ok], -score))[:k]
            out.append(pd.DataFrame({"target": name, "donor": names[ok[top]], "r": score[top]}))
        return pd.concat(out, ignore_index=True).assign(industry=t["industry"].iloc[0], as_of=t["as_of"].iloc[0])[["target", *key, "donor", "r"]]

    kinds = dict(upto.dtypes)
    schema = f"target {kinds['district']}, industry {kinds['industry']}, as_of {kinds['as_of']}, donor {kinds['district']}, r double"
    found = left.groupBy(*key, "a", "b").cogroup(right.groupBy(*key, "a", "b")).applyInPandas(best, schema)
    w = Window.partitionBy("target", *key).orderBy(F.col("r").desc(), "donor")
    return found.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).drop("_k")


def aligned(panel: DataFrame, chosen: DataFrame) -> DataFrame:
    """(target, industry, as_of, donor, r, q, y, x): log sales of targets and their chosen donors on the target's quarters."""
    one = panel.select("district", "industry", "q", F.log1p("sales").alias("_v"))
    y = one.withColumnsRenamed({"district": "target", "_v": "y"}).join(chosen, ["target", "industry"]).where(F.col("q") <= F.col("as_of"))
    return y.join(one.withColumnsRenamed({"district": "donor", "_v": "x"}), ["donor", "industry", "q"]).select("target", "industry", "as_of", "donor", "r", "q", "y", "x")


def simplex_weights(x: np.ndarray, y: np.ndarray, rounds: int = 20_000, tolerance: float = 1e-12) -> np.ndarray:
    """Non-negative weights of sum 1 least in mean squared error: accelerated projected gradient."""
    # weights sum to 1, so what all donors share can be taken from both sides: what is left is well scaled
    shared = x.mean(1)
    x, y = x - shared[:, None], y - shared
    n, d = x.shape
    g, c = x.T @ x / n, x.T @ y / n
    step = 1.0 / max(np.linalg.eigvalsh(g)[-1], 1e-12)
    w = v = np.full(d, 1.0 / d)
    t = 1.0
    for _ in range(rounds):
        z = v - step * (g @ v - c)
        u = np.sort(z)[::-1]
        s = np.cumsum(u) - 1
        k = np.nonzero(u - s / np.arange(1, d + 1) > 0)[0][-1]
        new = np.maximum(z - s[k] / (k + 1), 0)
        if (new - w) @ (z - new) > 0:  # restart where momentum points uphill
            t = 1.0
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t2 * (new - w)
        moved, w, t = np.abs(new - w).max(), new, t2
        if moved < tolerance:
            break
    return w


def weights(rows: DataFrame) -> DataFrame:
    """(target, industry, as_of, donor, weight, rmse, n): one small problem a target, of at most ``MAX_DONORS`` donors times its quarters."""
    keys = ["target", "industry", "as_of"]

    def solve(f: pd.DataFrame) -> pd.DataFrame:
        wide = f.pivot(index="q", columns="donor", values="x").sort_index()
        y = f.drop_duplicates("q").set_index("q")["y"].loc[wide.index].to_numpy()
        x = wide.to_numpy()
        w = simplex_weights(x, y)
        out = f[keys].iloc[[0]].loc[lambda g: g.index.repeat(len(w))].reset_index(drop=True)
        return out.assign(donor=wide.columns.to_numpy(), weight=w, rmse=float(np.sqrt(np.mean((y - x @ w) ** 2))), n=len(y))

    kinds = dict(rows.dtypes)
    return rows.groupBy(*keys).applyInPandas(solve, ", ".join(f"{k} {kinds[k]}" for k in [*keys, "donor"]) + ", weight double, rmse double, n long")


def baseline(panel: DataFrame, targets: DataFrame) -> DataFrame:
    """(district, industry, as_of, donors, rmse, good, expected): next quarter's sales without a change.

    Null where a donor that counts has no such quarter; targets with fewer than ``MIN_DONORS`` donors are left out.
    """
    keys = ["target", "industry", "as_of"]
    panel = stored(panel.select("district", "district_type", "industry", "q", "sales"), "panel")
    w = weights(aligned(panel, similar_donors(panel, targets)))
    after = panel.select(F.col("district").alias("donor"), "industry", F.col("q").alias("_q"), F.log1p("sales").alias("_x"))
    both = w.withColumn("_q", F.col("as_of") + 1).join(after, ["donor", "industry", "_q"], "left")
    out = both.groupBy(*keys).agg(F.count("*").alias("donors"), F.max("rmse").alias("rmse"), F.count("_x").alias("_k"), F.sum(F.col("weight") * F.col("_x")).alias("_s"))
    out = out.where(F.col("donors") >= MIN_DONORS)
    return out.select(F.col("target").alias("district"), "industry", "as_of", "donors", "rmse", (F.col("rmse") <= GOOD_RMSE).alias("good"), F.when(F.col("_k") == F.col("donors"), F.expm1("_s")).alias("expected"))


def fitted(panel: DataFrame, targets: DataFrame, value: str = "sales") -> DataFrame:
    """(district, industry, as_of, q, actual, expected) before the change; with another ``value`` the same weights mix that column."""
    keys = ["target", "industry", "as_of"]
    rows = stored(aligned(panel, similar_donors(panel, targets)), "aligned")
    w = weights(rows).select(*keys, "donor", "weight")
    one = panel.select("district", "industry", "q", F.col(value).alias("_v"))
    mix = rows.select(*keys, "donor", "q").join(w, [*keys, "donor"]).join(one.withColumnRenamed("district", "donor"), ["donor", "industry", "q"])
    expected = mix.groupBy(*keys, "q").agg(F.expm1(F.sum(F.col("weight") * F.log1p("_v"))).alias("expected"))
    actual = one.withColumnsRenamed({"district": "target", "_v": "actual"})
    return expected.join(actual, ["target", "industry", "q"]).select(F.col("target").alias("district"), "industry", "as_of", "q", "actual", "expected")


def effects(panel: DataFrame, cases: DataFrame) -> DataFrame:
    """(district, industry, as_of, effect, good) of ``cases(district, industry, as_of, after)``: the relative gap to what was expected."""
    b = baseline(panel, cases.select("district", "industry", "as_of").distinct())
    return cases.join(b, ["district", "industry", "as_of"]).select("district", "industry", "as_of", ratio(F.col("after") - F.col("expected"), F.col("expected")).alias("effect"), "good").where(F.col("effect").isNotNull())


def mean_effect(found: DataFrame, own: Column, draws: int = 500, seed: int = 0) -> DataFrame:
    """n, mean, low, high, good_share, scope: over the cases of the cell itself (``own``), or of the industry where it has none."""
    from quillmart.operators.policy import bootstrap

    found = stored(found, "effects")
    mine = found.where(own)
    scope, rows = ("cell", mine) if not mine.isEmpty() else ("industry", found)
    keyed = rows.withColumn("cluster", F.xxhash64("district", "industry", "as_of", "effect"))
    one = keyed.agg(F.count("*").alias("n"), F.avg("effect").alias("mean"), F.avg(F.col("good").cast("double")).alias("good_share"))
    return one.join(bootstrap(keyed, F.col("effect"), draws, seed)).withColumn("scope", F.lit(scope))  # one row each

