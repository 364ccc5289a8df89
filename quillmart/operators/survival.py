"""Risk of shrinking: event frames, Cox regression with time-varying covariates, survival curves, concordance.

The event is a fall of the store count by a fifth from its running peak. Everything per row is a window or an
aggregate; the driver sees sums by time, as many as there are quarters.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmart.operators.panel import CELL, MIN_QUARTERS, history
from quillmart.operators.ranking import quantile_bucket
from quillmart.operators.storage import stored

THRESHOLD = 0.20
COVARIATES = ["sales_fall", "traffic_change", "log_stores"]


def event_frame(panel: DataFrame, covariates: list[str] = COVARIATES, threshold: float = THRESHOLD) -> DataFrame:
    """(cell, start, stop, event, covariates): a row a quarter up to and with the first event; cells of fewer than six quarters, and of one usable row, go."""
    w = Window.partitionBy(*CELL)
    rows = history(panel).withColumns({"_n": F.count(F.lit(1)).over(w), "_ev": F.min(F.when(F.col("store_fall") >= threshold, F.col("t"))).over(w)})
    rows = rows.where((F.col("_n") >= MIN_QUARTERS) & (F.col("_ev").isNull() | (F.col("t") <= F.col("_ev"))))
    out = rows.select(*CELL, F.col("t").alias("start"), (F.col("t") + 1).alias("stop"), F.coalesce((F.col("t") == F.col("_ev")).cast("int"), F.lit(0)).alias("event"), *covariates)
    return out.dropna(subset=covariates).withColumn("_k", F.count(F.lit(1)).over(w)).where("_k >= 2").drop("_k")


def cox(frame: DataFrame, covariates: list[str] = COVARIATES, ridge: float = 0.1, rounds: int = 25, tolerance: float = 1e-7) -> dict:
    """Coefficients on standardised covariates, their means and deviations, hazard ratios, log likelihood.

    Newton's method on Efron's partial likelihood less ridge / 2 times the squared coefficients. At a time's risk set
    only sums are needed, so each round is one aggregate by time.
    """
    k = len(covariates)
    frame = stored(frame.select("stop", "event", *covariates), "events")
    row = frame.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(covariates)), *(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(covariates))).first()
    mean, sd = np.array([row[f"m{i}"] or 0.0 for i in range(k)]), np.array([row[f"s{i}"] or 1.0 for i in range(k)])
    x = [((F.col(c) - float(mean[i])) / float(sd[i])) for i, c in enumerate(covariates)]
    beta, value = np.zeros(k), -np.inf
    for _ in range(rounds):
        eta = F.exp(sum((F.lit(float(b)) * c for b, c in zip(beta, x, strict=True)), F.lit(0.0)))
        sums = {"r": F.lit(1.0)} | {f"r{i}": x[i] for i in range(k)} | {f"r{i}_{j}": x[i] * x[j] for i in range(k) for j in range(i, k)}
        died = F.col("event") == 1
        aggs = [F.sum(v * eta).alias(n) for n, v in sums.items()] + [F.sum(F.when(died, v * eta)).alias(f"d{n}") for n, v in sums.items()] + [F.sum(F.when(died, v)).alias(f"e{i}") for i, v in enumerate(x)] + [F.sum("event").alias("n")]
        gradient, hessian, loglik = -ridge * beta, -ridge * np.eye(k), -ridge / 2 * float(beta @ beta)
        for r in frame.groupBy("stop").agg(*aggs).where("n > 0").orderBy("stop").collect():
            n = int(r["n"])
            full = lambda p: (r[p], np.array([r[f"{p}{i}"] for i in range(k)]), np.array([[r[f"{p}{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]))  # noqa: B023, E731
            (a, b, c), (da, db, dc) = full("r"), full("dr")
            e = np.array([r[f"e{i}"] for i in range(k)])
            loglik += float(beta @ e)
            gradient = gradient + e
            for step in range(n):
                s = step / n
                z, zx, zxx = a - s * da, (b - s * db), (c - s * dc)
                m = zx / z
                loglik -= np.log(z)
                gradient = gradient - m
                hessian = hessian - (zxx / z - np.outer(m, m))
        if loglik - value < tolerance and np.isfinite(value):
            break
        value = loglik
        beta = beta - np.linalg.solve(hessian, gradient)
    return {"covariates": covariates, "beta": beta, "mean": mean, "sd": sd, "hazard_ratio": np.exp(beta / sd), "se": np.sqrt(np.diag(np.linalg.inv(-hessian))), "loglik": value}


def risk(frame: DataFrame, model: dict) -> DataFrame:
    """The frame with ``risk``, the partial hazard against a mean row."""
    lin = sum((F.lit(float(b / s)) * (F.col(c) - float(m)) for c, b, m, s in zip(model["covariates"], model["beta"], model["mean"], model["sd"], strict=True)), F.lit(0.0))
    return frame.withColumn("risk", F.exp(lin))


def cells(scored: DataFrame, buckets: int = 5) -> DataFrame:
    """Per cell: mean risk, whether it had the event, duration, and its equal-frequency risk bucket."""
    each = scored.groupBy(*CELL).agg(F.avg("risk").alias("risk"), F.max("event").alias("event"), F.max("stop").alias("duration"))
    return quantile_bucket(stored(each, "cells"), "risk", buckets, "bucket")


def survival_curves(each: DataFrame, by: str = "bucket") -> DataFrame:
    """(by, duration, at_risk, events, survival): Kaplan and Meier's product; cells are counted by duration first."""
    counts = each.groupBy(by, "duration").agg(F.count("*").alias("_n"), F.sum("event").cast("long").alias("events"))
    order = Window.partitionBy(by).orderBy("duration")
    left = counts.withColumn("at_risk", F.sum("_n").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    share = 1 - F.col("events") / F.col("at_risk")
    # a step to zero has no logarithm
    out = left.withColumns({"_zero": F.max((share <= 0).cast("int")).over(order), "_log": F.sum(F.when(share > 0, F.log(share))).over(order)})
    return out.select(by, "duration", "at_risk", "events", F.when(F.col("_zero") == 1, 0.0).otherwise(F.exp(F.coalesce("_log", F.lit(0.0)))).alias("survival"))


def concordance(each: DataFrame) -> DataFrame:
    """pairs, c_index: of comparable pairs, the share where the one whose event came first had the higher risk (ties half).

    A cell with an event at T is compared with all that last longer, or as long without an event. No pairs are made:
    for each T all that outlast it stand in order of risk beside the events, and counts below are running sums. Risks
    are counted by (duration, event, risk) first. The distinct times of events, quarters since a cell began and so as
    few as the quarters there are, pass through the driver.
    """
    counts = each.groupBy("duration", "event", "risk").agg(F.count("*").alias("n"))
    times = F.array(*(F.lit(r["duration"]) for r in counts.where("event = 1").select("duration").distinct().collect())).cast("array<long>")
    events = counts.where("event = 1").select(F.col("duration").alias("T"), "risk", F.col("n").alias("dead"), F.lit(0).cast("long").alias("alive"))
    outlasted = F.filter(times, lambda t: (F.col("duration") > t) | ((F.col("duration") == t) & (F.col("event") == 0)))
    later = counts.select(F.explode(outlasted).alias("T"), "risk", F.lit(0).cast("long").alias("dead"), F.col("n").alias("alive"))
    both = events.union(later).groupBy("T", "risk").agg(F.sum("dead").alias("dead"), F.sum("alive").alias("alive"))
    below = F.sum("alive").over(Window.partitionBy("T").orderBy("risk")) - F.col("alive")
    total = F.sum("alive").over(Window.partitionBy("T"))
    scored = both.withColumns({"_below": below, "_total": total}).where("dead > 0")
    return scored.agg(F.sum(F.col("dead") * F.col("_total")).alias("pairs"), (F.sum(F.col("dead") * (F.col("_below") + F.col("alive") / 2.0)) / F.nullif(F.sum(F.col("dead") * F.col("_total")), F.lit(0))).alias("c_index"))


def risk_position(each: DataFrame) -> DataFrame:
    """Per cell the share, in percent, of cells with a lower risk."""
    from quillmart.operators.ranking import global_ranks

    lower = global_ranks(each, "risk", "_rank", "_total")
    ties = Window.partitionBy("risk")
    return lower.withColumn("safer_pct", (F.col("_rank") - (F.count(F.lit(1)).over(ties) + 1) / 2.0) / F.col("_total") * 100).drop("_rank", "_total")


def contributions(frame: DataFrame, model: dict, k: int = 3) -> DataFrame:
    """Per row up to ``k`` covariates that raise its hazard, as (covariate, value, amount), largest first."""
    parts = [F.struct((F.lit(float(b / s)) * (F.col(c) - float(m))).alias("amount"), F.lit(c).alias("covariate"), F.col(c).cast("double").alias("value")) for c, b, m, s in zip(model["covariates"], model["beta"], model["mean"], model["sd"], strict=True)]
    top = F.slice(F.sort_array(F.filter(F.array(*parts), lambda x: x["amount"] > 0), asc=False), 1, k)
    return frame.select(*CELL, "stop", F.explode(top).alias("c")).select(*CELL, "stop", "c.covariate", "c.value", "c.amount")
