"""Verifying the effect of a change: visit aggregates, metric changes, scores and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmart.functions.classify import effect_verdict
from quillmart.functions.columns import change, clip, exact_sum, ratio

#: Weight of each part of the score, and the change that earns it in full (percent, or points).
SALES_WEIGHTS = {"target": 0.35, "visits": 0.15, "order_value": 0.10, "revisit": 0.15, "coupon": 0.10, "new_customers": 0.05, "returned": 0.10}
SALES_TARGETS = {"target": 15, "visits": 15, "order_value": 10, "revisit": 5, "coupon": 10, "new_customers": 15, "returned": 20}
REVIEW_WEIGHTS = {"rating": 0.10, "negative_rate": 0.20, "aspect_negative_rate": 0.30, "aspect_reviews": 0.10, "revisit": 0.15, "sales": 0.10, "reviews": 0.05}
REVIEW_TARGETS = {"rating": 0.5, "negative_rate": 30, "aspect_negative_rate": 30, "aspect_reviews": 20, "revisit": 5, "sales": 10, "reviews": 20}


def in_hours(hour: Column, start: int, end: int) -> Column:
    """Whether an hour lies in [start, end]; a stretch may pass midnight."""
    return hour.between(start, end) if start <= end else (hour >= start) | (hour <= end)


def hourly(lines: DataFrame) -> DataFrame:
    return lines.groupBy("hour").agg(exact_sum("bill").alias("sales"))


def aggregates(lines: DataFrame, by: list[str], start_hour: int | None = None, end_hour: int | None = None) -> DataFrame:
    """Per group: total and target-hour sales, visits, order value, revisit and coupon rates in percent, customers, days of the span.

    A customer revisits with two or more distinct transactions. Null customers are no customers; without hours the
    target is everything. Customers are pre-aggregated, so one customer's visits never meet in memory.
    """
    target = F.lit(True) if start_hour is None or end_hour is None else in_hours(F.col("hour"), start_hour, end_hour)
    sums = lines.groupBy(*by).agg(
        exact_sum("bill").alias("total_sales"), F.coalesce(exact_sum(F.when(target, F.col("bill"))), F.lit(0.0)).alias("target_sales"), F.count_distinct("transaction").alias("visits"),
        (F.avg(F.coalesce(F.col("coupon"), F.lit(False)).cast("int")) * 100).alias("coupon_rate"), (F.datediff(F.max("day"), F.min("day")) + 1).alias("days"),
    )
    each = lines.where(F.col("customer").isNotNull()).groupBy(*by, "customer").agg(F.count_distinct("transaction").alias("_n"))
    again = each.groupBy(*by).agg((F.avg((F.col("_n") >= 2).cast("int")) * 100).alias("revisit_rate"), F.count("*").alias("customers"))
    out = sums.join(again, by, "left") if by else sums.join(again)  # one row each
    return out.select(*by, "total_sales", "target_sales", "visits", ratio(F.col("total_sales"), F.col("visits")).alias("order_value"), F.coalesce("revisit_rate", F.lit(0.0)).alias("revisit_rate"), "coupon_rate", F.coalesce("customers", F.lit(0)).alias("customers"), "days")


def new_customers(after: DataFrame, before: DataFrame) -> DataFrame:
    fresh = after.where(F.col("customer").isNotNull()).select("customer").distinct().join(before.select("customer").distinct(), "customer", "left_anti")
    return fresh.agg(F.count("*").alias("new_customers"))


def metric_changes(rows: DataFrame, stretch: str, metrics: dict[str, bool], by: list[str] | None = None) -> DataFrame:
    """metric, before, after, change, change_pct, improved for ``rows(stretch in before/after, metrics)``; the flag says whether more is better. A missing side gives nulls."""
    by = by or []
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v"), F.lit(up).alias("up")) for m, up in metrics.items()))).alias("e")
    sides = rows.select(*by, stretch, each).select(*by, stretch, "e.*").groupBy(*by, "metric", "up").agg(F.max(F.when(F.col(stretch) == "before", F.col("v"))).alias("before"), F.max(F.when(F.col(stretch) == "after", F.col("v"))).alias("after"))
    a, b = F.col("before"), F.col("after")
    return sides.select(*by, "metric", "before", "after", (b - a).alias("change"), (change(a, b) * 100).alias("change_pct"), F.when(F.col("up"), b > a).otherwise(b < a).alias("improved"))


def _sides(rows: DataFrame, stretch: str, by: list[str], columns: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(*(F.max(F.when(F.col(stretch) == s, F.col(c).cast("double"))).alias(f"{c}_{s}") for c in columns for s in ("before", "after")))


def _full(x: Column, target: float) -> Column:
    """Points from 0 to 100: nothing for no or a missing change, everything from the target on."""
    return clip(F.coalesce(x, F.lit(0.0)) / target * 100, 0.0, 100.0)


def sales_score(rows: DataFrame, stretch: str, by: list[str] | None = None) -> DataFrame:
    """adjusted, score, verdict from aggregates of a stretch before and one after; ``adjusted`` is the target's change beyond the total's."""
    by = by or []
    s = _sides(rows, stretch, by, ["target_sales", "total_sales", "visits", "order_value", "revisit_rate", "coupon_rate", "new_customers", "returned"])
    pct = lambda c: change(F.col(f"{c}_before"), F.col(f"{c}_after")) * 100
    diff = lambda c: F.col(f"{c}_after") - F.col(f"{c}_before")
    adjusted = F.coalesce(pct("target_sales") - F.coalesce(pct("total_sales"), F.lit(0.0)), F.lit(0.0))
    parts = {"target": adjusted, "visits": pct("visits"), "order_value": pct("order_value"), "revisit": diff("revisit_rate"), "coupon": diff("coupon_rate"), "new_customers": pct("new_customers"), "returned": pct("returned")}
    score = sum((_full(x, SALES_TARGETS[k]) * SALES_WEIGHTS[k] for k, x in parts.items()), F.lit(0.0))
    return s.select(*by, adjusted.alias("adjusted"), score.alias("score")).withColumn("verdict", effect_verdict(F.col("score")))


def review_score(rows: DataFrame, stretch: str, by: list[str] | None = None) -> DataFrame:
    """score, verdict of review measures; where ``revisit_rate`` or ``sales`` is missing on a side, the other weights make up the whole."""
    by = by or []
    s = _sides(rows, stretch, by, ["rating", "negative_rate", "aspect_negative_rate", "aspect_reviews", "revisit_rate", "sales", "reviews"])
    pct = lambda c: change(F.col(f"{c}_before"), F.col(f"{c}_after")) * 100
    diff = lambda c: F.col(f"{c}_after") - F.col(f"{c}_before")
    parts = {"rating": diff("rating"), "negative_rate": -pct("negative_rate"), "aspect_negative_rate": -pct("aspect_negative_rate"), "aspect_reviews": -pct("aspect_reviews"), "revisit": diff("revisit_rate"), "sales": pct("sales"), "reviews": pct("reviews")}
    there = {"revisit": diff("revisit_rate").isNotNull(), "sales": diff("sales").isNotNull()}
    weight = {k: F.when(there[k], w).otherwise(0.0) if k in there else F.lit(w) for k, w in REVIEW_WEIGHTS.items()}
    points = sum((_full(x, REVIEW_TARGETS[k]) * weight[k] for k, x in parts.items()), F.lit(0.0))
    return s.select(*by, (points / sum(weight.values(), F.lit(0.0))).alias("score")).withColumn("verdict", effect_verdict(F.col("score")))


def keyword_trend(now: DataFrame, before: DataFrame) -> DataFrame:
    """keyword, n, before, is_new, change_pct for ``(keyword, n)`` of two stretches."""
    both = now.join(before.withColumnRenamed("n", "before"), "keyword", "left").withColumn("before", F.coalesce("before", F.lit(0)))
    return both.select("keyword", "n", "before", (F.col("before") == 0).alias("is_new"), (ratio(F.col("n") - F.col("before"), F.col("before")) * 100).alias("change_pct"))


def reward(before: Column, after: Column, cost_before: Column, cost_after: Column, campaign: Column, days_before: Column, days_after: Column, floor: float = 1.0) -> Column:
    """Relative change of contribution, the base at least ``floor``; null unless ``reward_status`` is complete."""
    base, now = before - cost_before, after - cost_after - campaign
    whole = reward_status(before, after, cost_before, cost_after, campaign, days_before, days_after) == "complete"
    return F.when(whole, (now - base) / F.greatest(F.abs(base), F.lit(floor)))


def reward_status(before: Column, after: Column, cost_before: Column, cost_after: Column, campaign: Column, days_before: Column, days_after: Column) -> Column:
    """complete; missing where an input is null; invalid for negative costs or stretches without days; unequal stretches."""
    missing = F.lit(False)
    for c in (before, after, cost_before, cost_after, campaign, days_before, days_after):
        missing = missing | c.isNull()
    invalid = (F.least(cost_before, cost_after, campaign) < 0) | (F.least(days_before, days_after) <= 0)
    return F.when(missing, "missing").when(invalid, "invalid").when(days_before != days_after, "unequal").otherwise("complete")


def aspects(logits: DataFrame, labels: list[str], none: str = "none") -> DataFrame:
    """review, aspect, label, confidence in percent of ``logits(review, aspect, scores)``: the label of the largest softmax; ``none`` is dropped."""
    top = F.array_max("scores")
    total = F.aggregate("scores", F.lit(0.0), lambda s, x: s + F.exp(x - F.array_max("scores")))
    at = F.array_position("scores", top)
    return logits.select("review", "aspect", F.element_at(F.array(*map(F.lit, labels)), at.cast("int")).alias("label"), (100 / total).alias("confidence")).where(F.col("label") != none)


def refined(found: DataFrame, overrides: DataFrame, threshold: float = 65.0) -> DataFrame:
    """``found(review, aspect, label, confidence)`` with labels below ``threshold`` replaced where an override has one; ``source`` says which."""
    o = overrides.select("review", "aspect", F.col("label").alias("_label"), F.col("confidence").alias("_confidence"))
    use = (F.col("confidence") < threshold) & F.col("_label").isNotNull()
    both = found.join(o, ["review", "aspect"], "left")
    return both.select("review", "aspect", F.when(use, F.col("_label")).otherwise(F.col("label")).alias("label"), F.when(use, F.col("_confidence")).otherwise(F.col("confidence")).alias("confidence"), F.when(use, "override").otherwise("model").alias("source"))
