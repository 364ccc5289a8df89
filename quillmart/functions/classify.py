"""Rules that turn measures into verdicts: ordered conditions, the first that holds decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The thresholds of the rules below.
MARKET_STEP = 0.10
RESIDENT_STEP, RESIDENT_FRESH, VISITOR_STEP, WORKER_STEP = 0.05, 1e-6, 0.12, 0.15
REGION_STEP, REGION_PEERS = 0.10, 3
TREND_STEP = -0.01


def _any_null(*columns: Column) -> Column:
    out = columns[0].isNull()
    for c in columns[1:]:
        out = out | c.isNull()
    return out


def market_state(sales: Column, stores: Column, per_store: Column) -> Column:
    """What the long-run changes of sales, store count and sales a store say together."""
    s = MARKET_STEP
    return (
        F.when(_any_null(sales, stores, per_store), "unknown")
        .when((sales <= -s) & (stores <= -s) & (per_store <= -s), "compound_slump")
        .when((sales <= -s) & (stores <= -s), "shrinking")
        .when((per_store <= -s) & (stores >= s), "overcrowded")
        .when((per_store <= -s) & (F.abs(stores) < s), "demand_loss")
        .when((sales > -s) & (per_store > -s), "normal")
        .otherwise("watch")
    )


def traffic_source(residents: Column, visitors: Column, workers: Column) -> Column:
    """Who left: residents, visitors or workers. Resident counts that didn't move at all are stale and confirm nothing."""
    fresh = F.abs(residents) > RESIDENT_FRESH
    home_down, home_stable = fresh & (residents <= -RESIDENT_STEP), fresh & (F.abs(residents) < RESIDENT_STEP)
    out_down, out_stable = visitors <= -VISITOR_STEP, F.abs(visitors) < VISITOR_STEP
    work_down, work_stable = workers <= -WORKER_STEP, F.abs(workers) < WORKER_STEP
    with_workers = (
        F.when(home_down & out_down & work_down, "all_round_shrinkage")
        .when(home_stable & out_down & work_down, "workers_leave_inflow_falls")
        .when(out_stable & work_down, "workers_fall_early_sign")
        .when(home_down & out_stable & work_stable, "residents_leave")
        .when(home_stable & work_stable & out_down, "inflow_falls")
        .when(home_down & out_down & work_stable, "district_shrinks")
        .otherwise("unknown")
    )
    without = F.when(home_down & out_down, "district_shrinks").when(home_stable & out_down, "inflow_falls").when(out_stable & home_down, "residents_leave").otherwise("unknown")
    return F.when(_any_null(residents, visitors), "unknown").when(workers.isNotNull(), with_workers).otherwise(without)


def regional_pattern(own: Column, around: Column, n_around: Column) -> Column:
    """Whether a district moves with its neighbours."""
    down, around_down = own <= -REGION_STEP, around <= -REGION_STEP
    return (
        F.when(_any_null(own, around, n_around) | (n_around < REGION_PEERS), "unknown")
        .when(down & around_down, "falls_together")
        .when(down, "falls_alone")
        .when(around_down, "holds_against_trend")
        .when((own > 0) & (around > 0), "rises_together")
        .otherwise("unknown")
    )


def decline_cause(own: Column, district: Column, industry: Column) -> Column:
    """What a falling trend falls along with; ``own`` against the mean of the two others decides the rest."""
    t = TREND_STEP
    return (
        F.when(_any_null(own, district, industry), "unknown")
        .when(own >= t, "not_falling")
        .when((district < t) & (industry < t), "with_district_and_industry")
        .when(district < t, "with_district")
        .when(industry < t, "with_industry")
        .when(own - (district + industry) / 2 < t, "below_benchmark")
        .otherwise("no_companion")
    )


def severity(qoq: Column, yoy: Column, from_peak: Column, decline_share: Column) -> Column:
    """Points from 0 to 7."""

    def points(x: Column, two: float, one: float) -> Column:
        return F.when(x <= two, 2).when(x <= one, 1).otherwise(0)

    return points(qoq, -0.2, -0.1) + points(yoy, -0.2, -0.1) + points(from_peak, -0.3, -0.15) + F.when(decline_share >= 0.7, 1).otherwise(0)


def urgency(points: Column) -> Column:
    return F.when(points >= 5, "high").when(points >= 2, "medium").otherwise("low")


def grade(state: Column, points: Column) -> Column:
    """The kind of response that a market state and its severity call for."""
    return (
        F.when(state.isin("shrinking", "compound_slump"), "restructure")
        .when(state == "overcrowded", "differentiate")
        .when(state == "demand_loss", "win_back")
        .when((state == "normal") & (points < 2), "extend_strengths")
        .otherwise("observe")
    )


def trend_signal(change_pct: Column) -> Column:
    return F.when(change_pct.isNull(), "unknown").when(change_pct >= 30, "surge").when(change_pct >= 10, "rise").when(change_pct <= -10, "fall").otherwise("flat")


def growth_points(rate: Column, p90: Column, p70: Column, mean: Column) -> Column:
    return F.when(rate.isNull(), 0.0).when(rate >= p90, 100.0).when(rate >= p70, 80.0).when(rate < 0, 20.0).when(rate >= mean, 60.0).otherwise(40.0)


def effect_confidence(adjusted_p: Column, join_rate: Column, gain_pct: Column) -> Column:
    return (
        F.when((join_rate < 0.8) | (adjusted_p > 0.1) | (gain_pct <= 0), "low")
        .when((adjusted_p <= 0.01) & (join_rate >= 0.95), "high")
        .when(adjusted_p <= 0.05, "medium")
        .otherwise("low")
    )


def effect_verdict(score: Column) -> Column:
    return F.when(score >= 70, "effective").when(score >= 40, "partly_effective").otherwise("not_effective")


def band(percentile: Column) -> Column:
    """Low, normal or high place among peers, from 0 to 100."""
    return F.when(percentile <= 25, "low").when(percentile >= 75, "high").when(percentile.isNotNull(), "normal")


def outlier(z: Column) -> Column:
    return F.when(z >= 2.5, "very_high").when(z <= -2.5, "very_low").when(z.isNotNull(), "ordinary")


def weather_factor(temperature: Column, rain: Column, humidity: Column) -> Column:
    """Demand factor; a missing measure changes nothing."""
    warm = F.when(temperature >= 30, 0.10).when(temperature >= 25, 0.05).when(temperature <= 5, 0.08).otherwise(0.0)
    wet = F.when(rain >= 80, -0.08).when(rain >= 60, -0.05).otherwise(0.0)
    return 1.0 + warm + wet + F.when(humidity >= 80, 0.03).otherwise(0.0)
