"""Decision logs with a known truth, drawn by counters instead of a running generator.

Every draw is a hash of the seed, what the draw is for and the row's own key. So a log is the same however its rows
are dealt, a lost task draws the same again, and any part of it can be drawn alone. The action is drawn from the very
probabilities that are logged, and each action's expected reward is known, so an estimator can be held against it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmart.operators.effects import reward

#: The expected reward of each action for each problem.
EFFECTS = {
    "고객_회복": {"즉시할인": 0.08, "쿠폰발행": 0.05, "타임세일": 0.04, "세트메뉴 도입": 0.03, "사이드메뉴 추가": 0.02, "배달채널 확대": -0.02},
    "차별화": {"매장 리뉴얼": -0.02, "신메뉴 출시": 0.04, "배달채널 확대": 0.02},
    "강점_확대": {"브랜드 SNS 캠페인": 0.03, "지역 제휴 마케팅": 0.02},
    "관찰": {"웰컴 프로모션": 0.02, "리뷰 관리 캠페인": 0.01},
}
#: Noise and floor of the reward, exploration, costs as shares of sales, sales of a cell without any.
NOISE, FLOOR, EPSILON = 0.05, 0.01, 0.30
VARIABLE_COST, CAMPAIGN_COST, MARGIN_MEAN, MARGIN_STD = 0.4, 0.02, 5_000_000.0, 1_500_000.0
MEASURED_DAYS, STORES, MIN_QUARTERS = 30, 20, 6
#: Hexadecimal digits of a hash that make one draw; a double holds their number and a half.
DIGITS = 13
CONTEXT = ["x1", "x2", "x3", "x4", "x5", "x6"]


class Draws:
    """Draws for the rows of a frame, by the columns that tell its rows apart."""

    def __init__(self, seed: int, *key: Column):
        self.seed, self.key = seed, key

    def _hash(self, purpose: str) -> Column:
        return F.md5(F.concat_ws("|", F.lit(str(self.seed)), F.lit(purpose), *(k.cast("string") for k in self.key)))

    def _part(self, hashed: Column, n: int) -> Column:
        whole = F.conv(F.substring(hashed, 1 + n * DIGITS, DIGITS), 16, 10).cast("long")
        return (whole.cast("double") + 0.5) / float(16**DIGITS)

    def uniform(self, purpose: str) -> Column:
        """Between 0 and 1, both excluded."""
        return self._part(self._hash(purpose), 0)

    def normal(self, purpose: str, mean: float, std: float) -> Column:
        """From two uniform parts of one hash, by the polar transform."""
        h = self._hash(purpose)
        return F.lit(mean) + std * F.sqrt(-2 * F.ln(self._part(h, 0))) * F.cos(2 * math.pi * self._part(h, 1))

    def place(self, purpose: str, n: int | Column) -> Column:
        """A whole number from 0 to n - 1."""
        return F.floor(self.uniform(purpose) * n).cast("int")


@dataclass(frozen=True)
class World:
    """What a log is drawn from.

    A reward is the action's effect, plus ``gain`` times (x4 - 1/2), plus noise, and at least ``floor`` where there is
    one. With ``by_context`` the action the policy believes in rises with x4, so that with a gain the plain mean of an
    action's rewards is biased and only a weighted or a model-based estimate is not.
    """

    effects: dict[str, dict[str, float]] = field(default_factory=lambda: EFFECTS)
    seed: int = 0
    per_cell: int = 1
    epsilon: float = EPSILON
    noise: float = NOISE
    floor: float | None = FLOOR
    gain: float = 0.0
    by_context: bool = False

    def expected(self, problem: str, arm: str) -> float:
        """The mean reward of always taking ``arm``, over contexts and noise."""
        m = self.effects[problem][arm]
        if self.floor is None:
            return m
        if self.gain:
            raise ValueError("the mean of a floored reward with a gain has no closed form")
        z = (m - self.floor) / self.noise
        return self.floor + (m - self.floor) * 0.5 * (1 + math.erf(z / math.sqrt(2))) + self.noise * math.exp(-z * z / 2) / math.sqrt(2 * math.pi)

    def truth(self, spark) -> DataFrame:
        """problem, arm, truth: a row an action."""
        rows = [(p, a, self.expected(p, a)) for p, arms in self.effects.items() for a in arms]
        return spark.createDataFrame(rows, "problem string, arm string, truth double")


def target_cells(panel: DataFrame, min_quarters: int = MIN_QUARTERS) -> DataFrame:
    """district, industry, quarter (the last one known), treated_quarter, sales (of the treated one).

    A cell's quarter is a target from the one after ``min_quarters`` observed ones on.
    """
    w = Window.partitionBy("district", "industry").orderBy("quarter")
    rows = panel.select("district", "industry", F.col("quarter").alias("treated_quarter"), "sales", F.lag("quarter").over(w).alias("quarter"), F.row_number().over(w).alias("n"))
    return rows.where(F.col("n") > min_quarters).drop("n")


def _decided(cells: DataFrame, world: World, problem: str) -> DataFrame:
    """The decisions on one problem: ``per_cell`` drawn ones a cell, and one for each industry and action."""
    arms = list(world.effects[problem])
    drawn = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(world.per_cell - 1))).alias("draw"), F.lit(None).cast("int").alias("_forced"))
    least = cells.groupBy("industry").agg(F.min(F.struct("district", "quarter", "treated_quarter", "sales")).alias("c"))
    forced = least.select("c.district", "industry", "c.treated_quarter", "c.sales", "c.quarter", F.lit(-1).alias("draw"), F.explode(F.sequence(F.lit(0), F.lit(len(arms) - 1))).alias("_forced"))
    rows = drawn.unionByName(forced)
    return rows.select(F.lit(problem).alias("problem"), "*", F.array(*map(F.lit, arms)).alias("candidates"), F.array(*(F.lit(float(world.effects[problem][a])) for a in arms)).alias("_effects"))


def log(panel: DataFrame, world: World = World()) -> DataFrame:
    """A log of decisions about the cells of ``panel(district, industry, quarter, sales)``.

    Returns decision_id, problem, district, industry, quarter, treated_quarter, cluster (the store), x1 to x6,
    candidates, probabilities (of each candidate, as drawn from), arm, propensity, forced (a row for coverage, drawn
    evenly), the sales and costs before and after, days, reward (of those, by contribution margin) and hour (of the
    log's year). Rows grow with the panel: ``per_cell`` a target cell and problem, and one an industry and action.
    """
    cells = target_cells(panel)
    rows = None
    for problem in world.effects:
        one = _decided(cells, world, problem)
        rows = one if rows is None else rows.unionByName(one)
    d = Draws(world.seed, F.col("problem"), F.col("district"), F.col("industry"), F.col("treated_quarter"), F.col("draw"), F.coalesce("_forced", F.lit(-1)))
    rows = rows.withColumns({
        "x1": F.greatest(F.lit(-0.6), F.least(F.lit(0.6), d.normal("x1", 0.0, 0.15))), "x2": F.greatest(F.lit(-0.6), F.least(F.lit(0.6), d.normal("x2", 0.0, 0.15))),
        "x3": F.greatest(F.lit(-0.8), F.least(F.lit(0.0), d.normal("x3", -0.2, 0.15))), "x4": d.uniform("x4"), "x5": d.uniform("x5"), "x6": d.place("x6", 3) / 2.0,
    })
    k = F.size("candidates")
    believed = F.floor(F.col("x4") * k).cast("int") if world.by_context else d.place("believed", k)
    evenly = F.col("_forced").isNotNull()
    rows = rows.withColumn("_best", F.when(~evenly, believed))
    share = F.transform("candidates", lambda _, i: F.when(evenly, 1.0 / k).otherwise(world.epsilon / k + F.when(i == F.col("_best"), 1 - world.epsilon).otherwise(0.0)))
    u = d.uniform("action")
    explored = F.least(F.floor((u - (1 - world.epsilon)) / world.epsilon * k).cast("int"), k - 1) if world.epsilon else F.col("_best")
    rows = rows.withColumns({"probabilities": share, "_at": F.when(evenly, F.col("_forced")).when(u < 1 - world.epsilon, F.col("_best")).otherwise(explored)})
    wanted = F.get("_effects", F.col("_at")) + world.gain * (F.col("x4") - 0.5) + d.normal("noise", 0.0, world.noise)
    wanted = wanted if world.floor is None else F.greatest(F.lit(world.floor), wanted)
    before = F.when(F.col("sales") > 0, F.col("sales")).otherwise(F.abs(d.normal("margin", MARGIN_MEAN, MARGIN_STD)) / (1 - VARIABLE_COST))
    rows = rows.withColumns({"_wanted": wanted, "sales_before": before})
    margin = F.col("sales_before") * (1 - VARIABLE_COST)
    campaign = F.col("sales_before") * CAMPAIGN_COST
    after = (margin + F.col("_wanted") * F.greatest(margin, F.lit(1.0)) + campaign) / (1 - VARIABLE_COST)
    rows = rows.withColumns({"sales_after": after, "cost_before": F.col("sales_before") * VARIABLE_COST, "campaign_cost": campaign, "days": F.lit(MEASURED_DAYS)})
    rows = rows.withColumn("cost_after", F.col("sales_after") * VARIABLE_COST)
    paid = reward(*map(F.col, ("sales_before", "sales_after", "cost_before", "cost_after", "campaign_cost", "days", "days")))
    return rows.select(
        d._hash("id").alias("decision_id"), "problem", "district", "industry", "quarter", "treated_quarter", (F.col("district") * STORES + d.place("store", STORES)).cast("long").alias("cluster"), *CONTEXT,
        "candidates", "probabilities", F.get("candidates", F.col("_at")).alias("arm"), F.get("probabilities", F.col("_at")).alias("propensity"), evenly.alias("forced"),
        "sales_before", "sales_after", "cost_before", "cost_after", "campaign_cost", "days", paid.alias("reward"), d.place("hour", 8760).alias("hour"),
    )
