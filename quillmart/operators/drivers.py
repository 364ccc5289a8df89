"""What moved sales between two periods: daily totals, contributions, decompositions, breakdowns, root causes."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmart.functions.columns import exact_sum, ratio
from quillmart.operators.checks import InputError
from quillmart.operators.ranking import first_of

UNKNOWN = "unknown"


@dataclass(frozen=True)
class Periods:
    base_start: dt.date
    base_end: dt.date
    start: dt.date
    end: dt.date

    def __post_init__(self) -> None:
        """Neither period ends before it starts."""
        for first, last in ((self.base_start, self.base_end), (self.start, self.end)):
            if last < first:
                raise InputError(f"a period ends on {last}, before it starts on {first}")

    def base(self, day: str = "day") -> Column:
        return F.col(day).between(F.lit(self.base_start), F.lit(self.base_end))

    def current(self, day: str = "day") -> Column:
        return F.col(day).between(F.lit(self.start), F.lit(self.end))

    def within(self, df: DataFrame, day: str = "day") -> DataFrame:
        """The rows of either period; as literals the dates reach the scan."""
        return df.where(self.base(day) | self.current(day))


def infer_periods(lines: DataFrame, day: str = "day", *, start: dt.date | None = None, end: dt.date | None = None, base_start: dt.date | None = None, base_end: dt.date | None = None) -> Periods:
    """The month of the last day, and as many days up to the day before it. One date reaches the driver."""
    last = lines.agg(F.max(day).alias("d")).first()["d"]
    if last is None:
        raise InputError("no days")
    start, end = start or last.replace(day=1), end or last
    base_end = base_end or start - dt.timedelta(days=1)
    return Periods(base_start or base_end - (end - start), base_end, start, end)


def daily(lines: DataFrame, by: list[str]) -> DataFrame:
    """Per day and ``by``: revenue, qty, transactions, average order value, unit price and calendar columns."""
    out = lines.groupBy("day", *by).agg(exact_sum("bill").alias("revenue"), F.sum("qty").alias("qty"), F.count_distinct("transaction").alias("transactions"))
    return out.withColumns({
        "order_value": ratio(F.col("revenue"), F.col("transactions")),
        "unit_price": ratio(F.col("revenue"), F.col("qty")),
        "weekday": F.weekday("day"),
        "month": F.month("day"),
    })


def with_day_index(df: DataFrame, day: str = "day") -> DataFrame:
    """``df`` with the days since its first one."""
    first = df.agg(F.min(day).alias("d")).first()["d"]
    return df.withColumn("day_index", F.datediff(F.col(day), F.lit(first)))


def calendar(start: Column, end: Column) -> list[Column]:
    day = F.explode(F.sequence(start, end))
    return [day.alias("day")]


def calendar_flags(days: DataFrame) -> DataFrame:
    """weekend, month_start and month_end of each day."""
    d = F.col("day")
    return days.withColumns({"weekend": F.weekday(d) >= 5, "month_start": F.dayofmonth(d) == 1, "month_end": d == F.last_day(d)})


def daypart(hour: Column) -> Column:
    """Bins (-1, 6], (6, 10], (10, 14], (14, 18], (18, 22], (22, 24]."""
    out = F.when(hour <= 6, "dawn")
    for top, name in ((10, "morning"), (14, "lunch"), (18, "afternoon"), (22, "evening"), (24, "night")):
        out = out.when(hour <= top, name)
    return out


def _each_dimension(lines: DataFrame, dims: list[str], keep: list[str]) -> DataFrame:
    pairs = F.array(*(F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit(UNKNOWN)).alias("value")) for d in dims))
    return lines.select(*keep, F.explode(pairs).alias("_d")).select(*keep, "_d.dimension", "_d.value")


def _with_whole(sums: DataFrame, **wholes: Column) -> DataFrame:
    """``sums`` with figures of its dimension: a row a dimension, summed before the shuffle and broadcast back."""
    return sums.join(F.broadcast(sums.groupBy("dimension").agg(*(x.alias(c) for c, x in wholes.items()))), "dimension")


def _whole(amount: Column) -> Column:
    return F.sum(amount.cast("decimal(18,4)")).cast("double")


def contributions(lines: DataFrame, periods: Periods, dims: list[str]) -> DataFrame:
    """dimension, value, before, after, amount, share_pct of the whole change, direction; all dimensions in one pass."""
    rows = _each_dimension(periods.within(lines), dims, ["day", "bill"])
    sums = rows.groupBy("dimension", "value").agg(
        F.coalesce(exact_sum(F.when(periods.base(), F.col("bill"))), F.lit(0.0)).alias("before"), F.coalesce(exact_sum(F.when(periods.current(), F.col("bill"))), F.lit(0.0)).alias("after")
    )
    amount, whole = F.col("amount"), F.col("_whole")
    out = _with_whole(sums.withColumn("amount", F.col("after") - F.col("before")), _whole=_whole(amount))
    return out.select("dimension", "value", "before", "after", "amount", F.when(F.abs(whole) > 1e-8, amount / whole * 100).alias("share_pct"), F.when(amount > 0, "positive").when(amount < 0, "negative").otherwise("neutral").alias("direction"))


def price_and_quantity(lines: DataFrame, periods: Periods) -> DataFrame:
    """product, quantity_effect, price_effect, entry_effect: mid-point effects for products sold in both periods, else the whole revenue gained or lost."""
    rows = periods.within(lines)
    side = lambda when, n: (F.sum(F.when(when, F.col("qty"))).alias(f"q{n}"), exact_sum(F.when(when, F.col("bill"))).alias(f"r{n}"))
    t = rows.groupBy("product").agg(*side(periods.base(), 0), *side(periods.current(), 1))
    q0, q1, r0, r1 = (F.col(c) for c in ("q0", "q1", "r0", "r1"))
    p0, p1 = ratio(r0, q0), ratio(r1, q1)
    both = r0.isNotNull() & r1.isNotNull()
    return t.select(
        "product",
        F.when(both, (q1 - q0) * (p0 + p1) / 2).otherwise(0.0).alias("quantity_effect"),
        F.when(both, (p1 - p0) * (q0 + q1) / 2).otherwise(0.0).alias("price_effect"),
        F.when(both, 0.0).when(r0.isNull(), r1).otherwise(-r0).alias("entry_effect"),
    )


def summary(lines: DataFrame, periods: Periods) -> DataFrame:
    """One row: revenue, transactions and order value of both periods, and the mid-point effects of count and order value."""
    rows = periods.within(lines)
    base, cur = periods.base(), periods.current()
    t = rows.agg(
        exact_sum(F.when(base, F.col("bill"))).alias("base_revenue"), exact_sum(F.when(cur, F.col("bill"))).alias("revenue"),
        F.count_distinct(F.when(base, F.col("transaction"))).alias("base_transactions"), F.count_distinct(F.when(cur, F.col("transaction"))).alias("transactions"),
    )
    n0, n1 = F.col("base_transactions"), F.col("transactions")
    v0, v1 = ratio(F.col("base_revenue"), n0), ratio(F.col("revenue"), n1)
    return t.withColumns({
        "revenue_change": F.col("revenue") - F.col("base_revenue"),
        "base_order_value": v0, "order_value": v1,
        "count_effect": (n1 - n0) * (v0 + v1) / 2,
        "value_effect": (v1 - v0) * (n0 + n1) / 2,
    })


def main_formula_driver(one: DataFrame) -> DataFrame:
    """driver, amount: of count and order value the larger effect with the sign of the change, else the larger one."""
    each = one.select("revenue_change", F.explode(F.array(F.struct(F.lit("transaction_count").alias("driver"), F.col("count_effect").alias("amount")), F.struct(F.lit("order_value").alias("driver"), F.col("value_effect").alias("amount")))).alias("e"))
    each = each.select("revenue_change", "e.*")
    aligned = (F.col("amount") > 0) == (F.col("revenue_change") > 0)
    return each.orderBy(aligned.desc(), F.abs("amount").desc(), "driver").limit(1).select("driver", "amount")


def top_category(lines: DataFrame, periods: Periods) -> DataFrame:
    """The category with the most revenue of the current period."""
    sums = lines.where(periods.current()).groupBy("category").agg(exact_sum("bill").alias("revenue"))
    return sums.orderBy(F.col("revenue").desc(), "category").limit(1)


def breakdown(lines: DataFrame, dims: list[str], k: int = 20) -> DataFrame:
    """Per dimension its ``k`` values with the most revenue: revenue, share_pct of the dimension, qty, transactions, order_value."""
    # lines meet by transaction once, before they are multiplied: a transaction's values are then told apart without a shuffle
    rows = _each_dimension(lines.select(*dims, "bill", "qty", "transaction").repartition("transaction"), dims, ["bill", "qty", "transaction"])
    each = rows.groupBy("dimension", "value", "transaction").agg(F.sum(F.col("bill").cast("decimal(18,4)")).alias("_r"), F.sum("qty").alias("_q"))
    sums = each.groupBy("dimension", "value").agg(F.sum("_r").cast("double").alias("revenue"), F.sum("_q").alias("qty"), F.count("transaction").alias("transactions"))
    out = _with_whole(sums, _whole=_whole(F.col("revenue"))).withColumns({"share_pct": ratio(F.col("revenue"), F.col("_whole")) * 100, "order_value": ratio(F.col("revenue"), F.col("transactions"))})
    return first_of(out.drop("_whole"), ["dimension"], [F.col("revenue").desc(), F.col("value")], k)


def breakdown_sets(lines: DataFrame, dims: list[str]) -> DataFrame:
    """Revenue by each dimension alone and overall, as one grouping-sets aggregate: ``level`` names the set."""
    rows = lines.select(*dims, "bill")
    grouped = rows.groupingSets([[F.col(d)] for d in dims] + [[]], *map(F.col, dims)).agg(exact_sum("bill").alias("revenue"), F.count("*").alias("lines"), F.grouping_id().alias("_g"))
    n = len(dims)
    level = F.coalesce(*(F.when(F.col("_g") == (2**n - 1 - 2 ** (n - 1 - i)), F.lit(d)) for i, d in enumerate(dims)), F.lit("all"))
    return grouped.select(level.alias("level"), F.coalesce(*(F.col(d).cast("string") for d in dims), F.lit("all")).alias("value"), "revenue", "lines")


def price_levels(lines: DataFrame) -> DataFrame:
    """Mean and median unit price and mean quantity a line."""
    from quillmart.operators.ranking import quantiles

    mid = quantiles(lines, "unit_price", [0.5])[0]
    return lines.agg(F.avg("unit_price").alias("mean_price"), F.avg("qty").alias("mean_qty")).withColumn("median_price", F.lit(mid).cast("double"))


def traffic_ratios(days: DataFrame, traffic: str) -> DataFrame:
    """Mean daily revenue and transactions against mean traffic, over days that have it; nothing where it isn't positive."""
    t = days.where(F.col(traffic).isNotNull()).agg(F.avg(traffic).alias("traffic"), F.avg("revenue").alias("daily_revenue"), F.avg("transactions").alias("daily_transactions"))
    return t.where("traffic > 0").withColumns({"revenue_per_traffic": F.col("daily_revenue") / F.col("traffic"), "transactions_per_traffic_pct": F.col("daily_transactions") / F.col("traffic") * 100})


def exposed_against_not(days: DataFrame, exposure: str) -> DataFrame:
    """Mean revenue of exposed and other days and how they compare, in percent; a reference figure, not an effect."""
    x = F.col(exposure)
    t = days.where(x.isNotNull()).agg(
        F.avg(F.when(x > 0, F.col("revenue"))).alias("exposed"), F.avg(F.when(x <= 0, F.col("revenue"))).alias("unexposed"),
        F.count(F.when(x > 0, 1)).alias("exposed_days"), F.count(F.when(x <= 0, 1)).alias("unexposed_days"),
    )
    return t.withColumn("difference_pct", (ratio(F.col("exposed"), F.col("unexposed")) - 1) * 100)


def top_drivers(contributed: DataFrame, k: int = 6, material: float = 0.05, least_share: float = 10.0) -> DataFrame:
    """The largest contributions that go with the change: at least ``material`` of it and ``least_share`` percent of what goes with it in their dimension."""
    amount, size = F.col("amount"), F.abs("amount")
    rows = _with_whole(contributed, _whole=_whole(amount), _up=_whole(F.when(amount > 0, size)), _down=_whole(F.when(amount <= 0, size)), _values=F.count(F.lit(1)))
    aligned = rows.where(((F.col("dimension") != "store") | (F.col("_values") > 1)) & ((amount > 0) == (F.col("_whole") > 0)))
    share = size / F.when(F.col("_whole") > 0, F.col("_up")).otherwise(F.col("_down")) * 100
    kept = aligned.withColumn("dimension_share", share).where((size >= F.abs("_whole") * material) & (F.col("dimension_share") >= least_share))
    return kept.orderBy(F.abs("amount").desc(), "dimension", "value").limit(k).select("dimension", "value", "amount", "dimension_share")


def distinct_factors(drivers: DataFrame, family: Column) -> DataFrame:
    """Drivers ranked by confidence, validation gain and size; of each family that isn't null only the first."""
    rank = [(F.col("confidence") == "high").desc(), F.coalesce("gain_pct", F.lit(0.0)).desc(), F.abs("amount").desc(), F.col("factor")]
    keyed = drivers.withColumn("_family", F.coalesce(family, F.concat(F.lit("own:"), "factor")))
    return first_of(keyed, ["_family"], rank).drop("_family")
