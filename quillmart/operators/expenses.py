"""A store's books: expense anomalies, budgets, purchase prices, cost rates, trends, duplicates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmart.functions.columns import exact_sum, ratio
from quillmart.operators.ranking import first_of

#: Base units in a purchase unit.
UNITS = {"kg": 1000.0, "L": 1000.0, "병": 750.0}


def weekly_outliers(receipts: DataFrame, threshold: float = 1.3) -> DataFrame:
    """(category, week, amount, mean, z, direction): weeks whose total strays from the category's weekly mean; weeks start on Monday."""
    weekly = receipts.groupBy("category", F.date_trunc("week", "day").cast("date").alias("week")).agg(exact_sum("total").alias("amount"))
    w = Window.partitionBy("category")
    z = ratio(F.col("amount") - F.col("mean"), F.col("_sd"))
    out = weekly.withColumns({"mean": F.avg("amount").over(w), "_sd": F.stddev_pop("amount").over(w)}).withColumn("z", z).where(F.abs("z") >= threshold)
    return out.select("category", "week", "amount", "mean", "z", F.when(F.col("z") > 0, "surge").otherwise("drop").alias("direction"))


def month(day: str = "day") -> Column:
    return F.date_format(day, "yyyy-MM")


def over_budget(receipts: DataFrame, budget: DataFrame) -> DataFrame:
    """(month, category, actual, budget, over, over_pct): spending beyond ``budget(month, category, budget)``; a missing budget is 0 and has no percentage."""
    actual = receipts.groupBy(month().alias("month"), "category").agg(exact_sum("total").alias("actual"))
    both = actual.join(budget.select("month", "category", "budget"), ["month", "category"], "left").withColumn("budget", F.coalesce("budget", F.lit(0.0)))
    over = F.col("actual") - F.col("budget")
    return both.withColumns({"over": over, "over_pct": F.when(F.col("budget") > 0, over / F.nullif(F.col("budget"), F.lit(0.0)) * 100)}).where("over > 0")


def purchases(items: DataFrame, receipts: DataFrame, end: dt.date | None = None) -> DataFrame:
    """Items with their receipt's day, up to ``end``."""
    rows = items.join(receipts.select("receipt", "day"), "receipt")
    return rows if end is None else rows.where(F.col("day") <= F.lit(end))


def price_changes(bought: DataFrame, weeks: int = 4, least_pct: float = 10.0) -> DataFrame:
    """(item, before, recent, change_pct): mean unit price of the last ``weeks`` against as many before; items without a unit are services."""
    goods = bought.where(F.col("unit").isNotNull())
    last = goods.agg(F.max("day").alias("d")).first()["d"]
    if last is None:
        return goods.select("item", F.lit(0.0).alias("before"), F.lit(0.0).alias("recent"), F.lit(0.0).alias("change_pct"))
    mid, start = last - dt.timedelta(weeks=weeks), last - dt.timedelta(weeks=2 * weeks)
    sums = goods.where(F.col("day") > F.lit(start)).groupBy("item").agg(F.avg(F.when(F.col("day") <= F.lit(mid), F.col("unit_price"))).alias("before"), F.avg(F.when(F.col("day") > F.lit(mid), F.col("unit_price"))).alias("recent"))
    return sums.withColumn("change_pct", ratio(F.col("recent") - F.col("before"), F.col("before")) * 100).where(F.abs("change_pct") >= least_pct)


def latest_prices(bought: DataFrame) -> DataFrame:
    """(item, unit_price, unit): the last purchase of each item, of one day the last line."""
    return bought.groupBy("item").agg(F.max_by(F.struct("unit_price", "unit"), F.struct("day", "receipt", "line", "unit_price")).alias("_m")).select("item", "_m.unit_price", "_m.unit")


def cost_rates(products: DataFrame, recipes: DataFrame, prices: DataFrame) -> DataFrame:
    """(product, price, cost, cost_rate_pct, missing) of ``products(product, price)`` by ``recipes(product, item, amount)``.

    Without a recipe, or where an item has no price or an unknown unit, the cost is null; ``missing`` names the first
    such item.
    """
    unit = F.coalesce(*(F.when(F.col("unit") == u, F.lit(n)) for u, n in UNITS.items()))
    per = prices.select("item", (F.col("unit_price") / unit).alias("_per"))
    parts = recipes.join(per, "item", "left").groupBy("product").agg(F.sum(F.col("_per") * F.col("amount")).alias("_cost"), F.min(F.when(F.col("_per").isNull(), F.col("item"))).alias("missing"), F.lit(True).alias("_known"))
    both = products.join(parts, "product", "left")
    cost = F.when(F.col("_known") & F.col("missing").isNull(), F.col("_cost"))
    return both.select("product", "price", cost.alias("cost"), (ratio(cost, F.col("price")) * 100).alias("cost_rate_pct"), F.when(F.col("_known").isNull(), "recipe").otherwise(F.col("missing")).alias("missing"))


def price_index(bought: DataFrame) -> DataFrame:
    """(item, month, price, index): monthly mean unit price, the first observed month 100."""
    monthly = bought.where(F.col("unit").isNotNull()).groupBy("item", month().alias("month")).agg(F.avg("unit_price").alias("price"))
    first = F.first("price").over(Window.partitionBy("item").orderBy("month"))
    return monthly.withColumn("index", ratio(F.col("price"), first) * 100)


def monthly_trend(revenue: DataFrame, spending: DataFrame, step: str = "month") -> DataFrame:
    """(period, revenue, spending) per month or quarter of ``(day, total)`` tables: 0 where one side has none within its own span, absent where neither reaches."""
    months = 3 if step == "quarter" else 1

    def sums(df: DataFrame, name: str) -> DataFrame:
        got = df.where(F.col("day").isNotNull()).groupBy(F.trunc("day", step).alias("period")).agg(exact_sum("total").alias(name))
        spine = got.agg(F.min("period").alias("a"), F.max("period").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b", F.expr(f"interval {months} month"))).alias("period"))
        return spine.join(got, "period", "left").select("period", F.coalesce(name, F.lit(0.0)).alias(name))

    both = sums(revenue, "revenue").join(sums(spending, "spending"), "period", "full")
    return both.select("period", F.coalesce("revenue", F.lit(0.0)).alias("revenue"), F.coalesce("spending", F.lit(0.0)).alias("spending"))


def report_period(df: DataFrame, kind: str, day: dt.date) -> tuple[dt.date, dt.date] | None:
    """First and last day of a monthly, yearly or full report, held to the data's range; None without data."""
    row = df.agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
    if row["a"] is None:
        return None
    if kind == "full":
        return row["a"], row["b"]
    start = day.replace(day=1) if kind == "monthly" else day.replace(month=1, day=1)
    following = (start.replace(day=28) + dt.timedelta(days=4)).replace(day=1) if kind == "monthly" else start.replace(year=start.year + 1)
    return max(start, row["a"]), min(following - dt.timedelta(days=1), row["b"])


def known_duplicates(new: DataFrame, known: DataFrame) -> DataFrame:
    """New receipts that are known already: same vendor without spaces, day and total; nulls are equal to nulls."""
    vendor = F.replace(F.coalesce("vendor", F.lit("")), F.lit(" "), F.lit(""))
    key = lambda df: df.withColumn("_k", F.xxhash64(vendor, F.coalesce(F.col("day").cast("string"), F.lit("")), F.coalesce(F.col("total"), F.lit(0.0))))
    sides = key(known).select("_k", vendor.alias("_v"), F.col("day").alias("_d"), F.coalesce("total", F.lit(0.0)).alias("_t"))
    same = (F.col("_kk") == F.col("_k")) & (vendor == F.col("_v")) & F.col("day").eqNullSafe(F.col("_d")) & (F.coalesce("total", F.lit(0.0)) == F.col("_t"))
    return key(new).withColumnRenamed("_k", "_kk").join(sides, same, "left_semi").drop("_kk")


# trends of counts


def trend_signals(rows: DataFrame, least: int = 14, most_zero: float = 0.4) -> DataFrame:
    """(item, recent, before, change_pct, signal): mean of the last 7 days against the 14 before them.

    Items with fewer than ``least`` rows or at least ``most_zero`` zero days are left out.
    """
    from quillmart.functions.classify import trend_signal

    r = F.row_number().over(Window.partitionBy("item").orderBy(F.col("day").desc()))
    sums = rows.withColumn("_r", r).groupBy("item").agg(
        F.count("*").alias("_n"), F.avg((F.col("value") == 0).cast("double")).alias("_zero"),
        F.avg(F.when(F.col("_r") <= 7, F.col("value"))).alias("recent"), F.avg(F.when(F.col("_r").between(8, 21), F.col("value"))).alias("before"),
    )
    kept = sums.where((F.col("_n") >= least) & (F.col("_zero") < most_zero))
    pct = F.when(F.col("before") > 0, (F.col("recent") - F.col("before")) / F.nullif(F.col("before"), F.lit(0.0)) * 100)
    return kept.select("item", "recent", "before", pct.alias("change_pct")).withColumn("signal", trend_signal(F.col("change_pct")))


def excluded_items(rows: DataFrame, least: int = 14, most_zero: float = 0.4) -> DataFrame:
    """(item, n, zero_share, reason) of the items that signals leave out."""
    sums = rows.groupBy("item").agg(F.count("*").alias("n"), F.avg((F.col("value") == 0).cast("double")).alias("zero_share"))
    return sums.withColumn("reason", F.when(F.col("n") < least, "few_rows").when(F.col("zero_share") >= most_zero, "low_volume")).where("reason is not null")


def top_items(rows: DataFrame, k: int) -> DataFrame:
    """The ``k`` items with the highest mean value."""
    return rows.groupBy("item").agg(F.avg("value").alias("mean")).orderBy(F.col("mean").desc(), "item").limit(k)


def quarterly_means(rows: DataFrame) -> DataFrame:
    return rows.groupBy("item", F.concat_ws("-", F.year("day").cast("string"), F.quarter("day").cast("string")).alias("quarter")).agg(F.avg("value").alias("mean"))


def forecast(history: DataFrame, weather: Column | None, days: int) -> DataFrame:
    """(item, quantity, low, high, confidence) for ``days``: mean daily count times a weather factor, 15 percent either way; ``history(item, value)``."""
    factor = F.lit(1.0) if weather is None else weather
    h = history.groupBy("item").agg(F.avg("value").alias("_m"), F.count("value").alias("_n"))
    q = F.ceil(F.coalesce("_m", F.lit(0.0)) * days * factor).cast("long")
    sure = F.least(0.70 + F.when(F.col("_n") >= 30, 0.10).otherwise(0.0) + (0.05 if weather is not None else 0.0), F.lit(0.95))
    return h.select("item", q.alias("quantity"), sure.alias("confidence")).select("item", "quantity", F.greatest(F.floor(F.col("quantity") * 0.85), F.lit(0)).cast("long").alias("low"), F.ceil(F.col("quantity") * 1.15).cast("long").alias("high"), "confidence")


def review_gaps(reviews: DataFrame, by: str) -> DataFrame:
    """(by, trend): the mean gap in days between reviews, negated, so that more frequent is more."""
    gap = F.datediff("day", F.lag("day").over(Window.partitionBy(by).orderBy("day")))
    return reviews.withColumn("_g", gap).groupBy(by).agg((-F.avg("_g")).alias("trend"))


def latest_states(rows: DataFrame, key: str, at: str) -> DataFrame:
    """The last row of each key by time, ties by its content."""
    rest = [c for c in rows.columns if c not in (key, at)]
    return first_of(rows, [key], [F.col(at).desc(), *map(F.col, rest)])


def expired(rows: DataFrame, key: str, at: str, status: str, now: dt.datetime, days: int, terminal: tuple[str, ...] = ("done", "rejected")) -> DataFrame:
    """Keys whose last state is terminal and older than ``days``."""
    ended = F.lit(False)
    for prefix in terminal:
        ended = ended | F.coalesce(F.col(status).startswith(prefix), F.lit(False))
    return latest_states(rows, key, at).where(ended & (F.col(at) < F.lit(now - dt.timedelta(days=days)))).select(key)


def stale_jobs(jobs: DataFrame, now: Column, queued_minutes: int = 30, running_minutes: int = 60) -> DataFrame:
    """Jobs that wait or run for too long, with the state they are to get."""
    age = (F.unix_timestamp(now) - F.unix_timestamp("updated")) / 60
    late = ((F.col("state") == "queued") & (age > queued_minutes)) | ((F.col("state") == "running") & (age > running_minutes))
    return jobs.where(late).withColumn("next_state", F.lit("failed"))
