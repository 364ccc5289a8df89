"""Queries over receipts, purchases and search counts."""

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmart.functions import classify
from quillmart.operators import expenses
from quillmart.plans.bases import RECEIPTS, SEARCHES
from quillmart.plans.registry import query
from quillmart.sources import readers, tables, writers
from quillmart.sources.tables import Tables

SUM = "CAST(sum(CAST({} AS DECIMAL(18,4))) AS DOUBLE)"


@query(
    f"""WITH {RECEIPTS}, w AS (SELECT category, CAST(date_trunc('week', day) AS DATE) AS week, {SUM.format("total")} AS amount FROM receipts GROUP BY 1, 2),
z AS (SELECT *, avg(amount) OVER (PARTITION BY category) AS mean, (amount - avg(amount) OVER (PARTITION BY category)) / nullif(stddev_pop(amount) OVER (PARTITION BY category), 0) AS z FROM w)
SELECT category, week, amount, mean, z, CASE WHEN z > 0 THEN 'surge' ELSE 'drop' END AS direction FROM z WHERE abs(z) >= 1.3""",
    "amount mean z",
    digits=5,
)
def expense_outliers(t: Tables) -> DataFrame:
    return expenses.weekly_outliers(tables.receipts(t))


@query(
    f"""WITH {RECEIPTS}, a AS (SELECT strftime(day, '%Y-%m') AS month, category, {SUM.format("total")} AS actual FROM receipts GROUP BY 1, 2), b AS (SELECT month, category, round(actual) * 0.9 AS budget FROM a WHERE month < '2000-01')
SELECT a.month, a.category, actual, coalesce(budget, 0.0) AS budget, actual - coalesce(budget, 0.0) AS over, CASE WHEN budget > 0 THEN (actual - budget) / budget * 100 END AS over_pct FROM a LEFT JOIN b ON a.month = b.month AND a.category = b.category WHERE actual > coalesce(budget, 0.0)""",
    "actual budget over over_pct",
    digits=4,
)
def budget_overruns(t: Tables) -> DataFrame:
    from quillmart.functions.columns import exact_sum

    r = tables.receipts(t)
    budget = r.groupBy(expenses.month().alias("month"), "category").agg(exact_sum("total").alias("a")).where("month < '2000-01'").select("month", "category", (F.round("a") * 0.9).alias("budget"))
    return expenses.over_budget(r, budget)


BOUGHT = f"{RECEIPTS}, bought AS (SELECT i.*, r.day FROM receipt_items i JOIN receipts r ON i.receipt = r.receipt)"


def _bought(t: Tables) -> DataFrame:
    return expenses.purchases(tables.receipt_items(t), tables.receipts(t))


@query(
    f"""WITH {BOUGHT}, g AS (SELECT * FROM bought WHERE unit IS NOT NULL), d AS (SELECT max(day) AS d FROM g),
s AS (SELECT item, avg(unit_price) FILTER (day <= d - 28) AS before, avg(unit_price) FILTER (day > d - 28) AS recent FROM g, d WHERE day > d - 56 GROUP BY item)
SELECT item, before, recent, (recent - before) / nullif(before, 0) * 100 AS change_pct FROM s WHERE abs((recent - before) / nullif(before, 0) * 100) >= 10""",
    "before recent change_pct",
)
def purchase_price_changes(t: Tables) -> DataFrame:
    return expenses.price_changes(_bought(t))


LATEST = f"{BOUGHT}, latest AS (SELECT item, unit_price, unit FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY day DESC, receipt DESC, line DESC, unit_price DESC) AS n FROM bought) WHERE n = 1)"


@query(f"WITH {LATEST} SELECT * FROM latest", "unit_price")
def latest_prices(t: Tables) -> DataFrame:
    return expenses.latest_prices(_bought(t))


@query(
    f"""WITH {LATEST}, products AS (SELECT 'menu ' || p_name AS product, max(p_retailprice) AS price FROM part GROUP BY p_name),
recipes AS (SELECT 'menu ' || p_name AS product, p_name AS item, (1 + length(p_name) % 5)::DOUBLE AS amount FROM part WHERE p_name NOT LIKE 'red%' GROUP BY p_name UNION ALL SELECT 'menu ' || p_name, 'no such item', 1.0 FROM part WHERE p_name LIKE 'blue%' GROUP BY p_name),
per AS (SELECT item, unit_price / CASE unit WHEN 'kg' THEN 1000.0::DOUBLE WHEN 'L' THEN 1000.0::DOUBLE END AS per FROM latest),
c AS (SELECT r.product, sum(per * amount) AS cost, min(r.item) FILTER (per IS NULL) AS missing FROM recipes r LEFT JOIN per ON r.item = per.item GROUP BY r.product)
SELECT p.product, price, CASE WHEN c.product IS NOT NULL AND missing IS NULL THEN cost END AS cost, CASE WHEN c.product IS NOT NULL AND missing IS NULL THEN cost / nullif(price, 0) * 100 END AS cost_rate_pct, CASE WHEN c.product IS NULL THEN 'recipe' ELSE missing END AS missing FROM products p LEFT JOIN c ON p.product = c.product""",
    "price cost cost_rate_pct",
)
def cost_rates(t: Tables) -> DataFrame:
    names = t.part.groupBy("p_name").agg(F.max("p_retailprice").alias("price"))
    product = F.concat(F.lit("menu "), "p_name").alias("product")
    recipes = names.where("p_name not like 'red%'").select(product, F.col("p_name").alias("item"), (1 + F.length("p_name") % 5).cast("double").alias("amount"))
    recipes = recipes.union(names.where("p_name like 'blue%'").select(product, F.lit("no such item"), F.lit(1.0)))
    return expenses.cost_rates(names.select(product, "price"), recipes, expenses.latest_prices(_bought(t)))


@query(
    f"""WITH {BOUGHT}, m AS (SELECT item, strftime(day, '%Y-%m') AS month, avg(unit_price) AS price FROM bought WHERE unit IS NOT NULL GROUP BY 1, 2)
SELECT item, month, price, price / nullif(first_value(price) OVER (PARTITION BY item ORDER BY month), 0) * 100 AS index FROM m""",
    "price index",
)
def purchase_price_index(t: Tables) -> DataFrame:
    return expenses.price_index(_bought(t))


def _trend_sql(step: str, months: int) -> str:
    return f"""WITH {RECEIPTS}, r AS (SELECT CAST(date_trunc('{step}', day) AS DATE) AS period, {SUM.format("total")} AS v FROM receipts WHERE category IN ('BUILDING', 'MACHINERY') GROUP BY 1), e AS (SELECT CAST(date_trunc('{step}', day) AS DATE) AS period, {SUM.format("total")} AS v FROM receipts WHERE category NOT IN ('BUILDING', 'MACHINERY') GROUP BY 1),
rs AS (SELECT CAST(unnest(generate_series(min(period), max(period), INTERVAL {months} MONTH)) AS DATE) AS period FROM r), es AS (SELECT CAST(unnest(generate_series(min(period), max(period), INTERVAL {months} MONTH)) AS DATE) AS period FROM e)
SELECT period, coalesce(r.v, 0.0) AS revenue, coalesce(e.v, 0.0) AS spending FROM (SELECT period FROM rs UNION SELECT period FROM es) LEFT JOIN r USING (period) LEFT JOIN e USING (period)"""


def _sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    r = tables.receipts(t)
    return r.where("category in ('BUILDING', 'MACHINERY')"), r.where("category not in ('BUILDING', 'MACHINERY')")


@query(_trend_sql("month", 1), "revenue spending")
def monthly_trend(t: Tables) -> DataFrame:
    return expenses.monthly_trend(*_sides(t))


@query(_trend_sql("quarter", 3), "revenue spending")
def quarterly_trend(t: Tables) -> DataFrame:
    return expenses.monthly_trend(*_sides(t), step="quarter")


@query(
    f"""WITH {RECEIPTS}, new AS (SELECT receipt, replace(vendor, '#', ' ') AS vendor, day, total FROM receipts), known AS (SELECT replace(vendor, '#', '') AS vendor, day, CASE WHEN receipt % 3 = 0 THEN total ELSE -total END AS total FROM receipts)
SELECT receipt FROM new n WHERE EXISTS (SELECT 1 FROM known k WHERE k.vendor = replace(n.vendor, ' ', '') AND k.day = n.day AND k.total = n.total)"""
)
def duplicate_receipts(t: Tables) -> DataFrame:
    r = tables.receipts(t)
    new = r.withColumn("vendor", F.replace("vendor", F.lit("#"), F.lit(" ")))
    # of two receipts in three another total is known
    known = r.withColumns({"vendor": F.replace("vendor", F.lit("#"), F.lit("")), "total": F.when(F.col("receipt") % 3 == 0, F.col("total")).otherwise(-F.col("total"))})
    return expenses.known_duplicates(new, known).select("receipt")


@query(
    f"""WITH {SEARCHES}, r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY day DESC) AS n FROM searches),
s AS (SELECT item, count(*) AS k, avg((value = 0)::INT) AS zero, avg(value) FILTER (n <= 7) AS recent, avg(value) FILTER (n BETWEEN 8 AND 21) AS before FROM r GROUP BY item),
c AS (SELECT item, recent, before, CASE WHEN before > 0 THEN (recent - before) / before * 100 END AS change_pct FROM s WHERE k >= 14 AND zero < 0.4)
SELECT *, CASE WHEN change_pct IS NULL THEN 'unknown' WHEN change_pct >= 30 THEN 'surge' WHEN change_pct >= 10 THEN 'rise' WHEN change_pct <= -10 THEN 'fall' ELSE 'flat' END AS signal FROM c""",
    "recent before change_pct",
)
def search_trends(t: Tables) -> DataFrame:
    return expenses.trend_signals(tables.searches(t))


@query(
    f"""WITH {SEARCHES}, x AS (SELECT item, day, CASE WHEN length(item) % 2 = 0 AND day(day) % 2 = 0 THEN 0.0 ELSE value END AS value FROM searches WHERE item NOT LIKE 'view%' OR day < DATE '2024-01-10')
SELECT item, CAST(count(*) AS BIGINT) AS n, CAST(avg((value = 0)::INT) AS DOUBLE) AS zero_share, CASE WHEN count(*) < 14 THEN 'few_rows' ELSE 'low_volume' END AS reason FROM x GROUP BY item HAVING count(*) < 14 OR avg((value = 0)::INT) >= 0.4""",
    "zero_share",
)
def excluded_searches(t: Tables) -> DataFrame:
    s = tables.searches(t).where("item not like 'view%' or day < date '2024-01-10'")
    return expenses.excluded_items(s.withColumn("value", F.when((F.length("item") % 2 == 0) & (F.dayofmonth("day") % 2 == 0), 0.0).otherwise(F.col("value"))))


@query(f"WITH {SEARCHES} SELECT item, avg(value) AS mean FROM searches GROUP BY item ORDER BY mean DESC, item LIMIT 10", "mean")
def top_searches(t: Tables) -> DataFrame:
    return expenses.top_items(tables.searches(t), 10)


@query(f"WITH {SEARCHES} SELECT item, CAST(year(day) AS VARCHAR) || '-' || CAST(quarter(day) AS VARCHAR) AS quarter, avg(value) AS mean FROM searches GROUP BY 1, 2", "mean")
def quarterly_searches(t: Tables) -> DataFrame:
    return expenses.quarterly_means(tables.searches(t))


@query(
    f"""WITH {SEARCHES}, h AS (SELECT item, avg(value) AS m, count(value) AS n FROM searches GROUP BY item), f AS (SELECT item, n, CAST(ceil(m * 7 * (1.0::DOUBLE + 0.05::DOUBLE + (-0.05)::DOUBLE + 0.03::DOUBLE)) AS BIGINT) AS quantity FROM h)
SELECT item, quantity, CAST(greatest(floor(quantity * 0.85::DOUBLE), 0) AS BIGINT) AS low, CAST(ceil(quantity * 1.15::DOUBLE) AS BIGINT) AS high, least(0.95::DOUBLE, 0.70::DOUBLE + CASE WHEN n >= 30 THEN 0.10::DOUBLE ELSE 0.0::DOUBLE END + 0.05::DOUBLE) AS confidence FROM f""",
    "confidence",
)
def demand_forecast(t: Tables) -> DataFrame:
    factor = classify.weather_factor(F.lit(27.0), F.lit(65.0), F.lit(85.0))
    return expenses.forecast(tables.searches(t), factor, 7)


@query(
    """WITH g AS (SELECT user_id, date_diff('day', lag(CAST(ts AS DATE)) OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE)), CAST(ts AS DATE)) AS g FROM events) SELECT user_id, -avg(g) AS trend FROM g GROUP BY user_id""",
    "trend",
)
def review_growth(t: Tables) -> DataFrame:
    return expenses.review_gaps(t.events.select("user_id", F.col("ts").cast("date").alias("day")), "user_id")


@query(
    """WITH s AS (SELECT user_id, ts, CASE event_type WHEN 'purchase' THEN 'done: bought' WHEN 'error' THEN 'rejected' ELSE 'open' END AS status, event_id FROM events), l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, status, event_id) AS n FROM s)
SELECT user_id FROM l WHERE n = 1 AND (status LIKE 'done%' OR status LIKE 'rejected%') AND ts < TIMESTAMP '2024-02-03' - INTERVAL 5 DAY"""
)
def expired_states(t: Tables) -> DataFrame:
    s = t.events.select("user_id", "ts", F.when(F.col("event_type") == "purchase", "done: bought").when(F.col("event_type") == "error", "rejected").otherwise("open").alias("status"), "event_id")
    return expenses.expired(s, "user_id", "ts", "status", dt.datetime(2024, 2, 3), 5)


@query(
    """WITH j AS (SELECT event_id, ts AS updated, CASE event_id % 3 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' ELSE 'done' END AS state FROM events)
SELECT event_id, 'failed' AS next_state FROM j WHERE (state = 'queued' AND floor(epoch(TIMESTAMP '2024-01-20')) - floor(epoch(updated)) > 1800) OR (state = 'running' AND floor(epoch(TIMESTAMP '2024-01-20')) - floor(epoch(updated)) > 3600)"""
)
def stale_jobs(t: Tables) -> DataFrame:
    j = t.events.select("event_id", F.col("ts").alias("updated"), F.when(F.col("event_id") % 3 == 0, "queued").when(F.col("event_id") % 3 == 1, "running").otherwise("done").alias("state"))
    return expenses.stale_jobs(j, F.lit(dt.datetime(2024, 1, 20)).cast("timestamp")).select("event_id", "next_state")


@query("SELECT c_custkey, CAST(5000 + row_number() OVER (ORDER BY c_acctbal, c_custkey) AS BIGINT) AS id FROM customer")
def running_ids(t: Tables) -> DataFrame:
    """Ids after the largest known one, in order, without a one-task window."""
    return writers.with_ids(t.customer.select("c_custkey", "c_acctbal"), "id", 5000, ["c_acctbal", "c_custkey"]).select("c_custkey", "id")


@query("SELECT CAST(s // 4 * 10 + s % 4 + 1 AS INTEGER) AS quarter FROM (SELECT unnest(generate_series(8000, 8020)) AS s)")
def quarter_codes(t: Tables) -> DataFrame:
    return readers.quarter_codes(t.spark, 20001, 20051)


@query("SELECT n_regionkey, min(n_name) AS n_name FROM nation GROUP BY n_regionkey")
def industry_lookup(t: Tables) -> DataFrame:
    return readers.lookup(t.nation, "n_regionkey", "n_name")


@query(
    """WITH x AS (SELECT n_regionkey, n_nationkey, 'v,' || CASE WHEN n_nationkey % 4 = 0 THEN '+9999' ELSE CAST(n_nationkey * 13 AS VARCHAR) END || ',' || CAST(n_nationkey % 7 AS VARCHAR) AS field FROM nation)
SELECT n_nationkey, field, CASE WHEN n_nationkey % 7 IN (0, 1, 4, 5) AND n_nationkey % 4 <> 0 THEN n_nationkey * 13 / 10.0::DOUBLE END AS value FROM x""",
    "value",
)
def quality_marked_fields(t: Tables) -> DataFrame:
    """Numbers in comma-separated fields, kept by their quality mark."""
    k = F.col("n_nationkey")
    rows = t.nation.select("n_nationkey", F.concat(F.lit("v,"), F.when(k % 4 == 0, "+9999").otherwise((k * 13).cast("string")), F.lit(","), (k % 7).cast("string")).alias("field"))
    return rows.withColumn("value", readers.scaled(F.col("field"), "+9999", 10, 1, 2))


@query(
    """WITH d AS (SELECT CAST(ts AS DATE) AS day, sum(value) AS rain, avg(value) AS wind FROM events GROUP BY 1)
SELECT CAST(year(day) * 10 + quarter(day) AS INTEGER) AS quarter, sum(rain) AS rain, avg(wind) AS wind, CAST(count(*) AS BIGINT) AS days, sum(rain) / CASE quarter(day) WHEN 1 THEN 91 ELSE 92 END AS rain_a_day FROM d GROUP BY year(day), quarter(day)""",
    "rain wind rain_a_day",
)
def quarterly_weather(t: Tables) -> DataFrame:
    days = t.events.groupBy(F.col("ts").cast("date").alias("day")).agg(F.sum("value").alias("rain"), F.avg("value").alias("wind"))
    return readers.quarterly_weather(days, ["rain", "snow"], ["wind"])
