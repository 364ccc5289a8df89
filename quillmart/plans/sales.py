"""Queries over point-of-sale lines: daily totals, drivers, decompositions, validation, effects."""

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmart.functions.columns import exact_sum
from quillmart.operators import checks, drivers, effects, ranking
from quillmart.plans.bases import DECISIONS, POS
from quillmart.plans.registry import query
from quillmart.sources import tables
from quillmart.sources.tables import Tables

DEC = "CAST(sum(CAST({0} AS DECIMAL(18,4))){1} AS DOUBLE)"
PERIODS = f"""{POS}, top AS (SELECT max(day) AS d1, date_trunc('month', max(day))::DATE AS d0 FROM pos),
span AS (SELECT d0, d1, d0 - 1 AS b1, d0 - 1 - CAST(d1 - d0 AS INTEGER) AS b0 FROM top),
two AS (SELECT pos.*, day BETWEEN b0 AND b1 AS is_base, day BETWEEN d0 AND d1 AS is_current FROM pos, span WHERE day BETWEEN b0 AND d1)"""
DIMS = ["store", "hour", "category", "channel"]


@query(
    f"""WITH {POS}, g AS (SELECT day, store, {DEC.format("bill", "")} AS revenue, sum(qty) AS qty, CAST(count(DISTINCT transaction) AS BIGINT) AS transactions FROM pos GROUP BY 1, 2)
SELECT *, revenue / nullif(transactions, 0) AS order_value, revenue / nullif(qty, 0) AS unit_price, CAST(isodow(day) - 1 AS INTEGER) AS weekday, CAST(month(day) AS INTEGER) AS month, CAST(date_diff('day', (SELECT min(day) FROM pos), day) AS INTEGER) AS day_index FROM g""",
    "revenue qty order_value unit_price",
)
def daily_store_sales(t: Tables) -> DataFrame:
    return drivers.with_day_index(drivers.daily(tables.pos(t), ["store"]))


@query(
    f"""WITH {PERIODS}, each AS (
  {" UNION ALL ".join(f"SELECT '{d}' AS dimension, coalesce(CAST({d} AS VARCHAR), 'unknown') AS value, is_base, is_current, bill FROM two" for d in DIMS)}),
g AS (SELECT dimension, value, coalesce({DEC.format("bill", " FILTER (is_base)")}, 0.0) AS before, coalesce({DEC.format("bill", " FILTER (is_current)")}, 0.0) AS after FROM each GROUP BY 1, 2),
w AS (SELECT dimension, sum(CAST(after - before AS DECIMAL(18,4)))::DOUBLE AS whole FROM g GROUP BY 1)
SELECT g.dimension, value, before, after, after - before AS amount, CASE WHEN abs(whole) > 1e-8 THEN (after - before) / whole * 100 END AS share_pct,
  CASE WHEN after > before THEN 'positive' WHEN after < before THEN 'negative' ELSE 'neutral' END AS direction FROM g JOIN w ON g.dimension = w.dimension""",
    "before after amount share_pct",
)
def driver_contributions(t: Tables) -> DataFrame:
    lines = tables.pos(t)
    return drivers.contributions(lines, drivers.infer_periods(lines), DIMS)


@query(
    f"""WITH {PERIODS}, p AS (SELECT product, sum(qty) FILTER (is_base) AS q0, sum(qty) FILTER (is_current) AS q1, {DEC.format("bill", " FILTER (is_base)")} AS r0, {DEC.format("bill", " FILTER (is_current)")} AS r1 FROM two GROUP BY product)
SELECT product, CASE WHEN r0 IS NOT NULL AND r1 IS NOT NULL THEN (q1 - q0) * (r0 / q0 + r1 / q1) / 2 ELSE 0.0 END AS quantity_effect, CASE WHEN r0 IS NOT NULL AND r1 IS NOT NULL THEN (r1 / q1 - r0 / q0) * (q0 + q1) / 2 ELSE 0.0 END AS price_effect,
  CASE WHEN r0 IS NOT NULL AND r1 IS NOT NULL THEN 0.0 WHEN r0 IS NULL THEN r1 ELSE -r0 END AS entry_effect FROM p""",
    "quantity_effect price_effect entry_effect",
)
def price_quantity_effects(t: Tables) -> DataFrame:
    lines = tables.pos(t)
    return drivers.price_and_quantity(lines, drivers.infer_periods(lines))


SUMMARY = f"""{PERIODS}, s AS (SELECT {DEC.format("bill", " FILTER (is_base)")} AS base_revenue, {DEC.format("bill", " FILTER (is_current)")} AS revenue,
  CAST(count(DISTINCT transaction) FILTER (is_base) AS BIGINT) AS base_transactions, CAST(count(DISTINCT transaction) FILTER (is_current) AS BIGINT) AS transactions FROM two),
summary AS (SELECT *, revenue - base_revenue AS revenue_change, base_revenue / base_transactions AS base_order_value, revenue / transactions AS order_value,
  (transactions - base_transactions) * (base_revenue / base_transactions + revenue / transactions) / 2 AS count_effect, (revenue / transactions - base_revenue / base_transactions) * (base_transactions + transactions) / 2 AS value_effect FROM s)"""


@query(f"WITH {SUMMARY} SELECT * FROM summary", "base_revenue revenue revenue_change base_order_value order_value count_effect value_effect")
def sales_summary(t: Tables) -> DataFrame:
    lines = tables.pos(t)
    return drivers.summary(lines, drivers.infer_periods(lines))


@query(
    f"""WITH {SUMMARY}, e AS (SELECT revenue_change, 'transaction_count' AS driver, count_effect AS amount FROM summary UNION ALL SELECT revenue_change, 'order_value', value_effect FROM summary)
SELECT driver, amount FROM e ORDER BY ((amount > 0) = (revenue_change > 0)) DESC, abs(amount) DESC, driver LIMIT 1""",
    "amount",
)
def main_driver(t: Tables) -> DataFrame:
    lines = tables.pos(t)
    return drivers.main_formula_driver(drivers.summary(lines, drivers.infer_periods(lines)))


@query(f"WITH {PERIODS} SELECT category, {DEC.format('bill', '')} AS revenue FROM two WHERE is_current GROUP BY category ORDER BY revenue DESC, category LIMIT 1", "revenue")
def top_category(t: Tables) -> DataFrame:
    lines = tables.pos(t)
    return drivers.top_category(lines, drivers.infer_periods(lines))


DAYPART = "CASE WHEN hour <= 6 THEN 'dawn' WHEN hour <= 10 THEN 'morning' WHEN hour <= 14 THEN 'lunch' WHEN hour <= 18 THEN 'afternoon' WHEN hour <= 22 THEN 'evening' WHEN hour <= 24 THEN 'night' END"
BREAKDOWN_DIMS = ["hour", "weekday", "daypart", "weekday_daypart", "category", "channel", "store"]
EACH = f"""{POS}, wide AS (SELECT *, isodow(day) - 1 AS weekday, {DAYPART} AS daypart, CAST(isodow(day) - 1 AS VARCHAR) || '-' || {DAYPART} AS weekday_daypart FROM pos),
each AS ({" UNION ALL ".join(f"SELECT '{d}' AS dimension, coalesce(CAST({d} AS VARCHAR), 'unknown') AS value, bill, qty, transaction FROM wide" for d in BREAKDOWN_DIMS)})"""


@query(
    f"""WITH {EACH}, g AS (SELECT dimension, value, {DEC.format("bill", "")} AS revenue, sum(qty) AS qty, CAST(count(DISTINCT transaction) AS BIGINT) AS transactions FROM each GROUP BY 1, 2),
x AS (SELECT *, revenue / nullif((sum(CAST(revenue AS DECIMAL(18,4))) OVER (PARTITION BY dimension))::DOUBLE, 0) * 100 AS share_pct, revenue / nullif(transactions, 0) AS order_value, row_number() OVER (PARTITION BY dimension ORDER BY revenue DESC, value) AS n FROM g)
SELECT * EXCLUDE (n) FROM x WHERE n <= 20""",
    "revenue qty share_pct order_value",
)
def sales_breakdown(t: Tables) -> DataFrame:
    """Seven dimensions in one pass, the twenty largest values of each."""
    lines = tables.pos(t).withColumns({"weekday": F.weekday("day"), "daypart": drivers.daypart(F.col("hour"))})
    return drivers.breakdown(lines.withColumn("weekday_daypart", F.concat_ws("-", F.col("weekday").cast("string"), "daypart")), BREAKDOWN_DIMS)


@query(
    f"""WITH {POS}, g AS (SELECT CASE WHEN GROUPING(category) = 0 THEN 'category' WHEN GROUPING(channel) = 0 THEN 'channel' ELSE 'all' END AS level, coalesce(category, channel, 'all') AS value,
  {DEC.format("bill", "")} AS revenue, CAST(count(*) AS BIGINT) AS lines FROM pos GROUP BY GROUPING SETS ((category), (channel), ())) SELECT * FROM g""",
    "revenue",
)
def sales_grouping_sets(t: Tables) -> DataFrame:
    return drivers.breakdown_sets(tables.pos(t), ["category", "channel"])


@query(f"WITH {POS} SELECT avg(unit_price) AS mean_price, avg(qty) AS mean_qty, median(unit_price) AS median_price FROM pos", "mean_price mean_qty median_price")
def price_levels(t: Tables) -> DataFrame:
    return drivers.price_levels(tables.pos(t))


DAILY = f"""{POS}, days AS (SELECT day, {DEC.format("bill", "")} AS revenue, CAST(count(DISTINCT transaction) AS BIGINT) AS transactions FROM pos GROUP BY day),
factored AS (SELECT *, CASE WHEN day_n % 7 <> 0 THEN (day_n * 37 % 200)::DOUBLE END AS traffic, CASE WHEN quarter(day) % 2 = 0 THEN 1.5::DOUBLE ELSE 0.0::DOUBLE END AS exposure FROM (SELECT *, date_diff('day', DATE '1990-01-01', day) AS day_n FROM days))"""


def _factored(t: Tables) -> DataFrame:
    days = drivers.daily(tables.pos(t), []).select("day", "revenue", "transactions")
    n = F.datediff("day", F.lit(dt.date(1990, 1, 1)))
    return days.withColumns({"traffic": F.when(n % 7 != 0, (n * 37 % 200).cast("double")), "exposure": F.when(F.quarter("day") % 2 == 0, 1.5).otherwise(0.0)})


@query(
    f"""WITH {DAILY}, g AS (SELECT avg(traffic) AS traffic, avg(revenue) AS daily_revenue, avg(transactions) AS daily_transactions FROM factored WHERE traffic IS NOT NULL)
SELECT *, daily_revenue / traffic AS revenue_per_traffic, daily_transactions / traffic * 100 AS transactions_per_traffic_pct FROM g WHERE traffic > 0""",
    "traffic daily_revenue daily_transactions revenue_per_traffic transactions_per_traffic_pct",
)
def traffic_conversion(t: Tables) -> DataFrame:
    return drivers.traffic_ratios(_factored(t), "traffic")


@query(
    f"""WITH {DAILY}, g AS (SELECT avg(revenue) FILTER (exposure > 0) AS exposed, avg(revenue) FILTER (exposure <= 0) AS unexposed, CAST(count(*) FILTER (exposure > 0) AS BIGINT) AS exposed_days, CAST(count(*) FILTER (exposure <= 0) AS BIGINT) AS unexposed_days FROM factored)
SELECT *, (exposed / nullif(unexposed, 0) - 1) * 100 AS difference_pct FROM g""",
    "exposed unexposed difference_pct",
)
def exposed_days(t: Tables) -> DataFrame:
    return drivers.exposed_against_not(_factored(t), "exposure")


@query(
    f"""WITH {DAILY}, r AS (SELECT avg((traffic IS NOT NULL)::INT) AS traffic, avg((exposure IS NOT NULL)::INT) AS exposure FROM factored)
SELECT 'traffic' AS factor, CAST(traffic AS DOUBLE) AS rate, traffic < 0.8 AS low FROM r UNION ALL SELECT 'exposure', CAST(exposure AS DOUBLE), exposure < 0.8 FROM r""",
    "rate",
)
def factor_join_rates(t: Tables) -> DataFrame:
    return checks.join_rate(_factored(t), ["traffic", "exposure"])


@query(
    f"""WITH {PERIODS}, each AS ({" UNION ALL ".join(f"SELECT '{d}' AS dimension, coalesce(CAST({d} AS VARCHAR), 'unknown') AS value, is_base, is_current, bill FROM two" for d in DIMS)}),
g AS (SELECT dimension, value, coalesce({DEC.format("bill", " FILTER (is_current)")}, 0.0) - coalesce({DEC.format("bill", " FILTER (is_base)")}, 0.0) AS amount FROM each GROUP BY 1, 2),
w AS (SELECT *, (sum(CAST(amount AS DECIMAL(18,4))) OVER (PARTITION BY dimension))::DOUBLE AS whole, count(*) OVER (PARTITION BY dimension) AS n FROM g),
a AS (SELECT *, abs(amount) / (sum(CAST(abs(amount) AS DECIMAL(18,4))) OVER (PARTITION BY dimension))::DOUBLE * 100 AS dimension_share FROM w WHERE (dimension <> 'store' OR n > 1) AND (amount > 0) = (whole > 0))
SELECT dimension, value, amount, dimension_share FROM a WHERE abs(amount) >= abs(whole) * 0.05 AND dimension_share >= 10 ORDER BY abs(amount) DESC, dimension, value LIMIT 6""",
    "amount dimension_share",
)
def root_cause_details(t: Tables) -> DataFrame:
    lines = tables.pos(t)
    return drivers.top_drivers(drivers.contributions(lines, drivers.infer_periods(lines), DIMS))


@query(
    """SELECT * FROM (SELECT day, dayofweek(day) IN (0, 6) AS weekend, day(day) = 1 AS month_start, day = last_day(day) AS month_end FROM (SELECT CAST(unnest(generate_series((SELECT min(o_orderdate) FROM orders), (SELECT max(o_orderdate) FROM orders), INTERVAL 1 DAY)) AS DATE) AS day))"""
)
def calendar_spine(t: Tables) -> DataFrame:
    """Every day of the orders' span with its flags."""
    span = t.orders.agg(F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("b"))
    return drivers.calendar_flags(span.select(*drivers.calendar(F.col("a"), F.col("b"))))


@query(
    f"""WITH {POS}, d AS (SELECT day, store, sum(CAST(bill AS DECIMAL(18,4))) AS revenue, sum(qty) AS qty, count(*) AS n FROM pos GROUP BY 1, 2)
SELECT 'revenue' AS measure, CAST((SELECT sum(CAST(bill AS DECIMAL(18,4))) FROM pos) AS DOUBLE) AS raw, CAST((SELECT sum(revenue) FROM d) AS DOUBLE) AS aggregated, true AS agrees
UNION ALL SELECT 'qty', (SELECT sum(qty) FROM pos), (SELECT sum(qty) FROM d), true UNION ALL SELECT 'lines', CAST((SELECT count(*) FROM pos) AS DOUBLE), CAST((SELECT sum(n) FROM d) AS DOUBLE), true""",
    "raw aggregated",
)
def reconciled_totals(t: Tables) -> DataFrame:
    lines = tables.pos(t)
    days = lines.groupBy("day", "store").agg(exact_sum("bill").alias("revenue"), F.sum("qty").alias("qty"), F.count("*").alias("n"))
    return checks.reconciled(lines, days, [("revenue", exact_sum("bill"), exact_sum("revenue")), ("qty", F.sum("qty"), F.sum("qty")), ("lines", F.count("*"), F.sum("n"))])


@query(
    """WITH x AS (SELECT *, CASE WHEN l_orderkey % 7 = 0 THEN -l_quantity WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_quantity END AS q, CASE WHEN l_orderkey % 5 = 0 THEN l_extendedprice + 1 ELSE l_extendedprice END AS b, l_extendedprice / l_quantity AS p FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, q, b FROM x WHERE q IS NULL OR q <= 0 OR abs(q * p - b) > 0.01""",
    "q b",
)
def invalid_amounts(t: Tables) -> DataFrame:
    k = F.col("l_orderkey")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.when(k % 7 == 0, -F.col("l_quantity")).when(k % 11 == 0, None).otherwise(F.col("l_quantity")).alias("q"), F.when(k % 5 == 0, F.col("l_extendedprice") + 1).otherwise(F.col("l_extendedprice")).alias("b"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"))
    return checks.bad_amounts(rows, "q", "p", "b").select("l_orderkey", "l_linenumber", "l_partkey", "q", "b")


@query("SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_keys(t: Tables) -> DataFrame:
    return checks.duplicates(t.lineitem, ["l_orderkey", "l_linenumber"])


@query(
    """SELECT o_orderkey, d, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM (
  SELECT o_orderkey, o_orderdate, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%d-%m-%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'on ' || strftime(o_orderdate, '%Y') END AS d FROM orders)"""
)
def parsed_days(t: Tables) -> DataFrame:
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    text = F.when(k % 3 == 0, F.date_format(d, "dd-MM-yyyy")).when(k % 3 == 1, F.date_format(d, "yyyy-MM-dd")).otherwise(F.concat(F.lit("on "), F.date_format(d, "yyyy")))
    return t.orders.select("o_orderkey", text.alias("d")).withColumn("day", checks.parse_day(F.col("d")))


LEDGER = [("repeated", "n > 1"), ("not_eligible", "not eligible"), ("no_propensity", "propensity is null"), ("propensity_range", "not (propensity > 0 and propensity <= 0.6)"), ("not_after", "treated_quarter <= quarter"), ("no_reward", "reward is null")]


@query(
    f"""WITH {DECISIONS}, twice AS (SELECT *, 0 AS copy FROM decisions UNION ALL SELECT *, 1 FROM decisions WHERE decision_id % 19 = 0),
x AS (SELECT *, row_number() OVER (PARTITION BY decision_id ORDER BY copy) AS n FROM twice)
SELECT reason, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE {" ".join(f"WHEN {c} THEN '{r}'" for r, c in LEDGER)} ELSE 'ok' END AS reason FROM x) GROUP BY reason"""
)
def exclusion_ledger(t: Tables) -> DataFrame:
    """Each row counted once, under the first check that it fails."""
    d = tables.decisions(t)
    twice = d.withColumn("copy", F.lit(0)).union(d.where("decision_id % 19 = 0").withColumn("copy", F.lit(1)))
    marked = twice.withColumn("again", checks.is_repeat(["decision_id"], [F.col("copy")]))
    return checks.ledger(marked, [(r, F.col("again") if r == "repeated" else F.expr(c)) for r, c in LEDGER])


@query(
    """WITH known AS (SELECT 'Customer#' || lpad(CAST(s_suppkey * 3 AS VARCHAR), 9, '0') AS name FROM supplier)
SELECT c_custkey, c_name FROM customer WHERE c_name NOT IN (SELECT name FROM known)"""
)
def new_customers_only(t: Tables) -> DataFrame:
    """Anti-join on normalised names."""
    known = t.supplier.select(F.concat(F.lit("Customer#"), F.lpad((F.col("s_suppkey") * 3).cast("string"), 9, "0")).alias("name"))
    return checks.without_known(t.customer.select("c_custkey", "c_name"), known, F.trim("c_name"), F.col("name"))


# effects of a change: aggregates of two stretches of days

MONTHS = f"""{PERIODS}, tagged AS (SELECT *, CASE WHEN is_base THEN 'before' ELSE 'after' END AS stretch FROM two),
per_customer AS (SELECT stretch, customer, count(DISTINCT transaction) AS n FROM tagged GROUP BY 1, 2),
agg AS (SELECT stretch, {DEC.format("bill", "")} AS total_sales, coalesce({DEC.format("bill", " FILTER (hour >= 22 OR hour <= 2)")}, 0.0) AS target_sales, CAST(count(DISTINCT transaction) AS BIGINT) AS visits,
  avg(coupon::INT) * 100.0 AS coupon_rate, CAST(date_diff('day', min(day), max(day)) + 1 AS INTEGER) AS days FROM tagged GROUP BY stretch),
rev AS (SELECT stretch, avg((n >= 2)::INT) * 100.0 AS revisit_rate, CAST(count(*) AS BIGINT) AS customers FROM per_customer GROUP BY stretch),
aggregates AS (SELECT a.stretch, total_sales, target_sales, visits, total_sales / visits AS order_value, revisit_rate, coupon_rate, customers, days FROM agg a JOIN rev r ON a.stretch = r.stretch)"""


def _stretches(t: Tables) -> DataFrame:
    lines = tables.pos(t)
    p = drivers.infer_periods(lines)
    return p.within(lines).withColumn("stretch", F.when(p.base(), "before").otherwise("after"))


@query(f"WITH {MONTHS} SELECT * FROM aggregates", "total_sales target_sales order_value revisit_rate coupon_rate")
def visit_aggregates(t: Tables) -> DataFrame:
    return effects.aggregates(_stretches(t), ["stretch"], 22, 2)


@query(f"WITH {MONTHS} SELECT CAST(count(*) AS BIGINT) AS new_customers FROM per_customer a WHERE stretch = 'after' AND NOT EXISTS (SELECT 1 FROM per_customer b WHERE b.stretch = 'before' AND b.customer = a.customer)")
def new_customers(t: Tables) -> DataFrame:
    rows = _stretches(t)
    return effects.new_customers(rows.where("stretch = 'after'"), rows.where("stretch = 'before'"))


@query(
    f"""WITH {POS} SELECT hour, {DEC.format("bill", "")} AS sales FROM pos GROUP BY hour""",
    "sales",
)
def hourly_sales(t: Tables) -> DataFrame:
    return effects.hourly(tables.pos(t))


def _held(x: str) -> str:
    return f"greatest(0.0::DOUBLE, least(100.0::DOUBLE, {x}))"


@query(
    f"""WITH {MONTHS}, b AS (SELECT * FROM aggregates WHERE stretch = 'before'), a AS (SELECT * FROM aggregates WHERE stretch = 'after'),
n AS (SELECT count(*) AS fresh FROM per_customer a WHERE stretch = 'after' AND NOT EXISTS (SELECT 1 FROM per_customer b WHERE b.stretch = 'before' AND b.customer = a.customer)),
c AS (SELECT (a.target_sales - b.target_sales) / nullif(b.target_sales, 0) * 100 AS target, (a.total_sales - b.total_sales) / nullif(b.total_sales, 0) * 100 AS total, (a.visits - b.visits) / nullif(b.visits, 0) * 100 AS visits,
  (a.order_value - b.order_value) / nullif(b.order_value, 0) * 100 AS value, a.revisit_rate - b.revisit_rate AS revisit, a.coupon_rate - b.coupon_rate AS coupon FROM a, b),
s AS (SELECT coalesce(target - coalesce(total, 0.0), 0.0) AS adjusted, {_held("coalesce(target - coalesce(total, 0.0), 0.0) / 15 * 100")} * 0.35 + {_held("coalesce(visits, 0.0) / 15 * 100")} * 0.15 + {_held("coalesce(value, 0.0) / 10 * 100")} * 0.10 + {_held("coalesce(revisit, 0.0) / 5 * 100")} * 0.15 + {_held("coalesce(coupon, 0.0) / 10 * 100")} * 0.10 AS score FROM c)
SELECT adjusted, score, CASE WHEN score >= 70 THEN 'effective' WHEN score >= 40 THEN 'partly_effective' ELSE 'not_effective' END AS verdict FROM s""",
    "adjusted score",
)
def sales_effect(t: Tables) -> DataFrame:
    """Effect score of the later stretch against the earlier one; new and returning customers have no history here and count 0."""
    rows = effects.aggregates(_stretches(t), ["stretch"], 22, 2).withColumns({"new_customers": F.lit(0), "returned": F.lit(0)})
    return effects.sales_score(rows, "stretch")


@query(
    f"""WITH {MONTHS} SELECT metric, before, after, after - before AS change, (after - before) / nullif(before, 0) * 100 AS change_pct, CASE WHEN metric = 'coupon_rate' THEN after < before ELSE after > before END AS improved FROM (
  SELECT m AS metric, max(v) FILTER (stretch = 'before') AS before, max(v) FILTER (stretch = 'after') AS after FROM (
    SELECT stretch, unnest(['total_sales', 'order_value', 'revisit_rate', 'coupon_rate']) AS m, unnest([total_sales, order_value, revisit_rate, coupon_rate]) AS v FROM aggregates) GROUP BY m)""",
    "before after change change_pct",
)
def metric_changes(t: Tables) -> DataFrame:
    rows = effects.aggregates(_stretches(t), ["stretch"], 22, 2)
    return effects.metric_changes(rows, "stretch", {"total_sales": True, "order_value": True, "revisit_rate": True, "coupon_rate": False})


@query(
    """WITH k AS (SELECT CASE WHEN user_id % 7 = 3 AND ts < TIMESTAMP '2024-01-16' THEN 'past-' ELSE '' END || event_type || '-' || CAST(user_id % 40 AS VARCHAR) AS keyword, ts >= TIMESTAMP '2024-01-16' AS now FROM events),
c AS (SELECT keyword, CAST(count(*) FILTER (now) AS BIGINT) AS n, CAST(count(*) FILTER (NOT now) AS BIGINT) AS before FROM k GROUP BY keyword)
SELECT keyword, n, before, before = 0 AS is_new, CASE WHEN before > 0 THEN (n - before) / before * 100.0::DOUBLE END AS change_pct FROM c WHERE n > 0""",
    "change_pct",
)
def keyword_trends(t: Tables) -> DataFrame:
    """Counts of this stretch against the one before, new ones marked."""
    now = F.col("ts") >= F.lit("2024-01-16").cast("timestamp")
    past = F.when((F.col("user_id") % 7 == 3) & ~now, "past-").otherwise("")
    rows = t.events.select(F.concat(past, "event_type", F.lit("-"), (F.col("user_id") % 40).cast("string")).alias("keyword"), now.alias("now"))
    count = lambda df: df.groupBy("keyword").agg(F.count("*").alias("n"))
    return effects.keyword_trend(count(rows.where("now")), count(rows.where("not now")))


@query(
    """WITH f AS (SELECT 'f' || CAST(n_nationkey AS VARCHAR) AS factor, (n_nationkey * 7919 % 1000) / 1000.0::DOUBLE AS p, n_nationkey FROM nation), r AS (SELECT *, row_number() OVER (ORDER BY p, factor) AS k, count(*) OVER () AS n FROM f)
SELECT factor, p, least(1.0::DOUBLE, min(p * n / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) AS adjusted FROM r""",
    "p adjusted",
)
def adjusted_p_values(t: Tables) -> DataFrame:
    f = t.nation.select(F.concat(F.lit("f"), F.col("n_nationkey").cast("string")).alias("factor"), (F.col("n_nationkey") * 7919 % 1000 / 1000.0).alias("p"))
    return ranking.adjusted_p(f, "p", "factor", "adjusted")


@query(
    """WITH d AS (SELECT 'temp' || CAST(n_nationkey AS VARCHAR) AS factor, CASE n_nationkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence, (n_nationkey * 31 % 17)::DOUBLE AS gain_pct, (n_nationkey * 101 % 89 - 40)::DOUBLE AS amount,
  CASE WHEN n_nationkey % 5 < 2 THEN 'temperature' END AS family FROM nation),
r AS (SELECT *, row_number() OVER (PARTITION BY coalesce(family, 'own:' || factor) ORDER BY (confidence = 'high') DESC, gain_pct DESC, abs(amount) DESC, factor) AS n FROM d)
SELECT factor, confidence, gain_pct, amount FROM r WHERE n = 1""",
    "gain_pct amount",
)
def distinct_external_factors(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    d = t.nation.select(F.concat(F.lit("temp"), k.cast("string")).alias("factor"), F.when(k % 3 == 0, "high").when(k % 3 == 1, "medium").otherwise("low").alias("confidence"), (k * 31 % 17).cast("double").alias("gain_pct"), (k * 101 % 89 - 40).cast("double").alias("amount"), F.when(k % 5 < 2, "temperature").alias("family"))
    return drivers.distinct_factors(d, F.col("family")).select("factor", "confidence", "gain_pct", "amount")
