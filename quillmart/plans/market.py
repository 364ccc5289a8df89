"""Queries over the quarter panel: growth, ranks, trends, structure, diagnosis, anomalies."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmart.functions.columns import quarter_days, quarter_end, quarter_label, quarter_start, shift_quarter
from quillmart.operators import anomaly, checks, panel, ranking
from quillmart.plans.bases import PANEL
from quillmart.plans.registry import query
from quillmart.sources import tables
from quillmart.sources.tables import Tables

WEEK = [f"d{i}" for i in range(7)]
GROWTH = f"""{PANEL}, growth AS (
  SELECT p.*, (p.sales - a.sales) / nullif(a.sales, 0) AS qoq, (p.sales - b.sales) / nullif(b.sales, 0) AS yoy
  FROM panel p LEFT JOIN panel a ON p.district = a.district AND p.industry = a.industry AND a.q = p.q - 1
  LEFT JOIN panel b ON p.district = b.district AND p.industry = b.industry AND b.q = p.q - 4)"""
AVERAGE_RANK = "(rank() OVER (PARTITION BY {by} ORDER BY {v}) + (count(*) OVER (PARTITION BY {by}, {v}) - 1) / 2.0)"


@query(
    f"""WITH {GROWTH}, ranked AS (
  SELECT *, {AVERAGE_RANK.format(by="industry, quarter", v="sales")} / count(sales) OVER (PARTITION BY industry, quarter) AS place FROM growth)
SELECT district, industry, quarter, sales, txns, qoq, yoy, CAST(place AS DOUBLE) AS place
FROM (SELECT *, row_number() OVER (PARTITION BY industry, quarter ORDER BY sales DESC, district) AS n FROM ranked) WHERE n <= 10""",
    "sales qoq yoy place",
)
def panel_leaders(t: Tables) -> DataFrame:
    """The flagship: each industry's ten largest districts of each quarter, with exact-quarter growth and percentile."""
    rows = panel.growth(tables.panel(t)).withColumn("place", ranking.percentile_rank("sales", ["industry", "quarter"]))
    top = ranking.first_of(rows, ["industry", "quarter"], [F.col("sales").desc(), F.col("district")], 10)
    return top.select("district", "industry", "quarter", "sales", "txns", "qoq", "yoy", "place")


@query(f"WITH {PANEL} SELECT * FROM panel WHERE txns >= 10", "sales traffic residents workers " + " ".join(WEEK))
def panel_min_support(t: Tables) -> DataFrame:
    return tables.panel(t).where(F.col("txns") >= 10)


@query(
    f"""WITH {PANEL} SELECT district, industry, quarter, sales,
  CAST(sum(CAST(sales AS DECIMAL(18,4))) OVER (PARTITION BY district, quarter) AS DOUBLE) AS district_sales,
  CAST(sum(CAST(sales AS DECIMAL(18,4))) OVER (PARTITION BY industry, quarter) AS DOUBLE) AS industry_sales FROM panel""",
    "sales district_sales industry_sales",
)
def panel_group_totals(t: Tables) -> DataFrame:
    return panel.with_totals(tables.panel(t)).select("district", "industry", "quarter", "sales", "district_sales", "industry_sales")


@query(
    """SELECT s.s_suppkey, s.s_name, s.s_acctbal, s.s_nationkey, n.n_name, n.n_regionkey, r.r_name
FROM supplier s LEFT JOIN nation n ON s_nationkey = n_nationkey LEFT JOIN region r ON n_regionkey = r_regionkey""",
    "s_acctbal",
)
def dimension_chain(t: Tables) -> DataFrame:
    nation = t.nation.withColumnRenamed("n_nationkey", "s_nationkey")
    region = t.region.withColumnRenamed("r_regionkey", "n_regionkey")
    return panel.merged(t.supplier, [(nation, ["s_nationkey"]), (region, ["n_regionkey"])])


@query(
    f"""WITH {PANEL}, x AS (SELECT *, row_number() OVER (PARTITION BY district, industry ORDER BY q) - 1 AS t FROM panel)
SELECT district, industry, quarter, CAST(t AS INTEGER) AS t,
  -(sales - max(sales) OVER w) / nullif(max(sales) OVER w, 0) AS sales_fall, -(stores - max(stores) OVER w) / nullif(max(stores) OVER w, 0) AS store_fall,
  CASE WHEN t > 0 THEN greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (traffic - lag(traffic) OVER (PARTITION BY district, industry ORDER BY q)) / nullif(lag(traffic) OVER (PARTITION BY district, industry ORDER BY q), 0))) END AS traffic_change,
  ln(1 + stores) AS log_stores
FROM x WINDOW w AS (PARTITION BY district, industry ORDER BY q ROWS UNBOUNDED PRECEDING)""",
    "sales_fall store_fall traffic_change log_stores",
)
def drawdown_history(t: Tables) -> DataFrame:
    rows = panel.history(tables.panel(t))
    return rows.select("district", "industry", "quarter", "t", "sales_fall", "store_fall", "traffic_change", "log_stores")


TREND = """
  {name}_rows AS (SELECT district, industry, row_number() OVER (PARTITION BY district, industry ORDER BY q) AS i, ln(1 + {v}) AS y FROM totals),
  {name} AS (SELECT a.district, a.industry, exp(median((b.y - a.y) / (b.i - a.i))) - 1 AS {name}
    FROM {name}_rows a JOIN {name}_rows b ON a.district = b.district AND a.industry = b.industry AND a.i < b.i GROUP BY 1, 2)"""
TOTALS = """totals AS (SELECT *, CAST(sum(CAST(sales AS DECIMAL(18,4))) OVER (PARTITION BY district, quarter) AS DOUBLE) AS district_sales,
  CAST(sum(CAST(sales AS DECIMAL(18,4))) OVER (PARTITION BY industry, quarter) AS DOUBLE) AS industry_sales FROM panel)"""


@query(
    f"""WITH {PANEL}, {TOTALS}, {TREND.format(name="own_trend", v="sales")}, {TREND.format(name="district_trend", v="district_sales")}, {TREND.format(name="industry_trend", v="industry_sales")},
cells AS (SELECT DISTINCT district, industry FROM panel),
x AS (SELECT district, industry, coalesce(own_trend, 0.0) AS own_trend, coalesce(district_trend, 0.0) AS district_trend, coalesce(industry_trend, 0.0) AS industry_trend
  FROM cells LEFT JOIN own_trend USING (district, industry) LEFT JOIN district_trend USING (district, industry) LEFT JOIN industry_trend USING (district, industry))
SELECT *, own_trend - (district_trend + industry_trend) / 2 AS gap,
  CASE WHEN own_trend >= -0.01 THEN 'not_falling' WHEN district_trend < -0.01 AND industry_trend < -0.01 THEN 'with_district_and_industry'
    WHEN district_trend < -0.01 THEN 'with_district' WHEN industry_trend < -0.01 THEN 'with_industry'
    WHEN own_trend - (district_trend + industry_trend) / 2 < -0.01 THEN 'below_benchmark' ELSE 'no_companion' END AS verdict FROM x""",
    "own_trend district_trend industry_trend gap",
)
def trend_cause(t: Tables) -> DataFrame:
    return panel.cause(tables.panel(t))


DECLINES = """steps AS (
  SELECT district, industry, sales < lag(sales) OVER w AS down, lag(sales) OVER w IS NOT NULL AS step,
    row_number() OVER (PARTITION BY district, industry ORDER BY q DESC) AS back FROM panel WINDOW w AS (PARTITION BY district, industry ORDER BY q)),
declines AS (
  SELECT district, industry, coalesce(avg(CAST(down AS DOUBLE)) FILTER (step), 0.0) AS decline_share,
    CAST(min(back) FILTER (NOT (step AND coalesce(down, false))) - 1 AS BIGINT) AS decline_run FROM steps GROUP BY 1, 2)"""
ENDS = """ends AS (
  SELECT district, industry, arg_min(sales, q) s0, arg_max(sales, q) s1, arg_min(stores, q) n0, arg_max(stores, q) n1, arg_min(sales / nullif(stores, 0), q) p0, arg_max(sales / nullif(stores, 0), q) p1,
    arg_min(txns, q) t0, arg_max(txns, q) t1, arg_min(sales / nullif(txns, 0), q) k0, arg_max(sales / nullif(txns, 0), q) k1,
    arg_min(residents, q) r0, arg_max(residents, q) r1, arg_min(traffic, q) f0, arg_max(traffic, q) f1, arg_min(workers, q) w0, arg_max(workers, q) w1 FROM panel GROUP BY 1, 2),
moves AS (
  SELECT district, industry, (s1 - s0) / nullif(s0, 0) AS sales_change, (n1 - n0) / nullif(n0, 0) AS stores_change, (p1 - p0) / nullif(p0, 0) AS per_store_change, (t1 - t0) / nullif(t0, 0) AS txns_change,
    (k1 - k0) / nullif(k0, 0) AS ticket_change, (r1 - r0) / nullif(r0, 0) AS residents_change, (f1 - f0) / nullif(f0, 0) AS traffic_change, (w1 - w0) / nullif(w0, 0) AS workers_change FROM ends),
structure AS (
  SELECT *, CASE WHEN sales_change IS NULL OR stores_change IS NULL OR per_store_change IS NULL THEN 'unknown'
    WHEN sales_change <= -0.1 AND stores_change <= -0.1 AND per_store_change <= -0.1 THEN 'compound_slump' WHEN sales_change <= -0.1 AND stores_change <= -0.1 THEN 'shrinking'
    WHEN per_store_change <= -0.1 AND stores_change >= 0.1 THEN 'overcrowded' WHEN per_store_change <= -0.1 AND abs(stores_change) < 0.1 THEN 'demand_loss'
    WHEN sales_change > -0.1 AND per_store_change > -0.1 THEN 'normal' ELSE 'watch' END AS state,
  CASE WHEN residents_change IS NULL OR traffic_change IS NULL OR workers_change IS NULL THEN 'unknown'
    WHEN abs(residents_change) > 1e-6 AND residents_change <= -0.05 AND traffic_change <= -0.12 AND workers_change <= -0.15 THEN 'all_round_shrinkage'
    WHEN abs(residents_change) > 1e-6 AND abs(residents_change) < 0.05 AND traffic_change <= -0.12 AND workers_change <= -0.15 THEN 'workers_leave_inflow_falls'
    WHEN abs(traffic_change) < 0.12 AND workers_change <= -0.15 THEN 'workers_fall_early_sign'
    WHEN abs(residents_change) > 1e-6 AND residents_change <= -0.05 AND abs(traffic_change) < 0.12 AND abs(workers_change) < 0.15 THEN 'residents_leave'
    WHEN abs(residents_change) > 1e-6 AND abs(residents_change) < 0.05 AND abs(workers_change) < 0.15 AND traffic_change <= -0.12 THEN 'inflow_falls'
    WHEN abs(residents_change) > 1e-6 AND residents_change <= -0.05 AND traffic_change <= -0.12 AND abs(workers_change) < 0.15 THEN 'district_shrinks'
    ELSE 'unknown' END AS who_left FROM moves)"""
CHANGES = "sales_change stores_change per_store_change txns_change ticket_change residents_change traffic_change workers_change"


@query(f"WITH {PANEL}, {DECLINES} SELECT * FROM declines", "decline_share")
def decline_runs(t: Tables) -> DataFrame:
    return panel.declines(tables.panel(t))


@query(f"WITH {PANEL}, {ENDS} SELECT * FROM structure", CHANGES)
def structure_and_state(t: Tables) -> DataFrame:
    return panel.structure(tables.panel(t))


SEVERITY = f"""{GROWTH}, {DECLINES}, {ENDS},
last AS (SELECT district, industry, max(q) AS q, max(sales) AS peak, arg_max(quarter, sales) AS peak_quarter FROM panel GROUP BY 1, 2),
s0 AS (SELECT g.district, g.industry, g.quarter, g.sales, g.qoq, g.yoy, peak_quarter, decline_share, decline_run, state, (g.sales - peak) / nullif(peak, 0) AS from_peak
  FROM last l JOIN growth g ON l.district = g.district AND l.industry = g.industry AND l.q = g.q JOIN declines d ON d.district = g.district AND d.industry = g.industry
  JOIN structure s ON s.district = g.district AND s.industry = g.industry),
s1 AS (SELECT *, CAST(CASE WHEN qoq <= -0.2 THEN 2 WHEN qoq <= -0.1 THEN 1 ELSE 0 END + CASE WHEN yoy <= -0.2 THEN 2 WHEN yoy <= -0.1 THEN 1 ELSE 0 END
    + CASE WHEN from_peak <= -0.3 THEN 2 WHEN from_peak <= -0.15 THEN 1 ELSE 0 END + CASE WHEN decline_share >= 0.7 THEN 1 ELSE 0 END AS INTEGER) AS points FROM s0),
severity AS (SELECT *, CASE WHEN state IN ('shrinking', 'compound_slump') THEN 'high' WHEN state = 'normal' AND points < 2 THEN 'low' WHEN points >= 5 THEN 'high' WHEN points >= 2 THEN 'medium' ELSE 'low' END AS urgency,
  CASE WHEN state IN ('shrinking', 'compound_slump') THEN 'restructure' WHEN state = 'overcrowded' THEN 'differentiate' WHEN state = 'demand_loss' THEN 'win_back'
    WHEN state = 'normal' AND points < 2 THEN 'extend_strengths' ELSE 'observe' END AS grade FROM s1)"""


@query(f"WITH {SEVERITY} SELECT * FROM severity", "sales qoq yoy decline_share from_peak")
def severity_and_grade(t: Tables) -> DataFrame:
    return panel.severity(tables.panel(t))


@query(
    f"""WITH {SEVERITY} SELECT district, industry, coalesce(qoq, 0.0) AS c0, coalesce(yoy, 0.0) AS c1, coalesce(from_peak, 0.0) AS c2, decline_share AS c3, points / 6.0::DOUBLE AS c4,
  CASE urgency WHEN 'high' THEN 1.0::DOUBLE WHEN 'medium' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS c5 FROM severity""",
    "c0 c1 c2 c3 c4 c5",
)
def context_vectors(t: Tables) -> DataFrame:
    return panel.context(tables.panel(t)).select("district", "industry", *(F.col("context")[i].alias(f"c{i}") for i in range(6)))


@query(
    f"""WITH {PANEL}, w AS (SELECT a.district, a.industry, a.quarter, count(b.district) AS n, median(b.sales) AS m, count(b.district) FILTER (b.district_type = a.district_type) AS n2, median(b.sales) FILTER (b.district_type = a.district_type) AS m2
  FROM panel a LEFT JOIN panel b ON a.industry = b.industry AND a.quarter = b.quarter AND a.district <> b.district GROUP BY 1, 2, 3),
g AS (SELECT district, industry, count(*) AS n_q, max(q) - min(q) + 1 AS span, max(quarter) AS quarter, arg_max(txns, q) AS txns, arg_max(stores, q) AS stores, arg_max(sales, q) AS sales FROM panel GROUP BY 1, 2),
x AS (SELECT g.district, g.industry, n_q, n_q <> span AS gap, txns, stores, sales, CASE WHEN n2 >= 20 THEN n2 ELSE n END AS peers, CASE WHEN n2 >= 20 THEN m2 ELSE m END AS mid FROM g JOIN w USING (district, industry, quarter)),
y AS (SELECT district, industry, list_filter([CASE WHEN txns IS NULL OR stores IS NULL THEN 'missing_counts' END, CASE WHEN n_q < 6 THEN 'short_history' END, CASE WHEN gap THEN 'gaps' END,
  CASE WHEN peers < 20 THEN 'few_peers' END, CASE WHEN mid > 0 AND sales / mid >= 50 THEN 'special_scale' END], lambda v: v IS NOT NULL) AS ws FROM x)
SELECT district, industry, array_to_string(ws, ',') AS warnings, len(ws) = 0 AS usable FROM y"""
)
def quality_warnings(t: Tables) -> DataFrame:
    return panel.warnings(tables.panel(t))


SHARES = f"""{PANEL}, shares AS (SELECT *, {", ".join(f"{d} / nullif({' + '.join(WEEK)}, 0) AS {d}_share" for d in WEEK)} FROM panel)"""


@query(f"""WITH {SHARES} SELECT district, industry, quarter, {", ".join(f"{d}_share" for d in WEEK)} FROM shares""", " ".join(f"{d}_share" for d in WEEK))
def weekday_shares(t: Tables) -> DataFrame:
    return panel.shares(tables.panel(t), WEEK).select("district", "industry", "quarter", *(f"{d}_share" for d in WEEK))


PEERS = f"""{SHARES}, p AS (
  SELECT a.district, a.industry, a.quarter, count(b.district) AS n, count(b.district) FILTER (b.district_type = a.district_type) AS n2,
    {", ".join(f"any_value(a.{d}_share) AS {d}, avg(b.{d}_share) AS {d}_m, stddev_samp(b.{d}_share) AS {d}_s, avg(b.{d}_share) FILTER (b.district_type = a.district_type) AS {d}_m2, stddev_samp(b.{d}_share) FILTER (b.district_type = a.district_type) AS {d}_s2" for d in WEEK)}
  FROM shares a LEFT JOIN shares b ON a.industry = b.industry AND a.quarter = b.quarter AND a.district <> b.district GROUP BY 1, 2, 3),
c AS (SELECT district, industry, quarter, CAST(CASE WHEN n2 >= 20 THEN n2 ELSE n END AS BIGINT) AS peers,
    {", ".join(f"{d}, CASE WHEN n2 >= 20 THEN {d}_m2 ELSE {d}_m END AS {d}_m, CASE WHEN n2 >= 20 THEN {d}_s2 ELSE {d}_s END AS {d}_s" for d in WEEK)} FROM p),
scores AS (SELECT district, industry, quarter, peers, {", ".join(f"CASE WHEN {d} IS NOT NULL AND NOT ({d}_s < 1e-4 OR ({d}_m <> 0 AND {d}_s / nullif({d}_m, 0) < 0.01)) THEN ({d} - {d}_m) / nullif({d}_s, 0) END AS {d}_share_z" for d in WEEK)} FROM c)"""


@query(f"WITH {PEERS} SELECT * FROM scores", " ".join(f"{d}_share_z" for d in WEEK))
def peer_scores(t: Tables) -> DataFrame:
    """z among the other districts of the industry and quarter, of the same type where that has twenty of them."""
    rows = panel.shares(tables.panel(t), WEEK)
    z = ranking.peer_z(rows, [f"{d}_share" for d in WEEK], ["industry", "quarter"], ["industry", "quarter", "district_type"], 20)
    return z.select("district", "industry", "quarter", "peers", *(f"{d}_share_z" for d in WEEK))


@query(
    f"""WITH {PEERS}, parts AS ({" UNION ALL ".join(f"SELECT district, industry, quarter, peers, '{d}' AS part, {d}_share_z AS z FROM scores WHERE {d}_share_z IS NOT NULL" for d in WEEK)}),
r AS (SELECT *, row_number() OVER (w ORDER BY z DESC, part) AS up, row_number() OVER (w ORDER BY z, part DESC) AS down, row_number() OVER (w ORDER BY abs(z) DESC, part DESC) AS size FROM parts WINDOW w AS (PARTITION BY district, industry, quarter))
SELECT district, industry, quarter, 'weekday' AS axis, any_value(peers) AS peers, coalesce(string_agg(part, ',' ORDER BY up) FILTER (up <= 3 AND z >= 1), '') AS strong,
  coalesce(string_agg(part, ',' ORDER BY down) FILTER (down <= 3 AND z <= -1), '') AS weak, avg(abs(z)) AS intensity, max(part) FILTER (size = 1) AS largest FROM r GROUP BY 1, 2, 3""",
    "intensity",
)
def axis_strengths(t: Tables) -> DataFrame:
    return panel.axis_strengths(tables.panel(t), WEEK, "weekday")


@query(
    f"""WITH {PANEL} SELECT district, industry, quarter, CASE {" ".join(f"WHEN {d} = greatest({', '.join(WEEK)}) THEN '{d}'" for d in WEEK)} END AS part FROM panel"""
)
def peak_weekday(t: Tables) -> DataFrame:
    return tables.panel(t).select("district", "industry", "quarter", panel.peak_part(tables.panel(t), WEEK).alias("part"))


@query(
    f"""WITH {PANEL}, m AS (SELECT a.district, a.industry, a.quarter, a.sales, median(b.sales) AS med, count(*) AS n, count(*) FILTER (b.sales <= a.sales) AS upto
  FROM panel a JOIN panel b ON a.industry = b.industry AND a.quarter = b.quarter AND a.district <> b.district GROUP BY ALL),
d AS (SELECT m.district, m.industry, m.quarter, m.sales, med, m.n, upto, median(abs(b.sales - med)) AS mad FROM m JOIN panel b ON m.industry = b.industry AND m.quarter = b.quarter AND m.district <> b.district GROUP BY ALL)
SELECT industry, quarter, district, sales, CASE WHEN mad > 1e-9 THEN greatest(-10.0::DOUBLE, least(10.0::DOUBLE, 0.6745 * (sales - med) / mad)) ELSE 0.0::DOUBLE END AS robust_z, upto / n * 100.0::DOUBLE AS percentile FROM d WHERE n >= 20""",
    "sales robust_z percentile",
)
def robust_scores(t: Tables) -> DataFrame:
    return ranking.robust_z(tables.panel(t), "sales", ["industry", "quarter"], "district", 20)


@query(
    f"""WITH {PANEL} SELECT district, industry, quarter,
  CAST(rank() OVER (PARTITION BY industry, quarter ORDER BY stores) + (count(*) OVER (PARTITION BY industry, quarter, stores) - 1) / 2.0 AS DOUBLE) AS average_rank,
  CAST(rank() OVER (PARTITION BY industry, quarter ORDER BY stores DESC) AS INTEGER) AS strict_rank,
  ((rank() OVER (PARTITION BY industry, quarter ORDER BY stores) - 1) + count(*) OVER (PARTITION BY industry, quarter ORDER BY stores RANGE UNBOUNDED PRECEDING)) / 2.0::DOUBLE / count(*) OVER (PARTITION BY industry, quarter) * 100 AS mid_percentile
FROM panel""",
    "average_rank mid_percentile",
)
def rank_variants(t: Tables) -> DataFrame:
    by = ["industry", "quarter"]
    return tables.panel(t).select("district", *by, ranking.average_rank("stores", by).alias("average_rank"), ranking.strict_rank("stores", by).alias("strict_rank"), ranking.mid_percentile("stores", by).alias("mid_percentile"))


@query(
    """SELECT o_orderkey, CAST(rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 AS DOUBLE) AS rank,
  CAST((rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0) / count(*) OVER () AS DOUBLE) AS share FROM orders""",
    "rank share",
)
def global_ranks(t: Tables) -> DataFrame:
    """Ranks among all rows of a table, over ranges of distinct values."""
    rows = ranking.global_ranks(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice")
    return rows.select("o_orderkey", "rank", (F.col("rank") / F.col("total")).alias("share"))


@query(
    f"""WITH {PANEL}, cells AS (SELECT district, industry, sum(stores) / 1.0::DOUBLE AS v FROM panel GROUP BY 1, 2), e AS (SELECT list_distinct(quantile_cont(v, [0.2, 0.4, 0.6, 0.8])) AS es, min(v) AS lo, max(v) AS hi FROM cells)
SELECT district, industry, v, CAST(1 + len(list_filter(es, lambda x: x > lo AND x < hi AND v > x)) AS INTEGER) AS bucket FROM cells, e""",
    "v",
)
def quantile_buckets(t: Tables) -> DataFrame:
    cells = tables.panel(t).groupBy("district", "industry").agg((F.sum("stores") / 1.0).alias("v"))
    return ranking.quantile_bucket(cells, "v", 5, "bucket")


@query("SELECT * FROM (SELECT unnest([0.0, 0.01, 0.25, 0.5, 0.9, 1.0])::DOUBLE AS p, unnest((SELECT quantile_cont(l_extendedprice, [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]) FROM lineitem)) AS value)", "value")
def exact_quantiles(t: Tables) -> DataFrame:
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    found = ranking.quantiles(t.lineitem, "l_extendedprice", probs)
    return t.spark.createDataFrame(list(zip(probs, found, strict=True)), "p double, value double")


@query(
    f"""WITH {PANEL} SELECT p.district, p.industry, p.quarter, p.sales, a.m AS type_median, b.m AS city_median FROM panel p
JOIN (SELECT industry, district_type, quarter, median(sales) AS m FROM panel GROUP BY 1, 2, 3) a USING (industry, district_type, quarter)
JOIN (SELECT industry, quarter, median(sales) AS m FROM panel GROUP BY 1, 2) b USING (industry, quarter)""",
    "sales type_median city_median",
)
def scope_medians(t: Tables) -> DataFrame:
    return panel.compared(tables.panel(t), "sales", {"type": ["industry", "district_type"], "city": ["industry"]})


@query(
    f"""WITH {PANEL}, {TOTALS} , f AS (SELECT p.district, p.industry, p.quarter, ln(1 + p.sales) AS log_sales, ln(1 + p.sales / nullif(p.stores, 0)) AS log_sales_per_store, ln(1 + p.sales / nullif(p.txns, 0)) AS log_sales_per_txn,
  p.sales / nullif(p.district_sales, 0) AS district_share, p.sales / nullif(p.industry_sales, 0) AS industry_share,
  CASE WHEN a.sales <> 0 THEN greatest(-3.0::DOUBLE, least(3.0::DOUBLE, (p.sales - a.sales) / a.sales)) END AS sales_qoq, CASE WHEN b.sales <> 0 THEN greatest(-3.0::DOUBLE, least(3.0::DOUBLE, (p.sales - b.sales) / b.sales)) END AS sales_yoy
  FROM totals p LEFT JOIN panel a ON p.district = a.district AND p.industry = a.industry AND a.q = p.q - 1 LEFT JOIN panel b ON p.district = b.district AND p.industry = b.industry AND b.q = p.q - 4),
b AS (SELECT quantile_cont(sales_qoq, [0.01, 0.5, 0.99]) AS q, quantile_cont(sales_yoy, [0.01, 0.5, 0.99]) AS y, quantile_cont(log_sales, [0.01, 0.5, 0.99]) AS s FROM f),
x AS (SELECT f.*, coalesce(sales_qoq, q[2]) NOT BETWEEN q[1] AND q[3] AS e1, coalesce(sales_yoy, y[2]) NOT BETWEEN y[1] AND y[3] AS e2, log_sales NOT BETWEEN s[1] AND s[3] AS e3 FROM f, b)
SELECT district, industry, quarter, log_sales, log_sales_per_store, log_sales_per_txn, district_share, industry_share, sales_qoq, sales_yoy, CAST(e1::INT + e2::INT + e3::INT AS INTEGER) AS extremes, e1::INT + e2::INT + e3::INT >= 2 OR e1 OR e2 AS anomaly FROM x""",
    "log_sales log_sales_per_store log_sales_per_txn district_share industry_share sales_qoq sales_yoy",
)
def extreme_changes(t: Tables) -> DataFrame:
    features = panel.anomaly_features(tables.panel(t))
    kept = ["log_sales", "log_sales_per_store", "log_sales_per_txn", "district_share", "industry_share", "sales_qoq", "sales_yoy"]
    return panel.extremes(features, ["sales_qoq", "sales_yoy", "log_sales"]).select("district", "industry", "quarter", *kept, "extremes", "anomaly")


@query(
    f"""WITH {PANEL}, d AS (SELECT district, q, CAST(sum(CAST(sales AS DECIMAL(18,4))) AS DOUBLE) AS sales FROM panel GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY district ORDER BY q DESC) AS n FROM d)
SELECT district, (max(sales) FILTER (n = 1) - max(sales) FILTER (n = 2)) / nullif(max(sales) FILTER (n = 2), 0) AS growth, max(sales) FILTER (n = 1) AS latest FROM r WHERE n <= 2 GROUP BY district""",
    "growth latest",
)
def district_growth(t: Tables) -> DataFrame:
    """Growth between the last two observed quarters, and the latest value."""
    from quillmart.functions.columns import exact_sum

    d = tables.panel(t).groupBy("district", "q").agg(exact_sum("sales").alias("sales"))
    return panel.observed_growth(d, ["district"], "sales", "q").join(panel.latest(d, ["district"], "q", ["sales"]).withColumnRenamed("sales", "latest"), "district")


@query(
    f"""WITH {PANEL}, base AS (SELECT district, industry, quarter, sales, 'base' AS origin FROM panel), new AS (SELECT district, industry, CASE WHEN district % 3 = 0 THEN quarter ELSE quarter + 100 END AS quarter, sales * 2 AS sales, 'new' AS origin FROM panel)
SELECT * FROM base b WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.district = b.district AND n.industry = b.industry AND n.quarter = b.quarter) UNION ALL SELECT * FROM new""",
    "sales",
)
def panel_upsert(t: Tables) -> DataFrame:
    """New rows replace those of the same key."""
    rows = tables.panel(t).select("district", "industry", "quarter", "sales")
    base = rows.withColumn("origin", F.lit("base"))
    # a third of the new rows have keys that exist, the others stand ten years later
    quarter = F.when(F.col("district") % 3 == 0, F.col("quarter")).otherwise(F.col("quarter") + 100)
    new = rows.withColumns({"quarter": quarter, "sales": F.col("sales") * 2, "origin": F.lit("new")})
    return checks.upsert(base, new, ["district", "industry", "quarter"])


@query(
    f"""WITH {PANEL}, d AS (SELECT DISTINCT quarter, q FROM panel)
SELECT quarter, CAST((q - 1) // 4 * 10 + (q - 1) % 4 + 1 AS INTEGER) AS before, CAST((q - 4) // 4 * 10 + (q - 4) % 4 + 1 AS INTEGER) AS year_before,
  make_date(CAST(q // 4 AS INTEGER), CAST(q % 4 * 3 + 1 AS INTEGER), 1) AS first_day, CAST(make_date(CAST(q // 4 AS INTEGER), CAST(q % 4 * 3 + 1 AS INTEGER), 1) + INTERVAL 3 MONTH AS DATE) - 1 AS last_day,
  CAST(date_diff('day', make_date(CAST(q // 4 AS INTEGER), CAST(q % 4 * 3 + 1 AS INTEGER), 1), CAST(make_date(CAST(q // 4 AS INTEGER), CAST(q % 4 * 3 + 1 AS INTEGER), 1) + INTERVAL 3 MONTH AS DATE)) AS INTEGER) AS days,
  CAST(quarter // 10 AS VARCHAR) || ' Q' || CAST(quarter % 10 AS VARCHAR) AS label FROM d"""
)
def quarter_arithmetic(t: Tables) -> DataFrame:
    q = F.col("quarter")
    return tables.panel(t).select("quarter").distinct().select(
        "quarter", shift_quarter(q, -1).alias("before"), shift_quarter(q, -4).alias("year_before"), quarter_start(q).alias("first_day"), quarter_end(q).alias("last_day"), quarter_days(q).alias("days"), quarter_label(q).alias("label")
    )


@query(
    f"""WITH {PANEL}, w AS (SELECT quarter, min(residents) AS lo, max(residents) AS hi, avg(residents) AS mean, CAST(count(DISTINCT district) AS BIGINT) AS districts, CAST(count(*) FILTER (residents < 0) AS BIGINT) AS negative FROM panel GROUP BY quarter) SELECT * FROM w""",
    "lo hi mean",
)
def quarter_audit(t: Tables) -> DataFrame:
    return tables.panel(t).groupBy("quarter").agg(F.min("residents").alias("lo"), F.max("residents").alias("hi"), F.avg("residents").alias("mean"), F.count_distinct("district").alias("districts"), F.count(F.when(F.col("residents") < 0, 1)).alias("negative"))


@query()
def odd_cells(t: Tables) -> DataFrame:
    """Isolation-forest scores of change features, checked by the tests on planted outliers."""
    features = panel.anomaly_features(tables.panel(t))
    rows = anomaly.anomalies(features, ["sales_qoq", "sales_yoy", "stores_qoq", "traffic_qoq"], trees=100)
    return rows.select("district", "industry", "quarter", "score", "extremes", "odd")


@query(
    f"""WITH {SHARES}, e AS (SELECT district, industry, {", ".join(f"arg_min({c}, q) AS {c}_0, arg_max({c}, q) AS {c}_1" for c in ("sales", "txns"))}, {", ".join(f"first({d}_share ORDER BY q) AS {d}_0, last({d}_share ORDER BY q) AS {d}_1" for d in WEEK)} FROM shares GROUP BY 1, 2)
SELECT district, industry, {", ".join(f"({c}_1 - {c}_0) / nullif({c}_0, 0) AS {c}_change" for c in ("sales", "txns"))}, {", ".join(f"({d}_1 - {d}_0) * 100 AS {d}_share_points" for d in WEEK)} FROM e""",
    "sales_change txns_change " + " ".join(f"{d}_share_points" for d in WEEK),
)
def structure_moves(t: Tables) -> DataFrame:
    """First quarter against last: amounts by relative change, shares by percentage points."""
    return panel.moves(panel.shares(tables.panel(t), WEEK), ["sales", "txns"], [f"{d}_share" for d in WEEK])


@query(f"WITH {PANEL} SELECT district, industry, CAST(count(*) FILTER (quarter <= 19964) AS BIGINT) AS n, CASE WHEN NOT bool_or(quarter = 19964) THEN 'quarter_missing' END AS error FROM panel GROUP BY 1, 2")
def as_of_errors(t: Tables) -> DataFrame:
    """The history of every cell as of a quarter, or the error that it doesn't have that quarter."""
    return panel.as_of_ledger(tables.panel(t), 19964)


@query(
    f"""WITH {PANEL}, moved AS (SELECT * REPLACE (CASE WHEN quarter = 19964 AND district % 3 = 0 THEN sales * 1.1 ELSE sales END AS sales) FROM panel)
SELECT district, industry, quarter, sales, CAST(sum(CAST(sales AS DECIMAL(18,4))) OVER (PARTITION BY district, quarter) AS DOUBLE) AS district_sales,
  CAST(sum(CAST(sales AS DECIMAL(18,4))) OVER (PARTITION BY industry, quarter) AS DOUBLE) AS industry_sales FROM moved""",
    "sales district_sales industry_sales",
    digits=3,
)
def what_if_totals(t: Tables) -> DataFrame:
    """A tenth more in one quarter in some districts: their sales, and what their districts and industries then sell."""
    more = F.when((F.col("quarter") == 19964) & (F.col("district") % 3 == 0), F.col("sales") * 0.1)
    return panel.what_if(tables.panel(t), more).select("district", "industry", "quarter", "sales", "district_sales", "industry_sales")


@query(
    """WITH recs AS (SELECT o_custkey AS report, 'm' || CAST(o_orderkey % 5 AS VARCHAR) AS measure, CAST(o_orderkey % 8 AS INTEGER) AS problem, 'e' || CAST(CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE o_orderkey % 8 END AS VARCHAR) AS evidence,
    CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS score FROM orders),
problems AS (SELECT c_custkey AS report, k AS problem, 'e' || CAST(k AS VARCHAR) AS evidence, k * 0.02::DOUBLE AS share FROM customer, (SELECT CAST(unnest(range(7)) AS INTEGER) AS k)),
n AS (SELECT report, measure, count(*) AS n FROM recs GROUP BY 1, 2)
SELECT r.report, r.measure, r.problem, r.evidence, r.score, array_to_string(list_filter([CASE WHEN p.report IS NULL THEN 'dangling' END, CASE WHEN r.evidence IS DISTINCT FROM p.evidence AND p.report IS NOT NULL THEN 'other_evidence' END,
  CASE WHEN share < 0.03 THEN 'small_share' END, CASE WHEN p.report IS NOT NULL AND r.score IS NULL THEN 'no_score' END, CASE WHEN n > 1 THEN 'repeated' END], lambda x: x IS NOT NULL), ',') AS findings
FROM recs r LEFT JOIN problems p ON r.report = p.report AND r.problem = p.problem JOIN n ON n.report = r.report AND n.measure = r.measure""",
    "score",
)
def recommendation_findings(t: Tables) -> DataFrame:
    """Recommendations held against the problems of the report they belong to."""
    k, name = F.col("o_orderkey"), lambda letter, n: F.concat(F.lit(letter), n.cast("string"))
    recs = t.orders.select(
        F.col("o_custkey").alias("report"), name("m", k % 5).alias("measure"), (k % 8).cast("int").alias("problem"),
        name("e", F.when(k % 9 == 0, F.lit(0)).otherwise(k % 8)).alias("evidence"), F.when(k % 11 != 0, F.col("o_totalprice")).alias("score"),
    )
    of = t.customer.select(F.col("c_custkey").alias("report"), F.explode(F.array(*map(F.lit, range(7)))).alias("problem"))
    problems = of.select("report", "problem", name("e", F.col("problem")).alias("evidence"), (F.col("problem") * 0.02).alias("share"))
    return checks.checked_recommendations(recs, problems, "report")
