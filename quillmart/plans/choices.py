"""Queries over the decision log: off-policy estimates, bandit scores, gates; regressions and counterfactuals over the panel."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmart.functions.columns import quarter_of, serial
from quillmart.operators import counterfactual, policy, regression, spatial, survival
from quillmart.plans.bases import DECISIONS, DISTRICTS, HAPPENINGS, PANEL
from quillmart.plans.registry import query
from quillmart.sources import tables
from quillmart.sources.tables import Tables

ARMS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
CONTEXT = ["x1", "x2", "x3"]
UNIFORM = {a: 1.0 / len(ARMS) for a in ARMS}
ESS = "coalesce(sum(w) * sum(w) / nullif(sum(w * w), 0), 0.0)"


@query(
    f"""WITH {DECISIONS}, x AS (SELECT problem, (arm = '2-HIGH')::INT / propensity AS w, reward FROM usable)
SELECT problem, CAST(count(*) AS BIGINT) AS n, avg(w * reward) AS ips, sum(w * reward) / nullif(sum(w), 0) AS snips, {ESS} AS ess FROM x GROUP BY problem""",
    "ips snips ess",
)
def importance_estimates(t: Tables) -> DataFrame:
    return policy.importance_estimates(tables.usable_decisions(t), policy.always("2-HIGH"), ["problem"])


@query(
    f"""WITH {DECISIONS}, x AS (SELECT problem, 0.2::DOUBLE / propensity AS w, reward FROM usable)
SELECT problem, CAST(count(*) AS BIGINT) AS n, avg(w * reward) AS ips, sum(w * reward) / nullif(sum(w), 0) AS snips, {ESS} AS ess FROM x GROUP BY problem""",
    "ips snips ess",
)
def uniform_estimates(t: Tables) -> DataFrame:
    return policy.importance_estimates(tables.usable_decisions(t), policy.uniform(ARMS), ["problem"])


@query(f"""WITH {DECISIONS}, a AS (SELECT unnest({ARMS + ["6-NEVER"]!r}) AS arm) SELECT a.arm, CAST(count(u.arm) AS BIGINT) AS n FROM a LEFT JOIN usable u ON a.arm = u.arm GROUP BY a.arm""")
def arm_support(t: Tables) -> DataFrame:
    arms = t.spark.createDataFrame([(a,) for a in [*ARMS, "6-NEVER"]], "arm string")
    return policy.support(tables.usable_decisions(t), arms)


Z = ["1.0::DOUBLE", "x1", "x2", "x3"]


@query(
    f"""WITH {DECISIONS} SELECT arm, CAST(count(*) AS BIGINT) AS n, {", ".join(f"sum({Z[i]} * {Z[j]}) AS a{i}_{j}" for i in range(4) for j in range(i, 4))}, {", ".join(f"sum(reward * {Z[i]}) AS b{i}" for i in range(4))} FROM usable GROUP BY arm""",
    " ".join([f"a{i}_{j}" for i in range(4) for j in range(i, 4)] + [f"b{i}" for i in range(4)]),
    digits=4,
)
def arm_statistics(t: Tables) -> DataFrame:
    """What a linear bandit learns from a log: moments per arm in one pass."""
    return policy.arm_moments(tables.usable_decisions(t), CONTEXT, ["arm"])


@query()
def doubly_robust(t: Tables) -> DataFrame:
    """Direct and doubly robust value of the uniform policy, cross-fitted by store; checked against NumPy by the tests."""
    return policy.estimates(tables.usable_decisions(t), CONTEXT, UNIFORM)


@query()
def action_safety(t: Tables) -> DataFrame:
    return policy.safety(tables.usable_decisions(t), CONTEXT, ARMS, "2-HIGH")


@query(
    f"""WITH {DECISIONS}, x AS (SELECT *, 0.2::DOUBLE / propensity AS w FROM usable), s AS (SELECT min(n) AS least_support FROM (SELECT count(u.arm) AS n FROM (SELECT unnest({ARMS!r}) AS arm) a LEFT JOIN usable u ON a.arm = u.arm GROUP BY a.arm)),
g AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(any_value(least_support) AS BIGINT) AS least_support, {ESS} AS ess, avg((x1 < -10 OR x1 > 10 OR x1 IS NULL)::INT) AS bad_context FROM x, s),
r AS (SELECT *, list_filter([CASE WHEN n < 100 THEN 'rows' END, CASE WHEN least_support < 20 THEN 'support' END, CASE WHEN ess < 10 THEN 'ess' END, CASE WHEN bad_context > 0.05 THEN 'context' END], lambda v: v IS NOT NULL) AS rs FROM g)
SELECT n, least_support, ess, CAST(bad_context AS DOUBLE) AS bad_context, array_to_string(rs, ',') AS reasons, len(rs) = 0 AS active FROM r""",
    "ess bad_context",
)
def activation_gate(t: Tables) -> DataFrame:
    arms = t.spark.createDataFrame([(a,) for a in ARMS], "arm string")
    return policy.activation(tables.usable_decisions(t), CONTEXT, arms)


@query()
def bandit_scores(t: Tables) -> DataFrame:
    """Expected reward, uncertainty, upper bound and softmax propensity of every arm for every customer's context."""
    log = tables.usable_decisions(t)
    model = policy.Bandit.learn(log, CONTEXT, ARMS, weight=F.when(F.col("decision_id") % 10 < 3, 0.3).otherwise(1.0))
    rows = t.customer.select("c_custkey", (F.col("c_acctbal") / 10000).alias("x1"), F.lit(0.5).alias("x2"), (F.col("c_custkey") % 10 / 10).alias("x3"))
    return model.scored(rows, "c_custkey", CONTEXT)


@query(
    """WITH s AS (SELECT c_custkey, 'a' || CAST(k AS VARCHAR) AS arm, CAST((c_custkey * 7919 + k * 104729) % 1000 AS DOUBLE) AS expected FROM customer, (SELECT unnest([0, 1, 2, 3]) AS k)),
r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY expected DESC, arm) AS overall, row_number() OVER (PARTITION BY c_custkey ORDER BY (arm = 'a1'), expected DESC, arm) AS inside FROM s)
SELECT c_custkey, arm, CASE WHEN arm = 'a1' THEN 0.0::DOUBLE WHEN inside = 1 THEN 0.9::DOUBLE + 0.1::DOUBLE / 3 ELSE 0.1::DOUBLE / 3 END AS probability, overall = 1 AS served FROM r""",
    "probability",
)
def epsilon_greedy(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", F.explode(F.array(*map(F.lit, range(4)))).alias("k"))
    scored = rows.select("c_custkey", F.concat(F.lit("a"), F.col("k").cast("string")).alias("arm"), ((F.col("c_custkey") * 7919 + F.col("k") * 104729) % 1000).cast("double").alias("expected"))
    return policy.epsilon_greedy(scored, "c_custkey", 0.1, ["a1"])


@query(
    """WITH s AS (SELECT c_custkey, 'a' || CAST(k AS VARCHAR) AS arm, (c_custkey * 7919 + k * 104729) % 1000 AS x, (c_custkey * 31 + k * 17) % 7 AS y FROM customer, (SELECT unnest([0, 1, 2, 3]) AS k)),
a AS (SELECT c_custkey, arm FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY x DESC, arm) AS n FROM s) WHERE n = 1), b AS (SELECT c_custkey, arm FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY y DESC, arm) AS n FROM s) WHERE n = 1)
SELECT a.c_custkey, a.arm AS first, b.arm AS second, a.arm = b.arm AS agree FROM a JOIN b ON a.c_custkey = b.c_custkey"""
)
def shadow_agreement(t: Tables) -> DataFrame:
    k = F.col("k")
    rows = t.customer.select("c_custkey", F.explode(F.array(*map(F.lit, range(4)))).alias("k")).withColumn("arm", F.concat(F.lit("a"), k.cast("string")))
    return policy.agreement(rows.select("c_custkey", "arm", ((F.col("c_custkey") * 7919 + k * 104729) % 1000).alias("score")), rows.select("c_custkey", "arm", ((F.col("c_custkey") * 31 + k * 17) % 7).alias("score")), "c_custkey")


@query(
    f"""WITH {DECISIONS}, b AS (SELECT problem, count(*) AS n, count(*) FILTER (NOT eligible) AS blocked, date_diff('day', min(day), max(day)) AS days, count(DISTINCT cluster) AS stores FROM decisions GROUP BY problem),
r AS (SELECT unnest(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY']) AS problem, unnest([0.01, 0.5, 0.5, 0.5, 0.5])::DOUBLE AS max_blocked, unnest([10, 10, 10000, 10, 10]) AS min_days, unnest([5, 5, 5, 100000, 5]) AS min_stores)
SELECT b.problem, CASE WHEN blocked / n > max_blocked THEN 'stop' WHEN days < min_days OR stores < min_stores THEN 'wait' ELSE 'continue' END AS action FROM b JOIN r ON b.problem = r.problem"""
)
def experiment_stops(t: Tables) -> DataFrame:
    b = tables.decisions(t).groupBy("problem").agg(F.count("*").alias("n"), F.count(F.when(~F.col("eligible"), 1)).alias("blocked"), F.datediff(F.max("day"), F.min("day")).alias("days"), F.count_distinct("cluster").alias("stores"))
    rules = t.spark.createDataFrame([("AUTOMOBILE", 0.01, 10, 5), ("BUILDING", 0.5, 10, 5), ("FURNITURE", 0.5, 10000, 5), ("HOUSEHOLD", 0.5, 10, 100000), ("MACHINERY", 0.5, 10, 5)], "problem string, max_blocked double, min_days int, min_stores int")
    return policy.stop_rule(b, rules, "problem")


# regression: log sales differences on exposure differences, a dummy a quarter, errors by district


def _differences(t: Tables) -> DataFrame:
    exposures = spatial.exposure(tables.happenings(t), tables.districts(t), "district", 2000.0)
    rows = spatial.filled(tables.panel(t), exposures, ["district", "quarter"], ["exposure"])
    cell = ["district", "industry"]
    d = {f"d_{c}": regression.log_difference(c, cell, "q", c != "exposure") for c in ("sales", "exposure", "stores", "traffic")}
    return rows.withColumns(d).where("d_sales is not null and d_exposure is not null")


DIFFS = f"""{HAPPENINGS}, {DISTRICTS}, {PANEL},
e AS (SELECT district, quarter, sum(days * exp(-sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) / 1000)) AS exposure FROM event_quarters a JOIN districts b ON sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 2000 GROUP BY 1, 2),
f AS (SELECT p.*, coalesce(e.exposure, 0.0) AS exposure FROM panel p LEFT JOIN e ON p.district = e.district AND p.quarter = e.quarter),
d AS (SELECT a.district, a.quarter, ln(1 + a.sales) - ln(1 + b.sales) AS y, ln(1 + a.exposure) - ln(1 + b.exposure) AS x FROM f a JOIN f b ON a.district = b.district AND a.industry = b.industry AND b.q = a.q - 1),
c AS (SELECT district, quarter, y - avg(y) OVER (PARTITION BY quarter) AS y, x - avg(x) OVER (PARTITION BY quarter) AS x FROM d),
fit AS (SELECT sum(x * y) / sum(x * x) AS coef, sum(x * x) AS sxx, count(*) AS n, count(DISTINCT district) AS g, count(DISTINCT quarter) AS k FROM c),
u AS (SELECT district, sum(x * (y - coef * x)) AS s FROM c, fit GROUP BY district)"""


@query(
    f"""WITH {DIFFS} SELECT 'd_exposure' AS name, any_value(coef) AS coef, sqrt(sum(s * s)) / any_value(sxx) * sqrt(any_value(g / (g - 1.0) * (n - 1.0) / (n - k - 1.0))) AS se, CAST(any_value(n) AS BIGINT) AS n, CAST(any_value(g) AS BIGINT) AS clusters FROM u, fit""",
    "coef se",
)
def exposure_regression(t: Tables) -> DataFrame:
    """One regressor with quarter dummies and errors clustered by district: coefficient and standard error hold against SQL."""
    f = regression.fit(_differences(t), "d_sales", ["d_exposure"], "quarter", "district")
    return t.spark.createDataFrame([(n, float(f.coef[i]), float(f.se[i]), f.n, f.clusters) for i, n in enumerate(f.names)], "name string, coef double, se double, n long, clusters long")


@query()
def exposure_verdicts(t: Tables) -> DataFrame:
    """With controls, a placebo of next quarter's exposure, and the sign's stability over left-out quarters."""
    return regression.verdicts(_differences(t), "d_sales", ["d_exposure"], ["d_stores", "d_traffic"], "quarter", "district", ["district", "industry"], "q", min_rows=100)


@query()
def factor_attribution(t: Tables) -> DataFrame:
    """What the factors' moves between the last month and the one before go along with."""
    from quillmart.operators import drivers
    from quillmart.plans.sales import _factored

    days = _factored(t).withColumns({"weekend": (F.weekday("day") >= 5).cast("int"), "weekday": F.weekday("day"), "month": F.month("day")})
    p = drivers.infer_periods(days)
    return regression.period_attribution(days, ["traffic", "weekend"], p.base(), p.current(), ["month"])


# counterfactuals and risk

AS_OF = 20004


@query(
    f"""WITH {PANEL}, t AS (SELECT district AS target, industry, 8003 AS as_of, district_type AS kind FROM panel WHERE quarter = {AS_OF}),
p AS (SELECT t.target, t.industry, t.as_of, p.district AS donor, count(DISTINCT p.q) AS n, any_value(p.district_type = t.kind) AS same FROM t JOIN panel p ON p.industry = t.industry AND p.district <> t.target AND p.q <= t.as_of GROUP BY ALL),
c AS (SELECT *, count(*) FILTER (same) OVER (PARTITION BY target, industry) AS peers FROM p)
SELECT target, industry, as_of, donor FROM c WHERE n >= 6 AND (peers < 20 OR same)"""
)
def donor_pools(t: Tables) -> DataFrame:
    return counterfactual.donor_pool(tables.panel(t), _targets(t))


def _targets(t: Tables) -> DataFrame:
    return tables.panel(t).where(F.col("quarter") == AS_OF).select("district", "industry", F.col("q").alias("as_of"))


SIMILAR = f"""WITH {PANEL}, t AS (SELECT district AS target, industry, 8003 AS as_of, district_type AS kind FROM panel WHERE quarter = {AS_OF}),
p AS (SELECT t.target, t.industry, t.as_of, p.district AS donor, count(DISTINCT p.q) AS n, any_value(p.district_type = t.kind) AS same FROM t JOIN panel p ON p.industry = t.industry AND p.district <> t.target AND p.q <= t.as_of GROUP BY ALL),
c AS (SELECT *, count(*) FILTER (same) OVER (PARTITION BY target, industry) AS peers FROM p WHERE n >= 6),
pool AS (SELECT target, industry, as_of, donor FROM c WHERE peers < 20 OR same),
y AS (SELECT t.target, t.industry, t.as_of, p.q, ln(1 + p.sales) AS y, count(*) OVER (PARTITION BY t.target, t.industry) AS quarters FROM t JOIN panel p ON p.district = t.target AND p.industry = t.industry AND p.q <= t.as_of),
b AS (SELECT y.target, y.industry, y.as_of, pool.donor, y.y, ln(1 + d.sales) AS x, quarters FROM y JOIN pool ON pool.target = y.target AND pool.industry = y.industry JOIN panel d ON d.district = pool.donor AND d.industry = y.industry AND d.q = y.q WHERE quarters >= 6),
r AS (SELECT target, industry, as_of, donor, round_even(CASE WHEN var_pop(x) > 1e-13 AND var_pop(y) > 1e-13 THEN corr(y, x) ELSE -1 END, 9) AS r FROM b GROUP BY target, industry, as_of, donor, quarters HAVING count(*) = quarters)
SELECT target, industry, as_of, donor, r FROM (SELECT *, row_number() OVER (PARTITION BY target, industry ORDER BY r DESC, donor) AS k FROM r) WHERE k <= 10"""


@query(SIMILAR, "r")
def similar_donors(t: Tables) -> DataFrame:
    """Of each cell's pool the ten that moved most like it, from blocked products of series."""
    return counterfactual.similar_donors(tables.panel(t), _targets(t), k=10)


@query()
def synthetic_baselines(t: Tables) -> DataFrame:
    """Next quarter's sales of every cell had nothing changed, from weighted donors."""
    return counterfactual.baseline(tables.panel(t), _targets(t))


@query()
def measured_effects(t: Tables) -> DataFrame:
    panel = tables.panel(t)
    after = panel.where(F.col("q") == 8004).select("district", "industry", F.col("sales").alias("after"))
    found = counterfactual.effects(panel, _targets(t).join(after, ["district", "industry"]))
    return counterfactual.mean_effect(found, F.col("district") == 1)


EVENTS = f"""{PANEL}, h AS (SELECT *, row_number() OVER (PARTITION BY district, industry ORDER BY q) - 1 AS t, -(sales - max(sales) OVER w) / nullif(max(sales) OVER w, 0) AS sales_fall, -(stores - max(stores) OVER w) / nullif(max(stores) OVER w, 0) AS store_fall,
  (traffic - lag(traffic) OVER (PARTITION BY district, industry ORDER BY q)) / nullif(lag(traffic) OVER (PARTITION BY district, industry ORDER BY q), 0) AS moved, ln(1 + stores) AS log_stores, count(*) OVER (PARTITION BY district, industry) AS n FROM panel WINDOW w AS (PARTITION BY district, industry ORDER BY q ROWS UNBOUNDED PRECEDING)),
ev AS (SELECT *, min(CASE WHEN store_fall >= 0.2 THEN t END) OVER (PARTITION BY district, industry) AS ev FROM h),
frame0 AS (SELECT district, industry, t AS start, t + 1 AS stop, coalesce((t = ev)::INT, 0) AS event, sales_fall, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, moved)) AS traffic_change, log_stores FROM ev WHERE n >= 6 AND (ev IS NULL OR t <= ev) AND moved IS NOT NULL AND sales_fall IS NOT NULL),
frame AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY district, industry) AS k FROM frame0) WHERE k >= 2)"""


@query(f"WITH {EVENTS} SELECT district, industry, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop, CAST(event AS INTEGER) AS event, sales_fall, traffic_change, log_stores FROM frame", "sales_fall traffic_change log_stores")
def shrinkage_events(t: Tables) -> DataFrame:
    return survival.event_frame(tables.panel(t))


CELLS = f"""{PANEL}, cells AS (SELECT district, industry, CAST(1 + (district + CAST(count(*) AS INTEGER)) % 2 AS INTEGER) AS bucket, CAST(count(*) - district % 7 AS INTEGER) AS duration, CAST((district * 7 + length(industry)) % 2 AS INTEGER) AS event, ((district * 7919 + length(industry) * 31) % 50)::DOUBLE AS risk FROM panel GROUP BY 1, 2)"""


def _cells(t: Tables) -> DataFrame:
    g = tables.panel(t).groupBy("district", "industry").agg(F.count("*").cast("int").alias("n"))
    d = F.col("district")
    return g.select("district", "industry", (1 + (d + F.col("n")) % 2).cast("int").alias("bucket"), (F.col("n") - d % 7).cast("int").alias("duration"), ((d * 7 + F.length("industry")) % 2).cast("int").alias("event"), ((d * 7919 + F.length("industry") * 31) % 50).cast("double").alias("risk"))


@query(
    f"""WITH {CELLS}, c AS (SELECT bucket, duration, count(*) AS n, sum(event) AS events FROM cells GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY bucket ORDER BY duration DESC) AS at_risk FROM c)
SELECT bucket, duration, CAST(at_risk AS BIGINT) AS at_risk, CAST(events AS BIGINT) AS events, product(1 - events / at_risk) OVER (PARTITION BY bucket ORDER BY duration) AS survival FROM r""",
    "survival",
)
def survival_curves(t: Tables) -> DataFrame:
    return survival.survival_curves(_cells(t))


@query(
    f"""WITH {CELLS}, p AS (SELECT a.risk AS r, b.risk AS s FROM cells a JOIN cells b ON a.event = 1 AND (b.duration > a.duration OR (b.duration = a.duration AND b.event = 0)))
SELECT CAST(count(*) AS BIGINT) AS pairs, avg(CASE WHEN s < r THEN 1.0::DOUBLE WHEN s = r THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS c_index FROM p""",
    "c_index",
)
def concordance(t: Tables) -> DataFrame:
    return survival.concordance(_cells(t))


@query()
def cox_risks(t: Tables) -> DataFrame:
    """Cells with mean partial hazard, event, duration and risk bucket, from a model fitted to the same panel."""
    frame = survival.event_frame(tables.panel(t))
    return survival.risk_position(survival.cells(survival.risk(frame, survival.cox(frame))))


@query("SELECT CAST(o_orderdate AS DATE) AS day, CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS INTEGER) AS q FROM orders")
def quarter_serials(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderdate").cast("date").alias("day"), serial(quarter_of(F.col("o_orderdate"))).alias("q"))
