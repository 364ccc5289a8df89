"""Queries over the simulated decision log, whose truth is known: the log, and what each estimator makes of it."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmart.functions.columns import ratio
from quillmart.operators import policy
from quillmart.plans.bases import PANEL
from quillmart.plans.registry import query
from quillmart.sources import simulated, tables
from quillmart.sources.tables import Tables

#: Rewards rise with x4 and so do the actions believed in: plain means are biased, by about a third of the gain.
WORLD = simulated.World(seed=7, per_cell=2, floor=None, gain=0.1, by_context=True)
KEY = "concat_ws('|', problem, district, industry, treated_quarter, draw, coalesce(_forced, -1))"


def _uniform(purpose: str, seed: int, n: int = 0) -> str:
    return f"((('0x' || substr(md5('{seed}|{purpose}|' || key), {1 + 13 * n}, 13))::BIGINT)::DOUBLE + 0.5::DOUBLE) / {16**13}.0::DOUBLE"


def _normal(purpose: str, seed: int, mean: float, std: float) -> str:
    return f"({mean}::DOUBLE + {std}::DOUBLE * sqrt(-2 * ln({_uniform(purpose, seed)})) * cos(2 * pi() * {_uniform(purpose, seed, 1)}))"


def log_sql(w: simulated.World) -> str:
    """The tables up to ``decided``, the log of ``w``, in DuckDB."""
    arms = "\n  UNION ALL ".join(f"SELECT '{p}' AS problem, {list(a)!r} AS candidates, {list(a.values())!r}::DOUBLE[] AS fx" for p, a in w.effects.items())
    u = lambda purpose, n=0: _uniform(purpose, w.seed, n)
    believed = "floor(x4 * k)" if w.by_context else f"floor({u('believed')} * k)"
    wanted = f"fx[act + 1] + {w.gain}::DOUBLE * (x4 - 0.5) + {_normal('noise', w.seed, 0.0, w.noise)}"
    wanted = wanted if w.floor is None else f"greatest({w.floor}::DOUBLE, {wanted})"
    return f"""{PANEL}, arms AS ({arms}),
quarters AS (SELECT district, industry, quarter AS treated_quarter, sales, lag(quarter) OVER (PARTITION BY district, industry ORDER BY quarter) AS quarter,
  row_number() OVER (PARTITION BY district, industry ORDER BY quarter) AS n FROM panel),
cells AS (SELECT * FROM quarters WHERE n > {simulated.MIN_QUARTERS}),
firsts AS (SELECT *, row_number() OVER (PARTITION BY industry ORDER BY district, quarter) AS f FROM cells),
rows AS (
  SELECT problem, candidates, fx, district, industry, quarter, treated_quarter, sales, unnest(generate_series(0, {w.per_cell - 1})) AS draw, NULL AS _forced FROM cells, arms
  UNION ALL SELECT problem, candidates, fx, district, industry, quarter, treated_quarter, sales, -1, unnest(generate_series(0, len(candidates) - 1)) FROM firsts, arms WHERE f = 1),
keyed AS (SELECT *, {KEY} AS key, len(candidates) AS k FROM rows),
x AS (SELECT *, greatest(-0.6, least(0.6, {_normal("x1", w.seed, 0.0, 0.15)})) AS x1, greatest(-0.6, least(0.6, {_normal("x2", w.seed, 0.0, 0.15)})) AS x2,
  greatest(-0.8, least(0.0, {_normal("x3", w.seed, -0.2, 0.15)})) AS x3, {u("x4")} AS x4, {u("x5")} AS x5, floor({u("x6")} * 3) / 2 AS x6, {u("action")} AS u FROM keyed),
b AS (SELECT *, CASE WHEN _forced IS NULL THEN CAST({believed} AS INTEGER) END AS best FROM x),
c AS (SELECT *, CAST(CASE WHEN _forced IS NOT NULL THEN _forced WHEN u < 1 - {w.epsilon}::DOUBLE THEN best ELSE least(floor((u - (1 - {w.epsilon}::DOUBLE)) / {w.epsilon}::DOUBLE * k), k - 1) END AS INTEGER) AS act,
  CASE WHEN sales > 0 THEN sales ELSE abs({_normal("margin", w.seed, simulated.MARGIN_MEAN, simulated.MARGIN_STD)}) / 0.6 END AS sales_before FROM b),
d AS (SELECT *, {wanted} AS wanted, sales_before * 0.6::DOUBLE AS margin FROM c),
e AS (SELECT *, (margin + wanted * greatest(margin, 1.0) + sales_before * 0.02::DOUBLE) / 0.6::DOUBLE AS sales_after FROM d),
decided AS (SELECT md5('{w.seed}|id|' || key) AS decision_id, problem, district, industry, quarter, treated_quarter,
  CAST(district * 20 + floor({u("store")} * 20) AS BIGINT) AS cluster, x1, x2, x3, x4, x5, x6, candidates[act + 1] AS arm,
  CASE WHEN _forced IS NOT NULL THEN 1.0::DOUBLE / k ELSE {w.epsilon}::DOUBLE / k + CASE WHEN act = best THEN 1 - {w.epsilon}::DOUBLE ELSE 0.0::DOUBLE END END AS propensity, _forced IS NOT NULL AS forced,
  sales_before, sales_after, CAST(floor({u("hour")} * 8760) AS INTEGER) AS hour,
  (sales_after - sales_after * 0.4::DOUBLE - sales_before * 0.02::DOUBLE - (sales_before - sales_before * 0.4::DOUBLE)) / greatest(abs(sales_before - sales_before * 0.4::DOUBLE), 1.0) AS reward FROM e)"""


def truth_sql(w: simulated.World) -> str:
    return "truths AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{a}', {w.expected(p, a)!r}::DOUBLE)" for p, arms in w.effects.items() for a in arms) + ") t(problem, arm, truth))"


PLAIN = simulated.World()


@query(
    f"WITH {log_sql(PLAIN)} SELECT decision_id, problem, district, industry, quarter, treated_quarter, cluster, x1, x2, x3, x4, x5, x6, arm, propensity, forced, ln(sales_before) AS log_before, ln(sales_after) AS log_after, hour, reward FROM decided",
    "x1 x2 x3 x4 x5 x6 propensity reward log_before log_after",
)
def simulated_log(t: Tables) -> DataFrame:
    rows = simulated.log(tables.panel(t), PLAIN).drop("candidates", "probabilities", "cost_before", "cost_after", "campaign_cost", "days")
    return rows.select("*", F.ln("sales_before").alias("log_before"), F.ln("sales_after").alias("log_after")).drop("sales_before", "sales_after")


@query(
    f"""WITH {log_sql(WORLD)}, {truth_sql(WORLD)},
w AS (SELECT t.problem, t.arm, truth, CASE WHEN d.arm = t.arm THEN 1 / propensity ELSE 0 END AS w, CASE WHEN d.arm = t.arm THEN reward END AS own, reward FROM decided d JOIN truths t ON d.problem = t.problem),
s AS (SELECT problem, arm, any_value(truth) AS truth, CAST(count(*) AS BIGINT) AS n, CAST(count(own) AS BIGINT) AS taken, avg(own) AS plain, avg(w * reward) AS ips, sum(w * reward) / sum(w) AS snips,
  sum(w) * sum(w) / sum(w * w) AS ess, sum(w) AS sw, sum(w * w) AS ww, sum(w * w * reward) AS wwr, sum(w * w * reward * reward) AS wwrr FROM w GROUP BY problem, arm),
est AS (SELECT *, sqrt(greatest(0.0, wwrr - 2 * snips * wwr + snips * snips * ww)) / sw AS se FROM s)
SELECT problem, arm, truth, n, taken, plain, ips, snips, ess, se, abs(snips - truth) <= 4 * se AS recovered FROM est""",
    "truth plain ips snips ess se",
)
def simulated_recovery(t: Tables) -> DataFrame:
    """Each action's planted value beside its plain mean and its weighted estimates; the log is read once for all actions."""
    return policy.recovered(simulated.log(tables.panel(t), WORLD), WORLD.truth(t.spark))


FITS = """z AS (SELECT *, CAST(('0x' || substr(md5(CAST(cluster AS VARCHAR)), 1, 8))::BIGINT % 5 AS INTEGER) AS fold FROM decided),
m AS (SELECT problem, arm, fold, count(*) AS n, sum(x4) AS sx, sum(x4 * x4) AS sxx, sum(reward) AS sr, sum(reward * x4) AS sxr FROM z GROUP BY ALL),
whole AS (SELECT problem, arm, sum(n) + 0.1::DOUBLE AS a, sum(sx) AS b, sum(sxx) + 0.1::DOUBLE AS c, sum(sr) AS p, sum(sxr) AS q FROM m GROUP BY ALL),
theta AS (SELECT problem, arm, (c * p - b * q) / (a * c - b * b) AS t0, (a * q - b * p) / (a * c - b * b) AS t1 FROM whole),
folds AS (SELECT w.problem, w.arm, f.fold, a - coalesce(m.n, 0) AS a, b - coalesce(sx, 0) AS b, c - coalesce(sxx, 0) AS c, p - coalesce(sr, 0) AS p, q - coalesce(sxr, 0) AS q
  FROM whole w CROSS JOIN (SELECT unnest(range(5)) AS fold) f LEFT JOIN m ON m.problem = w.problem AND m.arm = w.arm AND m.fold = f.fold),
fitted AS (SELECT problem, arm, fold, (c * p - b * q) / (a * c - b * b) AS t0, (a * q - b * p) / (a * c - b * b) AS t1 FROM folds)"""


@query(
    f"""WITH {log_sql(WORLD)}, {truth_sql(WORLD)}, {FITS},
r AS (SELECT t.problem, t.arm AS target, truth, theta.t0 + theta.t1 * z.x4 AS dm,
  theta.t0 + theta.t1 * z.x4 + CASE WHEN z.arm = t.arm THEN 1 / propensity * (reward - (fitted.t0 + fitted.t1 * z.x4)) ELSE 0 END AS dr
  FROM z JOIN truths t ON z.problem = t.problem JOIN theta ON theta.problem = t.problem AND theta.arm = t.arm JOIN fitted ON fitted.problem = z.problem AND fitted.arm = z.arm AND fitted.fold = z.fold)
SELECT problem, target AS arm, any_value(truth) AS truth, CAST(count(*) AS BIGINT) AS n, avg(dm) AS dm, avg(dr) AS dr, stddev_samp(dr) / sqrt(count(*)) AS se, abs(avg(dr) - any_value(truth)) <= 4 * stddev_samp(dr) / sqrt(count(*)) AS recovered
FROM r GROUP BY problem, target""",
    "truth dm dr se",
)
def simulated_doubly_robust(t: Tables) -> DataFrame:
    """Direct and doubly robust value of every action of every problem, cross-fitted by store, in one pass over the log."""
    return policy.recovered_robustly(simulated.log(tables.panel(t), WORLD), WORLD.truth(t.spark), ["x4"])


@query(
    f"""WITH {log_sql(WORLD)}, g AS (SELECT problem, arm, sum(1) + 1.0 AS a, sum(x4) AS b, sum(x4 * x4) + 1.0 AS c, sum(reward) AS p, sum(reward * x4) AS q FROM decided GROUP BY ALL),
th AS (SELECT *, a * c - b * b AS det FROM g),
s AS (SELECT decision_id, th.arm, (c * p - b * q) / det + (a * q - b * p) / det * x4 AS expected, sqrt(greatest((c - 2 * b * x4 + a * x4 * x4) / det, 0)) AS uncertainty FROM decided d JOIN th ON d.problem = th.problem WHERE d.problem = '고객_회복'),
v AS (SELECT *, expected + uncertainty AS score FROM s),
p AS (SELECT *, exp(score - max(score) OVER (PARTITION BY decision_id)) AS e, row_number() OVER (PARTITION BY decision_id ORDER BY score DESC, arm) AS n FROM v)
SELECT decision_id, arm, expected, uncertainty, score, e / sum(e) OVER (PARTITION BY decision_id) AS propensity, n = 1 AS best FROM p""",
    "expected uncertainty score propensity",
)
def simulated_bandit_scores(t: Tables) -> DataFrame:
    """A linear bandit learned from the log of one problem, scoring each of its decisions' contexts."""
    rows = simulated.log(tables.panel(t), WORLD).where(F.col("problem") == "고객_회복")
    arms = sorted(WORLD.effects["고객_회복"])
    return policy.Bandit.learn(rows, ["x4"], arms).scored(rows, "decision_id", ["x4"])


@query(
    """WITH v AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS b, l_extendedprice * (1 + l_tax - l_discount) AS a, l_extendedprice * 0.4::DOUBLE AS cb,
  CASE WHEN l_linenumber % 5 <> 0 THEN l_extendedprice * 0.4::DOUBLE * (1 - l_discount) END AS ca, CASE WHEN l_linenumber = 2 AND l_quantity > 45 THEN -1.0 ELSE l_quantity END AS k,
  CASE WHEN l_linenumber = 3 THEN 28 ELSE 30 END AS days FROM lineitem),
s AS (SELECT *, CASE WHEN ca IS NULL THEN 'missing' WHEN k < 0 THEN 'invalid' WHEN days <> 30 THEN 'unequal' ELSE 'complete' END AS status FROM v)
SELECT l_orderkey, l_linenumber, status, CASE WHEN status = 'complete' THEN (a - ca - k - (b - cb)) / greatest(abs(b - cb), 1.0) END AS reward, (a - b) / nullif(b, 0) AS lift FROM s""",
    "reward lift",
)
def contribution_rewards(t: Tables) -> DataFrame:
    """The reward by contribution margin with its status beside the plain lift of sales."""
    from quillmart.operators import effects

    price, n = F.col("l_extendedprice"), F.col("l_linenumber")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", price.alias("b"), (price * (1 + F.col("l_tax") - F.col("l_discount"))).alias("a"), (price * 0.4).alias("cb"),
        F.when(n % 5 != 0, price * 0.4 * (1 - F.col("l_discount"))).alias("ca"), F.when((n == 2) & (F.col("l_quantity") > 45), -1.0).otherwise(F.col("l_quantity")).alias("k"), F.when(n == 3, 28).otherwise(30).alias("days"))
    inputs = [F.col(c) for c in ("b", "a", "cb", "ca", "k")] + [F.lit(30), F.col("days")]
    return rows.select("l_orderkey", "l_linenumber", effects.reward_status(*inputs).alias("status"), effects.reward(*inputs).alias("reward"), ratio(F.col("a") - F.col("b"), F.col("b")).alias("lift"))
