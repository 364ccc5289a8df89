"""The quarter panel: merging, growth on exact quarters, drawdown, trends, diagnosis of each cell."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmart.functions import classify
from quillmart.functions.columns import change, ratio
from quillmart.operators import ranking
from quillmart.operators.checks import totals

CELL = ["district", "industry"]
#: Quarters that a diagnosis needs, peers that a comparison needs, the ratio to the peers' median beyond which a cell is special.
MIN_QUARTERS, MIN_PEERS, SPECIAL_RATIO = 6, 20, 50.0


def merged(facts: DataFrame, dimensions: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """Facts left-joined with each dimension on its own keys; a dimension's clashing columns are renamed with its number."""

    def step(df: DataFrame, item: tuple[int, tuple[DataFrame, list[str]]]) -> DataFrame:
        i, (dim, keys) = item
        clash = {c: f"{c}_{i}" for c in dim.columns if c in df.columns and c not in keys}
        return df.join(dim.withColumnsRenamed(clash), keys, "left")

    return reduce(step, enumerate(dimensions, 1), facts)


def with_totals(panel: DataFrame) -> DataFrame:
    """The panel with its district's and its industry's sales of the quarter."""
    return totals(totals(panel, ["district", "quarter"], "sales", "district_sales"), ["industry", "quarter"], "sales", "industry_sales")


def at_lag(value: str, by: list[str], serial: str, k: int) -> Column:
    """The value exactly ``k`` quarters before (after, if negative); null if that quarter isn't there."""
    return F.max(value).over(Window.partitionBy(*by).orderBy(serial).rangeBetween(-k, -k))


def lag_row(value: str, by: list[str], serial: str, k: int = 1) -> Column:
    """The value ``k`` rows before, whatever its quarter."""
    return F.lag(value, k).over(Window.partitionBy(*by).orderBy(serial))


def growth(panel: DataFrame, value: str = "sales", by: list[str] = CELL) -> DataFrame:
    """The panel with ``qoq`` and ``yoy`` on exact quarters."""
    v = F.col(value)
    return panel.withColumns({"qoq": change(at_lag(value, by, "q", 1), v), "yoy": change(at_lag(value, by, "q", 4), v)})


def observed_growth(panel: DataFrame, by: list[str], value: str, serial: str) -> DataFrame:
    """Growth between the last two quarters that were observed; null with fewer than two or on a zero base."""
    last = ranking.first_of(panel.select(*by, serial, value), by, [F.col(serial).desc()], 2, "_n")
    two = last.groupBy(*by).agg(F.max(F.when(F.col("_n") == 1, F.col(value))).alias("_a"), F.max(F.when(F.col("_n") == 2, F.col(value))).alias("_b"))
    return two.select(*by, change(F.col("_b"), F.col("_a")).alias("growth"))


def latest(panel: DataFrame, by: list[str], serial: str, columns: list[str]) -> DataFrame:
    """The values of each group's last row."""
    return panel.groupBy(*by).agg(*(F.max_by(c, serial).alias(c) for c in columns))


def history(panel: DataFrame) -> DataFrame:
    """Per cell and quarter: ordinal ``t``, the fall from the running peak of sales and stores, positional traffic change held to 1."""
    order = Window.partitionBy(*CELL).orderBy("q")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    fall = lambda c: -ratio(F.col(c) - F.max(c).over(upto), F.max(c).over(upto))
    moved = change(F.lag("traffic").over(order), F.col("traffic"))
    return panel.withColumns({
        "t": (F.row_number().over(order) - 1).cast("int"),
        "sales_fall": fall("sales"),
        "store_fall": fall("stores"),
        "traffic_change": F.when(moved.isNotNull(), F.least(F.greatest(moved, F.lit(-1.0)), F.lit(1.0))),
        "log_stores": F.log1p("stores"),
    })


def _slope(series: Column, value: str) -> Column:
    """Theil and Sen's slope of an ordered array of structs: the median over pairs, as a change per step; 0 without a pair."""
    from_each = F.transform(series, lambda x, i: F.transform(F.slice(series, i + 2, F.size(series)), lambda y, j: (y[value] - x[value]) / (j + 1)))
    slopes = F.array_sort(F.filter(F.flatten(from_each), lambda s: s.isNotNull()))
    n = F.size(slopes)
    middle = (F.get(slopes, F.floor((n - 1) / 2).cast("int")) + F.get(slopes, F.floor(n / 2).cast("int"))) / 2
    return F.coalesce(F.expm1(F.when(n > 0, middle)), F.lit(0.0))


def trends(panel: DataFrame, by: list[str], values: dict[str, str], serial: str) -> DataFrame:
    """Each value's slope of log1p over the position in the series, under its name in ``values``; 0 for a single row.

    A series is one array, as long as the quarters are many; pairs are made inside it and all values share one shuffle.
    """
    series = F.sort_array(F.collect_list(F.struct(serial, *(F.log1p(c).alias(name) for name, c in values.items()))))
    return panel.groupBy(*by).agg(series.alias("_series")).select(*by, *(_slope(F.col("_series"), name).alias(name) for name in values))


def trend(panel: DataFrame, by: list[str], value: str, serial: str, out: str = "trend") -> DataFrame:
    """One value's slope; see ``trends``."""
    return trends(panel, by, {out: value}, serial)


def _steps(panel: DataFrame, by: list[str], value: str, serial: str) -> DataFrame:
    """The panel with each row's place ``_i``, whether a value stands before it (``_step``) and whether it is less (``_down``)."""
    order = Window.partitionBy(*by).orderBy(serial)
    before = F.lag(value).over(order)
    return panel.withColumns({"_i": F.row_number().over(order), "_step": before.isNotNull(), "_down": F.col(value) < before})


def _decline_figures() -> list[Column]:
    """decline_share and decline_run of a series of ``_steps``."""
    stays = ~(F.col("_step") & F.coalesce("_down", F.lit(False)))
    return [
        F.coalesce(F.avg(F.when(F.col("_step"), F.col("_down").cast("double"))), F.lit(0.0)).alias("decline_share"),
        (F.count("*") - F.max(F.when(stays, F.col("_i")))).cast("long").alias("decline_run"),
    ]


def declines(panel: DataFrame, by: list[str] = CELL, value: str = "sales", serial: str = "q") -> DataFrame:
    """Per series: ``decline_share`` of steps down, and ``decline_run``, the steps down in a row at its end."""
    return _steps(panel, by, value, serial).groupBy(*by).agg(*_decline_figures())


def _end_values(columns: list[str], serial: str) -> list[Column]:
    return [f(c, serial).alias(f"{c}_{n}") for c in columns for n, f in (("first", F.min_by), ("last", F.max_by))]


def ends(panel: DataFrame, columns: list[str], by: list[str] = CELL, serial: str = "q") -> DataFrame:
    """``<c>_first`` and ``<c>_last`` of each series."""
    return panel.groupBy(*by).agg(*_end_values(columns, serial))


def moved(column: str) -> Column:
    """The relative change of ``<column>_first`` to ``<column>_last``; null on a zero base."""
    return change(F.col(f"{column}_first"), F.col(f"{column}_last"))


def moves(panel: DataFrame, amounts: list[str], rates: list[str], by: list[str] = CELL, serial: str = "q") -> DataFrame:
    """Per series, first against last: ``<amount>_change``, relative and null on a zero base, and ``<rate>_points``, in percentage points."""
    e = ends(panel, [*amounts, *rates], by, serial)
    return e.select(*by, *(moved(c).alias(f"{c}_change") for c in amounts), *(((F.col(f"{c}_last") - F.col(f"{c}_first")) * 100).alias(f"{c}_points") for c in rates))


def _per_unit(panel: DataFrame) -> DataFrame:
    return panel.withColumns({"per_store": ratio(F.col("sales"), F.col("stores")), "ticket": ratio(F.col("sales"), F.col("txns"))})


def structure(panel: DataFrame) -> DataFrame:
    """Per cell: long-run relative changes, market state, who left, transactions against ticket size. Rates are compared by ``moves``."""
    out = moves(_per_unit(panel), ["sales", "stores", "per_store", "txns", "ticket", "residents", "traffic", "workers"], [])
    return out.withColumns({
        "state": classify.market_state(F.col("sales_change"), F.col("stores_change"), F.col("per_store_change")),
        "who_left": classify.traffic_source(F.col("residents_change"), F.col("traffic_change"), F.col("workers_change")),
    })


def severity(panel: DataFrame) -> DataFrame:
    """Per cell, at its last quarter: growth, peak and drawdown, declines, severity points, urgency, and the response they call for.

    Windows and the aggregate all stand on the cell: the panel is shuffled by it once.
    """
    rows = _steps(_per_unit(growth(panel)), CELL, "sales", "q")
    out = rows.groupBy(*CELL).agg(
        *(F.max_by(c, "q").alias(c) for c in ("quarter", "sales", "qoq", "yoy")),
        F.max("sales").alias("_peak"), F.max_by("quarter", F.struct("sales", -F.col("q"))).alias("peak_quarter"),
        *_decline_figures(), *_end_values(parts := ["sales", "stores", "per_store"], "q"),
    )
    out = out.withColumn("state", classify.market_state(*map(moved, parts))).withColumn("from_peak", ratio(F.col("sales") - F.col("_peak"), F.col("_peak")))
    out = out.drop("_peak", *(f"{c}_{n}" for c in parts for n in ("first", "last")))
    out = out.withColumn("points", classify.severity(F.col("qoq"), F.col("yoy"), F.col("from_peak"), F.col("decline_share")))
    return out.withColumns({"urgency": F.when(F.col("state").isin("shrinking", "compound_slump"), "high").when((F.col("state") == "normal") & (F.col("points") < 2), "low").otherwise(classify.urgency(F.col("points"))), "grade": classify.grade(F.col("state"), F.col("points"))})


def cause(panel: DataFrame) -> DataFrame:
    """Per cell: its trend against those of its district and its industry, and the verdict."""
    out = trends(with_totals(panel), CELL, {"own_trend": "sales", "district_trend": "district_sales", "industry_trend": "industry_sales"}, "q")
    base = (F.col("district_trend") + F.col("industry_trend")) / 2
    return out.withColumns({"gap": F.col("own_trend") - base, "verdict": classify.decline_cause(F.col("own_trend"), F.col("district_trend"), F.col("industry_trend"))})


def what_if(panel: DataFrame, change_of: Column) -> DataFrame:
    """The panel with ``change_of`` added to a row's sales where it isn't null, and ``district_sales`` and ``industry_sales`` made of the new figures.

    Features made of the result are those of the changed market. Sales don't fall below 0.
    """
    return with_totals(panel.withColumn("sales", F.greatest(F.col("sales") + F.coalesce(change_of, F.lit(0.0)), F.lit(0.0))))


def as_of(panel: DataFrame, quarter: int, by: list[str] = CELL) -> DataFrame:
    """History up to ``quarter`` of the series that have that quarter."""
    there = panel.where(F.col("quarter") == quarter).select(*by).distinct()
    return panel.where(F.col("quarter") <= quarter).join(there, by, "left_semi")


def as_of_ledger(panel: DataFrame, quarter: int, by: list[str] = CELL) -> DataFrame:
    """Per series: ``n``, its quarters up to ``quarter``, and ``error``, ``quarter_missing`` where it doesn't have that quarter, else null."""
    there = F.coalesce(F.max(F.col("quarter") == quarter), F.lit(False))
    return panel.groupBy(*by).agg(F.count(F.when(F.col("quarter") <= quarter, 1)).alias("n"), F.when(~there, "quarter_missing").alias("error"))


def warnings(panel: DataFrame) -> DataFrame:
    """Per cell: quality warnings at its last quarter, not exclusive, and ``usable`` where there is none."""
    order = Window.partitionBy(*CELL).orderBy("q")
    rows = panel.withColumn("_gap", (F.col("q") - F.lag("q").over(order)) != 1)
    wide = ["industry", "quarter"]
    sizes = rows
    for name, by in (("_wide", wide), ("_narrow", [*wide, "district_type"])):
        sizes = ranking._joined(sizes, rows.groupBy(*by).agg((F.count("*") - 1).alias(name)), by)
    medians = ranking._median_of_others(ranking._median_of_others(sizes, "sales", wide, "_mw"), "sales", [*wide, "district_type"], "_mn")
    near = F.col("_narrow") >= MIN_PEERS
    made = medians.withColumns({"_peers": F.when(near, F.col("_narrow")).otherwise(F.col("_wide")), "_median": F.when(near, F.col("_mn")).otherwise(F.col("_mw"))})
    last = made.groupBy(*CELL).agg(F.count("*").alias("n"), F.coalesce(F.max("_gap"), F.lit(False)).alias("gap"), *(F.max_by(c, "q").alias(c) for c in ("txns", "stores", "sales", "_peers", "_median")))
    checks = [
        (F.col("txns").isNull() | F.col("stores").isNull(), "missing_counts"),
        (F.col("n") < MIN_QUARTERS, "short_history"),
        (F.col("gap"), "gaps"),
        (F.col("_peers") < MIN_PEERS, "few_peers"),
        ((F.col("_median") > 0) & (F.col("sales") / F.nullif(F.col("_median"), F.lit(0.0)) >= SPECIAL_RATIO), "special_scale"),
    ]
    found = F.array_compact(F.array(*(F.when(bad, F.lit(name)) for bad, name in checks)))
    return last.select(*CELL, F.array_join(found, ",").alias("warnings"), (F.size(found) == 0).alias("usable"))


def shares(panel: DataFrame, parts: list[str]) -> DataFrame:
    """The panel with ``<part>_share`` of the row's sum of parts; null where that is 0."""
    whole = reduce(lambda a, b: a + b, (F.coalesce(F.col(c), F.lit(0.0)) for c in parts))
    return panel.withColumns({f"{c}_share": ratio(F.col(c), whole) for c in parts})


def axis_strengths(panel: DataFrame, parts: list[str], axis: str) -> DataFrame:
    """Per cell and quarter: z of each part's share among peers, mean of their sizes, the strongest, up to three strong and weak ones."""
    z = ranking.peer_z(shares(panel, parts), [f"{c}_share" for c in parts], ["industry", "quarter"], ["industry", "quarter", "district_type"], MIN_PEERS)
    each = F.array(*(F.struct(F.col(f"{c}_share_z").alias("z"), F.lit(c).alias("part")) for c in parts))
    known = F.filter(each, lambda x: x["z"].isNotNull())
    down = F.array_sort(known, lambda a, b: F.when(a["z"] > b["z"], -1).when(a["z"] < b["z"], 1).when(a["part"] < b["part"], -1).otherwise(1))
    names = lambda a: F.array_join(F.transform(a, lambda x: x["part"]), ",")
    out = z.select(*CELL, "quarter", "peers", down.alias("_d"))
    return out.select(
        *CELL, "quarter", F.lit(axis).alias("axis"), "peers",
        names(F.filter(F.slice("_d", 1, 3), lambda x: x["z"] >= 1.0)).alias("strong"),
        names(F.filter(F.slice(F.reverse("_d"), 1, 3), lambda x: x["z"] <= -1.0)).alias("weak"),
        (F.aggregate("_d", F.lit(0.0), lambda s, x: s + F.abs(x["z"])) / F.nullif(F.size("_d"), F.lit(0))).alias("intensity"),
        F.array_max(F.transform("_d", lambda x: F.struct(F.abs(x["z"]).alias("z"), x["part"].alias("part"))))["part"].alias("largest"),
    ).where(F.col("intensity").isNotNull())


def peak_part(panel: DataFrame, parts: list[str]) -> Column:
    """The part with the largest value, the first of equal ones."""
    return F.coalesce(*(F.when(F.col(c) == F.greatest(*map(F.col, parts)), F.lit(c)) for c in parts))


def context(panel: DataFrame) -> DataFrame:
    """Six features of each cell for a policy: nulls are neutral."""
    s = severity(panel)
    heat = F.when(F.col("urgency") == "high", 1.0).when(F.col("urgency") == "medium", 0.5).otherwise(0.0)
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return s.select(*CELL, F.array(zero("qoq"), zero("yoy"), zero("from_peak"), zero("decline_share"), zero("points") / 6.0, heat).alias("context"))


def compared(panel: DataFrame, value: str, scopes: dict[str, list[str]]) -> DataFrame:
    """Cell, quarter, its own value, and ``<scope>_median`` over each coarser group of the quarter."""
    out = panel.select(*CELL, "district_type", "quarter", value)
    for name, by in scopes.items():
        out = out.join(ranking.medians(panel, value, [*by, "quarter"], f"{name}_median").drop(f"{name}_median_n"), [*by, "quarter"], "left")
    return out.select(*CELL, "quarter", value, *(f"{n}_median" for n in scopes))


def anomaly_features(panel: DataFrame, min_txns: int = 1) -> DataFrame:
    """Efficiency and change features of each row; changes are on exact quarters and held to 3."""
    rows = with_totals(panel.where(F.col("txns") >= min_txns))
    held = lambda c, k: F.when(change(at_lag(c, CELL, "q", k), F.col(c)).isNotNull(), F.least(F.greatest(change(at_lag(c, CELL, "q", k), F.col(c).cast("double")), F.lit(-3.0)), F.lit(3.0)))
    log = lambda a, b: F.log1p(F.greatest(ratio(F.col(a), F.col(b)), F.lit(0.0)))
    part = lambda b: F.least(F.greatest(ratio(F.col("sales"), F.col(b)), F.lit(0.0)), F.lit(1.0))
    return rows.select(
        *CELL, "quarter", "district_type", "q",
        F.log1p(F.greatest("sales", F.lit(0.0))).alias("log_sales"), log("sales", "stores").alias("log_sales_per_store"), log("sales", "txns").alias("log_sales_per_txn"),
        log("sales", "traffic").alias("log_sales_per_traffic"), part("district_sales").alias("district_share"), part("industry_sales").alias("industry_share"),
        held("sales", 1).alias("sales_qoq"), held("sales", 4).alias("sales_yoy"), held("stores", 1).alias("stores_qoq"), held("traffic", 1).alias("traffic_qoq"),
    )


def extremes(features: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """The rows with ``extremes``, how many features lie outside the columns' quantiles, nulls read as the median; two make an anomaly, or one of growth."""
    out, counts, sales = features, F.lit(0), F.lit(False)
    for c, (lo, mid, hi) in ranking.quantiles_of(features, dict.fromkeys(columns, [low, 0.5, high])).items():
        if mid is None:
            continue
        v = F.coalesce(F.col(c), F.lit(mid))
        outside = (v < lo) | (v > hi)
        counts = counts + outside.cast("int")
        if c in ("sales_qoq", "sales_yoy"):
            sales = sales | outside
    return out.withColumn("extremes", counts.cast("int")).withColumn("anomaly", (F.col("extremes") >= 2) | sales)
