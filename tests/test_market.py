"""Panel, ranking and validation operators on frames whose answers are worked out by hand."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillmart.functions import classify
from quillmart.functions.columns import area_radius, haversine, is_true, quarter_label, serial, shift_quarter, short_address, transverse_mercator
from quillmart.operators import checks, panel, ranking


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).cast("double" if isinstance(v, float) or v is None else "string" if isinstance(v, str) else "int").alias(k) for k, v in values.items()))
    return row.select(column.alias("v")).first()["v"]


def cells(spark, rows):
    """(district, industry, quarter, sales, stores) with what other columns an operator reads."""
    df = spark.createDataFrame([(d, d % 2, i, q, float(s), n) for d, i, q, s, n in rows], "district int, district_type int, industry string, quarter int, sales double, stores long")
    return df.withColumns({"q": serial(F.col("quarter")), "txns": F.lit(10).cast("long"), "traffic": F.lit(100.0), "residents": F.lit(1000.0), "workers": F.lit(500.0)})


@pytest.mark.parametrize(
    ("sales", "stores", "each", "want"),
    [(-0.2, -0.2, -0.2, "compound_slump"), (-0.2, -0.1, 0.0, "shrinking"), (0.0, 0.2, -0.1, "overcrowded"), (-0.15, 0.05, -0.2, "demand_loss"), (0.1, 0.0, 0.1, "normal"), (-0.2, 0.0, 0.0, "watch"), (None, 0.0, 0.0, "unknown")],
)
def test_market_state(spark, sales, stores, each, want):
    assert one(spark, classify.market_state(F.col("a"), F.col("b"), F.col("c")), a=sales, b=stores, c=each) == want


@pytest.mark.parametrize(
    ("home", "out", "work", "want"),
    [(-0.1, -0.2, -0.2, "all_round_shrinkage"), (0.01, -0.2, -0.2, "workers_leave_inflow_falls"), (0.0, 0.0, -0.2, "workers_fall_early_sign"), (0.0, -0.2, None, "unknown"), (0.01, -0.2, None, "inflow_falls"), (-0.1, 0.0, None, "residents_leave"), (-0.1, -0.2, 0.0, "district_shrinks"), (None, 0.0, 0.0, "unknown")],
)
def test_traffic_source(spark, home, out, work, want):
    assert one(spark, classify.traffic_source(F.col("a"), F.col("b"), F.col("c")), a=home, b=out, c=work) == want


@pytest.mark.parametrize(("score", "want"), [(70.0, "effective"), (69.99, "partly_effective"), (40.0, "partly_effective"), (39.99, "not_effective")])
def test_effect_verdict_edges(spark, score, want):
    assert one(spark, classify.effect_verdict(F.col("a")), a=score) == want


@pytest.mark.parametrize(("t", "r", "h", "want"), [(30.0, 80.0, 80.0, 1.05), (25.0, 60.0, 0.0, 1.0), (5.0, 0.0, 0.0, 1.08), (None, None, None, 1.0), (20.0, 0.0, 85.0, 1.03)])
def test_weather_factor(spark, t, r, h, want):
    assert one(spark, classify.weather_factor(F.col("a"), F.col("b"), F.col("c")), a=t, b=r, c=h) == pytest.approx(want)


def test_quarter_codes(spark):
    assert one(spark, shift_quarter(F.col("a"), -1), a=20241) == 20234
    assert one(spark, shift_quarter(F.col("a"), 5), a=20244) == 20261
    assert one(spark, quarter_label(F.col("a")), a=20262) == "2026 Q2"


def test_texts_and_places(spark):
    assert one(spark, short_address(F.col("a"), {"서울특별시": "서울"}), a="서울특별시  마포구 양화로 1 101동 202호") == "서울 마포구 양화로 1"
    assert [one(spark, is_true(F.col("a")), a=x) for x in (" Yes", "1", "no", "TRUE")] == [True, True, False, True]
    assert one(spark, haversine(F.lit(127.0), F.lit(37.5), F.col("a"), F.lit(37.5)), a=127.1) == pytest.approx(8821.6, abs=1)
    assert one(spark, area_radius(F.col("a")), a=np.pi * 4e6) == pytest.approx(2000)
    east, north = transverse_mercator(F.col("a"), F.lit(38.0))
    assert one(spark, east, a=127.0) == pytest.approx(200_000)
    assert one(spark, north, a=127.0) == pytest.approx(500_000)
    # a degree of longitude at 38 degrees north is about 87.8 km
    assert one(spark, east, a=128.0) - 200_000 == pytest.approx(87_836, abs=60)


def test_growth_needs_the_exact_quarter(spark):
    df = cells(spark, [(1, "x", 20241, 100, 1), (1, "x", 20243, 50, 1), (1, "x", 20244, 75, 1), (1, "x", 20251, 120, 1)])
    got = {r.quarter: (r.qoq, r.yoy) for r in panel.growth(df).collect()}
    assert got == {20241: (None, None), 20243: (None, None), 20244: (0.5, None), 20251: (pytest.approx(0.6), pytest.approx(0.2))}


def test_trend_is_the_median_slope(spark):
    df = cells(spark, [(1, "x", 20241 + i, np.expm1(3 + 0.1 * i), 1) for i in range(4)] + [(2, "x", 20241, 5, 1)])
    got = {r.district: r.trend for r in panel.trend(df, panel.CELL, "sales", "q").collect()}
    assert got == {1: pytest.approx(np.expm1(0.1)), 2: 0.0}


def test_declines(spark):
    df = cells(spark, [(1, "x", 20241, 5, 1), (1, "x", 20242, 6, 1), (1, "x", 20243, 4, 1), (1, "x", 20244, 3, 1), (2, "x", 20241, 5, 1)])
    got = {r.district: (r.decline_share, r.decline_run) for r in panel.declines(df).collect()}
    assert got == {1: (pytest.approx(2 / 3), 2), 2: (0.0, 0)}


def test_severity_peak_and_grade(spark):
    df = cells(spark, [(1, "x", 20241, 100, 10), (1, "x", 20242, 120, 10), (1, "x", 20243, 80, 5)])
    r = panel.severity(df).first()
    assert (r.peak_quarter, r.points, r.state, r.urgency, r.grade) == (20242, 4, "shrinking", "high", "restructure")
    assert r.from_peak == pytest.approx(-1 / 3)


def test_as_of_and_warnings(spark):
    df = cells(spark, [(1, "x", 20241, 100, 1), (1, "x", 20243, 80, 1), (2, "x", 20241, 5, 1)])
    assert {(r.district, r.quarter) for r in panel.as_of(df, 20243).collect()} == {(1, 20241), (1, 20243)}
    got = {r.district: (r.warnings, r.usable) for r in panel.warnings(df).collect()}
    assert got == {1: ("short_history,gaps,few_peers", False), 2: ("short_history,few_peers", False)}


def test_ranks_match_pandas(spark):
    values = [5.0, 1.0, 5.0, None, 2.0, 5.0]
    df = spark.createDataFrame([(i, "g", v) for i, v in enumerate(values)], "id int, g string, v double")
    want = pd.Series(values).rank(pct=True)
    got = {r.id: r.p for r in df.select("id", ranking.percentile_rank("v", ["g"]).alias("p")).collect()}
    whole = {r.id: r.p for r in ranking.global_percentile(df, "v", "p").collect()}
    for i, w in enumerate(want):
        assert (got[i] is None and whole[i] is None) if np.isnan(w) else got[i] == whole[i] == pytest.approx(w)


def test_quantiles_match_numpy(spark):
    draw = np.random.default_rng(1)
    values = np.concatenate([draw.normal(size=3000), np.repeat(0.5, 500)])
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    probs = [0.0, 0.001, 0.3, 0.5, 0.97, 1.0]
    assert ranking.quantiles(df, "v", probs) == pytest.approx(list(np.quantile(values, probs)))
    assert ranking.quantiles(df.limit(0), "v", [0.5]) == [None]


def test_robust_z_against_pairs(spark):
    draw = np.random.default_rng(2)
    f = pd.DataFrame({"g": np.repeat(["a", "b"], 40), "k": range(80), "v": draw.integers(0, 12, 80).astype(float)})
    got = {r.k: (r.robust_z, r.percentile) for r in ranking.robust_z(spark.createDataFrame(f), "v", ["g"], "k").collect()}
    assert len(got) == 80
    for r in f.itertuples():
        others = f[(f.g == r.g) & (f.k != r.k)].v
        mad = (others - others.median()).abs().median()
        z = 0.6745 * (r.v - others.median()) / mad if mad > 1e-9 else 0.0
        assert got[r.k] == pytest.approx((float(np.clip(z, -10, 10)), (others <= r.v).mean() * 100))


def test_adjusted_p(spark):
    p = [0.01, 0.04, 0.03, 0.5]
    df = spark.createDataFrame([(str(i), x) for i, x in enumerate(p)], "k string, p double")
    got = [r.q for r in ranking.adjusted_p(df, "p", "k", "q").orderBy("k").collect()]
    assert got == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.5])


def test_ledger_counts_each_row_once(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, -1), (None, -1)], "a int, b int")
    got = {r.reason: r.n for r in checks.ledger(df, [("no_a", F.col("a").isNull()), ("no_b", F.col("b").isNull()), ("low", F.col("b") < 0)]).collect()}
    assert got == {"no_a": 1, "no_b": 1, "low": 1, "ok": 1}


def test_joins_check_their_keys(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    with pytest.raises(checks.InputError, match="repeated key"):
        checks.join_many_to_one(a, a.union(a), ["k"])
    with pytest.raises(checks.InputError, match="missing columns"):
        checks.require_columns(a, ["k", "z"])
    assert checks.join_one_to_one(a, a.withColumn("v", F.lit(1)), ["k"]).count() == 2


def test_upsert_insert_and_anti_join(spark):
    base = spark.createDataFrame([(1, "old"), (2, "old")], "k int, v string")
    new = spark.createDataFrame([(2, "new", 1), (3, "new", 1)], "k int, v string, extra int")
    assert sorted((r.k, r.v, r.extra) for r in checks.upsert(base, new, ["k"]).collect()) == [(1, "old", None), (2, "new", 1), (3, "new", 1)]
    assert sorted((r.k, r.v) for r in checks.insert_ignore(base, new, ["k"]).collect()) == [(1, "old"), (2, "old"), (3, "new")]
    rows = spark.createDataFrame([("a",), ("",), (None,)], "n string")
    left = checks.without_known(rows, spark.createDataFrame([("a",), ("",), (None,)], "m string"), F.col("n"), F.col("m")).collect()
    assert sorted(r.n or "" for r in left) == ["", ""]


def test_days_and_columns(spark):
    df = spark.createDataFrame([("31-12-2024", None), ("2024-02-30", None), ("2024-02-03", None)], "d string, empty string")
    assert [r.x for r in df.select(checks.parse_day(F.col("d")).alias("x")).collect()] == [dt.date(2024, 12, 31), None, dt.date(2024, 2, 3)]
    assert checks.without_null_columns(df).columns == ["d"]


def test_moves_tell_rates_from_amounts(spark):
    df = spark.createDataFrame([(1, "a", 1, 10.0, 0.25), (1, "a", 3, 15.0, 0.10), (2, "a", 1, 0.0, None), (2, "a", 2, 1.0, 0.5)], "district int, industry string, q int, sales double, share double")
    got = {r.district: (r.sales_change, r.share_points) for r in panel.moves(df, ["sales"], ["share"]).collect()}
    assert got[1] == (0.5, pytest.approx(-15.0))
    assert got[2] == (None, None)


def test_missing_quarter_is_an_error_row(spark):
    df = spark.createDataFrame([(1, "a", 20241), (1, "a", 20242), (2, "a", 20241), (2, "a", 20243)], "district int, industry string, quarter int")
    assert {r.district: (r.n, r.error) for r in panel.as_of_ledger(df, 20242).collect()} == {1: (2, None), 2: (1, "quarter_missing")}


def test_what_if_moves_the_totals(spark):
    df = spark.createDataFrame([(1, "a", 1, 10.0), (1, "b", 1, 5.0), (2, "a", 1, 7.0)], "district int, industry string, quarter int, sales double")
    rows = panel.what_if(df, F.when((F.col("district") == 1) & (F.col("industry") == "a"), F.lit(-20.0))).collect()
    assert {(r.district, r.industry): (r.sales, r.district_sales, r.industry_sales) for r in rows} == {(1, "a"): (0.0, 5.0, 7.0), (1, "b"): (5.0, 5.0, 5.0), (2, "a"): (7.0, 7.0, 7.0)}


def test_quantiles_of_several_columns(spark):
    x, y = [float(i * 37 % 101) for i in range(400)], [None if i % 3 else float(i) for i in range(400)]
    df = spark.createDataFrame([(a, b, None) for a, b in zip(x, y, strict=True)], "x double, y double, z double")
    probs = [0.0, 0.01, 0.5, 0.99, 1.0]
    got = ranking.quantiles_of(df, {"x": probs, "y": [0.3], "z": [0.5]}, accuracy=50)
    assert got["x"] == pytest.approx(list(np.quantile(x, probs)))
    assert got["y"] == pytest.approx([np.quantile([v for v in y if v is not None], 0.3)])
    assert got["z"] == [None]


def test_peers_with_null_keys_are_a_group(spark):
    df = spark.createDataFrame([(i, None, "t", float(i)) for i in range(5)], "k int, g string, h string, v double")
    got = {r.k: (r.peers, r.v_z) for r in ranking.peer_z(df, ["v"], ["g"], ["g", "h"], least=3).collect()}
    others = [1.0, 2.0, 3.0, 4.0]
    assert got[0] == (4, pytest.approx((0 - np.mean(others)) / np.std(others, ddof=1)))


def test_slopes_of_short_and_broken_series(spark):
    df = spark.createDataFrame([(1, "a", 1, 3.0), (2, "a", 1, 1.0), (2, "a", 2, None), (2, "a", 4, 7.0)], "district int, industry string, q int, sales double")
    got = {r.district: r.trend for r in panel.trend(df, panel.CELL, "sales", "q").collect()}
    assert got[1] == 0.0
    assert got[2] == pytest.approx(np.exp((np.log(8) - np.log(2)) / 2) - 1)
