"""Drivers, effects, places, books and receipts on small frames, and the invariants they keep."""

import datetime as dt
import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillmart.operators import checks, drivers, effects, expenses, leads, receipts, spatial
from quillmart.operators.checks import InputError
from quillmart.sources import tables

DAY = dt.date(2024, 3, 10)


def test_decompositions_add_up(spark, sf):
    lines = tables.pos(tables.Tables(spark, sf))
    p = drivers.infer_periods(lines)
    s = drivers.summary(lines, p).first()
    assert s.count_effect + s.value_effect == pytest.approx(s.revenue_change)
    e = drivers.price_and_quantity(lines, p).agg(F.sum(F.col("quantity_effect") + F.col("price_effect") + F.col("entry_effect")).alias("v")).first()
    assert e.v == pytest.approx(s.revenue_change)
    for r in drivers.contributions(lines, p, ["store", "category"]).groupBy("dimension").agg(F.sum("amount").alias("v")).collect():
        assert r.v == pytest.approx(s.revenue_change)


def test_periods(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1),), (DAY,)], "day date")
    p = drivers.infer_periods(df)
    assert (p.base_start, p.base_end, p.start, p.end) == (dt.date(2024, 2, 20), dt.date(2024, 2, 29), dt.date(2024, 3, 1), DAY)


def test_dayparts(spark):
    df = spark.range(25).select(drivers.daypart(F.col("id")).alias("p"))
    assert [r.p for r in df.collect()] == ["dawn"] * 7 + ["morning"] * 4 + ["lunch"] * 4 + ["afternoon"] * 4 + ["evening"] * 4 + ["night"] * 2


def test_visits_by_hand(spark):
    rows = [(1, "a", True, 23, 10.0, 1), (2, "a", False, 1, 20.0, 2), (3, "b", None, 12, 30.0, 2), (3, None, True, 12, 40.0, 3)]
    df = spark.createDataFrame([(t, c, k, h, b, dt.date(2024, 3, d)) for t, c, k, h, b, d in rows], "transaction int, customer string, coupon boolean, hour int, bill double, day date")
    r = effects.aggregates(df, [], 22, 2).first()
    assert (r.total_sales, r.target_sales, r.visits, r.revisit_rate, r.coupon_rate, r.customers, r.days) == (100.0, 30.0, 3, 50.0, 50.0, 2, 3)


def test_review_score_without_optional_measures(spark):
    schema = "stretch string, rating double, negative_rate double, aspect_negative_rate double, aspect_reviews double, revisit_rate double, sales double, reviews double"
    df = spark.createDataFrame([("before", 4.0, 40.0, 50.0, 100.0, None, 10.0, 100.0), ("after", 4.25, 28.0, 50.0, 80.0, 5.0, None, 120.0)], schema)
    r = effects.review_score(df, "stretch").first()
    assert r.score == pytest.approx((50 * 0.10 + 100 * 0.20 + 0 + 100 * 0.10 + 100 * 0.05) / 0.75)
    assert r.verdict == "partly_effective"


def test_reward(spark):
    cols = [F.lit(x) for x in (1_000_000.0, 1_300_000.0, 200_000.0, 250_000.0, 50_000.0)]
    got = spark.range(1).select(effects.reward(*cols, F.lit(7), F.lit(7)).alias("a"), effects.reward(*cols, F.lit(7), F.lit(8)).alias("b")).first()
    assert got.a == pytest.approx(0.25)
    assert got.b is None


def test_radius_join_against_all_pairs(spark):
    draw = random.Random(3)
    a = [(i, draw.uniform(-5000, 5000), draw.uniform(-5000, 5000)) for i in range(150)] + [(999, None, 1.0)]
    b = [(i, draw.uniform(-5000, 5000), draw.uniform(-5000, 5000)) for i in range(150)]
    got = {(r.a, r.b) for r in spatial.radius_join(spark.createDataFrame(a, "a int, x double, y double"), spark.createDataFrame(b, "b int, x double, y double"), 700.0).collect()}
    assert got == {(i, j) for i, x, y in a[:-1] for j, u, v in b if np.hypot(x - u, y - v) <= 700}
    near = {r.a: r.b for r in spatial.nearest(spark.createDataFrame(a, "a int, x double, y double"), spark.createDataFrame(b, "b int, x double, y double"), "a", "b", 50.0).collect()}
    assert near == {i: min(b, key=lambda p: np.hypot(x - p[1], y - p[2]))[0] for i, x, y in a[:-1]}


def test_no_nested_loop_is_planned(spark):
    a, b = (spark.range(10).select(F.col("id").alias(n), F.col("id").cast("double").alias("x"), F.col("id").cast("double").alias("y")) for n in "ab")
    plan = spatial.radius_join(a, b, 3.0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan
    assert "Cartesian" not in plan


def test_intervals(spark):
    rows = [(1, dt.date(2024, 2, 1), dt.date(2024, 7, 10)), (2, dt.date(2024, 2, 1), None), (3, dt.date(2024, 2, 1), dt.date(2024, 1, 1)), (4, None, None)]
    df = spark.createDataFrame(rows, "k int, start date, end date")
    got = sorted((r.k, r.quarter, r.days) for r in spatial.interval_quarters(df, "start", "end").collect())
    assert got == [(1, 20241, 60), (1, 20242, 91), (1, 20243, 10), (2, 20241, 1), (3, 20241, 1)]


def test_event_details_are_json(spark, sf):
    t = tables.Tables(spark, sf)
    r = spatial.exposure_details(tables.happenings(t), tables.districts(t), "district", 3000.0).first()
    found = json.loads(r.details)
    assert len(found) == r.n
    assert all(set(x) >= {"distance", "start", "end"} for x in found)


def test_budget_and_cost_by_hand(spark):
    r = spark.createDataFrame([(1, DAY, "v", "food", 220.0), (2, DAY, "v", "ads", 10.0)], "receipt long, day date, vendor string, category string, total double")
    b = spark.createDataFrame([("2024-03", "food", 100.0)], "month string, category string, budget double")
    got = {x.category: (x.over, x.over_pct) for x in expenses.over_budget(r, b).collect()}
    assert got == {"food": (120.0, 120.0), "ads": (10.0, None)}
    products = spark.createDataFrame([("latte", 5000.0), ("tea", 4000.0), ("mocha", 5000.0)], "product string, price double")
    recipes = spark.createDataFrame([("latte", "beans", 18.0), ("latte", "milk", 200.0), ("mocha", "cocoa", 5.0)], "product string, item string, amount double")
    prices = spark.createDataFrame([("beans", 20000.0, "kg"), ("milk", 900.0, "L"), ("cocoa", 10.0, "bag")], "item string, unit_price double, unit string")
    got = {x["product"]: (x.cost, x.cost_rate_pct, x.missing) for x in expenses.cost_rates(products, recipes, prices).collect()}
    assert got == {"latte": (pytest.approx(540.0), pytest.approx(10.8), None), "tea": (None, None, "recipe"), "mocha": (None, None, "cocoa")}


def test_report_periods(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 15),), (dt.date(2024, 12, 5),)], "day date")
    assert expenses.report_period(df, "monthly", dt.date(2024, 12, 20)) == (dt.date(2024, 12, 1), dt.date(2024, 12, 5))
    assert expenses.report_period(df, "yearly", DAY) == (dt.date(2024, 1, 15), dt.date(2024, 12, 5))
    assert expenses.report_period(df, "full", DAY) == (dt.date(2024, 1, 15), dt.date(2024, 12, 5))
    assert expenses.report_period(df.limit(0), "full", DAY) is None


def test_trends_skip_thin_items(spark):
    rows = [("a", DAY + dt.timedelta(days=i), 10.0 if i < 14 else 14.0) for i in range(21)] + [("b", DAY + dt.timedelta(days=i), 1.0) for i in range(5)] + [("c", DAY + dt.timedelta(days=i), float(i % 2)) for i in range(21)]
    df = spark.createDataFrame(rows, "item string, day date, value double")
    got = [(r.item, r.change_pct, r.signal) for r in expenses.trend_signals(df).collect()]
    assert got == [("a", pytest.approx(40.0), "surge")]
    assert {r.item: r.reason for r in expenses.excluded_items(df).collect()} == {"b": "few_rows", "c": "low_volume"}


# receipts

BOXES = [("가나 커피", 10, 40, 90, 60), ("상품명", 10, 75, 40, 92), ("아메리카노", 10, 100, 80, 120), ("2", 100, 101, 110, 119), ("9,000", 150, 100, 200, 121), ("치즈 케이크", 10, 130, 90, 150), ("6,500원", 150, 160, 200, 180), ("할인", 10, 190, 40, 210), ("-500", 150, 190, 190, 210), ("합계금액", 10, 230, 60, 250), ("15,000", 150, 230, 200, 250)]


def boxes(spark):
    return spark.createDataFrame([("r1", float(a), float(b), float(c), float(d), t, 0.9) for t, a, b, c, d in BOXES], receipts.BOX)


def test_rows_items_discounts(spark):
    rows = receipts.text_rows(boxes(spark)).cache()
    assert [r.text for r in rows.where("row = 2").orderBy("place").collect()] == ["아메리카노", "2", "9,000"]
    got = [(r.item, r.quantity, r.unit_price, r.total_price) for r in receipts.items(rows).orderBy("row").collect()]
    assert got == [("아메리카노", 2, 4500, 9000), ("치즈 케이크", 1, 6500, 6500)]
    assert [(r.item, r.total_price) for r in receipts.discounts(rows).collect()] == [("할인", -500)]
    heights = spark.createDataFrame([("r1", 400.0)], "image string, height double")
    assert receipts.store_names(boxes(spark), heights).first().name == "가나 커피"


def test_rows_keep_lines_apart(spark):
    """Lines that touch stay apart, words that are a little off stay together, a tall box joins no two lines."""
    draw = np.random.default_rng(4)
    made = [("r", 40.0 * x, 22.0 * y + float(draw.uniform(-3, 3)), 40.0 * x + 30, 22.0 * y + 20.0, f"{y}:{x}", 0.9) for y in range(12) for x in range(5)]
    made.append(("r", 300.0, 0.0, 320.0, 100.0, "tall", 0.9))
    got = receipts.text_rows(spark.createDataFrame(made, receipts.BOX)).where("text <> 'tall'").collect()
    lines = {}
    for r in got:
        lines.setdefault(r.row, []).append((r.place, r.text))
    assert sorted(" ".join(t for _, t in sorted(x)) for x in lines.values()) == sorted(" ".join(f"{y}:{x}" for x in range(5)) for y in range(12))


def test_discounts_and_the_end_of_items(spark):
    rows = [(i, p, t) for i, line in enumerate(["-T 홍길동", "커피 4,000", "행사 할인 △500", "쿠폰 1,000", "회원 10% 할인", "tel 02-123-4567", "(300) 증정", "과세물품가액 3,000", "에누리 -200"]) for p, t in enumerate(line.split(" "))]
    df = spark.createDataFrame([("r", i, p, t) for i, p, t in rows], "image string, row long, place long, text string")
    assert [(r.item, r.total_price) for r in receipts.discounts(df).orderBy("row").collect()] == [("행사 할인", -500), ("쿠폰", -1000), ("증정", -300)]
    assert [r.item for r in receipts.items(df).orderBy("row").collect()] == ["커피", "쿠폰"]  # a coupon's row is both


def test_letters_are_the_same_at_both_ends():
    assert receipts.letters("각나") == "ㄱㅏㄱㄴㅏ_" and receipts.letters("값 A") == "ㄱㅏㅄa"
    assert round(receipts.SequenceMatcher(None, receipts.letters("각나"), receipts.letters("가간")).ratio(), 3) == 0.667
    assert receipts.alike("아메리카노", "물", 0.5) == 0.0 and receipts.alike("커피", "커피", 0.9) == 1.0


def test_heads(spark):
    texts = ["영수증", "2024/03/10 14:05", "123-45-67890", "과세금액", "9,091", "부가세", "909원", "합계금액", "10,000", "카카오페이", "카드"]
    lines = spark.createDataFrame([("r", i, t) for i, t in enumerate(texts)] + [("s", 0, "1,200"), ("s", 1, "3,400"), ("s", 2, "일시불")], "image string, pos int, text string")
    got = {r.image: r for r in receipts.labelled_amounts(lines).collect()}
    assert (got["r"].supply, got["r"].vat, got["r"].total, got["r"].day, got["r"].time, got["r"].business) == (9091, 909, 10000, "2024-03-10", "14:05", "123-45-67890")
    assert (got["s"].total, got["s"].vat) == (3400, None)
    assert {r.image: r.payment for r in receipts.payment(lines).collect()} == {"r": "카카오페이", "s": "카드"}
    checked = receipts.amount_checks(receipts.labelled_amounts(lines), spark.createDataFrame([("r", 2, 5000, 10000)], "image string, quantity int, unit_price long, total_price long"))
    r = checked.where("image = 'r'").first()
    assert (r.positive, r.parts_agree, r.items_agree, r.bad_items) == (True, True, True, 0)
    kinds = spark.createDataFrame([("전자 세금계산서 영수증",), ("그냥",)], "t string").select(receipts.document_type(F.col("t")).alias("k"), receipts.category(F.lit("원두 1kg"), F.col("t")).alias("c")).collect()
    assert [k.k for k in kinds] == ["TAX_INVOICE", "UNKNOWN"]
    assert kinds[0].c == "식재료비"


def test_two_passes_become_one(spark):
    rows = [("r", "a", 0, 0.0, 0.0, 10.0, 10.0, "x", 0.5), ("r", "b", 0, 1.0, 0.0, 11.0, 10.0, "better", 0.9), ("r", "b", 1, 50.0, 50.0, 60.0, 60.0, "own", 0.4)]
    df = spark.createDataFrame(rows, "image string, source string, pos int, x0 double, y0 double, x1 double, y1 double, text string, prob double")
    assert sorted(r.text for r in receipts.merge_passes(df).collect()) == ["better", "own"]


def test_item_pairs_and_metrics(spark):
    schema = "image string, {} int, item string, quantity int, unit_price long, total_price long"
    truth = spark.createDataFrame([("r", 0, "아메리카노", 2, 4500, 9000), ("r", 1, "치즈케이크", 1, 6500, 6500), ("r", 2, "물", 1, 1000, 1000)], schema.format("t"))
    found = spark.createDataFrame([("r", 0, "아메리카노 HOT", 2, 4500, 9000), ("r", 1, "치즈케익", 1, 6000, 6500), ("r", 2, "사과", 1, 1, 1)], schema.format("f"))
    pairs = receipts.item_pairs(truth, found)
    assert sorted((r.t, r.f) for r in pairs.collect()) == [(0, 0), (1, 1)]
    e = receipts.evaluation(truth, found, pairs).first()
    assert (e.matched, e.precision, e.recall, e.unit_price_accuracy, e.total_price_accuracy) == (2, pytest.approx(2 / 3), pytest.approx(2 / 3), 0.5, 1.0)


def test_catalogue(spark):
    items = spark.createDataFrame([("r", 0, "s", "아메리카느", 4500), ("r", 1, "s", "쥬스", 100)], "image string, row int, store string, item string, unit_price long")
    known = spark.createDataFrame([("s", "아메리카노", "아메리카노", 4500), ("s", "카페라떼", "카페라떼", 5000)], "store string, product string, alias string, price long")
    got = receipts.catalogue_matches(items, known).collect()
    assert [(r.row, r["product"]) for r in got] == [(0, "아메리카노")]
    assert got[0].score > 0.85


def test_forecast_by_hand(spark):
    df = spark.createDataFrame(pd.DataFrame({"item": ["a"] * 30 + ["b"], "value": [10.0] * 30 + [np.nan]})).replace(float("nan"), None)
    got = {r.item: (r.quantity, r.low, r.high, round(r.confidence, 2)) for r in expenses.forecast(df, None, 7).collect()}
    assert got == {"a": (70, 59, 81, 0.8), "b": (0, 0, 0, 0.7)}


def test_periods_end_after_they_start():
    day = dt.date(2024, 1, 10)
    with pytest.raises(InputError):
        drivers.Periods(day, day - dt.timedelta(1), day, day)
    with pytest.raises(InputError):
        drivers.Periods(day, day, day, day - dt.timedelta(1))


def test_rows_out_of_order(spark):
    df = spark.createDataFrame([(1, 1, 2, 5, 4), (2, 1, None, 5, 5), (3, 3, 2, 9, 1)], "k int, a int, b int, c int, d int")
    assert {r.k: r.period for r in checks.out_of_order(df, [("a", "b"), ("c", "d")]).collect()} == {1: "c", 3: "a"}


def test_dangling_references(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, ref string")
    assert [r.k for r in checks.dangling(df, "ref", spark.createDataFrame([("x",), ("x",)], "id string"), "id").collect()] == [2]


def test_leads_that_are_handed_on(spark):
    df = spark.createDataFrame([("a", "b", 1.0, None, "L"), (None, "b", 1.0, "M", "L"), ("a", None, 1.0, "M", "L"), ("a", "b", float("nan"), "M", "L"), ("c", "b", 2.0, "M", "L")], "name string, address string, final_score double, middle_class string, large_class string")
    assert sorted((r.name, r.trade) for r in leads.to_records(df).collect()) == [("a", "L"), ("c", "M")]


def test_score_medians(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (4.0, None), (None, None)], "a double, b double")
    assert tuple(leads.score_medians(df, ["a", "b"]).first()) == (2.0, None)
