"""The input tables, and the domain inputs projected from them.

Each projection is a plain DataFrame with the columns an operator asks for; operators take any DataFrame that has them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmart.functions.columns import exact_sum, quarter_of, serial, shift_quarter


class Tables:
    """The Parquet tables below ``path``, read on first use: ``tables.orders``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")


def panel(t: Tables) -> DataFrame:
    """The quarter panel: one row a (district, industry, quarter).

    ``sales``, ``txns``, ``stores``, ``traffic``, ``residents``, ``workers`` and sales by weekday ``d0`` (Monday) to ``d6``.
    """
    lines = t.lineitem.select("l_suppkey", "l_partkey", "l_quantity", "l_shipdate", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount"))
    where = t.supplier.select("s_suppkey", "s_nationkey").join(t.nation.select("n_nationkey", "n_regionkey"), F.col("s_nationkey") == F.col("n_nationkey"))
    joined = lines.join(where, F.col("l_suppkey") == F.col("s_suppkey")).join(t.part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    keyed = joined.select(
        F.col("s_nationkey").alias("district"), F.col("n_regionkey").alias("district_type"), F.col("p_type").alias("industry"),
        quarter_of(F.col("l_shipdate")).alias("quarter"), F.weekday("l_shipdate").alias("dow"), "l_suppkey", "amount", "l_quantity",
    )
    out = keyed.groupBy("district", "district_type", "industry", "quarter").agg(
        exact_sum("amount").alias("sales"),
        F.count("*").alias("txns"),
        F.count_distinct("l_suppkey").alias("stores"),
        F.sum("l_quantity").alias("traffic"),
        *(F.coalesce(exact_sum(F.when(F.col("dow") == i, F.col("amount"))), F.lit(0.0)).alias(f"d{i}") for i in range(7)),
    )
    q = serial(F.col("quarter"))
    return out.withColumns({
        "q": q,
        "residents": (1000 + (F.col("district") * 37 + q * 53) % 400).cast("double"),
        "workers": (500 + (F.col("district") * 91 + q * 29) % 300).cast("double"),
    })


def pos(t: Tables) -> DataFrame:
    """Point-of-sale lines: transaction, day, hour, store, product, category, channel, customer, coupon, qty, unit_price, bill."""
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    joined = t.lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(
        F.col("l_orderkey").alias("transaction"),
        F.col("o_orderdate").cast("date").alias("day"),
        (F.col("l_orderkey") % 24).cast("int").alias("hour"),
        F.col("l_suppkey").alias("store"),
        F.col("l_partkey").alias("product"),
        F.col("p_type").alias("category"),
        F.col("o_orderpriority").alias("channel"),
        F.col("o_custkey").alias("customer"),
        (F.col("l_discount") > 0.05).alias("coupon"),
        F.col("l_quantity").alias("qty"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        F.col("l_extendedprice").alias("bill"),
    )


def decisions(t: Tables) -> DataFrame:
    """A log of decisions: arm, propensity, reward and a context of three features, clustered by store."""
    o = t.orders.join(t.customer.select("c_custkey", "c_mktsegment", "c_acctbal"), F.col("o_custkey") == F.col("c_custkey"))
    quarter = quarter_of(F.col("o_orderdate"))
    key = F.col("o_orderkey")
    return o.select(
        key.alias("decision_id"),
        F.col("o_orderpriority").alias("arm"),
        F.col("o_custkey").alias("cluster"),
        F.col("c_mktsegment").alias("problem"),
        F.when(key % 13 != 0, (1 + key % 7) / 10.0).alias("propensity"),
        F.when(key % 17 != 0, F.col("o_totalprice") / 100000.0).alias("reward"),
        (F.col("c_acctbal") / 10000.0).alias("x1"),
        (F.quarter("o_orderdate") / 4.0).alias("x2"),
        (F.col("o_custkey") % 10 / 10.0).alias("x3"),
        F.col("o_orderdate").cast("date").alias("day"),
        quarter.alias("quarter"),
        F.when(key % 3 == 0, quarter).when(key % 3 == 1, shift_quarter(quarter, 1)).otherwise(shift_quarter(quarter, 2)).alias("treated_quarter"),
        (key % 11 != 0).alias("eligible"),
    )


def usable_decisions(t: Tables) -> DataFrame:
    """Decisions that off-policy estimators may use."""
    return decisions(t).where(F.col("eligible") & F.col("propensity").isNotNull() & F.col("reward").isNotNull())


def districts(t: Tables) -> DataFrame:
    """District centres in metres and in degrees, with an area."""
    k = F.col("n_nationkey")
    return t.nation.select(
        k.alias("district"), F.col("n_regionkey").alias("district_type"),
        (k * 7919 % 10000).cast("double").alias("x"), (k * 104729 % 10000).cast("double").alias("y"),
        (126.8 + k % 5 * 0.1).alias("lon"), (37.4 + F.floor(k / 5) * 0.05).alias("lat"),
        (1.0e6 * (1 + k)).alias("area"),
    )


def points(t: Tables) -> DataFrame:
    """Customers as points on the same plane."""
    k = F.col("c_custkey")
    return t.customer.select(
        k.alias("point"), F.col("c_mktsegment").alias("category"),
        (k * 7919 % 10000).cast("double").alias("x"), (k * 104729 % 10000).cast("double").alias("y"),
        (126.7 + k * 7919 % 1000 / 1000.0 * 0.6).alias("lon"), (37.35 + k * 104729 % 1000 / 1000.0 * 0.3).alias("lat"),
    )


def happenings(t: Tables) -> DataFrame:
    """Events with a place and a period of days; some have no end, some end before they start."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    start = F.col("o_orderdate").cast("date")
    return t.orders.select(
        k.alias("event"), F.when(k % 2 == 0, "open").otherwise("close").alias("kind"), F.col("o_orderpriority").alias("name"),
        (c * 7919 % 10000).cast("double").alias("x"), (c * 104729 % 10000).cast("double").alias("y"),
        start.alias("start"), F.when(k % 3 != 0, F.date_add(start, (k % 120 - 2).cast("int"))).alias("end"),
    )


def receipts(t: Tables) -> DataFrame:
    """Expense receipts: receipt, day, vendor, category, total."""
    o = t.orders.join(t.customer.select("c_custkey", "c_mktsegment", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select(F.col("o_orderkey").alias("receipt"), F.col("o_orderdate").cast("date").alias("day"), F.col("c_name").alias("vendor"), F.col("c_mktsegment").alias("category"), F.col("o_totalprice").alias("total"))


def receipt_items(t: Tables) -> DataFrame:
    """Items of receipts: receipt, line, item, unit (null for services), unit_price."""
    return t.lineitem.join(t.part.select("p_partkey", "p_name", "p_size"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("receipt"), (F.col("l_linenumber").cast("long") * 1000000 + F.col("l_partkey") * 100 + F.col("l_suppkey") % 100).alias("line"), F.col("p_name").alias("item"),
        F.when(F.col("p_size") % 3 == 0, "kg").when(F.col("p_size") % 3 == 1, "L").alias("unit"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
    )


def searches(t: Tables) -> DataFrame:
    """Daily search counts by item, zero days included for each item's whole span."""
    counts = t.events.groupBy(F.concat_ws("-", "event_type", (F.col("user_id") % 5).cast("string")).alias("item"), F.col("ts").cast("date").alias("day")).agg(F.count("*").cast("double").alias("value"))
    span = counts.groupBy("item").agg(F.min("day").alias("first"), F.max("day").alias("last"))
    days = span.select("item", F.explode(F.sequence("first", "last")).alias("day"))
    return days.join(counts, ["item", "day"], "left").select("item", "day", F.coalesce("value", F.lit(0.0)).alias("value"))


def receipt_lines(t: Tables) -> DataFrame:
    """Printed lines of receipts: image, i (from 1), name, qty, price (whole), off (a discount, null without), split (the name on a line of its own), kind."""
    i = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount"))
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", i.alias("i")).join(t.part.select("p_partkey", "p_type", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    suffix = F.when(F.col("p_size") % 9 == 0, " 원두").when(F.col("p_size") % 5 == 0, " 박스").otherwise("")
    price = F.floor("l_extendedprice").cast("long")
    return rows.select(
        F.col("l_orderkey").alias("receipt"), "i", F.concat("p_type", suffix).alias("name"), F.col("l_quantity").cast("long").alias("qty"), price.alias("price"),
        F.when(F.col("l_discount") >= 0.08, F.floor(price / 20).cast("long")).alias("off"), (F.col("i") % 3 == 0).alias("split"), ((F.col("l_orderkey") + F.col("i")) % 4).alias("kind"),
    )


def receipt_boxes(t: Tables) -> DataFrame:
    """Text boxes as recognition finds them on a printed receipt: image, slot (the printed line), place, x0, y0, x1, y1, text, prob.

    Boxes of a printed line are up to three pixels apart in height; a line is twelve high and twenty from the next.
    """
    lines = receipt_lines(t)
    shown = lambda c: F.format_number(c, 0)
    box = lambda slot, place, x, width, text, when=None: F.when(F.lit(True) if when is None else when, F.struct(slot.cast("long").alias("slot"), F.lit(place).alias("place"), F.lit(float(x)).alias("x0"), F.lit(float(x + width)).alias("x1"), text.alias("text")))
    at = 6 + 3 * (F.col("i") - 1)
    off = F.when(F.col("kind") == 1, F.concat(shown(F.col("off")), F.lit("-"))).when(F.col("kind") == 2, F.concat(F.lit("("), shown(F.col("off")), F.lit(")"))).otherwise(F.concat(F.lit("-"), shown(F.col("off"))))
    has_off = F.col("off").isNotNull()
    printed = lines.select(F.col("receipt"), F.explode(F.array(
        box(F.when(F.col("split"), at).otherwise(at + 1), 0, 10, 120, F.col("name")), box(at + 1, 1, 200, 20, F.col("qty").cast("string")),
        box(at + 1, 2, 300, 60, F.concat(shown(F.col("price")), F.when((F.col("kind") == 0) & (F.col("price") >= 1000), "원").otherwise(""))),
        box(at + 2, 0, 10, 40, F.lit("할인"), has_off), box(at + 2, 1, 300, 50, off, has_off),
    )).alias("b")).where("b is not null")
    total = lines.groupBy("receipt").agg(F.sum("price").alias("total"), F.max("i").alias("n"))
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    heads = total.join(o.select("o_orderkey", "o_orderdate", "r_name"), F.col("receipt") == F.col("o_orderkey"))
    k, vat, end = F.col("receipt"), F.floor(F.col("total") / 11).cast("long"), 6 + 3 * F.col("n")
    day = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" "), F.lpad((k % 24).cast("string"), 2, "0"), F.lit(":"), F.lpad((k % 60).cast("string"), 2, "0"))
    number = F.concat_ws("-", F.lpad((k % 1000).cast("string"), 3, "0"), F.lit("45"), F.lpad((k % 100000).cast("string"), 5, "0"))
    first = lambda n: F.lit(n)
    framed = heads.select("receipt", F.explode(F.array(
        box(first(0), 0, 10, 150, F.concat(F.lit("가게 "), F.col("r_name"))), box(first(1), 0, 100, 60, F.lit("영수증")), box(first(2), 0, 10, 150, day), box(first(3), 0, 10, 100, number),
        box(first(5), 0, 10, 60, F.lit("상품명")), box(end, 0, 10, 80, F.lit("과세금액")), box(end, 1, 300, 60, shown(F.col("total") - vat)), box(end + 1, 0, 10, 60, F.lit("부가세")), box(end + 1, 1, 300, 60, shown(vat)),
        box(end + 2, 0, 10, 80, F.lit("합계금액")), box(end + 2, 1, 300, 60, shown(F.col("total"))), box(end + 3, 0, 10, 80, F.when(k % 3 == 0, "카카오페이").when(k % 3 == 1, "신용카드").otherwise("현금결제")),
    )).alias("b"))
    rows = printed.unionByName(framed).select(k.cast("string").alias("image"), "receipt", "b.*")
    turn = k * 31 + F.col("slot") * 17 + F.col("place") * 7
    height = F.when(F.col("slot") == 0, 16.0).otherwise(12.0)
    top = F.col("slot") * 20.0 + (turn % 7 - 3) * 0.5
    return rows.select("image", "slot", "place", "x0", top.alias("y0"), "x1", (top + height).alias("y1"), "text", (0.5 + turn % 5 / 10.0).alias("prob"), turn.alias("turn"))
