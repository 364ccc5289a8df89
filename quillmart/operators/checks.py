"""Validation: required columns, duplicates, ledgers of excluded rows, cardinality-checked joins, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmart.functions.columns import exact_sum


class InputError(ValueError):
    """A table doesn't have what an operator needs."""


def require_columns(df: DataFrame, columns: list[str], *, rows: bool = False) -> DataFrame:
    """``df`` itself, or an InputError naming what's missing; with ``rows`` an empty table is an error too."""
    if missing := sorted(set(columns) - set(df.columns)):
        raise InputError(f"missing columns: {missing}")
    if rows and df.isEmpty():
        raise InputError("no rows")
    return df


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    if (row := duplicates(df, keys).first()) is not None:
        raise InputError(f"repeated key {keys}: {row.asDict()}")
    return df


def join_many_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """A join whose right side must have each key once."""
    return left.join(require_unique(right, keys), keys, how)


def join_one_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    return join_many_to_one(require_unique(left, keys), right, keys, how)


def parse_day(text: Column) -> Column:
    """Day-month-year or ISO text; null where neither fits."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("dd-MM-yyyy")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))).cast("date")


def bad_amounts(df: DataFrame, qty: str, price: str, bill: str, tolerance: float = 0.01) -> DataFrame:
    """Rows that aren't positive numbers or whose bill isn't quantity times price."""
    q, p, b = F.col(qty), F.col(price), F.col(bill)
    return df.where(q.isNull() | p.isNull() | b.isNull() | (q <= 0) | (p <= 0) | (b <= 0) | (F.abs(q * p - b) > tolerance))


def first_failure(checks: list[tuple[str, Column]], otherwise: Column | None = None) -> Column:
    """The first reason, in order, whose condition holds; null (or ``otherwise``) for a row that passes all. A null condition doesn't hold."""
    out = F.coalesce(*(F.when(bad, F.lit(reason)) for reason, bad in checks))
    return out if otherwise is None else F.coalesce(out, otherwise)


def ledger(df: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """reason, n: each row counted once under its first failing check; rows that pass have reason ``ok``."""
    return df.select(first_failure(checks, F.lit("ok")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def is_repeat(keys: list[str], order: list[Column]) -> Column:
    """True for all but the first row of a key."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) > 1


def reconciled(lines: DataFrame, daily: DataFrame, pairs: list[tuple[str, Column, Column]]) -> DataFrame:
    """measure, raw, aggregated, agrees: totals computed both ways. Either side is one row."""
    raw = lines.agg(*(a.cast("double").alias(name) for name, a, _ in pairs))
    made = daily.agg(*(b.cast("double").alias(f"{name}_2") for name, _, b in pairs))
    both = raw.join(made)  # one row each
    rows = F.explode(F.array(*(F.struct(F.lit(name).alias("measure"), F.col(name).alias("raw"), F.col(f"{name}_2").alias("aggregated")) for name, _, _ in pairs))).alias("r")
    return both.select(rows).select("r.*", (F.abs(F.col("r.raw") - F.col("r.aggregated")) <= 0.01).alias("agrees"))


def without_known(df: DataFrame, known: DataFrame, key: Column, known_key: Column) -> DataFrame:
    """Rows whose key isn't among the known ones; an empty or null key never matches."""
    keys = known.select(known_key.alias("_known")).where("_known <> ''").distinct()
    return df.withColumn("_key", F.coalesce(key, F.lit(""))).join(keys, F.col("_key") == F.col("_known"), "left_anti").drop("_key")


def upsert(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All new rows and those of ``base`` whose key isn't among them; columns of either side are kept."""
    return base.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_ignore(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` and the new rows whose key it doesn't have."""
    return base.unionByName(new.join(base.select(*keys).distinct(), keys, "left_anti").dropDuplicates(keys), allowMissingColumns=True)


def without_null_columns(df: DataFrame) -> DataFrame:
    """``df`` without columns that are null throughout; one row of counts reaches the driver."""
    counts = df.agg(*(F.count(f"`{c}`").alias(c) for c in df.columns)).first()
    return df.select(*(f"`{c}`" for c in df.columns if counts[c]))


def dangling(df: DataFrame, ref: str, known: DataFrame, key: str) -> DataFrame:
    """Rows whose reference isn't null and points nowhere."""
    return df.where(F.col(ref).isNotNull()).join(known.select(F.col(key).alias(ref)).distinct(), ref, "left_anti")


def out_of_order(df: DataFrame, periods: list[tuple[str, str]]) -> DataFrame:
    """Rows where a period ends before it starts, with ``period``, its first column, of the first such period; an open end is in order."""
    return df.withColumn("period", first_failure([(start, F.col(end) < F.col(start)) for start, end in periods])).where(F.col("period").isNotNull())


#: Fixed value: the share of sales below which a problem isn't worth a measure.
LEAST_SHARE = 0.03


def checked_recommendations(recs: DataFrame, problems: DataFrame, by: str) -> DataFrame:
    """``recs(by, measure, problem, evidence, score)`` against ``problems(by, problem, evidence, share)`` of the same report: each with ``findings``.

    A reference to no problem ends the checks of a row but for repeats; otherwise evidence has to be the problem's own, a
    known share at least 3 %, a score there. ``repeated``: the measure's name stands twice in its report.
    """
    known = problems.select(by, "problem", F.col("evidence").alias("_e"), "share", F.lit(True).alias("_there"))
    counts = recs.groupBy(by, "measure").agg(F.count("*").alias("_n"))
    rows = recs.join(known, [by, "problem"], "left").join(counts, [by, "measure"], "left")
    there = F.coalesce("_there", F.lit(False))
    checks = [
        (~there, "dangling"),
        (there & ~F.col("evidence").eqNullSafe(F.col("_e")), "other_evidence"),
        (there & (F.col("share") < LEAST_SHARE), "small_share"),
        (there & F.col("score").isNull(), "no_score"),
        (F.col("_n") > 1, "repeated"),
    ]
    found = F.array_compact(F.array(*(F.when(bad, F.lit(name)) for bad, name in checks)))
    return rows.select(*recs.columns, F.array_join(found, ",").alias("findings"))


def join_rate(df: DataFrame, columns: list[str], least: float = 0.8) -> DataFrame:
    """factor, rate, low: the share of rows that a join found a value for."""
    row = df.agg(*(F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("factor"), F.col(c).alias("rate")) for c in columns))).alias("r")
    return row.select(each).select("r.*", (F.col("r.rate") < least).alias("low"))


def totals(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """``df`` with the sum of ``value`` over a coarser key, pre-aggregated before it is joined back."""
    return df.join(df.groupBy(*by).agg(exact_sum(value).alias(out)), by, "left")
