"""Ranks, percentiles and peer comparisons.

Windows are partitioned by the peer group. Where the group is the whole table, ranks are made from counts of
distinct values dealt over ranges, so no task ever holds all rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_rank(value: str, by: list[str], descending: bool = False) -> Column:
    """Rank from 1 with ties sharing their mean rank; null for a null value."""
    v = F.col(value)
    order = Window.partitionBy(*by).orderBy(v.desc_nulls_last() if descending else v.asc_nulls_last())
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, value))
    return F.when(v.isNotNull(), F.rank().over(order) + (ties - 1) / 2.0)


def percentile_rank(value: str, by: list[str]) -> Column:
    """Average rank over the number of non-null values: neither percent_rank nor cume_dist."""
    return average_rank(value, by) / F.count(value).over(Window.partitionBy(*by))


def mid_percentile(value: str, by: list[str]) -> Column:
    """Half of (share below + share at most), in percent."""
    w = Window.partitionBy(*by)
    order = w.orderBy(F.col(value).asc_nulls_last())
    n = F.count(value).over(w)
    upto = F.count(value).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return F.when(F.col(value).isNotNull(), (F.rank().over(order) - 1 + upto) / 2.0 / n * 100)


def strict_rank(value: str, by: list[str]) -> Column:
    """1 + the number of strictly greater values."""
    return F.rank().over(Window.partitionBy(*by).orderBy(F.col(value).desc_nulls_last()))


def _splits(df: DataFrame, value: str, ranges: int) -> list[float]:
    """At most ``ranges - 1`` cut points of about equal shares; only these reach the driver."""
    cuts = df.agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 10 * ranges).alias("c")).first()["c"]
    return sorted(set(cuts or []))


def global_ranks(df: DataFrame, value: str, rank: str = "rank", total: str = "total", ranges: int = 64) -> DataFrame:
    """``df`` with the average rank of ``value`` among all rows and the count of non-null values, without a one-task window.

    Distinct values are counted first, so a value however common is one row; they are dealt over ``ranges`` of about
    equal shares, summed within each, and the few ranges' totals are added. Null values have a null rank.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n"))
    cuts = _splits(df, value, ranges)
    place = F.lit(0)
    if cuts:
        points = F.array(*map(F.lit, cuts))
        place = F.size(F.filter(points, lambda c: c <= F.col(value)))
    counts = counts.withColumn("_range", place)
    before = F.sum("_n").over(Window.partitionBy("_range").orderBy(value)) - F.col("_n")
    totals = counts.groupBy("_range").agg(F.sum("_n").alias("_sum"))
    # at most ``ranges`` rows
    base = totals.select("_range", (F.sum("_sum").over(Window.orderBy("_range")) - F.col("_sum")).alias("_base"), F.sum("_sum").over(Window.partitionBy()).alias(total))
    ranked = counts.withColumn("_before", before).join(F.broadcast(base), "_range")
    ranked = ranked.select(value, (F.col("_base") + F.col("_before") + (F.col("_n") + 1) / 2.0).alias(rank), total)
    return df.join(ranked, value, "left").select(*df.columns, rank, total)


def global_percentile(df: DataFrame, value: str, out: str) -> DataFrame:
    """``df`` with ``out``, the average rank of ``value`` over the number of non-null values."""
    return global_ranks(df, value, "_rank", "_total").withColumn(out, F.col("_rank") / F.col("_total")).drop("_rank", "_total")


def quantiles(df: DataFrame, value: str, probs: list[float], accuracy: int = 10_000) -> list[float | None]:
    """Exact quantiles of one column with linear interpolation; see ``quantiles_of``."""
    return quantiles_of(df, {value: probs}, accuracy)[value]


def quantiles_of(df: DataFrame, wanted: dict[str, list[float]], accuracy: int = 10_000) -> dict[str, list[float | None]]:
    """Exact quantiles of several columns with linear interpolation, in two jobs and without gathering a column.

    An approximate pass brackets each order statistic; the exact one counts what lies below each bracket and sorts the
    bracket's distinct values alone, some ``2 / accuracy`` of the rows. Nulls are ignored; an empty column gives None.
    """
    columns = list(wanted)
    known = df.select(*(F.col(f"`{c}`").cast("double").alias(f"v{i}") for i, c in enumerate(columns)))
    row = known.agg(*(
        made.alias(f"{name}{i}")
        for i, c in enumerate(columns)
        for name, made in (
            ("n", F.count(f"v{i}")), ("lo", F.min(f"v{i}")), ("hi", F.max(f"v{i}")),
            ("b", F.percentile_approx(f"v{i}", [min(1.0, max(0.0, p + d)) for p in wanted[c] for d in (-2 / accuracy, 2 / accuracy)], accuracy)),
        )
    )).first()
    out: dict[str, list[float | None]] = {c: [None] * len(wanted[c]) for c in columns}
    todo = {}
    for i, c in enumerate(columns):
        n = row[f"n{i}"]
        for j, p in enumerate(wanted[c]) if n else ():
            first = int(p * (n - 1))
            lo = row[f"lo{i}"] if first <= 2 * n / accuracy + 1 else row[f"b{i}"][2 * j]
            hi = row[f"hi{i}"] if first + 1 >= n - 2 * n / accuracy - 1 else row[f"b{i}"][2 * j + 1]
            todo[i, j] = first, min(first + 1, n - 1), lo, hi
    while todo:
        # one row a distinct value inside a bracket, and one, with a null value, for all below it
        numbered = list(todo)
        v = [F.col(f"v{i}") for i, _ in numbered]
        inside = [F.struct(F.lit(at).alias("at"), F.when(x >= F.lit(todo[k][2]), x).alias("v"), (x <= F.lit(todo[k][3])).alias("in")) for at, (k, x) in enumerate(zip(numbered, v, strict=True))]
        values = known.select(F.explode(F.array(*inside)).alias("e")).where("e.in").groupBy("e.at", "e.v").agg(F.count("*").alias("k"))
        upto = values.withColumn("upto", F.sum("k").over(Window.partitionBy("at").orderBy(F.col("v").asc_nulls_first())))
        rank = lambda n: F.element_at(F.array(*(F.lit(todo[k][n]) for k in numbered)), F.col("at") + 1)  # noqa: E731, B023
        got = upto.groupBy("at").agg(F.max(F.when(F.col("v").isNull(), F.col("k"))).alias("below"), *(F.min(F.when(F.col("upto") > rank(n), F.col("v"))).alias(name) for n, name in ((0, "a"), (1, "b"))))
        for g in got.collect():
            i, j = k = numbered[g["at"]]
            first, second, lo, hi = todo[k]
            if (g["below"] or 0) <= first and g["a"] is not None and g["b"] is not None:
                share = wanted[columns[i]][j] * (row[f"n{i}"] - 1) - first
                out[columns[i]][j] = g["a"] + share * (g["b"] - g["a"])
                del todo[k]
            else:
                todo[k] = first, second, row[f"lo{i}"], row[f"hi{i}"]  # the bracket missed: take all
    return out


def quantile_bucket(df: DataFrame, value: str, k: int, out: str) -> DataFrame:
    """``df`` with ``out``, the number from 1 of the value's equal-frequency bucket; equal edges fall together, so ties share a bucket."""
    edges = quantiles(df, value, [i / k for i in range(k + 1)])
    if edges[0] is None:
        return df.withColumn(out, F.lit(None).cast("int"))
    inner = sorted(set(edges))[1:-1]
    return df.withColumn(out, F.when(F.col(value).isNotNull(), sum((F.when(F.col(value) > e, 1).otherwise(0) for e in inner), F.lit(1))))


def _with_moments(df: DataFrame, values: list[str], by: list[str], tag: str) -> DataFrame:
    """``df`` with its group's rows, and each value's count, mean and sample deviation: combined before they are shuffled, joined back.

    A group however large is one row; null keys make a group like any other.
    """
    made = {f"{tag}": F.count(F.lit(1))} | {f"{tag}{m}{i}": f(v) for i, v in enumerate(values) for m, f in (("n", F.count), ("m", F.avg), ("s", F.stddev_samp))}
    groups = df.groupBy(*by).agg(*(x.alias(c) for c, x in made.items())).withColumnsRenamed({c: f"{tag}_{c}" for c in by})
    same = [df[c].eqNullSafe(groups[f"{tag}_{c}"]) for c in by]
    return df.join(groups, reduce(lambda a, b: a & b, same)).drop(*(f"{tag}_{c}" for c in by))


def _others(value: str, tag: str) -> tuple[Column, Column]:
    """(mean, sample deviation) of the other non-null values of the group, from centred moments."""
    n, mean, sd = (F.col(f"{tag.format(m)}") for m in "nms")
    off = F.col(value) - mean
    m = F.when(F.col(value).isNull(), mean).when(n > 1, mean - off / (n - 1))
    rest = F.pow(sd, 2) * (n - 1) - F.pow(off, 2) * n / (n - 1)
    return m, F.when(F.col(value).isNull(), sd).when(n > 2, F.sqrt(F.greatest(rest, F.lit(0.0)) / (n - 2)))


def peer_z(df: DataFrame, values: list[str], wide: list[str], narrow: list[str], least: int = 20) -> DataFrame:
    """z of each value among the other rows of the ``narrow`` group where it has ``least`` of them, else of the ``wide`` one.

    Adds ``<value>_z`` and ``peers``. Null where the value or the deviation is null, the deviation is below 1e-4 or below
    one hundredth of the mean.
    """
    out = _with_moments(_with_moments(df, values, wide, "_wide"), values, narrow, "_narrow")
    near = F.col("_narrow") - 1 >= least
    made = {"peers": F.when(near, F.col("_narrow")).otherwise(F.col("_wide")) - 1}
    for i, v in enumerate(values):
        (wm, ws), (nm, ns) = (_others(v, f"{tag}{{}}{i}") for tag in ("_wide", "_narrow"))
        m, s = F.when(near, nm).otherwise(wm), F.when(near, ns).otherwise(ws)
        flat = (s < 1e-4) | ((m != 0) & (s / F.nullif(m, F.lit(0.0)) < 0.01))
        made[f"{v}_z"] = F.when(~flat & F.col(v).isNotNull(), (F.col(v) - m) / F.nullif(s, F.lit(0.0)))
    return out.withColumns(made).select(*df.columns, "peers", *(f"{v}_z" for v in values))


#: Groups of fewer rows are looked at whole.
BRACKETED = 10_000


def _joined(df: DataFrame, groups: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """``df`` with the columns of ``groups``, a row a group; null keys make groups like any other."""
    groups = groups.withColumnsRenamed({c: f"_of_{c}" for c in by})
    return df.join(groups, reduce(lambda x, y: x & y, (df[c].eqNullSafe(groups[f"_of_{c}"]) for c in by)), how).drop(*(f"_of_{c}" for c in by))


def middles(df: DataFrame, value: str, by: list[str], ranks: dict[str, Column], accuracy: int = BRACKETED) -> DataFrame:
    """(by, _n, ranks): of each group the number of values and those at the given ranks, from 1, next to the middle.

    Ranks are expressions of ``_n`` within two of half of it. No group is sorted or gathered: an approximate pass brackets the
    middle, what lies below is counted, and of what lies inside, some ``4 / accuracy`` of a large group, the distinct
    values with their counts are put in order. Nulls are ignored; a rank outside of 1 to ``_n`` gives null.
    """
    known = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    near = F.percentile_approx("_v", [0.5 - 2 / accuracy, 0.5 + 2 / accuracy], accuracy)
    groups = known.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), near.alias("_b"))
    small = F.col("_n") < BRACKETED
    groups = groups.select(*by, "_n", F.when(small, F.col("_lo")).otherwise(F.col("_b")[0]).alias("_lo"), F.when(small, F.col("_hi")).otherwise(F.col("_b")[1]).alias("_hi"))
    inside = _joined(known, groups, by).where("_v <= _hi").withColumn("_v", F.when(F.col("_v") >= F.col("_lo"), F.col("_v")))
    counts = inside.groupBy(*by, "_v").agg(F.count("*").alias("_k"), F.first("_n").alias("_n"))
    upto = counts.withColumn("_upto", F.sum("_k").over(Window.partitionBy(*by).orderBy(F.col("_v").asc_nulls_first())))
    at = [F.min(F.when((F.col("_upto") >= r) & (r >= 1), F.struct("_upto", "_v"))).alias(c) for c, r in ranks.items()]
    found = upto.groupBy(*by).agg(F.first("_n").alias("_n"), *at)
    # the approximation is good for one in ``accuracy``; a rank outside of the bracket would mean that it isn't
    missed = F.lit(False)
    for c, r in ranks.items():
        missed = missed | ((r >= 1) & (r <= F.col("_n")) & F.col(f"{c}._v").isNull())
    return found.where(F.when(missed, F.raise_error(F.lit("a middle lies outside of its bracket"))).isNull()).select(*by, "_n", *(F.col(f"{c}._v").alias(c) for c in ranks))


def medians(df: DataFrame, value: str, by: list[str], out: str) -> DataFrame:
    """(by, ``out``, ``out``_n): each group's exact median, null without values, and the number of its values."""
    n = F.col("_n")
    found = middles(df, value, by, {"_a": F.floor((n + 1) / 2), "_b": F.floor(n / 2) + 1})
    some = found.select(*by, ((F.col("_a") + F.col("_b")) / 2).alias(out), n.alias(f"{out}_n"))
    every = df.select(*by).distinct()
    return _joined(every, some, by, "left").withColumn(f"{out}_n", F.coalesce(f"{out}_n", F.lit(0)))


def _median_of_others(df: DataFrame, value: str, by: list[str], out: str) -> DataFrame:
    """``df`` with the median of the other rows' values, from the order statistics around the group's middle.

    The k-th of the others is the group's k-th where the row's own value is above that, else the next one.
    """
    n = F.col("_n")
    k1, k2 = F.floor(n / 2), F.floor((n + 1) / 2)  # of n - 1 values
    both = _joined(df, middles(df, value, by, {"_a": k1, "_b": k1 + 1, "_c": k2, "_d": k2 + 1}), by)
    first = F.when(F.col(value) > F.col("_a"), F.col("_a")).otherwise(F.col("_b"))
    second = F.when(F.col(value) > F.col("_c"), F.col("_c")).otherwise(F.col("_d"))
    return both.withColumn(out, F.when(n > 1, (first + second) / 2)).drop("_n", "_a", "_b", "_c", "_d")


def counts_upto(df: DataFrame, value: str, by: list[str], out: str, size: str, parts: int = 64) -> DataFrame:
    """``df`` with ``out``, the number of the group's values at most the row's own, and ``size``, that of all its values.

    A group's distinct values are dealt over up to ``parts`` ranges of it, counted within each and put after those before.
    """
    known = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    edges = known.groupBy(*by).agg(F.count("*").alias("_size"), F.percentile_approx("_v", [i / parts for i in range(1, parts)], 1000).alias("_edges"))
    counts = _joined(known.groupBy(*by, "_v").agg(F.count("*").alias("_k")), edges, by)
    counts = counts.withColumn("_part", F.size(F.filter("_edges", lambda e: e < F.col("_v")))).drop("_edges")
    w = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.groupBy(*by, "_part").agg(F.sum("_k").alias("_s")).select(*by, "_part", F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_before"))
    within = counts.withColumn("_within", F.sum("_k").over(Window.partitionBy(*by, "_part").orderBy("_v")))
    found = _joined(within, before, [*by, "_part"]).select(*by, F.col("_v").alias(value), (F.col("_before") + F.col("_within")).alias(out), F.col("_size").alias(size))
    return _joined(df, found, [*by, value], "left")


def robust_z(df: DataFrame, value: str, by: list[str], key: str, least: int = 20) -> DataFrame:
    """(by, key, value, robust_z, percentile): 0.6745 (x - median) / MAD of the other rows, held to 10, and the share of them at most x.

    A group has few distinct medians of others (three at most), so deviations are made once for each of them: the work
    is in proportion to the rows. Rows with fewer than ``least`` others are left out; a MAD near 0 gives 0.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, key, F.col(value).alias("_v"))
    rows = counts_upto(_median_of_others(rows, "_v", by, "_med"), "_v", by, "_upto", "_size").where(F.col("_size") > least)
    medians = rows.select(*by, F.col("_med").alias("_of")).distinct()
    spread = _joined(rows, medians, by).withColumn("_dev", F.abs(F.col("_v") - F.col("_of")))
    spread = _median_of_others(spread, "_dev", [*by, "_of"], "_mad").where(F.col("_of") == F.col("_med"))
    z = F.when(F.col("_mad") > 1e-9, 0.6745 * (F.col("_v") - F.col("_med")) / F.col("_mad")).otherwise(0.0)
    return spread.select(*by, key, F.col("_v").alias(value), F.least(F.greatest(z, F.lit(-10.0)), F.lit(10.0)).alias("robust_z"), ((F.col("_upto") - 1) / (F.col("_size") - 1) * 100).alias("percentile"))


def adjusted_p(df: DataFrame, p: str, key: str, out: str) -> DataFrame:
    """``df`` with Benjamini and Hochberg's adjusted p values. One row a test: tests are few, factors and not data rows."""
    up = Window.orderBy(F.col(p), F.col(key))
    ranked = df.withColumns({"_rank": F.row_number().over(up), "_n": F.count(F.lit(1)).over(Window.partitionBy())})
    from_above = Window.orderBy(F.col("_rank").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn(out, F.least(F.min(F.col(p) * F.col("_n") / F.col("_rank")).over(from_above), F.lit(1.0))).drop("_rank", "_n")


def first_of(df: DataFrame, by: list[str], order: list[Column], k: int = 1, rank: str | None = None) -> DataFrame:
    """The first k rows of each group in ``order``; with ``rank`` their number is kept."""
    name = rank or "_first"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)
    return out if rank else out.drop(name)
