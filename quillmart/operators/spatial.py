"""Places and periods: radius and nearest joins over grid cells, quarters of an interval, distance-weighted exposure.

A radius join is an equi-join on grid cells of the radius' size: each left point looks into its own cell and those
around it, so no pair further apart than two cells is made and no nested loop is planned. A crowded cell is a skewed
join key, which adaptive execution splits.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmart.functions.columns import EARTH_RADIUS, code_of, quarter_end, quarter_of, quarter_start, serial


def _cells(coords: list[str], size: float) -> list[Column]:
    return [F.floor(F.col(c) / size).cast("long") for c in coords]


def radius_join(left: DataFrame, right: DataFrame, radius: float, coords: list[str] = ["x", "y"], out: str = "distance") -> DataFrame:  # noqa: B006
    """Every pair of a left and a right row at most ``radius`` apart, with the distance; null coordinates pair with nothing.

    Other columns of the two sides must differ; the right side's coordinates are dropped.
    """
    n = len(coords)
    names, there = [f"_cell{i}" for i in range(n)], [f"_{c}_r" for c in coords]
    known = lambda df: df.where(" and ".join(f"`{c}` is not null" for c in coords))
    around = F.array(*(F.struct(*(F.lit(d).cast("long").alias(f"d{i}") for i, d in enumerate(step))) for step in product((-1, 0, 1), repeat=n)))
    a = known(left).withColumn("_step", F.explode(around))
    a = a.withColumns({name: cell + F.col(f"_step.d{i}") for i, (name, cell) in enumerate(zip(names, _cells(coords, radius), strict=True))}).drop("_step")
    b = known(right).withColumns(dict(zip(names, _cells(coords, radius), strict=True))).withColumnsRenamed(dict(zip(coords, there, strict=True)))
    squares = sum(((F.col(c) - F.col(r)) * (F.col(c) - F.col(r)) for c, r in zip(coords, there, strict=True)), F.lit(0.0))
    return a.join(b, names).withColumn(out, F.sqrt(squares)).where(F.col(out) <= radius).drop(*names, *there)


def nearest(left: DataFrame, right: DataFrame, key: str, right_key: str, radius: float, coords: list[str] = ["x", "y"], limit: float = float("inf"), digits: int | None = None) -> DataFrame:  # noqa: B006
    """(key, right_key, distance) of the nearest right row, ties to the smaller key; rows with nothing within ``limit`` are left out.

    With ``digits`` distances equal when so rounded are ties. Rows that found nothing look again in a radius twice as large, so each looks at few cells.
    """
    from quillmart.operators.storage import stored

    open_, found = left.select(key, *coords), None
    other = right.select(right_key, *coords)
    spread = other.agg(*(F.max(c).alias(f"hi_{c}") for c in coords), *(F.min(c).alias(f"lo_{c}") for c in coords)).first()
    mine = left.agg(*(F.max(c).alias(f"hi_{c}") for c in coords), *(F.min(c).alias(f"lo_{c}") for c in coords)).first()
    if any(v is None for v in (*spread, *mine)):
        return radius_join(open_, other, radius, coords).select(key, right_key, "distance")
    reach = min(limit, 2 * sum(max(spread[f"hi_{c}"], mine[f"hi_{c}"]) - min(spread[f"lo_{c}"], mine[f"lo_{c}"]) for c in coords) + radius)
    while True:
        r = min(radius, reach)
        by = F.col("distance") if digits is None else F.round("distance", digits)
        best = radius_join(open_, other, r, coords).groupBy(key).agg(F.min(F.struct(by.alias("by"), right_key, "distance")).alias("m")).select(key, f"m.{right_key}", "m.distance")
        best = stored(best, "nearest")
        found = best if found is None else found.union(best)
        if r >= reach:
            return found
        open_ = stored(open_.join(best, key, "left_anti"), "open")
        if open_.isEmpty():
            return found
        radius *= 2


def sphere(lon: Column, lat: Column) -> list[Column]:
    """Three coordinates in metres of a point on the globe: straight distances order as great-circle ones do."""
    return [
        (EARTH_RADIUS * F.cos(F.radians(lat)) * F.cos(F.radians(lon))).alias("_sx"),
        (EARTH_RADIUS * F.cos(F.radians(lat)) * F.sin(F.radians(lon))).alias("_sy"),
        (EARTH_RADIUS * F.sin(F.radians(lat))).alias("_sz"),
    ]


def nearest_on_globe(left: DataFrame, right: DataFrame, key: str, right_key: str, radius: float = 2_000.0) -> DataFrame:
    """(key, right_key, distance in metres along the surface); rows without coordinates have null for both."""
    on = lambda df, k: df.select(k, *sphere(F.col("lon").cast("double"), F.col("lat").cast("double"))).where("_sx is not null and _sz is not null")
    found = nearest(on(left, key), on(right, right_key), key, right_key, radius, ["_sx", "_sy", "_sz"], digits=3)
    arc = 2 * EARTH_RADIUS * F.asin(F.least(F.col("distance") / (2 * EARTH_RADIUS), F.lit(1.0)))
    return left.select(key).join(found.select(key, right_key, arc.alias("distance")), key, "left")


def interval_quarters(df: DataFrame, start: str, end: str) -> DataFrame:
    """One row a quarter that [start, end] touches, with ``quarter`` and ``days``, the days of overlap.

    A missing end, or one before the start, is the start; rows without a start go.
    """
    last = F.when(F.col(end).isNull() | (F.col(end) < F.col(start)), F.col(start)).otherwise(F.col(end))
    rows = df.where(F.col(start).isNotNull()).withColumn(end, last)
    first_q, last_q = serial(quarter_of(F.col(start))), serial(quarter_of(F.col(end)))
    rows = rows.withColumn("_q", F.explode(F.sequence(first_q, last_q))).withColumn("quarter", code_of(F.col("_q"))).drop("_q")
    q = F.col("quarter")
    return rows.withColumn("days", F.datediff(F.least(F.col(end), quarter_end(q)), F.greatest(F.col(start), quarter_start(q))) + 1)


def decay(distance: Column, scale: float = 1_000.0) -> Column:
    return F.exp(-distance / scale)


def exposure(events: DataFrame, places: DataFrame, place: str, radius: float) -> DataFrame:
    """Per place and quarter: number and days of events within ``radius``, the nearest one, and days weighted by distance."""
    near = radius_join(interval_quarters(events, "start", "end"), places.select(place, "x", "y"), radius)
    return near.groupBy(place, "quarter").agg(
        F.count("*").alias("events"), F.sum("days").cast("long").alias("days"), F.min("distance").alias("nearest"), F.sum(F.col("days") * decay(F.col("distance"))).alias("exposure")
    )


def exposure_details(events: DataFrame, places: DataFrame, place: str, radius: float, event: str = "event") -> DataFrame:
    """Per place and quarter: the distinct events whose nearest place it is, within ``radius``, as JSON in order of distance, and their number ``n``."""
    near = nearest(events, places, event, place, radius, limit=radius)
    rows = interval_quarters(events.drop("x", "y"), "start", "end").join(near, event)
    item = F.struct(F.round("distance", 1).alias("distance"), F.col("name"), F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"))
    listed = rows.select(place, "quarter", item.alias("e")).distinct().groupBy(place, "quarter")
    return listed.agg(F.count("*").alias("n"), F.to_json(F.array_sort(F.collect_list("e"))).alias("details"))


def openings(events: DataFrame, places: DataFrame, place: str, radius: float) -> DataFrame:
    """Per place and quarter of the event's start: count, exposure and nearest of openings and closures, absent ones 0 (nearest null)."""
    dated = events.where(F.col("start").isNotNull()).withColumn("quarter", quarter_of(F.col("start")))
    near = radius_join(dated, places.select(place, "x", "y"), radius)
    wide = near.groupBy(place, "quarter").pivot("kind", ["open", "close"]).agg(F.count(F.lit(1)).alias("count"), F.sum(decay(F.col("distance"))).alias("exposure"), F.min("distance").alias("nearest"))
    return wide.na.fill(0, ["open_count", "close_count"]).na.fill(0.0, ["open_exposure", "close_exposure"])


def ridership_exposure(rides: DataFrame, stations: DataFrame, places: DataFrame, place: str, radius: float) -> DataFrame:
    """Per place and quarter: rides of stations within ``radius`` weighted by distance, their number, the nearest. ``rides(station, quarter, rides)``, ``stations(station, x, y)``."""
    sums = rides.groupBy("station", "quarter").agg(F.sum("rides").alias("rides"))
    placed = sums.join(stations.where("x is not null and y is not null").dropDuplicates(["station"]), "station")
    near = radius_join(placed, places.select(place, "x", "y"), radius)
    return near.groupBy(place, "quarter").agg(F.sum(F.col("rides") * decay(F.col("distance"))).alias("exposure"), F.count("*").alias("stations"), F.min("distance").alias("nearest"))


def neighbour_changes(changes: DataFrame, places: DataFrame, place: str, radius: float) -> DataFrame:
    """Per place and quarter: its own change, the median change of the other places within ``radius``, how many have one, and the pattern.

    ``changes(place, quarter, change)``.
    """
    from quillmart.functions.classify import regional_pattern
    from quillmart.operators.ranking import medians

    other = f"_{place}"
    pairs = radius_join(places.select(place, "x", "y"), places.select(F.col(place).alias(other), "x", "y"), radius).where(F.col(place) != F.col(other)).select(place, other)
    theirs = changes.select(F.col(place).alias(other), "quarter", F.col("change").alias("_c")).where("_c is not null")
    around = medians(pairs.join(theirs, other), "_c", [place, "quarter"], "around").withColumnRenamed("around_n", "n_around")
    out = changes.join(around, [place, "quarter"], "left").withColumn("n_around", F.coalesce("n_around", F.lit(0)))
    return out.select(place, "quarter", "change", "around", "n_around", regional_pattern(F.col("change"), F.col("around"), F.col("n_around")).alias("pattern"))


def filled(df: DataFrame, exposures: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``df`` with exposures, 0 where there is none."""
    return df.join(exposures.select(*keys, *columns), keys, "left").withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in columns})
