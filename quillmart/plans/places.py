"""Queries about places: radius and nearest joins, exposure, neighbours."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmart.functions import columns
from quillmart.operators import panel, ranking, spatial
from quillmart.plans.bases import DISTRICTS, HAPPENINGS, PANEL, POINTS
from quillmart.plans.registry import query
from quillmart.sources import tables
from quillmart.sources.tables import Tables

DIST = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"


@query(f"WITH {DISTRICTS}, {POINTS} SELECT a.district, b.point, {DIST} AS distance FROM districts a JOIN points b ON {DIST} <= 1000", "distance")
def radius_pairs(t: Tables) -> DataFrame:
    near = spatial.radius_join(tables.points(t).select("point", "x", "y"), tables.districts(t).select("district", "x", "y"), 1000.0)
    return near.select("district", "point", "distance")


@query(
    f"""WITH {DISTRICTS}, {POINTS}, r AS (SELECT b.point, a.district, {DIST} AS distance, row_number() OVER (PARTITION BY b.point ORDER BY {DIST}, a.district) AS n FROM points b CROSS JOIN districts a) SELECT point, district, distance FROM r WHERE n = 1""",
    "distance",
)
def nearest_district(t: Tables) -> DataFrame:
    return spatial.nearest(tables.points(t), tables.districts(t), "point", "district", 500.0)


HAV = "2 * 6371000.0 * asin(sqrt(least(1.0::DOUBLE, power(sin(radians(a.lat - b.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(a.lon - b.lon) / 2), 2))))"


@query(
    f"""WITH {DISTRICTS}, {POINTS}, r AS (SELECT b.point, a.district, {HAV} AS distance, sqrt(a.area / pi()) AS radius, row_number() OVER (PARTITION BY b.point ORDER BY round({HAV}, 3), a.district) AS n FROM points b CROSS JOIN districts a)
SELECT point, district, distance, radius FROM r WHERE n = 1""",
    "distance radius",
    digits=3,
)
def nearest_on_globe(t: Tables) -> DataFrame:
    """Each point's nearest centre by great circle, with the centre's equal-area radius."""
    found = spatial.nearest_on_globe(tables.points(t), tables.districts(t), "point", "district")
    return found.join(tables.districts(t).select("district", columns.area_radius(F.col("area")).alias("radius")), "district").select("point", "district", "distance", "radius")


@query(f"WITH {HAPPENINGS} SELECT event, quarter, CAST(days AS INTEGER) AS days FROM event_quarters")
def interval_quarters(t: Tables) -> DataFrame:
    return spatial.interval_quarters(tables.happenings(t), "start", "end").select("event", "quarter", "days")


@query(
    f"""WITH {HAPPENINGS}, {DISTRICTS} SELECT district, quarter, CAST(count(*) AS BIGINT) AS events, CAST(sum(days) AS BIGINT) AS days, min({DIST}) AS nearest, sum(days * exp(-{DIST} / 1000)) AS exposure
FROM event_quarters a JOIN districts b ON {DIST} <= 2000 GROUP BY 1, 2""",
    "nearest exposure",
)
def event_exposure(t: Tables) -> DataFrame:
    return spatial.exposure(tables.happenings(t), tables.districts(t), "district", 2000.0)


@query(
    f"""WITH {HAPPENINGS}, {DISTRICTS}, near AS (SELECT event, district, d FROM (SELECT a.event, b.district, {DIST} AS d, row_number() OVER (PARTITION BY a.event ORDER BY {DIST}, b.district) AS n FROM happenings a CROSS JOIN districts b) WHERE n = 1 AND d <= 2000),
e AS (SELECT DISTINCT district, quarter, round(d, 1) AS distance, name, CAST(start AS VARCHAR) AS start, CAST("end" AS VARCHAR) AS "end" FROM event_quarters JOIN near USING (event))
SELECT district, quarter, CAST(count(*) AS BIGINT) AS n, CAST(to_json(list({{'distance': distance, 'name': name, 'start': start, 'end': "end"}} ORDER BY distance, name, start, "end")) AS VARCHAR) AS details FROM e GROUP BY 1, 2"""
)
def event_details(t: Tables) -> DataFrame:
    """Events of each district and quarter as JSON."""
    return spatial.exposure_details(tables.happenings(t), tables.districts(t), "district", 2000.0)


@query(
    f"""WITH {HAPPENINGS}, {DISTRICTS}, n AS (SELECT district, CAST(year(start) * 10 + quarter(start) AS INTEGER) AS quarter, kind, {DIST} AS d FROM happenings a JOIN districts b ON {DIST} <= 1000)
SELECT district, quarter, CAST(count(*) FILTER (kind = 'open') AS BIGINT) AS open_count, coalesce(sum(exp(-d / 1000)) FILTER (kind = 'open'), 0.0) AS open_exposure, min(d) FILTER (kind = 'open') AS open_nearest,
  CAST(count(*) FILTER (kind = 'close') AS BIGINT) AS close_count, coalesce(sum(exp(-d / 1000)) FILTER (kind = 'close'), 0.0) AS close_exposure, min(d) FILTER (kind = 'close') AS close_nearest FROM n GROUP BY 1, 2""",
    "open_exposure open_nearest close_exposure close_nearest",
)
def openings_and_closures(t: Tables) -> DataFrame:
    return spatial.openings(tables.happenings(t), tables.districts(t), "district", 1000.0)


@query(
    f"""WITH {DISTRICTS}, {POINTS}, s AS (SELECT o_custkey AS point, CAST(year(o_orderdate) * 10 + quarter(o_orderdate) AS INTEGER) AS quarter, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS rides FROM orders GROUP BY 1, 2)
SELECT district, quarter, sum(rides * exp(-{DIST} / 1000)) AS exposure, CAST(count(*) AS BIGINT) AS stations, min({DIST}) AS nearest FROM s JOIN points a ON s.point = a.point JOIN districts b ON {DIST} <= 500 GROUP BY 1, 2""",
    "exposure nearest",
    digits=3,
)
def ridership_exposure(t: Tables) -> DataFrame:
    rides = t.orders.select(F.col("o_custkey").alias("station"), columns.quarter_of(F.col("o_orderdate")).alias("quarter"), F.col("o_totalprice").alias("rides"))
    stations = tables.points(t).select(F.col("point").alias("station"), "x", "y")
    return spatial.ridership_exposure(rides, stations, tables.districts(t), "district", 500.0)


AREA = f"""{PANEL}, area AS (SELECT district, quarter, q, CAST(sum(CAST(sales AS DECIMAL(18,4))) AS DOUBLE) AS sales FROM panel GROUP BY 1, 2, 3),
changes AS (SELECT a.district, a.quarter, (a.sales - b.sales) / nullif(b.sales, 0) AS change FROM area a LEFT JOIN area b ON a.district = b.district AND b.q = a.q - 1)"""


@query(
    f"""WITH {AREA}, {DISTRICTS}, pairs AS (SELECT a.district, b.district AS other FROM districts a JOIN districts b ON a.district <> b.district AND {DIST} <= 3000),
n AS (SELECT p.district, c.quarter, median(c.change) AS around, CAST(count(*) AS BIGINT) AS n_around FROM pairs p JOIN changes c ON c.district = p.other WHERE c.change IS NOT NULL GROUP BY 1, 2)
SELECT c.district, c.quarter, c.change, n.around, coalesce(n.n_around, 0) AS n_around,
  CASE WHEN c.change IS NULL OR n.around IS NULL OR coalesce(n.n_around, 0) < 3 THEN 'unknown' WHEN c.change <= -0.1 AND around <= -0.1 THEN 'falls_together' WHEN c.change <= -0.1 THEN 'falls_alone'
    WHEN around <= -0.1 THEN 'holds_against_trend' WHEN c.change > 0 AND around > 0 THEN 'rises_together' ELSE 'unknown' END AS pattern
FROM changes c LEFT JOIN n ON c.district = n.district AND c.quarter = n.quarter""",
    "change around",
)
def neighbour_patterns(t: Tables) -> DataFrame:
    area = tables.panel(t).groupBy("district", "quarter", "q").agg(columns.exact_sum("sales").alias("sales"))
    changes = area.select("district", "quarter", columns.change(panel.at_lag("sales", ["district"], "q", 1), F.col("sales")).alias("change"))
    return spatial.neighbour_changes(changes, tables.districts(t), "district", 3000.0)


@query(
    f"""WITH {HAPPENINGS}, {DISTRICTS}, {PANEL}, e AS (SELECT district, quarter, sum(days * exp(-{DIST} / 1000)) AS exposure FROM event_quarters a JOIN districts b ON {DIST} <= 2000 GROUP BY 1, 2),
x AS (SELECT p.district, p.quarter, coalesce(e.exposure, 0.0) AS exposure FROM (SELECT DISTINCT district, quarter FROM panel) p LEFT JOIN e ON p.district = e.district AND p.quarter = e.quarter),
m AS (SELECT district, quarter, exposure, ((rank() OVER (PARTITION BY quarter ORDER BY exposure) - 1) + count(*) OVER (PARTITION BY quarter ORDER BY exposure RANGE UNBOUNDED PRECEDING)) / 2.0::DOUBLE / count(*) OVER (PARTITION BY quarter) * 100 AS percentile FROM x)
SELECT *, CASE WHEN percentile <= 25 THEN 'low' WHEN percentile >= 75 THEN 'high' ELSE 'normal' END AS band FROM m""",
    "exposure percentile",
)
def exposure_percentiles(t: Tables) -> DataFrame:
    from quillmart.functions.classify import band

    exposures = spatial.exposure(tables.happenings(t), tables.districts(t), "district", 2000.0)
    cells = spatial.filled(tables.panel(t).select("district", "quarter").distinct(), exposures, ["district", "quarter"], ["exposure"])
    return cells.withColumn("percentile", ranking.mid_percentile("exposure", ["quarter"])).withColumn("band", band(F.col("percentile")))


@query()
def projected_centres(t: Tables) -> DataFrame:
    """Centres in the plane of the central belt, checked by the tests against known points."""
    east, north = columns.transverse_mercator(F.col("lon"), F.col("lat"))
    return tables.districts(t).select("district", east.alias("east"), north.alias("north"))
