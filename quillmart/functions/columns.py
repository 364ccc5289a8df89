"""Column expressions shared by the operators: exact sums, guarded ratios, quarter codes, geography, text."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres; the mean radius that the haversine distances use.
EARTH_RADIUS = 6_371_000.0


def exact_sum(value: Column | str) -> Column:
    """Sum of amounts with at most four decimals, whatever the order rows arrive in; null if there is none."""
    return F.sum(F.col(value).cast("decimal(18,4)") if isinstance(value, str) else value.cast("decimal(18,4)")).cast("double")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or either is null."""
    return a / F.nullif(b, F.lit(0))


def change(before: Column, after: Column) -> Column:
    """(after - before) / before, null on a zero or missing base."""
    return ratio(after - before, before)


def clip(x: Column, low: float, high: float) -> Column:
    """x held between low and high; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def no_nan(x: Column) -> Column:
    """NaN and infinities to null, once, at the scan."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


# quarters: a code is year * 10 + quarter, a serial counts quarters without gaps


def quarter_of(day: Column) -> Column:
    return (F.year(day) * 10 + F.quarter(day)).cast("int")


def serial(code: Column) -> Column:
    return (F.floor(code / 10) * 4 + code % 10 - 1).cast("int")


def code_of(number: Column) -> Column:
    return (F.floor(number / 4) * 10 + number % 4 + 1).cast("int")


def shift_quarter(code: Column, by: int) -> Column:
    return code_of(serial(code) + by)


def quarter_start(code: Column) -> Column:
    return F.make_date(F.floor(code / 10).cast("int"), ((code % 10 - 1) * 3 + 1).cast("int"), F.lit(1))


def quarter_end(code: Column) -> Column:
    return F.last_day(F.add_months(quarter_start(code), 2))


def quarter_days(code: Column) -> Column:
    return F.datediff(quarter_end(code), quarter_start(code)) + 1


def quarter_label(code: Column) -> Column:
    return F.concat(F.floor(code / 10).cast("string"), F.lit(" Q"), (code % 10).cast("string"))


# geography


def planar(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between two points given in degrees."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_RADIUS) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def transverse_mercator(lon: Column, lat: Column, *, lon0: float = 127.0, lat0: float = 38.0, scale: float = 1.0, easting: float = 200_000.0, northing: float = 500_000.0, a: float = 6_378_137.0, f: float = 1 / 298.257222101) -> tuple[Column, Column]:
    """Easting and northing in metres on an ellipsoid (Snyder's series); defaults are the central belt on GRS80."""
    e2 = f * (2 - f)
    ep = e2 / (1 - e2)
    m0, m2, m4, m6 = 1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256, 3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024, 15 * e2**2 / 256 + 45 * e2**3 / 1024, 35 * e2**3 / 3072
    p0 = math.radians(lat0)
    base = a * (m0 * p0 - m2 * math.sin(2 * p0) + m4 * math.sin(4 * p0) - m6 * math.sin(6 * p0))
    p = F.radians(lat)
    n = F.lit(a) / F.sqrt(1 - e2 * F.pow(F.sin(p), 2))
    t, c = F.pow(F.tan(p), 2), ep * F.pow(F.cos(p), 2)
    w = F.radians(lon - lon0) * F.cos(p)
    m = a * (m0 * p - m2 * F.sin(2 * p) + m4 * F.sin(4 * p) - m6 * F.sin(6 * p))
    east = easting + scale * n * (w + (1 - t + c) * F.pow(w, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep) * F.pow(w, 5) / 120)
    north = northing + scale * (m - base + n * F.tan(p) * (w * w / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(w, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep) * F.pow(w, 6) / 720))
    return east, north


def area_radius(area: Column) -> Column:
    """Radius of the circle of that area."""
    return F.sqrt(area / math.pi)


# text


def tidy_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def short_address(address: Column, aliases: dict[str, str] | None = None) -> Column:
    """An address up to its building details: aliases applied, white space collapsed, cut at a block, floor or room number.

    Null gives an empty text, which never matches anything.
    """
    out = F.coalesce(address, F.lit(""))
    for name, alias in (aliases or {}).items():
        out = F.replace(out, F.lit(name), F.lit(alias))
    return F.trim(F.regexp_replace(tidy_space(out), r"\d+(?:동|층|호)(?![\p{L}\p{N}_]).*$", ""))


def is_true(text: Column) -> Column:
    """Flags written as text."""
    return F.coalesce(F.lower(F.trim(text.cast("string"))).isin("true", "1", "yes", "y"), F.lit(False))


def words_of(text: Column) -> Column:
    """The distinct words of two or more letters or digits, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1)))


#: A number with its unit, as in claims that generated text may quote. Fixed value.
QUANTITY = r"[+\-]?\d[\d,]*(?:\.\d+)?\s?(?:%|퍼센트|원|명|개월|개|건|주|일|회)|[+\-]?\d[\d,]*(?:\.\d+)?배(?![달란])"


def quantities(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({QUANTITY})"), F.lit(1))


def dot(a: Column, b: Column) -> Column:
    """Inner product, components added in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; a zero vector has a tiny length in place of none."""
    length = lambda v: F.when(dot(v, v) == 0, F.lit(1e-9)).otherwise(F.sqrt(dot(v, v)))
    return dot(a, b) / (length(a) * length(b))
