"""Readers: delimited text in mixed encodings, registries, weather observations, nested documents, vectors, paged services."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce
from urllib.request import urlopen

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from quillmart.operators.checks import InputError
from quillmart.operators.storage import stored

#: Quality marks of an observation that may be used.
GOOD_MARKS = ["0", "1", "4", "5"]


def csv(spark: SparkSession, path: str | list[str], schema: str | StructType, encoding: str = "UTF-8") -> DataFrame:
    """Headed CSV with an explicit schema; a byte order mark in the header is ignored, columns are taken by place."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("encoding", encoding).csv(path)


def redecoded(column: Column, encoding: str) -> Column:
    """A text that was read byte by byte as Latin-1, decoded as what it is; Spark itself reads few encodings. Arrow batches."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else t.encode("latin-1").decode(encoding, "replace"))

    return F.pandas_udf(run, StringType())(column)


def csv_any_encoding(spark: SparkSession, path: str, schema: str | StructType, fallback: str = "cp949") -> DataFrame:
    """The CSV files that ``path`` matches, each in UTF-8 if it is valid UTF-8 throughout, else in ``fallback``; an error without any.

    Which files are which is one job over their lines' bytes. The fallback's bytes must not contain those of a comma,
    quote or line break within a character.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), (~F.is_valid_utf8("value")).alias("bad"))
    files = lines.groupBy("file").agg(F.max("bad").alias("bad")).collect()  # one row a file
    if not files:
        raise InputError(f"no files match {path}")
    kinds = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    parts = []
    if good := [r["file"] for r in files if not r["bad"]]:
        parts.append(csv(spark, good, kinds))
    if bad := [r["file"] for r in files if r["bad"]]:
        raw = csv(spark, bad, StructType([StructField(f.name, StringType()) for f in kinds]), "ISO-8859-1")
        parts.append(raw.select(*(redecoded(F.col(f"`{f.name}`"), fallback).try_cast(f.dataType).alias(f.name) for f in kinds)))
    return reduce(DataFrame.unionByName, parts)


def registry(spark: SparkSession, path: str, names: dict[str, str]) -> DataFrame:
    """A registry whose columns are all text: the listed ones, renamed; ``lon`` and ``lat`` become numbers, null where they aren't."""
    rows = spark.read.option("header", True).option("inferSchema", False).csv(path)
    if missing := sorted(set(names) - set(rows.columns)):
        raise InputError(f"missing columns: {missing}")
    out = rows.select(*(F.col(f"`{a}`").alias(b) for a, b in names.items()))
    return out.withColumns({c: F.col(c).try_cast("double") for c in ("lon", "lat") if c in out.columns})


def scaled(field: Column, missing: str, scale: float, value_at: int = 0, mark_at: int = 1) -> Column:
    """A number in a comma-separated field, null if it is the missing value or its quality mark isn't a good one."""
    parts = F.split(F.coalesce(field, F.lit("")), ",")
    value = F.when(F.get(parts, F.lit(value_at)) != missing, F.get(parts, F.lit(value_at)))
    return F.when(F.get(parts, F.lit(mark_at)).isin(*GOOD_MARKS), value.try_cast("double") / scale)


def hourly_rain(*fields: Column) -> Column:
    """The largest one-hour depth in millimetres among the slots."""
    def one(field: Column) -> Column:
        parts = F.split(F.coalesce(field, F.lit("")), ",")
        depth = F.when(F.get(parts, F.lit(1)) != "9999", F.get(parts, F.lit(1))).try_cast("double") / 10
        return F.when((F.get(parts, F.lit(0)) == "01") & F.get(parts, F.lit(3)).isin(*GOOD_MARKS), depth)

    return F.greatest(*map(one, fields))


def daily_weather(observations: DataFrame, station: int, start: str, end: str, zone: str = "America/New_York") -> DataFrame:
    """Daily weather of one station from surface observations in UTC text times; days are local.

    The station filter is a plain comparison, so it reaches the scan of a columnar copy.
    """
    at = F.from_utc_timestamp(F.col("DATE").try_cast("timestamp_ntz").cast("timestamp"), zone)
    rows = observations.where(F.col("STATION").try_cast("long") == station).withColumn("day", at.cast("date")).where(F.col("day").between(start, end))
    rows = rows.select(
        "day", scaled(F.col("TMP"), "+9999", 10).alias("t"), scaled(F.col("DEW"), "+9999", 10).alias("dew"), scaled(F.col("WND"), "9999", 10, 3, 4).alias("wind"),
        scaled(F.col("VIS"), "999999", 1).alias("vis"), scaled(F.col("SLP"), "99999", 10).alias("slp"), hourly_rain(F.col("AA1"), F.col("AA2"), F.col("AA3")).alias("rain"),
    )
    return rows.groupBy("day").agg(
        F.avg("t").alias("temperature"), F.min("t").alias("temperature_min"), F.max("t").alias("temperature_max"), F.avg("dew").alias("dew_point"), F.avg("wind").alias("wind"),
        F.avg("vis").alias("visibility"), F.avg("slp").alias("pressure"), F.count("*").alias("observations"), F.sum("rain").alias("rain"),
    )


def station_lines(spark: SparkSession, path: str, fields: dict[str, int], missing: float = -9.0) -> DataFrame:
    """Lines of fields between white space or commas by place, lines that start with # left out; ``missing`` is null."""
    lines = spark.read.text(path).where(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    parts = F.split(F.trim("value"), r"[,\s]+")
    number = lambda i: F.nullif(F.get(parts, F.lit(i)).try_cast("double"), F.lit(missing))
    return lines.select(*(F.get(parts, F.lit(i)).alias(n) if n in ("day", "station") else number(i).alias(n) for n, i in fields.items()))


def quarterly_weather(days: DataFrame, sums: list[str], means: list[str]) -> DataFrame:
    """Per quarter of ``day``: sums and means of the named columns that are there, and each sum a day of the quarter."""
    from quillmart.functions.columns import quarter_days, quarter_of

    have = [c for c in sums if c in days.columns]
    out = days.groupBy(quarter_of(F.col("day")).alias("quarter")).agg(*(F.sum(c).alias(c) for c in have), *(F.avg(c).alias(c) for c in means if c in days.columns), F.count("*").alias("days"))
    return out.withColumns({f"{c}_a_day": F.col(c) / quarter_days(F.col("quarter")) for c in have})


def find_rows(payload: object) -> list[dict]:
    """The first list of objects below item, row, rows, data or list, however deep; an object with one counts as a list of one."""
    queue = [payload]
    while queue:
        at = queue.pop(0)
        if isinstance(at, list) and at and all(isinstance(x, dict) for x in at):
            return at
        if isinstance(at, dict):
            for name in ("item", "row", "rows", "data", "list"):
                inner = at.get(name)
                if isinstance(inner, dict) and not any(isinstance(v, dict | list) for v in inner.values()):
                    return [inner]
                if isinstance(inner, list) and inner and all(isinstance(x, dict) for x in inner):
                    return inner
            queue += [v for v in at.values() if isinstance(v, dict | list)]
    return []


def documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, one a file, with each file's path as ``file``."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_path"))


def xml_rows(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("rowTag", tag).xml(path)


def passages(spark: SparkSession, chunks: str, vectors: str, key: str) -> DataFrame:
    """Chunk rows (JSON lines) with their vectors (Parquet) by key; an error unless each has the other."""
    rows, v = spark.read.json(chunks), spark.read.parquet(vectors)
    n, m, both = rows.count(), v.count(), rows.join(v.select(key), key).count()
    if not n == m == both:
        raise InputError(f"{n} chunks, {m} vectors, {both} of them by the same key")
    return rows.join(v, key)


# a paged service: quarters dealt over a few partitions, pages until a short one


class QuarterPartition(InputPartition):
    def __init__(self, quarters: list[str]):
        self.quarters = quarters


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.url, self.size, self.names = options["url"], int(options.get("pagesize", "1000")), schema.fieldNames()
        self.quarters = [q for q in options.get("quarters", "").split(",") if q] or [""]
        self.parallel = int(options.get("parallel", "5"))

    def partitions(self) -> list[QuarterPartition]:
        return [QuarterPartition(self.quarters[i :: self.parallel]) for i in range(min(self.parallel, len(self.quarters)))]

    def read(self, partition: QuarterPartition) -> Iterator[tuple]:
        for quarter in partition.quarters:
            yield from self._pages(quarter)

    def _pages(self, quarter: str) -> Iterator[tuple]:
        start = 1
        while True:
            url = self.url.format(start=start, end=start + self.size - 1, page=(start - 1) // self.size + 1, quarter=quarter)
            with urlopen(url) as answer:
                rows = find_rows(json.load(answer))
            for r in rows:
                yield tuple(None if r.get(n) is None else str(r.get(n)) for n in self.names)
            if len(rows) < self.size:
                return
            start += self.size


class Paged(DataSource):
    """``spark.read.format("paged")``: a service that answers pages of rows in JSON.

    Options: ``url`` with {start}, {end}, {page} and {quarter}, ``pagesize``, ``quarters`` (comma-separated), ``parallel``,
    the requests at a time (5): quarters are dealt over so many partitions. All columns are text, as services send them; cast them afterwards. Register with ``spark.dataSource.register``.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        raise InputError("give a schema: all columns text")

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(self.options, schema)


def cached_quarters(spark: SparkSession, path: str, quarters: list[int], fetch: Callable[[list[int]], DataFrame]) -> DataFrame:
    """The rows of ``quarters``, the cache at ``path`` first: only what it lacks is fetched, and the newest quarter always, as it may still grow.

    ``fetch`` gives rows with ``quarter``; fetched quarters but the newest are added to the cache, a folder each, an
    empty one too. A quarter that is fetched again replaces its folder.
    """
    newest = max(quarters)
    folders = {q: f"{path.rstrip('/')}/quarter={q}" for q in quarters if q != newest}
    at = lambda name: spark._jvm.org.apache.hadoop.fs.Path(name)
    files = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    lacking = [q for q, folder in folders.items() if not files.exists(at(f"{folder}/_SUCCESS"))]
    fresh = stored(fetch([*lacking, newest]), "quarters")
    for q in lacking:
        fresh.where(F.col("quarter") == q).drop("quarter").write.mode("overwrite").parquet(folders[q])
    kind = fresh.schema["quarter"].dataType
    bare = fresh.drop("quarter").schema
    old = [spark.read.schema(bare).parquet(folder).withColumn("quarter", F.lit(q).cast(kind)) for q, folder in folders.items() if q not in lacking]
    return reduce(lambda a, b: a.unionByName(b), old, fresh)


#: The services' names, and the fields of each with the names and types they get here.
SERVICES: dict[str, tuple[str, dict[str, str]]] = {
    "sales": ("VwsmTrdarSelngQq", {"STDR_YYQU_CD": "quarter int", "TRDAR_CD": "district long", "TRDAR_SE_CD_NM": "district_type string", "SVC_INDUTY_CD": "industry string", "SVC_INDUTY_CD_NM": "industry_name string", "THSMON_SELNG_AMT": "sales double", "THSMON_SELNG_CO": "txns long"}),
    "stores": ("VwsmTrdarStorQq", {"STDR_YYQU_CD": "quarter int", "TRDAR_CD": "district long", "SVC_INDUTY_CD": "industry string", "STOR_CO": "stores long"}),
    "foot_traffic": ("VwsmTrdarFlpopQq", {"STDR_YYQU_CD": "quarter int", "TRDAR_CD": "district long", "TOT_FLPOP_CO": "traffic double"}),
    "residents": ("VwsmTrdarRepopQq", {"STDR_YYQU_CD": "quarter int", "TRDAR_CD": "district long", "TOT_REPOP_CO": "residents double"}),
    "workers": ("VwsmTrdarWrcPopltnQq", {"STDR_YYQU_CD": "quarter int", "TRDAR_CD": "district long", "TOT_WRC_POPLTN_CO": "workers double"}),
    "events": ("culturalEventInfo", {"CODENAME": "kind string", "TITLE": "name string", "STRTDATE": "start date", "END_DATE": "end date", "LAT": "lat double", "LOT": "lon double"}),
    "stations": ("TaimsKsccDvSubwayStationGeom", {"stnKrNm": "station string", "convX": "x double", "convY": "y double"}),
    "big_stores": ("LOCALDATA_082501", {"APVPERMYMD": "opened date", "DCBYMD": "closed date", "X": "x double", "Y": "y double"}),
    "districts": ("TbgisTrdarRelm", {"TRDAR_CD": "district long", "TRDAR_CD_NM": "name string", "TRDAR_SE_CD_NM": "district_type string", "XCNTS_VALUE": "x double", "YDNTS_VALUE": "y double", "RELM_AR": "area double"}),
}


def service_schema(service: str) -> str:
    """The schema to read a service's text fields with."""
    return ", ".join(f"`{field}` string" for field in SERVICES[service][1])


def service_rows(raw: DataFrame, service: str) -> DataFrame:
    """A service's text fields under their names and types here; what can't be cast is null, a missing field is null."""
    there = {c.lower(): c for c in raw.columns}
    text_of = lambda field: F.trim(F.col(f"`{there[field.lower()]}`")) if field.lower() in there else F.lit(None).cast("string")

    def one(field: str, kind: str) -> Column:
        text = text_of(field)
        if kind == "date":
            return F.coalesce(F.substring(text, 1, 10).try_cast("date"), F.try_to_timestamp(F.substring(text, 1, 8), F.lit("yyyyMMdd")).cast("date"))
        return text.try_cast(kind)

    return raw.select(*(one(field, kind).alias(name) for field, (name, kind) in ((f, v.split()) for f, v in SERVICES[service][1].items())))


def quarter_codes(spark: SparkSession, first: int, last: int) -> DataFrame:
    """Every quarter code from ``first`` to ``last``."""
    from quillmart.functions.columns import code_of

    a, b = (c // 10 * 4 + c % 10 - 1 for c in (first, last))
    return spark.range(a, b + 1).select(code_of(F.col("id")).alias("quarter"))


def latest_codes(last: int, n: int = 4) -> list[int]:
    serial = last // 10 * 4 + last % 10 - 1
    return [(s // 4) * 10 + s % 4 + 1 for s in range(serial - n + 1, serial + 1)]


def lookup(df: DataFrame, code: str, name: str) -> DataFrame:
    """Distinct codes, each with its least name, by name."""
    return df.where(F.col(code).isNotNull()).groupBy(code).agg(F.min(name).alias(name)).orderBy(name, code)


def nested(df: DataFrame, group: str, *columns: str) -> DataFrame:
    """One row a group with its distinct members as a sorted array of structs."""
    return df.groupBy(group).agg(F.array_sort(F.collect_set(F.struct(*columns))).alias("members"))
