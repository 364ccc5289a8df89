"""Helpers shared by the operators: scratch tables, components of a link graph."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: list[tuple[str, str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder named by ``spark.checkpoint.dir``.

    Where that setting is empty and Spark runs on this machine alone (tests, a laptop) a temporary folder is made and
    set for the session; on a cluster, whose machines don't share such a folder, it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quillmart-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append(("path", path))
    return path


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go with the end of each write: nothing reads them again."""
    before = spark.conf.get(_TIDY, "false")
    spark.conf.set(_TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(_TIDY, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: the lineage ends at files that outlive executors."""
    path = scratch(df.sparkSession, name)
    with tidy(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` written in the shared folder as a table bucketed by ``column``, so that later joins on it don't move its rows."""
    spark = df.sparkSession
    n, path = int(spark.conf.get("spark.sql.shuffle.partitions")), scratch(spark, name)
    table = f"{name}_{path.rpartition('-')[2]}"
    with tidy(spark):
        df.repartition(n, column).write.bucketBy(n, column).option("compression", "zstd").option("path", path).saveAsTable(table)
    _made.append(("table", table))
    return spark.table(table)


def told_apart(rows: DataFrame, key: str, number: str) -> tuple[DataFrame, bool]:
    """``rows`` with a column that numbers, from 0, the rows of each ``key`` that isn't null; and whether any key repeats.

    Where none does the number is 0 and no row moves. Else the rows are stored first, so that each keeps its place, and
    rows of a repeated key are numbered within each partition they were read in, after those of the partitions before:
    no key's rows meet in one task.
    """
    repeated = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key)
    if repeated.isEmpty():
        return rows.withColumn(number, F.lit(0).cast("long")), False
    kept = stored(rows.withColumn("_m", F.monotonically_increasing_id()), "rows")
    some = kept.select(key, "_m", F.shiftright("_m", 33).alias("_p")).join(repeated, key, "left_semi")
    before = Window.partitionBy(key).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    first = some.groupBy(key, "_p").agg(F.count("*").alias("_c")).select(key, "_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_f"))
    within = F.row_number().over(Window.partitionBy(key, "_p").orderBy("_m")) - 1
    place = some.withColumn("_w", within).join(first, [key, "_p"]).select(key, "_m", (F.col("_f") + F.col("_w")).cast("long").alias(number))
    return kept.join(place, [key, "_m"], "left").withColumn(number, F.coalesce(number, F.lit(0))).drop("_m"), True


def release(spark: SparkSession) -> None:
    """Delete the scratch folders and tables of this process; results that still read them must have been written."""
    while _made:
        kind, name = _made.pop()
        if kind == "table":
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        else:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(name: str, taken: Iterable[str]) -> str:
    """``name``, with as many underscores more as keep it apart from the names ``taken``, whatever their case."""
    taken = {c.lower() for c in taken}
    while name.lower() in taken:
        name += "_"
    return name


def given_back() -> None:
    """Inside a task: memory that is free but kept by the worker's allocators goes back to the system.

    Workers serve one stage after another, and each leaves its free pages scattered among what stays.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()


def text_of(column: str = "text"):
    """The text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` by alternating large and small stars.

    Returns ``(node, component)`` for every node with an edge to another one, ``component`` being the smallest
    node reachable. Self loops and null ends are ignored. Each round shuffles the current edges once or twice,
    is written to the shared folder, and pointers double, so rounds grow with the logarithm of the diameter; if
    ``rounds`` don't suffice it is an error, never a partial result. Rows of one node are never gathered: minima and
    joins are the only operations.
    """
    e = (
        edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    e = stored(e, "links")
    last = None
    for _ in range(rounds):
        # large star: every larger neighbour of u is linked to the smallest node around u
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: u and its smaller neighbours are linked to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        e = stored(small.where("u <> v").distinct(), "links")
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
