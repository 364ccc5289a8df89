"""Structured Streaming: windowed counts, idempotent delivery, model statistics kept up to date, running totals by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmart.operators.storage import shared_path


def files(spark: SparkSession, folder: str, name: str, schema: str, per_batch: int = 1) -> DataFrame:
    """A stream of the Parquet files in ``folder`` whose name matches."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", per_batch).parquet(folder)


def tumbling(events: DataFrame, at: str, by: list[str], length: str, delay: str) -> DataFrame:
    """Counts and sums of ``value`` per window; rows later than ``delay`` behind the newest are late."""
    w = F.window(at, length)
    return events.withWatermark(at, delay).groupBy(w, *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "total")


def sliding(events: DataFrame, at: str, by: list[str], length: str, step: str, delay: str) -> DataFrame:
    w = F.window(at, length, step)
    return events.withWatermark(at, delay).groupBy(w, *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n")


def sessions(events: DataFrame, at: str, by: list[str], gap: str, delay: str) -> DataFrame:
    w = F.session_window(at, gap)
    return events.withWatermark(at, delay).groupBy(w, *by).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "n")


def once(events: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """Each key's first row; state is kept for ``delay``, so it stays bounded."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def collected(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there, into Parquet with its own checkpoint, and read the result."""
    spark = stream.sparkSession
    path = shared_path(spark, name)
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}-state").option("path", path).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def each_batch(stream: DataFrame, act: Callable[[DataFrame, int], None], name: str, mode: str = "append") -> None:
    """Run a stream over what is there, handing each batch on; a batch may come again after a failure, under the same number."""
    path = shared_path(stream.sparkSession, name)
    stream.writeStream.foreachBatch(act).outputMode(mode).option("checkpointLocation", path).trigger(availableNow=True).start().awaitTermination()


class ArmStatistics:
    """Moments per arm that batches of a decision log are added to, each batch once.

    Batches' moments are kept as rows under their number, so a batch that comes again replaces itself; the model is
    their sum.
    """

    def __init__(self, spark: SparkSession, context: list[str]):
        self.spark, self.context, self.path, self.seen = spark, context, shared_path(spark, "arms"), 0

    def __call__(self, batch: DataFrame, number: int) -> None:
        from quillmart.operators.policy import arm_moments

        arm_moments(batch, self.context, ["arm"]).write.mode("overwrite").parquet(f"{self.path}/batch={number}")
        self.seen += 1

    def total(self) -> DataFrame:
        rows = self.spark.read.option("basePath", self.path).parquet(f"{self.path}/batch=*")
        return rows.groupBy("arm").agg(*(F.sum(c).alias(c) for c in rows.columns if c not in ("arm", "batch")))


def running_totals(events: DataFrame, key: str) -> DataFrame:
    """(key, n, total) of the keys each batch has touched, after it; for update mode, state kept per key without bound in time.

    ``events`` has ``value``. A batch's rows are summed before they are shuffled.
    """
    return events.groupBy(F.col(key).cast("string").alias(key)).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("value").cast("double")), F.lit(0.0)).alias("total"))
