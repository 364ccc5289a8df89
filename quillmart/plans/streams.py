"""Structured Streaming over the events file: the stream reads what is there and ends."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmart.plans.registry import query
from quillmart.sources.tables import Tables
from quillmart.streaming import keyed, windows

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def _stream(t: Tables) -> DataFrame:
    return windows.files(t.spark, t.path, "events.parquet", SCHEMA)


@query(
    """WITH m AS (SELECT max(ts) - INTERVAL 1 HOUR AS w FROM events) SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS "end", event_type, CAST(count(*) AS BIGINT) AS n, sum(value) AS total FROM events
GROUP BY 1, 2, 3 HAVING time_bucket(INTERVAL 1 DAY, any_value(ts)) + INTERVAL 1 DAY <= (SELECT w FROM m)""",
    "total",
)
def stream_tumbling(t: Tables) -> DataFrame:
    """Daily counts by type, each once the watermark has passed its day."""
    return windows.collected(windows.tumbling(_stream(t), "ts", ["event_type"], "1 day", "1 hour"), "tumbling")


@query(
    """WITH m AS (SELECT max(ts) - INTERVAL 1 HOUR AS w FROM events), s AS (SELECT event_type, time_bucket(INTERVAL 12 HOUR, ts) - k * INTERVAL 12 HOUR AS start FROM events, (SELECT unnest([0, 1]) AS k))
SELECT start, start + INTERVAL 1 DAY AS "end", event_type, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY ALL HAVING start + INTERVAL 1 DAY <= (SELECT w FROM m)"""
)
def stream_sliding(t: Tables) -> DataFrame:
    return windows.collected(windows.sliding(_stream(t), "ts", ["event_type"], "1 day", "12 hours", "1 hour"), "sliding")


@query(
    """WITH m AS (SELECT max(ts) - INTERVAL 1 HOUR AS w FROM events), g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", user_id, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT w FROM m)"""
)
def stream_sessions(t: Tables) -> DataFrame:
    return windows.collected(windows.sessions(_stream(t), "ts", ["user_id"], "6 hours", "1 hour"), "sessions")


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT event_id) AS BIGINT) AS ids FROM events")
def stream_once(t: Tables) -> DataFrame:
    """Events delivered twice come out once."""
    s = _stream(t)
    twice = s.select("event_id", "ts", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"))
    return windows.collected(windows.once(twice, "event_id", "ts", "1 hour").select("event_id", "ts"), "once").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


@query(
    """WITH l AS (SELECT event_type AS arm, value AS reward, (user_id % 10) / 10.0::DOUBLE AS x FROM events) SELECT arm, CAST(count(*) AS BIGINT) AS n, CAST(count(*) AS DOUBLE) AS a0_0, sum(x) AS a0_1, sum(x * x) AS a1_1, sum(reward) AS b0, sum(reward * x) AS b1 FROM l GROUP BY arm""",
    "a0_0 a0_1 a1_1 b0 b1",
)
def stream_arm_statistics(t: Tables) -> DataFrame:
    """A log appended file by file; each batch adds its moments once."""
    keep = windows.ArmStatistics(t.spark, ["x"])
    log = _stream(t).select(F.col("event_type").alias("arm"), F.col("value").alias("reward"), (F.col("user_id") % 10 / 10).alias("x"))
    windows.each_batch(log, keep, "arms-stream")
    return keep.total().select("arm", "n", "a0_0", "a0_1", "a1_1", "b0", "b1")


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n, sum(value) AS total FROM events GROUP BY event_type", "total")
def stream_running_totals(t: Tables) -> DataFrame:
    """State of one's own kept per key; the last update of each is its total."""
    path: list[DataFrame] = []

    def act(batch: DataFrame, number: int) -> None:
        from quillmart.operators.storage import stored

        path.append(stored(batch.withColumn("_batch", F.lit(number)), "totals"))

    windows.each_batch(windows.running_totals(_stream(t), "event_type"), act, "totals-stream", "update")
    out = path[0]
    for more in path[1:]:
        out = out.union(more)
    return out.groupBy("event_type").agg(F.max_by("n", F.struct("_batch", "n")).alias("n"), F.max_by("total", F.struct("_batch", "n")).alias("total"))


@query(
    """WITH l AS (SELECT event_type AS arm, value AS reward, (user_id % 10) / 10.0::DOUBLE AS x FROM events), s AS (SELECT arm, CAST(count(*) AS BIGINT) AS n, count(*) + 1.0 AS a, sum(x) AS b, sum(x * x) + 1.0 AS d, sum(reward) AS p, sum(reward * x) AS q FROM l WHERE reward IS NOT NULL AND x IS NOT NULL GROUP BY arm)
SELECT arm, n, (d * p - b * q) / (a * d - b * b) AS constant, (a * q - b * p) / (a * d - b * b) AS slope FROM s""",
    "constant slope",
)
def stream_arm_models(t: Tables) -> DataFrame:
    """Each arm's ridge model, kept in state and updated by the batch that brings its rows."""
    log = _stream(t).select(F.col("event_type").alias("arm"), F.col("value").alias("reward"), (F.col("user_id") % 10 / 10).alias("x"))
    m = keyed.latest_models(keyed.run(keyed.arm_models(log, ["x"]), "arm-models"))
    return m.select("arm", "n", F.col("theta")[0].alias("constant"), F.col("theta")[1].alias("slope"))


@query(
    """WITH m AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR AS w FROM events),
s AS (SELECT user_id, ts, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' ELSE 'done' END AS state FROM events WHERE ts <= (SELECT w FROM m)),
n AS (SELECT *, ts + CASE state WHEN 'queued' THEN INTERVAL 6 HOUR WHEN 'running' THEN INTERVAL 12 HOUR END AS failed, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, state) AS next FROM s)
SELECT CAST(user_id AS VARCHAR) AS job, state, ts AS since, failed FROM n WHERE failed <= (SELECT w FROM m) AND (next IS NULL OR next > failed)"""
)
def stream_stale_jobs(t: Tables) -> DataFrame:
    """Jobs that stayed queued for six hours or ran for twelve, each failed by its own timer."""
    state = F.when(F.col("event_type") == "view", "queued").when(F.col("event_type") == "click", "running").otherwise("done")
    return keyed.run(keyed.stale(_stream(t), "user_id", "ts", state, {"queued": 360, "running": 720}, "1 hour"), "stale-jobs")
