"""Queries that run a stream over all rows there are, then read what it wrote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakequill.plans.catalog import Tables, query
from lakequill.streaming import ingest as S
from lakequill.streaming import paced as C


@query("""
WITH log AS (SELECT user_id, event_id, value, event_id % 2 AS part FROM events WHERE event_type IS DISTINCT FROM 'error'),
first AS (SELECT user_id, min(part) AS part FROM log GROUP BY 1)
SELECT l.user_id, max(l.event_id) AS event_id, arg_max(l.value, l.event_id) AS value FROM log l JOIN first f ON l.user_id = f.user_id AND l.part = f.part GROUP BY 1
""")
def ingested_log(t: Tables) -> DataFrame:
    """A log that comes in two files, the events of even and of odd ids: the first file that has a user settles it."""
    source, target, checkpoint = (t.scratch(f"ingest-{name}") for name in ("log", "rows", "state"))
    error = F.when(F.col("event_type") == "error", "error")
    log = t.events.select("user_id", "event_id", "value", F.lit("h").alias("config_hash"), error.alias("error"))
    schema = "user_id long, event_id long, value double, config_hash string, error string"
    for part in (0, 1):
        log.where(F.col("event_id") % 2 == part).write.mode("append").json(source)
        S.ingest(S.read_log_stream(t.spark, source, schema), target, checkpoint, ["user_id"], "event_id", "h").awaitTermination()
    return t.spark.read.parquet(target).select("user_id", "event_id", "value")


@query("""
WITH hours AS (SELECT event_type, date_trunc('hour', ts) AS h, sum((value > 20)::INT) AS successes, count(*) AS trials FROM events GROUP BY 1, 2)
SELECT event_type, strftime(h, '%Y-%m-%d %H:%M:%S') AS start, successes::BIGINT AS successes, trials FROM hours
WHERE h + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)
""")
def hourly_rates(t: Tables) -> DataFrame:
    """Rates by event type and hour; an hour is told once the watermark has passed its end."""
    source, target, checkpoint = (t.scratch(f"rates-{name}") for name in ("log", "rows", "state"))
    t.events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", (F.col("value") > 20).alias("high")).write.parquet(source)
    stream = t.spark.readStream.schema("ts timestamp, event_type string, high boolean").parquet(source)
    rates = S.windowed_rates(stream, "ts", "event_type", "high")
    rates.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(target).select("event_type", F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "successes", "trials")


def _in_two_parts(t: Tables, name: str, columns: str, rows: DataFrame, at: Column, run) -> DataFrame:  # noqa: ANN001
    """What run(stream) writes, started anew when the second half of the rows by time has come; state goes on from the checkpoint."""
    source, target, checkpoint = (t.scratch(f"{name}-{part}") for part in ("log", "rows", "state"))
    middle = F.to_timestamp(F.lit("2024-01-15 12:00:00"))
    with C.with_state(t.spark):
        for half in (at < middle, at >= middle):
            rows.where(half).write.mode("append").parquet(source)
            out = run(t.spark.readStream.schema(columns).parquet(source))
            out.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(target)


@query("""
WITH e AS (SELECT user_id AS key, event_id AS id, epoch_us(ts) // 1000 AS ms, CASE WHEN event_type = 'error' THEN event_id % 6 ELSE 0 END AS f FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms, id) AS i FROM e),
r AS (SELECT *, greatest(ms, max(ms - i * 28800000) OVER (PARTITION BY key ORDER BY ms, id) + (i - 1) * 28800000) AS released FROM n),
d AS (SELECT key, id, ms AS arrived, released, (least(f, 3) + 1)::INT AS attempts, f <= 3 AS ok, released + 60000 * ((1 << least(f, 3)::INT) - 1) AS done FROM r)
SELECT key, id, arrived, released::BIGINT AS released, attempts, ok, done::BIGINT AS done FROM d WHERE done <= (SELECT max(ms) - 600000 FROM e)
""")
def paced_calls(t: Tables) -> DataFrame:
    """Each user's events as calls of which two are free and one more each eight hours; errors fail up to five times, three retries."""
    failures = F.when(F.col("event_type") == "error", F.col("event_id") % 6).otherwise(0).cast("int")
    rows = t.events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), failures.alias("failures"))
    run = lambda s: C.paced(s, "ts", "user_id", "event_id", "failures", every=28_800_000, capacity=2, backoff=60_000, retries=3)
    return _in_two_parts(t, "paced", "user_id long, event_id long, ts timestamp, failures int", rows, F.col("ts"), run)


@query("""
WITH f AS (SELECT user_id, event_type, min(epoch_us(ts) // 1000) AS ms FROM events GROUP BY 1, 2)
SELECT user_id AS shard, count(*)::INT AS keys, max(ms) AS completed FROM f GROUP BY 1 HAVING count(*) = 5
""")
def complete_users(t: Tables) -> DataFrame:
    """A user is a shard of five parts, the types of events; it is given once all have come."""
    rows = t.events.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", F.lit(5).alias("expected"))
    run = lambda s: C.complete_shards(s, "ts", "user_id", "event_type", "expected")
    return _in_two_parts(t, "shards", "user_id long, ts timestamp, event_type string, expected int", rows, F.col("ts"), run)
