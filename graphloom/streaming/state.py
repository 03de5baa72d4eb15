"""Operators over logs of events. Those on windows work on streams as they do on batches; streams drop what is later than the watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The order of health states, worst last.
SEVERITY = ("healthy", "degraded", "down")


def job_status(log: DataFrame) -> DataFrame:
    """job_id, status, processed, failed: the last entry of each job (job_id, seq, status, processed, failed)."""
    return log.groupBy("job_id").agg(F.max_by(F.struct("status", "processed", "failed"), "seq").alias("s")).select("job_id", "s.*")


def to_resume(entries: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """Entries whose locator no checkpoint has as processed (locator, state)."""
    return entries.join(checkpoint.filter("state = 'processed'").select("locator"), "locator", "left_anti")


def live_entries(cache: DataFrame, now: Column) -> DataFrame:
    """The last entry of each key that has not expired; an entry without a valid expiry has."""
    last = cache.groupBy("key").agg(F.max_by(F.struct("data", "expires_at"), "created_at").alias("e")).select("key", "e.*")
    return last.filter(F.coalesce(F.col("expires_at") > now, F.lit(False)))


def request_counts(events: DataFrame, key: str = "user_id", at: str = "ts", width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """key, minute, n: requests in fixed windows; the watermark bounds the state of a stream."""
    return events.withWatermark(at, late).groupBy(key, F.window(at, width).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("minute"), "n")


def over_limit(counts: DataFrame, limits: DataFrame, default: int, key: str = "user_id") -> DataFrame:
    """Windows with more requests than the key's limit (key, most), else the default: with the number refused."""
    most = F.coalesce("most", F.lit(default))
    return counts.join(limits, key, "left").withColumn("refused", F.greatest(F.lit(0), F.col("n") - most)).filter("refused > 0").drop("most")


def first_in_time(events: DataFrame, keys: list[str], at: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Events without repetitions of their keys within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def access_summary(events: DataFrame, *by: str) -> DataFrame:
    """Requests, errors, mean and 95th percentile of latency (value) by day and the given columns."""
    return events.groupBy(F.to_date("ts").alias("day"), *by).agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("event_type") == "error").alias("errors"), F.avg("value").alias("latency"), F.percentile("value", 0.95).alias("p95"))


def health(checks: DataFrame, by: str) -> DataFrame:
    """The worst state of each group (by, state)."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITY)), F.col("state"))
    return checks.groupBy(by).agg(F.max_by("state", rank).alias("state"))


def run_to_completion(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Writes what a stream has now to Parquet, in order of arrival, and stops."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream over a folder of event files."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
