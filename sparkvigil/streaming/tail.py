"""A growing log as a stream of events, counted in event-time windows and joined to job windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.join import AFTER, BEFORE
from ..sources.logs import classify, split_lines


def log_stream(spark: SparkSession, path: str, cluster: str, host: str = "", zone: str = "UTC", delay: str = "10 minutes") -> DataFrame:
    """Events of lines as files arrive; ones later than the delay behind the newest are dropped by what follows."""
    lines = spark.readStream.text(path).select(F.col("value").alias("line"), F.lit(None).cast("long").alias("line_no"))
    return classify(split_lines(lines, host, zone), cluster).drop("job_text").withWatermark("ts", delay)


def counts(events: DataFrame, window: str = "5 minutes") -> DataFrame:
    """Events of each class by window, node and cluster."""
    return events.groupBy(F.window("ts", window), "cluster", "node", "class").agg(F.count("*").alias("n"))


def evidence(jobs: DataFrame, loose: DataFrame, before: int = BEFORE, after: int = AFTER) -> DataFrame:
    """Node-scoped pairs of two streams: a job's own event (cluster, node, job, job_ts) and an event without a job on
    its node in reach of it. State is bounded by the watermarks and the interval."""
    a, b = jobs.alias("a"), loose.alias("b")
    reach = F.col("b.ts").between(F.col("a.job_ts") - F.expr(f"interval {before} seconds"), F.col("a.job_ts") + F.expr(f"interval {after} seconds"))
    return a.join(b, (F.col("a.cluster") == F.col("b.cluster")) & (F.col("a.node") == F.col("b.node")) & reach)
