"""The evidence view over the driver's events table, and captures made from it, in SQL that both engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import attrs_key, format_time

#: source, class and signature of each event_type.
KINDS = {
    "error": ("journal", "resource.oom", "kernel.oom.invoked"),
    "purchase": ("slurm", "app.nonzero_exit", "slurm.sacct.state.FAILED"),
    "click": ("fabric", "fabric.link_flap", "mlx5.ib_event.link_down"),
    "view": ("gpu", "unknown", "nvidia.smi.allocated_but_idle"),
    "signup": ("journal", "config.clock_skew", "chrony.system_clock_wrong"),
}


def _case(j: int) -> str:
    return "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v[j]}'" for k, v in KINDS.items()) + " END"


NODE = "CASE WHEN event_id % 11 = 0 THEN '' ELSE concat('node-', lpad(CAST(user_id % 16 AS STRING), 4, '0')) END"
JOB = "CASE WHEN event_type IN ('error', 'purchase') THEN user_id * 100 + day(ts) END"
SEVERITY = "CASE WHEN value >= 100 THEN 'error' WHEN value >= 20 THEN 'warn' ELSE 'info' END"
STATE = "concat('S', CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 3 AS STRING))"

#: The view in DuckDB SQL.
EV = f"""ev AS (
  SELECT event_id, ts, 'cluster-a' AS cluster, {NODE} AS node, {JOB} AS job, {_case(0)} AS source, {_case(1)} AS class, {_case(2)} AS signature,
    concat('{{"severity":"', {SEVERITY}, '","state":"', {STATE}, '"}}') AS attrs_key, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '000Z' AS ts_text, event_id AS ordinal
  FROM events
)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A small input, which may be one split, dealt to all cores for work on each row; a large one as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    stored = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if stored < cores * SPLIT_BYTES else df


#: Bytes under which a split isn't worth a task of its own.
SPLIT_BYTES = 32 << 20


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the event schema, with event_id as their input position."""
    e = table(spark, sf_dir, "events")
    job = F.expr(JOB).cast("decimal(20,0)")
    none = F.lit(None)
    jobid = F.when(job.isNotNull(), F.struct(
        job.cast("string").alias("raw"), job.alias("base"), none.cast("long").alias("array_task"), none.cast("string").alias("array_range"), none.cast("long").alias("het_offset"), none.cast("string").alias("step"),
    ))
    attrs = F.create_map(F.lit("severity"), F.expr(SEVERITY), F.lit("state"), F.expr(STATE))
    return e.select(
        F.col("ts").cast("timestamp").alias("ts"), F.lit("cluster-a").alias("cluster"), F.expr(NODE).alias("node"), jobid.alias("jobid"), F.expr(_case(0)).alias("source"), F.expr(_case(1)).alias("class"),
        F.struct(F.expr(_case(2)).alias("signature"), attrs.alias("attrs")).alias("detail"), F.col("event_id").alias("ordinal"),
    )


def ts_text(col: str = "ts"):
    return format_time(F.col(col))


def key_of():
    return attrs_key(F.col("detail")["attrs"])
