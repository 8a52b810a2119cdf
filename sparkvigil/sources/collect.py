"""All readers over one set of captures: events, what could and couldn't be read, and lines that weren't understood."""

from __future__ import annotations

import posixpath
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.jobid import parse_job_id
from ..operators import join, report
from . import accounting, captures, devices, logs

#: Daemon logs, which only privileged users can read as a rule.
DAEMON_LOGS = ("slurmd.log", "slurmctld.log")
#: What each capability tells; it is what a report names as lost without it.
REVEALS = {
    "sacct": "states, exit codes, limits and use of jobs", "job-stderr": "what the program itself wrote before it died", "journalctl": "kernel, device and fabric messages of a host",
    "nvidia-smi": "driver, runtime and use of devices", "ibstat": "state and rate of fabric ports", **{f"log:{n}": "node states and requeues as the daemon saw them" for n in DAEMON_LOGS},
}


class Collected(NamedTuple):
    """events of the event schema, capabilities (schema.CAPABILITY and cluster), warnings (source, warning)."""

    events: DataFrame
    capabilities: DataFrame
    warnings: DataFrame

    def staged(self, folder: str) -> Collected:
        """The same, written below a shared folder and read again, so that what follows doesn't plan and read it anew."""
        out = []
        for name, df in zip(self._fields, self, strict=True):
            df.write.mode("overwrite").parquet(f"{folder}/{name}")
            out.append(df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}"))
        return Collected(*out)


def collect(lines: DataFrame, cluster: str, host: str = "", zone: str = "UTC", job: int | None = None, cap: int = logs.LOG_CAP) -> Collected:
    """Reads the captures (path, name, line_no, line) of one host.

    The accounting table goes first: the job's own events in it bound what the other readers keep. Without a job, or if
    accounting doesn't know it, no window bounds the journal, and its last ``cap`` lines are read (0: all), which the
    capability says. A capture that isn't there is a capability that is missing, never an error. Only names of captures
    and the job's window come to the driver.
    """
    spark = lines.sparkSession
    there = [r["name"] for r in lines.select("name").distinct().orderBy("name").collect()]
    one = lambda name: lines.filter(F.col("name") == name)
    known: list[tuple] = []
    found: list[DataFrame] = []
    odd: list[DataFrame] = []

    def told(source: str, name: str, level: str, available: bool, detail: str = "") -> bool:
        known.append((source, name, level, available, detail if available or detail else "not captured", REVEALS[name]))
        return available

    def command(source: str, *words: str) -> DataFrame | None:
        name = captures.resolve(there, words[0], list(words[1:]))
        return one(name) if told(source, words[0], "unprivileged", name is not None) else None

    window = None
    table = command("slurm", "sacct")
    if table is not None:
        own, bad = accounting.events(table, cluster, zone)
        found.append(own)
        odd.append(bad.select(F.lit("slurm").alias("source"), F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(": "), "warning").alias("warning")))
        if job is not None:
            window = join.window_of(own, job)
            found += _stderr(lines, there, own, job, cluster, told)

    inside = (lambda e: e.filter(F.col("ts").between(F.lit(window[0]), F.lit(window[1])))) if window else (lambda e: e)
    whole = f"no window, so the last {cap} lines were read" if cap and not window else ""
    name = captures.resolve(there, "journalctl", [])
    text = []
    if told("journal", "journalctl", "unprivileged", name is not None, whole if name else ""):
        text.append(one(name) if window or not cap else logs.tail(one(name), cap))
    text += [one(log) for log in DAEMON_LOGS if told("journal", f"log:{log}", "privileged", log in there)]
    if text:
        events, bad = logs.events(reduce(DataFrame.unionByName, text), cluster, host, zone)
        found.append(inside(events))
        why = F.concat(F.col("n").cast("string"), F.lit(" times "), "kind", F.lit(", first in line "), F.col("first_line").cast("string"), F.lit(": "), "example")
        odd.append(bad.select(F.lit("journal").alias("source"), why.alias("warning")))

    smi = command("gpu", "nvidia-smi")
    if smi is not None:
        found.append(inside(devices.gpu_events(smi, cluster, host, zone)))
        timeless = devices.snapshots(smi, zone)[0].filter("ts is null")
        odd.append(timeless.select(F.lit("gpu").alias("source"), F.concat("path", F.lit(": no time, so no events")).alias("warning")))
    fabric = captures.resolve(there, "ibstat", [])
    if fabric is None:
        told("fabric", "ibstat", "unprivileged", False)
    caps = spark.createDataFrame(known, schema.CAPABILITY)
    if fabric is not None:
        seen = devices.fabric_capability(devices.ports(one(fabric))).select("source", "name", "level", "available", "detail", F.lit(REVEALS["ibstat"]).alias("reveals"))
        caps = caps.unionByName(seen)
    none = spark.createDataFrame([], schema.EVENT)
    warnings = spark.createDataFrame([], "source string, warning string")
    for more in odd:
        warnings = warnings.unionByName(more)
    return Collected(join.merge_events(none, *found), caps.withColumn("cluster", F.lit(cluster)), warnings)


def _stderr(lines: DataFrame, there: list[str], own: DataFrame, job: int, cluster: str, told) -> list[DataFrame]:
    """Events of the job's error output, at the job's last accounting time, which is the only clock it has."""
    described = captures.resolve(there, "scontrol", ["show", "job"])
    path = devices.stderr_path(lines.filter(F.col("name") == described)).first() if described else None
    name = posixpath.basename(path["stderr"]) if path else None
    detail = "" if name in there else "no job description names it" if name is None else f"{name} was not captured"
    if not told("slurm", "job-stderr", "unprivileged", name in there, detail):
        return []
    rows = lines.filter(F.col("name") == name)
    of_job = own.filter(F.col("jobid.base") == job).agg(F.max("ts").alias("at"), F.when(F.count_distinct("node") == 1, F.max("node")).alias("node")).filter("at is not null")
    paths = rows.select("path").distinct().withColumn("k", F.lit(1))
    jobs = paths.join(F.broadcast(of_job.withColumn("k", F.lit(1))), "k").select("path", parse_job_id(F.lit(str(job))).alias("jobid"), "at", "node")
    return [devices.stderr_events(rows, jobs, cluster)]


def context(spark: SparkSession, path: str | list[str], cluster: str, job: int, host: str = "", zone: str = "UTC", limit: int = 4000, profile: dict | None = None, stage: str = "") -> DataFrame:
    """From captures to one job's report: the lines of report.context_lines. A ``stage`` folder holds what was read."""
    got = collect(captures.read_lines(spark, path), cluster, host, zone, job)
    got = got.staged(stage) if stage else got
    odd = got.warnings.select(F.lit(cluster).alias("cluster"), F.lit(1).alias("n"))
    asked = spark.range(1).select(F.lit(cluster).alias("cluster"), F.lit(job).cast("decimal(20,0)").alias("job"))
    return report.context_lines(got.events, got.capabilities, odd, report.site_lines(profile or {}), limit, cluster_scope=True, jobs=asked)


def doctor(lines: DataFrame, cluster: str, host: str = "", zone: str = "UTC") -> DataFrame:
    """What the readers could see of one host's captures: the lines of report.doctor_lines."""
    got = collect(lines, cluster, host, zone)
    return report.doctor_lines(got.capabilities, got.events, got.warnings)
