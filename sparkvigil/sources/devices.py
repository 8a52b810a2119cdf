"""Job stderr, GPU snapshots and fabric ports: scans that carry state from line to line as running windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.validate import registered_only

# Patterns of job stderr and its location.
STDERR_PATH = r"^\s*StdErr=(\S+)\s*$"
NCCL_INIT = r"NCCL INFO comm \S+ rank (\d+) nranks (\d+).*commId (\S+)"
NCCL_TIMEOUT = r"(?:\[rank(\d+)\][:\s].*)?Watchdog caught collective operation timeout: WorkNCCL\(.*?OpType=(\w+).*?Timeout\(ms\)=(\d+)"
CUDA_SHORT = r"CUDA driver version is insufficient for CUDA runtime version"
CUDA_MODULE = r"(?i)\bcuda[/-](\d+\.\d+)"
# Patterns of a GPU snapshot.
SMI_TIME = r"^(\w{3})\s+(\w{3})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})\s+(\d{4})"
SMI_VERSIONS = r"Driver Version:\s*([\d.]+)\s+CUDA Version:\s*([\d.]+)"
SMI_DEVICE = r"^\|\s+(\d+)\s+(.*?)\s{2,}(?:On|Off)\s+\|\s+([0-9A-Fa-f]{8}:[0-9A-Fa-f]{2}:[0-9A-Fa-f]{2}\.[0-9A-Fa-f])"
SMI_USE = r"\|\s+(\d+)MiB\s*/\s*(\d+)MiB\s+\|\s+(\d+)%"


def stderr_path(lines: DataFrame) -> DataFrame:
    """path, stderr of job descriptions that name one."""
    return lines.filter(F.col("line").rlike(STDERR_PATH)).select("path", F.regexp_extract("line", STDERR_PATH, 1).alias("stderr"))


def stderr_events(lines: DataFrame, jobs: DataFrame, cluster: str) -> DataFrame:
    """Events of job stderr. jobs: path, jobid, at (the job's last accounting time, the only clock there is), node.

    A collective timeout takes size and id of its rank's last communicator seen before it; a runtime mismatch takes
    the first runtime version seen so far.
    """
    line = F.col("line")
    init, late, short = line.rlike(NCCL_INIT), line.rlike(NCCL_TIMEOUT), line.rlike(CUDA_SHORT)
    rank = F.when(init, F.regexp_extract(line, NCCL_INIT, 1)).when(late, F.regexp_extract(line, NCCL_TIMEOUT, 1))
    file = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.filter(init | late | short | line.rlike(CUDA_MODULE)).select(
        "path", "line_no", F.when(init, "init").when(late, "late").when(short, "short").otherwise("cuda").alias("is"), rank.alias("rank"),
        F.when(init, F.struct(F.regexp_extract(line, NCCL_INIT, 2).alias("world"), F.regexp_extract(line, NCCL_INIT, 3).alias("comm"))).alias("init"),
        F.when(late, F.regexp_extract(line, NCCL_TIMEOUT, 2)).alias("op"), F.when(late, F.regexp_extract(line, NCCL_TIMEOUT, 3)).alias("ms"),
        F.when(~init & line.rlike(CUDA_MODULE), F.regexp_extract(line, CUDA_MODULE, 1)).alias("cuda"),
    )
    seen = rows.withColumn("known", F.last("init", ignorenulls=True).over(Window.partitionBy("path", "rank").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))).withColumn("version", F.first("cuda", ignorenulls=True).over(file))
    late, name = F.col("is") == "late", F.when(F.col("is") == "late", "fabric.nccl_timeout").otherwise("gpu.driver_mismatch")
    attrs = F.create_map(
        F.lit("rank"), F.when(late, F.col("rank")), F.lit("op"), F.col("op"), F.lit("timeout_seconds"), S.ms_to_seconds(F.col("ms")), F.lit("world_size"), F.when(late, F.col("known.world")),
        F.lit("comm"), F.when(late, F.col("known.comm")), F.lit("cuda_version"), F.when(~late, F.col("version")),
    )
    found = seen.filter(F.col("is").isin("late", "short")).join(jobs.select("path", "jobid", "at", "node"), "path")
    signature = F.when(late, "nccl.watchdog.collective_timeout").otherwise("cuda.runtime.driver_insufficient")
    return found.select(
        F.col("at").alias("ts"), F.lit(cluster).alias("cluster"), "node", "jobid", F.lit("slurm").alias("source"), name.alias("class"),
        F.struct(signature.alias("signature"), registered_only(name, attrs).alias("attrs")).alias("detail"), F.col("line_no").alias("ordinal"),
    )


def snapshots(lines: DataFrame, zone: str = "UTC") -> tuple[DataFrame, DataFrame]:
    """GPU snapshots by file: (path, ts, driver, cuda, gpu_index of the first device) and devices (path, nr, index,
    pci, used, total, util). A use line belongs to the device before it; ts is null without a time."""
    line = F.col("line")
    g = lambda p, n: F.when(line.rlike(p), F.regexp_extract(line, p, n))
    device = line.rlike(SMI_DEVICE)
    file = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    when = S.nonempty(F.concat_ws(" ", *[g(SMI_TIME, n) for n in (2, 3, 5, 4)]))
    ts = F.to_utc_timestamp(F.try_to_timestamp(when, F.lit("MMM d yyyy HH:mm:ss")), zone)
    rows = lines.select(
        "path", "line_no", ts.alias("ts"), g(SMI_VERSIONS, 1).alias("driver"), g(SMI_VERSIONS, 2).alias("cuda"), g(SMI_DEVICE, 1).alias("index"), F.lower(g(SMI_DEVICE, 3)).alias("pci"),
        *[F.when(~device, g(SMI_USE, n)).alias(k) for n, k in enumerate(("used", "total", "util"), 1)],
    ).withColumn("nr", F.count("index").over(file))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("line_no"))).alias(c)
    files = rows.groupBy("path").agg(first("ts"), first("driver"), first("cuda"), F.coalesce(F.min_by("index", F.when(F.col("index").isNotNull(), F.col("line_no"))), F.lit("0")).alias("gpu_index"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line_no"))).alias(c)
    devices = rows.filter("nr > 0").groupBy("path", "nr").agg(F.max("index").alias("index"), F.max("pci").alias("pci"), last("used"), last("total"), last("util"))
    return files, devices


def gpu_events(lines: DataFrame, cluster: str, host: str, zone: str = "UTC") -> DataFrame:
    """A driver under the least one of its runtime, and devices that hold half their memory at no use."""
    files, devices = snapshots(lines, zone)
    files = files.filter("ts is not null")
    old = files.filter(S.driver_too_old(F.col("driver"), F.col("cuda")))
    attrs = F.create_map(F.lit("gpu_index"), F.col("gpu_index"), F.lit("driver_version"), F.col("driver"), F.lit("cuda_version"), F.col("cuda"), F.lit("expected_driver_version"), S.lookup(S.MIN_DRIVER, F.col("cuda")))
    none = F.lit(None).cast("struct<raw:string,base:decimal(20,0),array_task:bigint,array_range:string,het_offset:bigint,step:string>").alias("jobid")

    def event(name: str, signature: str, attrs, order) -> list:
        return ["ts", F.lit(cluster).alias("cluster"), F.lit(host).alias("node"), none, F.lit("gpu").alias("source"), F.lit(name).alias("class"), F.struct(F.lit(signature).alias("signature"), attrs.alias("attrs")).alias("detail"), order.cast("long").alias("ordinal")]

    number = lambda c: F.col(c).try_cast("long")
    idle = devices.filter(S.allocated_but_idle(number("used"), number("total"), number("util"))).join(files.select("path", "ts"), "path")
    severity = F.create_map(F.lit("severity"), F.lit("warn"))
    return old.select(*event("gpu.driver_mismatch", "nvidia.driver.runtime_version_mismatch", attrs, F.lit(0))).unionByName(idle.select(*event("unknown", "nvidia.smi.allocated_but_idle", severity, F.col("nr"))))


def ports(lines: DataFrame) -> DataFrame:
    """path, nr, device, number, state, phys_state, rate, link_layer, id, healthy, summary of fabric ports."""
    line = S.strip("line")
    file = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    ca, port = line.startswith("CA '"), line.startswith("Port ") & line.endswith(":")
    value = lambda k: F.when(line.startswith(k + ":"), S.strip(F.substring_index(line, k + ":", -1)))
    rows = lines.select(
        "path", "line_no", F.when(ca, F.regexp_replace(F.regexp_replace(line, "^CA ", ""), "^'+|'+$", "")).alias("ca"), F.when(port, S.strip(F.regexp_replace(F.regexp_replace(line, "^Port ", ""), ":$", ""))).alias("port"),
        F.when(ca | port, F.col("line_no")).alias("head"), *[value(k).alias(c) for k, c in (("State", "state"), ("Physical state", "phys_state"), ("Rate", "rate"), ("Link layer", "link_layer"))],
    )
    carried = rows.withColumns({"device": F.coalesce(F.last("ca", ignorenulls=True).over(file), F.lit("")), "nr": F.last("head", ignorenulls=True).over(file), "number": F.col("port")})
    last = lambda c: F.coalesce(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line_no"))), F.lit("")).alias(c)
    found = carried.filter("nr is not null").groupBy("path", "nr").agg(F.max("device").alias("device"), F.max("number").alias("number"), *[last(c) for c in ("state", "phys_state", "rate", "link_layer")]).filter("number is not null")
    return found.withColumns({
        "id": F.concat_ws(":", "device", "number"), "healthy": F.lower("state") == "active",
        "summary": F.concat(S.strip(F.concat_ws(" ", "state", "phys_state")), F.when(F.col("rate") != "", F.concat(F.lit(" "), "rate")).otherwise("")),
    })


def down_ports(found: DataFrame) -> DataFrame:
    return found.filter("not healthy").orderBy("path", "id")


def fabric_capability(found: DataFrame) -> DataFrame:
    """Port state is reported as a capability; it gives no events."""
    return found.groupBy("path").agg(F.lit("fabric").alias("source"), F.lit("ibstat").alias("name"), F.lit("unprivileged").alias("level"), F.lit(True).alias("available"), F.concat(F.count("*").cast("string"), F.lit(" port(s), "), F.count_if(~F.col("healthy")).cast("string"), F.lit(" down")).alias("detail"))
