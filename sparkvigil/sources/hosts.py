"""Facts of hosts from small files and command output: site discovery and node profiles in long form."""

from __future__ import annotations

import json
import os
import re
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import scalars as S
from ..operators.sets import require_unique
from .devices import ports, snapshots

# Shared file systems that a profile records.
SHARED_FS = ("lustre", "gpfs", "nfs", "nfs4", "beegfs", "panfs", "ceph", "cephfs", "fhgfs", "weka", "wekafs", "daos")
BUILDERS = {"SPACK_ROOT": "spack", "EASYBUILD_INSTALLPATH": "easybuild"}
PROFILE_KEYS = (
    "cluster", "scheduler.kind", "scheduler.version", "scheduler.config_path", "scheduler.partitions", "scheduler.qos", "modules.kind", "modules.roots",
    "os.id", "os.version_id", "os.kernel_release", "os.glibc_version", "fabric.kind", "fabric.hcas", "gpu.vendor", "gpu.driver_version", "gpu.cuda_version",
    "gpu.models", "bmc.kind", "builders", "mounts",
)


def conf_value(lines: DataFrame, key: str) -> DataFrame:
    """host, value of ``Key=Value`` in a scheduler configuration: any case, comments stripped, the first one."""
    text = S.strip(F.substring_index("line", "#", 1))
    hit = F.lower(S.strip(F.substring_index(text, "=", 1))) == key.lower()
    found = lines.filter(text.contains("=") & hit).select("host", "line_no", S.strip(F.regexp_replace(text, "^[^=]*=", "")).alias("value"))
    return found.groupBy("host").agg(F.min_by("value", "line_no").alias("value"))


def release_value(lines: DataFrame, key: str) -> DataFrame:
    """host, value of an os-release key, without quotes."""
    found = lines.filter(S.strip("line").startswith(f"{key}=")).select("host", "line_no", F.regexp_replace(F.regexp_replace(S.strip("line"), "^[^=]*=", ""), "^[\"']+|[\"']+$", "").alias("value"))
    return found.groupBy("host").agg(F.min_by("value", "line_no").alias("value"))


def mounts(lines: DataFrame) -> DataFrame:
    """host, mountpoint, fs_type, source of shared file systems, the first of each mountpoint."""
    f = F.split(S.strip("line"), r"\s+")
    rows = lines.filter((F.size(f) >= 3) & F.get(f, F.lit(2)).isin(*SHARED_FS)).select("host", "line_no", S.unescape_mount(F.get(f, F.lit(1))).alias("mountpoint"), F.get(f, F.lit(2)).alias("fs_type"), S.unescape_mount(F.get(f, F.lit(0))).alias("source"))
    first = Window.partitionBy("host", "mountpoint").orderBy("line_no")
    return rows.withColumn("n", F.row_number().over(first)).filter("n = 1").select("host", "mountpoint", "fs_type", "source").orderBy("host", "mountpoint")


def _fact(df: DataFrame, key: str | Column, value: str | Column = "value") -> DataFrame:
    key = F.lit(key) if isinstance(key, str) else key
    value = F.col(value) if isinstance(value, str) else value
    return df.select("host", key.alias("key"), value.alias("value")).filter("coalesce(value, '') <> ''")


def _variables(lines: DataFrame) -> DataFrame:
    return lines.filter("name = 'environ.txt' and contains(line, '=')").select("host", F.substring_index("line", "=", 1).alias("var"), F.regexp_replace("line", "^[^=]*=", "").alias("value"))


def _file(lines: DataFrame, name: str) -> DataFrame:
    return lines.filter(F.col("name") == name)


# Captures that tell of a tool or a configuration file.
TOOLS = {"scontrol": "scontrol", "smi": "nvidia-smi", "dcgmi": "dcgmi", "ibstat": "ibstat", "ipmitool": "ipmitool"}
FILES = {"conf": "slurm.conf", "prometheus": "prometheus.yml", "ganglia": "gmond.conf", "release": "os-release", "kernel": "osrelease", "glibc": "ldd.txt"}


def _presence(names: DataFrame) -> DataFrame:
    """host and whether each tool and file was captured there."""
    name = F.col("name")
    tools = [F.bool_or((name == t) | name.startswith(t + ".") | name.startswith(t + "-")).alias(c) for c, t in TOOLS.items()]
    return names.groupBy("host").agg(*tools, *[F.bool_or(name == f).alias(c) for c, f in FILES.items()])


def probes(lines: DataFrame) -> DataFrame:
    """host, name, level, available, detail, reveals: the nine things that discovery looks for on each host.

    BMCs are never read, so that probe is never available; the system's is only with all three of its files.
    """
    facts = discover(lines).groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("f"))
    rows = _presence(lines.select("host", "name").distinct()).join(facts, "host", "left")
    fact = lambda k: F.coalesce(F.try_element_at("f", F.lit(k)), F.lit(""))
    some = lambda k: ~fact(k).isin("", "none")
    said = lambda *ks: F.concat_ws(" ", *[nonempty(fact(k)) for k in ks])
    nonempty = S.nonempty
    found = (
        ("scheduler", "unprivileged", some("scheduler.kind"), said("scheduler.kind", "scheduler.version"), "the batch system that answers have to speak of"),
        ("modules", "unprivileged", some("modules.kind"), said("modules.kind"), "which software can be loaded"),
        ("builders", "unprivileged", some("builders"), said("builders"), "where software was built"),
        ("os", "unprivileged", F.col("release") & F.col("kernel") & F.col("glibc"), said("os.id", "os.version_id"), "system, kernel and C library"),
        ("fabric", "unprivileged", F.col("ibstat"), said("fabric.kind", "fabric.hcas"), "adapters and their rates"),
        ("gpu", "unprivileged", F.col("smi"), said("gpu.driver_version", "gpu.cuda_version"), "driver generation and devices"),
        ("mounts", "unprivileged", some("mounts"), said("mounts"), "file systems that jobs share"),
        ("bmc", "privileged", F.lit(False), F.when(F.col("ipmitool"), "ipmitool is there and was not run").otherwise("no ipmitool"), "power and heat events of a node"),
        ("metrics", "unprivileged", some("metrics"), said("metrics"), "telemetry that is collected already"),
    )
    each = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(lv).alias("level"), ok.alias("available"), F.coalesce(nonempty(detail), F.lit("not found")).alias("detail"), F.lit(why).alias("reveals")) for n, lv, ok, detail, why in found])
    return rows.select("host", F.inline(each))


def discover(lines: DataFrame) -> DataFrame:
    """host, key, value: what the captured files (host, name, line_no, line) of each host tell of its site.

    Lists are sorted and joined by commas. A missing file gives no row, never an error.
    """
    names = lines.select("host", "name").distinct()
    tool = lambda t: F.bool_or((F.col("name") == t) | F.col("name").startswith(t + ".") | F.col("name").startswith(t + "-"))
    kind = F.when(F.col("s"), "slurm").when(F.col("p"), "pbs").when(F.col("l"), "lsf").otherwise("none")
    scheduler = names.groupBy("host").agg(tool("scontrol").alias("s"), tool("qstat").alias("p"), tool("bjobs").alias("l")).select("host", kind.alias("value"))
    listed = lambda name: _file(lines, name).groupBy("host").agg(F.array_join(S.unique_sorted(F.collect_list("line")), ",").alias("value"))
    env = _variables(lines)
    by_var = lambda *vs: F.max(F.when(F.col("var").isin(*vs) & (F.col("value") != ""), F.col("value")))
    modules = env.groupBy("host").agg(by_var("LMOD_CMD", "LMOD_PKG").alias("lmod"), by_var("MODULESHOME").alias("tcl"), by_var("MODULEPATH").alias("path"))
    word = lambda n: F.get(F.split(S.strip("line"), r"\s+"), F.lit(n))
    first = lambda name, value: _file(lines, name).filter("line_no = 1").select("host", value.alias("value"))
    release = _file(lines, "os-release")
    smi = _file(lines, "nvidia-smi.txt").withColumn("path", F.col("host"))
    files, _ = snapshots(smi)
    files = files.withColumnRenamed("path", "host")
    from .devices import SMI_DEVICE

    models = smi.filter(F.col("line").rlike(SMI_DEVICE)).groupBy("host").agg(F.array_join(F.array_sort(F.collect_set(F.regexp_extract("line", SMI_DEVICE, 2))), ",").alias("value"))
    fabric = ports(_file(lines, "ibstat.txt").withColumn("path", F.col("host"))).withColumnRenamed("path", "host")
    fabric = fabric.groupBy("host").agg(F.array_join(F.array_sort(F.collect_set("device")), ",").alias("hcas"), F.array_join(S.unique_sorted(F.collect_list("rate")), ",").alias("rates"), F.when(F.bool_or(F.lower("link_layer") == "ethernet"), "roce").otherwise("infiniband").alias("kind"))
    roots = F.array_join(S.unique_sorted(F.split("path", ":")), ",")
    built = env.filter(F.col("var").isin(*BUILDERS) & (F.col("value") != "")).groupBy("host").agg(F.array_join(F.array_sort(F.collect_list(F.concat(S.lookup(BUILDERS, F.col("var")), F.lit("="), F.col("value")))), ",").alias("value"))
    mounted = mounts(_file(lines, "mounts")).groupBy("host").agg(F.array_join(F.array_sort(F.collect_list(F.concat("mountpoint", F.lit("("), "fs_type", F.lit(")")))), ",").alias("value"))
    facts = [
        _fact(conf_value(_file(lines, "slurm.conf"), "ClusterName"), "cluster"), _fact(scheduler, "scheduler.kind"), _fact(first("scontrol.txt", word(1)), "scheduler.version"),
        _fact(listed("sinfo.txt"), "scheduler.partitions"), _fact(listed("sacctmgr-show-qos.txt"), "scheduler.qos"),
        _fact(modules, "modules.kind", F.when(F.col("lmod").isNotNull(), "lmod").when(F.col("tcl").isNotNull(), "tcl").otherwise("none")), _fact(modules, "modules.roots", roots),
        _fact(release_value(release, "ID"), "os.id"), _fact(release_value(release, "VERSION_ID"), "os.version_id"), _fact(first("osrelease", S.strip("line")), "os.kernel_release"),
        _fact(first("ldd.txt", F.element_at(F.split(S.strip("line"), r"\s+"), -1)), "os.glibc_version"), _fact(fabric, "fabric.kind", "kind"), _fact(fabric, "fabric.hcas", "hcas"),
        _fact(files, "gpu.vendor", F.when(F.col("driver").isNotNull(), "nvidia")), _fact(files, "gpu.driver_version", "driver"), _fact(files, "gpu.cuda_version", "cuda"), _fact(models, "gpu.models"),
        _fact(built, "builders"), _fact(mounted, "mounts"), _fact(fabric, "fabric.rates", "rates"),
        _fact(_presence(names), "scheduler.config_path", F.when(F.col("scontrol") & F.col("conf"), "/etc/slurm/slurm.conf")),
        _fact(_presence(names), "gpu.dcgm", F.when(F.col("smi"), F.col("dcgmi").cast("string"))), _fact(_presence(names), "bmc.kind", F.when(F.col("ipmitool"), "ipmi").otherwise("none")),
        _fact(_presence(names), "metrics", F.concat_ws(",", F.when(F.col("prometheus"), "prometheus"), F.when(F.col("ganglia"), "ganglia"))),
    ]
    out = facts[0]
    for f in facts[1:]:
        out = out.unionByName(f)
    return out


def node_keys(lines: DataFrame) -> DataFrame:
    """host, key, value that a node's profile is compared by: discovery's host facts, kernel arguments, the munge
    key's day, mounts and ports one by one."""
    kept = discover(lines).filter(F.col("key").isin("os.id", "os.version_id", "os.kernel_release", "os.glibc_version", "gpu.driver_version", "gpu.cuda_version", "modules.roots"))
    kept = kept.withColumn("value", F.when(F.col("key") == "modules.roots", F.replace("value", F.lit(","), F.lit(":"))).otherwise(F.col("value")))
    cmdline = _file(lines, "cmdline").filter("line_no = 1").select("host", S.normalize_cmdline(F.col("line")).alias("value"))
    times = _file(lines, "mtimes.txt").select("host", F.split("line", r"\s+")[0].alias("file"), F.get(F.split("line", r"\s+"), F.lit(1)).alias("t"))
    munge = times.filter("file = 'munge.key'").select("host", F.date_format(S.offset_time(F.col("t")), "yyyy-MM-dd").alias("value"))
    mounted = mounts(_file(lines, "mounts"))
    fabric = ports(_file(lines, "ibstat.txt").withColumn("path", F.col("host"))).withColumnRenamed("path", "host")
    out = kept
    for f in (
        _fact(cmdline, "os.kernel_cmdline"), _fact(munge, "munge.key_mtime"), _fact(mounted, F.concat(F.lit("mount."), "mountpoint"), F.concat_ws(" ", "fs_type", "source")),
        _fact(fabric, F.concat(F.lit("fabric.port."), "id"), "summary"),
    ):
        out = out.unionByName(f)
    return out


def capture_profiles(lines: DataFrame, cluster: str, captured_at: str) -> DataFrame:
    """One node profile for each host."""
    keys = node_keys(lines).groupBy("host").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("keys"))
    looked = probes(lines).groupBy("host").agg(F.array_sort(F.collect_list(F.struct("name", "level", "available", "detail", "reveals"))).alias("probes"))
    keys = keys.join(looked, "host", "left")
    return keys.select(
        F.lit(schema.PROFILE_VERSION).alias("profile_version"), F.lit(cluster).alias("cluster"), F.col("host").alias("node"), F.lit(captured_at).cast("timestamp").alias("captured_at"), "keys",
        F.coalesce("probes", F.array()).cast(schema.NODE_PROFILE["probes"].dataType).alias("probes"),
    )


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Node profiles from a directory of JSON files; a bad file, an unknown member or a node twice raises."""
    texts = spark.read.text(path, wholetext=True)
    known = F.array(*map(F.lit, schema.NODE_PROFILE.fieldNames()))
    odd = texts.filter(F.json_object_keys("value").isNull() | (F.size(F.array_except(F.json_object_keys("value"), known)) > 0)).select("_metadata.file_name").first()
    if odd:
        raise ValueError(f"{odd[0]}: not a node profile")
    got = spark.read.schema(schema.NODE_PROFILE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return require_unique(got, "node")


def read_misses(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(misses, unreadable lines) of a JSON-lines log."""
    shape = "when string, cluster string, job string, kind string, expected string, note string, _corrupt_record string"
    got = spark.read.text(path).filter("trim(value) <> ''").select(F.from_json("value", shape).alias("m")).select("m.*")
    return got.filter("_corrupt_record is null").drop("_corrupt_record"), got.filter("_corrupt_record is not null").select("_corrupt_record")


def append_miss(path: str, when: str, cluster: str, kind: str, job: str = "", expected: str = "", note: str = "") -> dict:
    """Adds one miss to the log on the driver, its time in the canonical form where it can be read as one."""
    form = re.fullmatch(r"(\d{4}-\d\d-\d\d)(?:[T ](\d\d:\d\d:\d\d)(?:\.(\d{1,9}))?(Z|[+-]\d\d:\d\d)?)?", when.strip())
    try:
        at = form and datetime.fromisoformat(f"{form[1]}T{form[2] or '00:00:00'}{(form[4] or 'Z')}").astimezone(UTC)
    except ValueError:
        at = None
    time = f"{at:%Y-%m-%dT%H:%M:%S}.{(form[3] or '').ljust(9, '0')}Z" if at else when.strip()
    miss = {k: v for k, v in {"when": time, "cluster": cluster, "job": job, "kind": kind, "expected": expected, "note": note}.items() if v or k in ("when", "cluster", "kind", "note")}
    os.makedirs(os.path.dirname(os.path.abspath(path)), mode=0o700, exist_ok=True)
    fd = os.open(path, os.O_WRONLY | os.O_CREAT | os.O_APPEND, 0o600)
    with os.fdopen(fd, "a", encoding="utf-8") as f:
        f.write(json.dumps(miss, ensure_ascii=False) + "\n")
    return miss
