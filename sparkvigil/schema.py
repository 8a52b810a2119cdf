"""The event model: closed enums, attribute registry, bounds and DDL."""

from __future__ import annotations

from pyspark.sql import types as T

VERSION = 2
PROFILE_VERSION = 1
POLICY_VERSION = 1

# The closed vocabulary of sources and classes.
SOURCES = ("bmc", "fabric", "gpu", "journal", "site", "slurm", "storage")
#: Sources that no reader of this engine fills.
UNREAD_SOURCES = ("bmc", "storage")
CLASSES = (
    "app.nonzero_exit", "app.segfault", "auth.credential", "auth.munge", "config.clock_skew", "config.drift", "fabric.congestion",
    "fabric.link_flap", "fabric.nccl_timeout", "gpu.driver_mismatch", "gpu.ecc", "gpu.fallen_off_bus", "gpu.xid", "resource.disk_quota",
    "resource.oom", "resource.oom_gpu", "resource.walltime_exceeded", "sched.cancelled", "sched.node_fail", "sched.preempted",
    "sched.requeued", "storage.io_error", "storage.mount_missing", "storage.stale_handle", "unknown",
)

# Attribute keys of every class, and of each class; a star marks identifying values.
UNIVERSAL_ATTRS = "exit_code signal state severity user* account* partition*"
CLASS_ATTRS = {
    "unknown": "",
    "app.nonzero_exit": "command*",
    "app.segfault": "comm* pid fault_addr",
    "resource.oom": "cgroup* limit_bytes usage_bytes killed_pid killed_comm*",
    "resource.oom_gpu": "gpu_index limit_bytes usage_bytes requested_bytes",
    "resource.walltime_exceeded": "limit_seconds elapsed_seconds",
    "resource.disk_quota": "mount* fs_type limit_bytes usage_bytes",
    "sched.node_fail": "reason",
    "sched.requeued": "reason",
    "sched.preempted": "reason by",
    "sched.cancelled": "reason by*",
    "auth.munge": "reason peer* skew_sec daemon",
    "auth.credential": "reason cred_type",
    "fabric.link_flap": "device port link_state phys_state rate flap_count",
    "fabric.congestion": "device port counter counter_delta",
    "fabric.nccl_timeout": "rank world_size op timeout_seconds comm",
    "gpu.driver_mismatch": "gpu_index driver_version expected_driver_version cuda_version",
    "gpu.xid": "gpu_index xid pci_addr",
    "gpu.ecc": "gpu_index ecc_type ecc_count pci_addr",
    "gpu.fallen_off_bus": "gpu_index pci_addr",
    "storage.mount_missing": "mount* fs_type server*",
    "storage.io_error": "mount* fs_type errno",
    "storage.stale_handle": "mount* fs_type",
    "config.clock_skew": "skew_sec reference daemon",
    "config.drift": "key observed* expected* peer_count peer_majority",
}
MAX_ATTRS, MAX_VALUE_BYTES, MAX_SIGNATURE_BYTES = 16, 256, 128


def registry() -> dict[str, dict[str, bool]]:
    """class -> key -> whether its values identify someone."""
    out = {}
    for name in CLASSES:
        keys = f"{UNIVERSAL_ATTRS} {CLASS_ATTRS[name]}".split()
        out[name] = {k.rstrip("*"): k.endswith("*") for k in keys}
    return out


def family(name: str) -> str:
    return name.partition(".")[0]


JOB_ID = T.StructType([
    T.StructField("raw", T.StringType()), T.StructField("base", T.DecimalType(20, 0)), T.StructField("array_task", T.LongType()),
    T.StructField("array_range", T.StringType()), T.StructField("het_offset", T.LongType()), T.StructField("step", T.StringType()),
])
DETAIL = T.StructType([T.StructField("signature", T.StringType()), T.StructField("attrs", T.MapType(T.StringType(), T.StringType()))])


def _pii(name: str, kind: str) -> T.StructField:
    return T.StructField(name, T.StringType(), metadata={"pii": kind})


EVENT = T.StructType([
    T.StructField("ts", T.TimestampType()), _pii("cluster", "cluster"), _pii("node", "host"), T.StructField("jobid", JOB_ID),
    T.StructField("source", T.StringType()), T.StructField("class", T.StringType()), T.StructField("detail", DETAIL), T.StructField("ordinal", T.LongType()),
])
PROBE = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("level", T.StringType()), T.StructField("available", T.BooleanType()),
    T.StructField("detail", T.StringType()), T.StructField("reveals", T.StringType()),
])
NODE_PROFILE = T.StructType([
    T.StructField("profile_version", T.IntegerType()), _pii("cluster", "cluster"), _pii("node", "host"), T.StructField("captured_at", T.TimestampType()),
    T.StructField("keys", T.MapType(T.StringType(), T.StringType())), T.StructField("probes", T.ArrayType(PROBE)),
])
PORT = "device string, number string, state string, phys_state string, rate string, link_layer string"
CAPABILITY = "source string, name string, level string, available boolean, detail string, reveals string"
