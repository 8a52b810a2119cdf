"""System and daemon logs as events: lines split by form, then the first of an ordered table of signatures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.jobid import parse_job_id
from ..operators.validate import registered_only

# Forms of a log line (groups: time, host, unit, pid, message; time, message).
JOURNAL = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[+-]\d{2}:?\d{2}|Z)?)\s+(\S+)\s+([^:\[]+)(?:\[(\d+)\])?:\s*(.*)$"
DAEMON = r"^\[(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?)\]\s*(.*)$"

# Signature, class, pattern, and attrs; a number stands for a group of the pattern.
# "job" and "node" name the event's job and node, "kb" and "sec" are conversions.
SIGNATURES = (
    ("kernel.memcg.oom_kill", "resource.oom", r"Memory cgroup out of memory: Killed process (\d+) \(([^)]+)\)", {"killed_pid": 1, "killed_comm": 2}),
    ("kernel.oom.invoked", "resource.oom", r"(\S+) invoked oom-killer", {"killed_comm": 1}),
    ("kernel.memcg.limit_reached", "resource.oom", r"^memory: usage (\d+)kB, limit (\d+)kB", {"usage_bytes": ("kb", 1), "limit_bytes": ("kb", 2)}),
    ("slurm.slurmstepd.oom_kill_detected", "resource.oom", r"Detected \d+ oom_kill event in StepId=(\S+?)\.\s", {"job": 1}),
    ("slurm.slurmstepd.time_limit", "resource.walltime_exceeded", r"\*\*\* JOB (\d+) ON \S+ CANCELLED AT \S+ DUE TO TIME LIMIT \*\*\*", {"job": 1}),
    ("slurm.slurmstepd.step_time_limit", "resource.walltime_exceeded", r"\*\*\* (?:STEP|JOB) (\S+) ON \S+ CANCELLED AT \S+ DUE TO STEP TIME LIMIT \*\*\*", {"job": 1}),
    ("munge.expired_credential", "auth.munge", r"^Expired credential", {"reason": "Expired credential", "daemon": "munged"}),
    ("slurm.slurmd.munge_decode_failed", "auth.munge", r"Munge decode failed: (.+)$", {"reason": 1, "daemon": "slurmd"}),
    ("slurm.slurmd.register_auth_error", "auth.munge", r"Unable to register: (.*authentication error.*)$", {"reason": 1, "daemon": "slurmd"}),
    ("slurm.protocol_auth_error", "auth.munge", r"has authentication error: (.+)$", {"reason": 1}),
    ("chrony.system_clock_wrong", "config.clock_skew", r"System clock wrong by (-?[\d.]+) seconds", {"skew_sec": ("sec", 1), "reference": "chrony", "daemon": "chronyd"}),
    ("ntp.step_threshold_exceeded", "config.clock_skew", r"time (?:reset|step) (-?[\d.]+) s", {"skew_sec": ("sec", 1), "reference": "ntp", "daemon": "ntpd"}),
    ("slurm.slurmctld.node_set_down", "sched.node_fail", r"Nodes (\S+) not responding, setting DOWN", {"node": 1, "reason": "Not responding", "state": "DOWN*"}),
    ("slurm.slurmctld.node_not_responding", "sched.node_fail", r"Nodes (\S+) not responding$", {"node": 1, "reason": "Not responding"}),
    ("mlx5.port_module_event.cable_unplugged", "fabric.link_flap", r"mlx5_port_module_event.*Cable unplugged", {}),
    ("mlx5.ib_event.link_down", "fabric.link_flap", r"infiniband (\S+):.*Port (\d+) link down", {"device": 1, "port": 2, "link_state": "Down"}),
    ("mlx5.ib_event.link_up", "fabric.link_flap", r"infiniband (\S+):.*Port (\d+) link up", {"device": 1, "port": 2, "link_state": "Active"}),
    ("nvidia.xid", "gpu.xid", r"NVRM: Xid \(PCI:([0-9a-fA-F:.]+)\): (\d+)", {"pci_addr": 1, "xid": 2}),
    ("nvidia.fallen_off_bus", "gpu.fallen_off_bus", r"GPU has fallen off the bus", {}),
    ("lustre.estale", "storage.stale_handle", r"Lustre:.*Stale file handle", {"fs_type": "lustre", "errno": "ESTALE"}),
    ("nfs.server_not_responding", "storage.io_error", r"nfs: server \S+ not responding", {"fs_type": "nfs", "errno": "ETIMEDOUT"}),
)


def split_lines(lines: DataFrame, host: str = "", zone: str = "UTC") -> DataFrame:
    """Adds ts, node, unit, msg; ts is null for a line of neither form. Daemon lines take the given host."""
    def split(x: Column) -> Column:
        g = lambda n: F.regexp_extract(x, JOURNAL, n)
        d = lambda n: F.regexp_extract(x, DAEMON, n)
        fields = lambda *v: F.struct(*[c.alias(k) for k, c in zip(("time", "node", "unit", "msg"), v, strict=True)])
        return F.when(x.rlike(JOURNAL), fields(g(1), g(2), S.strip(g(3)), S.strip(g(5)))).when(x.rlike(DAEMON), fields(d(1), F.lit(host), F.lit(""), S.strip(d(2))))

    # an array of one, taken out by explode: filters on what is made here don't make it again
    got = lines.select("*", F.explode(F.array(split(F.col("line")))).alias("__s"))
    return got.select(*lines.columns, F.explode(F.array(S.log_time(F.col("__s.time"), zone))).alias("ts"), "__s.node", "__s.unit", "__s.msg")


def signature_number(msg: Column) -> Column:
    """Place from 0 of the first signature that matches; null for none. One combined pattern rules most lines out."""
    case = reduce(lambda c, i: c.when(msg.rlike(SIGNATURES[i][2]), i), range(1, len(SIGNATURES)), F.when(msg.rlike(SIGNATURES[0][2]), 0))
    return F.when(msg.rlike("|".join(f"(?:{s[2]})" for s in SIGNATURES)), case)


def _value(spec, groups: list[Column]) -> Column:
    if isinstance(spec, int):
        return groups[spec - 1]
    if isinstance(spec, tuple):
        return S.kb_to_bytes(groups[spec[1] - 1]) if spec[0] == "kb" else S.truncate_seconds(groups[spec[1] - 1])
    return F.lit(spec)


def _groups(attrs: dict) -> int:
    return max([s if isinstance(s, int) else s[1] for s in attrs.values() if not isinstance(s, str)], default=0)


def classify(split: DataFrame, cluster: str) -> DataFrame:
    """Events of split lines (ts, node, unit, msg, line_no), with ``job_text`` as found in the line."""
    sig = F.col("hit.sig")
    at = lambda j: F.get(F.array(*[F.lit(s[j]) for s in SIGNATURES]), sig)

    def parts(n: Column) -> Column:
        cases = None
        for i, (_, _, pattern, attrs) in enumerate(SIGNATURES):
            g = [F.regexp_extract("msg", pattern, k) if _groups(attrs) >= k else F.lit(None).cast("string") for k in (1, 2)]
            own = F.struct(F.lit(i).alias("sig"), g[0].alias("g1"), g[1].alias("g2"))
            cases = F.when(n == i, own) if cases is None else cases.when(n == i, own)
        return cases

    known = split.filter("ts is not null").select("*", F.explode(F.array(signature_number(F.col("msg")))).alias("__n")).filter("__n is not null")
    hit = known.select("*", F.explode(F.array(parts(F.col("__n")))).alias("hit")).drop("__n")

    def field(key: str) -> Column:
        by_value: dict = {}
        for i, (_, _, _, attrs) in enumerate(SIGNATURES):
            if key in attrs:
                by_value.setdefault(attrs[key], []).append(i)
        return F.coalesce(*[F.when(sig.isin(*rows), _value(spec, [F.col("hit.g1"), F.col("hit.g2")])) for spec, rows in by_value.items()])

    keys = sorted({k for _, _, _, attrs in SIGNATURES for k in attrs} - {"job", "node"})
    error = F.when(F.col("msg").startswith("error:") | F.col("unit").contains("error"), "error")
    attrs = F.create_map(*[x for k in keys for x in (F.lit(k), field(k))], F.lit("severity"), error)
    told = hit.select(
        "ts", S.nonempty(F.coalesce(S.nonempty(field("node")), F.col("node"))).alias("node"), S.nonempty(field("job")).alias("job_text"), at(1).alias("class"), at(0).alias("signature"), attrs.alias("attrs"), F.col("line_no").alias("ordinal"),
    )
    return told.select(
        "ts", F.lit(cluster).alias("cluster"), "node", parse_job_id(F.col("job_text")).alias("jobid"), F.lit("journal").alias("source"), "class",
        F.struct("signature", registered_only(F.col("class"), F.col("attrs")).alias("attrs")).alias("detail"), "ordinal", "job_text",
    )


#: Kinds of bad lines.
BAD_LINE, BAD_JOB = "unparsed line", "unparseable job id"


def events(lines: DataFrame, cluster: str, host: str = "", zone: str = "UTC") -> tuple[DataFrame, DataFrame]:
    """(events, warnings by kind: n, first_line, example). No cluster gives no events."""
    split = split_lines(lines.filter(S.strip("line") != ""), host, zone)
    found = classify(split, cluster) if cluster else classify(split, "-").filter(F.lit(False))
    odd = split.filter("ts is null").select(F.lit(BAD_LINE).alias("kind"), "line_no", "line")
    bad = found.filter("job_text is not null and jobid is null").select(F.lit(BAD_JOB).alias("kind"), F.col("ordinal").alias("line_no"), F.col("job_text").alias("line"))
    from ..operators.sets import aggregated_warnings

    return found.drop("job_text"), aggregated_warnings(odd.unionByName(bad))


#: Lines read where no window bounds a log.
LOG_CAP = 10_000


def tail(lines: DataFrame, n: int = LOG_CAP) -> DataFrame:
    return lines.orderBy(F.desc("line_no")).limit(n)
