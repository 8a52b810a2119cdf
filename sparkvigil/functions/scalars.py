"""Scalar functions of the readers and reports, all built-in expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scheduler states and their classes.
STATE_CLASS = {
    "OUT_OF_MEMORY": "resource.oom",
    "TIMEOUT": "resource.walltime_exceeded",
    "NODE_FAIL": "sched.node_fail",
    "PREEMPTED": "sched.preempted",
    "CANCELLED": "sched.cancelled",
    "REQUEUED": "sched.requeued",
    "FAILED": "app.nonzero_exit",
    "BOOT_FAIL": "sched.node_fail",
    "DEADLINE": "resource.walltime_exceeded",
}
QUIET_STATES = ("COMPLETED", "RUNNING", "PENDING")
#: Kernel arguments that differ from node to node.
NODE_ARGUMENTS = ("root", "resume", "rootflags", "ro", "rw")
# Octal escapes of a mount table, the backslash last.
MOUNT_ESCAPES = {r"\040": " ", r"\011": "\t", r"\012": "\n", r"\134": "\\"}
# Least driver of each runtime.
MIN_DRIVER = {
    "11.8": "520.61.05",
    "12.0": "525.60.13",
    "12.1": "530.30.02",
    "12.2": "535.54.03",
    "12.3": "545.23.06",
    "12.4": "550.54.14",
    "12.5": "555.42.02",
    "12.6": "560.28.03",
}


def strip(c: Column | str) -> Column:
    """Without white space at either end, tabs and line ends too."""
    return F.btrim(c, F.lit(" \t\n\r\x0b\x0c"))


def once(value: Column, made: Callable[[Column], Column]) -> Column:
    """made of a value that is computed once, however often it is named: plans stay small."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def nonempty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def format_time(ts: Column) -> Column:
    """Fixed-width UTC with nine digits of fraction."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSSSS'Z'")


def _local_time(text: Column, zone: str) -> Column:
    """A time without zone, of the given zone, in UTC; fractions are optional."""
    got = F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss.[SSSSSS][SSSSS][SSSS][SSS][SS][S]")))
    return F.to_utc_timestamp(got, zone)


def _offset_time(text: Column) -> Column:
    """A time with its offset (Z, +02:00 or +0200), which is authoritative."""
    forms = [f"yyyy-MM-dd'T'HH:mm:ss{f}{z}" for f in ("", ".[SSSSSS][SSSSS][SSSS][SSS][SS][S]") for z in ("XXX", "XX")]
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in forms])


def log_time(text: Column, zone: str = "UTC") -> Column:
    """Offset times as given, others in the zone; null if neither."""
    return once(text, lambda t: F.when(t.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$"), _offset_time(t)).otherwise(_local_time(t, zone)))


def scheduler_time(text: Column, zone: str = "UTC") -> Column:
    return once(strip(text), lambda t: F.when(~t.isin("", "Unknown", "None", "N/A"), F.coalesce(_local_time(t, zone), F.when(t.rlike(r"(?:Z|[+-]\d{2}:\d{2})$"), _offset_time(t)))))


def canonical_time(text: Column, zone: str = "UTC") -> Column:
    """A typed time (with or without offset, fraction or time of day) in the canonical form; other text as it is."""
    def read(t: Column) -> Column:
        short = F.regexp_replace(t, r"(\.\d{6})\d+", "$1")
        plain = [F.to_utc_timestamp(F.try_to_timestamp(t, F.lit(f)), zone) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")]
        return F.coalesce(format_time(F.coalesce(_offset_time(short), _local_time(short, zone), *plain)), t)

    return once(strip(text), read)


def _normalize_state(text: Column) -> Column:
    """Trimmed, cut at " by "; a trailing + is resolved if just one known state begins so. Empty is null."""
    whole = strip(text)
    at = F.instr(whole, " by ")
    state = strip(F.when(at > 1, F.substring(whole, F.lit(1), at - 1)).otherwise(whole))
    stem = F.regexp_replace(state, r"\+$", "")
    known = F.filter(F.array(*map(F.lit, (*STATE_CLASS, *QUIET_STATES))), lambda s: s.startswith(stem))
    return nonempty(F.when(state.endswith("+") & (F.size(known) == 1), known[0]).otherwise(state))


def state_class(state: Column) -> Column:
    return F.coalesce(lookup(STATE_CLASS, state), F.lit("unknown"))


def _bytes_of(text: Column) -> Column:
    """A size such as 8G, 8190M or 1204Kn in bytes as text; null if it is none."""
    t = F.regexp_replace(strip(text), r"[cn]+$", "")
    unit = F.regexp_extract(t, r"([KMGT])$", 1)
    n = F.regexp_replace(t, r"[KMGT]$", "")
    number = F.when(n.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), n.try_cast("double"))
    scale = F.when(unit == "K", 1024.0).when(unit == "M", 1024.0**2).when(unit == "G", 1024.0**3).when(unit == "T", 1024.0**4).otherwise(1.0)
    whole = number * scale
    return F.when(whole >= 0, F.floor(whole)).otherwise(F.ceil(whole)).cast("decimal(20,0)").cast("string")


def _seconds_of(text: Column) -> Column:
    """SS, MM:SS, HH:MM:SS, each after D-; the clock part is folded by 60 from the left, fractions are cut."""
    t = strip(text)
    days = F.when(t.contains("-"), F.substring_index(t, "-", 1)).otherwise("0")
    clock = F.substring_index(F.when(t.contains("-"), F.regexp_replace(t, r"^[^-]*-", "")).otherwise(t), ".", 1)
    ok = days.rlike(r"^\d{1,9}$") & clock.rlike(r"^\d{1,9}(:\d{1,9}){0,2}$")
    parts = F.split(clock, ":")
    folded = F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 60 + F.coalesce(p.try_cast("long"), F.lit(0)))
    return F.when(ok, (F.coalesce(days.try_cast("long"), F.lit(0)) * 86400 + folded).cast("string"))


def kb_to_bytes(text: Column) -> Column:
    return (text.try_cast("decimal(20,0)") * 1024).cast("decimal(24,0)").cast("string")


def ms_to_seconds(text: Column) -> Column:
    return F.floor(text.try_cast("decimal(20,0)") / 1000).cast("string")


def truncate_seconds(text: Column) -> Column:
    return F.nullif(nonempty(F.substring_index(text, ".", 1)), F.lit("-"))


def version_key(text: Column, width: Column) -> Column:
    """Dotted version as a comparable array of so many parts; missing and non-numeric ones are 0."""
    parts = F.transform(F.split(text, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)))
    return F.slice(F.concat(parts, F.array_repeat(F.lit(0), width)), F.lit(1), width)


def version_less(a: Column, b: Column) -> Column:
    """Whether version a is under b, by all parts of the longer one."""
    width = F.greatest(F.size(F.split(a, r"\.")), F.size(F.split(b, r"\.")))
    return F.when(a.isNotNull() & b.isNotNull(), version_key(a, width) < version_key(b, width))


def driver_too_old(driver: Column, cuda: Column) -> Column:
    """Whether the driver is under the least one of the runtime; null for an unlisted runtime."""
    return version_less(driver, lookup(MIN_DRIVER, cuda))


def allocated_but_idle(used: Column, total: Column, util: Column) -> Column:
    return (util == 0) & (total != 0) & (F.floor(used * 100 / F.nullif(total, F.lit(0))) >= 50)


def normalize_cmdline(text: Column) -> Column:
    """Kernel arguments without those of one node, sorted."""
    key = lambda a: F.substring_index(a, "=", 1)
    kept = F.filter(F.split(strip(text), r"\s+"), lambda a: (a != "") & ~key(a).isin(*NODE_ARGUMENTS) & ~key(a).startswith("rd."))
    return F.array_join(F.array_sort(kept), " ")


def unique_sorted(items: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(items, strip), lambda x: x != "")))


def unescape_mount(text: Column) -> Column:
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), MOUNT_ESCAPES.items(), text)


def attr_string(attrs: Column) -> Column:
    """Sorted k=v joined by spaces; empty for no attrs."""
    pairs = F.transform(F.sort_array(F.map_entries(attrs)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.coalesce(F.array_join(pairs, " "), F.lit(""))


def attrs_key(attrs: Column) -> Column:
    """Canonical text of a map, for grouping and order."""
    return F.coalesce(F.to_json(F.map_from_entries(F.sort_array(F.map_entries(attrs)))), F.lit("{}"))


def tokens(text: Column) -> Column:
    return F.floor((F.octet_length(text) + 3) / 4).cast("long")


def first_node(nodes: Column) -> Column:
    """The node of a list of one; null for none, a list or a range."""
    t = strip(nodes)
    return F.when((t != "") & (t != "None assigned") & ~t.rlike(r"[\[,]"), t)


def plausible_ipv4(text: Column) -> Column:
    parts = F.split(text, r"\.")
    return (F.size(parts) == 4) & F.forall(parts, lambda p: (F.length(p) <= 3) & F.coalesce(p.try_cast("int") <= 255, F.lit(False)))


def matches_any(value: Column, patterns: list[str]) -> Column:
    """Equal to a pattern, or to its part before one trailing star; no pattern matches nothing."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | (value == p) | (value.startswith(p[:-1]) if p.endswith("*") else F.lit(False))
    return hit


def local_time(text: Column, zone: str) -> Column:
    return once(text, lambda t: _local_time(t, zone))


def offset_time(text: Column) -> Column:
    return once(text, _offset_time)


def normalize_state(text: Column) -> Column:
    return once(strip(text), _normalize_state)


def bytes_of(text: Column) -> Column:
    return once(strip(text), _bytes_of)


def seconds_of(text: Column) -> Column:
    return once(strip(text), _seconds_of)
