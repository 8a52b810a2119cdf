"""Reports as rows of lines: a job's evidence, what readers could see, and a node against its fleet.

Each report has its keys, ``section``, ``ord`` and ``line``, and is made for all jobs, sources or nodes at once.
``text`` folds the lines of each into one string; a report of any number of jobs is written as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.scalars import tokens
from . import buckets, drift, join, timeline

LINES = "array<string>"
#: Sections of a job's report, in order.
HEAD, TIMELINE, OMITTED, GAPS = range(4)
#: Tokens kept free for what follows the timeline.
TRAILER = 64


def _given(*lines: Column) -> Column:
    """The lines that there are."""
    return F.array_compact(F.array(*lines))


def _size(lines: Column) -> Column:
    """Tokens of lines, each with its line end."""
    return tokens(F.concat(F.array_join(lines, "\n"), F.lit("\n")))


def _text(n: Column | str) -> Column:
    return (F.col(n) if isinstance(n, str) else n).cast("string")


def _spread(rows: DataFrame, keys: list[str], section: int, lines: str | Column) -> DataFrame:
    at = F.posexplode(lines).alias("ord", "line")
    return rows.select(*keys, F.lit(section).alias("section"), at).withColumn("ord", F.col("ord").cast("long"))


def gap_lines(capabilities: DataFrame) -> DataFrame:
    """cluster, gaps: lines of what could not be seen, by source and name. Capabilities are a few of each reader."""
    none = F.lit("")
    head = F.concat(F.lit("  "), "source", F.lit("/"), "name", F.lit(" ("), F.coalesce("level", none), F.lit(")"), F.when(F.coalesce("detail", none) != "", F.concat(F.lit(": "), "detail")).otherwise(none))
    lost = F.when(F.coalesce("reveals", none) != "", F.concat(F.lit("      lost: "), "reveals"))
    rows = capabilities.filter("not available").select("cluster", F.struct("source", "name", _given(head, lost).alias("lines")).alias("gap"))
    return rows.groupBy("cluster").agg(F.flatten(F.transform(F.array_sort(F.collect_list("gap")), lambda g: g["lines"])).alias("gaps"))


def context_lines(
    events: DataFrame, capabilities: DataFrame | None = None, warnings: DataFrame | None = None, site: list[str] | None = None,
    limit: int = 4000, before: int | None = None, after: int | None = None, skew: int = 0, cluster_scope: bool = False, salt_id: str = "", jobs: DataFrame | None = None,
) -> DataFrame:
    """cluster, job, section, ord, line: the report of every job (or of those in ``jobs``: cluster, job).

    What could not be seen and the head are taken off the ``limit`` of tokens first, so that neither gives way to more
    evidence; 0 keeps all evidence. ``capabilities`` has a cluster; ``warnings`` (cluster, n) counts lines that no
    signature knew. A job in ``jobs`` without an event has a report that says so. Null counts are 0.
    """
    keys = list(timeline.JOB)
    runs = buckets.Collapsed(events, before, after, skew, cluster_scope, jobs.select("job").distinct() if jobs is not None else None)
    rows = runs.rows(["source", "class", "signature", "job_raw", "attrs_text"], limit)
    early, late = (join.BEFORE if before is None else before) + skew, (join.AFTER if after is None else after) + skew
    seen = runs.jobs().select(*keys, "n", F.col("events").alias("own"), F.col("first_ts").alias("lo"), F.col("last_ts").alias("hi"), "nodes", "runs")
    if jobs is not None:
        seen = seen.unionByName(jobs.select(*keys).distinct().join(seen, keys, "left_anti"), allowMissingColumns=True)
    seen = seen.join(gap_lines(capabilities), "cluster", "left") if capabilities is not None else seen.withColumn("gaps", F.lit(None).cast(LINES))
    seen = seen.join(warnings.groupBy("cluster").agg(F.sum("n").alias("odd")), "cluster", "left") if warnings is not None else seen.withColumn("odd", F.lit(0))
    at = lambda c, s: F.date_format(F.col(c) + F.make_dt_interval(secs=F.lit(s)), "yyyy-MM-dd HH:mm:ss")
    empty = F.coalesce("n", F.lit(0)) == 0
    n_nodes = F.coalesce(F.size("nodes"), F.lit(0))
    head = _given(
        F.concat(F.lit("job "), _text("job"), F.lit(" on "), F.col("cluster")),
        F.concat(F.lit(f"schema v{S.VERSION}, "), _text(F.coalesce("n", F.lit(0))), F.lit(" events, "), _text(F.coalesce("own", F.lit(0))), F.lit(" with the job's own id, "), _text(F.greatest(n_nodes, F.lit(0))), F.lit(" nodes")),
        F.when(~empty, F.concat(F.lit("window "), at("lo", -early), F.lit(" to "), at("hi", late), F.lit(" UTC"))),
        F.lit(f"redaction: pseudonyms, salt {salt_id}" if salt_id else "redaction: none, names are real"),
        F.when(n_nodes > 0, F.concat(F.lit("nodes: "), F.array_join("nodes", ", "))),
        *[F.lit(x) for x in (site or [])],
        F.when(empty, F.lit("no events: nothing recorded this job, or no reader could see what did")),
    )
    odd = F.when(F.coalesce("odd", F.lit(0)) > 0, F.concat(_text("odd"), F.lit(" lines matched no signature")))
    gaps = F.coalesce("gaps", F.array(F.lit("  (nothing)")))
    seen = seen.withColumn("head", head).withColumn("tail", F.concat(F.array(F.lit("NOT SEEN")), gaps, _given(odd)))
    spent = seen.select(*keys, (_size(F.col("head")) + _size(F.col("tail")) + TRAILER).alias("__spent"))
    told = timeline.marked(rows.join(spent, keys), limit, F.col("__spent")).drop("__spent")
    shown = timeline.lines(told.filter("kept").drop("kept", "source_width", "class_width"))
    lines = shown.select(*keys, F.lit(TIMELINE).alias("section"), "ord", F.explode(_given(F.concat(F.lit("  ["), "day", F.lit("]")), F.col("line"))).alias("line"))
    lines = lines.withColumn("ord", F.col("ord") * 2 + F.when(F.col("line").startswith("  ["), 0).otherwise(1))
    # Runs that no report of the limit has aren't among the rows, but counted.
    stay = shown.groupBy(*keys).agg(F.count("*").alias("stay"))
    # All other sections in one pass over what was seen, as each would count the jobs' events again.
    n = F.col("runs") - F.coalesce("stay", F.lit(0))
    omitted = F.when(n > 0, F.array(F.concat(_text(n), F.lit(f" rows left out to fit {limit} tokens, the farthest from the job's own events first")))).otherwise(F.array().cast(LINES))
    of = lambda section, c: F.transform(c, lambda x, i: F.struct(F.lit(section).alias("section"), i.cast("long").alias("ord"), x.alias("line")))
    rest = F.concat(of(HEAD, F.col("head")), of(OMITTED, omitted), of(GAPS, F.col("tail")))
    return seen.join(stay, keys, "left").select(*keys, F.explode(rest).alias("__line")).select(*keys, "__line.*").unionByName(lines)


def site_lines(profile: dict, path: str = "") -> list[str]:
    """What of a site profile changes the shape of a right answer; an absent profile is stated, not left out."""
    if not profile.get("cluster"):
        return ["SITE no profile: scheduler, modules and drivers are unknown"]
    part = lambda name: profile.get(name) or {}
    sched, mods, base, fabric, gpu = map(part, ("scheduler", "modules", "os", "fabric", "gpu"))
    known = lambda kind: kind not in (None, "", "none")
    rows = [
        ("scheduler", f"{sched['kind']} {sched.get('version', '')}" if known(sched.get("kind")) else "none detected"),
        ("modules", mods["kind"] if known(mods.get("kind")) else "none active"),
    ]
    system = f"{base.get('id', '')} {base.get('version_id', '')}".strip()
    if system:
        extra = [f"{word} {base[key]}" for word, key in (("kernel", "kernel_release"), ("glibc", "glibc_version")) if base.get(key)]
        rows.append(("os", ", ".join([system, *extra])))
    if known(fabric.get("kind")):
        rows.append(("fabric", " ".join([fabric["kind"], *fabric.get("rates", [])])))
    if known(gpu.get("vendor")):
        driver = f" driver {gpu['driver_version']}" if gpu.get("driver_version") else ""
        cuda = f", CUDA {gpu['cuda_version']}" if gpu.get("cuda_version") else ""
        models = f" ({', '.join(gpu['models'])})" if gpu.get("models") else ""
        rows.append(("gpu", f"{gpu['vendor']}{driver}{cuda}{models}"))
    out = [f"SITE from {path}" if path else "SITE", *[f"  {label:<10} {value.strip()}" for label, value in rows]]
    if any(gap.get("name") == "scheduler" for gap in profile.get("gaps") or []):
        out.append("  note       the scheduler was never probed with success; correct it by hand")
    return out


def doctor_lines(capabilities: DataFrame, events: DataFrame, warnings: DataFrame) -> DataFrame:
    """source, section, ord, line: per source its capabilities by name, what a missing one costs, and its counts.

    capabilities (source, name, level, available, detail, reveals), events (source), warnings (source). A source of any
    of them has a report. Capabilities are a few of each reader; events and warnings are only counted.
    """
    none = F.lit("")
    head = F.concat(F.when(F.col("available"), "  ok   ").otherwise("  MISS "), F.col("name"), F.lit(" ("), F.coalesce("level", none), F.lit(")"), F.when(F.coalesce("detail", none) != "", F.concat(F.lit(" "), "detail")).otherwise(none))
    lost = F.when(~F.col("available") & (F.coalesce("reveals", none) != ""), F.concat(F.lit("       without it: "), "reveals"))
    found = capabilities.groupBy("source").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("name", _given(head, lost).alias("lines")))), lambda g: g["lines"])).alias("found"))
    n = events.groupBy("source").agg(F.count("*").alias("n"))
    odd = warnings.groupBy("source").agg(F.count("*").alias("odd"))
    both = found.join(n, "source", "full_outer").join(odd, "source", "full_outer")
    counts = F.concat(F.lit("  "), _text(F.coalesce("n", F.lit(0))), F.lit(" events"), F.when(F.col("odd") > 0, F.concat(F.lit(", "), _text("odd"), F.lit(" warnings"))).otherwise(none))
    lines = F.concat(F.array("source"), F.coalesce("found", F.array(F.lit("  (declares no capabilities)"))), F.array(counts))
    return _spread(both, ["source"], HEAD, lines)


def diff_lines(values: DataFrame, min_peers: int = drift.MIN_PEERS) -> DataFrame:
    """cluster, node, section, ord, line: every node's divergence from its siblings' majority.

    values is the long form of node profiles. Siblings are counted and not named: naming them in every report would cost
    the square of a fleet. A node with too few siblings is told so and not compared.
    """
    keys = ["cluster", "node"]
    spread = F.col("spread_seconds")
    fleet = drift.fleet(values).select("cluster", "nodes").join(drift.capture_spread(values).select("cluster", "spread_seconds", "stale"), "cluster")
    cells = drift.verdicts(values, min_peers)
    apart = F.when(F.col("expected") != F.col("observed"), F.struct("key", _given(
        F.concat(F.lit("  "), "key", F.lit(": "), "observed"), F.concat(F.lit("    "), _text("peer_majority"), F.lit(" of "), _text("peer_count"), F.lit(" siblings: "), "expected"),
    ).alias("lines")))
    verdict = cells.groupBy(*keys).agg(F.collect_list(apart).alias("apart"), F.array_sort(F.collect_list(F.when(F.col("expected").isNull(), F.col("key")))).alias("open"))
    rows = values.select(*keys).distinct().join(fleet, "cluster").join(verdict, keys, "left")
    few = F.col("nodes") <= min_peers
    peers = _text(F.col("nodes") - 1)
    stale = F.when(~few & F.col("stale"), F.concat(F.lit("captures span "), spread_text(spread), F.lit(": what differs may be when they were read")))
    head = _given(
        F.concat(F.lit("node "), "node", F.lit(" of cluster "), "cluster"),
        F.when(few, F.concat(F.lit("not compared: "), peers, F.lit(f" siblings, {min_peers} are needed"))).otherwise(F.concat(peers, F.lit(" siblings"))), stale,
    )
    apart = F.flatten(F.transform(F.array_sort(F.coalesce("apart", F.array())), lambda d: d["lines"]))
    body = F.when(few, F.array().cast(LINES)).when(F.size(apart) > 0, F.concat(F.array(F.lit("DIVERGENCE FROM THE MAJORITY")), apart)).otherwise(F.array(F.lit("no divergence on any key")))
    undecided = F.when(F.size("open") > 0, F.concat(F.array(F.lit("NO MAJORITY")), F.transform("open", lambda k: F.concat(F.lit("  "), k)))).otherwise(F.array().cast(LINES))
    return _spread(rows, keys, HEAD, F.concat(head, body, undecided))


def spread_text(seconds: Column) -> Column:
    """Whole days from a day on, else hours and minutes."""
    minutes = F.round(seconds / 60).cast("long")
    short = F.concat(F.when(minutes >= 60, F.concat((minutes / 60).cast("long").cast("string"), F.lit("h"))).otherwise(""), (minutes % 60).cast("string"), F.lit("m"))
    return F.when(seconds >= 86400, F.concat(F.bround(seconds / 86400).cast("long").cast("string"), F.lit("d"))).otherwise(short)


def text(lines: DataFrame) -> DataFrame:
    """The keys of each report and its lines as one ``text``."""
    keys = [c for c in lines.columns if c not in ("section", "ord", "line")]
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "ord", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy(*keys).agg(whole.alias("text"))
