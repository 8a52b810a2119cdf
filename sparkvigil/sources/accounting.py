"""Scheduler accounting tables, by pipes or fixed width, as events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.jobid import parse_job_id
from ..operators.validate import registered_only

# Columns of the pipe form, in order.
FIELDS = "JobID JobName Partition Account AllocCPUS State ExitCode ReqMem MaxRSS Timelimit Elapsed NodeList Start End User".split()


def _is_header(line: Column, fields: Column) -> Column:
    """Whether a field is the job id's name; fields are looked at only in a line that holds the name somewhere."""
    return F.lower(line).contains("jobid") & F.exists(fields, lambda f: F.lower(S.strip(f)) == "jobid")


def _rows(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pipe rows (path, line_no, fields), and rows of the fixed form (path, line_no, row or warning).

    Pipe rows always have the columns FIELDS; a pipe header is only skipped, and ends the widths of a fixed form.
    A fixed row is cut at the places of the last rule's dashes, its last column to the end of the line, and named by
    the last header.
    """
    file = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    line = F.col("line")
    pipe = line.contains("|")
    kept = lines.filter(S.strip("line") != "")
    rule = S.strip("line").rlike("^[- ]+$")
    words = F.split(S.strip("line"), r"\s+")
    head = ~pipe & ~rule & _is_header(line, words)
    # spans of dashes: starts and lengths from the pieces of the rule line
    dashes = F.regexp_extract_all(line, F.lit("-+"), F.lit(0))
    gaps = F.split(line, "-+", -1)
    start = lambda i: F.aggregate(F.slice(F.zip_with(gaps, dashes, lambda g, d: F.length(g) + F.coalesce(F.length(d), F.lit(0))), F.lit(1), i), F.lit(0), lambda a, n: a + n) + F.length(F.get(gaps, i))
    spans = F.transform(dashes, lambda d, i: F.struct(start(i).alias("at"), F.length(d).alias("n")))
    marked = kept.select("path", "line_no", "line", F.when(rule, "rule").when(pipe, "pipe").when(head, "head").otherwise("row").alias("is"), F.when(rule, spans).alias("s"), F.when(head, words).alias("h"))
    # only files that hold lines of the fixed form carry state, and so have their lines in order
    fixed = marked.filter("`is` <> 'pipe'").select("path").distinct()
    ordered = marked.join(fixed, "path", "left_semi")
    reset = F.max(F.when(F.col("is") == "pipe", F.col("line_no"))).over(file)
    rule_at = F.max(F.when(F.col("is") == "rule", F.col("line_no"))).over(file)
    head_at = F.max(F.when(F.col("is") == "head", F.col("line_no"))).over(file)
    live = lambda at: at > F.coalesce(reset, F.lit(0))
    carried = ordered.withColumn("spans", F.when(live(rule_at), F.last("s", ignorenulls=True).over(file))).withColumn("cols", F.when(live(head_at), F.last("h", ignorenulls=True).over(file)))
    last = F.size("spans") - 1
    cut = F.transform("spans", lambda s, i: S.strip(F.when(i == last, F.substring(line, s["at"] + 1, F.length(line))).otherwise(F.substring(line, s["at"] + 1, s["n"]))))
    named = lambda cols, vals: F.map_from_entries(F.transform(cols, lambda c, i: F.struct(S.strip(c), F.coalesce(S.strip(F.get(vals, i)), F.lit("")))))
    missing = F.col("spans").isNull() | F.col("cols").isNull()
    rest = carried.filter("`is` = 'row'").select(
        "path", "line_no", F.when(~missing, named(F.col("cols"), cut)).alias("row"), F.when(missing, "no header seen; cannot map columns").alias("warning"),
    )
    piped = lines.filter(pipe & ~_is_header(line, F.split(line, r"\|", -1))).select("path", "line_no", F.split(line, r"\|", -1).alias("fields"))
    return piped, rest


def rows(lines: DataFrame) -> DataFrame:
    """path, line_no, row (map of column to text) or warning."""
    piped, rest = _rows(lines)
    cells = [x for i, c in enumerate(FIELDS) for x in (F.lit(c), F.coalesce(S.strip(F.get("fields", F.lit(i))), F.lit("")))]
    return piped.select("path", "line_no", F.create_map(*cells).alias("row"), F.lit(None).cast("string").alias("warning")).unionByName(rest)


def events(lines: DataFrame, cluster: str, zone: str = "UTC") -> tuple[DataFrame, DataFrame]:
    """(events, warnings with path, line_no, warning) of accounting tables."""
    wanted = [*FIELDS, "Reason"]
    get = lambda k: F.coalesce(F.col(f"f_{k}"), F.lit(""))
    piped, rest = _rows(lines)
    at = {k: i for i, k in enumerate(FIELDS)}
    cells = [S.strip(F.get("fields", F.lit(at[k]))) if k in at else F.lit(None).cast("string") for k in wanted]
    read = piped.select("path", "line_no", F.lit(None).cast("string").alias("warning"), *[c.alias(f"f_{k}") for k, c in zip(wanted, cells, strict=True)])
    read = read.unionByName(rest.select("path", "line_no", "warning", *[F.try_element_at("row", F.lit(k)).alias(f"f_{k}") for k in wanted]))
    parsed = F.struct(parse_job_id(get("JobID")).alias("job"), S.normalize_state(get("State")).alias("state"), S.scheduler_time(get("End"), zone).alias("end"), (get("JobID") == "").alias("blank"))
    told = read.select("*", F.explode(F.array(parsed)).alias("__p")).select("*", "__p.*").drop("__p")  # made once, whatever is filtered on it
    why = (
        F.when(F.col("warning").isNotNull(), F.col("warning"))
        .when(F.col("blank"), None)
        .when(F.col("job").isNull(), F.concat(F.lit("unparseable job id "), get("JobID")))
        .when(F.col("state").isNull(), F.concat(F.lit("no state of job "), get("JobID")))
        .when(F.col("state").isin(*S.QUIET_STATES), None)
        .when(F.col("end").isNull(), F.concat(F.lit("unusable End of job "), get("JobID")))
    )
    told = told.withColumn("why", why)
    usable = told.filter(~F.col("blank") & F.col("why").isNull() & ~F.col("state").isin(*S.QUIET_STATES))
    name = S.state_class(F.col("state"))
    some = lambda c: F.when(~F.coalesce(c, F.lit("")).isin("", "Unknown"), c)
    of = lambda *families: name.isin(*families)
    attrs = {
        "state": F.col("state"), "exit_code": some(get("ExitCode")), "account": some(get("Account")), "partition": some(get("Partition")), "user": some(get("User")),
        "limit_bytes": F.when(of("resource.oom"), S.bytes_of(get("ReqMem"))), "usage_bytes": F.when(of("resource.oom"), S.bytes_of(get("MaxRSS"))),
        "limit_seconds": F.when(of("resource.walltime_exceeded"), S.seconds_of(get("Timelimit"))), "elapsed_seconds": F.when(of("resource.walltime_exceeded"), S.seconds_of(get("Elapsed"))),
        "reason": F.when(name.startswith("sched."), some(get("Reason"))),
    }
    made = F.create_map(*[x for k, v in attrs.items() for x in (F.lit(k), v)])
    found = usable.select(
        F.col("end").alias("ts"), F.lit(cluster).alias("cluster"), S.first_node(get("NodeList")).alias("node"), F.col("job").alias("jobid"), F.lit("slurm").alias("source"),
        name.alias("class"), F.struct(F.concat(F.lit("slurm.sacct.state."), F.col("state")).alias("signature"), registered_only(name, made).alias("attrs")).alias("detail"), F.col("line_no").alias("ordinal"),
    )
    return found, told.filter("why is not null").select("path", "line_no", F.col("why").alias("warning"))
