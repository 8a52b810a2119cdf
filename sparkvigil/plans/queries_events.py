"""Queries over the evidence view: joins, orders, timelines, sets and encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.jobid import job_id_error, parse_job_id
from ..operators import buckets, encode, join, policy, sets, timeline, validate
from . import evidence
from .evidence import EV, events, key_of, ts_text

ORDER = "ts, source, node, coalesce(CAST(job AS STRING), ''), class, signature, attrs_key, ordinal"
RELATED = "ts, CASE relation WHEN 'direct' THEN 0 WHEN 'node' THEN 1 ELSE 2 END, source, node, coalesce(CAST(own AS STRING), ''), class, signature, attrs_key, ordinal"
SKEW = {"before": 300, "after": 120, "skew": 60}
NODE, LO, HI = "node-0003", "2024-01-05 00:00:00", "2024-01-06 12:00:00"
BUDGET, RESERVED = 160, 20


def evidence_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return e.select(F.col("ordinal").alias("event_id"), ts_text().alias("ts_text"), "cluster", "node", F.col("jobid.base").cast("long").alias("job"), "source", "class", F.col("detail.signature").alias("signature"), key_of().alias("attrs_key"))


def canonical_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each event in its day's canonical order."""
    day = Window.partitionBy(F.to_date("ts")).orderBy(*join.canonical_order())
    return events(spark, sf_dir).select(F.col("ordinal").alias("event_id"), F.row_number().over(day).alias("place"))


def _related(df: DataFrame) -> DataFrame:
    return df.select(F.col("job").cast("long").alias("job"), F.col("ordinal").alias("event_id"), "relation", "seq")


def for_job_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _related(buckets.ranked(events(spark, sf_dir), cluster_scope=True))


def for_job_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _related(join.ranked(join.direct(join.for_jobs(events(spark, sf_dir)))))


def for_job_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _related(buckets.ranked(events(spark, sf_dir)))


def for_job_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _related(buckets.ranked(events(spark, sf_dir), cluster_scope=True, **SKEW))


def _related_sql(before: int = join.BEFORE, after: int = join.AFTER, relations: str = "'direct', 'node', 'cluster'") -> str:
    return f"""
WITH {EV}, x AS (
  SELECT job, min(ts) - INTERVAL {before} SECOND AS lo, max(ts) + INTERVAL {after} SECOND AS hi FROM ev WHERE job IS NOT NULL GROUP BY job
), n AS (SELECT DISTINCT job, node FROM ev WHERE job IS NOT NULL AND node <> ''),
r AS (
  SELECT ev.job AS own, ev.job, 'direct' AS relation, ev.* EXCLUDE (job) FROM ev WHERE ev.job IS NOT NULL
  UNION ALL SELECT NULL, x.job, 'node', ev.* EXCLUDE (job) FROM ev JOIN n ON ev.node = n.node JOIN x ON x.job = n.job WHERE ev.job IS NULL AND ev.ts BETWEEN x.lo AND x.hi
  UNION ALL SELECT NULL, x.job, 'cluster', ev.* EXCLUDE (job) FROM ev JOIN x ON ev.ts BETWEEN x.lo AND x.hi WHERE ev.job IS NULL AND ev.node = ''
), q AS (SELECT * FROM r WHERE relation IN ({relations}))"""


def _seq_sql(*args, **kw) -> str:
    return _related_sql(*args, **kw) + f" SELECT CAST(job AS BIGINT) AS job, event_id, relation, row_number() OVER (PARTITION BY job ORDER BY {RELATED}) AS seq FROM q"


def for_node_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = join.for_node(events(spark, sf_dir), NODE, F.lit(LO).cast("timestamp"), F.lit(HI).cast("timestamp"))
    return found.select(F.col("ordinal").alias("event_id"), ts_text().alias("ts_text"), F.col("jobid.base").cast("long").alias("job"), "class")


def jobs_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join.jobs(events(spark, sf_dir)).select("cluster", F.col("job").cast("long").alias("job"))


def job_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    nodes = join.job_nodes(e).groupBy("cluster", "job").agg(F.count("*").alias("nodes"))
    x = join.extents(e).join(nodes, ["cluster", "job"], "left")
    return x.select(F.col("job").cast("long").alias("job"), *[ts_text(c).alias(c) for c in ("first_ts", "last_ts", "lo", "hi")], "events", F.coalesce("nodes", F.lit(0)).alias("nodes"))


def _clocks(e: DataFrame) -> DataFrame:
    return e.filter("node <> ''").groupBy("source", "node").agg(F.max((F.col("ordinal") % 1000 - 500) * 1000000).alias("offset_nanos"))


def skew_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join.skew_of(_clocks(events(spark, sf_dir)))


def assumed_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join.assumed_clocks(events(spark, sf_dir)).select("source", "offset_nanos", "method")


def collapse_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = buckets.Collapsed(events(spark, sf_dir), cluster_scope=True).rows(["signature", "node"])
    return rows.select(F.col("job").cast("long").alias("job"), "ord", "count", ts_text().alias("ts_text"), ts_text("last").alias("last_text"), "relation", "signature", "node")


def _rows_sql() -> str:
    key = "concat_ws('|', relation, source, class, signature, node, coalesce(CAST(own AS STRING), ''), attrs_key)"
    return _related_sql() + f""", s AS (
  SELECT *, {key} AS k, row_number() OVER w AS seq, lag({key}) OVER w AS p FROM q WINDOW w AS (PARTITION BY job ORDER BY {RELATED})
), g AS (SELECT *, sum(CASE WHEN p = k THEN 0 ELSE 1 END) OVER (PARTITION BY job ORDER BY seq) AS run FROM s),
c AS (
  SELECT job, run, min(seq) - 1 AS ord, count(*) AS count, arg_min(ts, seq) AS ts, arg_max(ts, seq) AS last, min(relation) AS relation, min(source) AS source, min(class) AS class,
    min(signature) AS signature, min(node) AS node, min(own) AS own, min(attrs_key) AS attrs_key FROM g GROUP BY job, run
)"""


_TAIL = """concat(signature, CASE WHEN count > 1 THEN concat(' ×', CAST(count AS STRING), ' through ', strftime(last, '%H:%M:%S')) ELSE '' END,
  CASE WHEN relation = 'direct' THEN concat(' job=', CAST(own AS STRING)) ELSE '' END,
  ' ', replace(replace(replace(replace(replace(attrs_key, '","', ' '), '":"', '='), '{"', ''), '"}', ''), '"', ''))"""
_TEXT_TS = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '000Z'"


def timeline_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timeline.lines_of(buckets.Collapsed(events(spark, sf_dir), cluster_scope=True).rows(["source", "class", "signature", "job_raw", "attrs_text"]))
    return rows.select(F.col("job").cast("long").alias("job"), "ord", "day", "line")


def budget_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every job's timeline that stay in a report of BUDGET tokens."""
    rows = buckets.Collapsed(events(spark, sf_dir), cluster_scope=True).rows(["source", "class", "signature", "job_raw", "attrs_text"], BUDGET - RESERVED)
    return timeline.budget(rows, BUDGET, RESERVED).select(F.col("job").cast("long").alias("job"), "ord", "relation")


def cut_sql(room: str, joined: str = "") -> str:
    """k: collapsed rows with their rank rk of being dropped; f: per job the last rank dropped for the lines to fit in ``room`` tokens."""
    return _rows_sql() + f""", b AS (
  SELECT *, strlen({_TAIL}) + 16 AS bytes, min(ts) FILTER (WHERE relation = 'direct') OVER (PARTITION BY job) AS lo, max(ts) FILTER (WHERE relation = 'direct') OVER (PARTITION BY job) AS hi FROM c
), d AS (SELECT *, greatest(0, epoch_us(lo) - epoch_us(ts), epoch_us(ts) - epoch_us(hi)) AS gap FROM b),
k AS (SELECT *, CASE WHEN relation = 'direct' THEN 2147483647 ELSE row_number() OVER (PARTITION BY job, relation = 'direct' ORDER BY gap DESC, ord DESC) END AS rk FROM d),
t AS (SELECT job, 0 AS cut FROM k UNION ALL SELECT job, rk FROM k WHERE rk < 2147483647),
z AS (
  SELECT t.job, t.cut, sum(k.bytes) + count(*) * (max(strlen(k.source)) + max(strlen(k.class))) + 15 * count(DISTINCT CAST(k.ts AS DATE)) AS total
  FROM (SELECT DISTINCT job, cut FROM t) t JOIN k ON k.job = t.job AND k.rk > t.cut GROUP BY t.job, t.cut
), f AS (SELECT t.job, coalesce(min(z.cut) FILTER (WHERE (z.total + 3) // 4 <= {room}), 2147483646) AS cut FROM (SELECT DISTINCT job FROM t) t LEFT JOIN z ON z.job = t.job {joined} GROUP BY t.job)"""


BUDGET_SQL = cut_sql(str(BUDGET - RESERVED)) + """
SELECT CAST(k.job AS BIGINT) AS job, k.ord, k.relation FROM k JOIN f ON k.job = f.job AND k.rk > f.cut"""

# Job ids by suffix.
SUFFIXES = ("", ".batch", "_7", "_[8-20%4]", "+1", "_7.0", "_", "_x", "_7+1", ".")
JOB_TEXT = "concat(CAST(user_id AS STRING), CASE event_id % 10 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SUFFIXES)) + " END)"


def job_id_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = evidence.table(spark, sf_dir, "events").select("event_id", F.expr(JOB_TEXT).alias("raw"))
    p = e.select("event_id", parse_job_id(F.col("raw")).alias("p")).filter("p is not null")
    return p.select("event_id", "p.raw", F.col("p.base").cast("long").alias("base"), "p.array_task", "p.array_range", "p.het_offset", "p.step")


def job_id_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = evidence.table(spark, sf_dir, "events").select("event_id", F.expr(JOB_TEXT).alias("raw"))
    return e.withColumn("reason", job_id_error(F.col("raw"))).filter("reason is not null")


_ID = r"^([0-9]+)(?:_([0-9]+|\[[^\]]*\])|\+([0-9]+))?(?:\.([^.\[\]]+))?$"
JOB_PARSE_SQL = rf"""
WITH t AS (SELECT event_id, {JOB_TEXT} AS raw FROM events)
SELECT event_id, raw, CAST(regexp_extract(raw, '{_ID}', 1) AS BIGINT) AS base,
  TRY_CAST(nullif(regexp_extract(raw, '{_ID}', 2), '') AS BIGINT) AS array_task, CASE WHEN regexp_extract(raw, '{_ID}', 2) LIKE '[%' THEN regexp_extract(raw, '{_ID}', 2) END AS array_range,
  TRY_CAST(nullif(regexp_extract(raw, '{_ID}', 3), '') AS BIGINT) AS het_offset, nullif(regexp_extract(raw, '{_ID}', 4), '') AS step
FROM t WHERE regexp_matches(raw, '{_ID}')"""
JOB_INVALID_SQL = f"""
SELECT event_id, {JOB_TEXT} AS raw, CASE event_id % 10 WHEN 6 THEN 'empty array suffix' WHEN 7 THEN 'not numeric' WHEN 8 THEN 'both array and heterogeneous' ELSE 'empty step' END AS reason
FROM events WHERE event_id % 10 >= 6"""

#: Ways in which every 13th event is broken.
BROKEN = {
    0: "cluster = ''", 1: "source = 'nagios'", 2: "class = 'gpu.melted'", 3: "signature = ''", 4: "long signature", 5: "unregistered attr", 6: "long attr", 7: "no ts",
}


def validate_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("ordinal") % 13
    name, attrs = F.when(n == 4, F.repeat(F.lit("s"), 129)).when(n == 3, "").otherwise(F.col("detail.signature")), F.col("detail.attrs")
    more = F.when(n == 5, F.map_concat(attrs, F.create_map(F.lit("shoe_size"), F.lit("9")))).when(n == 6, F.create_map(F.lit("state"), F.repeat(F.lit("é"), 129))).otherwise(attrs)
    e = events(spark, sf_dir).withColumns({
        "detail": F.struct(name.alias("signature"), more.alias("attrs")), "cluster": F.when(n == 0, "").otherwise(F.col("cluster")), "source": F.when(n == 1, "nagios").otherwise(F.col("source")),
        "class": F.when(n == 2, "gpu.melted").otherwise(F.col("class")), "ts": F.when(n != 7, F.col("ts")),
    })
    return validate.validate(e)[1].select(F.col("ordinal").alias("event_id"), "reject_reason")


VALIDATE_SQL = """
SELECT event_id, CASE event_id % 13 WHEN 0 THEN 'no cluster' WHEN 1 THEN 'unknown source' WHEN 2 THEN 'unknown class' WHEN 3 THEN 'no signature' WHEN 4 THEN 'signature too long'
  WHEN 5 THEN 'unregistered attr shoe_size' WHEN 6 THEN 'attr too long state' WHEN 7 THEN 'no timestamp' END AS reject_reason FROM events WHERE event_id % 13 <= 7"""


def merge_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of all sources merged, counted by source and class."""
    e = events(spark, sf_dir)
    merged = join.merge_events(*[e.filter(F.col("source") == s) for s in S.SOURCES])
    return merged.groupBy("source", "class").agg(F.count("*").alias("n"), F.min("ordinal").alias("first_id"))


def unread_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture names (by user) that no error event touched."""
    e = evidence.table(spark, sf_dir, "events")
    name = F.concat(F.lit("capture-"), F.col("user_id").cast("string"), F.lit(".txt")).alias("name")
    return sets.unread(e.select(name), e.filter("event_type = 'error' and value > 100").select(name))


def multiset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(class, signature) of the first half of the month against the second, with multiplicity."""
    e = events(spark, sf_dir).select("ts", "class", F.col("detail.signature").alias("signature"), "node")
    early = F.dayofmonth("ts") <= 15
    return sets.multiset_difference(e.filter(early), e.filter(~early), ["class", "signature", "node"])


def source_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.source_gaps(events(spark, sf_dir))


def declared_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes by node and hour of the day: those of the month's first half, taken as declared, against the second's."""
    e = events(spark, sf_dir).select("ts", "node", "class", F.hour("ts").alias("hour"))
    early, keys = F.dayofmonth("ts") <= 15, ["node", "class", "hour"]
    return sets.symmetric_difference(e.filter(early).select(keys), e.filter(~early).select(keys))


def miss_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = evidence.table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"))
    return sets.miss_counts(e)


def warning_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = evidence.table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("event_id").alias("line_no"), F.col("props").alias("line"))
    return sets.aggregated_warnings(e)


def _capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = evidence.table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.max("value").alias("v"))
    return e.select(F.col("event_type").alias("source"), F.concat(F.lit("probe-"), F.col("user_id").cast("string")).alias("name"), (F.col("v") >= 30).alias("available"))


def capability_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.capabilities_missing(_capabilities(spark, sf_dir)).select("source", "name")


def capability_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.capability_report(_capabilities(spark, sf_dir))


_CAPS = "c AS (SELECT event_type AS source, concat('probe-', CAST(user_id AS STRING)) AS name, max(value) >= 30 AS available FROM events GROUP BY event_type, user_id)"

#: A test-only action set: what ships is empty.
ACTIONS = {"drain": "resume", "reboot": "", "requeue": "hold"}
RULES = policy.Policy(cluster="cluster-a", allow=["drain"], nodes=["node-000*", "node-0042"], jobs=["*"])
KIND = "CASE s_suppkey % 5 WHEN 0 THEN 'drain' WHEN 1 THEN 'reboot' WHEN 2 THEN 'requeue' WHEN 3 THEN 'format' ELSE 'drain' END"
TARGET = "CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE concat('node-', lpad(CAST(s_suppkey % 20 AS STRING), 4, '0')) END"


def policy_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = evidence.table(spark, sf_dir, "supplier")
    requests = s.select("s_suppkey", F.expr(KIND).alias("kind"), F.expr(TARGET).alias("node"), F.lit("").alias("job"))
    return policy.evaluate(requests, RULES, "cluster-a", ACTIONS).select("s_suppkey", "kind", "node", "allowed", "gate", "dry_run")


POLICY_SQL = f"""
WITH r AS (SELECT s_suppkey, {KIND} AS kind, {TARGET} AS node FROM supplier), g AS (
  SELECT *, CASE WHEN kind NOT IN ('drain', 'reboot', 'requeue') THEN 'unknown_action' WHEN kind = 'reboot' THEN 'irreversible' WHEN kind <> 'drain' THEN 'not_allowed'
    WHEN node = '' OR NOT (node LIKE 'node-000%' OR node = 'node-0042') THEN 'out_of_scope' END AS gate FROM r)
SELECT s_suppkey, kind, node, gate IS NULL AS allowed, gate, TRUE AS dry_run FROM g"""


def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(F.col("ordinal").alias("event_id"), encode.event_json().alias("line"))


JSON_SQL = f"""
WITH {EV} SELECT event_id, concat('{{"ts":"', ts_text, '","cluster":"cluster-a"', CASE WHEN node = '' THEN '' ELSE concat(',"node":"', node, '"') END, ',"jobid":',
  CASE WHEN job IS NULL THEN 'null' ELSE concat('{{"raw":"', CAST(job AS STRING), '","base":', CAST(job AS STRING), '}}') END,
  ',"source":"', source, '","class":"', class, '","detail":{{"signature":"', signature, '","attrs":', attrs_key, '}}}}') AS line FROM ev"""


QUERIES = {f.__name__: f for f in (
    evidence_view, canonical_order, for_job_all, for_job_direct, for_job_node, for_job_skew, for_node_window, jobs_distinct, job_extent, skew_of, assumed_clocks, collapse_runs, timeline_lines,
    budget_drop, job_id_parse, job_id_invalid, validate_reject, merge_union, unread_except, multiset_diff, source_gaps, declared_classes, miss_by_kind, warning_agg, capability_gaps,
    capability_report, policy_decide, canonical_json,
)}
SQL = {
    "evidence_view": f"WITH {EV} SELECT event_id, ts_text, cluster, node, job, source, class, signature, attrs_key FROM ev",
    "canonical_order": f"WITH {EV} SELECT event_id, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY {ORDER}) AS place FROM ev",
    "for_job_all": _seq_sql(),
    "for_job_direct": _seq_sql(relations="'direct'"),
    "for_job_node": _seq_sql(relations="'direct', 'node'"),
    "for_job_skew": _seq_sql(before=SKEW["before"] + SKEW["skew"], after=SKEW["after"] + SKEW["skew"]),
    "for_node_window": f"WITH {EV} SELECT event_id, ts_text, job, class FROM ev WHERE node = '{NODE}' AND ts BETWEEN TIMESTAMP '{LO}' AND TIMESTAMP '{HI}'",
    "jobs_distinct": f"WITH {EV} SELECT DISTINCT cluster, job FROM ev WHERE job IS NOT NULL",
    "job_extent": f"""WITH {EV}, x AS (SELECT job, min(ts) AS a, max(ts) AS b, count(*) AS events, count(DISTINCT nullif(node, '')) AS nodes FROM ev WHERE job IS NOT NULL GROUP BY job)
SELECT job, {", ".join(f"strftime({e}, '%Y-%m-%dT%H:%M:%S.%f') || '000Z' AS {n}" for e, n in (("a", "first_ts"), ("b", "last_ts"), (f"a - INTERVAL {join.BEFORE} SECOND", "lo"), (f"b + INTERVAL {join.AFTER} SECOND", "hi")))}, events, nodes FROM x""",
    "skew_of": f"WITH {EV}, c AS (SELECT max((event_id % 1000 - 500) * 1000000) AS o FROM ev WHERE node <> '' GROUP BY source, node) SELECT coalesce(max(abs(o)), 0) AS skew_nanos FROM c",
    "assumed_clocks": f"WITH {EV} SELECT DISTINCT source, CAST(0 AS BIGINT) AS offset_nanos, 'assumed_zero' AS method FROM ev",
    "collapse_runs": _rows_sql() + f" SELECT CAST(job AS BIGINT) AS job, ord, count, {_TEXT_TS} AS ts_text, strftime(last, '%Y-%m-%dT%H:%M:%S.%f') || '000Z' AS last_text, relation, signature, node FROM c",
    "timeline_lines": _rows_sql() + f""" SELECT CAST(job AS BIGINT) AS job, ord,
  CASE WHEN lag(CAST(ts AS DATE)) OVER (PARTITION BY job ORDER BY ord) IS DISTINCT FROM CAST(ts AS DATE) THEN strftime(ts, '%Y-%m-%d') END AS day,
  concat('  ', strftime(ts, '%H:%M:%S'), ' ', CASE relation WHEN 'direct' THEN '*' WHEN 'cluster' THEN '~' ELSE ' ' END, ' ', rpad(source, CAST(max(strlen(source)) OVER (PARTITION BY job) AS INT), ' '), ' ',
    rpad(class, CAST(max(strlen(class)) OVER (PARTITION BY job) AS INT), ' '), ' ', {_TAIL}) AS line FROM c""",
    "budget_drop": BUDGET_SQL,
    "job_id_parse": JOB_PARSE_SQL,
    "job_id_invalid": JOB_INVALID_SQL,
    "validate_reject": VALIDATE_SQL,
    "merge_union": f"WITH {EV} SELECT source, class, count(*) AS n, min(event_id) AS first_id FROM ev GROUP BY source, class",
    "unread_except": "SELECT DISTINCT concat('capture-', CAST(user_id AS STRING), '.txt') AS name FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 100)",
    "multiset_diff": f"""WITH {EV}, d AS (SELECT class, signature, node, CAST(sum(CASE WHEN day(ts) <= 15 THEN 1 ELSE -1 END) AS BIGINT) AS d FROM ev GROUP BY class, signature, node)
SELECT class, signature, node, greatest(d, 0) AS missing, greatest(-d, 0) AS extra FROM d WHERE d <> 0""",
    "source_gaps": f"WITH {EV} SELECT source FROM (VALUES ('fabric'), ('gpu'), ('journal'), ('site'), ('slurm')) t(source) WHERE source NOT IN (SELECT source FROM ev)",
    "declared_classes": f"""WITH {EV}, k AS (SELECT node, class, CAST(hour(ts) AS INT) AS hour, day(ts) <= 15 AS early FROM ev)
SELECT node, class, hour, CASE WHEN bool_or(early) THEN 'declared' ELSE 'actual' END AS side FROM k GROUP BY node, class, hour HAVING bool_or(early) <> bool_or(NOT early)""",
    "miss_by_kind": "SELECT event_type AS kind, count(*) AS n FROM events GROUP BY ROLLUP (event_type)",
    "warning_agg": "SELECT event_type AS kind, count(*) AS n, min(event_id) AS first_line, arg_min(props, event_id) AS example FROM events GROUP BY event_type",
    "capability_gaps": f"WITH {_CAPS} SELECT source, name FROM c WHERE NOT available",
    "capability_report": f"WITH {_CAPS} SELECT source, count(*) AS capabilities, count(*) FILTER (WHERE NOT available) AS missing, bool_and(available) AS ok FROM c GROUP BY source",
    "policy_decide": POLICY_SQL,
    "canonical_json": JSON_SQL,
}
