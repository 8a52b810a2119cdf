"""Queries of the reports: every job's context, every source's capabilities, every node against its fleet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import join, report
from . import evidence
from .evidence import EV, events
from .queries_events import _TAIL, cut_sql
from .queries_fleet import _FLEET, fleet

#: Tokens of a job's report, of which some jobs need more.
LIMIT = 400


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One capability of each event type, there if the type has an even number of events."""
    e = evidence.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("source")).agg((F.count("*") % 2 == 0).alias("available"))
    return e.select(F.lit("cluster-a").alias("cluster"), "source", F.lit("volume").alias("name"), F.lit("unprivileged").alias("level"), "available", F.lit("read by type").alias("detail"), F.concat(F.lit("all of type "), "source").alias("reveals"))


def context_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = events(spark, sf_dir).groupBy("cluster").agg(F.count_if(F.col("detail.attrs")["severity"] == "info").alias("n"))
    lines = report.context_lines(events(spark, sf_dir), _gaps(spark, sf_dir), odd, limit=LIMIT, cluster_scope=True)
    return lines.select(F.col("job").cast("long").alias("job"), "section", "ord", "line")


def doctor_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A capability for each node that a source has an event of, there if the two have an even number of events."""
    e = events(spark, sf_dir)
    found = e.filter("node <> ''").groupBy("source", F.col("node").alias("name")).agg((F.count("*") % 2 == 0).alias("available"))
    caps = found.select("source", "name", F.lit("unprivileged").alias("level"), "available", F.lit(None).cast("string").alias("detail"), F.concat(F.lit("events of "), "name").alias("reveals"))
    return report.doctor_lines(caps, e, e.filter(F.col("detail.attrs")["severity"] == "error"))


def diff_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.diff_lines(fleet(spark, sf_dir))


_IN = "FILTER (WHERE relation = 'direct')"
_NODES = "FILTER (WHERE relation = 'direct' AND node <> '')"
_AT = "strftime({} {} INTERVAL {} SECOND, '%Y-%m-%d %H:%M:%S')"
_HEAD = f""", h AS (
  SELECT job, CAST(sum(count) AS BIGINT) AS n, CAST(sum(count) {_IN} AS BIGINT) AS own_n, min(ts) {_IN} AS lo, max(last) {_IN} AS hi,
    list_sort(list(DISTINCT node) {_NODES}) AS nodes, count(DISTINCT node) {_NODES} AS nn FROM c GROUP BY job
), gap AS (SELECT event_type AS source FROM events GROUP BY event_type HAVING count(*) % 2 <> 0),
tail AS (SELECT list_concat(['NOT SEEN'], coalesce(
    (SELECT flatten(list([concat('  ', source, '/volume (unprivileged): read by type'), concat('      lost: all of type ', source)] ORDER BY source)) FROM gap), ['  (nothing)']),
  (SELECT CASE WHEN count(*) > 0 THEN [concat(CAST(count(*) AS STRING), ' lines matched no signature')] ELSE [] END FROM events WHERE value < 20 OR value IS NULL)) AS tail),
hl AS (
  SELECT job, tail, list_concat([concat('job ', CAST(job AS STRING), ' on cluster-a'),
    concat('schema v2, ', CAST(n AS STRING), ' events, ', CAST(own_n AS STRING), ' with the job''s own id, ', CAST(nn AS STRING), ' nodes'),
    concat('window ', {_AT.format('lo', '-', join.BEFORE)}, ' to ', {_AT.format('hi', '+', join.AFTER)}, ' UTC'), 'redaction: none, names are real'],
    CASE WHEN nn > 0 THEN [concat('nodes: ', array_to_string(nodes, ', '))] ELSE [] END) AS head FROM h, tail
), sp AS (
  SELECT job, greatest(0, {LIMIT} - (strlen(array_to_string(head, chr(10))) + 4) // 4 - (strlen(array_to_string(tail, chr(10))) + 4) // 4 - {report.TRAILER}) AS room FROM hl
)"""
CONTEXT_SQL = cut_sql("sp.room", "JOIN sp ON sp.job = t.job").replace(", b AS (", _HEAD + ", b AS (", 1) + f""", e AS (SELECT k.* FROM k JOIN f ON k.job = f.job AND k.rk > f.cut),
tl AS (
  SELECT job, ord, CASE WHEN lag(CAST(ts AS DATE)) OVER (PARTITION BY job ORDER BY ord) IS DISTINCT FROM CAST(ts AS DATE) THEN strftime(ts, '%Y-%m-%d') END AS day,
    concat('  ', strftime(ts, '%H:%M:%S'), ' ', CASE relation WHEN 'direct' THEN '*' WHEN 'cluster' THEN '~' ELSE ' ' END, ' ', rpad(source, CAST(max(strlen(source)) OVER (PARTITION BY job) AS INT), ' '), ' ',
      rpad(class, CAST(max(strlen(class)) OVER (PARTITION BY job) AS INT), ' '), ' ', {_TAIL}) AS line FROM e
), o AS (
  SELECT job, 0 AS section, unnest(range(len(head))) AS ord, unnest(head) AS line FROM hl
  UNION ALL SELECT job, 1, ord * 2, concat('  [', day, ']') FROM tl WHERE day IS NOT NULL
  UNION ALL SELECT job, 1, ord * 2 + 1, line FROM tl
  UNION ALL SELECT k.job, 2, 0, concat(CAST(count(*) AS STRING), ' rows left out to fit {LIMIT} tokens, the farthest from the job''s own events first') FROM k JOIN f ON k.job = f.job AND k.rk <= f.cut GROUP BY k.job
  UNION ALL SELECT job, 3, unnest(range(len(tail))), unnest(tail) FROM hl
) SELECT CAST(job AS BIGINT) AS job, section, CAST(ord AS BIGINT) AS ord, line FROM o"""
DOCTOR_SQL = f"""WITH {EV}, p AS (SELECT source, node, count(*) % 2 = 0 AS ok FROM ev WHERE node <> '' GROUP BY source, node),
g AS (SELECT source, flatten(list(CASE WHEN ok THEN [concat('  ok   ', node, ' (unprivileged)')] ELSE [concat('  MISS ', node, ' (unprivileged)'), concat('       without it: events of ', node)] END ORDER BY node)) AS found FROM p GROUP BY source),
n AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE attrs_key LIKE '%"severity":"error"%') AS odd FROM ev GROUP BY source),
w AS (SELECT source, list_concat([source], coalesce(found, ['  (declares no capabilities)']), [concat('  ', CAST(n AS STRING), ' events', CASE WHEN odd > 0 THEN concat(', ', CAST(odd AS STRING), ' warnings') ELSE '' END)]) AS lines FROM n LEFT JOIN g USING (source))
SELECT source, 0 AS section, unnest(range(len(lines))) AS ord, unnest(lines) AS line FROM w"""
DIFF_SQL = f"""WITH {_FLEET}, a AS (
  SELECT cluster, node, flatten(list([concat('  ', key, ': ', observed), concat('    ', CAST(peer_majority AS STRING), ' of ', CAST(peer_count AS STRING), ' siblings: ', expected)] ORDER BY key)) AS apart FROM d GROUP BY cluster, node
), u AS (SELECT cluster, node, list(concat('  ', key) ORDER BY key) AS open FROM v WHERE (cluster, node, key) NOT IN (SELECT (cluster, node, key) FROM m) GROUP BY cluster, node),
r AS (SELECT DISTINCT f.cluster, f.node, s.nodes, epoch(s.newest) - epoch(s.oldest) AS seconds FROM f JOIN s ON s.cluster = f.cluster),
w AS (
  SELECT cluster, node, list_concat([concat('node ', node, ' of cluster ', cluster)], CASE WHEN nodes <= 3 THEN [concat('not compared: ', CAST(nodes - 1 AS STRING), ' siblings, 3 are needed')] ELSE
    list_concat([concat(CAST(nodes - 1 AS STRING), ' siblings')],
      CASE WHEN seconds > 86400 THEN [concat('captures span ', CAST(CAST(round_even(seconds / 86400, 0) AS BIGINT) AS STRING), 'd: what differs may be when they were read')] ELSE [] END,
      CASE WHEN apart IS NULL THEN ['no divergence on any key'] ELSE list_concat(['DIVERGENCE FROM THE MAJORITY'], apart) END,
      CASE WHEN open IS NULL THEN [] ELSE list_concat(['NO MAJORITY'], open) END) END) AS lines
  FROM r LEFT JOIN a USING (cluster, node) LEFT JOIN u USING (cluster, node)
) SELECT cluster, node, 0 AS section, unnest(range(len(lines))) AS ord, unnest(lines) AS line FROM w"""

QUERIES = {f.__name__: f for f in (context_report, doctor_report, diff_report)}
SQL = {"context_report": CONTEXT_SQL, "doctor_report": DOCTOR_SQL, "diff_report": DIFF_SQL}
