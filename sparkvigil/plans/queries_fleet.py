"""Queries over fleets: drift of customers against their nation, profile comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import attrs_key
from ..operators import drift
from .evidence import table, ts_text

CAPTURED = "TIMESTAMP '2024-03-01 00:00:00' + INTERVAL '1' HOUR * (c_custkey % 60)"


def fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long-form profiles: fleet = nation, node = customer, keys segment and balance (ok unless it is negative)."""
    c = table(spark, sf_dir, "customer")
    keys = F.array(F.struct(F.lit("segment").alias("key"), F.col("c_mktsegment").alias("value")), F.struct(F.lit("balance").alias("key"), F.when(F.col("c_acctbal") >= 0, "ok").alias("value")))
    taken = F.timestamp_seconds(F.lit(1709251200) + (F.col("c_custkey") % 60) * 3600)
    return c.select(F.col("c_nationkey").cast("string").alias("cluster"), F.col("c_custkey").cast("string").alias("node"), taken.alias("captured_at"), F.explode(keys).alias("k")).select("cluster", "node", "captured_at", "k.key", "k.value")


def fleet_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.drifts(fleet(spark, sf_dir))


def fleet_undecided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.undecided(fleet(spark, sf_dir))


def fleet_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of fleets of at most 60, by a stricter floor than the default, so that both sides occur."""
    return drift.refused(fleet(spark, sf_dir), min_peers=59)


def capture_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = drift.capture_spread(fleet(spark, sf_dir))
    return s.select("cluster", ts_text("oldest").alias("oldest"), ts_text("newest").alias("newest"), "spread_seconds", "stale")


def drift_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = drift.drift_events(fleet(spark, sf_dir))
    return e.select(ts_text().alias("ts_text"), "cluster", "node", F.col("detail.signature").alias("signature"), attrs_key(F.col("detail.attrs")).alias("attrs_key"))


def _profile(df: DataFrame, nation: str, balance: str) -> DataFrame:
    facts = df.groupBy(F.col(nation).alias("nation")).agg(
        F.count("*").cast("string").alias("count"), F.when(F.min(balance) < 0, "debt").otherwise("").alias("debt"), F.when(F.max(balance) > 9000, "rich").otherwise("plain").alias("kind")
    )
    return facts.selectExpr("nation", "stack(3, 'count', count, 'debt', debt, 'kind', kind) as (key, value)")


def profile_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _profile(table(spark, sf_dir, "customer"), "c_nationkey", "c_acctbal")
    b = _profile(table(spark, sf_dir, "supplier"), "s_nationkey", "s_acctbal")
    return drift.compare_profiles(a, b, ["nation"])


_FLEET = f"""f AS (
  SELECT CAST(c_nationkey AS STRING) AS cluster, CAST(c_custkey AS STRING) AS node, {CAPTURED} AS captured_at, 'segment' AS key, c_mktsegment AS value FROM customer
  UNION ALL SELECT CAST(c_nationkey AS STRING), CAST(c_custkey AS STRING), {CAPTURED}, 'balance', CASE WHEN c_acctbal >= 0 THEN 'ok' END FROM customer
), s AS (SELECT cluster, count(DISTINCT node) AS nodes, min(captured_at) AS oldest, max(captured_at) AS newest FROM f GROUP BY cluster),
v AS (SELECT cluster, node, key, coalesce(nullif(value, ''), '(absent)') AS value FROM f JOIN s USING (cluster) WHERE nodes > 3),
p AS (
  SELECT t.cluster, t.node, t.key, t.value AS observed, o.value AS expected, o.n - CASE WHEN o.value = t.value THEN 1 ELSE 0 END AS votes, s.nodes - 1 AS peers
  FROM v t JOIN s ON s.cluster = t.cluster JOIN (SELECT cluster, key, value, count(*) AS n FROM v GROUP BY cluster, key, value) o ON o.cluster = t.cluster AND o.key = t.key
), m AS (SELECT * FROM p WHERE 2 * votes > peers),
d AS (SELECT cluster, node, key, observed, expected, peers AS peer_count, votes AS peer_majority FROM m WHERE observed <> expected)"""
_T = "strftime({}, '%Y-%m-%dT%H:%M:%S.%f') || '000Z'"


def _profile_sql(t: str, nation: str, balance: str) -> str:
    return f"""SELECT nation, unnest(['count', 'debt', 'kind']) AS key, unnest([n, debt, kind]) AS value FROM (
    SELECT {nation} AS nation, CAST(count(*) AS STRING) AS n, CASE WHEN min({balance}) < 0 THEN 'debt' ELSE '' END AS debt, CASE WHEN max({balance}) > 9000 THEN 'rich' ELSE 'plain' END AS kind FROM {t} GROUP BY {nation})"""


QUERIES = {f.__name__: f for f in (fleet_drift, fleet_undecided, fleet_refused, capture_spread, drift_events, profile_compare)}
SQL = {
    "fleet_drift": f"WITH {_FLEET} SELECT * FROM d",
    "fleet_undecided": f"WITH {_FLEET} SELECT cluster, node, key FROM v WHERE (cluster, node, key) NOT IN (SELECT (cluster, node, key) FROM m)",
    "fleet_refused": f"WITH {_FLEET} SELECT DISTINCT f.cluster, f.node, s.nodes - 1 AS siblings FROM f JOIN s USING (cluster) WHERE s.nodes <= 59",
    "capture_spread": f"WITH {_FLEET} SELECT cluster, {_T.format('oldest')} AS oldest, {_T.format('newest')} AS newest, CAST(epoch(newest) - epoch(oldest) AS BIGINT) AS spread_seconds, epoch(newest) - epoch(oldest) > 86400 AS stale FROM s",
    "drift_events": f"""WITH {_FLEET} SELECT {_T.format('s.newest')} AS ts_text, d.cluster, d.node, concat('site.drift.', d.key) AS signature,
  concat('{{"expected":"', expected, '","key":"', d.key, '","observed":"', observed, '","peer_count":"', CAST(peer_count AS STRING), '","peer_majority":"', CAST(peer_majority AS STRING), '"}}') AS attrs_key FROM d JOIN s USING (cluster)""",
    "profile_compare": f"""WITH a AS ({_profile_sql('customer', 'c_nationkey', 'c_acctbal')}), b AS ({_profile_sql('supplier', 's_nationkey', 's_acctbal')})
SELECT coalesce(a.nation, b.nation) AS nation, coalesce(a.key, b.key) AS key, coalesce(a.value, '') AS recorded, coalesce(b.value, '') AS probed
FROM a FULL JOIN b ON a.nation = b.nation AND a.key = b.key WHERE coalesce(a.value, '') <> coalesce(b.value, '')""",
}
