"""Fleet drift: every node against the strict majority of its siblings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_PEERS = 3
ABSENT = "(absent)"
STALE_HOURS = 24


def long_form(profiles: DataFrame) -> DataFrame:
    """cluster, node, captured_at, key, value of node profiles with a ``keys`` map."""
    return profiles.select("cluster", "node", "captured_at", F.explode_outer("keys").alias("key", "value"))


def fleet(values: DataFrame) -> DataFrame:
    """cluster, nodes (count), oldest, newest capture; null captures don't count."""
    return values.groupBy("cluster").agg(F.count_distinct("node").alias("nodes"), F.min("captured_at").alias("oldest"), F.max("captured_at").alias("newest"))


def grid(values: DataFrame, min_peers: int = MIN_PEERS) -> DataFrame:
    """cluster, node, key, value, nodes for each node and each key seen in its cluster; missing and empty are ABSENT."""
    sizes = fleet(values).filter(F.col("nodes") > min_peers)
    nodes = values.select("cluster", "node").distinct().join(sizes.select("cluster", "nodes"), "cluster")
    keys = values.filter("key is not null").select("cluster", "key").distinct()
    held = values.filter("key is not null").groupBy("cluster", "node", "key").agg(F.max("value").alias("value"))
    full = nodes.join(keys, "cluster").join(held, ["cluster", "node", "key"], "left")
    return full.withColumn("value", F.coalesce(F.nullif("value", F.lit("")), F.lit(ABSENT)))


def verdicts(values: DataFrame, min_peers: int = MIN_PEERS) -> DataFrame:
    """The grid with expected, peer_count, peer_majority; expected is null where siblings have no strict majority.

    A node's own vote is taken off the fleet's tally. A value can only win for someone if its tally is over half the
    siblings, which two values can be at most (an even split), so a key has two candidates at most.
    """
    cells = grid(values, min_peers)
    tally = cells.groupBy("cluster", "key", "value", "nodes").agg(F.count("*").alias("n"))
    strong = tally.filter(2 * F.col("n") > F.col("nodes") - 1).groupBy("cluster", "key").agg(F.collect_list(F.struct("value", "n")).alias("strong"))
    joined = cells.join(strong, ["cluster", "key"], "left")
    own = lambda s: s["n"] - F.when(s["value"] == F.col("value"), 1).otherwise(0)
    won = F.filter(F.coalesce("strong", F.array().cast("array<struct<value:string,n:bigint>>")), lambda s: 2 * own(s) > F.col("nodes") - 1)
    winner = F.get(won, F.lit(0))
    return joined.select("cluster", "node", "key", F.col("value").alias("observed"), winner["value"].alias("expected"), (F.col("nodes") - 1).alias("peer_count"), own(winner).alias("peer_majority"))


def drifts(values: DataFrame, min_peers: int = MIN_PEERS) -> DataFrame:
    return verdicts(values, min_peers).filter("expected <> observed")


def undecided(values: DataFrame, min_peers: int = MIN_PEERS) -> DataFrame:
    return verdicts(values, min_peers).filter("expected is null").select("cluster", "node", "key")


def refused(values: DataFrame, min_peers: int = MIN_PEERS) -> DataFrame:
    """Nodes with too few siblings for a majority to mean anything."""
    small = fleet(values).filter(F.col("nodes") <= min_peers)
    nodes = values.select("cluster", "node").distinct()
    return nodes.join(small, "cluster").select("cluster", "node", (F.col("nodes") - 1).alias("siblings"))


def capture_spread(values: DataFrame) -> DataFrame:
    """Oldest and newest capture of each cluster, seconds between, and whether that is stale."""
    spread = F.coalesce(F.unix_seconds("newest") - F.unix_seconds("oldest"), F.lit(0))
    return fleet(values).select("cluster", "oldest", "newest", spread.alias("spread_seconds"), (spread > STALE_HOURS * 3600).alias("stale"))


def drift_events(values: DataFrame, min_peers: int = MIN_PEERS) -> DataFrame:
    """Drifts as events, at the newest capture of their cluster."""
    found = drifts(values, min_peers).join(fleet(values).select("cluster", "newest"), "cluster")
    attrs = F.create_map(
        F.lit("key"), F.col("key"), F.lit("observed"), F.col("observed"), F.lit("expected"), F.col("expected"),
        F.lit("peer_count"), F.col("peer_count").cast("string"), F.lit("peer_majority"), F.col("peer_majority").cast("string"),
    )
    return found.select(
        F.col("newest").alias("ts"), "cluster", "node", F.lit("site").alias("source"), F.lit("config.drift").alias("class"),
        F.struct(F.concat(F.lit("site.drift."), F.col("key")).alias("signature"), attrs.alias("attrs")).alias("detail"),
    )


def compare_profiles(recorded: DataFrame, probed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, key, recorded, probed where two long forms (keys, key, value) differ; missing and empty are alike."""
    a = recorded.select(*keys, "key", F.coalesce("value", F.lit("")).alias("recorded"))
    b = probed.select(*keys, "key", F.coalesce("value", F.lit("")).alias("probed"))
    both = a.join(b, [*keys, "key"], "full_outer").na.fill("", ["recorded", "probed"])
    return both.filter(F.col("recorded") != F.col("probed"))
