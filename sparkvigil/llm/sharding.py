"""Sharding by balanced label propagation, with exact row quotas.

Documents are linked by a group (here: equal text; null texts are linked with nothing). Labels are shards.
Each document starts at a hash-random shard; every round, the part of a group that lies outside the shard where
most of the group is asks to move there, and the shards grant moves within their room, which is free capacity and
what leaves in the same round: a small part of a group moves whole with the probability room / demand, a large part
moves just the granted share, rounded at random. Rounds go on until few rows ask to move, ``ROUNDS`` at most. They work on one row per
group (its count in each shard), so a group of a third of all rows is one short row, and what the driver sees in a
round is a load for each shard and a demand for each pair of shards. Only groups of two or more rows take part;
single documents are free to fill the shards up.

Afterwards every shard gets exactly its quota (rows // shards, one more for the first rows % shards): members of a
group are numbered and dealt to the group's shards, what exceeds a quota and all single documents fill the free
slots in hash order. Law ``rows``: counts differ by one at most, slots are 0, 1, 2, ... in each shard.

Numbering is a running count in hash buckets shifted by the buckets before, so no task holds a group or shard.
Null doc_id and repeated rows are rows like others; ties are rows equal in every column used, which are
interchangeable. An empty table gives no rows. Columns named like those made here do not clash: only doc_id and
text are read, and ``carry`` names those handed through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stage, table

N_SHARDS = 8
#: Rounds at most; they end before, when at most SETTLED of the linked rows ask to move.
ROUNDS = 12
SETTLED = 0.001
#: Buckets over which running counts are dealt.
BUCKETS = 256
#: Part of a shard's room (free capacity and departures) that one round may grant, so that random grants seldom exceed a quota.
GRANT = 0.95


def _unit(*cols: Column | str) -> Column:
    """Hash-random number from 0 to 1 (not reached)."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)).cast("double") / float(1 << 30)


def _number(df: DataFrame, stage: Stage, name: str, keys: list[str], order: list[Column], bucket: Column) -> DataFrame:
    """Adds ``nr``: rows numbered from 0 within keys, bucket by bucket."""
    own = Window.partitionBy(*keys, "__b").orderBy(*order)
    held = stage.put(df.withColumn("__b", bucket).withColumn("__r", F.row_number().over(own)), name)
    counts = held.groupBy(*keys, "__b").agg(F.count("*").alias("__n"))
    before = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(*keys, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__s"))
    return held.join(shifts, [*keys, "__b"]).withColumn("nr", F.col("__r") - 1 + F.col("__s")).drop("__b", "__r", "__s")


def _grants(load: list[int], flow: list[list[int]], capacity: float) -> tuple[list[float], list[float]]:
    """Share of the moves into each shard that is granted, and the rows that makes: a shard has room for its free
    capacity and for what leaves it in the same round, which in turn depends on the others' grants."""
    shards = range(len(load))
    ask = [sum(flow[i][s] for i in shards) for s in shards]
    rate = [1.0] * len(load)
    for _ in range(200):  # from above, so that exchanges aren't held up by each other
        leaves = [sum(flow[s][t] * rate[t] for t in shards) for s in shards]
        room = [max(0.0, capacity - load[s] + leaves[s]) for s in shards]
        now = [min(rate[s], room[s] / ask[s]) if ask[s] else 0.0 for s in shards]
        if max(abs(a - b) for a, b in zip(rate, now)) < 1e-4:
            break
        rate = now
    rate = [r * GRANT for r in rate]
    return rate, [r * a for r, a in zip(rate, ask)]


def propagate(groups: DataFrame, stage: Stage, capacity: float, n_shards: int = N_SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """groups (g1, g2, held: array of counts by shard) after label propagation under the capacity of each shard."""
    shards = range(n_shards)
    for turn in range(rounds):
        best = F.array_max(F.transform("held", lambda n, i: F.struct(n.alias("n"), F.pmod(F.xxhash64("g1", i), F.lit(1009)).alias("tie"), i.alias("i"))))["i"]
        asked = groups.withColumn("best", best).withColumn("away", F.aggregate("held", F.lit(0).cast("long"), lambda a, n: a + n) - F.get("held", F.col("best")))
        sums = [F.sum(F.get("held", F.lit(s))).alias(f"load{s}") for s in shards]
        sums += [F.sum(F.when(F.col("best") == s, F.get("held", F.lit(i)))).alias(f"ask{i}_{s}") for i in shards for s in shards if i != s]
        told = asked.agg(*sums).first()  # what each shard holds, and what asks to go from one to another
        load = [told[f"load{s}"] or 0 for s in shards]
        flow = [[told[f"ask{i}_{s}"] or 0 if i != s else 0 for s in shards] for i in shards]
        if sum(map(sum, flow)) <= SETTLED * sum(load):
            break
        rate, free = _grants(load, flow, capacity)
        grant = F.get(F.array(*map(F.lit, rate)), F.col("best"))
        whole = F.get(F.array(*map(F.lit, [f / 50 for f in free])), F.col("best"))
        luck = _unit("g1", "g2", F.lit(turn))

        def leaves(n, i):  # used at once
            share = F.floor(n * grant + _unit("g1", "g2", F.lit(turn), i))  # rounded at random: cut down, small parts never moved
            return F.when(i == F.col("best"), F.lit(0)).when(F.col("away") <= whole, F.when(luck < grant, n).otherwise(0)).otherwise(share).cast("long")

        gone = F.transform("held", leaves)
        moved = asked.withColumn("gone", gone).withColumn("in", F.aggregate("gone", F.lit(0).cast("long"), lambda a, n: a + n))
        held = F.transform("held", lambda n, i: (n - F.get("gone", i) + F.when(i == F.col("best"), F.col("in")).otherwise(0)).cast("long"))
        groups = stage.put(moved.select("g1", "g2", held.alias("held")), f"round{turn}")
    return groups


def shard(docs: DataFrame, stage: Stage, n_shards: int = N_SHARDS, rounds: int = ROUNDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size (UTF-8 bytes + 1), text_crc32, shard, slot, and the carried columns."""
    text = F.coalesce("text", F.lit(""))
    own = F.when(F.col("text").isNull(), F.xxhash64("doc_id")).otherwise(F.lit(0))
    rows = docs.select(
        "doc_id", *carry, (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        F.xxhash64(text, own).alias("g1"), F.when(F.col("text").isNull(), F.lit(-1).cast("long")).otherwise(F.shiftleft(F.crc32(F.encode(text, "utf-8")), 31) + F.octet_length(text)).alias("g2"),
    )
    rows = stage.put(rows.withColumn("label", F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(n_shards)).cast("int")), "rows")
    n = rows.count()
    quota = [n // n_shards + (s < n % n_shards) for s in range(n_shards)]
    cells = rows.groupBy("g1", "g2").agg(*[F.sum((F.col("label") == s).cast("long")).alias(f"c{s}") for s in range(n_shards)])
    held = cells.select("g1", "g2", F.array(*[f"c{s}" for s in range(n_shards)]).alias("held"))
    size = F.aggregate("held", F.lit(0).cast("long"), lambda a, x: a + x)
    linked = stage.put(held.withColumn("members", size).filter("members > 1 and g2 <> -1").drop("members"), "linked")
    linked = propagate(linked, stage, float(min(quota)), n_shards, rounds)

    # members of a group are dealt in order to the group's shards
    marked = rows.drop("label").alias("r").join(linked.alias("l"), ["g1", "g2"], "left")
    order = [F.col("doc_id").asc_nulls_first(), F.col("size"), *[F.hash(c).asc_nulls_first() for c in carry]]
    bucket = F.pmod(F.xxhash64("doc_id", F.lit("rank")), F.lit(BUCKETS)).cast("int")
    members = _number(marked.filter("held is not null"), stage, "members", ["g1", "g2"], order, bucket)
    ends = F.transform("held", lambda x, i: F.aggregate(F.slice("held", 1, i + 1), F.lit(0).cast("long"), lambda a, y: a + y))
    placed = members.withColumn("shard", F.size(F.filter(ends, lambda e: e <= F.col("nr")))).drop("held", "nr")
    # numbers in each shard, groups together; those within the quota stay
    by_group = F.pmod(F.col("g1"), F.lit(BUCKETS)).cast("int")
    large = F.pmod(F.xxhash64("doc_id", F.lit("slot")), F.lit(BUCKETS)).cast("int")
    numbered = _number(placed, stage, "placed", ["shard"], [F.col("g1"), F.col("g2"), *order], (by_group * BUCKETS + large).cast("int"))
    limit = F.get(F.array(*[F.lit(int(q)).cast("long") for q in quota]), F.col("shard"))
    numbered = stage.put(numbered.withColumn("fits", F.col("nr") < limit), "numbered")
    taken = {r["shard"]: r["n"] for r in numbered.filter("fits").groupBy("shard").agg(F.count("*").alias("n")).collect()}  # one row a shard
    kept = numbered.filter("fits").select("doc_id", *carry, "size", "text_crc32", "shard", F.col("nr").alias("slot"))
    free = numbered.filter("not fits").drop("shard", "nr", "fits").unionByName(marked.filter("held is null").drop("held"))
    free = _number(free, stage, "free", [], [F.xxhash64("doc_id", F.lit("fill")), *order, F.col("g1"), F.col("g2")], F.floor(_unit("doc_id", F.lit("fill")) * (BUCKETS * 16)).cast("int"))
    gaps = [q - taken.get(s, 0) for s, q in enumerate(quota)]
    ends_at = [sum(gaps[: s + 1]) for s in range(n_shards)]
    into = F.size(F.filter(F.array(*[F.lit(int(e)).cast("long") for e in ends_at]), lambda e: e <= F.col("nr")))
    first = F.get(F.array(*[F.lit(int(taken.get(s, 0) - ends_at[s] + gaps[s])).cast("long") for s in range(n_shards)]), F.col("shard"))
    filled = free.withColumn("shard", into).withColumn("slot", F.col("nr") + first).select("doc_id", *carry, "size", "text_crc32", "shard", "slot")
    return kept.unionByName(filled).withColumn("shard", F.col("shard").cast("int")).withColumn("slot", F.col("slot").cast("long"))


def op7_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"), Stage(spark, "op7"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
