"""Mixing sources to target weights by hash-random order, prefix sums and exact cuts.

Sizes are words ``[^\\x20\\x09-\\x0D]+`` (null text: 0). Every source gets a weight; targets share the total
by weight but stop at ``max_epochs`` times the source's size, the excess being shared again by weight until
none is above (a water level, found in closed form from the sources sorted by size over weight). Within a
source, documents are ordered by a seeded hash of doc_id (then doc_id and size, so ties and repeated rows
have a defined result). That order is cut at the source's budget ``floor(target)``: whole epochs first, then a
last partial epoch in which the document on the cut gives just the words still missing. A null source is a
source of its own, last in order. An empty source or total of zero takes nothing.

Scale: the hash is uniform, so its leading digits are range buckets of equal weight even inside one hot
source; running sums are made inside (source, bucket) and shifted by the buckets before. No task holds a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Stage, table

#: Hex digits of the hash that make a range bucket: 16 ** 3 buckets in each source.
BUCKET_DIGITS = 3
MAX_EPOCHS = 3
SEED = "mix-1"


def cyclic_weight(rank: Column) -> Column:
    """1, 2, 3, repeating, for ranks from 1."""
    return ((rank - 1) % 3 + 1).cast("long")


def targets(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Sources (source, source_size, weight) with their target.

    This is one row per source, already summed; the windows over it see sources, never documents.
    """
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    level = sources.select(
        "*", F.sum("source_size").over(all_rows).alias("total"), F.sum("weight").over(all_rows).alias("weights"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("below"), F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("gone"),
    )
    # capped sources are a prefix of this order: size * cap <= weight * what is left / weights that are left
    left, share = F.col("total") - max_epochs * F.col("below"), F.col("weights") - F.col("gone")
    capped = level.withColumn("capped", F.col("source_size").cast("double") * max_epochs * share <= F.col("weight").cast("double") * left)
    free = ~F.col("capped")
    rest = capped.select(
        "*", F.max(F.when(free, left)).over(all_rows).alias("pool"), F.max(F.when(free, share)).over(all_rows).alias("pool_weight")
    )
    return rest.select(
        "source", "source_size", "weight",
        F.when(F.col("capped"), (F.col("source_size") * max_epochs).cast("double")).otherwise((F.col("weight") * F.col("pool")).cast("double") / F.col("pool_weight").cast("double")).alias("target"),
    )


def mix(docs: DataFrame, stage: Stage, weight=cyclic_weight, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, key, source_size, target, epochs (whole ones), part (words of the last epoch), taken."""
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("key")
    rows = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), key)
    rows = rows.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    own = Window.partitionBy("source", "bucket")
    runs = own.orderBy("key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ran = rows.select("*", F.sum("size").over(runs).alias("ran"))
    ran = stage.put(ran, "ran")
    buckets = ran.groupBy("source", "bucket").agg(F.sum("size").alias("held"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select("source", "bucket", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("shift"))
    sources = ran.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = sources.select("*", weight(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).alias("weight"))
    goal = targets(ranked, max_epochs)
    shifts = buckets.alias("b").join(goal.alias("g"), F.col("b.source").eqNullSafe(F.col("g.source"))).select("b.source", "b.bucket", "shift", "source_size", "target")
    joined = ran.alias("r").join(shifts.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.bucket") == F.col("s.bucket")))
    budget = F.floor(F.col("target")).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    start = F.col("ran") - F.col("size") + F.col("shift")
    rest = budget - F.col("epochs") * F.col("source_size")
    out = joined.select("r.doc_id", "r.source", "size", "key", "source_size", "target", epochs.alias("epochs"), start.alias("start"))
    out = out.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start"))).cast("long"))
    return out.select("doc_id", "source", "size", "key", "source_size", "target", "epochs", "part", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"))


def apply_mix(docs: DataFrame, stage: Stage, **options) -> DataFrame:
    """The mixed documents, with the columns of ``docs``: each as often as its whole epochs say, and the one on a
    source's cut once more with just the words (and the white space between) that the budget still takes.

    Documents without words are neither cut nor needed by a budget: they stay once. Repeated rows (equal doc_id,
    source and size) share one decision, that of the row which the mix takes most of.
    """
    plan = mix(docs, stage, **options).groupBy("doc_id", "source", "size").agg(F.max("epochs").alias("epochs"), F.max("part").alias("part"))
    n = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    joined = docs.withColumn("__size", n).alias("d").join(
        plan.alias("p"), F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("__size") == F.col("p.size"))
    )
    whole = F.col("p.epochs") + F.when(F.col("p.size") == F.col("p.part"), 1).otherwise(0)
    copies = F.when(F.col("p.size") == 0, F.lit(1)).otherwise(whole).cast("int")
    cut = (F.col("p.part") > 0) & (F.col("p.part") < F.col("p.size"))
    kinds = F.concat(F.array_repeat(F.lit(False), copies), F.when(cut, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")))
    spread = joined.select("d.*", F.col("p.part").alias("__part"), F.explode(kinds).alias("__cut"))
    words = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.col("__part").cast("int")), "")
    kept = {c: F.col(c) for c in docs.columns}
    kept["text"] = F.when(F.col("__cut"), words).otherwise(F.col("text"))
    if "n_chars" in kept:
        kept["n_chars"] = F.when(F.col("__cut"), F.length(words).cast("long")).otherwise(F.col("n_chars"))
    return spread.select(*[c.alias(k) for k, c in kept.items()])


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"), Stage(spark, "op3"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "epochs", "part")


SQL = f"""
WITH r AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM r GROUP BY source
), o AS (
  SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
    coalesce(sum(source_size) OVER w, 0) AS below, coalesce(sum(weight) OVER w, 0) AS gone
  FROM s WINDOW w AS (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), c AS (
  SELECT *, total - {MAX_EPOCHS} * below AS lft, weights - gone AS share,
    CAST(source_size AS DOUBLE) * {MAX_EPOCHS} * (weights - gone) <= CAST(weight AS DOUBLE) * (total - {MAX_EPOCHS} * below) AS capped FROM o
), p AS (
  SELECT *, max(CASE WHEN NOT capped THEN lft END) OVER () AS pool, max(CASE WHEN NOT capped THEN share END) OVER () AS pool_weight FROM c
), t AS (
  SELECT source, source_size, CASE WHEN capped THEN CAST({MAX_EPOCHS} * source_size AS DOUBLE) ELSE CAST(weight * pool AS DOUBLE) / CAST(pool_weight AS DOUBLE) END AS target FROM p
), x AS (
  SELECT r.doc_id, r.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
    sum(r.size) OVER (PARTITION BY r.source ORDER BY r.key, r.doc_id NULLS FIRST, r.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - r.size AS start
  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source
), e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM x),
f AS (SELECT *, CAST(greatest(0, least(size, budget - epochs * source_size - start)) AS BIGINT) AS part FROM e)
SELECT doc_id, size, source_size, target, CAST(epochs * size + part AS BIGINT) AS taken, CAST(epochs AS BIGINT) AS epochs, part FROM f
"""
