"""The corpus pipeline: language ID, near-duplicate removal, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and is written and read again as
Parquet in the cluster's shared folder. All but the last return the columns of ``documents``. Null ids and texts,
empty texts, repeated rows and empty tables go through; see each operator for what becomes of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkvigil.llm import contamination, jaccard, langid, mixing, sharding
from sparkvigil.llm.common import Stage, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that language ID rejects: those without a letter, or far from every centroid."""
    model = langid.train(docs.filter(langid.fold_of(F.col("doc_id")) != 1))
    return langid.identify(docs, model).filter("not rejected").drop("lang_pred", "score", "rejected")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group, that of smallest doc_id (null ids last, ties to the smaller hash of id and text); of
    rows that repeat id and text one. Rows are judged one by one: by a key of id and text, not by their id."""
    stage = Stage(spark, "pipeline-near")
    keyed = docs.withColumn("__key", F.xxhash64("doc_id", "text"))
    found = jaccard.join_components(keyed.select(F.col("__key").alias("doc_id"), "text"), stage)
    groups = found.select(F.col("doc_id").alias("__key"), F.col("component_id").alias("__group")).distinct()
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__key"))["__key"]
    kept = keyed.select("__key", "doc_id").join(groups, "__key").groupBy("__group").agg(first.alias("__key")).select("__key").distinct()
    rest = [F.hash(c) for c in docs.columns if c not in ("doc_id", "text")]
    once = F.row_number().over(Window.partitionBy("__key").orderBy(*rest, F.col("doc_id")))
    return keyed.join(kept, "__key", "left_semi").withColumn("__n", once).filter("__n = 1").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item."""
    return contamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats, keeps or cuts documents so that sources come to their target shares."""
    return mixing.apply_mix(docs, Stage(spark, "pipeline-mix"))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each row of the mix."""
    return sharding.shard(docs, Stage(spark, "pipeline-shard"), carry=("lang", "source", "n_chars"))


STAGES = [("language_id", language), ("jaccard_join", near_duplicates), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]
#: Label propagation and language ID aren't SQL; the tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    stage = Stage(spark, "pipeline")
    for name, step in STAGES[:-1]:
        docs = stage.put(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
