"""Shared-folder staging, table loading and block exchange for the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word-based contract: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the cluster's ``spark.checkpoint.dir``.

    Only where neither the setting nor a context checkpoint folder exists (tests on one machine)
    is a folder of our own made and recorded in the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("spark.sparkvigil.stage.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="sparkvigil-")
        spark.conf.set("spark.sparkvigil.stage.dir", found)
    return found.rstrip("/")


class Stage:
    """Tables written once to the shared folder, so that lineage ends there and survives lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/sparkvigil-{name}-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes staged tables that no later step reads."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def tidy(self) -> None:
        """Lets Spark delete shuffle files whose plans are no longer referenced."""
        gc.collect()
        self.spark._jvm.System.gc()


#: Input bytes, as stored, that a block stands for at most.
PART_BYTES = 64 << 20


def parts(docs: DataFrame) -> int:
    """Number of blocks that keyed data is dealt into: the session's shuffle partitions, more if the input is larger than so many
    blocks of ``PART_BYTES``."""
    leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.length())]
    stored = sum(x for x in sizes if x < 1 << 60)  # rows of an RDD have no size
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, least, -(-stored // PART_BYTES))


def dealt(df: DataFrame, n: int) -> DataFrame:
    """Rows with an int ``part`` below n go to the task of that number."""
    return df.repartitionById(n, F.col("part"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
