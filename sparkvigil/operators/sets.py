"""Set operations and gap reports: what was not read, not covered, not seen, or missed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S


def unread(files: DataFrame, seen: DataFrame) -> DataFrame:
    """Input names that no reader consumed."""
    return files.select("name").distinct().join(seen.select("name"), "name", "left_anti").orderBy("name")


def symmetric_difference(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """Distinct rows on one side only, with the side."""
    a, b = declared.distinct(), actual.distinct()
    return a.exceptAll(b).withColumn("side", F.lit("declared")).unionByName(b.exceptAll(a).withColumn("side", F.lit("actual")))


def multiset_difference(expected: DataFrame, got: DataFrame, keys: list[str]) -> DataFrame:
    """keys, missing, extra: how many more of each key one side has. One aggregation over both."""
    both = expected.select(*keys, F.lit(1).alias("d")).unionByName(got.select(*keys, F.lit(-1).alias("d")))
    diff = both.groupBy(*keys).agg(F.sum("d").alias("d")).filter("d <> 0")
    return diff.select(*keys, F.greatest("d", F.lit(0)).cast("long").alias("missing"), F.greatest(-F.col("d"), F.lit(0)).cast("long").alias("extra"))


def source_gaps(events: DataFrame) -> DataFrame:
    """Collector-backed sources without an event."""
    spark = events.sparkSession
    known = spark.createDataFrame([(s,) for s in S.SOURCES if s not in S.UNREAD_SOURCES], "source string")
    return known.join(events.select("source").distinct(), "source", "left_anti").orderBy("source")


def capabilities_missing(capabilities: DataFrame) -> DataFrame:
    return capabilities.filter("not available").orderBy("name", "source")


def capability_report(capabilities: DataFrame) -> DataFrame:
    """Per source: how many capabilities there are, how many are missing, and whether all are there."""
    missing = F.count_if(~F.col("available"))
    return capabilities.groupBy("source").agg(F.count("*").alias("capabilities"), missing.alias("missing"), F.bool_and("available").alias("ok"))


def miss_counts(misses: DataFrame) -> DataFrame:
    """Misses by kind, and their total under a null kind."""
    return misses.rollup("kind").agg(F.count("*").alias("n"))


def aggregated_warnings(lines: DataFrame, kind: str = "kind", line_no: str = "line_no", example: str = "line") -> DataFrame:
    """One row for each kind of bad line: count, the first line's number and text."""
    return lines.groupBy(kind).agg(F.count("*").alias("n"), F.min(line_no).alias("first_line"), F.min_by(example, line_no).alias("example"))


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def require_unique(rows: DataFrame, *keys: str) -> DataFrame:
    found = duplicates(rows, *keys).first()
    if found:
        raise ValueError(f"duplicate {', '.join(f'{k}={found[k]}' for k in keys)}")
    return rows
