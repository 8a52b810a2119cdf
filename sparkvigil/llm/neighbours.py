"""Approximate nearest neighbours by a permutation index.

A bounded, seeded sample of vectors gives ``PIVOTS`` pivots. Every vector is represented by its ``PREFIX`` nearest
pivots in order, and its position in that order is posted to each pivot's inverted file (a pivot beyond the prefix
counts as position PREFIX). A query reads the files of its own ``READ`` nearest pivots, sums up the footrule distance,
and the best are reranked by exact Euclidean distance in double precision: ``SHARE`` of a block and ``RERANK`` for each
neighbour asked for, by one rule at every size.

The index is dealt by rows: each Arrow batch of vectors is a block with inverted files of its own, all queries go to
all blocks, block after block of ``QUERY_BLOCK`` queries, and each block returns its k best, which are merged by query.
Equal vectors of a block count once while ranking, with their k + 1 smallest ids, so a group of copies takes one place.

Rows with a null id, or whose vector is null, zero, or holds a null or non-finite component, take no part. Vectors of
another length than the query's are not compared. Ties go to the smaller id. A repeated id is one candidate for each
of its rows; rows with the query's own id are left out. Fewer candidates than k give all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, union_all

PIVOTS = 256
PREFIX = 256
READ = 128
SHARE = 0.02
RERANK = 5
#: Queries broadcast at a time, which bounds the bytes sent.
QUERY_BLOCK = 16384


def vectors(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ids and double vectors of the rows that take part."""
    ids, col = batch.column(0), batch.column(1)
    got_ids, got = [], []
    whole = col.flatten()
    if col.null_count == 0 and ids.null_count == 0 and whole.null_count == 0 and len(col) and len(whole) % len(col) == 0 and len({len(whole) // len(col)} | set(np.diff(np.asarray(col.offsets)))) == 1:
        x = np.asarray(whole, dtype=np.float64).reshape(len(col), -1)
        ok = np.isfinite(x).all(1) & (x != 0).any(1)
        return np.asarray(ids, dtype=np.int64)[ok], x[ok]
    for i, v in zip(ids.to_pylist(), col.to_pylist(), strict=True):
        if i is not None and v and None not in v:
            x = np.array(v, np.float64)
            if np.isfinite(x).all() and x.any():
                got_ids.append(i)
                got.append(x)
    return np.array(got_ids, np.int64), got


def prefixes(x: np.ndarray, pivots: np.ndarray, m: int) -> np.ndarray:
    """The m nearest pivots of each vector, in order; ties to the smaller pivot."""
    d = (x * x).sum(1)[:, None] - 2 * x @ pivots.T + (pivots * pivots).sum(1)[None]
    return np.argsort(d, axis=1, kind="stable")[:, :m].astype(np.int32)


class Block:
    """Inverted files of one block of vectors of one length."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray, k: int, prefix: int = PREFIX):
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        x += 0.0  # no negative zero
        _, first, same = np.unique(np.ascontiguousarray(x).view(f"V{8 * x.shape[1]}").ravel(), return_index=True, return_inverse=True)
        by = np.argsort(same, kind="stable")
        ends = np.searchsorted(same[by], np.arange(len(first) + 1))
        self.ids = [ids[by[a : min(b, a + k + 1)]] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        self.x, self.k, self.m = x[first], k, min(prefix, len(pivots))
        near = prefixes(self.x, pivots, self.m)
        self.files = np.full((len(pivots), len(near)), self.m, np.int16)  # one for each pivot: the position it has for each vector
        self.files[near.ravel(), np.repeat(np.arange(len(near)), self.m)] = np.tile(np.arange(self.m, dtype=np.int16), len(near))

    def search(self, q: np.ndarray, near: np.ndarray, own: int, share: float, rerank: int) -> list[tuple[int, float]]:
        n = len(self.x)
        take = min(n, rerank * self.k + int(np.ceil(share * n)))
        apart = self.files[near]
        apart -= np.arange(len(near), dtype=np.int16)[:, None]
        np.abs(apart, out=apart)
        best = np.argpartition(apart.sum(0, dtype=np.int32), take - 1)[:take]
        d = np.sqrt(((self.x[best] - q) ** 2).sum(1))
        cut = np.partition(d, min(self.k, len(d) - 1))[min(self.k, len(d) - 1)]
        found = [(float(d[j]), int(i)) for j in np.flatnonzero(d <= cut) for i in self.ids[best[j]] if i != own]
        return [(i, s) for s, i in sorted(found)[: self.k]]


def search(data: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, pivots: int = PIVOTS, prefix: int = PREFIX, read: int = READ, share: float = SHARE, rerank: int = RERANK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of data found for each row of queries."""
    spark = data.sparkSession
    rows = data.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter("id is not null")
    sizes = rows.filter("size(v) > 0").groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()  # one row for each length
    base: dict[int, np.ndarray] = {}
    for r in sizes:
        sample = rows.filter(F.size("v") == r["dim"]).filter(F.pmod(F.xxhash64("id", F.lit("pivot")), F.lit(1 << 30)) < min(1 << 30, (1 << 30) * 8 * pivots // r["n"])).orderBy(F.xxhash64("id"), "id").limit(4 * pivots)
        _, x = vectors(pa.RecordBatch.from_pandas(sample.toPandas(), schema=pa.schema([("id", pa.int64()), ("v", pa.list_(pa.float64()))])))
        if len(x):
            base[r["dim"]] = np.unique(np.stack(list(x)), axis=0)[:: max(1, len(np.unique(np.stack(list(x)), axis=0)) // pivots)][:pivots]
    n_blocks = -(-max(1, asked.count()) // QUERY_BLOCK)
    out = []
    for block in range(n_blocks):
        part = asked.filter(F.pmod(F.xxhash64("id", F.lit("block")), F.lit(n_blocks)) == block)
        frame = part.toPandas()  # QUERY_BLOCK rows
        ids, x = vectors(pa.RecordBatch.from_pandas(frame, schema=pa.schema([("id", pa.int64()), ("v", pa.list_(pa.float64()))])))
        wanted = []
        for i, v in zip(ids, x, strict=True):
            if len(v) in base:
                wanted.append((int(i), v, prefixes(v[None], base[len(v)], min(read, prefix, len(base[len(v)])))[0]))
        shared = spark.sparkContext.broadcast((base, wanted))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            base, wanted = shared.value
            for b in batches:
                ids, x = vectors(b)
                lengths = np.array([len(v) for v in x])
                got: list[tuple[int, int, float]] = []
                for dim in set(lengths.tolist()) & set(base):
                    own = lengths == dim
                    index = Block(ids[own], np.stack([v for v, o in zip(x, own, strict=True) if o]), base[dim], k, prefix)
                    got += [(q, i, s) for q, v, near in wanted if len(v) == dim for i, s in index.search(v, near, q, share, rerank)]
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.float64())], ["query_id", "vec_id", "score"])

        out.append(rows.mapInArrow(run, "query_id bigint, vec_id bigint, score double"))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return union_all(out).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(data, data.filter("vec_id % 100 = 0"))
