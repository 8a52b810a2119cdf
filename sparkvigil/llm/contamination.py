"""Benchmark decontamination: short test items found inside long documents by containment.

An item is contained in a document if ``PERCENT`` of its distinct k-word shingles (lower-cased A-Z; fewer words: the
whole sequence) occur in it, wherever they stand. Search is by MinHash in size partitions: items are parted by powers
of two of their shingle count; in a partition of at most u shingles each item keeps its
``u - ceil(t * u) + 1`` smallest hashes. A document that contains the item lacks too few shingles to miss all of
these, so a document with none of an item's minimum hashes is ruled out for certain, at any length. Candidates are
verified by exact shingle containment.

Documents are scanned once for each block of items; a block's text is at most ``BLOCK_BYTES`` (a longer item is a
block of its own), and only this bounded block is sent to the tasks. Documents are not shuffled.

Null or wordless texts and items match nothing. Repeated rows and null ids are kept one by one. Whole texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import table, union_all

SHINGLE = 5
PERCENT = 80
BLOCK_BYTES = 32 << 20
U = np.uint64


class Items:
    """A block of items: shingle sets, and their minimum hashes by shingle length."""

    def __init__(self, rows: list[tuple[int | None, str | None]], percent: int = PERCENT, k: int = SHINGLE):
        rows = sorted(((i, t) for i, t in rows if t), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        self.percent, self.ids, self.sets, self.index = percent, [], [], {}
        held: dict[int, list[tuple[int, np.ndarray]]] = {}
        for i, text in rows:
            raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
            w = K.Words(raw, np.array([0, len(raw)]), lower=True)
            n = len(w.hashes)
            if not n:
                continue
            own = np.unique(w.grams(min(n, k)))
            upper = 1 << (len(own) - 1).bit_length()  # of the size partition
            least = np.sort(K.mix(own))[: upper - -(-upper * percent // 100) + 1]
            held.setdefault(min(n, k), []).append((len(self.ids), least))
            self.ids.append(i)
            self.sets.append(own)
        for size, lists in held.items():
            keys = np.concatenate([x for _, x in lists])
            owner = np.concatenate([np.full(len(x), j) for j, x in lists])
            order = np.argsort(keys, kind="stable")
            self.index[size] = keys[order], owner[order]

    def found(self, data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(document, item, shared shingles) for each item that a document contains."""
        w = K.Words(data, offs, lower=True)
        doc = np.repeat(np.arange(len(w.count)), w.count)
        for size, (keys, owner) in self.index.items():
            grams = w.grams(size)
            if not len(grams):
                continue
            inside = doc[: len(grams)] == doc[size - 1 :]
            hashes = K.mix(grams)
            at = np.searchsorted(keys, hashes)
            hit = np.flatnonzero(inside & (keys[np.minimum(at, len(keys) - 1)] == hashes))
            pairs = set()
            for g in hit.tolist():
                j = at[g]
                while j < len(keys) and keys[j] == hashes[g]:
                    pairs.add((int(doc[g]), int(owner[j])))
                    j += 1
            last, own = -1, None
            for d, item in sorted(pairs):
                if d != last:
                    last = d
                    own = np.unique(grams[w.first[d] : w.first[d + 1] - size + 1])
                shared = len(np.intersect1d(own, self.sets[item], assume_unique=True))
                if 100 * shared >= self.percent * len(self.sets[item]):
                    yield d, item, shared


def blocks(items: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[list[tuple[int | None, str | None]]]:
    """Items in blocks of bounded bytes."""
    rows = items.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).filter("t is not null")
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-2 * size // BLOCK_BYTES) if size > BLOCK_BYTES else 1
    for b in range(n):
        yield [(r["i"], r["t"]) for r in rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).collect()]


def find_items(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment: every item that each document contains."""
    spark = docs.sparkSession
    names, kinds = ["doc_id", "item_id", "n_item", "n_shared", "containment"], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
    out = []
    for block in blocks(items):
        shared = spark.sparkContext.broadcast(Items(block, percent))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for b in batches:
                rows: list[list] = [[] for _ in names]
                for at, data, offs in K.chunks(b.column(1)):
                    for d, item, n in own.found(data, offs):
                        size = len(own.sets[item])
                        for col, v in zip(rows, (b.column(0)[at + d].as_py(), own.ids[item], size, n, n / size), strict=True):
                            col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], names)

        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        out.append(texts.mapInArrow(run, "doc_id bigint, item_id bigint, n_item bigint, n_shared bigint, containment double"))
    return union_all(out)


def drop_contaminated(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, all columns, that contain no item. A scan; nothing is shuffled."""
    spark = docs.sparkSession
    place = docs.columns.index("text")
    for block in blocks(items):
        shared = spark.sparkContext.broadcast(Items(block, percent))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for b in batches:
                clean = np.ones(b.num_rows, bool)
                for at, data, offs in K.chunks(b.column(place)):
                    for d, _, _ in own.found(data, offs):
                        clean[at + d] = False
                yield b.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op5_find_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH w AS (
  SELECT 0 AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
  UNION ALL
  SELECT 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') FROM benchmark
), m AS (SELECT DISTINCT least(len(w), 5) AS k FROM w WHERE kind = 1 AND len(w) > 0),
s AS (
  SELECT DISTINCT kind, id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g
  FROM w JOIN m ON CASE WHEN kind = 1 THEN k = least(len(w), 5) ELSE len(w) >= k END
), n AS (SELECT id, count(*) AS n FROM s WHERE kind = 1 GROUP BY id)
SELECT a.id AS doc_id, b.id AS item_id, any_value(n.n) AS n_item, count(*) AS n_shared, CAST(count(*) AS DOUBLE) / any_value(n.n) AS containment
FROM s a JOIN s b ON a.kind = 0 AND b.kind = 1 AND a.k = b.k AND a.g = b.g JOIN n ON n.id = b.id
GROUP BY a.id, b.id HAVING 100 * count(*) >= 80 * any_value(n.n)
"""
