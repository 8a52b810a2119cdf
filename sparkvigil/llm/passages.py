"""Substring dedup on words by difference-cover anchors.

A window is ``WINDOW`` consecutive words; a word is removed if a window that covers it also starts in a document of
smaller doc_id. Windows are judged on the input. Anchors are the ``WINDOW - PERIOD + 1`` words at positions which lie
in a difference cover modulo ``PERIOD``: for any two positions some shift below PERIOD brings both into the cover, so
two equal windows share an anchor at one offset. Only windows with a shared anchor are extended to their full length
and compared by 128-bit hash (96 bits are kept); of each, the smallest doc_id keeps its words.

Rows with equal words are one class with its smallest id; other rows of the class lose all words if these fill a
window, nothing else. Null doc_ids come after all others and are alike; rows that repeat an id are not smaller than
each other. Null text has no words. Rows are kept one by one. Counts are linear in words, there are no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .blocks import BLOB, BLOB_NAMES, FIRST, FIRST_KINDS, FIRST_NAMES, LONG, batch, blob_rows, by_class, columns_of, document_rows, gather, id_order, merged_runs
from .common import Stage, dealt, parts, table

WINDOW = 50
PERIOD = 31
#: A perfect difference set modulo 31.
COVER = (1, 5, 11, 24, 25, 27)
U = np.uint64


def _identities(words: K.Words) -> tuple[list[int], list[int]]:
    """Two hashes of each document's words."""
    out = []
    for salt in (0, 11):
        sums = np.zeros(len(words.hashes) + 1, U)
        h = K.mix(words.hashes + U(salt)) if salt else words.hashes
        np.cumsum(h * K.powers(len(h)), out=sums[1:])
        whole = (sums[words.first[1:]] - sums[words.first[:-1]]) * K.inverse_powers(len(h) + 1)[words.first[:-1]]
        out.append(K.mix(whole + words.count.astype(U) * K.SALT).view(LONG).tolist())
    return out[0], out[1]


def _several(h: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by hash and class: whether each is the first of its hash, and whether two classes have that."""
    head = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
    starts = np.flatnonzero(head)
    ends = np.append(starts[1:], len(h)) - 1
    return head, (cls[starts] != cls[ends])[np.cumsum(head) - 1] if len(h) else head


def _anchors(docs: DataFrame, window: int, n_parts: int) -> DataFrame:
    """Document rows, and (cls, position) of anchors that another class shares, dealt by class."""
    width = window - PERIOD + 1

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for at, data, offs in K.chunks(b.column(1)):
                w = K.Words(data, offs)
                cls, chk = _identities(w)
                yield document_rows(b.column(0).slice(at, len(cls)).to_pylist(), cls, chk, w.count.tolist(), n_parts)
                fresh = np.zeros(len(cls), bool)
                for i, c in enumerate(cls):
                    if w.count[i] >= window and c not in seen:
                        seen.add(c)
                        fresh[i] = True
                if len(seen) > 200_000:
                    seen.clear()
                if not fresh.any():
                    continue
                doc = np.repeat(np.arange(len(cls)), w.count)
                place = np.arange(len(doc)) - w.first[:-1][doc]
                use = fresh[doc] & np.isin(place % PERIOD, COVER) & (place + width <= w.count[doc])
                use = np.flatnonzero(use)
                h, c, at_word = w.windows(width)[use], np.array(cls, LONG)[doc[use]], place[use].astype(np.uint32)
                order = np.lexsort((c, h))
                h, c, at_word = h[order], c[order], at_word[order]
                # what two classes of the chunk share is known here: of a frequent anchor one row for each chunk meets the others
                head, several = _several(h, c)
                asked = head | ~several
                rows = list(K.deal((h[asked] % U(n_parts)).astype(LONG), n_parts, h[asked], c[asked], at_word[asked], several[asked]))
                yield blob_rows(rows, FIRST_NAMES, FIRST_KINDS)
                if not asked.all():
                    c, at_word = c[~asked], at_word[~asked]
                    rows = [(p, [None, *x]) for p, x in K.deal(c % n_parts, n_parts, c, at_word)]
                    yield blob_rows(rows, FIRST_NAMES, FIRST_KINDS)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            plain = b.column(6).is_null()
            if pc.any(plain).as_py():
                yield b.filter(plain)
            b = b.filter(pc.invert(plain))
            known = b.column(5).is_null()
            if pc.any(known).as_py():
                done = b.filter(known)
                yield pa.RecordBatch.from_arrays([*done.columns[:5], done.column(6), done.column(7), *[pa.nulls(done.num_rows, pa.binary())] * 3], FIRST_NAMES)
            held.append(b.filter(pc.invert(known)))
        h, cls, place, sure = columns_of(iter(held), [U, LONG, np.uint32, bool], 5)
        order = np.lexsort((cls, h))
        h, cls, place, sure = h[order], cls[order], place[order], sure[order]
        head, several = _several(h, cls)
        if len(h):
            several |= np.logical_or.reduceat(sure, np.flatnonzero(head))[np.cumsum(head) - 1]
        cls, place = cls[several], place[several]
        if len(cls):
            yield blob_rows(list(K.deal(cls % n_parts, n_parts, cls, place)), FIRST_NAMES, FIRST_KINDS)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(post, FIRST)
    return dealt(rows, n_parts).mapInArrow(shared, FIRST)


def _positions(cols: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    cls, place = cols
    order = np.lexsort((place, cls))
    cls, place = cls[order], place[order]
    keep = np.concatenate(([True], (cls[1:] != cls[:-1]) | (place[1:] != place[:-1]))) if len(cls) else np.zeros(0, bool)
    cls, place = cls[keep], place[keep]
    for c, a, b in by_class(cls):
        yield c, place[a:b].tobytes()


def _starts(cols: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """Runs of consecutive window starts as (first, end)."""
    cls, place = cols
    order = np.lexsort((place, cls))
    cls, place = cls[order], place[order].astype(LONG)
    for c, a, b in by_class(cls):
        lo, hi = merged_runs(place[a:b], place[a:b] + 1)
        yield c, np.stack([lo, hi], 1).tobytes()


def _least(h: np.ndarray, g: np.ndarray, ident: np.ndarray) -> np.ndarray:
    """The smallest id of each row's window; rows are sorted by hashes and id."""
    if not len(h):
        return ident
    head = np.concatenate(([True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])))
    return ident[np.flatnonzero(head)][np.cumsum(head) - 1]


def _extend(texts: DataFrame, window: int, n_parts: int) -> DataFrame:
    """From (cls, ord, spans of anchors, text): blobs of (cls, start) of windows that a smaller id holds too."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, data, offs in K.chunks(b.column(3)):
                w = K.Words(data, offs)
                cls, _ = _identities(w)
                use, doc = [], []
                for i, c in enumerate(cls):
                    n = int(w.count[i])
                    if c != b.column(0)[at + i].as_py() or n < window:
                        continue
                    marks = np.zeros(n + 1, np.int32)
                    marks[np.frombuffer(b.column(2)[at + i].as_py(), np.uint32) + 1] = 1
                    before = np.cumsum(marks)  # anchors before each position
                    starts = np.arange(n - window + 1)
                    starts = starts[before[np.minimum(starts + PERIOD, n)] > before[starts]]
                    use.append(starts + w.first[i])
                    doc.append(np.full(len(starts), i))
                if not use or not sum(map(len, use)):
                    continue
                use, doc = np.concatenate(use), np.concatenate(doc)
                h, g = w.windows(window)[use], w.windows(window, 11)[use]
                order = np.array([x.as_py() for x in b.column(1).slice(at, len(cls))], LONG)
                place = (use - w.first[:-1][doc]).astype(np.uint32)
                ident, c, g = order[doc], np.array(cls, LONG)[doc], (g >> U(32)).astype(np.uint32)
                # beside a smaller id of the chunk a window goes; only the smallest meets those of other chunks
                by = np.lexsort((ident, g, h))
                h, g, ident, c, place = h[by], g[by], ident[by], c[by], place[by]
                gone = ident > _least(h, g, ident)
                yield blob_rows(list(K.deal((h[~gone] % U(n_parts)).astype(LONG), n_parts, h[~gone], g[~gone], ident[~gone], c[~gone], place[~gone])))
                if gone.any():
                    yield blob_rows([(p, [None, None, None, *x]) for p, x in K.deal(c[gone] % n_parts, n_parts, c[gone], place[gone])])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            known = b.column(1).is_null()
            if pc.any(known).as_py():
                done = b.filter(known)
                yield pa.RecordBatch.from_arrays([done.column(0), done.column(4), done.column(5), *[pa.nulls(done.num_rows, pa.binary())] * 3], BLOB_NAMES)
            held.append(b.filter(pc.invert(known)))
        h, g, ident, cls, place = columns_of(iter(held), [U, np.uint32, LONG, LONG, np.uint32])
        if not len(h):
            return
        order = np.lexsort((ident, g, h))
        h, g, ident, cls, place = h[order], g[order], ident[order], cls[order], place[order]
        gone = ident > _least(h, g, ident)
        if gone.any():
            yield blob_rows(list(K.deal(cls[gone] % n_parts, n_parts, cls[gone], place[gone])))

    return dealt(texts.select("cls", "ord", "spans", "text").mapInArrow(post, BLOB), n_parts).mapInArrow(judge, BLOB)


def _cut(texts: DataFrame, window: int) -> DataFrame:
    """From (doc_id, text, cls, chk, whole, spans): the kept text and counts; rows of another class with the id go."""
    names, kinds = ["doc_id", "n_words", "n_removed", "spans", "text"], [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in names]
            for at, data, offs in K.chunks(b.column(1)):
                w = K.Words(data, offs)
                cls, chk = _identities(w)
                for i, (c, k) in enumerate(zip(cls, chk, strict=True)):
                    if c != b.column(2)[at + i].as_py() or k != b.column(3)[at + i].as_py():
                        continue
                    n, spans = int(w.count[i]), np.zeros((0, 2), LONG)
                    words = data[offs[i] : offs[i + 1]].tobytes().split()
                    if b.column(4)[at + i].as_py():
                        spans = np.array([[0, n]], LONG)
                    elif (runs := b.column(5)[at + i].as_py()) is not None:
                        runs = np.frombuffer(runs, LONG).reshape(-1, 2)
                        spans = np.stack(merged_runs(runs[:, 0], runs[:, 1] + window - 1), 1)
                    kept, last = [], 0
                    for lo, hi in spans.tolist():
                        kept += words[last:lo]
                        last = hi
                    kept += words[last:]
                    for col, x in zip(out, (b.column(0)[at + i].as_py(), n, n - len(kept), spans.ravel().tolist(), b" ".join(kept).decode("utf-8", "replace")), strict=True):
                        col.append(x)
            yield batch(names, kinds, out)

    return texts.select("doc_id", "text", "cls", "chk", "whole", "spans").mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, spans array<bigint>, text string")


def dedup_passages(docs: DataFrame, stage: Stage, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, spans (first, end, first, end ... of removed words) and the kept words as text."""
    if window < PERIOD:
        raise ValueError(f"windows have {PERIOD} words at least")
    n_parts = parts(docs)
    found = stage.put(_anchors(docs, window, n_parts), "anchors")
    stage.tidy()
    rows = found.filter("one is null and cls is not null").select("doc_id", "cls", "chk", "n")
    firsts = rows.groupBy("cls", "chk").agg(F.min(id_order()).alias("ord"), F.min("doc_id").alias("first_id"))
    marked = gather(found.filter("one is not null").select("part", "one", "two", "three", "four", "five"), n_parts, _positions, [LONG, np.uint32])
    texts = docs.select(F.col("doc_id").cast("long").alias("d"), "text")
    wanted = firsts.join(marked, "cls")
    judged = stage.put(_extend(texts.join(wanted, F.col("d").eqNullSafe(F.col("first_id"))), window, n_parts), "judged")
    stage.tidy()
    runs = gather(judged, n_parts, _starts, [LONG, np.uint32])
    info = rows.distinct().join(firsts, ["cls", "chk"]).join(runs, "cls", "left")
    info = info.select("doc_id", "cls", "chk", ((id_order() > F.col("ord")) & (F.col("n") >= window)).alias("whole"), "spans")
    info = stage.put(info, "info")
    stage.drop("anchors", "judged")
    return _cut(texts.join(info, F.col("d").eqNullSafe(F.col("doc_id"))), window)


def op6_dedup_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_passages(table(spark, sf_dir, "documents").select("doc_id", "text"), Stage(spark, "op6"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)
), m AS (SELECT h, min(doc_id) AS least FROM g GROUP BY h HAVING count(DISTINCT doc_id) > 1),
s AS (SELECT g.doc_id, list(DISTINCT g.i) AS starts FROM g JOIN m ON g.h = m.h AND g.doc_id > m.least GROUP BY g.doc_id),
c AS (
  SELECT w.doc_id, w.w, list_sort(coalesce(s.starts, [])) AS starts FROM w LEFT JOIN s ON s.doc_id = w.doc_id
), p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM c),
q AS (
  SELECT p.doc_id, p.i, p.word, max(x.i) AS last FROM p
  LEFT JOIN (SELECT doc_id, unnest(starts) AS i FROM c) x ON x.doc_id = p.doc_id AND x.i BETWEEN p.i - 49 AND p.i
  GROUP BY p.doc_id, p.i, p.word
)
SELECT c.doc_id, CAST(len(c.w) AS BIGINT) AS n_words, CAST(coalesce(k.gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM c LEFT JOIN (
  SELECT doc_id, count(last) AS gone, string_agg(word, ' ' ORDER BY i) FILTER (WHERE last IS NULL) AS kept FROM q GROUP BY doc_id
) k ON k.doc_id = c.doc_id
"""
