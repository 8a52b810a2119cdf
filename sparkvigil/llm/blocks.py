"""Block exchange: arrays of many rows dealt by part as bytes, and documents found again by their class."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import dealt

LONG = np.int64
#: A row of the first pass: a document (cls, check, n) or the bytes of columns for one part.
FIRST = "part int, doc_id bigint, cls bigint, chk bigint, n bigint, one binary, two binary, three binary, four binary, five binary"
FIRST_NAMES = ["part", "doc_id", "cls", "chk", "n", "one", "two", "three", "four", "five"]
FIRST_KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * 5
#: An odd factor that scatters ids in steps of any size.
SPREAD = 0x9E3779B97F4A7C15
BLOB = "part int, one binary, two binary, three binary, four binary, five binary"
BLOB_NAMES = ["part", "one", "two", "three", "four", "five"]
BLOB_KINDS = [pa.int32()] + [pa.binary()] * 5


def batch(names: list[str], kinds: list[pa.DataType], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def document_rows(ids: list, cls: list, chk: list, n: list, n_parts: int) -> pa.RecordBatch:
    """Rows of documents, those of equal texts spread over all parts by their ids.

    The part follows from the row alone and not from its place, so a task run again after a lost executor deals alike.
    """
    none = pa.nulls(len(ids), pa.binary())
    part = [(c + ((d or 0) * SPREAD >> 20)) % n_parts for c, d in zip(cls, ids, strict=True)]
    return batch(FIRST_NAMES, FIRST_KINDS, [part, ids, cls, chk, n, *[none] * 5])


def blob_rows(rows: list[tuple[int, list[bytes]]], names=BLOB_NAMES, kinds=BLOB_KINDS) -> pa.RecordBatch:
    gap = len(names) - 6
    columns = [pa.array([p for p, _ in rows], pa.int32()), *[pa.nulls(len(rows), k) for k in kinds[1 : 1 + gap]]]
    for j in range(5):
        columns.append(pa.array([x[j] if j < len(x) else None for _, x in rows], pa.binary()))
    return pa.RecordBatch.from_arrays(columns, names)


def columns_of(batches: Iterator[pa.RecordBatch], kinds: list, first: int = 1) -> list[np.ndarray]:
    held: list[list[bytes]] = [[] for _ in kinds]
    for b in batches:
        for j in range(len(kinds)):
            held[j] += [x for x in b.column(first + j).to_pylist() if x is not None]
    return [K.joined(h, k) for h, k in zip(held, kinds, strict=True)]


def gather(rows: DataFrame, n_parts: int, merge: Callable[[list[np.ndarray]], Iterator[tuple[int, bytes]]], kinds: list) -> DataFrame:
    """(cls, spans): what merge makes of the dealt columns, the first of which is the class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = columns_of(batches, kinds)
        if len(cols[0]):
            got = list(merge(cols))
            yield batch(["cls", "spans"], [pa.int64(), pa.binary()], [[c for c, _ in got], [s for _, s in got]])

    return dealt(rows, n_parts).mapInArrow(run, "cls bigint, spans binary")


def by_class(cls: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(class, first, end) of a sorted array."""
    heads = np.flatnonzero(np.concatenate(([True], cls[1:] != cls[:-1]))) if len(cls) else np.zeros(0, int)
    ends = np.append(heads[1:], len(cls))
    return zip(cls[heads].tolist(), heads.tolist(), ends.tolist(), strict=True)


def merged_runs(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals [start, end), joined where they touch; start is sorted."""
    reach = np.maximum.accumulate(end)
    head = np.concatenate(([True], start[1:] > reach[:-1]))
    at = np.flatnonzero(head)
    return start[at], reach[np.append(at[1:], len(start)) - 1]


def id_order(doc_id: str = "doc_id"):
    """Null ids come after all others."""
    return F.coalesce(F.col(doc_id), F.lit(2**63 - 1))
