"""Repeated byte strings by column-wise construction over aligned pieces of many documents.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts anywhere else, in the same document or
another; strings are judged on the input and overlap freely.

Pieces are aligned first. Every window of LENGTH bytes has one anchor, the leftmost of its ``GRAM``-byte strings with
the smallest hash, so equal windows have equal anchors at equal offsets, and windows with one anchor are neighbours.
They are parted by the side on which they reach farther, and the bytes that all of them have on this side lengthen the
key (to 250 of 400 bytes), so that a frequent line shorter than a window is many keys. Only keys that occur at two
places or more go on; the bytes of their windows make a piece with the anchor at a fixed column. What a chunk of texts
shares within itself is settled there: of a frequent key or piece one row for each chunk meets the others. Pieces of one
key meet in one part, where the collection is built column by column from the
right: each round inserts one symbol of every piece in front of its suffix, sorts the suffixes stably by it (the
symbols in this order are the column of the collection's Burrows-Wheeler transform) and updates the common prefixes
of neighbours. Columns are read in sequence from an external file, so memory is a few numbers a piece. A window whose
common prefix with a neighbour reaches LENGTH occurs twice.

The collection is cut into aligned pieces, not kept as whole documents, since whole documents would take a round for
each byte of the longest one and a pass over all bytes in each round; lengths count only up to LENGTH.

Rows of equal bytes are one class; with two rows or more of LENGTH bytes and more, all bytes go. Null text has no
bytes. Rows are kept one by one, null and repeated doc_ids too.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .blocks import BLOB, BLOB_NAMES, FIRST, FIRST_KINDS, FIRST_NAMES, LONG, batch, blob_rows, by_class, columns_of, document_rows, gather, merged_runs
from .common import Stage, dealt, parts, table

LENGTH = 400
GRAM = 100
U = np.uint64
PLACE = U((1 << 26) - 1)
#: An anchor's place, and how many bytes before it its first and last window start.
ANCHOR = np.dtype([("a", np.uint32), ("back", np.uint16), ("fore", np.uint16)])


def identity(raw: bytes) -> tuple[int, int]:
    a = np.frombuffer(hashlib.blake2b(raw, digest_size=16).digest(), LONG)
    return int(a[0]), int(a[1])


def reach(length: int, gram: int) -> tuple[int, int]:
    """Bytes before the anchor that a window has if it starts so many before it or more, and after it if it starts less."""
    left = (length - gram + 1) // 2
    return left, length - gram - left + 1


def _anchored(data: np.ndarray, offs: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, key's hash, anchor, first and last window start) by runs of windows of one side, places within documents."""
    n = len(data) - length + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (LONG, U, LONG, LONG, LONG))
    sums = np.zeros(len(data) + 1, U)
    value = data.astype(U)
    value += U(1)
    value *= K.powers(len(data))
    np.cumsum(value, out=sums[1:])
    m = len(data) - gram + 1
    h = K.mix((sums[gram:] - sums[:m]) * K.inverse_powers(m))
    low = (h & ~PLACE) | np.arange(m, dtype=U)
    width, span = 1, length - gram + 1
    while width * 2 <= span:
        np.minimum(low[:-width], low[width:], out=low[:-width])
        low = low[:-width]
        width *= 2
    if span > width:
        low = np.minimum(low[: n], low[span - width : span - width + n])
    low = (low[:n] & PLACE).astype(LONG)
    ok = np.zeros(n, bool)
    doc = np.zeros(n, LONG)
    for i in np.flatnonzero(np.diff(offs) >= length).tolist():
        ok[offs[i] : offs[i + 1] - length + 1] = True
        doc[offs[i] : offs[i + 1] - length + 1] = i
    head = ok.copy()
    head[1:] &= (low[1:] != low[:-1]) | ~ok[:-1] | (doc[1:] != doc[:-1])
    tail = ok.copy()
    tail[:-1] &= head[1:] | ~ok[1:]
    first, last = np.flatnonzero(head), np.flatnonzero(tail)
    at, (left, right) = low[first], reach(length, gram)
    runs = []
    for side, lo, hi, begin, end in (
        (0, first, np.minimum(last, at - left), at - left, at + gram), (1, np.maximum(first, at - left + 1), last, at, at + gram + right),
    ):
        some = np.flatnonzero(lo <= hi)
        begin, end = begin[some], end[some]
        key = K.mix((sums[end] - sums[begin]) * K.inverse_powers(len(data) + 1)[begin] + U(side))
        d = doc[first[some]]
        runs.append((d, key, at[some] - offs[d], lo[some] - offs[d], hi[some] - offs[d]))
    return tuple(map(np.concatenate, zip(*runs, strict=True)))


def _pieces(data: np.ndarray, offs: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, place of the first byte, bytes, offsets): documents, the very long ones in overlapping parts."""
    if len(offs) > 2 or len(data) <= K.CHUNK + length:
        yield 0, 0, data, offs
        return
    for at in range(0, len(data) - length + 1, K.CHUNK):
        part = data[at : at + K.CHUNK + length - 1]
        yield 0, at, part, np.array([0, len(part)])


def _several(h: np.ndarray, cls: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by hash, class and anchor: whether each is the first of its hash, and whether that is at two places."""
    head = np.concatenate(([True], h[1:] != h[:-1]))
    starts = np.flatnonzero(head)
    ends = np.append(starts[1:], len(h)) - 1
    return head, ((cls[starts] != cls[ends]) | (spans["a"][starts] != spans["a"][ends]))[np.cumsum(head) - 1]


def _anchors(docs: DataFrame, length: int, gram: int, n_parts: int) -> DataFrame:
    """Document rows, and (cls, anchor, first, last window) of anchors that occur twice, dealt by class."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for at, data, offs in K.chunks(b.column(1)):
                told = [identity(data[x:y].tobytes()) for x, y in zip(offs[:-1], offs[1:], strict=True)]
                cls = [t[0] for t in told]
                yield document_rows(b.column(0).slice(at, len(cls)).to_pylist(), cls, [t[1] for t in told], np.diff(offs).tolist(), n_parts)
                fresh = np.zeros(len(cls), bool)
                for i, c in enumerate(cls):
                    fresh[i] = c not in seen
                    seen.add(c)
                if len(seen) > 200_000:
                    seen.clear()
                for _, base, piece, own in _pieces(data, offs, length):
                    doc, h, anchor, first, last = _anchored(piece, own, length, gram)
                    use = fresh[doc]
                    doc, h, anchor, first, last = doc[use], h[use], anchor[use] + base, first[use] + base, last[use] + base
                    if not len(h):
                        continue
                    order = np.lexsort((anchor, np.array(cls, LONG)[doc], h))
                    h, c, anchor, first, last = h[order], np.array(cls, LONG)[doc[order]], anchor[order], first[order], last[order]
                    spans = np.zeros(len(h), ANCHOR)
                    spans["a"], spans["back"], spans["fore"] = anchor, anchor - first, anchor - last
                    head, several = _several(h, c, spans)
                    asked = head | ~several
                    yield blob_rows(list(K.deal((h[asked] % U(n_parts)).astype(LONG), n_parts, h[asked], c[asked], spans[asked], several[asked])), FIRST_NAMES, FIRST_KINDS)
                    if not asked.all():
                        c, spans = c[~asked], spans[~asked]
                        yield blob_rows([(p, [None, *x]) for p, x in K.deal(c % n_parts, n_parts, c, spans)], FIRST_NAMES, FIRST_KINDS)

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
        h, cls, spans, sure = columns_of(iter(held), [U, LONG, ANCHOR, bool], 5)
        if not len(h):
            return
        order = np.lexsort((spans["a"], cls, h))
        h, cls, spans, sure = (x[order] for x in (h, cls, spans, sure))
        head, several = _several(h, cls, spans)
        several |= np.logical_or.reduceat(sure, np.flatnonzero(head))[np.cumsum(head) - 1]
        if several.any():
            cls, spans = cls[several], spans[several]
            yield blob_rows(list(K.deal(cls % n_parts, n_parts, cls, spans)), FIRST_NAMES, FIRST_KINDS)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(post, FIRST)
    return dealt(rows, n_parts).mapInArrow(shared, FIRST)


def _lists(cols: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    rows = np.zeros(len(cols[0]), [("c", LONG), ("x", ANCHOR)])
    rows["c"], rows["x"] = cols
    rows = np.unique(rows)
    for c, a, b in by_class(rows["c"]):
        yield c, rows["x"][a:b].tobytes()


def repeated(key: np.ndarray, back: np.ndarray, fore: np.ndarray, data: np.ndarray, at: np.ndarray, size: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(piece, window start less anchor) of windows that occur in two pieces.

    Piece i has the bytes ``data[at[i] : at[i] + size[i]]``: those of its windows, from ``back`` bytes before its anchor,
    the last of which starts ``fore`` bytes before. Pieces of one key are compared.
    """
    n, reach = len(key), int(back.max())
    _, group = np.unique(key, return_inverse=True)
    first = reach - back.astype(LONG)
    last = reach - fore.astype(LONG)
    end = last + length  # columns [first, end) are there
    width = int(end.max())
    out_piece, out_place = [], []
    with tempfile.TemporaryFile() as f:
        columns = np.memmap(f, np.uint8, "w+", shape=(width, n))
        for lo in range(0, n, 1024):
            hi = min(n, lo + 1024)
            block = np.zeros((hi - lo, width), np.uint8)
            own = size[lo:hi]
            heads = np.cumsum(own) - own
            place = np.arange(int(own.sum())) - np.repeat(heads, own)
            row = np.repeat(np.arange(hi - lo), own)
            block[row, place + np.repeat(first[lo:hi], own)] = data[place + np.repeat(at[lo:hi], own)]
            columns[:, lo:hi] = block.T
        order = np.argsort(group, kind="stable")
        common = np.zeros(n + 1, np.int16)  # of each with the one before; the last is a stop
        common[n] = length
        for c in range(width - 1, -1, -1):
            there = (first <= c) & (c < end)
            symbol = np.where(there, columns[c].astype(np.int32) + 1, 0)
            sort = ((group.astype(np.int32) << 9) + symbol)[order]
            moved = np.argsort(sort, kind="stable")
            sort, order = sort[moved], order[moved]
            same = (sort[1:] == sort[:-1]) & ((sort[1:] & 511) > 0)
            a, b = moved[:-1], moved[1:]
            low = common[b].copy()
            far = np.flatnonzero(same & (b != a + 1))
            if len(far):
                cuts = np.empty(2 * len(far), LONG)
                cuts[0::2], cuts[1::2] = a[far] + 1, b[far] + 1
                low[far] = np.minimum.reduceat(common, cuts)[0::2]
            fresh = np.zeros(n + 1, np.int16)
            fresh[n] = length
            fresh[1:n] = np.where(same, np.minimum(low + 1, length), 0)
            common = fresh
            if c <= reach:
                full = common[:n] >= length
                full[:-1] |= full[1:]
                hit = order[full]
                hit = hit[(first[hit] <= c) & (c <= last[hit])]
                if len(hit):
                    out_piece.append(hit)
                    out_place.append(np.full(len(hit), c - reach, LONG))
        del columns
    if not out_piece:
        return np.zeros(0, LONG), np.zeros(0, LONG)
    return np.concatenate(out_piece), np.concatenate(out_place)


#: Pieces that are built at a time, whole keys together.
PIECES = 1 << 16


def _build(texts: DataFrame, length: int, gram: int, n_parts: int) -> DataFrame:
    """From (cls, spans of anchors, text): blobs of (cls, first, end) of bytes in repeated windows, dealt by class."""

    left, right = reach(length, gram)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, data, offs in K.chunks(b.column(2)):
                keys, cls, anchors, raw, sizes = [], [], [], [], []
                held = 0
                for i, (x, y) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
                    own = data[x:y]
                    c = b.column(0)[at + i].as_py()
                    if y - x < length or identity(own.tobytes())[0] != c:
                        continue
                    for a in np.frombuffer(b.column(1)[at + i].as_py(), ANCHOR):
                        lo, hi = int(a["a"]) - int(a["back"]), int(a["a"]) - int(a["fore"]) + length
                        begin, end = int(a["a"]), int(a["a"]) + gram
                        begin, end, side = (begin - left, end, b"l") if int(a["fore"]) >= left else (begin, end + right, b"r")
                        keys.append(hashlib.blake2b(own[begin:end].tobytes(), digest_size=8, key=side).digest())
                        cls.append(c)
                        anchors.append(a)
                        raw.append(own[lo:hi].tobytes())
                        held += hi - lo
                        if held > 4 * K.CHUNK:
                            yield from pack(keys, cls, anchors, raw)
                            keys, cls, anchors, raw, held = [], [], [], [], 0
                if keys:
                    yield from pack(keys, cls, anchors, raw)

    def pack(keys, cls, anchors, raw) -> Iterator[pa.RecordBatch]:
        cls, anchors = np.array(cls, LONG), np.array(anchors, ANCHOR)
        same: dict[tuple, list[int]] = {}
        for i, (key, a, piece) in enumerate(zip(keys, anchors, raw, strict=True)):
            same.setdefault((key, int(a["back"]), int(a["fore"]), hashlib.blake2b(piece, digest_size=16).digest()), []).append(i)
        equal = np.array([i for own in same.values() if len(own) > 1 for i in own], LONG)
        if len(equal):  # all their windows are repeated; one goes on for the others' sake
            c, a = cls[equal], anchors[equal]
            first = a["a"] - a["back"]
            rows = K.deal(c % n_parts, n_parts, c, first, (a["a"] - a["fore"] + np.uint32(length)).astype(np.uint32))
            yield blob_rows([(p, [None, *x]) for p, x in rows])
            keep = np.array([own[0] for own in same.values()], LONG)
            cls, anchors, keys, raw = cls[keep], anchors[keep], [keys[i] for i in keep], [raw[i] for i in keep]
        key = np.frombuffer(b"".join(keys), U)
        part = (key % U(n_parts)).astype(LONG)
        order = np.argsort(part, kind="stable")
        ends = np.searchsorted(part[order], np.arange(n_parts + 1))
        rows = []
        for p in range(n_parts):
            own = order[ends[p] : ends[p + 1]]
            if len(own):
                rows.append((p, [key[own].tobytes(), cls[own].tobytes(), anchors[own].tobytes(), b"".join(raw[i] for i in own)]))
        yield blob_rows(rows)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            known = b.column(1).is_null()
            if pc.any(known).as_py():
                done = b.filter(known)
                yield pa.RecordBatch.from_arrays([done.column(0), *done.columns[2:5], *[pa.nulls(done.num_rows, pa.binary())] * 2], BLOB_NAMES)
            held.append(b.filter(pc.invert(known)))
        key, cls, anchor, data = columns_of(iter(held), [U, LONG, ANCHOR, np.uint8])
        if not len(key):
            return
        size = anchor["back"].astype(LONG) - anchor["fore"] + length
        at = np.cumsum(size) - size
        order = np.argsort(key, kind="stable")
        heads = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
        lo = 0
        while lo < len(order):
            nxt = heads[heads >= min(lo + PIECES, len(order))]
            hi = int(nxt[0]) if len(nxt) else len(order)
            own = order[lo:hi]
            piece, start = repeated(key[own], anchor["back"][own], anchor["fore"][own], data, at[own], size[own], length)
            lo = hi
            if not len(piece):
                continue
            begin = anchor["a"][own][piece].astype(LONG) + start
            by = np.lexsort((begin, piece))
            piece, begin = piece[by], begin[by]
            # runs of window starts in one piece
            head = np.concatenate(([True], (piece[1:] != piece[:-1]) | (begin[1:] != begin[:-1] + 1)))
            tail = np.append(np.flatnonzero(head)[1:] - 1, len(piece) - 1)
            c = cls[own][piece[head]]
            yield blob_rows(list(K.deal(c % n_parts, n_parts, c, begin[head].astype(np.uint32), (begin[tail] + length).astype(np.uint32))))

    return dealt(texts.select("cls", "spans", "text").mapInArrow(post, BLOB), n_parts).mapInArrow(build, BLOB)


def _runs(cols: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    cls, first, end = cols
    order = np.lexsort((first, cls))
    cls, first, end = cls[order], first[order].astype(LONG), end[order].astype(LONG)
    for c, a, b in by_class(cls):
        yield c, np.stack(merged_runs(first[a:b], end[a:b]), 1).tobytes()


def _cut(texts: DataFrame) -> DataFrame:
    """From (doc_id, text, cls, chk, whole, spans): kept bytes and counts; rows of another class with the id go."""
    names, kinds = ["doc_id", "n_bytes", "n_removed", "spans", "kept"], [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, data, offs in K.chunks(b.column(1)):
                out: list[list] = [[] for _ in names]
                for i, (x, y) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
                    raw = data[x:y].tobytes()
                    if identity(raw) != (b.column(2)[at + i].as_py(), b.column(3)[at + i].as_py()):
                        continue
                    spans: list = []
                    if b.column(4)[at + i].as_py():
                        spans = [[0, len(raw)]]
                    elif (own := b.column(5)[at + i].as_py()) is not None:
                        spans = np.frombuffer(own, LONG).reshape(-1, 2).tolist()
                    kept, last = [], 0
                    for lo, hi in spans:
                        kept.append(raw[last:lo])
                        last = hi
                    left = b"".join([*kept, raw[last:]])
                    for col, v in zip(out, (b.column(0)[at + i].as_py(), len(raw), len(raw) - len(left), [v for s in spans for v in s], left), strict=True):
                        col.append(v)
                yield batch(names, kinds, out)

    return texts.select("doc_id", "text", "cls", "chk", "whole", "spans").mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, spans array<bigint>, kept binary")


def dedup_bytes(docs: DataFrame, stage: Stage, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (first, end, first, end ... of removed bytes) and the kept bytes."""
    if not 8 <= gram <= length:
        raise ValueError("gram must be from 8 to length")
    n_parts = parts(docs)
    found = stage.put(_anchors(docs, length, gram, n_parts), "anchors")
    stage.tidy()
    rows = found.filter("one is null").select("doc_id", "cls", "chk", "n")
    firsts = rows.groupBy("cls", "chk").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    marked = gather(found.filter("one is not null").select("part", "one", "two", "three", "four", "five"), n_parts, _lists, [LONG, ANCHOR])
    texts = docs.select(F.col("doc_id").cast("long").alias("d"), "text")
    wanted = firsts.join(marked, "cls")
    built = stage.put(_build(texts.join(wanted, F.col("d").eqNullSafe(F.col("first_id"))), length, gram, n_parts), "built")
    stage.tidy()
    runs = gather(built, n_parts, _runs, [LONG, np.uint32, np.uint32])
    info = rows.distinct().join(firsts, ["cls", "chk"]).join(runs, "cls", "left")
    info = info.select("doc_id", "cls", "chk", ((F.col("copies") > 1) & (F.col("n") >= length)).alias("whole"), "spans")
    info = stage.put(info, "info")
    stage.drop("anchors", "built")
    return _cut(texts.join(info, F.col("d").eqNullSafe(F.col("doc_id"))))


def op9_dedup_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"), Stage(spark, "op9"))
    return out.select("doc_id", "n_bytes", "n_removed", (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
