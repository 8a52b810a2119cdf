"""Exact n-gram Jaccard join and its connected components, by token-combination prefixes.

A document's set is its distinct k-word shingles (fewer words: the whole sequence; no words: empty, linked with
nothing). Documents of equal sets are one class. Shingles are ordered by frequency class, rare first, then by hash;
the class comes from counts over all documents in a sketch of fixed size (``SKETCH`` cells), which steers the order
only: any order gives the same links. Two sets that reach the threshold share a shingle in their prefixes
(size - ceil(t * size) + 1), and k + 1 in prefixes longer by k. Prefixes are extended by k = max(1, size // ``EXTEND``):

* a rare shingle (at most ``RARE`` classes hold it) is indexed alone and its pairs are counted. A similar pair shares
  k + 1 shingles, of which no more are frequent than either prefix holds; a pair that shares the rest is a candidate;
* frequent ones are indexed by combinations of two. Shingles are dealt to B buckets by hash, B the power of two up to
  the smaller k: of k + 1 shared ones two are in one bucket, so combinations within buckets find each pair, and their
  number stays in proportion to the set.

Candidates of combinations are the similar pairs which share no rare shingle. So a set of n shingles, of which r are
rare ones in its prefix, has at most m = n - r in common with the other, and the other's size is bounded by what m
allows (where both prefixes pass the end of the rare class). Members of a combination are compared with its leader
(fewest rare shingles); what these links join needs no pair inside. The others are paired with the members of other
components whose sizes the bound allows and whose 512-bit parities differ in no more bits than the sets may differ in
shingles. Such families shrink to their leaders, so pairs stay in proportion to rows; no cap drops a candidate.

Candidates are verified exactly: by a quarter of the hash space, in which more differences than the threshold allows
rule a pair out for certain, then by whole sets.

Null text is like no words. Null and repeated doc_ids are rows of their own; a component's id is its smallest
non-null doc_id. Sets are compared by 64-bit hashes. ``join_pairs`` gives all links between classes, and membership.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import Stage, dealt, parts, table
from .components import components

SHINGLE = 5
PERCENT = 80
RARE = 16
EXTEND = 10
#: Words of the parity of a set.
PARITY = 8
SKETCH_BITS = 22
SLICE_BITS = 14
U = np.uint64
CELL = U((1 << SKETCH_BITS) - 1)
LONG = np.int64


def _batch(names: list[str], kinds: list[pa.DataType], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _extra(n: int, percent: int) -> int:
    """k of a set of n shingles: a similar pair shares more than the smaller k within both prefixes."""
    return max(0, min(max(1, n // EXTEND), (n * percent + 99) // 100 - 1))


def _extra_column(n: Column, percent: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.greatest(F.lit(1), F.floor(n / EXTEND)), F.ceil(n * percent / 100) - 1))


def _class(s: np.ndarray) -> int:
    """A hash of the whole set."""
    return int(K.mix(np.sum(K.mix(s), keepdims=True)).view(LONG)[0])


def _sketch(docs: DataFrame, stage: Stage) -> np.ndarray:
    """Frequency class of each cell: 0 up to what chance makes of the mean count, one more for each doubling.

    A task counts to 255 in a cell at most, which is far beyond class 0.
    """
    spark = docs.sparkSession
    slices = 1 << (SKETCH_BITS - SLICE_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << SKETCH_BITS, np.int64)
        for b in batches:
            for _, data, offs in K.chunks(b.column(0)):
                w = K.Words(data, offs, lower=True)
                grams = w.grams(SHINGLE)
                ok = np.ones(len(w.hashes), bool)
                for j in range(1, SHINGLE):
                    ends = w.first[1:] - j
                    ok[ends[ends >= w.first[:-1]]] = False
                cells += np.bincount((grams[ok[: len(grams)]] & CELL).astype(np.int64), minlength=len(cells))
        if cells.any():
            small = np.minimum(cells, 255).astype(np.uint8).reshape(slices, -1)
            yield _batch(["part", "cells"], [pa.int32(), pa.binary()], [range(slices), [x.tobytes() for x in small]])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for p, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[p] = sums.get(p, 0) + np.frombuffer(blob, np.uint8).astype(np.uint32)
        yield _batch(["part", "cells"], [pa.int32(), pa.binary()], [list(sums), [x.tobytes() for x in sums.values()]])

    counted = docs.select("text").mapInArrow(count, "part int, cells binary")
    summed = counted.repartition(slices, "part").mapInArrow(total, "part int, cells binary").collect()  # 4 bytes a cell, of a fixed number
    cells = np.zeros((slices, 1 << SLICE_BITS), np.uint32)
    for r in summed:
        cells[r["part"]] = np.frombuffer(r["cells"], np.uint32)
    cells = cells.ravel()
    return np.clip(np.floor(np.log2(np.maximum(cells, 1) / (8 + 1.5 * cells.mean()))) + 1, 0, 30).astype(np.uint8)


def _pairs(token: np.ndarray, who: np.ndarray, n: np.ndarray, percent: int) -> tuple:
    """From postings: pairs of rare tokens, and the rows of frequent tokens."""
    order = np.lexsort((who, n, token))
    token, who, n = token[order], who[order], n[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (who[1:] != who[:-1])  # each class once
    token, who, n = token[new], who[new], n[new]
    head = np.ones(len(token), bool)
    head[1:] = token[1:] != token[:-1]
    group = np.cumsum(head) - 1
    size = np.bincount(group)[group] if len(group) else group
    rare, often = (size > 1) & (size <= RARE), size > RARE
    a = [np.zeros(0, np.int64)]
    b = [np.zeros(0, np.int64)]
    for step in range(1, RARE):
        i = np.flatnonzero(rare[step:] & (group[step:] == group[:-step])) if len(group) > step else []
        if not len(i):
            break
        a.append(i)
        b.append(i + step)
    a, b = np.concatenate(a), np.concatenate(b)
    near = n[a].astype(np.int64) * 100 >= n[b].astype(np.int64) * percent
    a, b = a[near], b[near]
    return _ordered(who, n, a, b, np.ones(len(a), np.int32)), (token[often], who[often], n[often])


def _ordered(who, n, a, b, times) -> tuple[np.ndarray, ...]:
    """Distinct pairs, smaller class first, with the sum of their times."""
    swap = who[a] > who[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    if not len(a):
        return who[a], who[b], n[a], n[b], times
    order = np.lexsort((who[b], who[a]))
    a, b = a[order], b[order]
    keep = np.ones(len(a), bool)
    keep[1:] = (who[a][1:] != who[a][:-1]) | (who[b][1:] != who[b][:-1])
    times = np.add.reduceat(times[order], np.flatnonzero(keep)).astype(np.int32)
    a, b = a[keep], b[keep]
    return who[a], who[b], n[a], n[b], times


ROW = "kind int, doc_id bigint, a bigint, b bigint, na int, nb int, times int"
_NAMES = ["kind", "doc_id", "a", "b", "na", "nb", "times"]
_KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]


def _index(docs: DataFrame, classes: np.ndarray, percent: int, n_parts: int) -> DataFrame:
    """ROW by kind. 0: a document, its class a and size na (no a: empty set), nb its shingles outside class 0 of the order, if its
    prefix holds all of class 0. 1: a pair and how many rare tokens it shares. 2: a posting of class b, of size nb, under the
    frequent token a."""
    shared = docs.sparkSession.sparkContext.broadcast(classes)  # of fixed size
    names = ["part", "doc_id", "a", "na", "nb", "tokens", "who", "sizes"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = shared.value
        seen: set[int] = set()
        for b in batches:
            ids = b.column(0)
            doc, cls, size, outer = [], [], [], []
            tokens, who, sizes = [], [], []
            for at, data, offs in K.chunks(b.column(1)):
                for i, s in enumerate(K.shingle_sets(K.Words(data, offs, lower=True), SHINGLE)):
                    n = len(s)
                    doc.append(ids[at + i].as_py())
                    size.append(n)
                    if not n:
                        cls.append(None)
                        outer.append(None)
                        continue
                    c = _class(s)
                    cls.append(c)
                    own_class = classes[(s & CELL).astype(np.int64)]
                    take = min(n, n - (n * percent + 99) // 100 + 1 + _extra(n, percent))
                    inner = int(np.count_nonzero(own_class == 0))
                    outer.append(n - inner if inner <= take else None)
                    if c in seen:
                        continue
                    seen.add(c)
                    own = (own_class.astype(U) << U(58)) | (s >> U(6))
                    tokens.append(np.partition(own, take - 1)[:take])
                    who.append(np.full(take, c, LONG))
                    sizes.append(np.full(take, n, np.int32))
            if len(seen) > 200_000:
                seen.clear()
            none = [None] * len(doc)
            yield _batch(names, kinds, [[d % n_parts if d is not None else 0 for d in doc], doc, cls, size, outer, none, none, none])
            if tokens:
                t = np.concatenate(tokens)
                rows = list(K.deal((K.mix(t) % U(n_parts)).astype(np.int64), n_parts, t, np.concatenate(who), np.concatenate(sizes)))
                none = [None] * len(rows)
                yield _batch(names, kinds, [[p for p, _ in rows], none, none, none, none, *[[x[j] for _, x in rows] for j in range(3)]])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[bytes]] = [[], [], []]
        for b in batches:
            plain = b.column(5).is_null()
            own = b.filter(plain)
            if own.num_rows:
                none = pa.nulls(own.num_rows, pa.int32())
                yield _batch(_NAMES, _KINDS, [[0] * own.num_rows, own.column(1), own.column(2), pa.nulls(own.num_rows, pa.int64()), own.column(3), own.column(4), none])
            rest = b.filter(pc.invert(plain))
            for j in range(3):
                held[j] += rest.column(5 + j).to_pylist()
        (a, b, na, nb, times), (token, who, n) = _pairs(K.joined(held[0], U), K.joined(held[1], LONG), K.joined(held[2], np.int32), percent)
        if len(a):
            yield _batch(_NAMES, _KINDS, [np.ones(len(a), np.int32), pa.nulls(len(a), pa.int64()), a, b, na, nb, times])
        if len(token):
            yield _batch(_NAMES, _KINDS, [np.full(len(token), 2, np.int32), pa.nulls(len(token), pa.int64()), token.view(LONG), who, pa.nulls(len(token), pa.int32()), n, pa.nulls(len(token), pa.int32())])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(post, "part int, doc_id bigint, a bigint, na int, nb int, tokens binary, who binary, sizes binary")
    return dealt(rows, n_parts).mapInArrow(pair, ROW)


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cls, low, high, p0 ..): sorted shingles below and above a quarter of the hash space, and the parity of the number of
    shingles in each of 64 * ``PARITY`` cells, of the classes in wanted (cls, doc_id)."""
    words = [f"p{j}" for j in range(PARITY)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cls, low, high, odd = [], [], [], []
            for at, data, offs in K.chunks(b.column(1)):
                for i, s in enumerate(K.shingle_sets(K.Words(data, offs, lower=True), SHINGLE)):
                    c = b.column(0)[at + i].as_py()
                    if len(s) and c == _class(s):
                        cut = np.searchsorted(s, U(1 << 62))
                        cls.append(c)
                        low.append(s[:cut].tobytes())
                        high.append(s[cut:].tobytes())
                        cells = np.bincount((s % U(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
                        odd.append(np.packbits(cells.astype(bool)).view(LONG))
            odd = np.array(odd, LONG).reshape(-1, PARITY)
            yield _batch(["cls", "low", "high", *words], [pa.int64(), pa.binary(), pa.binary()] + [pa.int64()] * PARITY, [cls, low, high, *odd.T])

    texts = docs.select(F.col("doc_id").cast("long").alias("d"), "text").join(wanted, F.col("d").eqNullSafe(F.col("doc_id")))
    return texts.select("cls", "text").mapInArrow(run, "cls bigint, low binary, high binary, " + ", ".join(f"{w} bigint" for w in words))


def _verify(pairs: DataFrame, sets: DataFrame, stage: Stage, name: str, percent: int) -> DataFrame:
    """The pairs (a, b) of pairs (a, b, na, nb) that reach the threshold."""

    def quarter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for na, nb, x, y in zip(*(b.column(j).to_pylist() for j in range(2, 6)), strict=True):
                x, y = np.frombuffer(x, U), np.frombuffer(y, U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                # at J = p / 100 sets differ in (100 - p) / (100 + p) of their summed sizes
                keep.append((len(x) + len(y) - 2 * both) * (100 + percent) <= (na + nb) * (100 - percent))
            yield b.select([0, 1, 2, 3]).filter(pa.array(keep, pa.bool_()))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for na, nb, *x in zip(*(b.column(j).to_pylist() for j in range(2, 8)), strict=True):
                lo, hi, lo2, hi2 = (np.frombuffer(v, U) for v in x)
                both = len(np.intersect1d(lo, lo2, assume_unique=True)) + len(np.intersect1d(hi, hi2, assume_unique=True))
                keep.append(100 * both >= percent * (na + nb - both))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    def side(key: str, *cols: str) -> DataFrame:
        return sets.select(F.col("cls").alias(key), *[F.col(c).alias(f"{c}_{key}") for c in cols])

    likely = pairs.join(side("a", "low"), "a").join(side("b", "low"), "b").select("a", "b", "na", "nb", "low_a", "low_b")
    likely = stage.put(likely.mapInArrow(quarter, "a bigint, b bigint, na int, nb int"), f"{name}_likely")
    stage.tidy()
    full = likely.join(side("a", "low", "high"), "a").join(side("b", "low", "high"), "b").select("a", "b", "na", "nb", "low_a", "high_a", "low_b", "high_b")
    return stage.put(full.mapInArrow(whole, "a bigint, b bigint"), f"{name}_links")


def _combine(held: DataFrame, percent: int) -> DataFrame:
    """(sig, cls, n, m, deep): the combinations of two frequent tokens in one bucket. held: cls, n, m, deep, tokens.

    For each B that the smaller k of a pair may have; B = 0 (sets of one shingle) has single tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cls, n, m, deep, tokens in zip(*(b.column(j) for j in range(5)), strict=True):
                cls, n, m, deep = cls.as_py(), n.as_py(), m.as_py(), deep.as_py()
                tokens = np.sort(tokens.values.to_numpy().view(U))
                mixed, got = K.mix(tokens.copy()), []
                most, least = (_extra(x, percent).bit_length() for x in (n, (n * percent + 99) // 100))
                for bits in range(least, most + 1):
                    if not bits:
                        got.append(mixed)
                        continue
                    bucket = (mixed >> U(20)) & U((1 << bits - 1) - 1)
                    order = np.argsort(bucket, kind="stable")
                    bucket, t = bucket[order], tokens[order]
                    for step in range(1, len(t)):
                        i = np.flatnonzero(bucket[step:] == bucket[:-step])
                        if not len(i):
                            break
                        got.append(K.mix(K.mix(t[i] + U(bits)) + K.SALT * t[i + step]))
                for sigs in got:
                    yield _batch(["sig", "cls", "n", "m", "deep"], [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()], [sigs.view(LONG), *(np.full(len(sigs), x) for x in (cls, n, m, deep))])

    return held.select("cls", "n", "m", "deep", "tokens").mapInArrow(run, "sig bigint, cls bigint, n int, m int, deep boolean")


def _fits(x: str, y: str, percent: int) -> Column:
    """Whether sizes, and what both sets can have in common, allow the threshold."""

    def of(side: str, name: str) -> Column:
        return F.col(f"{side}.{name}").cast("long")

    total = of(x, "n") + of(y, "n")
    near = (of(x, "n") * 100 >= of(y, "n") * percent) & (of(y, "n") * 100 >= of(x, "n") * percent)
    common = F.least(of(x, "m"), of(y, "m")) * (100 + percent) >= total * percent
    return near & (~F.col(f"{x}.deep") | ~F.col(f"{y}.deep") | common)


def _pair_of(x: str, y: str) -> list[Column]:
    """a, b, na, nb of a joined pair, smaller class first."""
    first = F.col(f"{x}.cls") < F.col(f"{y}.cls")
    return [F.when(first, F.col(f"{p}.{c}")).otherwise(F.col(f"{q}.{c}")).alias(name) for name, p, q, c in (("a", x, y, "cls"), ("b", y, x, "cls"), ("na", x, y, "n"), ("nb", y, x, "n"))]


SCORE = "struct(m / n as share, cls, n, m, deep)"


def _led(combined: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb) of each combination's members with its leader."""
    lists = combined.groupBy("sig").agg(F.max(F.expr(SCORE)).alias("lead"), F.min("cls").alias("lo"), F.max("cls").alias("hi")).filter("lo <> hi")
    joined = combined.join(lists.select("sig", "lead"), "sig").select(F.struct("cls", "n", "m", "deep").alias("x"), F.col("lead").alias("y"))
    return joined.filter((F.col("x.cls") != F.col("y.cls")) & _fits("x", "y", percent)).select(*_pair_of("x", "y")).distinct()


def _crossing(combined: DataFrame, comp: DataFrame | None, sets: DataFrame, stage: Stage, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb) of different components that share a combination and that no bound rules out."""
    if comp is None:
        rows = combined.withColumn("root", F.col("cls"))
    else:
        rows = combined.join(comp.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    # the largest partner that each row's m allows
    rows = rows.withColumn("most", F.floor(F.when(F.col("deep"), F.col("m")).otherwise(F.col("n")) * (100 + percent) / percent) - F.col("n"))
    lists = rows.groupBy("sig").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("n").alias("least"), F.max("most").alias("reach"), F.min("deep").alias("bounded"),
    ).filter("lo <> hi")
    live = rows.join(lists.select("sig", "least", "reach", "bounded"), "sig").filter("not bounded or (least <= most and n <= reach)")
    live = stage.put(live.select("sig", "cls", "n", "m", "deep", "root"), "live")
    spans = live.groupBy("sig").agg(F.max(F.expr("struct(m / n as share, cls, root)"))["root"].alias("core"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi")
    parity = [f"p{j}" for j in range(PARITY)]
    live = live.join(spans.select("sig", "core"), "sig").join(sets.select("cls", *parity), "cls")
    live = stage.put(live, "spanning")
    x, y = live.filter("root <> core").alias("x"), live.alias("y")
    other = (F.col("x.root") != F.col("y.root")) & ((F.col("y.root") == F.col("y.core")) | (F.col("x.cls") < F.col("y.cls")))
    apart = sum((F.bit_count(F.col(f"x.{p}").bitwiseXOR(F.col(f"y.{p}"))) for p in parity), F.lit(0))
    # at J = p / 100 sets differ in (100 - p) / (100 + p) of their summed sizes
    close = apart * (100 + percent) <= (F.col("x.n") + F.col("y.n")) * (100 - percent)
    return x.join(y, (F.col("x.sig") == F.col("y.sig")) & other & _fits("x", "y", percent) & close).select(*_pair_of("x", "y")).distinct()


def _candidates(docs: DataFrame, stage: Stage, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, cls, n), classes (cls, doc_id), pairs of rare shingles, combinations, and the sets of all these."""
    n_parts = parts(docs)
    classes = _sketch(docs, stage)
    found = stage.put(_index(docs, classes, percent, n_parts), "found")
    stage.tidy()
    rows = found.filter("kind = 0").select("doc_id", F.col("a").alias("cls"), F.col("na").alias("n"), F.col("nb").alias("outer"))
    firsts = rows.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.max("outer").alias("outer"))
    often = found.filter("kind = 2").select(F.col("a").alias("token"), F.col("b").alias("cls"))
    inner = F.sum((F.shiftrightunsigned("token", 58) == 0).cast("int"))
    held = often.groupBy("cls").agg(F.count("*").alias("often"), inner.alias("inner"), F.collect_list("token").alias("tokens"))  # a prefix at most
    held = held.join(firsts.select("cls", "n", "outer"), "cls")
    deep = F.col("outer").isNotNull()
    held = stage.put(held.select("cls", "n", "often", F.when(deep, F.col("outer") + F.col("inner")).otherwise(F.col("n")).cast("int").alias("m"), deep.alias("deep"), "tokens"), "held")
    counted = found.filter("kind = 1").groupBy("a", "b", "na", "nb").agg(F.sum("times").alias("times"))
    # of the k + 1 shingles that a similar pair shares, no more are frequent than either prefix holds
    for side in "ab":
        counted = counted.join(held.select(F.col("cls").alias(side), F.col("often").alias(f"often_{side}")), side, "left")
    shared = _extra_column(F.least("na", "nb"), percent) + 1
    enough = F.greatest(F.lit(1), shared - F.least(F.coalesce("often_a", F.lit(0)), F.coalesce("often_b", F.lit(0))))
    pairs = stage.put(counted.filter(F.col("times") >= enough).select("a", "b", "na", "nb"), "pairs")
    whole = held.filter(F.col("often") > _extra_column(F.ceil(F.col("n") * percent / 100), percent))
    combined = stage.put(_combine(whole, percent), "combined")
    needed = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).unionByName(whole.select("cls")).distinct()
    sets = stage.put(_sets(docs, firsts.select("cls", "doc_id").join(needed, "cls")), "sets")
    stage.tidy()
    return rows, firsts.select("cls", "doc_id"), pairs, combined, sets


def join_pairs(docs: DataFrame, stage: Stage, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """All links: membership (doc_id, cls, n) of every row, cls null for an empty set, and the linked classes (a, b)
    of different sets. Rows of one class are linked with each other and with all rows of its linked classes."""
    rows, _, pairs, combined, sets = _candidates(docs, stage, percent)
    crossing = _crossing(combined, None, sets, stage, percent)
    return rows.select("doc_id", "cls", "n"), _verify(pairs.unionByName(crossing).distinct(), sets, stage, "all", percent)


def join_components(docs: DataFrame, stage: Stage, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text), by links of Jaccard >= percent / 100."""
    rows, firsts, pairs, combined, sets = _candidates(docs, stage, percent)
    links = _verify(pairs.unionByName(_led(combined, percent)).distinct(), sets, stage, "one", percent)
    stage.tidy()
    comp = stage.put(components(links, stage, "c"), "comp")
    more = _verify(_crossing(combined, comp, sets, stage, percent), sets, stage, "two", percent)
    if more.limit(1).count():
        comp = stage.put(components(links.unionByName(more), stage, "d"), "comp_all")
    rooted = firsts.join(comp, F.col("cls") == F.col("node"), "left").select("cls", F.coalesce("root", "cls").alias("root"), "doc_id")
    rooted = stage.put(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = rooted.select("cls", "root").join(least, "root").select("cls", "component_id")
    stage.drop("sets", "pairs", "combined", "live", "spanning", "held")
    out = rows.join(named, "cls", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op8_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(table(spark, sf_dir, "documents").select("doc_id", "text"), Stage(spark, "op8"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id
  HAVING 100 * count(*) >= 80 * ((SELECT n FROM n WHERE doc_id = a.doc_id) + (SELECT n FROM n WHERE doc_id = b.doc_id) - count(*))
), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (
  SELECT a AS doc_id, a AS reached FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reached = e.a
)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id
LEFT JOIN (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id) c ON c.doc_id = w.doc_id
"""
