"""Language identification by nearest clustered centroid over normalised TF-IDF n-gram vectors.

Features are hashed byte 1- to 4-grams of the lower-cased text (letters and bytes over 127 kept, digits one
symbol, all else a space), counted over the whole text, log-damped, weighted by IDF and normalised. Each language gets several
centroids from spherical k-means; a text goes to the language of the centroid with the largest cosine.
Rejection is by distance, calibrated by length, that is the number of different n-grams (so repetition doesn't count):
all texts of the sample, and a piece of each of 1, 2, 4, ... words, are compared with centroids fitted without them. A
text whose cosine is under ``MARGIN`` of what all but ``LOW`` of the genuine ones of its length and centroid reach is
``rejected``. A length that a centroid has under ``ENOUGH`` of takes that of all centroids, or of the next shorter length.

The classifier is fitted on a bounded sample of labelled rows: of each language, rows whose doc_id hash is under
``SAMPLE / rows``, about ``SAMPLE`` rows, at most ``MAX_FEATURE_MB`` of vectors in all. It is the only sampled step.

Results: null text or text without a letter is ``und`` with score 0 and rejected; no labelled rows at all make
every text ``und``. Rows are kept one by one (repeated rows, null ids); ties go to the first language by code point.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BITS = 12
DIM = 1 << BITS
SAMPLE = 300
CENTROIDS = 4
FOLDS = 3
LOW = 0.01
MARGIN = 0.75
ENOUGH = 50
MAX_FEATURE_MB = 64
PIECES = tuple(2**k for k in range(13))
CHUNK = 1 << 20

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[48:58] = 48
_FOLD[128:] = np.arange(128, 256)
_LETTER = regex.compile(r"\p{L}")
_ASCII = regex.compile("[A-Za-z]")


def grams(text: str) -> np.ndarray:
    """Counts of hashed byte 1- to 4-grams of the whole text, in pieces of bounded memory."""
    raw = _FOLD[np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace"), np.uint8)]
    out = np.zeros(DIM, np.int64)
    for at in range(0, len(raw), CHUNK):
        b = raw[at : at + CHUNK + 3].astype(np.uint32)
        n = min(CHUNK, len(raw) - at)
        code = b.copy()
        for k in range(1, 5):
            if k > 1:
                code = code[:-1] * np.uint32(257) + b[k - 1 :] if len(code) > 1 else code[:0]
            own = code[:n]
            mixed = (own * np.uint32(0x9E3779B1) + np.uint32(k * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(32 - BITS)
            out += np.bincount(mixed, minlength=DIM)
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and bool(_ASCII.search(text) or _LETTER.search(text))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _length(counts: np.ndarray) -> int:
    """Half powers of two of the number of different n-grams."""
    return int(2 * np.log2(max(1, np.count_nonzero(counts))))


def _means(x: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, list[int]]:
    """Centroids of each of n languages by spherical k-means, and whose they are."""
    centres, owner = [], []
    for i in range(n):
        own = x[y == i]
        k = min(CENTROIDS, len(own))
        if not k:
            continue
        c = own[np.linspace(0, len(own) - 1, k).astype(int)]
        for _ in range(12):
            near = np.argmax(own @ c.T, 1)
            c = np.stack([_unit(own[near == j].mean(0)) if (near == j).any() else c[j] for j in range(k)])
        centres += list(c)
        owner += [i] * k
    return np.stack(centres).astype(np.float32), owner


def _floors(seen: list[tuple[int, int, float]], n: int) -> np.ndarray:
    """Least cosine by centroid and length, from (centroid, length, cosine) of genuine texts."""
    c, size, cos = (np.array(v) for v in zip(*seen))
    out = np.zeros((n, 2 * BITS + 1))
    for k in range(out.shape[1]):
        own = size == k
        if own.sum() < ENOUGH:
            out[:, k] = out[:, k - 1] if k else 0.0
            continue
        out[:, k] = np.quantile(cos[own], LOW)
        for j in range(n):
            if (mine := own & (c == j)).sum() >= ENOUGH:
                out[j, k] = np.quantile(cos[mine], LOW)
    return MARGIN * out


class Model:
    def __init__(self, langs, idf, centroids, owner, floors):
        self.langs, self.idf, self.centroids, self.owner, self.floors = langs, idf, centroids, owner, floors

    def vector(self, counts: np.ndarray) -> np.ndarray:
        return _unit(np.log1p(counts).astype(np.float32) * self.idf)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not self.langs or not has_letter(text):
            return "und", 0.0, True
        counts = grams(text)
        cos = self.centroids @ self.vector(counts)
        best = int(np.argmax(cos))
        score = float(min(1.0, max(0.0, cos[best])))
        return self.langs[self.owner[best]], score, bool(score < self.floors[best, _length(counts)])


def fit(rows: list[tuple[str, str]]) -> Model:
    """From (lang, text) rows of the bounded sample."""
    rows = sorted((lang, text) for lang, text in rows if has_letter(text))
    langs = sorted({lang for lang, _ in rows})
    if not rows:
        return Model([], np.ones(DIM, np.float32), np.zeros((0, DIM), np.float32), [], np.zeros((0, 2 * BITS + 1)))
    counts = np.stack([grams(t).astype(np.float32) for _, t in rows])
    idf = (np.log((1 + len(rows)) / (1 + (counts > 0).sum(0))) + 1).astype(np.float32)
    x = _unit(np.log1p(counts) * idf)
    y = np.array([langs.index(lang) for lang, _ in rows])
    centroids, owner = _means(x, y, len(langs))
    model = Model(langs, idf, centroids, owner, None)
    fold = np.array([zlib.crc32(t.encode("utf-8", "replace")) % FOLDS for _, t in rows])  # copies are in one fold
    seen: list[tuple[int, int, float]] = []
    for f in range(FOLDS):
        out = np.flatnonzero(fold == f)
        rest = _means(x[fold != f], y[fold != f], len(langs))[0] if len(out) < len(rows) else centroids
        for i in out:
            words = rows[i][1].split()
            mark = zlib.crc32(rows[i][1].encode("utf-8", "replace"))
            pieces = [" ".join(words[at : at + n]) for n in PIECES if n < len(words) for at in [mark % (len(words) - n + 1)]]
            for c in [counts[i], *(grams(p) for p in pieces if has_letter(p))]:
                v = model.vector(c)
                seen.append((int(np.argmax(centroids @ v)), _length(c), float((rest @ v).max())))
    model.floors = _floors(seen, len(owner))
    return model


def train(labelled: DataFrame, lang: str = "lang", text: str = "text", row_id: str = "doc_id") -> Model:
    """Fits on about SAMPLE rows of each language; their n-gram counts fit MAX_FEATURE_MB on the driver."""
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang).agg(F.count("*")).collect()}  # one row a language
    if not sizes:
        return fit([])
    each = max(1, min(SAMPLE, MAX_FEATURE_MB * (1 << 20) // (4 * DIM * len(sizes))))
    unit = F.pmod(F.xxhash64(row_id, F.lit("sample")), F.lit(1 << 30)).cast("double") / float(1 << 30)
    rate = F.create_map(*[x for name, n in sizes.items() for x in (F.lit(name), F.lit(min(1.0, each / n)))])
    taken = rows.filter(unit < F.try_element_at(rate, F.col(lang))).select(lang, text).limit(each * len(sizes) * 2)
    return fit([(r[0], r[1]) for r in taken.collect()])


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all by default) with lang_pred, score and rejected."""
    spark = docs.sparkSession
    keep = docs.columns if keep is None else keep
    shared = spark.sparkContext.broadcast(model)  # centroids of bounded number and size
    rows = docs.select(*keep, F.col("text").alias("__text"))
    fields = [f for f in rows.schema.fields if f.name != "__text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["`lang_pred` string", "`score` double", "`rejected` boolean"])
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = b.column(len(names))
            told = [m.predict(texts[i].as_py()) for i in range(b.num_rows)]
            made = [pa.array([t[k] for t in told], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], *made], [*names, "lang_pred", "score", "rejected"])

    return rows.mapInArrow(run, schema)


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; fold 1 is held out. A null id is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)), F.lit(0))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(fold_of(F.col("doc_id")) != 1))
    rows = docs.select("doc_id", "text", (fold_of(F.col("doc_id")) == 1).alias("held_out"))
    return identify(rows, model, keep=["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score", "rejected")
