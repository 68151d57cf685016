"""Vector codes by product quantisation in integers, with partial-distance search for the nearest entries."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_copies, materialise

#: Parts of a vector, entries of each part's codebook, rounds of refinement, steps of an integer in 1.
PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Integers beyond this saturate, so that distances of 64 components fit in 64 bits: components of 32,768 and more.
LARGEST = 1 << 27


def integers(vectors: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows kept, their components as integers) of an Arrow array of lists: floor(SCALE * x) of vectors that are whole: not null, no
    null and no component that isn't finite, and as long as width (null: any that has one length)."""
    size = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(vectors), -1))
    width = int(size.max(initial=0)) if width is None else width
    rows = np.flatnonzero(size == width) if width else np.zeros(0, int)
    flat = vectors.take(pa.array(rows)).flatten().cast(pa.float64())
    # a null is read as NaN, and both leave their vector out
    values = flat.to_numpy(zero_copy_only=False).reshape(-1, width) if width else np.zeros((0, 0))
    fine = np.isfinite(values).all(axis=1)
    whole = np.clip(np.floor(values[fine] * SCALE), -LARGEST, LARGEST).astype(np.int64)
    return rows[fine], np.pad(whole, ((0, 0), (0, -width % PARTS)))


def nearest(points: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance) of each point; ties to the lower index.

    Partial-distance search: entries are tried in order and dimensions in descending variance of the codebook, so that sums
    grow fast; a point goes on with an entry only while the sum doesn't exceed its best complete distance."""
    n = len(codebook)
    order = np.argsort(-(n * (codebook**2).sum(axis=0) - codebook.sum(axis=0) ** 2), kind="stable")
    columns = [np.ascontiguousarray(points[:, d]) for d in order]
    best = sum((c - codebook[0, d]) ** 2 for c, d in zip(columns, order, strict=True)) + np.zeros(len(points), np.int64)
    index = np.zeros(len(points), np.int64)
    for e in range(1, n):
        active, reached = np.arange(len(points)), np.zeros(len(points), np.int64)
        for c, d in zip(columns, order, strict=True):
            reached = reached + (c[active] - codebook[e, d]) ** 2
            on = reached <= best[active]
            active, reached = active[on], reached[on]
        nearer = reached < best[active]
        best[active[nearer]] = reached[nearer]
        index[active[nearer]] = e
    return index, best


def encode(points: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entries by point and part, squared distance summed over parts)."""
    step = points.shape[1] // PARTS
    found = [nearest(points[:, p * step : (p + 1) * step], codebooks[p]) for p in range(PARTS)]
    return np.stack([i for i, _ in found], axis=1), sum(d for _, d in found)


def _sums(codebooks: np.ndarray, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """part, entry, n, total (by component) of the vectors that one task reads: one row for each entry that is used."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(codebooks.shape[:2], np.int64), np.zeros(codebooks.shape, np.int64)
        step = codebooks.shape[2]
        for batch in batches:
            _, points = integers(batch.column(0), width)
            if len(points):
                index, _ = encode(points, codebooks)
                for p in range(PARTS):
                    np.add.at(n[p], index[:, p], 1)
                    np.add.at(total[p], index[:, p], points[:, p * step : (p + 1) * step])
        p, e = np.nonzero(n)
        yield pa.record_batch({"part": pa.array(p, pa.int32()), "entry": pa.array(e, pa.int32()), "n": pa.array(n[p, e]), "total": pa.array(total[p, e].tolist(), pa.list_(pa.int64()))})

    return run


def _codes(codebooks: np.ndarray, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, points = integers(batch.column(0), width)
            if len(rows):
                index, error = encode(points, codebooks)
                code = [bytes(x).hex() for x in index.astype(np.uint8)]
                kept = batch.take(pa.array(rows))
                yield pa.record_batch({"vec_id": kept.column(1), "label": kept.column(2), "code": pa.array(code, pa.string()), "error": pa.array(error)})

    return run


def whole(embedding: str = "embedding") -> F.Column:
    """Whether a vector is neither null nor empty and all its components are finite."""
    x = F.col(embedding)
    return F.coalesce((F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))


def fit(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[np.ndarray, int]:
    """(codebooks as [part, entry, component] in integers, length of the vectors) of vectors(vec_id, embedding).

    Codebooks begin as the parts of the ENTRIES smallest vec_ids (equal ones in order of their components, null ones last); the
    length of vectors is that of the first. Each round is one pass over all vectors, from which each task sends at most PARTS *
    ENTRIES sums; what comes to the driver is as many rows. Entries are replaced by floor(sum / count), unused ones stay."""
    rows = vectors.select(F.col("embedding").cast("array<float>").alias("embedding"), F.col("vec_id").cast("long").alias("vec_id"))
    first = rows.where(whole()).orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(ENTRIES).collect()
    if not first:
        return np.zeros((PARTS, 0, 0), np.int64), 0
    width = len(first[0].embedding)
    _, begin = integers(pa.array([r.embedding for r in first], pa.list_(pa.float32())), width)
    step = begin.shape[1] // PARTS
    books = np.stack([begin[:, p * step : (p + 1) * step] for p in range(PARTS)])
    for _ in range(rounds):
        s = rows.select("embedding").mapInArrow(_sums(books, width), "part int, entry int, n long, total array<long>")
        cells = [F.sum(F.col("total")[k].cast("decimal(38,0)")).alias(f"t{k}") for k in range(step)]
        for r in s.groupBy("part", "entry").agg(F.sum("n").alias("n"), *cells).collect():  # PARTS * ENTRIES rows at most
            books[r.part, r.entry] = [int(r[f"t{k}"]) // r.n for k in range(step)]
    return books, width


def digest(codebooks: np.ndarray) -> str:
    """SHA-256 of all entries' components by part, entry and place, in decimals with commas between."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label, label_error, codebooks_sha256 of vectors(vec_id, embedding, label).

    code: the entry of each part, two hex digits each; error: squared distance of the vector's integers to its code's; label_error:
    the sum of errors of the vectors of the same label, null labels together. Left out: vectors that are null or empty, have a
    component that is null or not finite, or another length than the first. A length that isn't a multiple of PARTS counts
    zeros behind it. Components of 32,768 and more count as that. Ties go to the lower entry; repeated rows and ids have a row
    each; an empty table gives none; other columns are left out, whatever their names."""
    books, width = fit(vectors)
    rows = vectors.select(F.col("embedding").cast("array<float>").alias("embedding"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"))
    coded = rows.mapInArrow(_codes(books, width), "vec_id long, label string, code string, error long")
    coded = materialise(coded.withColumn("key_", F.when(F.col("label").isNull(), "null").otherwise(F.concat(F.lit("="), "label"))), "codes")
    sums = coded.groupBy("key_").agg(F.sum("error").alias("label_error"), F.count("*").alias("copies_"))
    out = join_copies(coded, sums, "key_", "copies_", coded.count())
    return out.select("vec_id", "code", "error", "label", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
