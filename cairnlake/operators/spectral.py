"""Leading singular vectors of a symmetric matrix in a fixed number of passes, with nothing as long as the matrix on the driver. Rows are
numbered in blocks; what belongs to a block is one row (b, t, m) of bytes, a matrix with the block's rows side by side."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import few, held, stored

#: Directions this far below the largest of their block (as squares) are taken as rounding noise.
NOISE = 1e-13


#: Rows of a block, at most about.
ROWS = 16_384
BLOCKS = "b int, t int, m binary"


def _arrays(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1], m.ravel())


def _rows(rows: list[tuple[int, int, np.ndarray]]) -> pa.Table:
    b, t, m = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table([pa.array(b, pa.int32()), pa.array(t, pa.int32()), pa.array([x.tobytes() for x in m], pa.binary())], ["b", "t", "m"])


def _parts(x: pa.Table | pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    """(b, t, m as numbers) of rows of blocks."""
    m = x.column("m")
    for k, (b, t) in enumerate(zip(x.column("b").to_pylist(), x.column("t").to_pylist(), strict=True)):
        yield b, t, np.frombuffer(m[k].as_buffer(), float)


def _together(frames: list[DataFrame]):
    return reduce(DataFrame.union, frames).groupBy("b")


def tiles(cells: DataFrame, at: DataFrame) -> DataFrame:
    """cells(i, j, value) by blocks: b of their columns, t of their rows, m: places of rows, of columns, and values."""

    def pack(x: pa.Table) -> pa.Table:
        i, j, v = (x[c].to_numpy() for c in ("pi", "pj", "value"))
        order = np.argsort(i, kind="stable")
        return _rows([(x["b"][0].as_py(), x["t"][0].as_py(), np.r_[np.c_[i, j].astype(np.int32)[order].T.ravel().view(float), v[order]])])

    c = cells.join(at.select(F.col("id").alias("i"), F.col("b").alias("t"), F.col("pos").alias("pi")), "i").join(at.select(F.col("id").alias("j"), "b", F.col("pos").alias("pj")), "j")
    return stored(c.select("b", "t", "pi", "pj", "value").groupBy("b", "t").applyInArrow(pack, BLOCKS))


def product(cells: DataFrame, q: DataFrame, width: int, sizes: dict[int, int]) -> DataFrame:
    """Blocks of A q for tiles() of A and blocks of q: a block of columns gives one part of each block of rows, which are summed."""

    def times(x: pa.Table) -> pa.Table:
        parts, out = list(_parts(x)), {}
        q = next((m.reshape(width, -1) for _, t, m in parts if t < 0), None)
        for _, t, m in parts:
            if t >= 0 and q is not None:
                n = len(m) // 2
                (i, j), v = m[:n].view(np.int32).reshape(2, n), m[n:]
                y = out.setdefault(t, np.zeros((width, sizes[t])))
                for k in range(width):
                    y[k] += np.bincount(i, v * q[k][j], sizes[t])
        return _rows([(t, -1, y) for t, y in out.items()])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, y = None, None
        for x in batches:
            for b, _, m in _parts(x):
                if b != at:
                    if at is not None:
                        yield from _rows([(at, -1, y)]).to_batches()
                    at, y = b, np.zeros(len(m))
                y += m
        if at is not None:
            yield from _rows([(at, -1, y)]).to_batches()

    parts = _together([cells, q.withColumn("t", F.lit(-1))]).applyInArrow(times, BLOCKS)
    return stored(parts.repartition("b").sortWithinPartitions("b").mapInArrow(total, BLOCKS))


def _stacked(x: pa.Table, widths: list[int], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(K, Y) of a block, as rows: those of each step, one below the other, and those of t < 0."""
    at = {t: m for _, t, m in _parts(x)}
    n = next(len(m) // (widths[t] if t >= 0 else width) for t, m in at.items())
    k = [at[t].reshape(w, n) for t, w in enumerate(widths)]
    return np.vstack(k) if k else np.zeros((0, n)), at[-1].reshape(width, n) if -1 in at else np.zeros((width, n))


def gram(frames: list[DataFrame], y: DataFrame, widths: list[int], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(KᵀY, YᵀY) of blocks of K, by step, and of Y: each block sends so many rows of sums, whatever its size."""
    known = sum(widths)

    def sums(x: pa.Table) -> pa.Table:
        k, y = _stacked(x, widths, width)
        found = np.vstack([k @ y.T, y @ y.T])
        return pa.table([pa.array(np.arange(known + width, dtype=np.int32)), *map(pa.array, found.T)], ["r", *[f"v{k}" for k in range(width)]])

    each = _together([*frames, y.withColumn("t", F.lit(-1))]).applyInArrow(sums, "r int, " + ", ".join(f"v{k} double" for k in range(width)))
    found = each.groupBy("r").agg(*[F.sum(f"v{k}").alias(f"v{k}") for k in range(width)]).collect()  # known + width rows
    out = np.zeros((known + width, width))
    for r in found:
        out[r[0]] = r[1:]
    return out[:known], out[known:]


def changed(frames: list[DataFrame], y: DataFrame, widths: list[int], width: int, less: np.ndarray, by: np.ndarray) -> DataFrame:
    """Blocks of (Y - K less) by, as the next step's."""
    step = len(widths)

    def change(x: pa.Table) -> pa.Table:
        k, y = _stacked(x, widths, width)
        return _rows([(x["b"][0].as_py(), step, by.T @ (y - less.T @ k))])

    return stored(_together([*frames, y.withColumn("t", F.lit(-1))]).applyInArrow(change, BLOCKS))


def _freed(s: np.ndarray, scale: float) -> np.ndarray:
    """B with BᵀSB = 1, without directions that are noise."""
    e, v = np.linalg.eigh((s + s.T) / 2)
    keep = e > NOISE * scale
    return v[:, keep] / np.sqrt(e[keep])


def _largest(small: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k eigenvalues of largest size, and their vectors, of a symmetric matrix by its upper half, in a basis whose gram matrix is own."""
    even = _freed(own, 0.0)
    value, vector = np.linalg.eigh(even.T @ (np.triu(small) + np.triu(small, 1).T) @ even)
    order = np.argsort(-np.abs(value), kind="stable")[:k]
    return value[order], even @ vector[:, order]


def _settled(small: np.ndarray, own: np.ndarray, left: np.ndarray, k: int, tol: float) -> bool:
    """Whether the k largest stay as they are: left is the gram matrix of what the newest block's product holds beyond the space."""
    value, vector = _largest(small, own, k)
    if len(value) < k:
        return False
    w = vector[-len(left) :]
    residual = np.sqrt(np.maximum(np.einsum("ik,ij,jk->k", w, left, w), 0))
    return bool(residual.max() <= tol * np.abs(value[0]))


def symmetric_svd(matrix: DataFrame, dim: int = 48, extra: int = 10, steps: int = 20, tol: float = 1e-6) -> DataFrame:
    """id, vec: rows of U·S of the symmetric matrix(i, j, value), with min(dim, n - 1) components by descending size; those beyond its rank
    are 0. Signs, and rotations among equal singular values, are free.

    Block Krylov method: from dim + extra columns of hashed ids, each step multiplies the newest block by the matrix, frees it from all
    blocks before and writes it; the blocks before stay where they are. How far the blocks are from orthogonal is measured, and the matrix
    within that space, known from the same sums, is solved on the driver: at most (steps * (dim + extra))² numbers. It ends once all components
    asked for leave a residual of at most tol times the largest, or after `steps` steps, so that the number of jobs is bounded whatever the
    matrix. Exact where the blocks fill the space (n up to steps * (dim + extra)); in larger matrices components near the cut whose sizes
    lie close together come last."""
    given = stored(matrix.select(F.col("i").cast("string").alias("i"), F.col("j").cast("string").alias("j"), F.col("value").cast("double").alias("value")))
    ids = held(given.select(F.col("i").alias("id")).union(given.select("j")).where("id is not null").distinct())
    n = ids.count()
    k = min(dim, n - 1)
    if k < 1:
        return ids.select("id", F.array().cast("array<double>").alias("vec"))
    blocks = max(ids.sparkSession.sparkContext.defaultParallelism, -(-n // ROWS))
    names = held(ids.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("b")).agg(F.sort_array(F.collect_list("id")).alias("ids")))
    sizes = {r.b: r.n for r in names.select("b", F.size("ids").alias("n")).collect()}  # a row for each block
    at = names.select("b", F.posexplode("ids").alias("pos", "id"))
    cells = tiles(given.where("value <> 0"), few(at))
    width = min(dim + extra, n)
    hashed = [(F.xxhash64("id", F.lit(c)) / F.lit(2.0**63)).alias(f"c{c}") for c in range(width)]

    def begin(x: pa.Table) -> pa.Table:
        order = np.argsort(x["pos"].to_numpy())
        return _rows([(x["b"][0].as_py(), -1, np.vstack([x[f"c{c}"].to_numpy()[order] for c in range(width)]))])

    y = stored(at.select("b", "pos", *hashed).groupBy("b").applyInArrow(begin, BLOCKS))
    frames, files, widths = [], [], []  # one frame of all steps' files
    small, own = np.zeros((0, 0)), np.zeros((0, 0))  # the upper half of KᵀAK: a block's columns down to its own rows; KᵀK
    for step in range(steps + 1):
        c, s = gram(frames, y, widths, width)
        even = _freed(own, 0.0) if widths else np.zeros((0, 0))
        less = even @ (even.T @ c)
        left = s - c.T @ less
        if widths:  # Y is the matrix times the newest block
            small[:, -width:] = c
            if step == steps or _settled(small, own, left, k, tol):
                break
        by = _freed(left, max(np.linalg.eigvalsh(s)[-1], np.finfo(float).tiny))
        if not by.shape[1]:  # the blocks hold all that the matrix can reach
            break
        q = changed(frames, y, widths, width, less, by)
        width = by.shape[1]
        c, s = gram(frames, q, widths, width)
        own = np.block([[own, c], [c.T, s]])
        small = np.pad(small, (0, width))
        files, widths = [*files, *q.inputFiles()], [*widths, width]
        frames = [q.sparkSession.read.schema(BLOCKS).parquet(*files)]
        y = product(cells, q, width, sizes)
    value, vector = _largest(small, own, k)
    to = np.zeros((sum(widths), k))
    to[:, : len(value)] = vector * np.abs(value)

    def turn(x: pa.Table) -> pa.Table:
        return _rows([(x["b"][0].as_py(), -1, _stacked(x, widths, 0)[0].T @ to)])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for r, (_, _, m) in enumerate(_parts(x)):
                yield pa.RecordBatch.from_arrays([x.column("ids")[r].values, _arrays(m.reshape(-1, k))], ["id", "vec"])

    return _together(frames).applyInArrow(turn, BLOCKS).join(names, "b").select("b", "t", "m", "ids").mapInArrow(spread, "id string, vec array<double>")
