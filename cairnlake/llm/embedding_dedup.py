"""Near duplicates among embeddings: binary codes decide which pairs are computed in full."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialise, sorted_runs

#: Rows of a block: a task compares two blocks at a time.
BLOCK = 1024
#: Standard errors of the estimate within which a pair is computed in full.
SIGMAS = 4.0
#: Share of pairs at the threshold itself that the bands bring together; pairs above it more often.
RECALL = 0.998


def rotations(dim: int, number: int, seed: int = 17) -> np.ndarray:
    """(number * dim) x dim: random orthogonal matrices, one below the other."""
    rng = np.random.default_rng([seed, dim])
    out = []
    for _ in range(number):
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        out.append(q * np.sign(np.diag(r)))
    return np.concatenate(out)


def tuned(n: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """(bits of a band, bands): longer bands as the rows grow, so that a band's buckets stay small;
    as many as the recall at the threshold asks for. A bit of two unit vectors is equal with
    probability 1 - angle / pi."""
    bits = min(16, max(6, math.ceil(math.log2(max(1, n) / 256))))
    p = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - p))


def encode(x: np.ndarray, bits: int, bands: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit vectors, correction factors, keys by band). A vector's code is the signs of its first
    rotation; its factor is the inner product of the vector with its own code, by which the
    product of the code with another vector is divided to become an unbiased estimate."""
    dim = x.shape[1]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    y = unit @ rotations(dim, max(1, -(-bits * bands // dim))).T
    factor = np.abs(y[:, :dim]).sum(axis=1) / math.sqrt(dim)
    sign = (y[:, : bits * bands] > 0).reshape(len(x), bands, bits)
    return unit, factor, (sign << np.arange(bits)).sum(axis=2).astype("<u2")


def candidates(x: np.ndarray, y: np.ndarray, factor: np.ndarray, threshold: float) -> np.ndarray:
    """Of all (i, j), the pairs whose upper confidence bound reaches the threshold, from the code of
    x_i and the rotated y_j; x and y are unit vectors in the rotation of the codes."""
    dim = x.shape[1]
    code = np.where(x > 0, np.float32(1 / math.sqrt(dim)), np.float32(-1 / math.sqrt(dim)))
    estimate = (code @ y.T.astype(np.float32)) / factor[:, None].astype(np.float32)
    error = SIGMAS * np.sqrt(np.maximum(0, 1 - factor**2) / np.maximum(factor, 1e-9) ** 2 / max(1, dim - 1))
    return estimate + error[:, None].astype(np.float32) >= threshold - 1e-5


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges enough to connect what the pairs connect."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = root[x]
        return x

    out = []
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(i), find(j)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((i, j))
    return out


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors(vec_id, embedding, label).

    Vectors link if their labels are equal and not null and their cosine, in double precision, is
    at least threshold. Equal vectors of a label are one point with a weight. Points that share a
    key in a band (some bits of their codes) meet in blocks of about BLOCK rows; there, estimates
    with confidence bounds from codes and correction factors rule out most pairs and the rest are
    computed in full. A pair counts in the first band that it shares. Blocks return, instead of
    pairs, each point's number of links and a spanning forest, so that their rows don't grow with
    the square of a group. The bands find pairs at the threshold with probability `recall`, closer
    ones more often; no pair below the threshold links.

    Vectors that are null, empty, zero or hold null or non-finite components, and those of null
    labels or other lengths than their partner, link with nothing: n_links 0, component_id their
    own vec_id. Repeated vec_ids keep their rows, and are equal points or linked like others."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"), F.col("label").cast("string").alias("label"))
    fine = F.coalesce(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e300)) & F.exists("e", lambda x: x != 0), F.lit(False)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    v = v.withColumn("fine", fine)
    points = v.where("fine").groupBy("label", "e").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    points = materialise(points.select("rep", "weight", "label", F.size("e").alias("dim"), "e"), "points")
    n = points.count()
    bits, bands = tuned(n, threshold, recall)

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                _, factor, keys = encode(np.stack(part.e.to_numpy()), bits, bands)
                yield pd.DataFrame({"rep": part.rep.to_numpy(), "weight": part.weight.to_numpy(), "label": part.label.to_numpy(), "dim": dim, "e": part.e.to_numpy(), "factor": factor, "keys": [x.tobytes() for x in keys], "key": list(keys.astype(np.int32))})

    coded = points.mapInPandas(keyed, "rep long, weight long, label string, dim int, e array<double>, factor double, keys binary, key array<int>")
    coded = materialise(coded, "coded")
    spread = coded.select("rep", "label", "dim", F.posexplode("key").alias("band", "bucket"))
    counted = spread.groupBy("label", "dim", "band", "bucket").agg(F.count("*").alias("rows")).where("rows > 1")
    blocks = F.ceil(F.col("rows") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    # block b meets blocks b, b + 1, ... as the left side and 0 ... b as the right one
    all_ = F.sequence(F.lit(0), F.col("blocks") - 1)
    meets = F.transform(all_, lambda o: F.struct(F.least(o, F.col("block")).alias("lo"), F.greatest(o, F.col("block")).alias("hi")))
    placed = spread.join(counted.select("label", "dim", "band", "bucket", blocks.alias("blocks")), ["label", "dim", "band", "bucket"]).withColumn("block", block)
    placed = placed.select("rep", "label", "dim", "band", "bucket", "block", F.explode(meets).alias("m")).select("*", "m.lo", "m.hi").drop("m")
    full = placed.join(coded.select("rep", "weight", "e", "factor", "keys"), "rep")
    keys = ["label", "dim", "band", "bucket", "lo", "hi"]
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    full = full.repartition(parts, *keys).sortWithinPartitions(*keys)

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for run in sorted_runs(batches, keys):
            band, lo, hi, dim = (int(run[c].iloc[0]) for c in ("band", "lo", "hi", "dim"))
            x = np.stack(run.e.to_numpy())
            unit = x / np.linalg.norm(x, axis=1, keepdims=True)
            y = unit @ rotations(dim, 1).T
            key = np.frombuffer(b"".join(run["keys"]), "<u2").reshape(len(run), -1)
            factor, rep, weight, of = run.factor.to_numpy(), run.rep.to_numpy(), run.weight.to_numpy(), run.block.to_numpy()
            left, right = (np.arange(len(run)),) * 2 if lo == hi else (np.flatnonzero(of == lo), np.flatnonzero(of == hi))
            a, b = [], []
            for at in range(0, len(left), BLOCK):
                some = left[at : at + BLOCK]
                i, j = np.nonzero(candidates(y[some], y[right], factor[some], threshold))
                i, j = some[i], right[j]
                once = i < j if lo == hi else slice(None)
                i, j = i[once], j[once]
                for k in range(0, len(i), 65_536):
                    p, q = i[k : k + 65_536], j[k : k + 65_536]
                    ok = (key[p, :band] != key[q, :band]).all(axis=1)
                    p, q = p[ok], q[ok]
                    ok = np.einsum("ij,ij->i", unit[p], unit[q]) >= threshold
                    a.append(p[ok])
                    b.append(q[ok])
            a, b = np.concatenate([*a, np.zeros(0, int)]), np.concatenate([*b, np.zeros(0, int)])
            if len(a):
                links = np.bincount(a, weight[b], len(run)) + np.bincount(b, weight[a], len(run))
                has = np.flatnonzero(links)
                edges = _forest(rep[a], rep[b])
                yield pd.DataFrame({"a": np.r_[rep[has], [x for x, _ in edges]], "b": np.r_[rep[has], [y for _, y in edges]], "links": np.r_[links[has], np.zeros(len(edges))]}).astype("int64")

    met = materialise(full.mapInPandas(meet, "a long, b long, links long"), "met")
    roots = components(met.where("a <> b")).withColumnRenamed("node", "rep")
    links = met.where("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    known = points.join(links, "rep", "left").join(roots, "rep", "left").select("label", "e", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("root", "rep").alias("root"))
    out = v.select("vec_id", F.when(F.col("fine"), F.col("label")).alias("label"), "e").join(known, ["label", "e"], "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
