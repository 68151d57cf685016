"""Resharding with the fewest bytes moved: a minimum-cost flow from old shards to new ones, cut into blocks of rows."""

from __future__ import annotations

import heapq
import uuid
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from .common import materialise

#: Rows of a block, about; kinds of group hashes in each class of sizes of a shard, from which blocks are made; blocks of a file.
BLOCK_ROWS, GROUPS, FILE_BLOCKS = 512, 16, 256


def transfers(sizes: list[int], capacities: list[int], cost: np.ndarray | None = None) -> np.ndarray:
    """Bytes from each old shard (rows) to each new one: all of sizes, at most capacities, at the smallest total of cost * bytes.
    cost: null: nothing where a shard keeps its number, else 1 a byte, so that the fewest bytes move. Successive shortest paths
    with potentials over old and new shards; ties go to lower numbers. Too little capacity raises ValueError."""
    n, m = len(sizes), len(capacities)
    if sum(sizes) > sum(capacities):
        raise ValueError(f"{sum(sizes)} bytes don't fit into {sum(capacities)}")
    if cost is None:
        cost = 1 - np.eye(n, m)
    flow, left, room = np.zeros((n, m), dtype=object), list(map(int, sizes)), list(map(int, capacities))
    high = np.zeros(n + m)
    while any(left):
        # nodes 0 to n - 1 are old shards, from n on new ones; back edges undo flow
        far, via, done = np.full(n + m, np.inf), [-1] * (n + m), set()
        heap = [(0.0, i) for i in range(n) if left[i]]
        for _, i in heap:
            far[i] = 0.0
        heapq.heapify(heap)
        while heap:
            d, u = heapq.heappop(heap)
            if u in done:
                continue
            done.add(u)
            after = ((n + j, cost[u, j]) for j in range(m)) if u < n else ((i, -cost[i, u - n]) for i in range(n) if flow[i, u - n])
            for v, c in after:
                now = d + max(c + high[u] - high[v], 0.0)
                if now < far[v] - 1e-12:
                    far[v], via[v] = now, u
                    heapq.heappush(heap, (now, v))
        end = min((j for j in range(m) if room[j]), key=lambda j: (far[n + j] + high[n + j], j))
        path = [n + end]
        while via[path[-1]] >= 0:
            path.append(via[path[-1]])
        path.reverse()
        high += np.minimum(far, far[n + end])
        undone = [(v, u - n) for u, v in zip(path, path[1:], strict=False) if u >= n]
        most = min([left[path[0]], room[end], *(flow[i, j] for i, j in undone)])
        for u, v in zip(path, path[1:], strict=False):
            if u < n:
                flow[u, v - n] += most
            else:
                flow[v, u - n] -= most
        left[path[0]] -= most
        room[end] -= most
    return flow.astype(np.int64) if flow.size else np.zeros((n, m), np.int64)


def even(total: int, shards: int) -> list[int]:
    """Capacities that differ by one byte at most and hold just the total."""
    return [total * (k + 1) // shards - total * k // shards for k in range(shards)]


def reshard(rows: DataFrame, old: Column, size: Column, group: Column, capacities: list[int] | int, rounds: int = 2) -> DataFrame:
    """rows with old_shard int (as old says), shard int, block long (rows that were placed together) and slot long (place in the
    new shard, gapless from 0).

    capacities: bytes of each new shard, or their number: then all alike. In a shard rows stand in an order of size, largest
    first, then by hash of group; what stays comes first, so that small rows move and cuts fall between small rows. Each flow of
    transfers() is a stretch of that order, and a row goes where its middle lies. What rows as wholes miss of the flows, a round
    from the new shards to the same capacities sets right with the smallest rows. Rows of one group are neighbours and go apart
    only where a stretch ends: a group may hold a third of all bytes, so that it can't be kept whole.

    Only sums by shard, size and GROUPS come to the driver. Each round shuffles rows once, by block (BLOCK_ROWS rows, about,
    whatever the sizes of groups; rows equal in all columns share one). Any column of rows may be null; sizes are at least 1; ties
    go by hashes, equal rows may change places with each other; an empty table stays empty. rows' own columns of these names are
    replaced. Rows without an old shard count as in shard 0."""
    keep = [c for c in rows.columns if c.lower() not in ("old_shard", "shard", "block", "slot")]
    began = F.coalesce(old.cast("int"), F.lit(0))
    inner = rows.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row_"), began.alias("began_"), began.alias("at_"), F.greatest(size.cast("long"), F.lit(1)).alias("size_"), F.xxhash64(group).alias("hash_"))
    for k in range(rounds):
        placed = _placed(inner, capacities)
        inner = placed.withColumn("at_", F.col("shard")).drop("shard", "block", "rank_")
    # in a block the rows of one shard are a stretch, so that a place is the rows of earlier blocks and the rank in the stretch
    counts = placed.groupBy("shard", "at_", "block").agg(F.count("*").alias("n_"), F.min("rank_").alias("least_"))
    earlier = Window.partitionBy("shard").orderBy("at_", "block").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each block, not for each document
    offsets = counts.select("shard", "at_", "block", (F.coalesce(F.sum("n_").over(earlier), F.lit(0)) - F.col("least_")).alias("offset_"))
    out = placed.join(offsets, ["shard", "at_", "block"])
    return out.select("row_.*", F.col("began_").alias("old_shard"), "shard", "block", (F.col("offset_") + F.col("rank_")).alias("slot"))


def _placed(inner: DataFrame, capacities: list[int] | int) -> DataFrame:
    """inner(row_, began_, at_, size_, hash_) with block, rank_ (place in the block) and the shard to which transfers() from the shards at_ bring it."""
    spark = inner.sparkSession
    # class: leading zeros of the size, so that larger rows come first; then the group's hash
    x = inner.withColumn("class_", (F.lit(64) - F.length(F.bin("size_"))).cast("int")).withColumn("part_", F.pmod("hash_", F.lit(GROUPS)).cast("int"))
    sums = x.groupBy("at_", "class_", "part_").agg(F.sum("size_").alias("bytes_"), F.count("*").alias("n_")).toPandas()  # 64 * GROUPS rows a shard at most
    sums = sums.sort_values(["at_", "class_", "part_"], ignore_index=True)
    olds = sorted(int(i) for i in sums.at_.unique())
    sizes = [int(sums.bytes_[sums.at_ == i].sum()) for i in range(olds[-1] + 1)] if olds else []
    held = even(sum(sizes), capacities) if isinstance(capacities, int) else list(capacities)
    flow, cuts = transfers(sizes, held), []
    for i in olds:  # what stays comes first, then the others by number
        to = [j for j in ([i] if i < len(held) else []) + [j for j in range(len(held)) if j != i] if flow[i, j]]
        cuts.append((i, to, np.cumsum([flow[i, j] for j in to]).tolist()))
    # blocks of a group: by a hash of the whole row, as many as its rows need
    sums["blocks_"] = np.maximum(1, -(-sums.n_ // BLOCK_ROWS)).astype(np.int64)
    sums["first_"] = sums.groupby("at_").blocks_.cumsum() - sums.blocks_
    groups = spark.createDataFrame(sums[["at_", "class_", "part_", "blocks_", "first_"]].astype("int64"), "at_ int, class_ int, part_ int, blocks_ long, first_ long")
    spread = F.pmod(F.xxhash64("hash_", F.hash("row_")), F.lit(1 << 30))
    x = x.join(F.broadcast(groups), ["at_", "class_", "part_"]).withColumn("block", F.col("first_") + F.shiftright(spread * F.col("blocks_"), 30)).drop("class_", "part_", "blocks_", "first_")
    before = Window.partitionBy("at_").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each block, not for each document
    starts = x.groupBy("at_", "block").agg(F.sum("size_").alias("bytes_")).select("at_", "block", F.coalesce(F.sum("bytes_").over(before), F.lit(0)).alias("start_"))
    inside = Window.partitionBy("at_", "block").orderBy(F.desc("size_"), "hash_", F.hash("row_"))
    x = x.withColumn("upto_", F.sum("size_").over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn("rank_", F.row_number().over(inside)).join(starts, ["at_", "block"])
    ends = spark.createDataFrame(cuts, "at_ int, to_ array<int>, ends_ array<long>")  # at most as many numbers as pairs of shards
    middle = F.col("start_") + F.col("upto_") - F.col("size_") / 2
    x = x.join(F.broadcast(ends), "at_").withColumn("middle_", middle)
    passed = F.size(F.filter("ends_", lambda e: e <= F.col("middle_")))
    x = x.withColumn("shard", F.col("to_")[F.least(passed, F.size("to_") - 1)])
    return materialise(x.select(*inner.columns, "shard", "block", "rank_"), "placed")


def _write(assigned: DataFrame, root: str, version: int) -> list[tuple[int, str, str]]:
    """Writes rows with old_shard, shard and block as files by shard and stretch of blocks; (shard, file, path) of each."""
    name = f"data-{version}-{uuid.uuid4().hex[:8]}"
    file = F.concat_ws("-", F.lit(version), "old_shard", F.floor(F.col("block") / FILE_BLOCKS).cast("string"))
    rows = materialise(assigned.withColumn("file", file).drop("old_shard", "block", "slot"), "files")
    # large files are dealt to as many tasks as the rows need, so that no file is one task's work
    rows.repartition("shard", "file", F.pmod(F.xxhash64(*[c for c in rows.columns if c not in ("shard", "file")]), F.lit(4))).write.partitionBy("shard", "file").parquet(f"{root}/{name}")
    return [(r.shard, r.file, f"{name}/shard={r.shard}/file={r.file}") for r in rows.select("shard", "file").distinct().collect()]


def _manifest(spark: SparkSession, root: str, version: int, files: list[tuple[int, str, str]]) -> None:
    spark.createDataFrame(files, "shard int, file string, path string").coalesce(1).write.parquet(f"{root}/manifest-{version}")


def store(assigned: DataFrame, root: str) -> None:
    """Writes reshard()ed rows as version 0: files below root and their manifest."""
    _manifest(assigned.sparkSession, root, 0, _write(assigned, root, 0))


def stored(spark: SparkSession, root: str, version: int) -> DataFrame:
    """The rows of a stored version, with shard and file."""
    names = [r.path for r in spark.read.parquet(f"{root}/manifest-{version}").collect()]  # the version's list of files
    of = lambda d: spark.read.schema(_schema(spark, f"{root}/{d}")).option("basePath", f"{root}/{d}").parquet(*[f"{root}/{x}" for x in names if x.startswith(f"{d}/")])
    return reduce(lambda a, b: a.unionByName(b), map(of, sorted({x.split("/")[0] for x in names})))


def _schema(spark: SparkSession, path: str) -> StructType:
    own = StructType([f for f in spark.read.parquet(path).schema if f.name not in ("shard", "file")])
    return own.add("shard", IntegerType()).add("file", StringType())


def rewrite(root: str, version: int, moved: DataFrame) -> tuple[int, int]:
    """(files kept, files written) of the next stored version: moved is stored() rows after reshard() with their shard as the
    old one. Files of which every row stays in its shard are kept; the rows of all others are written anew. Nothing is
    overwritten: a version is its manifest, and readers of the old one go on."""
    spark = moved.sparkSession
    leaves = moved.groupBy("old_shard", "file").agg(F.max((F.col("shard") != F.col("old_shard")).cast("int")).alias("leaves"))
    leaves = materialise(leaves, "leaves")  # a row for each file
    kept = leaves.where("leaves = 0").select(F.col("old_shard").alias("shard"), "file")
    same = spark.read.parquet(f"{root}/manifest-{version}").join(kept, ["shard", "file"], "left_semi").collect()
    new = _write(moved.join(leaves.where("leaves = 1").drop("leaves"), ["old_shard", "file"], "left_semi"), root, version + 1)
    _manifest(spark, root, version + 1, [(r.shard, r.file, r.path) for r in same] + new)
    return len(same), len(new)
