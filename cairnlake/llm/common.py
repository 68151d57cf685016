"""What the operators of this folder share: table reads, the shared scratch folder, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it was counted and has at most this many (narrow) rows.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of fewer files than there are cores is dealt out to all of them."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or, only in
    local mode, a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith(("local[", "local")) or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="cairnlake-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: df written as Parquet in the shared folder and read back, so that a lost
    executor costs at most the tasks that it was running."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.held_in = path
    forget(spark)
    return out


def few_at_a_time(docs: DataFrame, rows: int = 1000) -> DataFrame:
    """docs, with texts handed to Python workers so many at a time: they may be long, and both sides hold a batch."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return docs


def forget(spark: SparkSession) -> None:
    """Lets the driver drop what it holds of queries that nothing refers to, and with them their shuffle
    files on the executors: both would else stay until memory runs short."""
    spark.sparkContext._jvm.System.gc()


def release(*tables: DataFrame) -> None:
    """Deletes tables of materialise() that nothing reads any more."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(t.held_in)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def maybe_broadcast(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Broadcasts df only if it has few rows; beyond that the join shuffles."""
    n = df.limit(BROADCAST_ROWS + 1).count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def join_copies(rows: DataFrame, values: DataFrame, key: str, copies: str, total: int) -> DataFrame:
    """rows left joined with values(key, copies, ...), a row for each key; copies is how many of the total
    rows have it. Keys with a thousandth of the rows or more, a thousand at most, are joined where
    their rows stand; only the others are shuffled."""
    hot = values.where(F.col(copies) * 1000 >= total).drop(copies)  # at most 1,000 rows
    named = [c for c in hot.columns if c != key]
    one = hot.select(key, F.struct(*named).alias("hot_"))
    told = rows.join(F.broadcast(one), key, "left")
    rest = told.where("hot_ is null").drop("hot_").join(values.where(F.col(copies) * 1000 < total).drop(copies), key, "left")
    return told.where("hot_ is not null").select(*rows.columns, *[F.col("hot_")[c].alias(c) for c in named]).unionByName(rest)


#: Edges whose components one task finds in memory; more take rounds of joins.
EDGES_IN_MEMORY = 1_000_000


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, root) of all edges(u, v), which one task reads."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = root[x]
        return x

    for batch in batches:
        for u, v in zip(batch.u.tolist(), batch.v.tolist(), strict=True):
            p, q = find(u), find(v)
            if p != q:
                root[max(p, q)] = min(p, q)
    nodes = list(root)
    for at in range(0, len(nodes), 100_000):
        some = nodes[at : at + 100_000]
        yield pd.DataFrame({"node": some, "root": [find(x) for x in some]})


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a, b), which are long: root is the smallest node that it reaches.

    Up to EDGES_IN_MEMORY edges are one task's work. Beyond, alternating large-star and small-star
    steps: every node is re-attached to the smallest node of its neighbourhood until no edge
    changes. A step is two aggregations with map-side combining and two joins that adaptive
    execution may split; the edges never grow."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e, before = materialise(e, "edges"), None
    if e.count() <= EDGES_IN_MEMORY:
        return materialise(e.coalesce(1).mapInPandas(_forest, "node long, root long"), "roots")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        last, e = e, materialise(small, "edges")
        release(last)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def sorted_runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of rows with equal keys, in the order of the input, which is sorted by keys; a run
    may span batches. Holds one run and one batch."""
    kept: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        k = batch[keys]
        new = (k.ne(k.shift())).any(axis=1).to_numpy()
        new[0] = not kept or any(kept[-1][c].iloc[-1] != batch[c].iloc[0] for c in keys)
        at = np.flatnonzero(new)
        ends = np.r_[at[at > 0], len(batch)]
        begin = 0
        for i, end in enumerate(ends):
            if new[begin] and kept:
                yield pd.concat(kept, ignore_index=True) if len(kept) > 1 else kept[0]
                kept = []
            kept.append(batch.iloc[begin:end])
            begin = end
    if kept:
        yield pd.concat(kept, ignore_index=True) if len(kept) > 1 else kept[0]
