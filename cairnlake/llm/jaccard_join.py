"""N-gram Jaccard join: which documents share at least 75 % of their word shingles, exactly."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, few_at_a_time, join_copies, materialise, maybe_broadcast, release
from .regions import resolve
from .shingles import bitmap, shingle_set

#: Documents whose shingles are counted to tell which ones are frequent: only the order of
#: pivots, and so the speed, depends on it, never the result.
SAMPLE_DOCS = 32_000
#: A shingle in so many documents of the sample is frequent.
FREQUENT = 3


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _signatures(batches: Iterator[pd.DataFrame], frequent: np.ndarray, percent: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for doc_id, text in zip(batch.doc_id, batch.text, strict=True):
            s = shingle_set(text)
            n = len(s)
            window = n - -(-percent * n // 100) + 1 if n else 0
            if len(frequent) and n:
                at = np.searchsorted(frequent, s)
                at[at == len(frequent)] = 0
                common = frequent[at] == s
                pivots = np.concatenate([s[~common], s[common]])[:window] if common.any() else s[:window]
            else:
                pivots = s[:window]
            out.append((doc_id, n, _digest(s), pivots.view(np.int64), bitmap(s)))
        yield pd.DataFrame(out, columns=["doc_id", "n_shingles", "digest", "pivots", "bits"])


def jaccard_join(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles (size of its set), component_id (smallest
    doc_id that it reaches by links, itself included).

    Jaccard distance is a metric, and every shingle t is a point {t} of its space: a document is
    nearer than 1 to the pivot {t} only if it holds t. The pivots nearest to a document make its
    regions: of its n shingles in a fixed order (frequent ones of a bounded sample last, then by
    hash) the first n - ceil(0.75 n) + 1. Two documents at distance 0.25 or less share one of
    these at least, by the triangle inequality on the remainders: so boundary documents are
    replicated to so many regions and no more. Regions are resolved recursively with documents
    as pivots (regions.resolve), each pair decided on the whole sets. Documents with equal sets
    are one point, taken once.

    Null or blank texts: n_shingles 0, own component. Repeated doc_ids: a row each, all of the
    same component, to which their different sets belong together. Extra columns of docs
    are ignored. Null ids: a row each, n_shingles, component_id null."""
    d = few_at_a_time(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    spark = docs.sparkSession
    sample = d.select("doc_id").orderBy(F.xxhash64("doc_id")).limit(SAMPLE_DOCS)

    def sampled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                held = np.concatenate([shingle_set(x) for x in batch.text.iloc[at : at + 256]])
                yield pd.DataFrame({"t": held.view(np.int64)})

    texts = d.join(F.broadcast(sample), "doc_id", "left_semi").select("text")  # at most SAMPLE_DOCS ids
    counted = texts.mapInPandas(sampled, "t long").groupBy("t").count().where(f"count >= {FREQUENT}").select("t")
    frequent = np.sort(counted.toArrow()["t"].to_numpy().astype(np.int64).view(np.uint64))
    held = spark.sparkContext.broadcast(frequent)
    signed = d.mapInPandas(lambda batches: _signatures(batches, held.value, percent), "doc_id long, n_shingles long, digest binary, pivots array<long>, bits binary")
    signed = materialise(signed, "signed")
    # a point for each distinct set, numbered by its own; doc_id and digest say where its text stands
    points = signed.where("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    points = materialise(points.withColumn("item", F.monotonically_increasing_id()), "points")
    again = signed.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c"), F.min("digest").alias("x"), F.max("digest").alias("y")).where("c > 1")
    again = materialise(again, "again")
    reps = signed.select("digest", "doc_id", "n_shingles", "pivots", "bits").join(points.select("digest", "doc_id", "item"), ["digest", "doc_id"])
    reps = materialise(reps if again.isEmpty() else reps.dropDuplicates(["item"]), "reps")
    rows = materialise(signed.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")), "rows")
    release(signed)
    before = F.concat(F.array(F.lit(None).cast("long")), F.slice("pivots", 1, F.greatest(F.size("pivots") - 1, F.lit(0))))
    members = reps.select(F.posexplode(F.arrays_zip(F.col("pivots").alias("region"), before.alias("prev"))).alias("pos", "at"), "item", F.col("n_shingles").alias("n"))
    members = members.select("at.region", "item", "n", "pos", "at.prev")
    items = reps.select("item", F.col("n_shingles").alias("n"), "bits")
    # texts of ids that stand on several rows are told apart by their sets
    several = again.where("x <> y").select("doc_id")
    many = not several.isEmpty()

    def fetch(need: DataFrame) -> DataFrame:
        need = need.join(points.select(F.col("item").alias("id"), "doc_id", "digest"), "id")
        if not many:
            return d.join(maybe_broadcast(need.drop("digest")), "doc_id")
        found = d.join(maybe_broadcast(materialise(need, "wanted")), "doc_id")
        return found.mapInPandas(_own_text, found.schema)

    roots = resolve(members, items, fetch, percent)
    if many:  # a doc_id is a node of the graph, so that it ties its sets together
        own = rows.where("digest is not null").join(maybe_broadcast(several), "doc_id", "left_semi").select("doc_id", "digest").distinct().join(points.select("digest", "item"), "digest")
        tied = own.join(own.groupBy("doc_id").agg(F.min("item").alias("b")), "doc_id").select(F.col("item").alias("a"), "b")
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(tied))
    named = points.join(roots.withColumnRenamed("node", "item"), "item", "left").withColumn("root", F.coalesce("root", "item"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = materialise(named.join(least, "root").select("digest", "copies", "component_id"), "named")
    total = named.agg(F.sum("copies")).first()[0] or 0
    return join_copies(rows, named, "digest", "copies", total).select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _own_text(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        same = [_digest(shingle_set(x)) == y for x, y in zip(batch.text, batch.digest, strict=True)]
        yield batch[np.array(same, bool)]


def keep_one(docs: DataFrame, percent: int = 75) -> DataFrame:
    """documents with one of each group of linked ones: that of the smallest doc_id; of rows with
    the same doc_id one. Texts without words and null ids all stay."""
    found = materialise(jaccard_join(docs, percent), "joined")
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    out = docs.join(maybe_broadcast(gone), "doc_id", "left_anti").select(docs.columns)
    again = found.where("doc_id is not null and n_shingles > 0").groupBy("doc_id").count().where("count > 1").select("doc_id")
    again = materialise(again, "again")
    if again.isEmpty():
        return out
    again = maybe_broadcast(again)
    return out.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(out.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns))
