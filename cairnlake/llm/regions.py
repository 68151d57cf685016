"""Exact resolution of regions: which items of a region, checked in full, are linked."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, materialise, release, sorted_runs
from .shingles import fold, shingle_set, similar

#: Items checked against one copy of a pivot's text in one task.
PER_GROUP = 128
#: Pivots for each region in the second round, and how many times as many in each later one.
PIVOTS, GROWTH = 2, 6
#: Items of one region that one task holds beside the region's pivots.
PER_TASK = 1024


def may_link(n: int, x: int, size_x: int, m: int, y: int, size_y: int, percent: int) -> bool:
    """Whether bitmaps x and y, of so many bits, leave it open that sets of n and m elements link.

    A bit that a has and b hasn't stands for an element at least that b lacks, so the
    intersection is at most n_a less the number of such bits, and likewise for b."""
    k = min(size_x, size_y)
    x, y = fold(x, size_x, k), fold(y, size_y, k)
    most = min(n - (x & ~y).bit_count(), m - (y & ~x).bit_count())
    return 100 * most >= percent * (n + m - most)


def screened(pairs: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """pairs(a, b) without those whose bitmaps alone show that they can't link; items(item, n, bits)."""
    side = lambda x: items.select(F.col("item").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b")

    def screen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            for i, (n, m, x, y) in enumerate(zip(batch.n_a, batch.n_b, batch.bits_a, batch.bits_b, strict=True)):
                keep[i] = may_link(n, int.from_bytes(x, "little"), 8 * len(x), m, int.from_bytes(y, "little"), 8 * len(y), percent)
            yield batch.loc[keep, ["a", "b"]]

    return rows.mapInPandas(screen, "a long, b long")


def met(live: DataFrame, most: int, items: DataFrame, percent: int) -> DataFrame:
    """The pairs(a, b) of an item and one of the first `most` items of a region of live(region, item, n, pos, prev,
    root) that sizes, positions and bitmaps leave open; a is the larger one, roots differ.

    A region's items are dealt into groups of about PER_TASK, each with a copy of the region's pivots, and
    compared where they lie: what is no candidate never becomes a row."""
    spark = live.sparkSession
    w = Window.partitionBy("region").orderBy("n", "item", "pos")
    groups = live.groupBy("region").agg(F.ceil(F.count("*") / PER_TASK).cast("int").alias("groups"))
    pivots = live.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= most).drop("rk")
    row = ["region", "item", "n", "pos", "prev", "root"]
    rows = live.join(groups, "region").select(*row, F.pmod(F.xxhash64("item"), "groups").cast("int").alias("part"), F.lit(False).alias("pivot"))
    rows = rows.unionByName(pivots.join(groups, "region").select(*row, F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), F.lit(True).alias("pivot")))
    rows = rows.withColumn("first", F.col("prev").isNull()).withColumn("prev", F.coalesce("prev", F.lit(0).cast("long"))).join(items.select("item", "bits"), "item")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "region", "part").sortWithinPartitions("region", "part")

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for run in sorted_runs(batches, ["region", "part"]):
            item, size, pos, prev, root, none, pivot = (run[c].to_numpy() for c in ("item", "n", "pos", "prev", "root", "first", "pivot"))
            bits = [(int.from_bytes(x, "little"), 8 * len(x)) for x in run.bits]
            j = np.flatnonzero(~pivot)
            out = []
            for p in np.flatnonzero(pivot):
                larger = (size[j] > size[p]) | (size[j] == size[p]) & (item[j] > item[p])
                fits = np.minimum(size[j] - pos[j], size[p] - pos[p]) * (100 + percent) >= percent * (size[j] + size[p])
                before = (prev[j] == prev[p]) & ~none[j] & ~none[p]  # they meet in an earlier region
                for i in j[(root[j] != root[p]) & larger & fits & ~before]:
                    if may_link(int(size[i]), *bits[i], int(size[p]), *bits[p], percent):
                        out.append((item[i], item[p]))
            if out:
                yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return rows.mapInPandas(meet, "a long, b long").distinct()


def checked(pairs: DataFrame, items: DataFrame, fetch: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """verified() pairs after a screening by bitmaps."""
    return verified(screened(pairs, items, percent), fetch, percent)


def verified(pairs: DataFrame, fetch: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """The pairs(a, b) whose texts have a Jaccard similarity of percent/100 at least, on word
    shingles. fetch(need) adds the column text (binary) to need(id, ...).

    b is a pivot with any number of partners: its partners are dealt into groups of about
    PER_GROUP, each with a copy of b's text, so that no task gathers all of them."""
    spark = pairs.sparkSession
    pairs = materialise(pairs, "screened")
    if pairs.isEmpty():
        return pairs
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / PER_GROUP).cast("int").alias("n"))
    need = pairs.join(parts, "b").select(F.col("a").alias("id"), "b", F.pmod(F.xxhash64("a"), "n").cast("int").alias("part"), F.lit(False).alias("pivot"))
    need = need.unionByName(parts.select(F.col("b").alias("id"), "b", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part"), F.lit(True).alias("pivot")))
    need = materialise(need, "need")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = fetch(need).select("b", "part", "pivot", "id", "text").repartition(n, "b", "part").sortWithinPartitions("b", "part", F.desc("pivot"))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, None
        for batch in batches:
            out = []
            for b, part, pivot, item, text in zip(*(batch[c] for c in ("b", "part", "pivot", "id", "text")), strict=True):
                if pivot:
                    at, held = (b, part), shingle_set(text)
                elif at == (b, part) and similar(shingle_set(text), held, percent):
                    out.append((item, b))
            yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    links = materialise(rows.mapInPandas(check, "a long, b long"), "links")
    release(pairs, need)
    return links


def distinct_regions(rows: DataFrame) -> DataFrame:
    """region of rows(region, item, pos, root): one of all regions that hold the same items, of two roots or more.

    Equal items are told by their count and 128 bits of hashes. Items that share several regions
    all pass them in the same order, so the one where they stand first stands for the others: what
    follows there is most, and no pair is lost."""
    one = rows.groupBy("region").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("pos").alias("pos"), F.count("*").alias("size"), F.bit_xor(F.xxhash64("item")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(1), "item")).alias("h2"))
    return one.where("lo <> hi").groupBy("size", "h1", "h2").agg(F.min(F.struct("pos", "region"))["region"].alias("region")).select("region")


def resolve(members: DataFrame, items: DataFrame, fetch: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """(node, root): all rounds of settled()."""
    return settled(members, items, fetch, percent)[0]


def settled(members: DataFrame, items: DataFrame, fetch: Callable[[DataFrame], DataFrame], percent: int, rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(node, root) of the graph of all linked pairs that share a region; members(region, item, n,
    pos, prev), items(item, n, bits): n the size of the item's set, bits its bitmap, pos how many elements
    of the set precede this region's in an order that all items share (0 if there is none), prev the
    item's region just before this one in that order (null if there is none). Items without a link are left out.

    Two items with the same prev share that region too, and so on back to the first region that
    they share, where prev differs: a pair is taken up there and skipped where prev is the same.

    Round 1 checks each item of a region against the region's pivot (its smallest item) alone.
    Items that are then in one component need no more checks: what is left are regions with
    items of two components or more. There, further rounds take new pivots, GROWTH times as many
    in each round, contract again, and drop the pivots, of which every pair is decided. A region
    ends when one component or one item is left, and of regions with the same items one is kept: no pair is skipped but those of which sizes
    and positions show that they don't link or meet in an earlier region, and those already
    connected. A round's rows are bounded by its number of
    pivots per row of its input, so that the few large regions left last don't hold up the rest.

    The second result are the rows of regions that are open after so many rounds; none if rounds
    is null."""
    w = Window.partitionBy("region").orderBy("n", "item", "pos")
    first = F.first(F.struct("item", "n", "pos", "prev")).over(w)
    m = members.select("region", "item", "n", "pos", "prev", first.alias("f"), F.lead("item").over(w).alias("next"))
    m = m.select("region", "item", "n", "pos", "prev", F.col("f.item").alias("p"), F.col("f.n").alias("pn"), F.col("f.pos").alias("ppos"), F.col("f.prev").alias("pprev"), "next")
    # in the first region that two linked items share, what follows in either set must suffice
    fits = f"least(n - pos, pn - ppos) * {100 + percent} >= {percent} * (n + pn) and not coalesce(prev = pprev, false)"
    live = materialise(m.where("p <> item or next is not null"), "live")
    pairs = live.where(f"p <> item and {fits}").select(F.col("item").alias("a"), F.col("p").alias("b")).distinct()
    roots = components(checked(pairs, items, fetch, percent))
    old, live, most = live, live.where("p <> item").select("region", "item", "n", "pos", "prev"), PIVOTS
    done = 0
    while True:
        labelled = live.join(roots.withColumnRenamed("node", "item"), "item", "left").select("region", "item", "n", "pos", "prev", F.coalesce("root", "item").alias("root"))
        open_ = distinct_regions(labelled)
        live = materialise(labelled.join(open_, "region", "left_semi"), "live")
        release(old)
        done += 1
        if done == rounds or live.isEmpty():
            return roots, live
        links = verified(met(live, most, items, percent), fetch, percent)
        if not links.isEmpty():
            ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(roots, "node", "left_anti").select("node", F.col("node").alias("root"))
            known = roots.unionByName(ends)
            side = lambda x, y: known.select(F.col("node").alias(x), F.col("root").alias(y))  # noqa: B023, E731
            up = components(links.join(side("a", "u"), "a").join(side("b", "v"), "b").select(F.col("u").alias("a"), F.col("v").alias("b")).distinct())
            roots = materialise(known.join(up.select(F.col("node").alias("root"), F.col("root").alias("up")), "root", "left").select("node", F.coalesce("up", "root").alias("root")), "roots")
        ranked = live.select("region", "item", "n", "pos", "prev", F.row_number().over(w).alias("rk"))
        old, live = live, ranked.where(F.col("rk") > most).drop("rk")
        most *= GROWTH
