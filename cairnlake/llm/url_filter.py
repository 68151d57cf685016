"""URL filters: rules first, then trust and distrust that spread over the link graph of hosts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialise

#: (verdict, host, path); a fixed table of the contract.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMPING = 0.85
#: Rounds end when the ranks of both sides together move at most this much; verdicts look at 12 digits.
TOLERANCE = 1e-13
#: A host without a rule is blocked if its share of all distrust is this many times its share of trust.
RATIO = 2.0


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without one."""
    rest = F.substring(url, F.locate("://", url) + F.lit(3), F.length(url))
    return F.when(F.locate("://", url) > 0, F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    rest = F.substring(url, F.locate("://", url) + F.lit(3), F.length(url))
    return F.when(F.locate("://", url) > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def by_rules(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct<rule, verdict> of the longest rule that fits, null if none does."""
    out = F.lit(None)
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def link_edges(pages: DataFrame) -> DataFrame:
    """src, dst, n: pages(host, html) of src that link to another host, with absolute or
    scheme-relative addresses; besides, a host and the domain above it link each other once."""
    targets = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(r"(?i)\bhref\s*=\s*[\"']?(?:https?:)?//([^/\"'?#>\s]+)"), F.lit(1)), lambda x: F.translate(x, UPPER, LOWER)))
    links = pages.select(F.col("host").alias("src"), F.explode(targets).alias("dst")).where("src <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("n"))
    above = pages.select("host").where("host <> ''").distinct().select("host", F.regexp_extract("host", r"^[^.]+\.(.+\..+)$", 1).alias("up")).where("up <> ''")
    both = above.select(F.explode(F.array(F.struct(F.col("host").alias("src"), F.col("up").alias("dst")), F.struct(F.col("up").alias("src"), F.col("host").alias("dst")))).alias("e")).select("e.*", F.lit(1.0).alias("n"))
    return links.unionByName(both).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def _ranks(sent: pd.DataFrame, seed: pd.DataFrame, rounds: int | None, damping: float) -> pd.DataFrame:
    """side, host, r: the rounds of propagate over a small graph in memory."""
    every = pd.concat([sent[["side", "src"]].set_axis(["side", "host"], axis=1), sent[["side", "dst"]].set_axis(["side", "host"], axis=1), seed[["side", "host"]]])
    at = pd.MultiIndex.from_frame(every.drop_duplicates())
    src, dst = (at.get_indexer(pd.MultiIndex.from_frame(sent[["side", c]])) for c in ("src", "dst"))
    first = np.zeros(len(at))
    first[at.get_indexer(pd.MultiIndex.from_frame(seed[["side", "host"]]))] = seed["r"]
    rank, done = first, 0
    while rounds is None or done < rounds:
        was, rank = rank, np.bincount(dst, rank[src] * sent["w"].to_numpy() * damping, len(at)) + (1 - damping) * first
        done += 1
        if rounds is None and np.abs(rank - was).sum() <= TOLERANCE:
            break
    out = at.to_frame(index=False, name=["side", "host"]).assign(r=rank)
    return out[out.r > 0]


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int | None = None, damping: float = DAMPING) -> DataFrame:
    """host, trust, distrust: personalised PageRank from seeds(host, trust, distrust) along edges(src,
    dst, n) for trust, against them for distrust, in one pass a round, until all ranks together
    move at most TOLERANCE, or for `rounds` if given. Rank that would leave at a
    host without edges is left out, which only scales the result; each side then sums to 1.
    Rows by host and side; a round is a join on the sender and a sum by receiver with map-side
    combining, written to the shared folder. Up to BROADCAST_ROWS edges and seeds, counted, run in memory."""
    sent = edges.select(F.lit("trust").alias("side"), "src", "dst", "n").unionByName(edges.select(F.lit("distrust").alias("side"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    out = sent.groupBy("side", "src").agg(F.sum("n").alias("total"))
    sent = materialise(sent.join(out, ["side", "src"]).select("side", "src", "dst", (F.col("n") / F.col("total")).alias("w")), "sent")
    seed = seeds.select(F.expr("stack(2, 'trust', host, trust, 'distrust', host, distrust) as (side, host, s)")).where("s > 0")
    seed = materialise(seed.join(seed.groupBy("side").agg(F.sum("s").alias("all_")), "side").select("side", "host", (F.col("s") / F.col("all_")).alias("r")), "seeds")
    if sent.count() + seed.count() <= BROADCAST_ROWS:
        small = _ranks(sent.toPandas(), seed.toPandas(), rounds, damping)
        rank = edges.sparkSession.createDataFrame([tuple(x) for x in small.itertuples(index=False)], "side string, host string, r double")
    else:
        rank, done, moving = seed, 0, True
        while moving and (rounds is None or done < rounds):
            moved = sent.join(rank.select("side", F.col("host").alias("src"), "r"), ["side", "src"]).select("side", F.col("dst").alias("host"), (F.col("r") * F.col("w") * damping).alias("r"), F.lit(0.0).alias("was"))
            start = seed.select("side", "host", (F.col("r") * (1 - damping)).alias("r"), F.lit(0.0).alias("was"))
            was = rank.select("side", "host", F.lit(0.0).alias("r"), F.col("r").alias("was"))
            rank = materialise(moved.unionByName(start).unionByName(was).groupBy("side", "host").agg(F.sum("r").alias("r"), F.sum("was").alias("was")), "rank")
            done += 1
            moving = rounds is not None or (rank.agg(F.sum(F.abs(F.col("r") - F.col("was")))).first()[0] or 0.0) > TOLERANCE
        rank = rank.select("side", "host", "r").where("r > 0")
    share = rank.join(rank.groupBy("side").agg(F.sum("r").alias("all_")), "side").withColumn("r", F.col("r") / F.col("all_"))
    return share.groupBy("host").agg(F.sum(F.when(F.col("side") == "trust", F.col("r")).otherwise(0.0)).alias("trust"), F.sum(F.when(F.col("side") == "distrust", F.col("r")).otherwise(0.0)).alias("distrust"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, rounds: int | None = None, ratio: float = RATIO) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for each row of pages(page_id, url, html).

    The longest rule that fits decides. Hosts with pages that rules allow are seeds of trust, those
    with blocked ones of distrust, by number of pages. Any other url is blocked if its host's share
    of distrust, rounded to 12 digits, is positive and at least `ratio` times its share of trust,
    else allowed. Null urls and those without :// have an empty host and path, no rule, and are
    allowed; null markup has no links; repeated rows keep their rows and count as pages."""
    rules = RULES if rules is None else rules
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), F.coalesce(path_of(F.col("url")), F.lit("")).alias("path"), "html")
    p = p.withColumn("r", by_rules(F.col("host"), F.col("path"), rules))
    judged = materialise(p.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("verdict")), "judged")
    seeds = judged.where("verdict is not null and host <> ''").groupBy("host").agg(F.sum((F.col("verdict") == "allow").cast("double")).alias("trust"), F.sum((F.col("verdict") == "block").cast("double")).alias("distrust"))
    ranks = propagate(materialise(link_edges(p.select("host", "html")), "links"), seeds, rounds)
    out = judged.join(ranks, "host", "left").fillna(0.0, ["trust", "distrust"])
    bad = (F.round("distrust", 12) > 0) & (F.round("distrust", 12) >= ratio * F.round("trust", 12))
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(bad, "block").otherwise("allow")).alias("verdict"), "trust", "distrust")
