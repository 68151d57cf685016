"""Mixing to target weights with soft membership. DataFrame functions only."""

from __future__ import annotations

import logging
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

DOMAINS = ("clean", "low", "toxic")
#: Labelled rows that the classifier is fitted on, at most.
SAMPLE = 20_000
#: Marker words of each domain in the classifier: at most so many, which stand in LEAST labelled documents, in MARKS times as many
#: of the domain as its share, and in DEVIATIONS standard deviations more; letters of a stem.
LEXICON, LEAST, MARKS, DEVIATIONS, STEM = 200, 3, 3.0, 4.0, 5
#: Shares of the domains in the mixture's tokens.
WEIGHTS = (0.90, 0.06, 0.04)
#: Where thinning by domain alone doesn't give the shares: how much smaller the mixture is, so that documents can be told apart; and steps at most.
SLACK, ROUNDS = 0.03, 48
#: Documents whose thinned rate is at least 1 / HEADROOM stay whole.
HEADROOM = 1.25
#: How near each domain comes to its target; and the share of its tokens that the last round moves, if targets can't be met.
TOLERANCE, MOVED = 2e-3, 1e-4
#: Steps between two tables of rates.
HELD = 8
log = logging.getLogger(__name__)


def domain(labels: DataFrame) -> DataFrame:
    """doc_id, domain of labels(doc_id, quality, toxic): toxic, else low quality, else clean; a label
    of null says nothing. Of several rows of a doc_id the worst counts."""
    d = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 0)
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), d.alias("k")).where("k is not null and doc_id is not null").groupBy("doc_id").agg(F.max("k").alias("k"))


def described(docs: DataFrame) -> DataFrame:
    """docs(key, text) with words (lower case, distinct, and the STEM first letters of longer ones with a mark), n_tokens (words,
    repeats included) and four classes of shape: share of distinct words, of capitals, of symbols, and length."""
    text = F.coalesce("text", F.lit(""))
    d = docs.withColumn("all_", F.array_remove(F.split(F.lower(text), r"[\s]+"), "")).withColumn("only_", F.array_distinct("all_"))
    stems = F.transform(F.filter("only_", lambda w: F.length(w) > STEM), lambda w: F.concat(F.substring(w, 1, STEM), F.lit("~")))
    d = d.withColumn("words", F.concat("only_", F.array_distinct(stems)))
    n = F.size("all_")
    size = F.length(text) + 1
    d = d.withColumn("n_tokens", n.cast("long"))
    shape = F.array(
        level(F.size("only_") / F.greatest(n, F.lit(1)), 0.3, 0.5, 0.7, 0.9), level(F.regexp_count(text, F.lit("[A-Z]")) / size, 0.01, 0.05, 0.1, 0.3),
        level(F.regexp_count(text, F.lit(r"[!%*#$&|<>{}=_~^\\]")) / size, 0.0, 0.005, 0.02, 0.06), level(n, 10, 50, 200, 1000),
    )
    return d.withColumn("shape", shape).drop("all_", "only_")


class Classifier:
    """Naive Bayes over classes: those of described(), and for each domain how large a share of a document its marker words are, none included.
    A few hundred words and numbers."""

    def __init__(self, prior: list[float], markers: list[list[str]], shapes: dict[tuple[int, int], list[float]]) -> None:
        self.prior, self.markers, self.shapes = prior, markers, shapes
        #: Tokens by domain that a mixture asked for and those it expects; set by mixed().
        self.targets: list[float] = []
        self.reached: list[float] = []

    def posteriors(self, rows: DataFrame) -> DataFrame:
        """described() rows with p: array<double> by domain. Each step is a column of its own, so that
        none is evaluated again where a later one, or a lambda, refers to it."""
        k = len(self.prior)
        rows = rows.withColumn("shape", marked(self.markers))
        for i in range(k):
            score = F.lit(self.prior[i])
            for f in sorted({f for f, _ in self.shapes}):
                c = F.lit(0.0)
                for (g, level), w in sorted(self.shapes.items()):
                    if g == f:
                        c = F.when(F.col("shape")[f] == level, float(w[i])).otherwise(c)
                score = score + c
            rows = rows.withColumn(f"s{i}_", score)
        every = [f"s{i}_" for i in range(k)]
        rows = rows.withColumn("top_", F.greatest(*every))
        for s in every:
            rows = rows.withColumn(s, F.exp(F.col(s) - F.col("top_")))
        rows = rows.withColumn("sum_", reduce(lambda a, b: a + b, map(F.col, every)))
        return rows.withColumn("p", F.array(*[F.col(s) / F.col("sum_") for s in every])).drop("top_", "sum_", *every)


def level(x: Column, *steps: float) -> Column:
    """How many of the steps x is above."""
    return reduce(lambda a, s: a + (x > s).cast("int"), steps, F.lit(0))


def marked(markers: list[list[str]]) -> Column:
    """shape with a class more for each domain: how many of its markers are among words, to a thousand tokens."""
    counts = [level(1000 * F.size(F.array_intersect("words", F.array(*map(F.lit, m)))) / F.greatest("n_tokens", F.lit(1)) if m else F.lit(0), 0, 4, 10, 25) for m in markers]
    return F.concat("shape", F.array(*counts))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    """From labelled documents(doc_id, text), of which at most `sample` are taken, by hash of doc_id.
    Counts are grouped aggregations; what comes to the driver is LEXICON words a domain and the
    counts by class of shape. Without labels every domain is alike."""
    from math import log

    k = len(DOMAINS)
    some = domain(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(some), "doc_id")  # at most `sample` narrow rows
    d = materialise(described(d).drop("text"), "labelled")
    n = {r.k: r["count"] for r in d.groupBy("k").count().collect()}
    total = [n.get(i, 0) + 1.0 for i in range(k)]
    by = [F.sum((F.col("k") == i).cast("double")).alias(f"c{i}") for i in range(k)]
    every = reduce(lambda a, b: a + b, (F.col(f"c{i}") for i in range(k)))
    counted = d.select("k", F.explode("words").alias("word")).where("length(word) >= 3 and length(word) <= 40").groupBy("word").agg(*by).where(every >= LEAST)
    counted = materialise(counted, "counted")
    markers: list[list[str]] = []
    for i in range(k):
        # by how many standard deviations more of the domain's documents have the word than is its share of all that do
        expected = every * (total[i] / sum(total))
        gain = (F.col(f"c{i}") - expected) / F.sqrt(expected)
        own = counted.where((F.col(f"c{i}") >= MARKS * expected) & (gain >= DEVIATIONS)).orderBy(F.desc(gain), "word").limit(LEXICON)
        markers.append([r.word for r in own.collect()])
    shapes: dict[tuple[int, int], list[float]] = {}
    for r in d.select("k", F.posexplode(marked(markers)).alias("f", "level")).groupBy("f", "level").agg(*by).collect():
        q = [(r[f"c{i}"] + 0.5) / (total[i] + 2.5) for i in range(k)]
        shapes[r.f, r.level] = [log(x / (sum(q) / k)) for x in q]
    return Classifier([log(x / sum(total)) for x in total], markers, shapes)


def overlaps(posterior: DataFrame, k: int) -> np.ndarray:
    """k x k: tokens that two domains share, sum of n_tokens * p_i * p_j."""
    total = posterior.agg(*[F.sum(F.col("n_tokens") * F.col("p")[i] * F.col("p")[j]) for i in range(k) for j in range(k)]).first()
    return np.array([x or 0.0 for x in total]).reshape(k, k)


def feasible(posterior: DataFrame, weights: list[float], most: float = 1.0, rounds: int = 16) -> list[float]:
    """Targets (tokens by domain) that rates in [0, most] can meet, as large as the weights allow and with their shares, or as near
    to those as soft posteriors come: what rates of min(most, HEADROOM * sum of p * q) give, where q thins each domain.
    q follows from the overlaps, then is corrected round by round as clipped rates ask for."""
    k, w = len(weights), np.array(weights, float)
    g = overlaps(posterior, k)
    if not g.sum():
        return [0.0] * k
    q = np.maximum(np.linalg.pinv(g / g.sum(), rcond=1e-9) @ w, 0.0)
    q = q / q.max() if q.max() else np.ones(k)
    got = np.zeros(k)
    for _ in range(rounds):
        rate = F.least(F.lit(float(most)), HEADROOM * most * reduce(lambda a, b: a + b, (F.col("p")[i] * float(q[i]) for i in range(k))))
        got = np.array([x or 0.0 for x in posterior.agg(*[F.sum(rate * F.col("n_tokens") * F.col("p")[i]) for i in range(k)]).first()])
        share = got / max(got.sum(), 1e-9)
        if np.all(np.abs(share - w) <= TOLERANCE * np.maximum(w, 1e-3)):
            break
        q = q * np.where(share > 0, w / np.maximum(share, 1e-12), 1.0)
        q = q / max(q.max(), 1e-12)
    return got.tolist()


def asked(posterior: DataFrame, weights: list[float], most: float = 1.0) -> list[float]:
    """Targets with just the shares that weights ask for, in as large a mixture as thinning by domain allows: where that has other
    shares, the one whose scarcest domain it holds, less SLACK. Whether rates reach them is told by rates()."""
    can = feasible(posterior, weights, most)
    total = min((x / w for x, w in zip(can, weights, strict=True) if w), default=0.0) * sum(weights)
    met = all(abs(x - w * total) <= 2 * TOLERANCE * max(w * total, 1e-9) for x, w in zip(can, weights, strict=True))
    return [w / sum(weights) * total * (1.0 if met else 1 - SLACK) for w in weights]


def rates(posterior: DataFrame, targets: list[float], most: float = 1.0, rounds: int | None = None) -> tuple[Column, list[float]]:
    """(column of rates, tokens by domain that they give) for posterior(n_tokens, p).

    Least squares of what the expected domain tokens, got = sum of rate * n_tokens * p, miss of their
    targets, over rates in [0, most], by accelerated projected gradient from rates of 1. Misses are
    weighed by the inverse of overlaps(), in which a step of 1 is the right one and rare domains count
    like others. Ends when each domain is within TOLERANCE of its target, or a step moves at most
    MOVED of each domain's tokens (targets that can't be met), or after `rounds` if given.
    A round is one aggregation to a vector by domain; a rate is a closed expression of those
    vectors, of which each table of rates holds HELD."""
    k = len(targets)
    p = [F.col("p")[i] for i in range(k)]
    g, t = overlaps(posterior, k), np.array(targets, float)
    mass, scale = g.sum(axis=1), max(g.sum(), 1.0)
    slope = np.linalg.pinv(g / scale, rcond=1e-9) / scale
    dot = lambda s: reduce(lambda a, b: a + b, (p[i] * s[i] for i in range(k)))
    clip = lambda r: F.greatest(F.lit(0.0), F.least(F.lit(float(most)), r))
    one = F.least(F.lit(1.0), F.lit(float(most)))
    begin = F.struct(one.alias("now"), one.alias("was"), one.alias("at"))
    ahead = lambda x, beta: x["now"] + beta * (x["now"] - x["was"])
    steps: list[list[float]] = []  # by domain, then how far the step began beyond the last rates

    def moved_by(x: Column, moves: list[list[float]]) -> Column:
        if not moves:
            return x
        table = F.array(*[F.array(*[F.lit(float(v)) for v in s]) for s in moves])
        return F.aggregate(table, x, lambda x, s: F.struct(clip(ahead(x, s[k]) - dot(s)).alias("now"), x["now"].alias("was"), ahead(x, s[k]).alias("at")))

    rows, beta, momentum = posterior.select("n_tokens", "p", begin.alias("x")), 0.0, 1.0
    fresh: list[list[float]] = []
    while True:
        d = rows.withColumn("x", moved_by(F.col("x"), fresh))
        if len(fresh) == HELD:
            rows, fresh = materialise(d, "rates"), []
            d = rows
        x = F.col("x")
        sums = [F.sum(v * F.col("n_tokens") * p[i]) for v in (x["now"], F.abs(x["now"] - x["at"]), ahead(x, F.lit(beta))) for i in range(k)]
        sums = [v or 0.0 for v in d.agg(*sums).first()]
        got, moved, begun = sums[:k], sums[k : 2 * k], sums[2 * k :]
        met = all(abs(x - y) <= TOLERANCE * max(y, 1e-3 * sum(got)) for x, y in zip(got, targets, strict=True))
        if len(steps) == rounds or met or (steps and all(v <= MOVED * x for v, x in zip(moved, mass, strict=True))):
            return moved_by(begin, steps)["now"], got
        steps.append([*(slope @ (np.array(begun) - t)).tolist(), beta])
        fresh.append(steps[-1])
        after = (1 + (1 + 4 * momentum * momentum) ** 0.5) / 2
        beta, momentum = (momentum - 1) / after, after


def mixed(docs: DataFrame, corpus: DataFrame, labels: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float | None = None, most: float = 1.0, sample: int = SAMPLE) -> tuple[DataFrame, Classifier, Column]:
    """(docs(key, text) as key, n_tokens, p by domain of DOMAINS and rate; the classifier, with the
    mixture's targets and the totals reached; the column rate of n_tokens and p).

    The classifier is fitted on corpus(doc_id, text) with labels. weights are the shares of the
    domains in the mixture's tokens, budget its tokens; null: as many as the shares allow with rates
    of at most `most` (asked()), so that what there is too little of stays whole and what there is
    too much of is thinned out. Null and empty texts have no token and get the rate of their posterior;
    repeated rows get the same rate."""
    model = fit(corpus, labels, sample)
    d = model.posteriors(described(docs.select("key", "text"))).select("key", "n_tokens", "p")
    d = materialise(d, "posteriors")
    model.targets = asked(d, list(weights), most) if budget is None else [w * budget for w in weights]
    column, model.reached = rates(d, model.targets, most, ROUNDS)
    for name, want, got in zip(DOMAINS, model.targets, model.reached, strict=True):
        log.info("mixture: %s has %.0f tokens, target %.0f", name, got, want)
    return d.withColumn("rate", column), model, column


def mix(docs: DataFrame, corpus: DataFrame, labels: DataFrame, **how: object) -> DataFrame:
    """documents of which floor(rate) copies stay, and one more with the probability of the rest, by
    a hash of the row's id and text that is the same in every run. Texts never cross a shuffle."""
    _, model, rate = mixed(docs.select(F.col("doc_id").alias("key"), "text"), corpus, labels, **how)
    rows = model.posteriors(described(docs.select("text", F.struct(*[docs[c] for c in docs.columns]).alias("row_"))))
    # a row is unpacked once more so that the plan doesn't write p's expressions into each use of them
    rows = rows.select("row_", F.inline(F.array(F.struct("n_tokens", "p")))).select("row_", F.round(rate, 9).alias("rate"))
    draw = (F.pmod(F.xxhash64(F.lit("mix"), "row_.doc_id", "row_.text"), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    rows = rows.withColumn("copies", F.floor("rate") + (F.col("rate") - F.floor("rate") > draw).cast("long")).where("copies > 0")
    return rows.select("row_", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row_.*")
