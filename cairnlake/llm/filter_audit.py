"""How filters interact: what each removes, alone, before and after the others, in every order."""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_copies, materialise

#: The filters by letter, in the order of their bits; a document fails A with fewer words than MIN_WORDS, B with a smaller share (in
#: hundredths) of distinct words than DISTINCT, C with a larger one of capitals than CAPITALS, D with one of SYMBOLS, E as a copy.
FILTERS, MIN_WORDS, DISTINCT, CAPITALS, SYMBOLS = "ABCDE", 100, 80, 10, "[#$%&*|]"
SPACE = "[\\x20\\x09-\\x0D]"


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, key (tells rows of one doc_id apart), part, text. Rows equal in all of these are one with several copies."""
    text, part = F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("part")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, part).withColumn("key", F.xxhash64("text", "part", F.col("doc_id").isNull()))


def word_counts(docs: DataFrame) -> DataFrame:
    """id_, key, words, distinct_words of the documents with words: words exploded, counted by (document, word), then by document.
    Texts are dealt out by document once; both aggregations keep that partitioning."""
    d = _keyed(docs).select(F.coalesce("doc_id", F.lit(-1)).alias("id_"), "key", "text").repartition("id_", "key")
    w = d.select("id_", "key", F.explode(F.split("text", SPACE)).alias("word")).where("word <> ''")
    return w.groupBy("id_", "key", "word").agg(F.count("*").alias("n")).groupBy("id_", "key").agg(F.sum("n").alias("words"), F.count("*").alias("distinct_words"))


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, part, copies, mask (bits of the filters that the document fails, A the lowest), good, toxic: a row for each
    different (doc_id, text, lang), copies of which stand in docs.

    Columns of docs(doc_id, text, lang) and labels(doc_id, quality, toxic); others are left out, whatever their names. A null text is
    empty, a null lang the part ''. E compares whole texts by SHA-256 over all rows; a row without a doc_id is no one's
    earlier copy and has none. Of several labels of a doc_id each counts that says 1."""
    caps = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    flags = _keyed(docs).select(
        "doc_id", "key", "part", F.unhex(F.sha2("text", 256)).alias("hash"), (100 * caps > CAPITALS * F.length("text")).alias("c"), F.col("text").rlike(SYMBOLS).alias("d"),
    )
    one = [F.first(x).alias(x) for x in ("hash", "c", "d")]
    flags = materialise(flags.groupBy("doc_id", "key", "part").agg(F.count("*").alias("copies"), *one), "flags")
    texts = flags.groupBy("hash").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("rows_"))
    flags = join_copies(flags, texts, "hash", "rows_", flags.count())
    label = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias({"quality": "good"}.get(c, c))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where("doc_id is not null").groupBy("doc_id").agg(label("quality"), label("toxic"))
    flags = flags.join(known, "doc_id", "left").withColumn("id_", F.coalesce("doc_id", F.lit(-1)))
    # documents without words have no row in word_counts(), and those have no flags
    both = flags.join(word_counts(docs), ["id_", "key"], "full").where("part is not null")
    words, distinct = (F.coalesce(F.floor(F.col("words") / F.col("copies")), F.lit(0)), F.coalesce("distinct_words", F.lit(0)))
    fails = [words < MIN_WORDS, 100 * distinct < DISTINCT * words, F.col("c"), F.col("d"), F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))]
    mask = reduce(lambda a, b: a + b, (F.when(x, 1 << i).otherwise(0) for i, x in enumerate(fails)))
    return both.select("doc_id", "part", "copies", mask.alias("mask"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def patterns(failed: DataFrame, filters: int = len(FILTERS)) -> DataFrame:
    """part, and arrays n, good, toxic: for each of the 2 ** filters patterns of failures how many documents have just that one. One
    aggregation of that many conditional counts, of which only sums by part are shuffled."""
    kinds = {"n": F.col("copies"), "good": F.col("copies") * F.col("good"), "toxic": F.col("copies") * F.col("toxic")}
    cells = [F.sum(F.when(F.col("mask") == m, v).otherwise(0)).cast("long").alias(f"{k}_{m}") for k, v in kinds.items() for m in range(1 << filters)]
    return failed.groupBy("part").agg(*cells).select("part", *[F.array(*[f"{k}_{m}" for m in range(1 << filters)]).alias(k) for k in kinds])


def orders(filters: str = FILTERS) -> list[tuple[str, int, int, int]]:
    """(order, step, bits of the filters before the step, bit of its own) for every order."""
    bit = {f: 1 << i for i, f in enumerate(filters)}
    return [("".join(o), k + 1, sum(bit[f] for f in o[:k]), bit[o[k]]) for o in permutations(filters) for k in range(len(o))]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: a row for each part, order of the
    filters and step, zeros included.

    Everything follows from the patterns of failures, so that documents are read once for all orders. Null, empty and very long texts,
    equal rows and clashing names are as in failures(); ties don't arise; an empty table has no part and no row."""
    p = materialise(patterns(failures(docs, labels)), "patterns")  # a row for each part
    steps = p.sparkSession.createDataFrame(orders(), "filter_order string, step int, before int, own int")
    x = p.crossJoin(F.broadcast(steps))  # five steps of each of the 120 orders
    every = [F.lit(m) for m in range(1 << len(FILTERS))]
    has = lambda m, bits: m.bitwiseAND(F.col(bits)) != 0

    def total(kind: str, condition) -> Column:
        return F.aggregate(F.array(*every), F.lit(0).cast("long"), lambda a, m: a + F.when(condition(m), F.col(kind)[m]).otherwise(0))

    gone = lambda m: has(m, "own") & ~has(m, "before")
    # of the documents that fail k filters, each of those removes them in one of k orders
    share = lambda m: F.floor(F.lit(factorial(len(FILTERS))) / F.greatest(F.bit_count(m), F.lit(1)))
    shapley = F.aggregate(F.array(*every), F.lit(0).cast("long"), lambda a, m: a + F.when(has(m, "own"), F.col("n")[m] * share(m)).otherwise(0))
    return x.select(
        "part", "filter_order", "step", total("n", lambda m: ~has(m, "own") & ~has(m, "before")).alias("kept"), total("n", gone).alias("removed"), total("n", lambda m: has(m, "own") & has(m, "before")).alias("redundant"),
        total("n", lambda m: m == F.col("own")).alias("unique_fails"), total("good", gone).alias("good_lost"), total("toxic", gone).alias("toxic_lost"), shapley.alias("shapley"),
    )
