"""The search index as a stored table: postings by bucket of terms, changed by segments and merged bucket by bucket."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.policy import rounded
from ..sources.versions import Versions
from .retrieval import B, IDF_FLOOR, K1, condition, leaves, named, parsed

#: Buckets of terms, and of ids; and files, at least, in which a bucket's rows are written, so that frequent terms are several tasks' work.
BUCKETS, SPLITS = 64, 4
#: Tokens of a task that sorts postings: few enough to be sorted in memory.
TASK = 500_000


def _bucket(x: str, n: int) -> Column:
    return F.pmod(F.xxhash64(x), F.lit(n)).cast("int")


def tokens(columns: list[str]) -> Column:
    """Index tokens of several columns, with a null between columns, over which no phrase goes."""
    parts = [text.index_tokens(F.coalesce(F.col(c), F.lit(""))) for c in columns]
    gap = F.array(F.lit(None).cast("string"))
    return reduce(lambda a, b: F.concat(a, gap, b), parts)


def places(tokens: Column) -> Column:
    """term, at (its places) of a row's tokens, gathered where the row is."""
    told = F.filter(F.transform(tokens, lambda x, i: F.struct(x.alias("term"), i.alias("at"))), lambda x: x["term"].isNotNull())
    starts = lambda s: F.filter(F.transform(s, lambda x, i: i), lambda i: (i == 0) | (F.get(s, i)["term"] != F.get(s, i - 1)["term"]))
    at = lambda s, r, i, k: F.transform(F.slice(s, i + 1, F.coalesce(F.get(r, k + 1), F.size(s)) - i), lambda y: y["at"])
    return named(F.sort_array(told), lambda s: named(starts(s), lambda r: F.transform(r, lambda i, k: F.struct(F.get(s, i)["term"].alias("term"), at(s, r, i, k).alias("at")))))


class Index:
    """A stored index below a folder that all executors share.

    Tables: postings(term, id, section, size, at: the term's places) by bucket of term; terms(term, df) by the same buckets; rows(id, section, size,
    terms) by bucket of id, from which a change knows what it takes away; tombs(id) of each segment, which end the rows that an id has in
    segments before. The manifest has the number of rows and of tokens. Rows are those of passages or sections: any columns of
    text beside id and section, all of which count alike."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        self.files, self.spark = Versions(spark, root), spark
        self.held = self.files.state()
        self.buckets = self.held["numbers"].get("buckets", buckets)

    # -- writing

    def _written(self, rows: DataFrame) -> tuple[dict, int, int]:
        """(files by table, rows, tokens) of a segment of rows."""
        named = [c for c in rows.columns if c not in ("id", "section")]
        t = rows.select("id", "section", tokens(named).alias("tokens")).withColumn("size", F.size("tokens") - (len(named) - 1))
        forward = t.select("id", "section", "size", F.array_compact(F.array_distinct("tokens")).alias("terms"), _bucket("id", self.buckets).alias("bucket"))
        found = {"rows": self.files.write(forward.repartition("bucket"), "bucket")}
        held = self._rows(found["rows"])
        n, total = held.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        # a posting moves once, with its places, to one of so many tasks that each sorts its share in memory
        splits = max(SPLITS, -(-total // (TASK * self.buckets)))
        p = t.select("id", "section", "size", F.explode(places(F.col("tokens"))).alias("p")).select("p.term", "id", "section", "size", "p.at", _bucket("p.term", self.buckets).alias("bucket"))
        p = p.repartition(max(1, min(self.buckets * splits, -(-total // TASK))), "bucket", _bucket("id", splits))
        found["postings"] = self.files.write(p.select("bucket", "term", "id", "section", "size", "at").sortWithinPartitions("bucket", "term", "id"), "bucket")
        return found, n, total

    def _rows(self, files: tuple[dict, dict[str, str]]) -> DataFrame:
        schema, folders = files
        return self.files.read({"tables": {"x": {"schema": schema, "files": {k: [[0, v]] for k, v in folders.items()}}}}, "x").drop("segment_")

    def _frequencies(self, rows: DataFrame, sign: int) -> DataFrame:
        return rows.select(F.explode("terms").alias("term")).groupBy("term").agg((F.count("*") * sign).alias("df"))

    def build(self, rows: DataFrame) -> Index:
        """The index of these rows alone, as the next version."""
        found, n, total = self._written(rows)
        df = self._frequencies(self._rows(found["rows"]), 1).withColumn("bucket", _bucket("term", self.buckets)).repartition("bucket")
        found["terms"] = self.files.write(df.sortWithinPartitions("bucket", "term"), "bucket")
        tables = {name: {"schema": schema, "files": {b: [[0, f]] for b, f in folders.items()}} for name, (schema, folders) in found.items()}
        tables["tombs"] = {"schema": self.spark.createDataFrame([], "id string").schema.jsonValue(), "files": {}}
        self.held = self.files.commit(self.held["version"], tables, {"n": n, "tokens": total, "segments": 1, "buckets": self.buckets})
        return self

    def upsert(self, rows: DataFrame, ids: DataFrame) -> Index:
        """The next version: all rows of ids(id) go, rows come. A segment is added; no bucket is written anew."""
        s, numbers = self.held["numbers"]["segments"], self.held["numbers"]
        gone = ids.select(F.col("id").cast("string").alias("id")).unionByName(rows.select(F.col("id").cast("string").alias("id"))).distinct()
        touched = {r.b for r in gone.select(_bucket("id", self.buckets).alias("b")).distinct().collect()}  # at most as many as buckets
        old = self._alive(self.files.read(self.held, "rows", touched)).join(gone, "id", "left_semi")
        lost_n, lost = old.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        found, n, total = self._written(rows)
        df = self._frequencies(self._rows(found["rows"]), 1).unionByName(self._frequencies(old, -1)).groupBy("term").agg(F.sum("df").alias("df"))
        # terms whose rows changed but not in number count, too: their bucket is to be merged
        found["terms"] = self.files.write(df.withColumn("bucket", _bucket("term", self.buckets)).repartition("bucket"), "bucket")
        found["tombs"] = self.files.write(gone.withColumn("bucket", _bucket("id", self.buckets)).repartition("bucket"), "bucket")
        tables = {name: {"schema": t["schema"], "files": dict(t["files"])} for name, t in self.held["tables"].items()}
        for name, (_, folders) in found.items():
            for b, folder in folders.items():
                tables[name]["files"][b] = [*tables[name]["files"].get(b, []), [s, folder]]
        self.held = self.files.commit(self.held["version"], tables, numbers | {"n": numbers["n"] + n - lost_n, "tokens": numbers["tokens"] + total - lost, "segments": s + 1})
        return self

    def merge(self) -> dict[str, int]:
        """Buckets written anew, by table: those that a segment since the last merge has changed; all others keep their files. Tombs go."""
        tables = {name: {"schema": t["schema"], "files": dict(t["files"])} for name, t in self.held["tables"].items()}
        told = lambda name: {int(b) for b, files in tables[name]["files"].items() if len(files) > 1}
        # a term that came or went has a row in terms of the same bucket
        terms = {int(b) for b, files in tables["terms"]["files"].items() if len(files) > 1 or files[0][0] >= self.held["numbers"].get("merged", 1)}
        ids, s, done = {int(b) for b in tables["tombs"]["files"]} | told("rows"), self.held["numbers"]["segments"], {}
        for name, parts, key in (("postings", terms, "term"), ("rows", ids, "id"), ("terms", terms, "term")):
            x = self.files.read(self.held, name, parts)
            x = x.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0") if name == "terms" else self._alive(x)
            x = x.withColumn("bucket", _bucket(key, self.buckets))
            x = x.withColumn("split_", _bucket("id", SPLITS)).repartition("bucket", "split_").drop("split_") if name == "postings" else x.repartition("bucket")
            order = ["bucket", key, "id"] if name == "postings" else ["bucket", key]
            _, folders = self.files.write(x.select("bucket", *[f["name"] for f in tables[name]["schema"]["fields"]]).sortWithinPartitions(*order), "bucket")
            tables[name]["files"] = {b: f for b, f in tables[name]["files"].items() if int(b) not in parts} | {b: [[s, f]] for b, f in folders.items()}
            done[name] = len(parts)
        tables["tombs"]["files"] = {}
        self.held = self.files.commit(self.held["version"], tables, self.held["numbers"] | {"segments": s + 1, "merged": s + 1})
        return done

    # -- reading

    def _alive(self, rows: DataFrame) -> DataFrame:
        """rows(id, ..., segment_) that no later segment has ended."""
        if not self.held["tables"]["tombs"]["files"]:
            return rows.drop("segment_")
        ended = self.files.read(self.held, "tombs").groupBy("id").agg(F.max("segment_").alias("ended_"))
        return rows.join(ended, "id", "left").where("ended_ is null or segment_ >= ended_").drop("ended_", "segment_")

    def _of(self, terms: list[str]) -> set[int]:
        if not terms:
            return set()
        asked = self.spark.createDataFrame([(t,) for t in terms], "term string")
        return {r.b for r in asked.select(_bucket("term", self.buckets).alias("b")).distinct().collect()}

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """term, id, section, size, at of these terms, or of all: of their buckets' files, and there of the row groups that may hold them."""
        if terms is None:
            return self._alive(self.files.read(self.held, "postings"))
        return self._alive(self.files.read(self.held, "postings", self._of(terms)).where(F.col("term").isin(terms)))

    def frequencies(self, terms: list[str] | None = None) -> DataFrame:
        """term, df."""
        t = self.files.read(self.held, "terms", None if terms is None else self._of(terms))
        t = t if terms is None else t.where(F.col("term").isin(terms))
        return t.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def _part(self, tf: Column, df: Column) -> Column:
        n, average = self.held["numbers"]["n"], self.held["numbers"]["tokens"] / max(self.held["numbers"]["n"], 1)
        idf = F.log((n - df + 0.5) / (df + 0.5))
        return F.when(idf <= 0, IDF_FLOOR).otherwise(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("size") / average))

    def bm25(self, terms: list[str]) -> DataFrame:
        """id, section, score (lower is better) of the rows that hold any term."""
        terms = sorted(set(terms))
        p = self.postings(terms).select("term", "id", "section", "size", F.size("at").alias("tf"))
        scored = p.join(F.broadcast(self.frequencies(terms)), "term").groupBy("id", "section").agg(F.sum(self._part(F.col("tf"), F.col("df"))).alias("s"))  # a row for each term asked
        return scored.select("id", "section", rounded(-F.col("s")).alias("score"))

    def bm25_of(self, asked: DataFrame) -> DataFrame:
        """query, id, section, score for asked(query, term): many queries in one plan, of which each term's postings are read once."""
        p = self.postings().select("term", "id", "section", "size", F.size("at").alias("tf"))
        known = asked.distinct().join(self.frequencies(), "term")
        scored = known.join(p, "term").groupBy("query", "id", "section").agg(F.sum(self._part(F.col("tf"), F.col("df"))).alias("s"))
        return scored.select("query", "id", "section", rounded(-F.col("s")).alias("score"))

    def _terms_with(self, prefix: str) -> list[str]:
        """Terms of the index that begin so: a scan of terms, which are fewer than rows."""
        return sorted(r.term for r in self.frequencies().where(F.col("term").startswith(prefix)).select("term").collect())

    def _places(self, words: list[str], prefix: bool) -> DataFrame:
        """id, section, size, tf of a phrase, from the places of its words."""
        ends = self._terms_with(words[-1]) if prefix else [words[-1]]
        found = None
        for k, own in enumerate([*[[w] for w in words[:-1]], ends]):
            p = self.postings(own).select("id", "section", "size", F.explode("at").alias("p")).select("id", "section", "size", (F.col("p") - k).alias("p"))
            found = p if found is None else found.join(p, ["id", "section", "size", "p"], "left_semi")
        return found.groupBy("id", "section", "size").agg(F.count("*").alias("tf"))

    def match(self, expression: str) -> DataFrame:
        """id, section, score of the rows that fit a raw expression, ranked by all of its words, phrases and prefixes."""
        tree = parsed(expression)
        asked = leaves(tree)
        rows = None
        for k, (words, prefix) in enumerate(asked):
            p = self._places(list(words), prefix).withColumn("leaf", F.lit(k))
            rows = p if rows is None else rows.unionByName(p)
        df = rows.groupBy("leaf").agg(F.count("*").alias("df"))  # a row for each leaf
        scored = rows.join(F.broadcast(df), "leaf").groupBy("id", "section").agg(F.collect_set("leaf").alias("held"), F.sum(self._part(F.col("tf"), F.col("df"))).alias("s"))
        fits = condition(tree, lambda leaf: F.array_contains("held", asked.index(leaf)))
        return scored.where(fits).select("id", "section", rounded(-F.col("s")).alias("score"))
