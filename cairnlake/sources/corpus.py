"""A corpus of markdown files as rows; versioned tables; the shared scratch folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from .versions import Versions

#: Frontmatter fields that are columns of their own; fixed values.
FIELDS = ("id", "title", "summary", "priority", "template", "stale", "locked", "tags", "entities", "source")


def ensure_checkpoints(spark: SparkSession) -> None:
    """Uses spark.checkpoint.dir; a folder of its own only where that is unset, in local mode."""
    if spark.sparkContext.getCheckpointDir():
        return
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(found or tempfile.mkdtemp(prefix="cairnlake-"))


def scan(spark: SparkSession, root: str) -> DataFrame:
    """path (below root) and text of the live notes of a folder: .md files of no hidden or trash folder
    (but .innate) that aren't named README, INDEX, GUIDE or _*."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/.innate")
    roots = [root, f"{root}/.innate"] if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) else [root]  # Spark lists no hidden folder by itself
    files = spark.read.text(roots, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    files = files.select(F.regexp_extract("file", r"/cortex/(.*)$", 1).alias("path"), "text")
    name = F.element_at(F.split("path", "/"), -1)
    hidden = F.exists(F.split("path", "/"), lambda p: p.startswith(".") & (p != ".innate"))
    return files.where((F.col("path") != "") & ~hidden & ~name.isin("README.md", "INDEX.md", "GUIDE.md") & ~name.startswith("_"))


def axis_of(path: Column) -> Column:
    first = F.split(path, "/")[0]
    return F.when(first == ".innate", "innate").otherwise(first)


def parse(files: DataFrame) -> DataFrame:
    """files(path, text) with the frontmatter's fields, extra (map of unknown ones), body and error:
    a malformed head or line, or a list that isn't in brackets, is an error, never a lost row."""
    parts = files.withColumn("head", F.regexp_extract("text", r"(?s)\A---\n(.*?)\n---(?:\n+|\z)", 1)).withColumn("body", F.regexp_replace("text", r"(?s)\A---\n.*?\n---(?:\n+|\z)", ""))
    rows = F.filter(F.split("head", "\n"), lambda x: F.trim(x) != "")
    bad = F.filter(rows, lambda x: ~x.rlike(r"^\w+:\s*\S.*$"))
    pair = lambda x: F.struct(F.regexp_extract(x, r"^(\w+):", 1).alias("key"), F.trim(F.regexp_extract(x, r"^\w+:(.*)$", 1)).alias("value"))
    parts = parts.withColumn("rows_", F.transform(F.filter(rows, lambda x: x.rlike(r"^\w+:\s*\S.*$")), pair)).withColumn("bad_", bad)
    value = lambda k: F.try_element_at(F.filter("rows_", lambda p: p["key"] == k), F.lit(-1))["value"]
    array = lambda k: F.when(value(k).rlike(r"^\[.*\]$"), F.filter(F.transform(F.split(F.regexp_replace(value(k), r"^\[|\]$", ""), ","), lambda x: F.trim(x)), lambda x: x != ""))
    flag = lambda k: F.lower(F.coalesce(value(k), F.lit(""))).isin("true", "1", "yes")
    source = F.when(value("source").startswith("["), F.from_json(value("source"), "array<string>")).when(value("source").startswith("{"), F.array(F.get_json_object(value("source"), "$.path"))).when(value("source").isNotNull(), F.array(value("source")))
    lists = [k for k in ("tags", "entities")]
    wrong = F.array_compact(F.array(*[F.when(value(k).isNotNull() & ~value(k).rlike(r"^\[.*\]$"), F.lit(k)) for k in lists]))
    error = F.when(~F.col("text").rlike(r"(?s)\A---\n.*?\n---"), "no frontmatter").when(F.size("bad_") > 0, F.concat(F.lit("malformed: "), F.element_at("bad_", 1))).when(F.size(wrong) > 0, F.concat(F.lit("not a list: "), F.element_at(wrong, 1)))
    extra = F.map_from_entries(F.filter("rows_", lambda p: ~p["key"].isin(*FIELDS)))
    return parts.select(
        "path", axis_of(F.col("path")).alias("axis"), *[value(k).alias(k) for k in ("id", "title", "summary", "template")], F.coalesce(value("priority"), F.lit("lazy")).alias("priority"),
        flag("stale").alias("stale"), flag("locked").alias("locked"), *[F.coalesce(array(k), F.array()).cast("array<string>").alias(k) for k in lists], source.alias("source"), extra.alias("extra"),
        "body", text.content_hash(F.col("text")).alias("content_hash"), text.word_count(F.col("body")).alias("word_count"), error.alias("error"),
    )


def dump(notes: DataFrame) -> DataFrame:
    """path and text of parsed notes, fields in one order, empty ones left out."""
    item = lambda k, v: F.when(v.isNotNull() & (v != ""), F.concat(F.lit(f"{k}: "), v))
    listed = lambda k: item(k, F.when(F.size(k) > 0, F.concat(F.lit("["), F.array_join(k, ", "), F.lit("]"))))
    flag = lambda k: F.when(F.col(k), F.lit(f"{k}: true"))
    rows = F.array_compact(F.array(*[item(k, F.col(k)) for k in ("id", "title", "summary", "priority", "template")], flag("stale"), flag("locked"), listed("tags"), listed("entities"), item("source", F.when(F.size("source") > 0, F.to_json("source")))))
    return notes.select("path", F.concat(F.lit("---\n"), F.array_join(rows, "\n"), F.lit("\n---\n\n"), F.col("body")).alias("text"))


def changed(scan_: DataFrame, catalog: DataFrame) -> DataFrame:
    """Parsed rows whose (path, content_hash) the catalog doesn't have."""
    return scan_.join(catalog.select("path", "content_hash"), ["path", "content_hash"], "left_anti")


def upsert(catalog: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """catalog with rows in place of those of the same key."""
    return catalog.join(rows.select(key), key, "left_anti").select(catalog.columns).unionByName(rows.select(catalog.columns))


def commit(tables: dict[str, DataFrame], root: str, version: int, keys: dict[str, str | list[str]] | None = None, parts: int = 64) -> None:
    """Writes a state as a version: readers see the old state or the new one whole. Tables are dealt out to `parts` partitions by their key (by
    default the first column), and partitions that are as they were in the version before share its files. Conflict, if another writer has
    made this version, or if the one before it isn't the newest (the first may have any number)."""
    files = Versions(next(iter(tables.values())).sparkSession, root)
    before = files.state(version - 1) if files.latest() >= version - 1 >= 0 and files.has(version - 1) else files.state(-1)
    files.replace(before | {"version": version - 1}, {name: (df, (keys or {}).get(name, df.columns[0])) for name, df in tables.items()}, parts)


def load(spark: SparkSession, root: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of a version, or of the newest."""
    files = Versions(spark, root)
    state = files.state(version)
    return {name: files.read(state, name).drop("segment_") for name in state["tables"]}


def source_hashes(files: DataFrame) -> DataFrame:
    """path, hash of files(path, text)."""
    return files.select("path", text.content_hash(F.col("text")).alias("hash"))
