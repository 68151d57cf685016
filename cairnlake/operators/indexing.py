"""The catalogue of notes: builds, references, the search index, and whether they agree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.corpus import changed, upsert


def build(catalog: DataFrame, scanned: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(catalogue after a scan; path, error of files left out; id of notes that went). Unchanged files aren't read again; of two files
    with one id the first path stays and the other is an error; notes whose file went go too, but only if no file failed."""
    good = scanned.where("error is null and id is not null and id <> ''")
    ranked = good.withColumn("copy_", F.row_number().over(Window.partitionBy("id").orderBy("path")))
    errors = scanned.where("error is not null").select("path", "error").unionByName(scanned.where("error is null and coalesce(id, '') = ''").select("path", F.lit("no id").alias("error")))
    errors = errors.unionByName(ranked.where("copy_ > 1").select("path", F.lit("duplicate id").alias("error")))
    first = ranked.where("copy_ = 1").drop("copy_")
    new = changed(first, catalog)
    failed = scanned.where("error is not null").limit(1).agg((F.count("*") > 0).alias("failed"))
    gone = catalog.join(scanned.select("path"), "path", "left_anti").join(first.select("id"), "id", "left_anti").select("id").crossJoin(F.broadcast(failed)).where("not failed").select("id")
    return upsert(catalog, new.select(catalog.columns)).join(gone, "id", "left_anti").select(catalog.columns), errors, gone


def rebuild(scanned: DataFrame, columns: list[str]) -> DataFrame:
    """The whole catalogue from a scan; any error stops it."""
    bad = scanned.where("error is not null or coalesce(id, '') = ''").select("path").unionByName(scanned.groupBy("id").agg(F.count("*").alias("n"), F.max("path").alias("path")).where("n > 1").select("path"))
    if not bad.isEmpty():
        raise ValueError(f"rebuild stopped: {bad.orderBy('path').first().path}")
    return scanned.select(columns)


def reindexed(catalog: DataFrame, scanned: DataFrame, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(catalogue with the given files read anew; path, error of those that failed or aren't there)."""
    asked = catalog.sparkSession.createDataFrame([(p,) for p in paths], "path string")
    some = asked.join(scanned, "path", "left")
    good = some.where("id is not null and error is null")
    return upsert(catalog, good.select(catalog.columns)), some.where("id is null or error is not null").select("path", F.coalesce("error", F.lit("no such file")).alias("error"))


def projected(notes: DataFrame) -> dict[str, DataFrame]:
    """What hangs on parsed notes: tags(id, pos, tag), entities(note_id, entities), markers(src, marker)."""
    return {
        "tags": notes.select("id", F.posexplode("tags").alias("pos", "tag")), "entities": notes.select(F.col("id").alias("note_id"), "entities"),
        "markers": notes.select(F.col("id").alias("src"), F.explode(text.reference_markers(F.col("body"))).alias("marker")).where("src <> marker"),
    }


def replaced(table: DataFrame, ids: DataFrame, rows: DataFrame, column: str = "id") -> DataFrame:
    """table with rows in place of all rows of ids(id)."""
    return table.join(ids.select(F.col("id").alias(column)), column, "left_anti").select(table.columns).unionByName(rows.select(table.columns))


def reference_edges(markers: DataFrame, notes: DataFrame) -> DataFrame:
    """src, dst, kind, weight of markers that name a note. As all markers are kept, a new note completes older references to it, too."""
    return markers.join(notes.select(F.col("id").alias("marker")), "marker", "left_semi").where("src <> marker").select("src", F.col("marker").alias("dst"), F.lit("reference").alias("kind"), F.lit(1.0).alias("weight")).distinct()


def unresolved(markers: DataFrame, notes: DataFrame) -> DataFrame:
    return markers.join(notes.select(F.col("id").alias("marker")), "marker", "left_anti").select("src", "marker").distinct()


def refill(index: DataFrame, notes: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(index rows of notes that exist, with rows of those that had none; id, state of orphans pruned and notes refilled)."""
    ids, held = notes.select("id"), index.select("id").distinct()
    orphans, bare = held.join(ids, "id", "left_anti"), ids.join(held, "id", "left_anti")
    out = index.join(ids, "id", "left_semi").select(index.columns).unionByName(rows.join(bare, "id", "left_semi").select(index.columns))
    return out, orphans.select("id", F.lit("pruned").alias("state")).unionByName(bare.select("id", F.lit("refilled").alias("state")))


def integrity(tables: dict[str, set[str]], expected: dict[str, set[str]], notes: DataFrame, files: DataFrame, index: DataFrame, tags: DataFrame, vocabulary: DataFrame, axes: DataFrame, level: int = 3) -> DataFrame:
    """level, code, subject: 0 tables and columns that are missing; 1 files without a note, notes without a file, notes without an index
    row and the reverse; 2 files that read otherwise than their note; 3 tags and axes that no vocabulary knows."""
    spark = notes.sparkSession
    lost = [(0, "missing-table" if t not in tables else "missing-column", t if t not in tables else f"{t}.{c}") for t, cs in sorted(expected.items()) for c in (sorted(cs - tables.get(t, set())) if t in tables else [""])]
    found = [spark.createDataFrame(lost, "level int, code string, subject string")]
    row = lambda df, n, code, c: found.append(df.select(F.lit(n).alias("level"), F.lit(code).alias("code"), F.col(c).alias("subject")).distinct())
    if level >= 1:
        row(files.join(notes, "path", "left_anti"), 1, "file-without-note", "path")
        row(notes.join(files, "path", "left_anti"), 1, "note-without-file", "path")
        row(notes.join(index, "id", "left_anti"), 1, "note-without-index", "id")
        row(index.join(notes, "id", "left_anti"), 1, "index-without-note", "id")
    if level >= 2:
        row(files.join(notes.select("path", F.col("content_hash").alias("h_")), "path").where("content_hash <> h_"), 2, "content-differs", "path")
    if level >= 3:
        row(tags.join(vocabulary, "tag", "left_anti"), 3, "unknown-tag", "tag")
        row(notes.join(axes, "axis", "left_anti"), 3, "unknown-axis", "axis")
    return reduce(lambda a, b: a.unionByName(b), found)


def as_json(rows: DataFrame) -> DataFrame:
    """A line of JSON for each row."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def append_events(log: str, events: DataFrame) -> None:
    """Adds events(ts, kind, session_id, payload) to the log's folder."""
    events.write.mode("append").parquet(log)
