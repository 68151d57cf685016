"""Read surfaces: lists, counts, statistics, vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.policy import fresh, rounded


def listing(notes: DataFrame, axis: str | None = None, priority: str | None = None, stale: bool | None = None, limit: int | None = None) -> DataFrame:
    out = notes
    for name, value in (("axis", axis), ("priority", priority), ("stale", stale)):
        out = out if value is None else out.where(F.col(name) == value)
    out = out.select("id", "axis", "priority", "stale", "word_count").orderBy("axis", "id")
    return out if limit is None else out.limit(limit)


def catalog(notes: DataFrame, ids: list[str]) -> DataFrame:
    """The notes of ids; none if ids is empty."""
    return notes.where(F.col("id").isin(ids) if ids else F.lit(False)).select("id", "axis", "title")


def axis_counts(axes: DataFrame, notes: DataFrame) -> DataFrame:
    """Axes without notes count 0."""
    return axes.join(notes.groupBy("axis").agg(F.count("*").alias("c")), "axis", "left").select("axis", F.coalesce("c", F.lit(0)).alias("n"))


def axis_stats(notes: DataFrame) -> DataFrame:
    return notes.groupBy("axis").agg(
        F.count("*").alias("n"), F.sum((F.col("priority") == "eager").cast("long")).alias("eager"), F.sum(F.col("stale").cast("long")).alias("stale"), rounded(F.avg("word_count"), 1).alias("avg_words"),
        F.max("word_count").alias("max_words"), rounded(F.avg("section_count"), 1).alias("avg_sections"), F.sum("hit_count").alias("hits"),
    )


def overall_stats(notes: DataFrame) -> DataFrame:
    return notes.agg(
        F.count("*").alias("n"), F.sum(F.col("stale").cast("long")).alias("stale"), F.sum((F.col("hit_count") > 0).cast("long")).alias("hit"), F.sum((F.col("hit_count") == 0).cast("long")).alias("never_hit"),
        rounded(F.avg("hit_count"), 3).alias("avg_hits"), F.max("hit_count").alias("max_hits"), F.sum("word_count").alias("words"),
    )


def note_stats(notes: DataFrame, tags: DataFrame, entities: DataFrame, now: int) -> DataFrame:
    """Counts and ages in days: aggregated first, then joined, not correlated subqueries."""
    t, e = tags.groupBy("id").agg(F.count("*").alias("tags")), entities.groupBy("id").agg(F.count("*").alias("entities"))
    days = lambda c: F.floor((F.lit(now) - F.col(c)) / 86400)
    return notes.join(t, "id", "left").join(e, "id", "left").select("id", "word_count", "section_count", F.coalesce("tags", F.lit(0)).alias("tags"), F.coalesce("entities", F.lit(0)).alias("entities"), days("created_at").alias("age_days"), days("last_retrieved_at").alias("idle_days"))


def top_tags(tags: DataFrame, limit: int = 20) -> DataFrame:
    return tags.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(limit)


def axis_top_tags(notes: DataFrame, tags: DataFrame, per_axis: int = 8) -> DataFrame:
    c = tags.join(notes.select("id", "axis"), "id").groupBy("axis", "tag").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("axis").orderBy(F.desc("n"), "tag"))
    return c.withColumn("rank", rank).where(F.col("rank") <= per_axis)


def tag_cooccurrence(tags: DataFrame, limit: int = 50) -> DataFrame:
    """Pairs within each note's few tags, from its array."""
    t = tags.groupBy("id").agg(F.array_sort(F.collect_set("tag")).alias("t"))
    both = F.flatten(F.transform("t", lambda a, i: F.transform(F.slice("t", i + 2, F.size("t")), lambda b: F.struct(a.alias("tag_a"), b.alias("tag_b")))))
    return t.select(F.explode(both).alias("p")).groupBy("p.tag_a", "p.tag_b").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag_a", "tag_b").limit(limit)


def rare_tags(tags: DataFrame, most: int = 1, limit: int = 40) -> DataFrame:
    return tags.groupBy("tag").agg(F.count("*").alias("n")).where(F.col("n") <= most).orderBy("n", "tag").limit(limit)


def unused(vocabulary: DataFrame, tags: DataFrame) -> DataFrame:
    return vocabulary.join(tags.select("tag"), "tag", "left_anti").select("tag")


def axis_sizes(notes: DataFrame, small: int = 2, large: int = 20) -> DataFrame:
    c = notes.groupBy("axis").agg(F.count("*").alias("n"))
    return c.select("axis", "n", F.when(F.col("n") <= small, "small").when(F.col("n") >= large, "large").otherwise("normal").alias("size"))


def entity_lookup(entities: DataFrame, notes: DataFrame, entity: str, limit: int = 20) -> DataFrame:
    return entities.where(F.col("entity") == entity).join(notes.select("id", "title"), "id", "left").orderBy(F.desc("last_seen_at"), "entity", "id").limit(limit).select("entity", "id", "title", "last_seen_at")


def entity_hits(entities: DataFrame, notes: DataFrame, wanted: list[str], per_entity: int = 5) -> DataFrame:
    """The latest fresh notes of each entity."""
    e = entities.where(F.col("entity").isin(wanted)).join(notes.where(fresh()).select("id"), "id", "left_semi")
    rank = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("last_seen_at"), "id"))
    return e.withColumn("rank", rank).where(F.col("rank") <= per_entity).select("entity", "id", "rank")


def split_candidates(notes: DataFrame, tags: DataFrame, min_words: int, min_sections: int, min_tags: int, limit: int = 50) -> DataFrame:
    from ..functions.policy import decay_candidate

    t = tags.groupBy("id").agg(F.countDistinct("tag").alias("tags")).where(F.col("tags") >= min_tags)
    return notes.where(decay_candidate() & (F.col("word_count") >= min_words) & (F.col("section_count") >= min_sections)).join(t, "id").orderBy(F.desc("word_count"), "id").limit(limit).select("id", "word_count", "section_count", "tags")


def habituated(findings: DataFrame, dismissals: DataFrame, generation: int, growth: float = 1.5, words: float = 0.5, sections: float = 2.0) -> DataFrame:
    """Findings(id, word_count, section_count) that were never dismissed, or in an older generation, or
    have grown enough since: more with every dismissal."""
    d = dismissals.select("id", "dismiss_count", F.col("word_count").alias("w0"), F.col("section_count").alias("s0"), F.col("generation").alias("g0"))
    factor = F.pow(F.lit(growth), F.col("dismiss_count") - 1)
    show = F.col("g0").isNull() | (F.col("g0") < generation) | (F.col("word_count") >= F.col("w0") * (1 + words * factor)) | (F.abs(F.col("section_count") - F.col("s0")) >= sections * factor)
    return findings.join(d, "id", "left").where(show).select("id", "word_count", "section_count")
