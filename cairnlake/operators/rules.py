"""Rules that need more than a note: fields, sources, sections, references, terms, tags and families.
Each gives subject, code and, where it helps, a detail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components

#: Edge kinds that someone drew on purpose.
DELIBERATE = ("reference", "sibling", "merge_ancestor", "supersedes", "promoted_to")
PERIOD_ID, DATED = r"-\d{6}(-\d{2,6})?(-(am|pm))?$", r"^\d{4}-\d{2}-\d{2}"


def axis_mismatch(notes: DataFrame) -> DataFrame:
    """notes(id, axis, path): the first folder isn't the axis."""
    folder = F.split("path", "/")[0]
    return notes.where(F.when(folder == ".innate", "innate").otherwise(folder) != F.col("axis")).select(F.col("id").alias("subject"), F.lit("axis-mismatch").alias("code"))


def unknown_fields(notes: DataFrame) -> DataFrame:
    """notes(id, extra map): a finding for each field that the frontmatter doesn't know."""
    return notes.select(F.col("id").alias("subject"), F.lit("unknown-field").alias("code"), F.explode(F.map_keys("extra")).alias("detail"))


def stale_sources(sources: DataFrame, files: DataFrame) -> DataFrame:
    """sources(id, path): absolute paths that files(path) doesn't hold."""
    gone = sources.where(F.col("path").startswith("/")).join(files.select("path"), "path", "left_anti")
    return gone.select(F.col("id").alias("subject"), F.lit("stale-source").alias("code"), F.col("path").alias("detail")).distinct()


def adjacent_headings(sections: DataFrame) -> DataFrame:
    """Sections of one line: the next heading follows at once."""
    return sections.where("line_end = line_start + 1").select(F.col("id").alias("subject"), F.lit("adjacent-empty-heading").alias("code"), F.col("path").alias("detail"))


def growth_unbounded(notes: DataFrame, sections: DataFrame, entries: int = 8) -> DataFrame:
    """Notes of so many dated sections, but templates, locked ones and those named for a period."""
    dated = sections.where(F.col("title").rlike(DATED)).groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") >= entries)
    open_ = notes.where(F.col("template").isNull() & ~F.coalesce("locked", F.lit(False)) & ~F.col("id").rlike(PERIOD_ID))
    return open_.select("id").join(dated, "id").select(F.col("id").alias("subject"), F.lit("growth-unbounded").alias("code"), F.col("n").cast("string").alias("detail"))


def enrich_thin(notes: DataFrame, terms: DataFrame) -> DataFrame:
    """Hangul notes that hide long camel-case names and have no active term."""
    all_ = F.concat_ws("\n", "title", "body")
    names = F.array_distinct(F.filter(F.regexp_extract_all(all_, F.lit("[A-Za-z]{12,}"), F.lit(0)), lambda x: x.rlike("[a-z][A-Z]")))
    thin = notes.where(all_.rlike("[가-힣]")).select("id", names.alias("names")).where(F.size("names") > 0)
    return thin.join(terms.where("status = 'active'").select(F.col("note_id").alias("id")), "id", "left_anti").select(F.col("id").alias("subject"), F.lit("enrich-thin").alias("code"), F.array_join("names", ", ").alias("detail"))


def tag_aliases(tags: DataFrame, aliases: DataFrame) -> DataFrame:
    """Tags that have another name by aliases(alias, tag)."""
    return tags.join(aliases.select(F.col("alias").alias("tag"), F.col("tag").alias("detail")), "tag").select(F.col("id").alias("subject"), F.lit("tag-alias-violation").alias("code"), F.concat("tag", F.lit(" -> "), "detail").alias("detail"))


def nearest(markers: DataFrame, notes: DataFrame) -> DataFrame:
    """subject, marker, near of dangling markers(subject, marker): the smallest id one edit away (a join on each
    string with a character left out), else the only id that the marker begins or ends, at a hyphen."""
    wanted, ids = markers.select("marker").distinct(), notes.select("id").distinct()

    def holes(df: DataFrame, c: str) -> DataFrame:
        cut = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(F.col(c), i + 1, F.length(c))))
        return df.select(c, F.explode(F.array_distinct(F.concat(F.array(c), cut))).alias("key"))

    edit = holes(wanted, "marker").join(holes(ids, "id"), "key").where(F.levenshtein("marker", "id", 1) == 1).groupBy("marker").agg(F.min("id").alias("edit"))
    parts = F.split("id", "-")
    some = lambda a, b: F.array_join(F.slice(parts, a, b), "-")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array(some(F.lit(1), i), some(i + 1, F.size(parts) - i)))
    grown = ids.where("id like '%-%'").select("id", F.explode(F.array_distinct(F.flatten(ends))).alias("marker")).join(wanted, "marker", "left_semi")
    only = grown.groupBy("marker").agg(F.min("id").alias("grown"), F.count("*").alias("n")).where("n = 1").drop("n")
    return markers.join(edit, "marker", "left").join(only, "marker", "left").select("subject", "marker", F.coalesce("edit", "grown").alias("near"))


def fragmentation(notes: DataFrame, edges: DataFrame, entities: DataFrame, tags: DataFrame) -> DataFrame:
    """isolated (no edge to a note that exists, no entity, one tag at most) and tag-only-axis (one tag at most) of
    notes that aren't eager."""
    known = notes.select("id")
    ends = edges.select(F.col("src").alias("id"), F.col("dst").alias("other")).unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("other")))
    linked = ends.join(known.select(F.col("id").alias("other")), "other", "left_semi").select("id").unionByName(entities.select("id")).distinct().withColumn("held", F.lit(True))
    n = notes.where("priority <> 'eager'").select("id").join(tags.groupBy("id").agg(F.count("*").alias("n")), "id", "left").where("coalesce(n, 0) <= 1").join(linked, "id", "left")
    return n.select(F.col("id").alias("subject"), F.when(F.col("held"), "tag-only-axis").otherwise("isolated").alias("code"))


def families(notes: DataFrame, edges: DataFrame, least: int = 3) -> DataFrame:
    """family, key, stem, has_index, id: notes that were one. Components of sibling edges take in notes of one axis whose
    ids share all but the last part with theirs (the component with most of them, then the smallest); other ids of one stem are a family
    if there are so many. stem: what all ids of a family begin with, 4 characters and one hyphen at least, or null."""
    ids = notes.select("id", "axis")
    known = notes.select("id")
    siblings = edges.where("kind = 'sibling'").join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    roots = components(siblings.select("src", "dst")).select(F.col("node").alias("id"), "root")
    stem = F.regexp_extract("id", "^(.*)-[^-]*$", 1)
    stems = ids.select("id", F.concat_ws("\0", "axis", stem).alias("group"), stem.alias("s")).where("length(s) >= 4 and s like '%-%'").join(roots, "id", "left")
    hits = stems.where("root is not null").groupBy("group", "root").agg(F.count("*").alias("n")).groupBy("group").agg(F.min_by("root", F.struct(-F.col("n"), "root")).alias("target"))
    size = stems.groupBy("group").agg(F.count("*").alias("size"))
    free = stems.where("root is null").join(hits, "group", "left").join(size, "group").where(F.col("target").isNotNull() | (F.col("size") >= least))
    members = roots.select(F.concat(F.lit("c"), "root").alias("family"), "id").unionByName(free.select(F.when(F.col("target").isNotNull(), F.concat(F.lit("c"), "target")).otherwise(F.concat(F.lit("s"), "group")).alias("family"), "id"))
    low, high = F.min(F.split("id", "-")), F.max(F.split("id", "-"))  # what these two share, all share
    same = F.aggregate(F.arrays_zip(F.col("low").alias("a"), F.col("high").alias("b")), F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")), lambda s, x: F.struct((s["on"] & F.coalesce(x["a"] == x["b"], F.lit(False))).alias("on"), (s["n"] + (s["on"] & F.coalesce(x["a"] == x["b"], F.lit(False))).cast("int")).alias("n")))["n"]
    f = members.groupBy("family").agg(low.alias("low"), high.alias("high"), F.min("id").alias("first")).withColumn("stem", F.array_join(F.slice("low", F.lit(1), same), "-"))
    f = f.withColumn("stem", F.when((F.length("stem") >= 4) & F.col("stem").contains("-"), F.col("stem"))).join(known.select(F.col("id").alias("stem"), F.lit(True).alias("has_index")), "stem", "left")
    f = f.withColumn("has_index", F.coalesce("has_index", F.lit(False))).select("family", F.when(F.col("has_index"), F.col("stem")).otherwise(F.col("first")).alias("key"), "stem", "has_index")
    return members.join(f, "family").select("family", "key", "stem", "has_index", "id")


def gist_missing(found: DataFrame) -> DataFrame:
    """Of families(): those with a stem that no note is named by."""
    return found.where("stem is not null and not has_index").groupBy("family", F.col("key").alias("subject"), "stem").agg(F.count("*").alias("members")).select("subject", F.lit("gist-missing").alias("code"), F.concat("stem", F.lit(" "), "members").alias("detail"))


def fragment_unlinked(found: DataFrame, edges: DataFrame) -> DataFrame:
    """Of families(): the number of members without a deliberate edge to another member or to the note named by the stem."""
    e = edges.where(F.col("kind").isin(*DELIBERATE)).select("src", "dst")
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    inside = found.select("family", "id").unionByName(found.where("stem is not null").select("family", F.col("stem").alias("id"))).distinct()
    held = found.select("family", F.col("id").alias("src")).join(both, "src").join(inside.withColumnRenamed("id", "dst"), ["family", "dst"]).select("family", F.col("src").alias("id")).distinct()
    loose = found.join(held, ["family", "id"], "left_anti").groupBy("family", "key", "stem").agg(F.count("*").alias("n"))
    return loose.select(F.col("key").alias("subject"), F.lit("fragment-unlinked").alias("code"), F.concat_ws(" ", F.coalesce("stem", "key"), "n").alias("detail"))
