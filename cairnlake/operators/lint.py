"""Rules over notes, documents and the corpus; each gives (code, severity, subject, detail)."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import templates, text


#: Codes that are errors; all others warn. Fixed values.
ERRORS = ("fence-unclosed", "invalid-id", "invalid-priority", "axis-mismatch", "axis-tag-missing", "path-collision")
#: What each scope looks at; fixed values.
RULES = {
    "document": ("fence-unclosed", "bare-hash-line", "wikilink-style", "heading-skip", "adjacent-empty-heading", "empty-section"),
    "note": ("invalid-id", "invalid-priority", "axis-mismatch", "no-tags", "axis-tag-missing", "empty-summary", "summary-long", "empty-title", "unknown-field", "stale-source", "empty-body", "tiny-body", "path-collision", "dangling-note-ref", "tag-alias-violation", "note-oversized", "growth-unbounded"),
    "note+db": ("enrich-thin", "template-drift"), "corpus": ("isolated", "fragment-unlinked", "gist-missing", "tag-only-axis", "tag-near-duplicate"),
}


def rule_catalog(spark: SparkSession) -> DataFrame:
    """severity, code, scope of all rules."""
    rows = [("error" if c in ERRORS else "warn", c, scope) for scope, codes in RULES.items() for c in codes]
    return spark.createDataFrame(rows, "severity string, code string, scope string").orderBy("severity", "code")


def template_drift(notes: DataFrame) -> DataFrame:
    """Notes whose headings aren't those of the template they name (notes(id, template, body)); of a template that is gone nothing is said."""
    frames = notes.select(F.col("id").alias("template"), F.col("body").alias("frame"))
    n = notes.where("template is not null").select("id", "template", "body").join(frames, "template")

    @F.pandas_udf("string")
    def drift(body: pd.Series, frame: pd.Series) -> pd.Series:
        return pd.Series([templates.violation(templates.headings(f), templates.headings(b)) for b, f in zip(body, frame, strict=True)], dtype=object)

    return n.select(F.col("id").alias("subject"), F.lit("template-drift").alias("code"), drift("body", "frame").alias("detail")).where("detail is not null")


def note_rules(oversized: int = 2000) -> dict[str, tuple[str, Column]]:
    """Conditions on columns of notes that are each a finding."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    return {
        "invalid-id": ("error", ~F.col("id").rlike("^[a-z0-9][a-z0-9-]*$")), "invalid-priority": ("error", ~F.col("priority").isin("eager", "lazy")),
        "empty-title": ("warn", blank("title")), "empty-summary": ("warn", F.coalesce("summary", F.lit("")) == ""), "summary-long": ("warn", F.length("summary") > 80),
        "empty-body": ("warn", blank("body")), "tiny-body": ("warn", (F.col("word_count") < 5) & ~blank("body")), "note-oversized": ("warn", F.col("word_count") >= oversized),
    }


def lint_notes(notes: DataFrame, oversized: int = 2000) -> DataFrame:
    """One pass: every rule is a column, findings are exploded."""
    found = [F.when(cond, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for code, (severity, cond) in note_rules(oversized).items()]
    return notes.select(F.col("id").alias("subject"), F.explode(F.array_compact(F.array(*found))).alias("f")).select("subject", "f.code", "f.severity")


def lint_tags(notes: DataFrame, tags: DataFrame) -> DataFrame:
    """no-tags and axis-tag-missing."""
    t = tags.groupBy("id").agg(F.collect_set("tag").alias("tags"))
    n = notes.select("id", "axis").join(t, "id", "left")
    code = F.when(F.col("tags").isNull(), "no-tags").when(~F.array_contains("tags", F.col("axis")), "axis-tag-missing")
    return n.select(F.col("id").alias("subject"), code.alias("code")).where("code is not null")


def lint_documents(notes: DataFrame) -> DataFrame:
    """subject, code, line (from 1) of line rules outside fences, folded over each note's lines in the JVM: fence-unclosed (where it opens),
    bare-hash-line, wikilink-style, heading-skip, empty-section (its heading). One finding for each line and rule."""
    finding = "struct<line: int, code: string>"
    state = f"struct<fence: string, opened: int, level: int, at: int, blank: boolean, found: array<{finding}>>"
    nothing = F.array().cast(f"array<{finding}>")
    start = F.struct(F.lit("").alias("fence"), F.lit(0).alias("opened"), F.lit(0).alias("level"), F.lit(0).alias("at"), F.lit(False).alias("blank"), nothing.alias("found"))

    def step(s: Column, row: Column) -> Column:
        line, i = row["line"], row["i"]
        mark = F.regexp_extract(line, r"^ {0,3}(`{3,}|~{3,})", 1)
        inside = s["fence"] != ""
        closes = inside & (mark != "") & mark.startswith(s["fence"]) & (F.trim(F.regexp_replace(line, r"^ {0,3}[`~]+", "")) == "")
        opens = ~inside & (mark != "") & ~(mark.startswith("`") & F.regexp_replace(line, r"^ {0,3}`+", "").contains("`"))
        level = F.length(F.regexp_extract(line, r"^(#{1,6})\s+\S", 1))
        heading = ~inside & ~opens & (level > 0)
        one = lambda cond, code, at=i: F.when(cond, F.array(F.struct(at.alias("line"), F.lit(code).alias("code")))).otherwise(nothing)
        more = F.concat(
            one(~inside & line.rlike(r"^#{1,6}[^#\s]"), "bare-hash-line"), one(~inside & line.rlike(r"\[\[[^\]]+\]\]"), "wikilink-style"),
            one(heading & (s["level"] > 0) & (level > s["level"] + 1), "heading-skip"), one(heading & s["blank"] & (level <= s["level"]), "empty-section", s["at"]),
        )
        return F.struct(
            F.when(closes, "").when(opens, mark).otherwise(s["fence"]).alias("fence"), F.when(opens, i).otherwise(s["opened"]).alias("opened"), F.when(heading, level).otherwise(s["level"]).alias("level"), F.when(heading, i).otherwise(s["at"]).alias("at"),
            F.when(heading, F.lit(True)).when(F.trim(line) != "", F.lit(False)).otherwise(s["blank"]).alias("blank"), F.concat(s["found"], more).alias("found"),
        )

    rows = F.transform(text.lines(F.col("body")), lambda x, i: F.struct(x.alias("line"), (i + 1).cast("int").alias("i")))
    end = F.aggregate(rows, start.cast(state), lambda s, x: step(s, x).cast(state))
    last = F.when(F.col("end.fence") != "", F.array(F.struct(F.col("end.opened").alias("line"), F.lit("fence-unclosed").alias("code")))).otherwise(nothing)
    return notes.select(F.col("id").alias("subject"), end.alias("end")).select("subject", F.explode(F.concat("end.found", last)).alias("f")).select("subject", "f.code", "f.line")


def dangling(notes: DataFrame) -> DataFrame:
    """References to notes that don't exist."""
    m = notes.select(F.col("id").alias("subject"), F.explode(text.reference_markers(F.col("body"))).alias("marker"))
    return m.join(notes.select(F.col("id").alias("marker")), "marker", "left_anti").select("subject", "marker")


def isolated(notes: DataFrame, edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Notes without an edge or an entity."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return notes.where("priority <> 'eager'").select("id").join(ends, "id", "left_anti").join(entities.select("id"), "id", "left_anti")


def integrity(notes: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """table, id of rows of children(id) whose note doesn't exist."""
    parts = [c.select(F.lit(name).alias("table_name"), "id").join(notes.select("id"), "id", "left_anti").distinct() for name, c in children.items()]
    return reduce(lambda a, b: a.unionByName(b), parts).select("table_name", "id")
