"""Markdown sections as rows, tables of contents, budgeted reads."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.edits import read_within
from ..functions.text import body_lines, split_sections, word_count

COLUMNS = ["id", "ord", "level", "title", "path", "line_start", "line_end", "text"]


def sections(notes: DataFrame) -> DataFrame:
    """A row for each heading outside fences of notes(id, body); batches of texts, not rows, cross to Python."""
    kind = dict(notes.dtypes)["id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(i, *s) for i, body in zip(batch["id"], batch["body"], strict=True) for s in split_sections(body)], columns=COLUMNS)

    return notes.select("id", "body").mapInPandas(run, f"id {kind}, ord int, level int, title string, path string, line_start int, line_end int, text string")


def budget(rows: DataFrame, words: int) -> DataFrame:
    """id, sections, shown, words: sections in order until the first that would exceed the budget."""
    w = Window.partitionBy("id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    c = rows.select("id", "ord", word_count(F.col("text")).alias("n")).withColumn("upto", F.sum("n").over(w))
    fits = F.col("upto") <= words
    return c.groupBy("id").agg(F.count("*").alias("sections"), F.sum(fits.cast("long")).alias("shown"), F.sum(F.when(fits, F.col("n")).otherwise(0)).cast("long").alias("words"))


def collisions(rows: DataFrame) -> DataFrame:
    """id, path, n of headings of one level and path that stand more than once."""
    return rows.groupBy("id", "path", "level").agg(F.count("*").alias("n")).where("n > 1")


def preambles(notes: DataFrame) -> DataFrame:
    """id, text above the first heading of notes(id, body), empty if there is none."""

    @F.pandas_udf("string")
    def above(bodies: pd.Series) -> pd.Series:
        return pd.Series(["\n".join(body_lines(b or "")[: found[0][4]] if (found := split_sections(b)) else body_lines(b or "")) for b in bodies], dtype=object)

    return notes.select("id", above("body").alias("text"))


def within(notes: DataFrame, words: int) -> DataFrame:
    """id, text, words, omitted (paths of sections), cut (where) of notes(id, body) read up to so many words."""

    @F.pandas_udf("text string, words long, omitted array<string>, cut string")
    def read(bodies: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_within(b or "", words) for b in bodies], columns=["text", "words", "omitted", "cut"])

    return notes.select("id", read("body").alias("r")).select("id", "r.*")
