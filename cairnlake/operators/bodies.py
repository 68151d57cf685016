"""Edits of note bodies as frames: section edits, moves of sections, splits, all-or-nothing batches, trash."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import edits

REQUEST = ["id", "seq", "action", "section", "content", "subtree"]


def _outcomes(notes: DataFrame, requests: DataFrame) -> DataFrame:
    """id, new_body, bad_seq, error of each note with requests: all of them applied by seq, or none and the first that fails."""
    kind = dict(notes.dtypes)["id"]
    asked = requests.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(*REQUEST[1:]))).alias("asked"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for id_, body, asked in zip(batch["id"], batch["body"], batch["asked"], strict=True):
                text, seq, error = body or "", None, None
                for r in asked:
                    try:
                        text = edits.apply(text, r["action"], r["section"], r["content"], r["subtree"])
                    except edits.EditError as e:
                        text, seq, error = body, r["seq"], str(e)
                        break
                out.append((id_, text, seq, error))
            yield pd.DataFrame(out, columns=["id", "new_body", "bad_seq", "error"]).astype({"bad_seq": "Int64"})

    return notes.select("id", "body").join(asked, "id").mapInPandas(run, f"id {kind}, new_body string, bad_seq long, error string")


def edited(notes: DataFrame, requests: DataFrame) -> DataFrame:
    """notes(id, body, ...) after requests(id, seq, action, section, content, subtree), with error added
    (null: all applied, or none asked). Only bodies with requests cross to Python."""
    done = _outcomes(notes, requests)
    out = notes.join(done, "id", "left").withColumn("body", F.when(F.col("new_body").isNull(), F.col("body")).otherwise(F.col("new_body")))
    return out.select(*notes.columns, "error")


def failing(notes: DataFrame, requests: DataFrame) -> DataFrame:
    """batch, error of requests(batch, ...) that can't be applied: on notes that don't exist, locked ones, or by their edit."""
    locked = F.col("locked") if "locked" in notes.columns else F.lit(False)
    known = notes.select("id", locked.alias("locked_"))
    gate = requests.select("batch", "id").distinct().join(known, "id", "left").select("batch", F.when(F.col("locked_").isNull(), "no such note").when(F.col("locked_"), "locked").alias("error"))
    wrong = _outcomes(notes, requests).where("error is not null").select("id", F.col("bad_seq").alias("seq"), "error")
    return gate.where("error is not null").unionByName(requests.select("batch", "id", "seq").join(wrong, ["id", "seq"]).select("batch", "error")).groupBy("batch").agg(F.min("error").alias("error"))


def transaction(notes: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(notes after every batch of requests(batch, id, seq, ...) that can be applied whole; batch, error of
    the others, which leave no trace). seq is unique within a note. Each round drops the batches
    whose edits fail first, as later ones may rest on them; both frames that carry over are checkpointed."""
    requests, refused = requests.checkpoint(), None
    while True:
        bad = failing(notes, requests).checkpoint()
        refused = bad if refused is None else refused.unionByName(bad)
        if bad.isEmpty():
            return edited(notes, requests).drop("error"), refused
        requests = requests.join(bad.select("batch"), "batch", "left_anti").checkpoint()


def pieces(notes: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(id, section, ...) with piece: the section with all below it, null if there is no such one."""

    @F.pandas_udf("string")
    def cut(bodies: pd.Series, paths: pd.Series) -> pd.Series:
        out = []
        for body, path in zip(bodies, paths, strict=True):
            try:
                out.append(edits.piece(body or "", path or ""))
            except edits.EditError:
                out.append(None)
        return pd.Series(out, dtype=object)

    return asked.join(notes.select("id", "body"), "id", "left").select(*asked.columns, cut("body", "section").alias("piece"))


def relocations(notes: DataFrame, moves: DataFrame) -> DataFrame:
    """Requests for transaction() of moves(batch, seq, src, dst, section): each section is removed from src
    and added to the end of dst, as it reads in notes; moves of what another batch changes or holds are refused."""
    found = pieces(notes, moves.withColumn("id", F.col("src")))
    row = lambda id_, action, section, content: F.struct(F.col(id_).alias("id"), F.when(F.col("piece").isNull(), "missing").otherwise(action).alias("action"), section.alias("section"), content.alias("content"))
    none = F.lit(None).cast("string")
    both = F.array(row("src", "remove", F.col("section"), F.col("piece")), row("dst", "add", none, F.col("piece")))
    return found.select("batch", "seq", F.explode(both).alias("r")).select("batch", "r.id", "seq", "r.action", "r.section", "r.content", F.lit(True).alias("subtree"))


def split(notes: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """parts(id, seq, child, section): (notes without the sections that went; id, body, parent of the children,
    pieces in order of seq). A note of which a section isn't found, or of which two overlap, stays whole and has no child."""
    found = pieces(notes, parts)
    asked = found.select("id", "seq", F.when(F.col("piece").isNull(), "missing").otherwise("remove").alias("action"), "section", F.col("piece").alias("content"), F.lit(True).alias("subtree"))
    out = edited(notes, asked)
    good = found.join(out.where("error is null").select("id"), "id", "left_semi")
    children = good.groupBy(F.col("child").alias("id"), F.col("id").alias("parent")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "piece"))), lambda x: x["piece"]), "\n").alias("body"))
    return out.drop("error"), children.select("id", "body", "parent")


def deleted(notes: DataFrame, trash: DataFrame, ids: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(notes without ids(id), trash(deleted_at, columns of notes) with them)."""
    gone = notes.join(ids.select("id").distinct(), "id", "left_semi").withColumn("deleted_at", F.lit(now).cast("long"))
    return notes.join(ids.select("id"), "id", "left_anti").select(notes.columns), trash.unionByName(gone.select(trash.columns))


def restored(notes: DataFrame, trash: DataFrame, ids: DataFrame) -> DataFrame:
    """notes with the latest deleted form of each of ids(id); notes that live are left as they are."""
    last = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("deleted_at"), *[c for c in notes.columns if c != "id"]))
    back = trash.join(ids.select("id").distinct(), "id", "left_semi").join(notes.select("id"), "id", "left_anti").withColumn("rank_", last).where("rank_ = 1")
    return notes.unionByName(back.select(notes.columns))
