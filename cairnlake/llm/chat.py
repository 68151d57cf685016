"""Chat formatting with one training example for each reply. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, ROLE_END, CLOSE = "### ", ": ", "</turn>\n"


def escape(text: Column) -> Column:
    """Control strings become backslash and a letter; reversible for every text."""
    for plain, code in (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in (("</turn>", "\\t"), ("###", "\\h"), ("\\", "\\b")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\c"))


def _unrole(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\c"), F.lit(":")))


def examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example, n_turns, formatted, loss_start, loss_length: for every assistant turn an
    example with all turns up to it, of which only the reply (loss_start and loss_length, in code
    points of formatted) is trainable. Turns after the last reply, or of a conversation without
    one, close with an example of their own whose loss is empty, so that no turn is lost.

    Null roles and texts are empty, turns are ordered by (turn, role, text), null turns first;
    repeated rows stay; null conv_ids are one conversation. A conversation is one unit: its
    text is put together by one task."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    c = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    head = lambda x: F.concat(F.lit(OPEN), _role(x["role"]), F.lit(ROLE_END))
    c = c.withColumn("heads", F.transform("turns", head)).withColumn("bodies", F.transform("turns", lambda x: escape(x["text"])))
    c = c.withColumn("n", F.size("turns"))
    ends = F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: (F.element_at("turns", i)["role"] == "assistant") | (i == F.col("n")))
    c = c.select("conv_id", "heads", "bodies", F.transform("turns", lambda x: x["role"] == "assistant").alias("reply"), F.posexplode(ends).alias("example", "last"))
    i = F.col("last")
    before = F.array_join(F.zip_with(F.slice("heads", 1, i - 1), F.slice("bodies", 1, i - 1), lambda h, b: F.concat(h, b, F.lit(CLOSE))), "")
    before = F.concat(F.when(i > 1, before).otherwise(F.lit("")), F.element_at("heads", i))
    c = c.withColumn("before", before).withColumn("body", F.element_at("bodies", i))
    return c.select(
        "conv_id", F.col("example").cast("int").alias("example"), i.cast("long").alias("n_turns"), F.concat("before", "body", F.lit(CLOSE)).alias("formatted"),
        F.length("before").cast("long").alias("loss_start"), F.when(F.element_at("reply", i), F.length("body")).otherwise(0).cast("long").alias("loss_length"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted string as array<struct<role, text>>."""
    parts = F.split(formatted, CLOSE)
    parts = F.slice(parts, 1, F.size(parts) - 1)

    def turn(x: Column) -> Column:
        end = F.locate(ROLE_END, x)
        role = F.substring(x, F.lit(len(OPEN) + 1), end - F.lit(len(OPEN) + 1))
        return F.struct(_unrole(role).alias("role"), unescape(F.substring(x, end + F.lit(len(ROLE_END)), F.length(x))).alias("text"))

    return F.transform(parts, turn)


def loss_text(row: DataFrame) -> Column:
    return unescape(F.substring(row["formatted"], row["loss_start"] + 1, row["loss_length"]))


def digests(found: DataFrame) -> DataFrame:
    """What can be read back from examples(), a row per conversation."""
    e = found.select("conv_id", "example", "n_turns", F.length("formatted").alias("chars"), loss_text(found).alias("loss"), "formatted")
    g = e.groupBy("conv_id").agg(
        F.max_by("formatted", "n_turns").alias("whole"), F.sum(F.length("loss")).alias("loss_chars"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"), F.sum("chars").alias("formatted_chars"),
    ).withColumn("turns", read_back(F.col("whole")))
    text = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return g.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"), F.col("loss_chars").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"))
