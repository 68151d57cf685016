"""The event log: windows by gaps, hits, landing rates, retention, drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

PAYLOAD = "struct<cmd: string, hit_ids: array<string>, expand_ids: array<string>>"


def parsed(events: DataFrame) -> DataFrame:
    """events(id, ts, kind, session_id, payload) with the payload's fields; malformed ones stay with nulls."""
    return events.withColumn("p", F.from_json("payload", PAYLOAD)).select("id", "ts", "kind", "session_id", F.col("p.cmd").alias("cmd"), F.col("p.hit_ids").alias("hit_ids"), F.col("p.expand_ids").alias("expand_ids"))


#: Events of one stretch of ids, which one task orders.
STRETCH = 65_536


def windows_of(events: DataFrame, gap: int = 900, after: int = -1, open_: DataFrame | None = None, stretch: int = STRETCH) -> DataFrame:
    """Parsed events beyond the watermark `after`, with window (number in its session from 0), in order
    of id: an event joins the open window if it is at most gap seconds after its end; the end is the
    latest time so far, so that late events join and don't open one. Events without a session are
    one session. Malformed ones take no part (but the watermark passes them). open_(id, session_id, ended_at): each
    session's window so far, which is window 0 here, with its id as window_id.

    A session of any length is ordered stretch by stretch of ids: what a stretch must know of those before it,
    their latest time and number of windows, are two prefix sums over a row for each stretch."""
    e = events.where((F.col("id") > after) & F.col("cmd").isNotNull())
    e = e.withColumns({"s_": F.coalesce("session_id", F.lit("")), "anon_": F.col("session_id").isNull(), "part_": F.floor(F.col("id") / stretch)})
    session, part = ["s_", "anon_"], ["s_", "anon_", "part_"]
    before = Window.partitionBy(*session).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    ends = e.groupBy(*part).agg(F.max("ts").alias("end_")).withColumn("end_", F.max("end_").over(before))
    e = e.join(ends, part)
    if open_ is not None:
        held = open_.select(F.coalesce("session_id", F.lit("")).alias("s_"), F.col("session_id").isNull().alias("anon_"), F.col("ended_at").alias("held_"), F.col("id").alias("open_id"))
        e = e.join(held, session, "left").withColumn("end_", F.greatest("end_", "held_"))
    w = Window.partitionBy(*part).orderBy("id")
    end = F.greatest("end_", F.max("ts").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    e = e.withColumn("opens_", F.coalesce((F.col("ts") > end + gap).cast("int"), F.lit(0)))
    sums = e.groupBy(*part).agg(F.sum("opens_").alias("sum_")).withColumn("sum_", F.coalesce(F.sum("sum_").over(before), F.lit(0)))
    e = e.join(sums, part).withColumn("window", F.col("sum_") + F.sum("opens_").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if open_ is not None:
        e = e.withColumn("window_id", F.when(F.col("window") == 0, F.col("open_id")))
    else:
        e = e.withColumn("window_id", F.lit(None).cast("long"))
    return e.select(*events.columns, "window", "window_id")


def activity_windows(found: DataFrame) -> DataFrame:
    """session_id, window, started_at, ended_at, queries."""
    first = F.min_by("ts", "id")
    return found.groupBy("session_id", "window").agg(first.alias("started_at"), F.max("ts").alias("ended_at"), F.count("*").alias("queries"))


def hits(found: DataFrame) -> DataFrame:
    """A row for each note that an event surfaced: session_id, window, event_id, ts, cmd, note_id, surface."""
    each = lambda c, s: found.select("session_id", "window", F.col("id").alias("event_id"), "ts", "cmd", F.explode(c).alias("note_id"), F.lit(s).alias("surface"))
    return each("hit_ids", "hit").unionByName(each("expand_ids", "expand"))


def activation_stats(h: DataFrame) -> DataFrame:
    return h.groupBy("cmd", "surface").agg(F.count("*").alias("n"), F.countDistinct("note_id").alias("notes"))


def hits_by_axis(h: DataFrame, notes: DataFrame) -> DataFrame:
    return h.join(notes.select(F.col("id").alias("note_id"), "axis"), "note_id", "left").groupBy(F.coalesce("axis", F.lit("(gone)")).alias("axis")).agg(F.count("*").alias("n"))


def used_now(h: DataFrame, notes: DataFrame, response: str, since: int, session: str | None = None, share: float = 0.3) -> DataFrame:
    """note_id, event_id, signal of notes whose latest hit since a time (of a session, if one is given) a response bears out: it names the
    id, or holds so large a share of the words of the note's title and summary."""
    own = h if session is None else h.where(F.col("session_id") == session)
    words = text.overlap_tokens(F.lit(response))
    of_note = text.overlap_tokens(F.concat_ws(" ", "title", "summary"))
    near = F.lit(response).contains(F.col("id")) | ((F.size(of_note) > 0) & (F.size(F.array_intersect(of_note, words)) / F.size(of_note) >= share))
    found = latest_hit(own, since).join(notes.select(F.col("id").alias("id"), "title", "summary"), F.col("note_id") == F.col("id"))
    return found.where((F.size(words) > 0) & near).select("note_id", "event_id", F.lit("content_overlap").alias("signal"))


def latest_hit(h: DataFrame, since: int) -> DataFrame:
    """Each note's latest hit since a time, by (ts, event)."""
    return h.where((F.col("surface") == "hit") & (F.col("ts") >= since)).groupBy("note_id").agg(F.max(F.struct("ts", "event_id")).alias("m")).select("note_id", "m.ts", "m.event_id")


def landing(h: DataFrame) -> DataFrame:
    """expanded, landed: surfaced by expansion, and of those later got in the same window. The latest
    get of each note and window decides, so there is no inequality join."""
    got = h.where("cmd = 'get' and surface = 'hit'").groupBy("session_id", "window", "note_id").agg(F.max("ts").alias("got"))
    e = h.where("surface = 'expand' and cmd <> 'get'").select("session_id", "window", "note_id", "ts")
    null_safe = e.session_id.eqNullSafe(got.session_id) & (e.window == got.window) & (e.note_id == got.note_id)
    out = e.join(got, null_safe, "left")
    return out.agg(F.count("*").alias("expanded"), F.sum((F.coalesce(F.col("got") >= F.col("ts"), F.lit(False))).cast("long")).alias("landed"))


def tick(landed: DataFrame, hops: int, least: int = 0, most: int = 1, min_sample: int = 50, low: float = 0.02, high: float = 0.15) -> DataFrame:
    """The hops that follow: one fewer at a low rate, one more at a high one, within bounds."""
    rate = F.col("landed") / F.col("expanded")
    new = F.when(F.col("expanded") < min_sample, hops).when(rate < low, max(least, hops - 1)).when(rate > high, min(most, hops + 1)).otherwise(hops)
    return landed.select("expanded", "landed", new.cast("int").alias("hops"))


def retained(events: DataFrame, now: int, days: int = 30) -> DataFrame:
    return events.where(F.col("ts") >= now - 86400 * days)


def source_drift(stored: DataFrame, current: DataFrame) -> DataFrame:
    """path, state: fresh, drifted, missing or new."""
    s, c = stored.select("path", F.col("hash").alias("old")), current.select("path", F.col("hash").alias("new"))
    state = F.when(F.col("new").isNull(), "missing").when(F.col("old").isNull(), "new").when(F.col("old") == F.col("new"), "fresh").otherwise("drifted")
    return s.join(c, "path", "full").select("path", state.alias("state"))
