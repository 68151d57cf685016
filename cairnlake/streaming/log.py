"""Windows and hits of an event log that are kept while events come in: a stream whose state is a stored version of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.policy import Tunables
from ..operators import activity, jobs
from ..operators.graph import held
from ..sources.versions import Versions

WINDOW = "id long, session_id string, started_at long, ended_at long, queries long"
HIT = "session_id string, event_id long, ts long, cmd string, note_id string, surface string, window_id long"


def session_key(session: Column) -> Column:
    """A key that isn't null: events without a session are one session."""
    return F.coalesce(F.concat(F.lit("s"), session), F.lit(""))


class WindowLog:
    """A folder with three tables and a few numbers, all of one version:

    last: each session's newest window, which its next events may still join, however late: rewritten in the partitions of the sessions
    that a batch touches. past: the windows before those, only added to. hits: what the events showed, only added to.
    numbers: mark (the largest id taken), behind (rows that came with ids at or below it), and what the ticks have gathered.

    Ids are a key and ascend from batch to batch; within a batch rows may stand in any order. Then any cut into batches gives the windows that
    activity.windows_of() has over the whole log. A batch that comes again, after a stop between commit and checkpoint, changes nothing,
    as its ids are at or below the mark. Of two writers on one version one gets Conflict."""

    def __init__(self, spark: SparkSession, root: str, t: Tunables | None = None, parts: int = 64) -> None:
        self.spark, self.root, self.t, self.parts = spark, root, t or Tunables(), parts

    def _at(self, spark: SparkSession) -> tuple[Versions, dict]:
        files = Versions(spark, self.root)
        state = files.state()
        if state["version"] < 0:
            empty = lambda schema: spark.createDataFrame([], schema)
            files.put({"last": (empty("key string, " + WINDOW), "key"), "past": (empty(WINDOW), "id"), "hits": (empty(HIT), "window_id")}, self.parts)
            state = files.state()
        return files, state

    def advance(self, events: DataFrame) -> int:
        """Takes one batch of events(id, ts, kind, session_id, payload); the new mark. Malformed ones move the mark only."""
        files, state = self._at(events.sparkSession)
        mark, behind = state["numbers"].get("mark", -1), state["numbers"].get("behind", 0)
        came = events.agg(F.max("id").alias("most"), F.count(F.when(F.col("id") <= mark, 1)).alias("behind")).first()
        if came.most is None or came.most <= mark:
            return mark
        new = held(activity.parsed(events.where(F.col("id") > mark)))
        sessions = new.where("cmd is not null").select(session_key(F.col("session_id")).alias("key")).distinct()
        touched = {r.n for r in sessions.select(F.pmod(F.xxhash64("key"), F.lit(state["tables"]["last"]["parts"])).cast("int").alias("n")).distinct().collect()}  # at most parts
        before = held(files.read(state, "last", touched).drop("segment_").join(sessions, "key", "left_semi"))
        found = held(activity.windows_of(new, self.t.window_gap_sec, mark, before.select("id", "session_id", "ended_at")))
        windows, hits = jobs.gathered(found)
        # a window that goes on has two rows: what it was, with the earlier first event, and what has come
        first = F.min_by("started_at", F.when(F.col("old_"), 0).otherwise(1)).alias("started_at")
        grown = windows.withColumn("key", session_key(F.col("session_id"))).withColumn("old_", F.lit(False)).unionByName(before.withColumn("old_", F.lit(True)))
        grown = held(grown.groupBy("key", "session_id", "id").agg(first, F.max("ended_at").alias("ended_at"), F.sum("queries").alias("queries")))
        newest = grown.groupBy("key").agg(F.max("id").alias("id")).select("id")
        last, past = grown.join(newest, "id", "left_semi"), grown.join(newest, "id", "left_anti")
        files.change(state, {"last": (last, last.select("key").limit(0))}, {"past": past, "hits": hits}, {"mark": came.most, "behind": behind + came.behind})
        return came.most

    def start(self, events: DataFrame, checkpoint: str, **trigger: object) -> StreamingQuery:
        """Follows a stream of events; trigger as DataStreamWriter.trigger() takes it."""
        out = events.writeStream.foreachBatch(lambda batch, _: self.advance(batch) and None).option("checkpointLocation", checkpoint)
        return (out.trigger(**trigger) if trigger else out).start()

    def numbers(self) -> dict:
        return self._at(self.spark)[1]["numbers"]

    def windows(self) -> DataFrame:
        """id (of the first event), session_id, started_at, ended_at, queries."""
        files, state = self._at(self.spark)
        names = ["id", "session_id", "started_at", "ended_at", "queries"]
        return files.read(state, "past").select(names).unionByName(files.read(state, "last").select(names))

    def hits(self) -> DataFrame:
        files, state = self._at(self.spark)
        return files.read(state, "hits").drop("segment_")

    def compact(self, most: int = 16, keep: int = 10) -> None:
        """Writes partitions anew that have gathered more than `most` files of past and hits; of the versions the newest `keep` stay."""
        for table in ("past", "hits"):
            files, state = self._at(self.spark)
            files.compact(state, table, most)
        Versions(self.spark, self.root).release(keep)

    def tick(self, now: int) -> dict:
        """jobs.homeostasis() over the windows that have closed since the tick before; its samples, hops and watermark are kept with the
        tables, so that ticks may come at any times and from any session. Gives the row."""
        files, state = self._at(self.spark)
        n = state["numbers"]
        so_far = {"watermark": n.get("ticked", -1), "seen": n.get("seen", 0), "landed": n.get("landed", 0), "hops": n.get("hops", self.t.expand_hops)}
        row = jobs.homeostasis(self.windows(), self.hits(), now, t=self.t, **so_far).first().asDict()
        files.change(state, {}, None, {"ticked": row["watermark"], "seen": row["sample_seen"], "landed": row["sample_landed"], "hops": row["hops"]})
        return row

    def retained(self, events: DataFrame, now: int) -> DataFrame:
        """The log without what is both old and taken: windows are derived before their events go."""
        recent = F.col("ts") >= now - 86400 * self.t.events_retention_days
        return events.where(recent | (F.col("id") > self.numbers().get("mark", -1)))
