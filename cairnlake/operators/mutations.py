"""Changes of notes and of what hangs on them. Each function takes the frames it changes and a frame
of requests and gives the new frame, so that a batch of any size is one plan; commit() writes it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.policy import Tunables
from .graph import canonical

TERM_RANK = {"active": 2, "pending": 1}
REASON_CHARS = 200


def renamed(rows: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """names(old, new): values of column renamed, as for tags and axes; rows that become equal are one."""
    new = names.select(F.col("old").alias(column), F.col("new").alias("new_"))
    return rows.join(new, column, "left").withColumn(column, F.coalesce("new_", column)).select(rows.columns).distinct()


def marked(notes: DataFrame, ids: DataFrame, stale: bool = True) -> DataFrame:
    """invalidate and revalidate: stale of the notes in ids(id)."""
    hit = ids.select("id", F.lit(True).alias("hit_")).distinct()
    return notes.join(hit, "id", "left").withColumn("stale", F.when(F.col("hit_"), F.lit(stale)).otherwise(F.col("stale"))).select(notes.columns)


def referrers(edges: DataFrame, ids: DataFrame, reason: str, now: int) -> DataFrame:
    """Flags that invalidating ids(id) raises: one stale_ref for each referrer of each of them."""
    e = edges.where("kind = 'reference' and src <> dst").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst").distinct()
    return e.select(F.col("src").alias("note_id"), F.lit("stale_ref").alias("flag"), F.lit(reason).alias("reason"), F.lit(now).cast("long").alias("ts"))


def _raised(raised: DataFrame) -> DataFrame:
    cut = raised.withColumn("reason", F.substring("reason", 1, REASON_CHARS))
    return cut.groupBy("note_id", "flag").agg(F.max_by("reason", F.struct("ts", "reason")).alias("new_reason"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("times"))


def flag(flags: DataFrame, raised: DataFrame) -> DataFrame:
    """raised(note_id, flag, reason, ts): a flag raised again counts on, takes the latest reason and opens."""
    both, new = flags.join(_raised(raised), ["note_id", "flag"], "full"), F.col("times").isNotNull()
    return both.select(
        "note_id", "flag", F.coalesce("new_reason", "reason").alias("reason"), F.coalesce("created_at", "first_ts").alias("created_at"), F.when(new, F.col("last_ts")).otherwise(F.col("last_flagged_at")).alias("last_flagged_at"),
        (F.coalesce("flag_count", F.lit(0)) + F.coalesce("times", F.lit(0))).alias("flag_count"), F.when(~new, F.col("resolved_at")).alias("resolved_at"),
    )


def flag_events(flags: DataFrame, raised: DataFrame) -> DataFrame:
    """Lifecycle rows of flag(): only flags that are new or were resolved leave one."""
    open_ = flags.where("resolved_at is null").select("note_id", "flag")
    r = _raised(raised).join(open_, ["note_id", "flag"], "left_anti")
    return r.select("note_id", F.lit("flagged").alias("kind"), F.concat("flag", F.lit(": "), "new_reason").alias("reason"), F.col("first_ts").alias("created_at"))


def resolve(flags: DataFrame, requests: DataFrame) -> DataFrame:
    """requests(note_id, flag, ts) close open flags; closed ones keep their time."""
    at = requests.groupBy("note_id", "flag").agg(F.min("ts").alias("at_"))
    return flags.join(at, ["note_id", "flag"], "left").withColumn("resolved_at", F.coalesce("resolved_at", "at_")).select(flags.columns)


def propose(edges: DataFrame, proposals: DataFrame, t: Tunables | None = None) -> DataFrame:
    """proposals(src, dst, confidence): new assoc edges, dormant: below the floor of neighbours, nearer to it
    with confidence (null: 1; kept within 0 and 1). Edges that exist keep their weight; of equal proposals the most confident stays."""
    t = t or Tunables()
    ceiling = t.neighbor_floor - 0.02
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("confidence"), F.lit(1.0))))
    weight = F.least(F.lit(ceiling), t.proposed_initial_weight + sure * max(0.0, ceiling - t.proposed_initial_weight))
    new = proposals.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.lit("assoc").alias("kind"), weight.alias("weight"))
    new = new.groupBy("src", "dst", "kind").agg(F.max("weight").alias("weight")).join(edges, ["src", "dst", "kind"], "left_anti")
    return edges.select("src", "dst", "kind", "weight").unionByName(new)


def link_siblings(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """groups(key, id), each the notes of one split: an edge of weight 1 between any two, if there is none."""
    other = groups.select("key", F.col("id").alias("dst"))
    new = groups.join(other, "key").where("id < dst").select(F.col("id").alias("src"), "dst", F.lit("sibling").alias("kind"), F.lit(1.0).alias("weight")).distinct()
    return edges.select("src", "dst", "kind", "weight").unionByName(new.join(edges, ["src", "dst", "kind"], "left_anti"))


def lineage(edges: DataFrame, links: DataFrame) -> DataFrame:
    """links(src, dst, kind) of descent: directed edges of weight 1."""
    new = canonical(links.select("src", "dst", "kind", F.lit(1.0).alias("weight"))).distinct().join(edges, ["src", "dst", "kind"], "left_anti")
    return edges.select("src", "dst", "kind", "weight").unionByName(new)


def add_terms(terms: DataFrame, new: DataFrame) -> DataFrame:
    """new(note_id, kind, term, created_at): pending terms; of those that exist only rejected ones open again."""
    keys = ["note_id", "kind", "term"]
    new = new.groupBy(keys).agg(F.min("created_at").alias("new_at"))
    again = (F.col("status").isNull()) | ((F.col("status") == "rejected") & F.col("new_at").isNotNull())
    both = terms.join(new, keys, "full")
    return both.select(*keys, F.when(again, "pending").otherwise(F.col("status")).alias("status"), F.when(again, F.col("new_at")).otherwise(F.col("created_at")).alias("created_at"), F.when(~again, F.col("reject_reason")).alias("reject_reason"))


def reject_pending(terms: DataFrame, now: int, max_age_sec: int = 86400) -> DataFrame:
    """Terms that wait for so long are rejected."""
    late = (F.col("status") == "pending") & (F.col("created_at") <= now - max_age_sec)
    return terms.withColumns({"status": F.when(late, "rejected").otherwise(F.col("status")), "reject_reason": F.when(late, "roundtrip_fail").otherwise(F.col("reject_reason"))})


def set_meta(meta: DataFrame, changes: DataFrame) -> DataFrame:
    """note_id, namespace, key, value, updated_at: the latest value of a key stays; a null value deletes it."""
    rows = meta.withColumn("new_", F.lit(0)).unionByName(changes.withColumn("new_", F.lit(1)))
    last = rows.groupBy("note_id", "namespace", "key").agg(F.max_by(F.struct("value", "updated_at"), F.struct("new_", "updated_at", "value")).alias("x"))
    return last.where("x.value is not null").select("note_id", "namespace", "key", "x.value", "x.updated_at")


def _moved(rows: DataFrame, moves: DataFrame) -> DataFrame:
    """rows(note_id, ...) under their new note; came: null for rows that were there, else their old note."""
    m = moves.select(F.col("old").alias("note_id"), F.col("new").alias("new_"))
    return rows.join(m, "note_id", "left").withColumn("came", F.when(F.col("new_").isNotNull(), F.col("note_id"))).withColumn("note_id", F.coalesce("new_", "note_id")).drop("new_")


def migrate(rows: DataFrame, moves: DataFrame) -> DataFrame:
    """moves(old, new), one old for each new: rows of old replace those of new."""
    kept = rows.join(moves.select(F.col("new").alias("note_id")), "note_id", "left_anti")
    return _moved(kept, moves).select(rows.columns)


def _own(x: str | Column) -> Column:
    """x of the row that was there, else of the smallest note that came."""
    return F.min_by(x, F.struct(F.col("came").isNotNull(), "came"))


def absorb_usage(usage: DataFrame, moves: DataFrame) -> DataFrame:
    """moves(old, new) of merged notes: hits add up; the last retrieval is unknown if one of them is."""
    last = F.when(F.count("last_retrieved_at") == F.count("*"), F.max("last_retrieved_at"))
    return _moved(usage, moves).groupBy("note_id").agg(F.sum("hit_count").alias("hit_count"), last.alias("last_retrieved_at"), _own("created_at").alias("created_at"))


def absorb_terms(terms: DataFrame, moves: DataFrame) -> DataFrame:
    """The row of the best status stays (active, pending, rejected), the one that was there among equals."""
    rest = [c for c in terms.columns if c not in ("note_id", "kind", "term")]
    rank = F.when(F.col("status") == "active", -TERM_RANK["active"]).when(F.col("status") == "pending", -TERM_RANK["pending"]).otherwise(0)
    best = F.min_by(F.struct(*rest), F.struct(rank, F.col("came").isNotNull(), "came"))
    return _moved(terms, moves).groupBy("note_id", "kind", "term").agg(best.alias("x")).select("note_id", "kind", "term", "x.*")


def absorb_flags(flags: DataFrame, moves: DataFrame) -> DataFrame:
    """Counts add up; state and reason come from an open flag first, then from the latest."""
    at = F.when(F.col("resolved_at").isNull(), F.col("last_flagged_at")).otherwise(F.col("resolved_at"))
    best = F.min_by(F.struct("reason", "resolved_at"), F.struct(F.col("resolved_at").isNotNull(), -at, F.col("came").isNotNull(), "came"))
    sums = _moved(flags, moves).groupBy("note_id", "flag").agg(best.alias("x"), F.min("created_at").alias("created_at"), F.max("last_flagged_at").alias("last_flagged_at"), F.sum("flag_count").alias("flag_count"))
    return sums.select("note_id", "flag", "x.reason", "created_at", "last_flagged_at", "flag_count", "x.resolved_at")


def absorb_dismissals(dismissals: DataFrame, moves: DataFrame) -> DataFrame:
    """Counts add up; what was seen comes from the latest dismissal."""
    seen = ["word_count", "section_count", "generation", "reason"]
    best = F.min_by(F.struct(*seen), F.struct(-F.col("last_dismissed_at"), F.col("came").isNotNull(), "came"))
    sums = _moved(dismissals, moves).groupBy("note_id", "kind").agg(F.sum("dismiss_count").alias("dismiss_count"), F.max("last_dismissed_at").alias("last_dismissed_at"), best.alias("x"))
    return sums.select("note_id", "kind", "dismiss_count", "last_dismissed_at", "x.*")
