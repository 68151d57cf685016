"""What a command does as a whole: searches with their effects, related notes, structure, the periodic jobs, replays."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import policy, text
from ..functions.policy import Tunables, rounded
from . import activity, enrichment, graph, indexing, mining, mutations, relational, retrieval, state
from .graph import held

QUERY_CHARS = 200


def search_effects(hits: DataFrame, expanded: DataFrame, usage: DataFrame, entities: DataFrame, edges: DataFrame, now: int, query: str, session: str | None = None, t: Tunables | None = None) -> dict[str, DataFrame]:
    """What a search leaves behind: usage and entities of all notes it showed (hits(id, rank), expanded(id, rank), ranks from 0), edges between
    them (2 to 8 notes; learned ones among them grow by rank), and one event. The frames given aren't changed."""
    t = t or Tunables()
    shown = hits.select("id", F.lit(0).alias("part"), "rank").unionByName(expanded.select("id", F.lit(1).alias("part"), "rank"))
    order = Window.orderBy("part", "rank", "id")  # the few notes that one search shows
    ranked = shown.withColumn("rank", F.row_number().over(order) - 1).groupBy("id").agg(F.min("rank").alias("rank"))
    used, seen = state.activated(usage, entities, ranked.select(F.col("id").alias("note_id"), F.lit(now).cast("long").alias("ts")))
    pairs = graph.pairs_of_sets(ranked.select(F.lit(1).alias("key"), F.col("id").alias("item")))
    wired = graph.strengthen(edges.select("src", "dst", "kind", "weight"), pairs, "cooccur", t.strengthen_step)
    few = ranked.agg((F.count("*") >= 2).alias("few"))
    boosted = ranked.crossJoin(F.broadcast(few)).where("few").drop("few")
    ids = lambda df: df.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("ids"))
    payload = F.to_json(F.struct(F.lit("search").alias("cmd"), F.lit(query[:QUERY_CHARS]).alias("query"), F.col("hit_ids"), F.col("expand_ids")))
    event = ids(hits).withColumnRenamed("ids", "hit_ids").crossJoin(ids(expanded).withColumnRenamed("ids", "expand_ids"))
    event = event.select(F.lit(now).cast("long").alias("ts"), F.lit("retrieval").alias("kind"), F.lit(session).cast("string").alias("session_id"), payload.alias("payload"))
    return {"usage": used, "entities": seen, "edges": graph.rebirth(wired, boosted, t.rebirth_search_boost), "events": event}


#: Searches of one stretch of ids, which are folded into one change of an edge.
FOLDED = 65_536


def _after(f: Column, g: Column) -> Column:
    """The change g after f. A change is w -> least(cap, a * w + b) with a of 1 or more and b of 0 or more, and two of them are one of the same
    form. Beyond 1e150 a factor takes any weight to the cap, and more would overflow."""
    cap = F.least(g["cap"], g["a"] * f["cap"] + g["b"])
    return F.struct(F.least(g["a"] * f["a"], F.lit(1e150)).alias("a"), F.least(g["a"] * f["b"] + g["b"], cap).alias("b"), cap.alias("cap"))


def _folded(changes: Column) -> Column:
    """The changes of a sorted array of structs with f(a, b, cap), one after another."""
    none = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(float("inf")).alias("cap"))
    return F.aggregate(changes, none, lambda f, x: _after(f, x["f"]))


def edges_after(edges: DataFrame, log: DataFrame, t: Tunables | None = None, cap: float = 1.0, stretch: int = FOLDED) -> DataFrame:
    """edges(src, dst, kind, weight) after the searches of log(id, hit_ids, expand_ids), one after another by id, as search_effects() changes them
    for one: notes are ranked as they are shown, one that is shown twice by its first place; 2 to 8 notes are wired (cooccur, by a step up to
    cap); then learned edges with both ends among them grow by the larger end's factor, never down, up to cap. Null and empty ids, arrays
    that are null and searches that show one note change nothing.

    Steps and factors don't commute below the cap, so that the order counts; but they can be put together: each edge's changes are folded in
    stretches of ids, and then stretch by stretch, so that no group grows with the log. Searches of more notes than are wired don't make
    pairs: the edges that they touch are joined from those that are there or come to be."""
    t = t or Tunables()
    shown = F.filter(F.concat(F.coalesce("hit_ids", F.array().cast("array<string>")), F.coalesce("expand_ids", F.array().cast("array<string>"))), lambda x: x.isNotNull() & (x != ""))
    asked = held(log.select("id", shown.alias("shown")).withColumn("notes", F.array_distinct("shown")).where(F.size("notes") >= 2))
    factor = lambda x: 1 + t.rebirth_search_boost / F.array_position("shown", x)  # noqa: E731  places from 1
    few = asked.where(F.size("notes") <= 8).withColumn("notes", F.array_sort("notes"))
    both = F.flatten(F.transform("notes", lambda a, i: F.transform(F.slice("notes", i + 2, F.size("notes")), lambda b: F.struct(a.alias("src"), b.alias("dst"), F.greatest(factor(a), factor(b)).alias("grows")))))
    pairs = few.select("id", F.explode(both).alias("p")).select("id", "p.*")
    learned = edges.where(F.col("kind").isin(*graph.LEARNED) & F.col("weight").isNotNull())
    known = learned.select("src", "dst", "kind")
    wired = pairs.select("src", "dst").distinct().withColumn("kind", F.lit("cooccur"))
    there = held(known.unionByName(wired).distinct())
    wide = asked.where(F.size("notes") > 8).select("id", F.explode(F.transform("notes", lambda x: F.struct(x.alias("note"), factor(x).alias("grows")))).alias("n")).select("id", "n.*")
    from_ = there.join(wide.withColumnRenamed("note", "src"), "src")
    reached = from_.join(wide.select("id", F.col("note").alias("dst"), F.col("grows").alias("grows_")), ["id", "dst"])
    change = lambda a, b: F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"), F.lit(cap).cast("double").alias("cap"))
    row = lambda df, n, f: df.select("src", "dst", "kind", "id", F.lit(n).alias("n"), f.alias("f"))
    grows, same = change(F.col("grows"), F.lit(0.0)), F.lit(1.0)
    # an edge of any kind that is learned grows in either direction that it is stored in
    ends = there.withColumns({"low": F.least("src", "dst"), "high": F.greatest("src", "dst")}).where("low <> high")
    met = ends.join(pairs.select("id", F.col("src").alias("low"), F.col("dst").alias("high"), "grows"), ["low", "high"])
    changes = row(pairs.withColumn("kind", F.lit("cooccur")), 0, change(same, F.lit(t.strengthen_step)))
    changes = changes.unionByName(row(met, 1, grows))
    changes = changes.unionByName(row(reached.withColumn("grows", F.greatest("grows", "grows_")), 1, grows))
    keys = ["src", "dst", "kind"]
    some = changes.groupBy(*keys, F.floor(F.col("id") / stretch).alias("part")).agg(_folded(F.array_sort(F.collect_list(F.struct("id", "n", "f")))).alias("f"))
    whole = some.groupBy(*keys).agg(_folded(F.array_sort(F.collect_list(F.struct("part", "f")))).alias("f"))
    out = edges.select(*keys, "weight").join(whole, keys, "full")
    # one that stands above the cap is left there by growth alone, and set to the cap by a step, as search by search
    new = F.least(F.col("f.cap"), F.col("f.a") * F.coalesce("weight", F.lit(0.0)) + F.col("f.b"))
    above = (F.col("weight") > cap) & (F.col("f.b") == 0)
    return out.select(*keys, F.when(F.col("f").isNull() | above, F.col("weight")).otherwise(new).alias("weight"))


def effects_after(log: DataFrame, usage: DataFrame, entities: DataFrame, edges: DataFrame, t: Tunables | None = None) -> dict[str, DataFrame]:
    """What the searches of log(id, ts, hit_ids, expand_ids) leave behind in usage, entities and edges, as search_effects() for each, in order of id."""
    shown = log.select("id", "ts", F.explode(F.concat(F.coalesce("hit_ids", F.array().cast("array<string>")), F.coalesce("expand_ids", F.array().cast("array<string>")))).alias("note_id"))
    used, seen = state.activated(usage, entities, shown.distinct().select("note_id", "ts"))
    return {"usage": used, "entities": seen, "edges": edges_after(edges, log, t)}


def related(notes: DataFrame, tags: DataFrame, entities: DataFrame, edges: DataFrame, vectors: DataFrame, texts: DataFrame, keywords: list[str], hints: list[str], t: Tunables | None = None, kind: str | None = None, groups: DataFrame | None = None) -> dict[str, DataFrame]:
    """The parts of an answer to a text: similar notes (by its keywords), linked ones, those near by vector that are neither, axes, top tags, tags
    that occur with those of similar notes, and notes of the entities it names. keywords and hints come from words_of()."""
    t = t or Tunables()
    similar = retrieval.search(notes, keywords, t.similar_limit, rows=texts)
    seeds = [r.id for r in similar.select("id").collect()]  # at most similar_limit
    e = edges if kind is None else edges.where(F.col("kind") == kind)
    g = groups if groups is None or kind is None else groups.where(F.col("kind") == kind)
    linked = graph.expand(e, similar.select("id"), max(1, t.expand_hops), 10, t, g) if t.expand_hops else similar.select("id", F.lit(0).alias("hop"), F.lit(0.0).alias("rank_weight")).limit(0)
    already = [r.id for r in linked.select("id").collect()]  # at most ten
    near = mining.vector_expand(vectors.join(notes.where(policy.fresh()).select("id"), "id", "left_semi"), seeds, t.similar_limit, already) if seeds else vectors.select("id", F.lit(0.0).alias("score")).limit(0)
    own = tags.join(similar.select("id"), "id", "left_semi").select("tag").distinct()
    pairs = relational.tag_cooccurrence(tags.join(tags.join(own, "tag", "left_semi").select("id").distinct(), "id", "left_semi"))
    return {
        "similar": retrieval.described(similar, notes, tags), "linked": linked, "vector_linked": near, "axes": notes.groupBy("axis").agg(F.count("*").alias("n")), "top_tags": relational.top_tags(tags),
        "cooccur": pairs.join(own.select(F.col("tag").alias("tag_a")), "tag_a", "left").select("tag_a", "tag_b", "n"), "entity_hits": relational.entity_hits(entities, notes, hints),
    }


def words_of(spark, said: str, limit: int = 15) -> tuple[list[str], list[str]]:
    """(keywords by frequency, entity hints) of one text."""
    one = spark.createDataFrame([(said,)], "text string")
    words = [r.word for r in retrieval.top_keywords(one, limit).collect()]
    return words, one.select(text.entity_hints(F.col("text"))).first()[0]


def structure(notes: DataFrame, edges: DataFrame, axis: str | None = None, groups: DataFrame | None = None) -> DataFrame:
    """part, name, n: notes by axis, edges by kind, edges by weight, the notes with most edges. Any two items of one of
    groups(key, item, kind, weight) have an edge, too, counted by sizes without making it; groups are for all axes only."""
    if groups is not None and axis is not None:
        raise ValueError("groups are counted over all axes only")
    n = notes if axis is None else notes.where(F.col("axis") == axis)
    e = edges
    if axis is not None:
        ids = n.select("id")
        e = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").unionByName(edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi"))
    row = lambda df, part, name, c: df.select(F.lit(part).alias("part"), F.col(name).cast("string").alias("name"), F.col(c).cast("long").alias("n"))
    kinds, weights, degrees = graph.distribution(e).select("kind", "n"), graph.histogram(e), graph.top_degree(e)
    if groups is not None:
        pairs, ends = graph.counted(groups)
        sums = lambda a, b, by: a.unionByName(b).groupBy(by).agg(F.sum("n").alias("n"))
        kinds, weights = sums(kinds, pairs.select("kind", "n"), "kind"), sums(weights, pairs.select(graph.bucket().alias("bucket"), "n"), "bucket")
        degrees = sums(e.select(F.explode(F.array("src", "dst")).alias("id"), F.lit(1).cast("long").alias("n")), ends, "id").orderBy(F.desc("n"), "id").limit(5).withColumnRenamed("n", "degree")
    parts = [row(n.groupBy("axis").agg(F.count("*").alias("n")), "axis", "axis", "n"), row(kinds, "kind", "kind", "n"), row(weights, "weight", "bucket", "n"), row(degrees, "degree", "id", "degree")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def split_report(notes: DataFrame, tags: DataFrame, dismissals: DataFrame, sections: DataFrame, generation: int, t: Tunables | None = None, limit: int = 20) -> DataFrame:
    """Split candidates that aren't dismissed, with their second-level sections and the words of each; gated first, then cut."""
    t = t or Tunables()
    found = relational.split_candidates(notes, tags, t.split_min_words, t.split_min_sections, t.split_min_tag_diversity, 1 << 30)
    shown = relational.habituated(found.select("id", "word_count", "section_count"), dismissals, generation, t.habituation_growth, t.habituation_words, t.habituation_sections)
    sketch = sections.where("level = 2").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ord", "title", text.word_count(F.col("text")).alias("words")))).alias("sketch"))
    out = found.join(shown.select("id"), "id", "left_semi").join(sketch, "id", "left")
    return out.orderBy(F.desc("word_count"), "id").limit(limit)


def homeostasis(windows: DataFrame, hits: DataFrame, now: int, watermark: int = -1, seen: int = 0, landed: int = 0, hops: int = 1, t: Tunables | None = None, least: int = 0, wild: int = 1) -> DataFrame:
    """One row: windows, seen, landed, sample_seen, sample_landed, evaluated, rate, hops, watermark after a tick over windows(id,
    started_at, ended_at) beyond the watermark, in order of id, up to the first that may still grow. Windows that began before the
    first get of all time don't count. Samples add up over ticks until there are enough; then they decide and begin anew."""
    t = t or Tunables()
    new = windows.where(F.col("id") > watermark)
    open_ = new.where(F.col("ended_at") >= now - t.window_gap_sec).agg(F.min("id").alias("open"))
    get = hits.where("cmd = 'get'").agg(F.min("ts").alias("first_get"))
    closed = new.crossJoin(F.broadcast(open_)).where("open is null or id < open")
    sighted = closed.crossJoin(F.broadcast(get)).where("started_at >= first_get").select(F.col("id").alias("window_id"))
    h = hits.join(sighted, "window_id", "left_semi")
    got = h.where("cmd = 'get'").groupBy("window_id", "note_id").agg(F.max("ts").alias("got"))
    shown = h.where("surface = 'expand' and cmd <> 'get'").join(got, ["window_id", "note_id"], "left")
    sums = shown.agg(F.count("*").alias("seen"), F.coalesce(F.sum((F.coalesce(F.col("got") >= F.col("ts"), F.lit(False))).cast("long")), F.lit(0)).alias("landed"))
    done = closed.agg(F.count("*").alias("windows"), F.coalesce(F.max("id"), F.lit(watermark)).alias("watermark"))
    s = done.crossJoin(sums).select("windows", "seen", "landed", (F.col("seen") + seen).alias("all_seen"), (F.col("landed") + landed).alias("all_landed"), "watermark")
    enough, rate = F.col("all_seen") >= t.homeostasis_min_sample, F.try_divide("all_landed", "all_seen")
    to = F.when(enough & (rate < t.homeostasis_low), max(least, hops - 1)).when(enough & (rate > t.homeostasis_high), min(wild, hops + 1) if hops < wild else hops).otherwise(hops)
    return s.select("windows", "seen", "landed", F.when(enough, 0).otherwise(F.col("all_seen")).cast("long").alias("sample_seen"), F.when(enough, 0).otherwise(F.col("all_landed")).cast("long").alias("sample_landed"), enough.alias("evaluated"), F.when(enough, rounded(rate)).alias("rate"), to.cast("int").alias("hops"), "watermark")


def derived(events: DataFrame, watermark: int, open_: DataFrame | None = None, gap: int = 900) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(windows(id, session_id, started_at, ended_at, queries), hits(window_id, ...), one row with the new watermark) of events beyond a watermark. open_(id,
    session_id, ended_at) holds each session's last window, which its next events may still join; the watermark passes malformed events, too."""
    new = events.where(F.col("id") > watermark)
    windows, hits = gathered(activity.windows_of(new, gap, watermark, open_))
    return windows, hits, new.agg(F.coalesce(F.max("id"), F.lit(watermark)).cast("long").alias("watermark"))


def gathered(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(windows, hits) as derived() has them, of events with their windows."""
    w = found.groupBy("session_id", "window").agg(F.coalesce(F.min("window_id"), F.min("id")).alias("id"), F.min_by("ts", "id").alias("started_at"), F.max("ts").alias("ended_at"), F.count("*").alias("queries"))
    h = activity.hits(found)
    named = w.select(F.col("session_id").alias("s_"), F.col("window").alias("w_"), F.col("id").alias("window_id"))
    h = h.join(named, h.session_id.eqNullSafe(named.s_) & (h.window == named.w_)).drop("s_", "w_", "window")
    return w.select("id", "session_id", "started_at", "ended_at", "queries"), h


def integrate(tables: dict[str, DataFrame], now: int, watermark: int = -1, t: Tunables | None = None) -> dict[str, DataFrame]:
    """The daily job over events, notes, axes, tags, vocabulary, flags, lifecycle, terms, edges, vectors, index: windows are derived before old
    events go; then vocabularies, flags, terms and reviews are put in order. Gives the new frames, and hits and windows."""
    t = t or Tunables()
    windows, hits, mark = derived(tables["events"], watermark, tables.get("open"), t.window_gap_sec)
    events = activity.retained(tables["events"], now, t.events_retention_days)
    flags = tables["flags"].where(F.col("resolved_at").isNull() | (F.col("resolved_at") >= now - 86400 * t.events_retention_days))
    raised = enrichment.review_flags(tables["edges"], tables["vectors"], now, t)
    terms = mutations.reject_pending(tables["terms"], now)
    axes = tables["axes"].join(state.empty_axes(tables["axes"], tables["notes"]), "axis", "left_anti")
    return {
        "windows": windows, "hits": hits, "watermark": mark, "events": events, "flags": enrichment.reviewed(flags, raised, tables["vectors"], now), "lifecycle": tables["lifecycle"].where(F.col("created_at") >= now - 86400 * t.lifecycle_retention_days),
        "terms": terms, "axes": axes, "vocabulary": tables["vocabulary"].join(relational.unused(tables["vocabulary"], tables["tags"]), "tag", "left_anti"), "index": indexing.refill(tables["index"], tables["notes"], tables["rows"])[0],
    }


def prune(edges: DataFrame, t: Tunables | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges after decay; one row: decayed, pruned)."""
    kept = graph.decay(edges, t)
    learned = edges.where(F.col("kind").isin(*graph.LEARNED)).agg(F.count("*").alias("decayed"))
    left = kept.where(F.col("kind").isin(*graph.LEARNED)).agg(F.count("*").alias("left_"))
    return kept, learned.crossJoin(left).select("decayed", (F.col("decayed") - F.col("left_")).alias("pruned"))


def logged_searches(events: DataFrame, limit: int) -> DataFrame:
    """query (the event's id), session_id, said, axis, n of the last `limit` searches among the last 4 * limit retrievals of events."""
    field = lambda k: F.get_json_object("payload", f"$.{k}")
    last = events.where("kind = 'retrieval'").orderBy(F.desc("id")).limit(4 * limit)
    found = last.select(F.col("id").alias("query"), "session_id", field("cmd").alias("cmd"), field("query").alias("said"), field("axis").alias("axis"), F.coalesce(field("limit").cast("int"), F.lit(5)).alias("n"))
    return found.where("cmd = 'search' and said <> ''").orderBy(F.desc("query")).limit(limit).drop("cmd")


def session_priors(events: DataFrame, notes: DataFrame, sessions: DataFrame, now: int, t: Tunables) -> DataFrame:
    """session_id, axis, prior of each of sessions(session_id), as axis_prior() has it for one."""
    e = events.where((F.col("ts") >= now - 60 * t.priming_window_min) & F.col("hit_ids").isNotNull()).join(sessions.where("session_id is not null").distinct(), "session_id", "left_semi")
    last = e.withColumn("nth", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("ts"), F.desc("id")))).where("nth <= 50")
    seen = last.select("session_id", F.explode("hit_ids").alias("id")).join(notes.select("id", "axis"), "id").groupBy("session_id", "axis").agg(F.count("*").alias("c"))
    all_ = seen.groupBy("session_id").agg(F.sum("c").alias("all_"))
    return seen.join(all_, "session_id").select("session_id", "axis", rounded(F.col("c") / F.col("all_")).alias("prior"))


def replayed(hits: DataFrame, log: DataFrame, priors: DataFrame, t: Tunables) -> DataFrame:
    """query, ids in order of what each of the logged searches shows: hits(query, id, axis, score), reranked where the session has priors."""
    primed = priors.select("session_id").distinct().withColumn("primed", F.lit(True))
    x = hits.join(log.select("query", "session_id", "n"), "query").join(primed, "session_id", "left").join(priors, ["session_id", "axis"], "left")
    pool = F.when(F.col("primed"), F.col("n") + F.least(2 * F.col("n"), F.lit(30))).otherwise(F.col("n"))
    x = x.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("score", "id")) - 1).where(F.col("rank") < pool).withColumn("size", F.count("*").over(Window.partitionBy("query")))
    boosted = rounded(F.col("size") - F.col("rank") + t.priming_alpha * F.coalesce("prior", F.lit(0.0)) * F.col("size"))
    x = x.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.when(F.col("primed"), boosted).otherwise(-F.col("rank"))), "rank"))).where("place <= n")
    shown = x.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda r: r["id"]).alias("ids"))
    return log.select("query").join(shown, "query", "left").select("query", F.coalesce("ids", F.array().cast("array<string>")).alias("ids"))


def shadow(events: DataFrame, notes: DataFrame, score, gene: str, value: float, now: int, t: Tunables | None = None, limit: int = 20) -> DataFrame:
    """query, said, baseline, candidate, entered, dropped (arrays of ids) of the last `limit` logged searches whose result another value of a
    tunable would change now. All searches are one plan: score gives query, id, section, score for their (query, term) (Index.bm25_of, or
    retrieval.bm25_of over passages), and best hits, priors and ranks are taken by query."""
    t = t or Tunables()
    other, log = replace(t, **{gene: type(getattr(t, gene))(value)}), graph.held(logged_searches(events, limit))
    asked = log.select("query", F.explode(text.query_tokens(F.col("said"))).alias("term"))
    best = score(asked).groupBy("query", "id").agg(F.min("score").alias("score"))
    hits = best.join(notes.where(policy.fresh()).select("id", F.col("axis").alias("own_")), "id").join(log.select("query", "axis"), "query").where("axis is null or axis = own_")
    hits = graph.held(hits.select("query", "id", F.col("own_").alias("axis"), "score"))
    parsed = activity.parsed(events)
    both = [replayed(hits, log, session_priors(parsed, notes, log.select("session_id"), now, x), x) for x in (t, other)]
    out = both[0].withColumnRenamed("ids", "baseline").join(both[1].withColumnRenamed("ids", "candidate"), "query").where("baseline <> candidate")
    return out.join(log.select("query", "said"), "query").select("query", "said", "baseline", "candidate", F.array_except("candidate", "baseline").alias("entered"), F.array_except("baseline", "candidate").alias("dropped"))
