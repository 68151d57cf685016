"""A log of operations applied to the tables: gates, conflicts between batches, then one plan for each table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.policy import GENES, UNDIRECTED, Tunables
from . import bodies, enrichment, graph, mutations, state
from .graph import held

#: What an operation needs: a live note `id`, a live note `other`, and how it touches rows: of the note as a whole, of a part that other batches may
#: not touch too, or by adding to what stands, which commutes. Keys name columns of the log or its arguments.
OPS = {
    "create_note": ((), [("note", "whole", ("id",))]), "restore": ((), [("note", "whole", ("id",))]), "delete_note": (("id",), [("note", "whole", ("id",))]),
    "migrate_note": (("id",), [("note", "whole", ("id",)), ("note", "whole", ("other",))]), "merge_notes": (("id", "other"), [("note", "whole", ("id",)), ("note", "whole", ("other",))]),
    "patch_section": (("id",), [("body", "set", ("id",))]), "rename_section": (("id",), [("body", "set", ("id",))]), "relocate_section": (("id", "other"), [("body", "set", ("id",)), ("body", "set", ("other",))]),
    "set_frontmatter": (("id",), [("head", "set", ("id",))]), "invalidate": (("id",), [("stale", "set", ("id",))]), "revalidate": (("id",), [("stale", "set", ("id",))]),
    "flag": (("id",), [("flag", "add", ("id", "flag"))]), "resolve_flag": (("id",), [("flag", "set", ("id", "flag"))]), "dismiss_candidate": ((), [("dismissal", "add", ("id", "kind"))]), "mark_used": (("id",), [("usage", "add", ("id",))]),
    "set_note_meta": (("id",), [("meta", "set", ("id", "namespace", "key"))]), "delete_note_meta": (("id",), [("meta", "set", ("id", "namespace", "key"))]), "add_retrieval_terms": (("id",), [("term", "add", ("id", "term"))]),
    "propose_link": (("id", "other"), [("edge", "add", ("id", "other"))]), "link_lineage": (("id", "other"), [("edge", "add", ("id", "other"))]), "purge_enrichment": ((), [("origin", "set", ("provenance",))]),
    "set_axis_description": ((), [("axis", "set", ("id",))]), "rename_axis": ((), [("axis", "set", ("id",)), ("axis", "set", ("other",))]), "rename_tag": ((), [("tag", "set", ("id",)), ("tag", "set", ("other",))]), "set_gene": ((), [("gene", "set", ("id",))]),
}
#: Operations on what isn't a note.
ELSEWHERE = ("purge_enrichment", "set_axis_description", "rename_axis", "rename_tag", "set_gene", "dismiss_candidate")
SETTABLE = ("title", "summary", "priority")


def touches(log: DataFrame) -> DataFrame:
    """batch, key, mode of the rows that each operation of log(batch, seq, op, id, other, args) changes. Operations on a note add to it as a whole,
    so that they go together with each other but not with one that makes, ends or moves it."""
    cell = lambda c: F.coalesce(F.col(c) if c in ("id", "other") else F.element_at("args", c), F.lit(""))
    row = lambda table, mode, key: F.struct(F.concat_ws("\x1f", F.lit(table), *map(cell, key)).alias("key"), F.lit(mode).alias("mode"))
    own = lambda op: [row(t, "set" if m == "whole" else m, k) for t, m, k in OPS[op][1]]
    part = lambda op: [row("note", "add", k) for k in {("id",), *([("other",)] if "other" in OPS[op][0] else [])}] if op not in ELSEWHERE and all(m != "whole" for _, m, _ in OPS[op][1]) else []
    which = reduce(lambda a, op: a.when(F.col("op") == op, F.array(*own(op), *part(op))), list(OPS)[1:], F.when(F.col("op") == "create_note", F.array(*own("create_note"))))
    return log.select("batch", F.explode(which).alias("t")).select("batch", "t.*").groupBy("batch", "key").agg(F.max(F.struct((F.col("mode") == "set").alias("x"), "mode")).alias("m")).select("batch", "key", F.col("m.mode").alias("mode"))


def gates(log: DataFrame, notes: DataFrame, edges: DataFrame, forbidden: DataFrame) -> DataFrame:
    """batch, error of operations that can't be taken up, whatever the others do. forbidden(axis, op): what the rules of an axis deny. A note made
    by an earlier operation of the batch counts as there."""
    known = notes.select("id", "axis", "locked")
    made = log.where("op in ('create_note', 'restore')").select("batch", "id", F.lit(True).alias("made")).unionByName(log.where("op = 'migrate_note'").select("batch", F.col("other").alias("id"), F.lit(True).alias("made"))).distinct()
    x = log.join(known, "id", "left").join(made, ["batch", "id"], "left")
    x = x.join(known.select(F.col("id").alias("other"), F.lit(True).alias("there"), F.col("locked").alias("other_locked")), "other", "left").join(made.select("batch", F.col("id").alias("other"), F.col("made").alias("other_made")), ["batch", "other"], "left")
    x = x.withColumn("rule_axis", F.coalesce("axis", F.element_at("args", "axis"))).join(F.broadcast(forbidden.select(F.col("axis").alias("rule_axis"), "op", F.lit(True).alias("no"))), ["rule_axis", "op"], "left")  # axes times operations
    asks = lambda side: F.col("op").isin(*[op for op, (need, _) in OPS.items() if side in need])
    inbound = edges.where(~F.col("kind").isin(*UNDIRECTED)).select(F.col("dst").alias("id"), F.col("src").alias("by")).unionByName(edges.where("kind = 'sibling'").select(F.explode(F.array(F.struct(F.col("dst").alias("id"), F.col("src").alias("by")), F.struct(F.col("src").alias("id"), F.col("dst").alias("by")))).alias("e")).select("e.*"))
    held_by = inbound.join(log.where("op = 'delete_note'").select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min("by").alias("blocker"))
    x = x.join(held_by, "id", "left")
    on_note, free = ~F.col("op").isin(*ELSEWHERE), F.col("made").isNull()
    valid = F.col("id").rlike("^[a-z0-9][a-z0-9-]*$")
    error = (
        F.when(~F.col("op").isin(*OPS), F.concat(F.lit("unknown operation: "), "op")).when(F.col("id").isNull() & (F.col("op") != "purge_enrichment"), "no id")
        .when(F.col("op").isin("create_note", "restore") & F.col("axis").isNotNull(), F.concat(F.lit("exists: "), "id")).when((F.col("op") == "create_note") & ~valid, F.concat(F.lit("invalid id: "), "id"))
        .when((F.col("op") == "migrate_note") & (F.col("there") | ~F.col("other").rlike("^[a-z0-9][a-z0-9-]*$")), F.concat(F.lit("can't become: "), "other"))
        .when(asks("id") & F.col("axis").isNull() & free, F.concat(F.lit("no such note: "), "id")).when(asks("other") & F.col("there").isNull() & F.col("other_made").isNull(), F.concat(F.lit("no such note: "), F.coalesce("other", F.lit("-"))))
        .when(on_note & F.coalesce("locked", F.lit(False)), F.concat(F.lit("locked: "), "id")).when(on_note & asks("other") & F.coalesce("other_locked", F.lit(False)), F.concat(F.lit("locked: "), "other"))
        .when(F.coalesce("no", F.lit(False)), "denied by the axis's rules").when((F.col("op") == "delete_note") & F.col("blocker").isNotNull(), F.concat(F.lit("referred to by: "), "blocker"))
        .when((F.col("op") == "set_frontmatter") & (F.size(F.array_except(F.map_keys("args"), F.array(*map(F.lit, SETTABLE)))) > 0), "field that can't be set")
    )
    return x.withColumn("error", error).where("error is not null").groupBy("batch").agg(F.min("error").alias("error"))


def conflicts(touched: DataFrame) -> DataFrame:
    """batch, error of the batches that touch a row in a way that an earlier one, itself taken up, rules out: as if batches came one after the
    other and each that meets a taken row were refused. A round takes up all batches that are the first of theirs at every row, and refuses those that these
    rule out; rows have two numbers each, so that one row of many batches makes no pairs."""
    t, refused = held(touched), None
    while True:
        x = F.col("mode") == "set"
        first = t.groupBy("key").agg(F.min("batch").alias("all_"), F.min(F.when(x, F.col("batch"))).alias("set_"))
        told = t.join(first, "key")
        ready = F.when(x, F.col("batch") == F.col("all_")).otherwise(F.col("set_").isNull() | (F.col("batch") < F.col("set_")))
        taken = held(told.groupBy("batch").agg(F.min(ready.cast("int")).alias("ok")).where("ok = 1").select("batch"))
        won = t.join(taken, "batch", "left_semi").groupBy("key").agg(F.max(x.cast("int")).alias("sets"), F.min("batch").alias("by"))
        lost = t.join(taken, "batch", "left_anti").join(won, "key").where(x | (F.col("sets") == 1)).groupBy("batch").agg(F.concat(F.lit("conflict with batch "), F.min("by").cast("string")).alias("error"))
        lost = held(lost)
        refused = lost if refused is None else refused.unionByName(lost)
        # rows that adding batches have taken are still closed to those that set them
        t = held(t.join(taken, "batch", "left_anti").join(lost.select("batch"), "batch", "left_anti"))
        if t.isEmpty():
            return refused


def apply(tables: dict[str, DataFrame], log: DataFrame, now: int, forbidden: DataFrame | None = None, t: Tunables | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """(the tables after log(batch, seq, op, id, other, args: map of texts); batch, error of refused batches). A batch is applied whole or not
    at all. Batches that are applied commute; in a batch operations take effect by kind, in the order of this function, and by seq within a kind.

    Tables: notes(id, axis, title, summary, priority, body, stale, locked, ...), tags(id, tag), edges, flags, terms, meta, usage, dismissals, axes, entities,
    values, gene_log, trash. Those an operation doesn't change come back as they are."""
    t, out = t or Tunables(), dict(tables)
    spark = log.sparkSession
    forbidden = spark.createDataFrame([], "axis string, op string") if forbidden is None else forbidden
    log = held(log.select("batch", "seq", "op", "id", "other", "args"))
    refused = held(gates(log, out["notes"], out["edges"], forbidden))
    left = log.join(refused.select("batch"), "batch", "left_anti")
    moves = left.where("op = 'relocate_section'").select("batch", "seq", F.col("id").alias("src"), F.col("other").alias("dst"), F.element_at("args", "section").alias("section"))
    arg = lambda k: F.element_at("args", k)
    action = F.when(F.col("op") == "rename_section", "rename").otherwise(arg("action"))
    plain = left.where("op in ('patch_section', 'rename_section')").select("batch", "id", "seq", action.alias("action"), arg("section").alias("section"), arg("content").alias("content"), F.coalesce(arg("subtree") == "true", F.lit(False)).alias("subtree"))
    edits = held(plain.unionByName(bodies.relocations(out["notes"], moves)))
    born = left.where("op = 'create_note'").select("batch", "id", arg("body").alias("body"))
    standing = out["notes"].select("id", "body", "locked").unionByName(born.select("id", "body", F.lit(False).alias("locked")).join(out["notes"].select("id"), "id", "left_anti").dropDuplicates(["id"]))
    wrong = bodies.failing(standing, edits) if not edits.isEmpty() else refused.limit(0)
    refused = held(refused.unionByName(wrong.select("batch", "error")))
    left = left.join(refused.select("batch"), "batch", "left_anti")
    if not left.isEmpty():
        refused = refused.unionByName(conflicts(touches(left)))
    refused = held(refused.groupBy("batch").agg(F.min("error").alias("error")))
    done = held(log.join(refused.select("batch"), "batch", "left_anti"))
    kinds = {r.op for r in done.select("op").distinct().collect()}  # names of operations
    some = lambda *names: done.where(F.col("op").isin(*names)) if kinds & set(names) else None
    ts = F.lit(now).cast("long")
    pairs = lambda x, a="old", b="new": x.select(F.col("id").alias(a), F.col("other").alias(b))
    empty = lambda name: F.lit(None).cast(dict(out["notes"].dtypes)[name]).alias(name)

    if (x := some("restore")) is not None:
        out["notes"] = bodies.restored(out["notes"], out["trash"], x.select("id"))
    if (x := some("create_note")) is not None:
        cells = {"id": F.col("id"), "axis": arg("axis"), "title": arg("title"), "summary": F.coalesce(arg("summary"), F.lit("")), "body": F.coalesce(arg("body"), F.lit("")), "priority": F.coalesce(arg("priority"), F.lit("lazy")), "stale": F.lit(False), "locked": F.lit(False)}
        out["notes"] = out["notes"].unionByName(x.select(*[cells[c].alias(c) if c in cells else empty(c) for c in out["notes"].columns]))
        out["tags"] = out["tags"].unionByName(x.select("id", F.explode(F.split(F.coalesce(arg("tags"), arg("axis")), ",")).alias("tag")).distinct())
        out["usage"] = out["usage"].unionByName(x.select(F.col("id").alias("note_id"), F.lit(0).cast("long").alias("hit_count"), F.lit(None).cast("long").alias("last_retrieved_at"), ts.alias("created_at")))
        out["axes"] = state.ensure_axes(out["axes"], x.groupBy(arg("axis").alias("axis")).agg(F.max(arg("axis_description")).alias("description")), now)
    mine = edits.join(done.select("batch").distinct(), "batch", "left_semi")
    if kinds & {"patch_section", "rename_section", "relocate_section"}:
        out["notes"] = bodies.edited(out["notes"], mine).drop("error")
    if (x := some("set_frontmatter")) is not None:
        last = x.groupBy("id").agg(*[F.max_by(arg(c), F.when(arg(c).isNotNull(), F.col("seq"))).alias(f"new_{c}") for c in SETTABLE])
        out["notes"] = out["notes"].join(last, "id", "left").select(*[F.coalesce(f"new_{c}", c).alias(c) if c in SETTABLE else F.col(c) for c in out["notes"].columns])
    if (x := some("invalidate", "revalidate")) is not None:
        last = x.groupBy("id").agg(F.max_by("op", "seq").alias("op"))
        out["flags"] = mutations.flag(out["flags"], mutations.referrers(out["edges"], last.where("op = 'invalidate'"), "stale", now))
        out["notes"] = mutations.marked(mutations.marked(out["notes"], last.where("op = 'invalidate'")), last.where("op = 'revalidate'"), False)
    if (x := some("flag")) is not None:
        out["flags"] = mutations.flag(out["flags"], x.select(F.col("id").alias("note_id"), arg("flag").alias("flag"), F.coalesce(arg("reason"), F.lit("")).alias("reason"), ts.alias("ts")))
    if (x := some("resolve_flag")) is not None:
        out["flags"] = mutations.resolve(out["flags"], x.select(F.col("id").alias("note_id"), arg("flag").alias("flag"), ts.alias("ts")))
    if (x := some("dismiss_candidate")) is not None:
        shape = {"word_count": "long", "section_count": "long", "generation": "int"}
        asked = x.select(F.col("id").alias("key"), arg("kind").alias("kind"), *[arg(c).cast(k).alias(c) for c, k in shape.items()], F.coalesce(arg("reason"), F.lit("")).alias("reason"), ts.alias("ts"))
        out["dismissals"] = state.dismissed(out["dismissals"], asked)
    if (x := some("mark_used")) is not None:
        none = out["entities"].select("entity", F.col("id").alias("note_id"), "last_seen_at", F.lit(0).alias("hit_count")).limit(0)
        out["usage"] = state.activated(out["usage"], none, x.select(F.col("id").alias("note_id"), ts.alias("ts")))[0]
    if (x := some("set_note_meta", "delete_note_meta")) is not None:
        value = F.when(F.col("op") == "set_note_meta", arg("value"))
        last = x.groupBy(F.col("id").alias("note_id"), arg("namespace").alias("namespace"), arg("key").alias("key")).agg(F.max_by(F.struct(value.alias("v")), "seq").alias("x"))
        out["meta"] = mutations.set_meta(out["meta"], last.select("note_id", "namespace", "key", F.col("x.v").alias("value"), ts.alias("updated_at")))
    if (x := some("add_retrieval_terms")) is not None:
        new = mutations.add_terms(out["terms"].select("note_id", "kind", "term", "status", "created_at", "reject_reason"), x.select(F.col("id").alias("note_id"), F.coalesce(arg("kind"), F.lit("alias")).alias("kind"), arg("term").alias("term"), ts.alias("created_at")))
        more = [c for c in out["terms"].columns if c not in new.columns]
        out["terms"] = new.join(out["terms"].select("note_id", "kind", "term", *more), ["note_id", "kind", "term"], "left").select(out["terms"].columns)
    if (x := some("propose_link")) is not None:
        new = mutations.propose(out["edges"], x.select(F.col("id").alias("src"), F.col("other").alias("dst"), arg("confidence").cast("double").alias("confidence")), t)
        out["edges"] = _kept(new, out["edges"])
    if (x := some("link_lineage")) is not None:
        out["edges"] = _kept(mutations.lineage(out["edges"], x.select(F.col("id").alias("src"), F.col("other").alias("dst"), F.coalesce(arg("kind"), F.lit("supersedes")).alias("kind"))), out["edges"])
    if (x := some("purge_enrichment")) is not None:
        for origin in [r.o for r in x.select(arg("provenance").alias("o")).distinct().collect()]:  # names of origins
            out["terms"], out["edges"] = enrichment.purge(out["terms"], out["edges"], origin)
    if (x := some("set_axis_description")) is not None:
        out["axes"] = state.describe_axes(out["axes"], x.groupBy(F.col("id").alias("axis")).agg(F.max_by(arg("description"), "seq").alias("description")))
    if (x := some("rename_tag")) is not None:
        out["tags"] = mutations.renamed(out["tags"], "tag", pairs(x))
    if (x := some("rename_axis")) is not None:
        for name in ("notes", "axes"):
            out[name] = mutations.renamed(out[name], "axis", pairs(x))
        out["tags"] = mutations.renamed(out["tags"], "tag", pairs(x))
    if (x := some("set_gene")) is not None:
        asked = x.groupBy(F.col("id").alias("gene")).agg(F.max_by(F.struct(arg("value").cast("double").alias("v")), "seq").alias("x"), F.lit("op").alias("cause")).select("gene", F.col("x.v").alias("value"), "cause")
        out["values"], log_, _ = state.set_genes(out["values"], out["gene_log"], state.genes(spark, GENES), asked, now)
        out["gene_log"] = log_
    if (x := some("migrate_note")) is not None:
        m = pairs(x)
        out |= _renamed(out, m)
        axis = x.select(F.col("other").alias("id"), arg("axis").alias("axis_"))
        out["notes"] = out["notes"].join(axis, "id", "left").select(*[F.coalesce("axis_", "axis").alias("axis") if c == "axis" else F.col(c) for c in out["notes"].columns])
    if (x := some("merge_notes")) is not None:
        out |= merged(out, pairs(x), now)
    if (x := some("delete_note")) is not None:
        out["notes"], out["trash"] = bodies.deleted(out["notes"], out["trash"], x.select("id"), now)
    if kinds & {"delete_note", "merge_notes"}:
        ids = out["notes"].select("id")
        out |= state.cascade({k: out[k] for k in ("flags", "terms", "meta", "usage") if k in out}, out["notes"])
        out |= {k: out[k].join(ids, "id", "left_semi").select(out[k].columns) for k in ("tags", "entities")}
        out["edges"] = out["edges"].join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(out["edges"].columns)
    return out, refused


def _kept(new: DataFrame, old: DataFrame) -> DataFrame:
    """new(src, dst, kind, weight) with the other columns of old where the edge was there."""
    more = [c for c in old.columns if c not in ("src", "dst", "kind", "weight")]
    return new.join(old.select("src", "dst", "kind", *more), ["src", "dst", "kind"], "left").select(old.columns) if more else new


def _renamed(tables: dict[str, DataFrame], moves: DataFrame) -> dict[str, DataFrame]:
    """The tables in which notes have the new ids of moves(old, new)."""
    m = moves.select(F.col("old").alias("o_"), F.col("new").alias("n_"))

    def column(df: DataFrame, c: str) -> DataFrame:
        return df.join(m.withColumnRenamed("o_", c), c, "left").withColumn(c, F.coalesce("n_", c)).select(df.columns)

    found = {k: column(tables[k], "id") for k in ("notes", "tags", "entities")} | {k: column(tables[k], "note_id") for k in ("flags", "terms", "meta", "usage")}
    return found | {"edges": graph.canonical(column(column(tables["edges"], "src"), "dst"))}


def merged(tables: dict[str, DataFrame], moves: DataFrame, now: int) -> dict[str, DataFrame]:
    """All tables after notes were merged, moves(old, new): what hangs on old goes to new by the rules of each table, bodies follow each other
    by id, metadata of new stays where both have a key, tags and entities are united, edges move, old ones go to the trash."""
    t = tables
    came = t["notes"].join(moves.select(F.col("old").alias("id"), "new"), "id").groupBy("new").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "body"))), lambda x: x["body"]), "\n").alias("more_"))
    n = t["notes"].join(came.withColumnRenamed("new", "id"), "id", "left").withColumn("body", F.when(F.col("more_").isNull(), F.col("body")).otherwise(F.concat_ws("\n", "body", "more_"))).select(t["notes"].columns)
    notes, trash = bodies.deleted(n, t["trash"], moves.select(F.col("old").alias("id")), now)
    to = lambda df, c: df.join(moves.withColumnRenamed("old", c), c, "left").withColumn("own_", F.col("new").isNull()).withColumn(c, F.coalesce("new", c)).drop("new")
    rest = [c for c in t["meta"].columns if c not in ("note_id", "namespace", "key")]
    meta = to(t["meta"], "note_id").groupBy("note_id", "namespace", "key").agg(F.max_by(F.struct(*rest), F.struct("own_", *rest)).alias("x")).select("note_id", "namespace", "key", "x.*")
    seen = to(t["entities"], "id").groupBy("entity", "id").agg(F.max("last_seen_at").alias("last_seen_at"))
    d = t["dismissals"].withColumnRenamed("key", "note_id")
    edges = graph.redirect(t["edges"], moves)
    return {
        "notes": notes, "trash": trash, "meta": meta.select(t["meta"].columns), "entities": seen, "tags": to(t["tags"], "id").select("id", "tag").distinct(), "usage": mutations.absorb_usage(t["usage"], moves).select(t["usage"].columns),
        "terms": mutations.absorb_terms(t["terms"], moves).select(t["terms"].columns), "flags": mutations.absorb_flags(t["flags"], moves), "dismissals": mutations.absorb_dismissals(d, moves).withColumnRenamed("note_id", "key").select(t["dismissals"].columns),
        "edges": _kept(edges, t["edges"]),
    }
