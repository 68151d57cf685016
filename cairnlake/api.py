"""The commands as methods of one object over a set of frames.

Tables (only those that a command needs must be there): notes, tags, entities, edges, passages, index, vectors, events, axes, vocabulary, aliases,
meta, lifecycle, flags, terms, dismissals, sources, rulesets, genes, gene_log, values. Commands that change something return the new
frames by name; commit() of sources.corpus writes them."""

from __future__ import annotations

from dataclasses import fields, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import policy, rulesets, templates, text
from .functions.policy import GENES, Tunables
from .operators import activity, bodies, enrichment, graph, indexing, jobs, lint, mining, neighbors, oplog, relational, retrieval, rules, spectral, state
from .operators.nearest import nearest_vectors
from .operators.postings import Index
from .operators.sections import sections, within
from .sources import corpus

#: Operations that a batch may hold, and which of their fields name notes or axes; fixed values.
OPERATIONS = {
    "create_note": {"axis": ("axis",)}, "patch_section": {"id": ("id",)}, "set_frontmatter": {"id": ("id",)}, "rename_section": {"id": ("id",)}, "invalidate": {"id": ("id",)}, "revalidate": {"id": ("id",)},
    "rebase_source": {"id": ("id",)}, "flag": {"id": ("id",)}, "resolve_flag": {"id": ("id",)}, "dismiss_candidate": {"id": ("id",)}, "mark_used": {"id": ("ids",)}, "set_gene": {}, "set_note_meta": {"id": ("id",)}, "delete_note_meta": {"id": ("id",)},
    "restore": {"id": ("id",)}, "delete_note": {"id": ("id",)}, "set_axis_description": {"axis": ("axis",)}, "migrate_note": {"id": ("from", "to"), "axis": ("axis",)}, "rename_axis": {"axis": ("from", "to")}, "rename_tag": {},
    "relocate_section": {"id": ("from", "to")}, "split_note": {"id": ("from",)}, "merge_notes": {"id": ("from", "into")}, "add_retrieval_terms": {"id": ("id",)}, "propose_link": {"id": ("src", "dst")}, "purge_enrichment": {}, "link_lineage": {"id": ("src", "dst")},
}
#: Frontmatter that may be set; fixed values.
SETTABLE = ("title", "summary", "priority", "tags", "entities", "source")


def mentioned(op: dict) -> tuple[list[str], list[str]]:
    """(ids, axes) that an operation names, by the roles of its fields."""
    roles = OPERATIONS.get(op.get("op", ""), {})
    flat = lambda role: [x for f in roles.get(role, ()) if op.get(f) for x in (op[f] if isinstance(op[f], list) else [op[f]])]
    return flat("id"), flat("axis")


def refused(op: dict, locked: set[str], axis_policy: rulesets.Policy | None = None) -> str | None:
    """Why an operation can't be taken up: unknown, on a locked note, or against the axis's rules; null if it can."""
    if op.get("op") not in OPERATIONS:
        return "unknown operation"
    if op["op"] == "set_frontmatter" and set(op.get("fields", {})) - set(SETTABLE):
        return f"fields that can't be set: {sorted(set(op['fields']) - set(SETTABLE))}"
    if hit := sorted(locked & set(mentioned(op)[0])):
        return f"locked: {', '.join(hit)}"
    if axis_policy and not axis_policy.allows(op["op"]):
        return "denied by the axis's rules"
    return None


class Library:
    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], tunables: Tunables | None = None, index: Index | None = None) -> None:
        self.spark, self.tables, self.t, self.index = spark, tables, tunables or Tunables(), index

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise KeyError(f"this command needs the table {name}")
        return self.tables[name]

    # -- query

    def axes(self) -> DataFrame:
        return relational.axis_counts(self["axes"], self["notes"])

    def search(self, said: str, limit: int = 5, expand: int = 0, raw: bool = False, prior: DataFrame | None = None, session: str | None = None, now: int | None = None, **filters: object) -> dict[str, DataFrame]:
        """found (with tags and marks), and extra: notes one step away. filters: axis, exclude, include_stale, since. With a session and a time
        the axes of its last events come first; with a time the search leaves effects: the new usage, entities and edges, and an event."""
        how = filters | {"rows": self.tables.get("passages"), "index": self.index}
        words = said if raw else self.spark.createDataFrame([(said,)], "q string").select(text.query_tokens(F.col("q"))).first()[0]
        if prior is None and session and now is not None:
            prior = retrieval.axis_prior(activity.parsed(self["events"]), self["notes"], now, session, self.t)
            prior = None if prior.isEmpty() else prior
        if prior is not None:
            found = retrieval.primed_search(self["notes"], words, prior, limit, self.t, **how)
            order = [F.desc("boosted"), "score", "id"]
        else:
            found = (retrieval.search_raw if raw else retrieval.search)(self["notes"], words, limit, **how)
            order = ["score", "id"]
        extra = graph.expand(self["edges"], found.select("id"), 1, expand, self.t) if expand else found.select("id", F.lit(0.0).alias("rank_weight")).limit(0)
        out = {"found": retrieval.described(found, self["notes"], self["tags"], self.tables.get("sources")), "extra": extra}
        if now is not None:
            rank = lambda df, by: df.select("id", (F.row_number().over(Window.orderBy(*by)) - 1).alias("rank"))  # noqa: E731  the few notes that are shown
            usage = self.tables.get("usage", self["notes"].select(F.col("id").alias("note_id"), "hit_count", "last_retrieved_at"))
            seen = self["entities"].select("entity", F.col("id").alias("note_id"), "last_seen_at", (F.col("hit_count") if "hit_count" in self["entities"].columns else F.lit(1)).cast("long").alias("hit_count"))
            out["effects"] = jobs.search_effects(rank(found, order), rank(extra, [F.desc("rank_weight"), "id"]), usage, seen, self["edges"], now, said, session, self.t)
        return out

    def related(self, said: str, kind: str | None = None) -> dict[str, DataFrame]:
        words, hints = jobs.words_of(self.spark, said)
        return jobs.related(self["notes"], self["tags"], self["entities"], self["edges"], self["vectors"], self["passages"], words, hints, self.t, kind)

    def get(self, ids: list[str], section: str | None = None, toc: bool = False, words: int | None = None) -> DataFrame:
        """Bodies in the order asked for; or one section of each, the sections, or as much as the budget of words holds."""
        found = state.bodies_of(self["notes"], ids)
        if section is not None:
            return bodies.pieces(self["notes"], found.where("not missing").select("id", F.lit(section).alias("section")))
        if words is not None:
            return within(found.where("not missing"), words)
        if toc:
            return sections(found.where("not missing").select("id", "body")).select("id", "path", "level", text.word_count(F.col("text")).alias("words"))
        return found

    def template(self, id_: str) -> str:
        """An empty body by the template of that id."""
        row = self["notes"].where(F.col("id") == id_).select("body").first()
        if row is None:
            raise KeyError(id_)
        return templates.scaffold(templates.headings(row.body))

    def meta(self, ids: list[str] | None = None, namespace: str | None = None, key: str | None = None, value: str | None = None) -> DataFrame:
        return state.meta_by_value(self["meta"], namespace or "", key or "", value) if ids is None else state.meta_of(self["meta"], ids, namespace)

    def entity(self, name: str | None = None, limit: int = 20) -> DataFrame:
        if name is not None:
            return relational.entity_lookup(self["entities"], self["notes"], name, limit)
        return self["entities"].orderBy(F.desc("last_seen_at"), "entity", "id").limit(limit)

    def structure(self, axis: str | None = None) -> DataFrame:
        return jobs.structure(self["notes"], self["edges"], axis)

    def neighbors(self, id_: str, k: int = 10) -> DataFrame:
        anchors = self.spark.createDataFrame([(id_,)], "id string")
        return neighbors.composite(self["index"], self["notes"], self["entities"], self["edges"], anchors, k, self.t)

    def stats(self, now: int, axis: str | None = None, id_: str | None = None) -> DataFrame:
        if id_ is not None:
            return relational.note_stats(self["notes"].where(F.col("id") == id_), self["tags"], self["entities"], now)
        return relational.overall_stats(self["notes"]) if axis is None else relational.axis_stats(self["notes"].where(F.col("axis") == axis))

    def list(self, **how: object) -> DataFrame:
        return relational.listing(self["notes"], **how)

    def history(self, id_: str, limit: int = 20) -> DataFrame:
        return state.history(self["lifecycle"], id_, limit)

    def enrichment(self) -> DataFrame:
        return enrichment.status(self["terms"], self["edges"], self["notes"], self["vectors"], self["flags"], self.t)

    def lint(self, generation: int = 0, code: str | None = None, severity: str | None = None, limit: int | None = None) -> DataFrame:
        found = lint.lint_notes(self["notes"], self.t.oversized_words).select("subject", "code", "severity", F.lit("note").alias("scope"), F.lit(None).cast("string").alias("detail"))
        warn = lambda df, scope, detail=None: df.select("subject", "code", F.when(F.col("code").isin(*lint.ERRORS), "error").otherwise("warn").alias("severity"), F.lit(scope).alias("scope"), (F.col(detail) if detail else F.lit(None)).cast("string").alias("detail"))
        for part in (warn(lint.lint_tags(self["notes"], self["tags"]), "note"), warn(lint.lint_documents(self["notes"]).withColumn("line", F.concat(F.lit("line "), F.col("line").cast("string"))), "document", "line"), warn(rules.fragmentation(self["notes"], self["edges"], self["entities"], self["tags"]), "corpus"), warn(lint.template_drift(self["notes"]), "note", "detail")):
            found = found.unionByName(part)
        return state.lint_findings(found, self["dismissals"], self["notes"], generation, code, severity, limit)

    # -- ops

    def denied(self, operations: DataFrame) -> DataFrame:
        """operations(batch, op, id) with error of those that a lock or the rules of the note's axis forbid; notes that don't exist pass."""
        axes = [r.axis for r in self["notes"].join(operations.select("id").distinct(), "id", "left_semi").select("axis").distinct().collect()]  # at most the axes
        if "rulesets" in self.tables:
            rules = {a: self.effective(a) for a in axes}
            no = [(a, op) for a, p in rules.items() for op in OPERATIONS if not p.allows(op)]
        else:
            no = []
        forbidden = F.broadcast(self.spark.createDataFrame(no, "axis string, op string").withColumn("no_", F.lit(True)))  # axes times operations
        known = operations.join(self["notes"].select("id", "axis", "locked"), "id").join(forbidden, ["axis", "op"], "left")
        error = F.when(F.col("locked"), F.concat(F.lit("locked: "), "id")).when(F.col("no_"), "denied by the axis's rules")
        return known.withColumn("error", error).where("error is not null").select("batch", "error")

    def apply(self, requests: DataFrame, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
        """(notes after batches of section edits, refused ones); a dry run returns the notes as they are. A batch with an operation that a
        lock or the rules of an axis forbid is refused whole."""
        op = F.when(F.col("action") == "rename", "rename_section").otherwise("patch_section")
        no = self.denied(requests.select("batch", "id", op.alias("op"))).groupBy("batch").agg(F.min("error").alias("error"))
        new, bad = bodies.transaction(self["notes"], requests.join(no.select("batch"), "batch", "left_anti"))
        return (self["notes"] if dry_run else new), no.unionByName(bad.select("batch", "error"))

    def run(self, log: DataFrame, now: int, dry_run: bool = False) -> tuple[dict[str, DataFrame], DataFrame]:
        """(tables after a log of operations(batch, seq, op, id, other, args), refused batches with their error): see operators.oplog. Rules of axes
        are asked; a dry run gives the tables as they are. Searches after it need Index.upsert() of the notes that changed."""
        axes = [r.axis for r in self["notes"].select("axis").distinct().collect()] + [r.axis for r in log.select(F.element_at("args", "axis").alias("axis")).distinct().collect() if r.axis]
        rules = {a: self.effective(a) for a in sorted(set(axes))} if "rulesets" in self.tables else {}
        no = [(a, op) for a, p in rules.items() for op in oplog.OPS if not p.allows(op)]  # axes times operations
        tables, refused = oplog.apply(self.tables, log, now, self.spark.createDataFrame(no, "axis string, op string"), self.t)
        return (self.tables if dry_run else tables), refused

    def create(self, notes: DataFrame, now: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(notes with new ones, edges with links to those of like tags, errors); ids that exist or don't fit are refused, names of tags made canonical."""
        known = self["notes"].select("id", F.lit(True).alias("here"))
        n = notes.join(known, "id", "left").withColumn("error", F.when(F.col("here"), "exists").when(~F.col("id").rlike("^[a-z0-9][a-z0-9-]*$"), "invalid id"))
        good = n.where("error is null").drop("here", "error")
        t = state.canonical_tags(good.select("id", F.posexplode("tags").alias("pos", "tag")), self["aliases"]).select("id", "tag")
        best = neighbors.tag_neighbors(t, self["tags"].select("id", "tag").unionByName(t))
        seeds = best.select(F.least("id", "other").alias("src"), F.greatest("id", "other").alias("dst"), F.lit("assoc").alias("kind"), F.col("jaccard").alias("weight")).groupBy("src", "dst", "kind").agg(F.max("weight").alias("weight"))
        edges = self["edges"].select("src", "dst", "kind", "weight")
        more = [F.lit(None).cast(dict(self["notes"].dtypes)[c]).alias(c) for c in self["notes"].columns if c not in good.columns]
        return self["notes"].unionByName(good.select("*", *more).select(self["notes"].columns)), edges.unionByName(seeds.join(edges, ["src", "dst", "kind"], "left_anti")), n.where("error is not null").select("id", "error")

    def set_frontmatter(self, changes: DataFrame) -> DataFrame:
        """notes with changes(id, title, summary, priority): null fields stay."""
        cells = [c for c in SETTABLE if c in changes.columns and c in self["notes"].columns]
        new = changes.select("id", *[F.col(c).alias(f"new_{c}") for c in cells])
        return self["notes"].join(new, "id", "left").select(*[F.coalesce(f"new_{c}", c).alias(c) if c in cells else F.col(c) for c in self["notes"].columns])

    def vocab(self) -> DataFrame:
        return self["vocabulary"].join(self["tags"].groupBy("tag").agg(F.count("*").alias("n")), "tag", "left").select("tag", F.coalesce("n", F.lit(0)).alias("n")).orderBy("tag")

    def describe(self, op: str | None = None) -> DataFrame:
        """op, role, field of operations."""
        rows = [(o, role, f) for o, roles in OPERATIONS.items() if op in (None, o) for role, names in (roles or {"": ("",)}).items() for f in names]
        return self.spark.createDataFrame(rows, "op string, role string, field string")

    # -- index

    def build(self, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        return indexing.build(self["notes"], corpus.parse(corpus.scan(self.spark, root)))

    def vector(self, dim: int = 48) -> DataFrame:
        m = neighbors.weight_matrix(self["edges"], self["tags"])
        return spectral.symmetric_svd(graph.ppmi(m.select(F.col("i").alias("src"), F.col("j").alias("dst"), F.lit("m").alias("kind"), F.col("m").alias("weight"))), dim)

    def verify_integrity(self, files: DataFrame, level: int = 3) -> DataFrame:
        shape = {k: set(v.columns) for k, v in self.tables.items()}
        return indexing.integrity(shape, {"notes": {"id", "axis", "path", "content_hash"}, "tags": {"id", "tag"}, "index": {"id"}}, self["notes"], files, self["index"], self["tags"], self["vocabulary"], self["axes"], level)

    def verify_sources(self, declared: DataFrame, files: DataFrame) -> DataFrame:
        return state.verify_sources(self["sources"], state.source_fingerprints(declared, files))

    def verify_terms(self, now: int) -> DataFrame:
        waiting = self["terms"].where("status = 'pending'")
        known = self["vocabulary"].select(F.col("tag").alias("word")).unionByName(self["entities"].select(F.col("entity").alias("word")))
        checked = enrichment.word_check(waiting, self["index"], self["notes"], known, self.t)
        return enrichment.validated(self["terms"], checked, enrichment.round_trips(checked.where("verdict = 'ok'"), self["index"], self["notes"], self.t), now)

    # -- consolidate

    def integrate(self, now: int, watermark: int = -1) -> dict[str, DataFrame]:
        return jobs.integrate({**self.tables, "events": activity.parsed(self["events"]), "rows": retrieval.index_rows(self["passages"])}, now, watermark, self.t)

    def homeostasis(self, now: int, **kept: int) -> DataFrame:
        windows, hits, _ = jobs.derived(activity.parsed(self["events"]), -1, None, self.t.window_gap_sec)
        return jobs.homeostasis(windows, hits, now, hops=self.t.expand_hops, t=self.t, **kept)

    def prune(self) -> tuple[DataFrame, DataFrame]:
        return jobs.prune(self["edges"], self.t)

    def report(self) -> dict[str, DataFrame]:
        return {"axes": relational.axis_sizes(self["notes"]), "rare_tags": relational.rare_tags(self["tags"]), "unused_tags": relational.unused(self["vocabulary"], self["tags"])}

    def candidates(self, kind: str, generation: int = 0, limit: int = 20) -> DataFrame:
        n = self["notes"]
        if kind == "split":
            return jobs.split_report(n, self["tags"], self["dismissals"].withColumnRenamed("key", "id").where("kind = 'split'"), sections(n.select("id", "body")), generation, self.t, limit)
        if kind in ("reconsolidate", "ripple", "enrich_review"):
            return state.flag_queue(self["flags"], n, "stale_ref" if kind == "ripple" else kind, limit)
        if kind == "cluster":
            return neighbors.clusters(self["edges"], self["entities"], n, self.t.cluster_max_size).limit(limit)
        if kind == "near_duplicate":
            kept = n.where(policy.fresh() & policy.forgettable())
            pairs = mining.near_duplicates(kept.select("id", F.concat_ws(" ", "title", "summary", "body").alias("body")))
            anchors = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
            found = neighbors.near_duplicates_ranked(pairs, neighbors.composite(self["index"], n, self["entities"], self["edges"], anchors, 3, self.t))
            return found.orderBy(F.desc("fts"), "a", "b").limit(limit)
        if kind == "missing_edge":
            kept = n.where(policy.fresh() & policy.not_eager())
            lonely = kept.join(neighbors.degrees(self["edges"], n), "id", "left_anti").select("id")
            v = self["vectors"].join(neighbors.connected(self["edges"], n), "id", "left_semi").withColumn("vec", F.slice("vec", 2, F.greatest(F.size("vec") - 1, F.lit(1))))
            return neighbors.missing_edges(nearest_vectors(v, self.t.missing_edge_vec_cos), neighbors.by_text(self["index"], n, lonely, 3, self.t.missing_edge_bm25), self["edges"], n, limit)
        raise ValueError(f"unknown kind of candidate: {kind}")

    # -- genome, rulesets

    def genes(self) -> DataFrame:
        return state.gene_list(state.genes(self.spark, GENES), self["values"])

    def gene_history(self, gene: str | None = None, limit: int = 20) -> DataFrame:
        return state.gene_history(self["gene_log"], gene, limit)

    def shadow(self, gene: str, value: float, limit: int = 20, now: int | None = None) -> DataFrame:
        """What logged searches would show under another value; now: null: the time of the last event."""
        wild, least, most, *_ = GENES[gene]
        if not least <= value <= most:
            raise ValueError(f"{gene} lies between {least} and {most}")
        now = (self["events"].agg(F.max("ts")).first()[0] or 0) if now is None else now
        score = self.index.bm25_of if self.index is not None else lambda asked: retrieval.bm25_of(self["passages"], asked)
        return jobs.shadow(self["events"], self["notes"], score, gene, value, now, self.t, limit)

    def with_genes(self) -> Library:
        """The same library under the values that are set."""
        known = {f.name: type(f.default) for f in fields(Tunables)}
        set_ = {r.gene: known[r.gene](r.value) for r in self["values"].collect() if r.gene in known}  # at most one for each gene
        return Library(self.spark, self.tables, replace(self.t, **set_), self.index)

    def rulesets(self) -> DataFrame:
        return self["rulesets"].select("id", "name").distinct().orderBy("id")

    def ruleset(self, id_: str) -> DataFrame:
        return self["rulesets"].where(F.col("id") == id_)

    def effective(self, axis: str) -> rulesets.Policy:
        rows = self["rulesets"].where("enabled").orderBy("id", "kind").collect()  # configuration: a few rows
        return rulesets.effective(axis, [(r.kind, r.params) for r in rows])
