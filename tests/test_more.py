"""State, index, enrichment, neighbours, jobs and commands on small frames."""

import re

import pytest
from pyspark.sql import functions as F

from cairnlake import api
from cairnlake.functions import edits, templates, text
from cairnlake.functions.policy import GENES, Tunables
from cairnlake.operators import activity, enrichment, indexing, jobs, lint, mining, neighbors, retrieval, state
from cairnlake.operators.sections import preambles, within

SF = "/root/testdata/sf0.001"
NOTE = "id string, axis string, title string, summary string, body string, priority string, stale boolean, locked boolean, template string, word_count long, section_count long"


def notes_of(spark, rows):
    return spark.createDataFrame([(i, x, t, s, b, "lazy", False, False, None, len(b.split()), 1) for i, x, t, s, b in rows], NOTE)


def some_notes(spark):
    return notes_of(spark, [("alpha", "tech", "Alpha gear", "about gears", "## A\ngears turn wheels"), ("beta", "tech", "Beta gear", "about gears", "## A\ngears turn cogs see `alpha`"), ("gamma", "flow", "Gamma", "rivers", "## B\nwater flows on [[delta]]"), ("delta-240102", "flow", "Delta", "", "## B\nend")])


def test_texts(spark):
    one = lambda f, *x: spark.createDataFrame([x], [f"c{i}" for i in range(len(x))]).select(f.alias("y")).first().y
    c = F.col("c0")
    assert one(text.fold(c), "Été Ğ Straße ño ệ") == "ete g straße no e"
    said = "AB-12 the Red Fox jumps Over The Lazy Dog Again xAB-3 éAbc Last-Word Red Fox CD-7"
    w = r"[^\W]"
    hints = [m for p in (r"[A-Z][A-Z0-9]+-\d+", r"[A-Z][a-z]+(?:\s[A-Z][a-z]+){0,3}") for m in re.findall(rf"(?<!{w})(?:{p})(?!{w})", said)]
    assert one(text.entity_hints(c), said) == list(dict.fromkeys(hints))[:20]
    assert one(text.overlap_tokens(c), "A b-cd, CD é1!") == ["cd", "é1"]
    assert one(text.path_for(F.lit("flow"), c), "x-240102") == "flow/2024/01/x-240102.md" and one(text.path_for(F.lit("flow"), c), "x") == "flow/x.md"
    assert one(text.day_string(c), 86400) == "1970-01-02" and one(text.day_string(c), 0) == "-"
    assert one(text.whole_number(c), " 12 ") == 12 and one(text.whole_number(c), "1x") is None and one(text.truthy(c), " Yes ")
    assert text.split_sections("# A\r\nx\x0b# B y")[1][2] == "B" and len(text.STOPWORDS) == 62


def test_entity_hints_of_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("text", text.entity_hints(F.col("text")).alias("h")).collect()
    w = "[^\\W]"  # letters, marks aside, digits and _
    for r in rows[:100]:
        want = [m for p in (r"[A-Z][A-Z0-9]+-[0-9]+", r"[A-Z][a-z]+(?:[ \t\n\r\f\x0b][A-Z][a-z]+){0,3}") for m in re.findall(rf"(?<!{w})(?:{p})(?!{w})", r.text)]
        assert r.h == list(dict.fromkeys(want))[:20]


def test_budgeted_reads(spark):
    body = "# Top\nintro here\n## A\none two three\n## B\nfour five\n### C\nsix"
    assert edits.read_within(body, 99)[0] == body and edits.read_within("a b\nc d e", 2) == ("a b", 2, [], "(preamble)")
    text_, words, omitted, cut = edits.read_within(body, 11)
    assert text_ == "# Top\nintro here\n## A\none two three" and (words, omitted, cut) == (9, ["# Top > ## B"], None)
    assert edits.read_within(body, 5) == ("# Top\nintro here", 4, ["# Top > ## A", "# Top > ## B"], None)
    assert edits.read_within(body, 3) == ("# Top", 2, ["# Top > ## A", "# Top > ## B"], "# Top")
    assert edits.read_within("## A\none two three four\nfive\n## B\nx", 4) == ("## A", 2, ["## B"], "## A")
    n = spark.createDataFrame([("a", "pre\nx\n# T\ny"), ("b", "none"), ("c", None)], "id string, body string")
    assert {r.id: r.text for r in preambles(n).collect()} == {"a": "pre\nx", "b": "none", "c": ""}
    assert {r.id: (r.words, r.cut) for r in within(n, 1).collect()} == {"a": (1, "(preamble)"), "b": (1, None), "c": (0, None)}


def test_templates(spark):
    frame = templates.headings("# Goal\nwhy\n## 1. Steps\nhow\n# Result")
    assert [(x.label, x.guide, [y.label for y in x.below]) for x in frame] == [("# Goal", "why", ["## 1. Steps"]), ("# Result", "", [])]
    assert templates.scaffold(frame) == "# Goal\n\n## 1. Steps\n\n# Result"
    says = lambda body: templates.violation(frame, templates.headings(body))
    assert says("# Goal\n## 1. Steps\n### free\n# Result") is None
    assert says("# Goal\n# Result") == "missing: # Goal > ## 1. Steps" and says("# Result\n# Goal\n## 1. Steps").startswith("order")
    assert says("# goal\n# Result").endswith("meant is # Goal") and says("# X").startswith("foreign") and says("# Goal\n## 1. Steps\n# Result\n# Result").startswith("repeated")
    n = notes_of(spark, [("t", "a", "", "", "# Goal"), ("x", "a", "", "", "# Other"), ("y", "a", "", "", "# Goal\nfine")]).withColumn("template", F.when(F.col("id") != "t", "t"))
    assert [r.subject for r in lint.template_drift(n).collect()] == ["x"]
    catalog = lint.rule_catalog(spark).collect()
    assert len(catalog) == 30 and catalog[0].severity == "error"


def test_routes_of_a_split(spark):
    e = spark.createDataFrame([("a", "p", "assoc", 1.0), ("b", "p", "assoc", 0.8), ("p", "q", "cooccur", 0.6), ("p", "r", "reference", 1.0), ("p", "s", "sibling", 1.0), ("x", "y", "assoc", 0.1), ("p", "old", "supersedes", 1.0)], "src string, dst string, kind string, weight double")
    s = spark.createDataFrame([("p", "p1"), ("p", "p2")], "parent string, child string")
    routes = spark.createDataFrame([("p", "assoc", "a", "p2")], "parent string, kind string, other string, child string")
    got = {(r.src, r.dst, r.kind): round(r.weight, 6) for r in state.split_edges(e, s, routes).collect()}
    assert got == {("a", "p2", "assoc"): 1.0, ("b", "p1", "assoc"): 0.4, ("b", "p2", "assoc"): 0.4, ("p1", "q", "cooccur"): 0.3, ("p2", "q", "cooccur"): 0.3, ("p1", "s", "sibling"): 1.0, ("p2", "s", "sibling"): 1.0, ("x", "y", "assoc"): 0.1}


def test_search_leaves_traces(spark):
    n = some_notes(spark)
    usage = n.select(F.col("id").alias("note_id"), F.lit(2).cast("long").alias("hit_count"), F.lit(None).cast("long").alias("last_retrieved_at"))
    entities = spark.createDataFrame([("Gear", "alpha", 1, 1)], "entity string, note_id string, last_seen_at long, hit_count long")
    edges = spark.createDataFrame([("alpha", "beta", "assoc", 0.5), ("alpha", "gamma", "assoc", 0.5)], "src string, dst string, kind string, weight double")
    rank = lambda *ids: spark.createDataFrame([(x, i) for i, x in enumerate(ids)], "id string, rank int")
    out = jobs.search_effects(rank("beta", "alpha"), rank("gamma"), usage, entities, edges, 77, "gears", "s1")
    assert {r.note_id: (r.hit_count, r.last_retrieved_at) for r in out["usage"].collect()} == {"alpha": (3, 77), "beta": (3, 77), "gamma": (3, 77), "delta-240102": (2, None)}
    assert out["entities"].first().hit_count == 2
    got = {(r.src, r.dst, r.kind): round(r.weight, 6) for r in out["edges"].collect()}
    assert got["alpha", "beta", "assoc"] == round(0.5 * 1.05, 6) and got["alpha", "gamma", "assoc"] == round(0.5 * (1 + 0.05 / 2), 6) and got["beta", "gamma", "cooccur"] == 1.0
    p = activity.parsed(out["events"].withColumn("id", F.lit(1))).first()
    assert (p.cmd, p.hit_ids, p.expand_ids, p.session_id) == ("search", ["beta", "alpha"], ["gamma"], "s1")
    alone = jobs.search_effects(rank("beta"), rank(), usage, entities, edges, 77, "gears")
    assert {r.weight for r in alone["edges"].collect()} == {0.5}


def test_sessions_in_stretches(spark):
    """The same windows however the ids are cut, with late events, and over batches."""
    import random

    rng = random.Random(4)
    rows, t = [], 0
    for i in range(400):
        t += rng.choice([10, 100, 850, 901, 3000, -400])
        rows.append((i, t, "retrieval", rng.choice([None, None, "a", "b"]), '{"cmd": "search", "hit_ids": ["n%d"]}' % (i % 9)))
    e = activity.parsed(spark.createDataFrame(rows, "id long, ts long, kind string, session_id string, payload string"))
    want, end, number = {}, {}, {}
    for i, ts, _, s, _ in rows:
        if s not in end:
            end[s], number[s] = ts, 0
        elif ts > end[s] + 900:
            number[s] += 1
        end[s] = max(end[s], ts)
        want[i] = number[s]
    for stretch in (7, 100, 65_536):
        assert {r.id: r.window for r in activity.windows_of(e, stretch=stretch).collect()} == want
    one = {(r.id, r.session_id): (r.ended_at, r.queries) for r in jobs.derived(e, -1)[0].collect()}
    first, hits, mark = jobs.derived(e.where("id < 150"), -1)
    assert mark.first().watermark == 149 and hits.count() == 150
    open_ = first.groupBy("session_id").agg(F.max(F.struct("id", "ended_at")).alias("x")).select("x.id", "session_id", "x.ended_at")
    second, _, _ = jobs.derived(e, 149, open_)
    both = first.unionByName(second).groupBy("id", "session_id").agg(F.max("ended_at").alias("e"), F.sum("queries").alias("q"))
    assert {(r.id, r.session_id): (r.e, r.q) for r in both.collect()} == one


def test_homeostasis_stops_at_an_open_window(spark):
    w = spark.createDataFrame([(1, 0, 10), (2, 100, 200), (3, 100, 9_500), (4, 300, 400)], "id long, started_at long, ended_at long")
    hits = spark.createDataFrame([(1, "n", 5, "search", "expand"), (2, "n", 120, "search", "expand"), (2, "n", 130, "get", "hit"), (2, "m", 140, "related", "expand"), (2, "m", 100, "get", "hit"), (4, "n", 350, "search", "expand")], "window_id long, note_id string, ts long, cmd string, surface string")
    r = jobs.homeostasis(w, hits, 10_000).first()
    assert (r.windows, r.seen, r.landed, r.sample_seen, r.evaluated, r.hops, r.watermark) == (2, 2, 1, 2, False, 1, 2)
    r = jobs.homeostasis(w, hits, 10_000, -1, 98, 0).first()
    assert (r.evaluated, r.rate, r.hops, r.sample_seen) == (True, 0.01, 0, 0)
    assert jobs.homeostasis(w, hits, 10_000, -1, 98, 60, hops=0).first().hops == 1


def test_pruned_self_queries_are_exact(spark):
    """Rows below a ceiling are the same with and without the pruning by common words."""
    d = spark.read.parquet(f"{SF}/documents.parquet")
    n = notes_of(spark, []).unionByName(d.select(F.concat(F.lit("d"), "doc_id").alias("id"), F.lit("a").alias("axis"), F.lit("t").alias("title"), F.lit("").alias("summary"), F.substring("text", 1, 700).alias("body"), F.lit("lazy").alias("priority"), F.lit(False).alias("stale"), F.lit(False).alias("locked"), F.lit(None).cast("string").alias("template"), F.lit(9).cast("long").alias("word_count"), F.lit(1).cast("long").alias("section_count")))
    index = retrieval.index_rows(n.select("id", F.lit("").alias("section"), F.concat_ws(" ", "title", "body").alias("content"))).cache()
    anchors = n.where("id like '%3'").select("id")
    whole = {(r.anchor, r.id): r.score for r in neighbors.self_queries(index, n, anchors).where("score <= -60").collect()}
    cut = {(r.anchor, r.id): r.score for r in neighbors.self_queries(index, n, anchors, -60.0).collect()}
    assert cut == whole and len(whole) > 5


def test_near_duplicates_of_any_number(spark):
    for copies in (6, 60, 600):
        d = spark.createDataFrame([(f"n{i:04}", "alpha beta gamma delta epsilon") for i in range(copies)] + [("x", "wholly other words stand here")], "id string, body string")
        assert mining.near_duplicates(d).count() == copies * (copies - 1) // 2


def test_missing_edges_prefer_vectors(spark):
    n = some_notes(spark)
    e = spark.createDataFrame([("alpha", "gamma", "assoc", 1.0), ("beta", "gamma", "assoc", 1.0)], "src string, dst string, kind string, weight double")
    v = spark.createDataFrame([("alpha", "beta", 0.95), ("beta", "alpha", 0.95), ("alpha", "gamma", 0.99)], "anchor string, other string, score double")
    w = spark.createDataFrame([("delta-240102", "beta", -80.0), ("alpha", "beta", -90.0)], "anchor string, id string, score double")
    got = [tuple(r) for r in neighbors.missing_edges(v, w, e, n).collect()]
    assert got == [("alpha", "beta", "vector", 0.95), ("beta", "delta-240102", "words", -80.0)]


def test_reviews(spark):
    e = spark.createDataFrame([("a", "b", "assoc", 0.6, "m"), ("a", "c", "assoc", 0.2, None)], "src string, dst string, kind string, weight double, provenance string")
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 0.1])], "id string, vec array<float>")
    flags = spark.createDataFrame([("c", "enrich_review", "old", 1, 1, 1, None)], "note_id string, flag string, reason string, created_at long, last_flagged_at long, flag_count long, resolved_at long")
    raised = enrichment.review_flags(e, v, 9)
    got = {r.note_id: r.resolved_at for r in enrichment.reviewed(flags, raised, v, 9).collect()}
    assert got == {"a": None, "b": None, "c": 9} and enrichment.reviewed(flags, raised, v.limit(0), 9) is flags
    terms = spark.createDataFrame([("a", "alias", "x", "active", None, "m"), ("a", "alias", "y", "pending", None, "u")], "note_id string, kind string, term string, status string, reject_reason string, provenance string")
    t, left = enrichment.purge(terms, e, "m")
    assert {(r.term, r.status) for r in t.collect()} == {("x", "rejected"), ("y", "pending")} and left.count() == 1


@pytest.fixture(scope="module")
def library(spark):
    n = some_notes(spark).withColumn("path", F.concat("axis", F.lit("/"), "id", F.lit(".md"))).withColumn("content_hash", F.lit("h")).withColumn("hit_count", F.lit(0).cast("long")).withColumn("created_at", F.lit(0).cast("long")).withColumn("last_retrieved_at", F.lit(None).cast("long"))
    rows = retrieval.content(retrieval.section_passages(n, __import__("cairnlake.operators.sections", fromlist=["sections"]).sections(n.select("id", "body"))))
    tables = {
        "notes": n, "tags": n.select("id", F.explode(F.array("axis", F.lit("all"))).alias("tag")), "entities": spark.createDataFrame([("Gear", "alpha", 5), ("Gear", "beta", 6)], "entity string, id string, last_seen_at long"),
        "edges": spark.createDataFrame([("alpha", "gamma", "assoc", 0.9)], "src string, dst string, kind string, weight double"), "passages": rows, "index": retrieval.index_rows(rows), "vectors": spark.createDataFrame([("alpha", [1.0, 0.0]), ("beta", [1.0, 0.1])], "id string, vec array<float>"),
        "axes": spark.createDataFrame([("tech",), ("flow",), ("none",)], "axis string"), "vocabulary": spark.createDataFrame([("tech",), ("flow",), ("all",), ("idle",)], "tag string"), "aliases": spark.createDataFrame([("techno", "tech")], "alias string, tag string"),
        "meta": spark.createDataFrame([("alpha", "ns", "k", "v")], "note_id string, namespace string, key string, value string"), "lifecycle": spark.createDataFrame([(1, "alpha", "created", 1)], "id long, note_id string, kind string, created_at long"),
        "flags": spark.createDataFrame([("alpha", "reconsolidate", "r", 1, 1, 1, None)], "note_id string, flag string, reason string, created_at long, last_flagged_at long, flag_count long, resolved_at long"),
        "terms": spark.createDataFrame([("alpha", "alias", "gears", "pending", 1, None), ("gamma", "alias", "!!", "pending", 1, None), ("gamma", "alias", "zzzz", "pending", 1, None)], "note_id string, kind string, term string, status string, created_at long, reject_reason string"),
        "dismissals": spark.createDataFrame([], "key string, kind string, dismiss_count long, word_count long, section_count long, generation int"), "events": spark.createDataFrame([(1, 100, "retrieval", None, '{"cmd": "search", "query": "gears", "limit": 3, "hit_ids": ["alpha"]}')], "id long, ts long, kind string, session_id string, payload string"),
        "values": spark.createDataFrame([("similar_limit", 3.0)], "gene string, value double"), "gene_log": spark.createDataFrame([(1, "similar_limit", 5.0, 3.0, "x", 9)], "id long, gene string, old_value double, new_value double, cause string, ts long"),
        "rulesets": spark.createDataFrame([("r1", "base", True, "ops.deny", '{"ops": ["delete_note"]}')], "id string, name string, enabled boolean, kind string, params string"),
    }
    return api.Library(spark, tables)


def test_query_commands(library):
    ids = lambda df, c="id": [r[c] for r in df.collect()]
    found = library.search("the gears turn", expand=3)
    assert sorted(ids(found["found"])) == ["alpha", "beta"] and ids(found["extra"]) == ["gamma"] and found["found"].first().tags == "all,tech"
    assert ids(library.search("gears NOT cogs", raw=True)["found"]) == ["alpha"]
    related = library.related("the gears of Gear turn")
    assert sorted(ids(related["similar"])) == ["alpha", "beta"] and set(ids(related["linked"])) == {"gamma"} and sorted(ids(related["entity_hits"])) == ["alpha", "beta"]
    assert [(r.id, r.missing) for r in library.get(["beta", "no"]).collect()] == [("beta", False), ("no", True)]
    assert library.get(["alpha"], "A").first().piece == "## A\ngears turn wheels" and library.get(["alpha"], toc=True).first().words == 3 and library.get(["alpha"], words=2).first().cut == "## A"
    assert library.template("alpha") == "## A" and library.meta(["alpha"]).first().entries == {"k": "v"} and library.meta(None, "ns", "k").count() == 1
    assert ids(library.entity("Gear")) == ["beta", "alpha"] and library.entity().count() == 2 and library.structure("tech").where("part = 'axis'").first().n == 2
    near = library.neighbors("alpha").collect()
    assert {r.id for r in near} >= {"beta", "gamma"} and near[0].id == "beta"
    assert library.stats(86400).first().n == 4 and library.stats(86400, "tech").first().n == 2 and library.stats(86400, id_="alpha").first().age_days == 1
    assert {(r.axis, r.n) for r in library.axes().collect()} == {("tech", 2), ("flow", 2), ("none", 0)} and library.list(axis="flow").count() == 2 and library.history("alpha").count() == 1
    assert library.enrichment().first().terms_pending == 3
    codes = {(r.subject, r.code) for r in library.lint().collect()}
    assert ("delta-240102", "empty-summary") in codes and ("gamma", "wikilink-style") in codes


def test_batch_commands(library, spark):
    asked = spark.createDataFrame([(1, "alpha", 1, "append", "A", "more", False), (2, "beta", 1, "remove", "no", None, False)], "batch int, id string, seq int, action string, section string, content string, subtree boolean")
    spark.sparkContext.setCheckpointDir(spark.sparkContext.getCheckpointDir() or "/tmp/cairnlake-tests")
    new, bad = library.apply(asked)
    assert new.where("id = 'alpha'").first().body.endswith("\nmore") and bad.first().batch == 2
    assert library.apply(asked, dry_run=True)[0] is library["notes"]
    made = spark.createDataFrame([("new-one", "tech", "T", "S", "B", ["techno", "all"]), ("alpha", "tech", "T", "S", "B", []), ("Bad", "x", "", "", "", [])], "id string, axis string, title string, summary string, body string, tags array<string>")
    notes, edges, errors = library.create(made, 5)
    assert notes.count() == 5 and {r.id: r.error for r in errors.collect()} == {"alpha": "exists", "Bad": "invalid id"}
    assert {(r.src, r.dst) for r in edges.where("weight = 1.0").collect()} == {("alpha", "new-one"), ("beta", "new-one")}
    changed = library.set_frontmatter(spark.createDataFrame([("alpha", "New", None)], "id string, title string, summary string"))
    assert changed.where("id = 'alpha'").first().title == "New" and changed.where("id = 'alpha'").first().summary == "about gears"
    assert library.vocab().where("tag = 'idle'").first().n == 0 and library.describe("merge_notes").count() == 2 and library.describe().select("op").distinct().count() == 27
    assert api.mentioned({"op": "merge_notes", "from": ["a", "b"], "into": "c"}) == (["a", "b", "c"], [])
    assert api.refused({"op": "delete_note", "id": "alpha"}, set(), library.effective("tech")) == "denied by the axis's rules"
    assert api.refused({"op": "invalidate", "id": "alpha"}, {"alpha"}) == "locked: alpha" and api.refused({"op": "x"}, set()) == "unknown operation" and api.refused({"op": "invalidate", "id": "beta"}, {"alpha"}) is None
    assert api.refused({"op": "set_frontmatter", "id": "b", "fields": {"id": 1}}, set()).startswith("fields")


def test_maintenance_commands(library, spark):
    files = spark.createDataFrame([("tech/alpha.md", "h"), ("tech/beta.md", "other"), ("new.md", "h")], "path string, content_hash string")
    got = {(r.level, r.code, r.subject) for r in library.verify_integrity(files).collect()}
    assert {(1, "file-without-note", "new.md"), (1, "note-without-file", "flow/gamma.md"), (2, "content-differs", "tech/beta.md")} <= got
    done = {(r.note_id, r.term): (r.status, r.reject_reason) for r in library.verify_terms(99).collect()}
    assert done == {("alpha", "gears"): ("active", None), ("gamma", "!!"): ("rejected", "malformed"), ("gamma", "zzzz"): ("pending", None)}
    day = library.integrate(10 * 86400)
    assert day["windows"].count() == 1 and day["watermark"].first().watermark == 1 and {r.axis for r in day["axes"].collect()} == {"tech", "flow"} and {r.tag for r in day["vocabulary"].collect()} == {"tech", "flow", "all"}
    assert {r.status for r in day["terms"].collect()} == {"rejected"} and library.homeostasis(10**6).first().windows == 1
    assert library.prune()[1].first().pruned == 0 and library.report()["unused_tags"].first().tag == "idle"
    assert [r.note_id for r in library.candidates("reconsolidate").collect()] == ["alpha"] and library.candidates("split").count() == 0
    assert library.genes().where("gene = 'similar_limit'").first().source == "genome" and library.genes().count() == len(GENES) and library.with_genes().t == Tunables(similar_limit=3)
    assert library.gene_history().count() == 1 and library.shadow("similar_limit", 4).count() == 0 and library.rulesets().count() == 1
    with pytest.raises(ValueError):
        library.shadow("similar_limit", 40)


def test_catalogue(spark):
    new = spark.createDataFrame([("a.md", "a", "h1", None), ("b.md", "b", "h2", None), ("c.md", "b", "h3", None), ("d.md", None, "h", None)], "path string, id string, content_hash string, error string")
    old = spark.createDataFrame([("a", "a.md", "h1"), ("z", "z.md", "h9")], "id string, path string, content_hash string")
    catalog, errors, gone = indexing.build(old, new)
    assert {r.id for r in catalog.collect()} == {"a", "b"} and {(r.path, r.error) for r in errors.collect()} == {("c.md", "duplicate id"), ("d.md", "no id")} and gone.first().id == "z"
    failed = indexing.build(old, new.withColumn("error", F.when(F.col("path") == "d.md", "bad")))
    assert {r.id for r in failed[0].collect()} == {"a", "b", "z"}
    with pytest.raises(ValueError):
        indexing.rebuild(new, ["id", "path"])
    again, bad = indexing.reindexed(old, new.where("path <> 'c.md'"), ["b.md", "no.md"])
    assert {r.id for r in again.collect()} == {"a", "b", "z"} and bad.first().path == "no.md"
    m = spark.createDataFrame([("a", "b"), ("a", "x"), ("b", "b")], "src string, marker string")
    assert [(r.src, r.dst) for r in indexing.reference_edges(m, again).collect()] == [("a", "b")] and indexing.unresolved(m, again).first().marker == "x"
    assert indexing.as_json(old.limit(1)).first().value.startswith('{"id":"a"') and state.cascade({"t": m.withColumnRenamed("src", "note_id")}, old)["t"].count() == 2


def test_near_duplicates_tokenize_once(spark):
    """sets are written once, and found pairs move without their tokens."""
    d = spark.createDataFrame([("a", "one two three four five six"), ("b", "two one three four five six seven"), ("c", "one two three four five six"), ("d", "nothing here"), ("e", None)], "id string, body string")
    found = mining.near_duplicates(d)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "token" not in plan.replace("tokens", "")
    assert {(r.a, r.b): (r.jaccard, r.containment) for r in found.collect()} == {("a", "b"): (0.857143, 1.0), ("b", "c"): (0.857143, 1.0), ("a", "c"): (1.0, 1.0)}


def test_similar_vectors_meet_in_blocks(spark, monkeypatch):
    """blocks of an axis give what all pairs give, with ties, copies, and vectors without a direction or of another length."""
    import random

    from cairnlake.plans.queries import ensure_checkpoints

    ensure_checkpoints(spark)
    monkeypatch.setattr(mining, "SIDE", 16)
    r = random.Random(2)
    rows = [(i, r.choice("xyz"), [float(r.randrange(-2, 4)) for _ in range(4)]) for i in range(120)] + [(200, "x", [0.0] * 4), (201, "y", None), (202, None, [1.0] * 4), (203, "z", [1.0, 2.0]), (204, "z", [2.0, 4.0])]
    size = lambda v: sum(x * x for x in v) ** 0.5
    want = []
    for i, axis, v in rows:
        others = [(j, w) for j, other, w in rows if i != j and axis and axis == other and v and w and len(v) == len(w) and size(v) and size(w)]
        near = [(round(sum(x * y for x, y in zip(v, w)) / (size(v) * size(w)), 6), j) for j, w in others]
        want += [(i, j, s) for s, j in sorted((x for x in near if x[0] >= 0.3), key=lambda x: (-x[0], x[1]))[:3]]
    found = mining.similar_vectors(spark.createDataFrame(rows, "id long, axis string, vec array<double>"), 0.3)
    assert sorted((x.anchor, x.other, round(x.score, 6)) for x in found.collect()) == sorted(want)
    assert "CoGroup" in found._jdf.queryExecution().optimizedPlan().toString()
