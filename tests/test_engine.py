"""The note engine: every query against its SQL, and properties on small frames."""

import pytest
from pyspark.sql import functions as F

from cairnlake.functions import text
from cairnlake.functions.policy import Tunables
from cairnlake.operators import activity, graph, lint, mining, relational, retrieval, sections
from cairnlake.sources import corpus
from cairnlake.streaming.windows import session_windows
from tests.oracle import differences

EDGE = "src string, dst string, kind string, weight double"


def test_queries_match_their_sql(spark):
    bad = {name: note for name, _, _, _, note in differences(spark, "/root/testdata/sf0.001") if note}
    assert not bad


def test_gap_windows_watermark_and_late_events(spark):
    gap, base = 900, 10**9
    rows = [(1, base, None, '{"cmd": "search", "hit_ids": ["n1"]}'), (2, base + 60, None, '{"cmd": "search", "hit_ids": ["n2"]}'), (3, base + 60 + gap + 1, None, '{"cmd": "search", "hit_ids": ["n1"]}'),
            (4, base, "task-a", '{"cmd": "search", "hit_ids": ["n1"]}'), (5, base + 90000, "task-a", '{"cmd": "search", "hit_ids": ["n2"]}'), (6, base + 1, "task-a", '{"cmd": "get", "hit_ids": []}'), (7, base, "x", "{")]
    e = activity.parsed(spark.createDataFrame([(i, t, "retrieval", s, p) for i, t, s, p in rows], "id long, ts long, kind string, session_id string, payload string"))
    w = activity.activity_windows(activity.windows_of(e, gap)).collect()
    assert sorted((r.session_id or "", r.window, r.queries) for r in w) == [("", 0, 2), ("", 1, 1), ("task-a", 0, 1), ("task-a", 1, 2)]
    assert max(r.ended_at for r in w) == base + 90000  # the late event joined the open window
    assert activity.hits(activity.windows_of(e, gap)).count() == 5 and activity.windows_of(e, gap, after=7).count() == 0
    assert session_windows(e.where("cmd is not null and id < 6")).count() == 4


def test_streaming_windows(spark, tmp_path):
    d = spark.createDataFrame([(0, "a"), (100, "a"), (5000, "a"), (9_000_000, "z")], "ts long, session_id string")
    d.write.parquet(str(tmp_path / "in"))
    out = session_windows(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")))
    q = out.writeStream.format("memory").queryName("w_").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted((r.started_at, r.ended_at, r.queries) for r in spark.table("w_").collect()) == [(0, 100, 2), (5000, 5000, 1)]


def test_graph_rules(spark):
    e = spark.createDataFrame([("b", "a", "cooccur", 0.5), ("a", "c", "sibling", 1.0), ("c", "a", "reference", 1.0), ("a", "a", "assoc", 1.0), ("a", "d", "assoc", 0.31)], EDGE)
    c = graph.canonical(e)
    assert sorted(tuple(r) for r in c.collect()) == [("a", "b", "cooccur", 0.5), ("a", "c", "sibling", 1.0), ("a", "d", "assoc", 0.31), ("c", "a", "reference", 1.0)]
    assert {r.dst for r in graph.decay(c).collect()} == {"b", "c", "a"}  # 0.31 * 0.9 is below the floor
    ranked = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "id string, rank int")
    grown = {(r.src, r.dst, r.kind): r.weight for r in graph.rebirth(c, ranked, 0.1).collect()}
    assert grown["a", "b", "cooccur"] == pytest.approx(0.55) and grown["a", "c", "sibling"] == 1.0 and grown["a", "d", "assoc"] == 0.31
    near = graph.neighbors(c, "a").collect()
    assert [(r.other, r.kind) for r in near] == [("c", "reference"), ("b", "cooccur"), ("c", "sibling")]  # siblings rank below
    merged = {(r.src, r.dst, r.kind): r.weight for r in graph.redirect(c, spark.createDataFrame([("d", "b")], "old string, new string")).collect()}
    assert merged["a", "b", "assoc"] == 0.31 and ("c", "a", "reference") in merged
    assert [r.id for r in graph.blockers(c, "a").collect()] == ["c"]
    two = graph.strengthen(c, spark.createDataFrame([("b", "a", 3)], "src string, dst string, n long"), "cooccur", 0.2).where("kind = 'cooccur'").first()
    assert two.weight == 1.0
    assert graph.pairs_of_sets(spark.createDataFrame([(1, x) for x in "abcdefghi"] + [(2, "a"), (2, "b"), (3, "a")], "key long, item string")).count() == 1


def test_clusters_drop_oversize_whole(spark):
    corpus.ensure_checkpoints(spark)
    e = spark.createDataFrame([(f"n{i}", f"n{i + 1}", "sibling", 1.0) for i in range(9)] + [("x", "y", "sibling", 1.0)], EDGE)
    assert [r.members for r in graph.clusters(e, 3).collect()] == ["x,y"]
    assert {r["size"] for r in graph.clusters(e, 12).collect()} == {10, 2}


def test_vectors(spark):
    v = spark.createDataFrame([(f"n{i}", [0.6, 0.8, 0.0, 0.0], 0) for i in range(7)] + [("zero", [0.0] * 4, 0)], "id string, vec array<float>, axis int")
    assert [r.id for r in mining.vector_expand(v, ["n0"], 3).collect()] == ["n1", "n2", "n3"]
    assert [r.id for r in mining.vector_expand(v, ["n0"], 3, ["n1"]).collect()] == ["n2", "n3", "n4"]
    e = spark.createDataFrame([("0", "1", "assoc", 2.0), ("0", "2", "assoc", 1.0), ("1", "2", "assoc", 3.0)], EDGE)
    assert all(r.value > 0 for r in graph.ppmi(e).collect())


def test_raw_expressions(spark):
    p = spark.createDataFrame([("a", "", "transfer giro été"), ("b", "", "transfer money"), ("c", "", "foo_bar baz")], "id string, section string, content string")
    ids = lambda x: sorted(r.id for r in retrieval.match(p, x).collect())
    assert ids("transfer NOT giro") == ["b"] and ids("ete") == ["a"] and ids('"foo bar"') == ["c"] and ids("mon* OR baz") == ["b", "c"] and ids("(transfer giro) OR baz") == ["a", "c"]
    for bad in ("a AND", "OR a", "(a", "a )", ""):
        with pytest.raises(ValueError, match="malformed"):
            retrieval.match(p, bad)


def test_bm25_matches_a_second_engine(spark):
    import sqlite3

    rows = [(f"n{i}", f"s{i}", " ".join(["alpha"] * (i % 3) + ["beta"] * (i % 5 == 0) + ["filler"] * (i % 7 + 1))) for i in range(40)]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(id unindexed, content, tokenize = 'unicode61 remove_diacritics 2')")
    db.executemany("insert into t values (?, ?)", [(a, c) for a, _, c in rows])
    want = {a: round(r, 5) for a, r in db.execute("select id, rank from t where t match 'alpha OR beta'")}
    got = {r.id: round(r.score, 5) for r in retrieval.bm25(spark.createDataFrame(rows, "id string, section string, content string"), ["alpha", "beta"]).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 2e-5 for k in want)


BODY = "intro\n# A\ntext one\n```\n# not a heading\n```\n### C\nmore words here\n## B\n# D\n"


def test_sections_and_document_rules(spark):
    n = spark.createDataFrame([("n1", BODY), ("n2", "```\n# open"), ("n3", "#bad\n[[link]]"), ("n4", None)], "id string, body string")
    s = [(r.level, r.path, r.line_start, r.line_end) for r in sections.sections(n).where("id = 'n1'").orderBy("ord").collect()]
    assert s == [(1, "A", 1, 9), (3, "A > C", 6, 8), (2, "A > B", 8, 9), (1, "D", 9, 11)]
    found = {(r.subject, r.code) for r in lint.lint_documents(n).collect()}
    assert found == {("n1", "heading-skip"), ("n1", "empty-section"), ("n2", "fence-unclosed"), ("n3", "bare-hash-line"), ("n3", "wikilink-style")}
    assert sections.budget(sections.sections(n), 9).where("id = 'n1'").first().shown == 1
    m = spark.createDataFrame([("alpha", "see `beta-note` and [[gamma]] and `alpha`"), ("beta-note", "")], "id string, body string")
    assert [(r.subject, r.marker) for r in lint.dangling(m).collect()] == [("alpha", "gamma")]


def test_text_functions(spark):
    df = spark.createDataFrame([("The café Foo_bar\r\nline two x",)], "t string")
    r = df.select(text.index_tokens(F.col("t")).alias("i"), text.lines(F.col("t")).alias("l"), text.query_tokens(F.col("t")).alias("q"), text.word_count(F.col("t")).alias("w")).first()
    assert r.i == ["the", "cafe", "foo", "bar", "line", "two", "x"] and r.l == ["The café Foo_bar", "line two", "x"][:1] + ["line two x"] and r.w == 6
    assert set(r.q) == {"caf", "foo_bar", "line", "two"}
    assert mining.near_tags(spark.createDataFrame([("abc",), ("abcd",), ("abd",), ("xyz",)], "tag string")).count() == 3


def test_corpus_round_trip(spark, tmp_path):
    root = tmp_path / "cortex"
    good = "---\nid: n1\ntitle: A title\ntags: [x, y]\nlocked: Yes\nmood: calm\nsource: [\"/a\", \"/b\"]\n---\n\n# H\nbody words\n"
    for name, t in {"tech/n1.md": good, "tech/README.md": good, ".trash/n2.md": good, ".innate/n3.md": "---\nid: n3\n---\n\nx", "flow/bad.md": "---\nid: n4\noops\ntags: x\n---\nbody", "flow/_x.md": good}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(t)
    n = corpus.parse(corpus.scan(spark, str(root)))
    r = {x.id: x for x in n.collect()}
    assert set(r) == {"n1", "n3", "n4"} and (r["n1"].axis, r["n3"].axis) == ("tech", "innate")
    assert r["n1"].tags == ["x", "y"] and r["n1"].locked and r["n1"].extra == {"mood": "calm"} and r["n1"].source == ["/a", "/b"] and r["n1"].error is None
    assert r["n4"].error == "malformed: oops" and r["n1"].body.startswith("# H")
    again = {x.id: x for x in corpus.parse(corpus.dump(n.where("id = 'n1'"))).collect()}
    assert again["n1"].body == r["n1"].body and again["n1"].tags == ["x", "y"]
    assert corpus.changed(n, n.where("id <> 'n3'")).select("id").first().id == "n3"
    a = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    state = corpus.upsert(a, spark.createDataFrame([("b", 3), ("c", 4)], "id string, v int"))
    corpus.commit({"t": state}, str(tmp_path / "state"), 1)
    assert sorted(tuple(x) for x in corpus.load(spark, str(tmp_path / "state"))["t"].collect()) == [("a", 1), ("b", 3), ("c", 4)]


def test_habituation_and_policy(spark):
    f = spark.createDataFrame([("new", 100, 5), ("same", 100, 5), ("grown", 150, 5), ("older", 100, 5), ("twice", 150, 5)], "id string, word_count int, section_count int")
    d = spark.createDataFrame([("same", 1, 100, 5, 2), ("grown", 1, 100, 5, 2), ("older", 1, 100, 5, 1), ("twice", 2, 100, 5, 2)], "id string, dismiss_count int, word_count int, section_count int, generation int")
    assert sorted(r.id for r in relational.habituated(f, d, 2).collect()) == ["grown", "new", "older"]
    assert Tunables().decay_factor == 0.9


def close_pairs(rows):
    """By brute force: pairs of (id, token set) with a Jaccard similarity of 0.6 or a containment of 0.85."""
    out = {}
    for i, (a, x) in enumerate(rows):
        for b, y in rows[i + 1 :]:
            both = len(x & y)
            if both and (both / len(x | y) >= 0.6 or both / min(len(x), len(y)) >= 0.85):
                out[min(a, b), max(a, b)] = (round(both / len(x | y), 6), round(both / min(len(x), len(y)), 6))
    return out


def test_near_duplicates_are_exact(spark):
    """Groups of copies larger than any cap on document frequency, near copies, and notes inside others."""
    import random

    rng = random.Random(3)
    words = [f"w{i:03d}" for i in range(120)]
    rows = [(f"c{i:02d}", set(words[:30])) for i in range(8)] + [(f"n{i:02d}", set(words[:30]) - {words[i]} | {words[40 + i]}) for i in range(8)] + [("in", set(words[5:12])), ("one", {words[3]})]
    rows += [(f"r{i:02d}", set(rng.choices(words, k=rng.randint(1, 40)))) for i in range(60)]
    d = spark.createDataFrame([(a, " ".join(sorted(x))) for a, x in rows] + [("none", "")], "id string, body string")
    got = mining.near_duplicates(d).collect()
    want = close_pairs(rows)
    assert {(r.a, r.b): pytest.approx((r.jaccard, r.containment), abs=2e-6) for r in got} == want and len(got) == len(want) > 120


def test_index_sizes_and_strengthened_pairs_are_whole(spark):
    from cairnlake.plans import fixtures, queries

    small = "/root/testdata/sf0.001"
    tokens = {r.id: len(r.t) for r in retrieval.passages(fixtures.notes(spark, small)).groupBy("id").agg(F.flatten(F.collect_list(text.index_tokens(F.col("content")))).alias("t")).collect() if r.t}
    assert {r.id: r.tokens for r in queries.index_sizes(spark, small).collect()} == tokens
    pairs = {(r.src, r.dst) for r in fixtures.ordered(spark, small).collect()}
    assert {(r.src, r.dst) for r in queries.strengthen_pairs(spark, small).where("kind = 'assoc'").collect()} == pairs


def test_near_tags_of_any_length(spark):
    """Against brute force over all entities, long ones too."""
    from cairnlake.plans import fixtures, queries

    def one_edit(a, b):
        a, b = sorted((a, b), key=len)
        i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
        return a != b and (a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :])

    small = "/root/testdata/sf0.001"
    tags = sorted({r.entity for r in fixtures.entities(fixtures.notes(spark, small)).collect()})
    by: dict = {}
    for t in tags:
        by.setdefault(len(t), []).append(t)
    want = {(min(a, b), max(a, b)) for a in tags for n in (len(a), len(a) + 1) for b in by.get(n, []) if one_edit(a, b)}
    got = [(r.a, r.b) for r in queries.lint_tag_near_duplicate(spark, small).collect()]
    assert set(got) == want and len(got) == len(want) and max(len(a) for a, _ in want) > 7
