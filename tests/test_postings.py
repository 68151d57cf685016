"""The stored index: against scans, after random changes against a rebuild; versions of tables."""

import random

import pytest
from pyspark.sql import functions as F

from cairnlake.operators import retrieval
from cairnlake.operators.postings import Index
from cairnlake.sources import corpus
from cairnlake.sources.versions import Conflict, Versions

WORDS = [f"w{k}" for k in range(60)] + ["déjà", "under_score", "Ünder"]


def passages(spark, texts, columns=("content",)):
    """One head and a section for each text."""
    rows = [(f"n{i}", s, *[t if c == columns[-1] else f"title w{i % 5}" if s == "" else "" for c in columns]) for i, t in texts.items() for s in ("", "L1") if s == "" or i % 2]
    return spark.createDataFrame(rows, f"id string, section string, {', '.join(f'{c} string' for c in columns)}")


def some(rng, n=12):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randrange(n)))


def told(index):
    """All that an index says."""
    p = {(r.term, r.id, r.section): (r.size, tuple(r["at"])) for r in index.postings().collect()}
    return p, {r.term: r.df for r in index.frequencies().collect()}, index.held["numbers"]["n"], index.held["numbers"]["tokens"]


def test_scores_equal_a_scan(spark, tmp_path):
    rng = random.Random(1)
    rows = passages(spark, {i: some(rng, 30) for i in range(200)})
    index = Index(spark, f"{tmp_path}/i", 16).build(rows)
    for terms in (["w1", "w2", "deja"], ["w7"], ["nothing"], [], ["under", "score"]):
        assert {tuple(r) for r in index.bm25(terms).collect()} == {tuple(r) for r in retrieval.bm25(rows, terms).collect()}, terms
    # only the files of the terms' buckets are opened
    files = index.postings(["w1", "w2"]).inputFiles()
    every = index.postings().inputFiles()
    assert 0 < len({f.split("bucket=")[1].split("/")[0] for f in files}) <= 2 < len({f.split("bucket=")[1].split("/")[0] for f in every})
    plan = index.bm25(["w1"])._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,w1)]" in plan.replace("In(term, [w1])", "EqualTo(term,w1)") and f"bucket={next(iter(index._of(['w1'])))}" in plan
    asked = spark.createDataFrame([(1, "w1"), (1, "w2"), (2, "w7"), (2, "w7"), (3, "nothing")], "query int, term string")
    got = {(r.query, r.id, r.section): r.score for r in index.bm25_of(asked).collect()}
    assert got == {(q, r.id, r.section): r.score for q, t in ((1, ["w1", "w2"]), (2, ["w7"])) for r in index.bm25(t).collect()}


EXPRESSIONS = ["w1", "w1 w2", "w1 AND w2 OR w3", "w1 NOT w2", '"w1 w2"', "w1*", '("w1 w2" OR w3) NOT (w4 w5)', "NOT_ OR w9", '"title w1*"', "Déjà", '"w2 w1" OR nothing', "(w1 OR w2) (w3 OR w4)"]


def test_raw_expressions_equal_a_scan(spark, tmp_path):
    rng = random.Random(2)
    rows = passages(spark, {i: some(rng, 25) for i in range(150)})
    index = Index(spark, f"{tmp_path}/i", 8).build(rows)
    tokens = {(r.id, r.section): r.t for r in rows.select("id", "section", __import__("cairnlake.functions.text", fromlist=["x"]).index_tokens(F.col("content")).alias("t")).collect()}

    def holds(tree, t):
        kind, *rest = tree
        if kind == "leaf":
            words, prefix = rest
            return any(list(t[i : i + len(words) - prefix]) == list(words[: len(words) - prefix]) and (not prefix or i + len(words) <= len(t) and t[i + len(words) - 1].startswith(words[-1])) for i in range(len(t)))
        a, b = (holds(x, t) for x in rest)
        return a and b if kind == "and" else a or b if kind == "or" else a and not b

    for e in EXPRESSIONS:
        scan = {(r.id, r.section): r.score for r in retrieval.matched(rows, e).collect()}
        assert scan == {(r.id, r.section): r.score for r in index.match(e).collect()}, e
        assert set(scan) == {k for k, t in tokens.items() if holds(retrieval.parsed(e), t)}, e
        assert {k[0] for k in scan} == {r.id for r in retrieval.match(rows, e).collect()}
    for e in ("", "AND w1", "w1 AND", "(w1", "w1)", '"w1', "***", "NOT w1"):
        with pytest.raises(ValueError):
            retrieval.parsed(e)


def test_columns_count_alike_and_no_phrase_crosses_them(spark, tmp_path):
    rows = spark.createDataFrame([("a", "", "one two", "three", None, "four"), ("b", "", "one", "two three", "", "")], "id string, section string, title string, summary string, body string, enrich string")
    index = Index(spark, f"{tmp_path}/i", 4).build(rows)
    assert [r.id for r in index.match('"two three"').collect()] == ["b"] and index.held["numbers"]["tokens"] == 7
    joined = retrieval.content(rows.fillna(""))
    assert {tuple(r) for r in index.bm25(["one", "four"]).collect()} == {tuple(r) for r in retrieval.bm25(joined, ["one", "four"]).collect()}


def test_index_after_changes_equals_a_rebuild(spark, tmp_path):
    rng = random.Random(3)
    columns = ("title", "body")
    texts = {i: some(rng) for i in range(60)}
    index = Index(spark, f"{tmp_path}/i", 32).build(passages(spark, texts, columns))
    for step in range(4):
        gone = rng.sample(sorted(texts), 3)
        new = {i: some(rng) for i in [*rng.sample(sorted(texts), 3), 100 + step]}
        texts = {i: t for i, t in texts.items() if i not in gone} | new
        index.upsert(passages(spark, new, columns), spark.createDataFrame([(f"n{i}",) for i in [*gone, 9999]], "id string"))
        if step == 2:
            before = {b: f for b, f in index.held["tables"]["postings"]["files"].items()}
            done = index.merge()
            after = index.held["tables"]["postings"]["files"]
            # just the buckets of terms that came or went are new
            assert sum(after.get(b) != f for b, f in before.items()) <= done["postings"] and all(len(f) == 1 for f in after.values())
            assert index.merge() == {"postings": 0, "rows": 0, "terms": 0}
    fresh = Index(spark, f"{tmp_path}/j", 32).build(passages(spark, texts, columns))
    assert told(index) == told(fresh)
    one = passages(spark, {0: "w1 rare"}, columns)
    small = Index(spark, f"{tmp_path}/j").upsert(one, one.select("id").distinct())
    done = small.merge()
    assert 0 < done["postings"] <= 32 and done["rows"] == 1
    assert told(Index(spark, f"{tmp_path}/j")) == told(small)  # read again from its files
    bare = small.upsert(one.limit(0), spark.createDataFrame([(f"n{i}",) for i in texts], "id string"))
    assert told(bare) == ({}, {}, 0, 0) and bare.bm25(["w1"]).count() == 0
    bare.merge()
    assert told(bare) == ({}, {}, 0, 0)


def test_merge_leaves_other_buckets_alone(spark, tmp_path):
    rows = spark.createDataFrame([(f"n{i}", "", f"t{i}") for i in range(200)], "id string, section string, content string")
    index = Index(spark, f"{tmp_path}/i", 64).build(rows)
    before = dict(index.held["tables"]["postings"]["files"])
    index.upsert(spark.createDataFrame([("n5", "", "fresh")], rows.schema), spark.createDataFrame([("n6",)], "id string"))
    done = index.merge()
    changed = {b for b in set(before) | set(index.held["tables"]["postings"]["files"]) if index.held["tables"]["postings"]["files"].get(b) != before.get(b)}
    # t5 and t6 went, fresh came
    assert changed <= {str(b) for b in index._of(["t5", "t6", "fresh"])} and done["postings"] <= 3
    assert {r.term for r in index.postings().collect()} == {f"t{i}" for i in range(200) if i not in (5, 6)} | {"fresh"}


def test_versions_share_files_and_refuse_a_second_writer(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "id string, x int")
    v = Versions(spark, f"{tmp_path}/t")
    assert v.latest() == -1
    first = v.put({"a": (make([(f"k{i}", i) for i in range(100)]), "id"), "b": (make([("z", 1)]), "id")}, 16)
    none = make([])
    second = v.change(first, {"a": (make([("k1", -1), ("new", 5)]), make([("k2", 0)])), "b": (make([("y", 2)]), none)})
    with pytest.raises(Conflict):
        v.change(first, {"a": (make([("k3", -3)]), none)})
    assert v.latest() == 1 and v.state()["version"] == 1
    rows = lambda s, t: {r.id: r.x for r in v.read(s, t).collect()}
    want = {f"k{i}": i for i in range(100)}
    assert rows(first, "a") == want and rows(first, "b") == {"z": 1}
    assert rows(second, "a") == {k: x for k, x in (want | {"k1": -1, "new": 5}).items() if k != "k2"}
    assert rows(second, "b") == {"z": 1, "y": 2}
    a, b = first["tables"]["a"]["files"], second["tables"]["a"]["files"]
    assert 0 < sum(a.get(p) != f for p, f in b.items()) <= 3 and sum(a.get(p) == f for p, f in b.items()) >= len(a) - 3
    # what a refused writer wrote is in no manifest
    assert rows(v.state(), "a")["k3"] == 3


def test_commits_share_partitions_that_are_as_before(spark, tmp_path):
    root = str(tmp_path / "corpus")
    rows = lambda edit: spark.range(400).selectExpr("id", f"case when id in ({edit}) then 'new' else 'text ' || id end as body", "map('k', id) as extra", "if(id % 3 = 0, null, id) as n")
    links = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 2.0), (None, "c", 2.0)], "src string, dst string, weight double")
    keys = {"links": ["src", "dst"]}
    corpus.commit({"notes": rows("-1"), "links": links}, root, 1, keys, parts=32)
    corpus.commit({"notes": rows("7"), "links": links}, root, 2, keys)
    one, two = (Versions(spark, root).state(v)["tables"] for v in (1, 2))
    differ = [p for p, f in one["notes"]["files"].items() if two["notes"]["files"][p] != f]
    assert len(differ) == 1 and len(one["notes"]["files"]) == 32 and one["links"]["files"] == two["links"]["files"]
    read = lambda v, t: sorted(map(repr, corpus.load(spark, root, v)[t].collect()))
    assert read(1, "notes") == sorted(map(repr, rows("-1").collect())) and read(2, "notes") == sorted(map(repr, rows("7").collect()))
    assert read(2, "links") == sorted(map(repr, links.collect()))
    with pytest.raises(Conflict):  # a second writer on version 1
        corpus.commit({"notes": rows("9"), "links": links}, root, 2, keys)
    with pytest.raises(Conflict):  # one that has never seen version 2
        corpus.commit({"notes": rows("9"), "links": links}, root, 5, keys)
    # rows that go, a table that empties, another schema; what was changed by key counts as changed
    files = Versions(spark, root)
    files.change(files.state(), {"notes": (rows("11").where("id = 11"), rows("1").where("id = 12").select("id"))})
    assert len(read(3, "notes")) == 399
    corpus.commit({"notes": rows("7").where("id <> 3"), "links": links.limit(0)}, root, 4, keys)
    assert read(4, "notes") == sorted(map(repr, rows("7").where("id <> 3").collect())) and read(4, "links") == []
    corpus.commit({"notes": rows("7").drop("n")}, root, 5)
    assert corpus.load(spark, root)["notes"].columns == ["id", "body", "extra"] and set(corpus.load(spark, root)) == {"notes"}


def test_postings_are_gathered_where_the_row_is(spark):
    """F14, F15, F16, F23, F27, F29: a posting moves once, with its places; sizes and frequencies take no shuffle of words."""
    from cairnlake.operators import postings, retrieval

    rows = spark.createDataFrame([(["b", "a", None, "b", "é"],), ([],), ([None],)], "t array<string>")
    df = rows.select(postings.places(F.col("t")).alias("p"))
    assert [[(x.term, x.at) for x in r.p] for r in df.collect()] == [[("a", [1]), ("b", [0, 3]), ("é", [4])], [], []]
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    p = retrieval.passages(spark.createDataFrame([("n1", "t", "s", "deep blue sea\nblue blue"), ("n2", "u", "v", "")], "id string, title string, summary string, body string"))
    told = {(r.id, r.section, r.term): r.tf for r in retrieval.postings(p).collect()}
    assert told["n1", "", "blue"] == 3 and told["n1", "L0001", "blue"] == 2 and len(told) == 15
    assert "Exchange" not in retrieval.postings(p)._jdf.queryExecution().executedPlan().toString()
