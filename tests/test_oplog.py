"""Logs of operations: each operation, each gate, conflicts against one batch after the other."""

import random

import pytest
from pyspark.sql import functions as F

from cairnlake.operators import oplog
from cairnlake.sources.corpus import ensure_checkpoints

LOG = "batch long, seq int, op string, id string, other string, args map<string,string>"


@pytest.fixture
def tables(spark):
    ensure_checkpoints(spark)
    make = spark.createDataFrame
    rows = [("a", "x", "A", "sa", "## S\none\n## T\ntwo", False, False), ("b", "x", "B", "sb", "## U\nbee", False, False), ("c", "y", "C", "sc", "cee", True, False), ("d", "y", "D", "sd", "dee", False, True), ("e", "x", "E", "se", "eee", False, False)]
    n = make([(*r, "lazy") for r in rows], "id string, axis string, title string, summary string, body string, stale boolean, locked boolean, priority string")
    return {
        "notes": n, "tags": make([("a", "x"), ("a", "t"), ("b", "x"), ("e", "u")], "id string, tag string"), "entities": make([("Gear", "a", 5), ("Gear", "b", 9), ("Cog", "e", 1)], "entity string, id string, last_seen_at long"),
        "edges": make([("a", "b", "reference", 1.0, None), ("a", "e", "assoc", 0.7, "model"), ("b", "e", "assoc", 0.6, None), ("c", "e", "supersedes", 1.0, None)], "src string, dst string, kind string, weight double, provenance string"),
        "flags": make([("a", "enrich_review", "r", 1, 1, 1, None), ("e", "enrich_review", "q", 2, 3, 4, None)], "note_id string, flag string, reason string, created_at long, last_flagged_at long, flag_count long, resolved_at long"),
        "terms": make([("a", "alias", "gears", "pending", 1, None, "model"), ("e", "alias", "gears", "active", 1, None, "user")], "note_id string, kind string, term string, status string, created_at long, reject_reason string, provenance string"),
        "meta": make([("a", "ns", "k", "v", 1), ("e", "ns", "k", "w", 1), ("e", "ns", "l", "x", 1)], "note_id string, namespace string, key string, value string, updated_at long"),
        "usage": make([(i, k, 10 + k, k) for k, i in enumerate("abcde")], "note_id string, hit_count long, last_retrieved_at long, created_at long"),
        "dismissals": make([("a", "split", 1, 5, 1, 0, "", 3)], "key string, kind string, dismiss_count long, word_count long, section_count long, generation int, reason string, last_dismissed_at long"),
        "axes": make([("x", "dx", 1), ("y", "(auto-created)", 1)], "axis string, description string, created_at long"), "values": make([], "gene string, value double"), "gene_log": make([], "gene string, old_value double, new_value double, cause string, ts long"),
        "trash": n.limit(1).select(F.lit("z").alias("id"), "axis", "title", "summary", F.lit("old").alias("body"), "stale", "locked", "priority", F.lit(4).cast("long").alias("deleted_at")),
    }


def run(tables, rows, **how):
    spark = tables["notes"].sparkSession
    out, bad = oplog.apply(tables, spark.createDataFrame(rows, LOG), 100, **how)
    return out, {r.batch: r.error for r in bad.collect()}


def of(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}


def test_operations_on_notes(tables):
    out, bad = run(tables, [
        (1, 1, "create_note", "new-1", None, {"axis": "z", "title": "N", "body": "## A\nx", "tags": "z,t", "axis_description": "zed"}), (1, 2, "patch_section", "new-1", None, {"action": "append", "section": "A", "content": "y"}),
        (2, 1, "patch_section", "a", None, {"action": "append", "section": "S", "content": "more"}), (2, 2, "rename_section", "a", None, {"section": "T", "content": "TT"}), (3, 1, "set_frontmatter", "b", None, {"title": "BB"}), (3, 2, "set_frontmatter", "b", None, {"title": "BBB", "priority": "eager"}),
        (4, 1, "invalidate", "b", None, {}), (5, 1, "revalidate", "c", None, {}), (6, 1, "restore", "z", None, {}), (7, 1, "mark_used", "b", None, {}), (8, 1, "mark_used", "b", None, {}),
    ])
    assert bad == {}
    n = {r.id: r for r in out["notes"].collect()}
    assert n["new-1"].body == "## A\nx\ny" and n["new-1"].axis == "z" and n["a"].body == "## S\none\nmore\n## TT\ntwo" and (n["b"].title, n["b"].priority, n["b"].stale) == ("BBB", "eager", True)
    assert n["c"].stale is False and n["z"].body == "old" and n["a"].title == "A"
    assert {("new-1", "z"), ("new-1", "t")} <= of(out["tags"], "id", "tag") and ("z", "zed") in of(out["axes"], "axis", "description")
    assert ("a", "stale_ref") in of(out["flags"], "note_id", "flag") and ("b", 3, 100) in of(out["usage"], "note_id", "hit_count", "last_retrieved_at") and ("new-1", 0, None) in of(out["usage"], "note_id", "hit_count", "last_retrieved_at")


def test_operations_beside_notes(tables):
    out, bad = run(tables, [
        (1, 1, "flag", "b", None, {"flag": "reconsolidate", "reason": "why"}), (2, 1, "resolve_flag", "a", None, {"flag": "enrich_review"}), (3, 1, "dismiss_candidate", "a", None, {"kind": "split", "word_count": "9", "section_count": "2", "generation": "1"}),
        (4, 1, "set_note_meta", "b", None, {"namespace": "ns", "key": "n", "value": "1"}), (4, 2, "set_note_meta", "b", None, {"namespace": "ns", "key": "n", "value": "2"}), (5, 1, "delete_note_meta", "a", None, {"namespace": "ns", "key": "k"}),
        (6, 1, "add_retrieval_terms", "b", None, {"term": "bees"}), (7, 1, "propose_link", "b", "c", {"confidence": "1.0"}), (8, 1, "link_lineage", "b", "a", {}), (9, 1, "set_axis_description", "y", None, {"description": "dy"}), (10, 1, "rename_tag", "t", "tt", {}),
        (11, 1, "set_gene", "priming_alpha", None, {"value": "1.5"}), (12, 1, "purge_enrichment", None, None, {"provenance": "model"}),
    ])
    assert bad == {}
    assert ("b", "reconsolidate", None) in of(out["flags"], "note_id", "flag", "resolved_at") and ("a", "enrich_review", 100) in of(out["flags"], "note_id", "flag", "resolved_at") and of(out["dismissals"], "key", "dismiss_count", "word_count") == {("a", 2, 9)}
    assert of(out["meta"], "note_id", "key", "value") == {("b", "n", "2"), ("e", "k", "w"), ("e", "l", "x")} and ("b", "bees", "pending") in of(out["terms"], "note_id", "term", "status") and ("a", "gears", "rejected") in of(out["terms"], "note_id", "term", "status")
    edges = of(out["edges"], "src", "dst", "kind")
    assert {("b", "c", "assoc"), ("b", "a", "supersedes"), ("b", "e", "assoc")} <= edges and ("a", "e", "assoc") not in edges
    assert ("y", "dy") in of(out["axes"], "axis", "description") and ("a", "tt") in of(out["tags"], "id", "tag") and of(out["values"], "gene", "value") == {("priming_alpha", 1.5)} and out["gene_log"].count() == 1


def test_moves_merges_and_ends(tables):
    out, bad = run(tables, [(1, 1, "relocate_section", "a", "b", {"section": "T"}), (2, 1, "migrate_note", "c", "cc", {"axis": "x"}), (3, 1, "rename_axis", "x", "xx", {})])
    n = {r.id: r for r in out["notes"].collect()}
    assert bad == {} and n["a"].body == "## S\none" and n["b"].body == "## U\nbee\n## T\ntwo" and "c" not in n and n["cc"].axis == "x" and n["a"].axis == "xx" and ("cc", "e", "supersedes") in of(out["edges"], "src", "dst", "kind") and ("cc",) in of(out["usage"], "note_id")
    assert ("a", "xx") in of(out["tags"], "id", "tag")
    out, bad = run(tables, [(1, 1, "merge_notes", "e", "a", {})])
    assert bad == {}
    n = {r.id: r for r in out["notes"].collect()}
    assert "e" not in n and n["a"].body == "## S\none\n## T\ntwo\neee" and ("e", 100) in of(out["trash"], "id", "deleted_at")
    assert of(out["meta"], "note_id", "key", "value") == {("a", "k", "v"), ("a", "l", "x")} and ("a", 4) in of(out["usage"], "note_id", "hit_count") and ("a", "gears", "active") in of(out["terms"], "note_id", "term", "status")
    assert ("a", "enrich_review", 5) in of(out["flags"], "note_id", "flag", "flag_count") and {("Cog", "a"), ("Gear", "a")} <= of(out["entities"], "entity", "id") and ("a", "u") in of(out["tags"], "id", "tag")
    assert of(out["edges"], "src", "dst", "kind") == {("a", "b", "reference"), ("a", "b", "assoc"), ("c", "a", "supersedes")}
    out, bad = run(tables, [(1, 1, "delete_note", "a", None, {})])
    assert bad == {} and "a" not in {r.id for r in out["notes"].collect()} and not {("a",)} & of(out["flags"], "note_id") | {("a",)} & of(out["meta"], "note_id") and out["edges"].where("src = 'a' or dst = 'a'").count() == 0 and ("a", 100) in of(out["trash"], "id", "deleted_at")


def test_gates_refuse_whole_batches(tables, spark):
    forbidden = spark.createDataFrame([("y", "flag"), ("q", "create_note")], "axis string, op string")
    good = ("set_note_meta", "a", None, {"namespace": "n", "key": "k", "value": "v"})
    cases = [
        (("dance", "a", None, {}), "unknown operation: dance"), (("invalidate", None, None, {}), "no id"), (("create_note", "a", None, {"axis": "x"}), "exists: a"), (("restore", "b", None, {}), "exists: b"), (("create_note", "Bad Id", None, {"axis": "x"}), "invalid id: Bad Id"),
        (("invalidate", "nobody", None, {}), "no such note: nobody"), (("propose_link", "a", "nobody", {}), "no such note: nobody"), (("propose_link", "a", None, {}), "no such note: -"), (("flag", "d", None, {"flag": "f"}), "locked: d"), (("propose_link", "a", "d", {}), "locked: d"),
        (("flag", "c", None, {"flag": "f"}), "denied by the axis's rules"), (("create_note", "qq", None, {"axis": "q"}), "denied by the axis's rules"), (("delete_note", "b", None, {}), "referred to by: a"), (("set_frontmatter", "a", None, {"id": "x"}), "field that can't be set"),
        (("migrate_note", "a", "b", {}), "can't become: b"), (("patch_section", "a", None, {"action": "append", "section": "no", "content": "x"}), None), (("rename_section", "a", None, {"section": "S", "content": "T"}), None),
    ]
    rows = [x for k, (op, _) in enumerate(cases) for x in ((k, 1, "set_note_meta", "a", None, {"namespace": f"n{k}", "key": "k", "value": "v"}), (k, 2, *op))]
    out, bad = run(tables, [*rows, (99, 1, *good)], forbidden=forbidden)
    assert set(bad) == set(range(len(cases))) and all(want is None or bad[k] == want for k, (_, want) in enumerate(cases)), bad
    assert of(out["meta"].where("note_id = 'a'"), "namespace") == {("ns",), ("n",)}


def in_turn(touched):
    """Batches one after the other: refused if a row that they touch is taken in another way."""
    taken, refused = {}, {}
    for batch in sorted({b for b, _, _ in touched}):
        own = [(k, m) for b, k, m in touched if b == batch]
        by = [b for k, m in own for b, other in taken.get(k, ()) if "set" in (m, other)]
        if by:
            refused[batch] = True
        else:
            for k, m in own:
                taken.setdefault(k, []).append((batch, m))
    return set(refused)


def test_conflicts_are_those_of_batches_in_turn(spark, tables):
    rng = random.Random(4)
    for _ in range(3):
        touched = list({(b, k): (b, k, m) for b in range(40) for k, m in [(f"k{rng.randrange(12)}", rng.choice(["set", "add", "add"])) for _ in range(rng.randrange(1, 4))]}.values())
        got = {r.batch for r in oplog.conflicts(spark.createDataFrame(touched, "batch long, key string, mode string")).collect()}
        assert got == in_turn(touched)


def test_conflicting_batches(tables):
    out, bad = run(tables, [
        (1, 1, "set_frontmatter", "a", None, {"title": "first"}), (2, 1, "set_frontmatter", "a", None, {"title": "second"}), (2, 2, "mark_used", "b", None, {}), (3, 1, "mark_used", "b", None, {}), (4, 1, "delete_note", "c", None, {}), (5, 1, "flag", "c", None, {"flag": "f"}), (6, 1, "invalidate", "a", None, {}),
    ])
    assert bad == {2: "conflict with batch 1", 5: "conflict with batch 4"}
    assert ("a", "first", True) in of(out["notes"], "id", "title", "stale") and ("b", 2) in of(out["usage"], "note_id", "hit_count")
    same, none = run(tables, [])
    assert none == {} and same["notes"].count() == 5
