"""Section edits, batches, trash and the rules over several notes, on small frames."""

import pytest

from cairnlake.functions import edits
from cairnlake.operators import bodies, rules
from cairnlake.operators.sections import sections
from cairnlake.sources.corpus import ensure_checkpoints

BODY = "pre\n# A\none\n\n## B\ntwo\n```\n## no\n```\n# C\n## B\nthree"
REQUESTS = "batch int, id string, seq int, action string, section string, content string, subtree boolean"


def test_edits_of_one_body():
    apply = edits.apply
    assert apply(BODY, "append", "A", "x") == BODY.replace("one\n\n", "one\n\nx\n")
    assert apply(BODY, "prepend", "# A", "x") == BODY.replace("# A\n", "# A\nx\n", 1)
    assert apply(BODY, "replace", "A > B", "x") == BODY.replace("two\n```\n## no\n```", "x")
    assert apply(BODY, "replace", "C", "x", True) == BODY[: BODY.index("# C")] + "# C\nx"
    assert apply(BODY, "remove", "A", None, True) == "pre\n# C\n## B\nthree" and apply(BODY, "remove", "A > B", None) == "pre\n# A\none\n\n# C\n## B\nthree"
    assert apply(BODY, "rename", "C > ## B", "D") == BODY[: BODY.rindex("## B")] + "## D\nthree"
    assert apply(BODY, "replace", "", "new") == BODY.replace("pre", "new", 1)
    assert apply("", "add", None, "# Z") == "# Z" and apply("a\n", "add", None, "# Z") == "a\n# Z"
    assert edits.piece(BODY, "A > B") == "## B\ntwo\n```\n## no\n```"
    for action, path, content in (("remove", "A", None), ("remove", "B", None), ("remove", "no", None), ("rename", "C", "A"), ("replace", "C", "# D"), ("append", "## A > # B", "x"), ("remove", "", None), ("rename", "C", ""), ("what", "C", None), ("add", None, "# A")):
        with pytest.raises(edits.EditError):
            apply(BODY, action, path, content)


def test_batches_are_whole_or_refused(spark):
    ensure_checkpoints(spark)
    notes = spark.createDataFrame([("n", BODY, False), ("m", "# M\nx", False), ("l", "# L", True), ("e", None, False)], "id string, body string, locked boolean")
    asked = [
        (1, "n", 1, "append", "A", "x", False), (1, "m", 1, "append", "M", "y", False), (2, "m", 2, "append", "M", "z", False), (2, "n", 2, "remove", "B", None, False),
        (3, "l", 1, "append", "L", "x", False), (4, "gone", 1, "add", None, "x", False), (4, "m", 3, "add", None, "# Q", False), (5, "e", 1, "add", None, "# E", None),
    ]
    out, refused = bodies.transaction(notes, spark.createDataFrame(asked, REQUESTS))
    assert {r.id: r.body for r in out.collect()} == {"n": BODY.replace("one\n\n", "one\n\nx\n"), "m": "# M\nx\ny", "l": "# L", "e": "# E"}
    assert {r.batch for r in refused.collect()} == {2, 3, 4} and out.columns == notes.columns
    moves = spark.createDataFrame([(1, 1, "n", "m", "C"), (2, 2, "n", "m", "B"), (3, 3, "n", "gone", "A")], "batch int, seq int, src string, dst string, section string")
    out, refused = bodies.transaction(notes, bodies.relocations(notes, moves))
    got = {r.id: r.body for r in out.collect()}
    assert got["n"] == BODY[: BODY.index("\n# C")] and got["m"] == "# M\nx\n# C\n## B\nthree" and {r.batch for r in refused.collect()} == {2, 3}
    within = spark.createDataFrame([(1, 1, "n", "m", "A > B"), (2, 2, "n", "m", "A")], "batch int, seq int, src string, dst string, section string")
    out, refused = bodies.transaction(notes, bodies.relocations(notes, within))
    assert {r.id: r.body for r in out.collect()}["n"] == "pre\n# A\none\n\n# C\n## B\nthree" and {r.batch: r.error for r in refused.collect()} == {2: "section has changed: A"}
    rest, children = bodies.split(notes, spark.createDataFrame([("n", 2, "c", "A > B"), ("n", 1, "c", "C"), ("m", 1, "d", "no")], "id string, seq int, child string, section string"))
    assert [tuple(r) for r in children.collect()] == [("c", "# C\n## B\nthree\n## B\ntwo\n```\n## no\n```", "n")]
    assert {r.id: r.body for r in rest.collect()}["n"] == "pre\n# A\none\n" and rest.count() == 4


def test_trash(spark):
    notes = spark.createDataFrame([("a", "1"), ("b", "2")], "id string, body string")
    trash = spark.createDataFrame([("a", "0", 1), ("c", "3", 1), ("c", "4", 2)], "id string, body string, deleted_at long")
    ids = spark.createDataFrame([("a",), ("c",), ("c",), ("z",)], "id string")
    assert sorted(map(tuple, bodies.restored(notes, trash, ids).collect())) == [("a", "1"), ("b", "2"), ("c", "4")]
    left, more = bodies.deleted(notes, trash, ids, 9)
    assert [r.id for r in left.collect()] == ["b"] and more.count() == 4 and more.where("deleted_at = 9").first().body == "1"


def test_rules(spark):
    frame = spark.createDataFrame
    got = lambda df: sorted(tuple(r) for r in df.collect())
    assert got(rules.axis_mismatch(frame([("a", "x", "x/a.md"), ("b", "x", "y/b.md"), ("c", "innate", ".innate/c.md")], "id string, axis string, path string"))) == [("b", "axis-mismatch")]
    assert got(rules.unknown_fields(frame([("a", {"k": "v"}), ("b", {})], "id string, extra map<string, string>"))) == [("a", "unknown-field", "k")]
    assert got(rules.stale_sources(frame([("a", "/x"), ("a", "/y"), ("a", "note")], "id string, path string"), frame([("/x",)], "path string"))) == [("a", "stale-source", "/y")]
    dated = "\n".join(f"## 2024-01-0{i} x\ny" for i in range(1, 9))
    notes = frame([("a", "한 someLongIdentifier", dated, None, False), ("b-202401", "t", dated, None, False), ("c", "한", "# H\n# I\nx shortName", None, False)], "id string, title string, body string, template string, locked boolean")
    assert got(rules.growth_unbounded(notes, sections(notes))) == [("a", "growth-unbounded", "8")]
    assert got(rules.adjacent_headings(sections(notes))) == [("c", "adjacent-empty-heading", "H")]
    terms = frame([("a", "pending")], "note_id string, status string")
    assert got(rules.enrich_thin(notes, terms)) == [("a", "enrich-thin", "someLongIdentifier")]
    assert got(rules.enrich_thin(notes, frame([("a", "active")], "note_id string, status string"))) == []
    markers = frame([("s", x) for x in ("log-maskin", "log", "flow", "tone")], "subject string, marker string")
    ids = frame([("log-masking",), ("transfer-flow",), ("old-tone",), ("new-tone",)], "id string")
    assert {r.marker: r.near for r in rules.nearest(markers, ids).collect()} == {"log-maskin": "log-masking", "log": "log-masking", "flow": "transfer-flow", "tone": None}


def test_families(spark):
    ensure_checkpoints(spark)
    ids = ["di-box-a", "di-box-b", "di-box-c", "ab-cde-1", "ab-cde-2", "ab-cde-3", "ab-cde", "xy-zzz-1", "xy-zzz-2", "p", "q"]
    notes = spark.createDataFrame([(x, "tech") for x in ids], "id string, axis string")
    edges = spark.createDataFrame([("di-box-a", "di-box-b", "sibling"), ("p", "q", "sibling"), ("p", "gone", "sibling"), ("ab-cde-1", "ab-cde", "reference"), ("ab-cde-2", "p", "reference"), ("ab-cde-3", "ab-cde-2", "assoc")], "src string, dst string, kind string")
    found = rules.families(notes, edges).cache()
    by_key = {}
    for r in found.collect():
        by_key.setdefault((r.key, r.stem, r.has_index), set()).add(r.id)
    assert by_key == {("di-box-a", "di-box", False): {"di-box-a", "di-box-b", "di-box-c"}, ("p", None, False): {"p", "q"}, ("ab-cde", "ab-cde", True): {"ab-cde-1", "ab-cde-2", "ab-cde-3"}}
    assert [tuple(r) for r in rules.gist_missing(found).collect()] == [("di-box-a", "gist-missing", "di-box 3")]
    assert sorted(tuple(r) for r in rules.fragment_unlinked(found, edges).collect()) == [("ab-cde", "fragment-unlinked", "ab-cde 2"), ("di-box-a", "fragment-unlinked", "di-box 1")]
