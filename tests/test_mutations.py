"""Changes of notes, policies and vectors on small frames."""

import numpy as np
import pytest

from cairnlake.functions import rulesets
from cairnlake.operators import graph, mutations, spectral
from cairnlake.plans import fixtures, queries
from cairnlake.sources.corpus import ensure_checkpoints

MOVES = [("b", "a"), ("c", "a")]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_flags_count_reopen_and_close(spark):
    schema = "note_id string, flag string, reason string, created_at long, last_flagged_at long, flag_count long, resolved_at long"
    have = frame(spark, [("a", "x", "r", 1, 1, 1, None), ("b", "x", "r", 1, 1, 2, 5), ("d", "x", "r", 1, 1, 1, 4)], schema)
    new = frame(spark, [("a", "x", "n1", 7), ("a", "x", "n2", 9), ("b", "x", "n", 8), ("c", "x", "n" * 300, 8)], "note_id string, flag string, reason string, ts long")
    got = {r.note_id: tuple(r)[2:] for r in mutations.flag(have, new).collect()}
    assert got == {"a": ("n2", 1, 9, 3, None), "b": ("n", 1, 8, 3, None), "c": ("n" * 200, 8, 8, 1, None), "d": ("r", 1, 1, 1, 4)}
    assert sorted(r.note_id for r in mutations.flag_events(have, new).collect()) == ["b", "c"]
    closed = {r.note_id: r.resolved_at for r in mutations.resolve(have, frame(spark, [("a", "x", 20), ("b", "x", 20)], "note_id string, flag string, ts long")).collect()}
    assert closed == {"a": 20, "b": 5, "d": 4}
    merged = {r.note_id: tuple(r)[2:] for r in mutations.absorb_flags(have, frame(spark, MOVES, "old string, new string")).collect()}
    assert merged == {"a": ("r", 1, 1, 3, None), "d": ("r", 1, 1, 1, 4)}


def test_merged_notes(spark):
    moves = frame(spark, MOVES, "old string, new string")
    usage = frame(spark, [("a", 1, 5, 100), ("b", 2, None, 50), ("e", 1, 7, 3)], "note_id string, hit_count long, last_retrieved_at long, created_at long")
    assert sorted(tuple(r) for r in mutations.absorb_usage(usage, moves).collect()) == [("a", 3, None, 100), ("e", 1, 7, 3)]
    terms = frame(spark, [("a", "alias", "t", "pending", 1), ("b", "alias", "t", "active", 2), ("c", "alias", "t", "active", 3), ("a", "alias", "u", "rejected", 4), ("c", "alias", "u", "rejected", 5)], "note_id string, kind string, term string, status string, created_at long")
    assert sorted(tuple(r) for r in mutations.absorb_terms(terms, moves).collect()) == [("a", "alias", "t", "active", 2), ("a", "alias", "u", "rejected", 4)]
    seen = frame(spark, [("a", "split", 1, 10, 1, 1, "x", 5), ("b", "split", 2, 20, 2, 2, "y", 6), ("c", "split", 1, 30, 3, 3, "z", 6)], "note_id string, kind string, dismiss_count long, word_count long, section_count long, generation long, reason string, last_dismissed_at long")
    assert tuple(mutations.absorb_dismissals(seen, moves).first()) == ("a", "split", 4, 6, 20, 2, 2, "y")
    rows = frame(spark, [("a", 1), ("b", 2), ("z", 3)], "note_id string, v long")
    assert sorted(tuple(r) for r in mutations.migrate(rows, frame(spark, [("b", "a")], "old string, new string")).collect()) == [("a", 2), ("z", 3)]


def test_edges_terms_and_meta(spark):
    e = frame(spark, [("a", "b", "assoc", 0.9), ("a", "b", "sibling", 0.5)], "src string, dst string, kind string, weight double")
    p = frame(spark, [("b", "a", 1.0), ("c", "b", 0.5), ("b", "c", 1.0), ("d", "d", 1.0), ("d", "a", None)], "src string, dst string, confidence double")
    got = {(r.src, r.dst): r.weight for r in mutations.propose(e.where("kind = 'assoc'"), p).collect()}
    assert got == {("a", "b"): 0.9, ("b", "c"): pytest.approx(0.48), ("a", "d"): pytest.approx(0.48)}
    linked = {(r.src, r.dst): r.weight for r in mutations.link_siblings(e, frame(spark, [(1, "a"), (1, "b"), (1, "c")], "key long, id string")).where("kind = 'sibling'").collect()}
    assert linked == {("a", "b"): 0.5, ("a", "c"): 1.0, ("b", "c"): 1.0}
    assert mutations.lineage(e, frame(spark, [("b", "a", "supersedes"), ("b", "a", "supersedes")], "src string, dst string, kind string")).count() == 3
    terms = frame(spark, [("a", "k", "t", "rejected", 1, "why"), ("a", "k", "u", "active", 1, None)], "note_id string, kind string, term string, status string, created_at long, reject_reason string")
    new = frame(spark, [("a", "k", "t", 9), ("a", "k", "u", 9), ("a", "k", "v", 9)], "note_id string, kind string, term string, created_at long")
    assert sorted(tuple(r)[2:] for r in mutations.add_terms(terms, new).collect()) == [("t", "pending", 9, None), ("u", "active", 1, None), ("v", "pending", 9, None)]
    schema = "note_id string, namespace string, key string, value string, updated_at long"
    meta = mutations.set_meta(frame(spark, [("a", "n", "k", "1", 1), ("a", "n", "l", "1", 1)], schema), frame(spark, [("a", "n", "k", "2", 2), ("a", "n", "l", None, 2)], schema))
    assert [tuple(r) for r in meta.collect()] == [("a", "n", "k", "2", 2)]
    notes = frame(spark, [("a", False), ("b", True)], "id string, stale boolean")
    assert [r.stale for r in mutations.marked(notes, notes.where("id = 'a'")).orderBy("id").collect()] == [True, True]


def test_policies():
    rules = [("ops.whitelist", '{"ops": ["*"]}'), ("ops.whitelist", '{"ops": ["a", "b"]}'), ("ops.whitelist", '{"ops": ["b", "c"]}'), ("ops.deny", '{"ops": ["c"], "axis": "tech"}'), ("consolidate.mode", '{"mode": "signal_only"}'), ("other", "{}")]
    p = rulesets.effective("tech", rules)
    assert p.whitelist == {"b"} and p.allows("b") and not p.allows("a") and p.deny == {"c"} and p.mode == "signal_only" and p.merge_auto
    assert rulesets.effective("flow", rules).deny == frozenset() and rulesets.effective("flow", []).allows("x")
    for bad in (("ops.deny", "[]"), ("ops.deny", "{}"), ("ops.deny", '{"ops": [1]}'), ("merge.auto", '{"enabled": 1}'), ("consolidate.mode", '{"mode": "x"}'), ("frontmatter.schema", "{}"), ("x", None)):
        with pytest.raises(rulesets.MalformedRule):
            rulesets.effective("tech", [bad])


def test_truncated_svd_keeps_the_gram_matrix(spark):
    ensure_checkpoints(spark)
    a = np.array([[0, 2, 1, 0], [2, 0, 3, 0], [1, 3, 0, 1], [0, 0, 1, 0]], float)
    m = frame(spark, [(f"n{i}", f"n{j}", float(a[i, j])) for i in range(4) for j in range(4) if a[i, j]], "i string, j string, value double")
    got = np.array([r.vec for r in graph.truncated_svd(m, 3).orderBy("id").collect()])
    u, s, _ = np.linalg.svd(a)
    want = u[:, :3] * s[:3]
    assert got.shape == (4, 3) and np.allclose(got @ got.T, want @ want.T, atol=1e-6)


def dense_rows(cells, dim):
    names = sorted({c[0] for c in cells} | {c[1] for c in cells})
    a = np.zeros((len(names), len(names)))
    for i, j, x in cells:
        a[names.index(i), names.index(j)] = x
    u, s, _ = np.linalg.svd(a)
    return names, (u * s)[:, : min(dim, len(names) - 1)]


def cosines(m):
    size = np.linalg.norm(m, axis=1)
    return (m @ m.T) / np.maximum(np.outer(size, size), 1e-300)


def test_symmetric_svd_against_a_dense_one(spark):
    ensure_checkpoints(spark)
    rng = np.random.default_rng(3)
    # a wide spectrum in more rows than the blocks hold, negative values, a row of its own, and rank 2
    q = np.linalg.qr(rng.normal(size=(90, 90)))[0]
    full = (q * (np.array([1, -1])[np.arange(90) % 2] * 0.6 ** np.arange(90))) @ q.T
    cells = [(f"n{i:02d}", f"n{j:02d}", float(full[i, j])) for i in range(90) for j in range(90)] + [("solo", "solo", 2.0)]
    for given, dim, extra, steps in ((cells, 5, 3, 4), ([("a", "b", 2.0), ("b", "a", 2.0), ("c", "c", 0.0), ("d", "d", 0.0)], 3, 10, 6)):
        got = spectral.symmetric_svd(frame(spark, given, "i string, j string, value double"), dim, extra, steps).orderBy("id").collect()
        names, want = dense_rows(given, dim)
        m = np.array([r.vec for r in got])
        assert [r.id for r in got] == names and m.shape == want.shape
        assert np.allclose(m @ m.T, want @ want.T, atol=1e-7) and np.allclose(np.linalg.norm(m, axis=0), np.linalg.norm(want, axis=0), atol=1e-7)
    assert [tuple(r) for r in spectral.symmetric_svd(frame(spark, [("a", "a", 1.0)], "i string, j string, value double")).collect()] == [("a", [])]
    assert spectral.symmetric_svd(frame(spark, [], "i string, j string, value double")).count() == 0


def test_graph_vectors_of_a_table(spark):
    """Cosines as those of a dense decomposition, to 1e-6."""
    sf = "/root/testdata/sf0.001"
    got = {r.id: r.vec for r in queries.graph_vectors(spark, sf).collect()}
    names, want = dense_rows([tuple(r) for r in graph.ppmi(fixtures.edges(spark, sf)).collect()], 48)
    assert sorted(got) == names and len(names) > 100
    assert np.abs(cosines(np.array([got[x] for x in names])) - cosines(want)).max() < 1e-6


def test_symmetric_svd_writes_its_blocks_once(spark):
    from pathlib import Path

    ensure_checkpoints(spark)
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    written = lambda: sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
    rng = np.random.default_rng(5)
    cells = [(f"n{i:03d}", f"n{(i + d) % 400:03d}", float(x)) for i in range(400) for d, x in zip((1, 7, 90), rng.normal(size=3), strict=True)]
    both = frame(spark, cells + [(j, i, x) for i, j, x in cells], "i string, j string, value double")
    before = written()
    assert spectral.symmetric_svd(both, 20, 0, 8, 0.0).count() == 400
    assert written() - before < 3_000_000  # all blocks anew each step, twice, are 4.6 MB; once, they are 0.5 MB and the products as much
