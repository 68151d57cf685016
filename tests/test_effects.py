"""What many searches leave behind, against one search after another."""

import random

import pytest

from cairnlake.functions.policy import Tunables
from cairnlake.operators import jobs

EDGE = "src string, dst string, kind string, weight double"
LOG = "id long, ts long, hit_ids array<string>, expand_ids array<string>"


def one_by_one(edges, log, t, cap=1.0):
    w = {(s, d, k): x for s, d, k, x in edges}
    for _, _, hits, extra in sorted(log, key=lambda r: r[0]):
        shown = [x for x in (hits or []) + (extra or []) if x]
        place = {x: shown.index(x) + 1 for x in shown}
        if len(place) < 2:
            continue
        if len(place) <= 8:
            for a in place:
                for b in place:
                    if a < b:
                        w[a, b, "cooccur"] = min(cap, (w.get((a, b, "cooccur")) or 0.0) + t.strengthen_step)
        for (a, b, k), x in w.items():
            if k in ("cooccur", "assoc") and a in place and b in place and x is not None:
                f = 1 + t.rebirth_search_boost / min(place[a], place[b])
                w[a, b, k] = max(x, min(cap, x * f))
    return w


@pytest.mark.parametrize("stretch", [5, 65_536])
def test_edges_after_many_searches(spark, stretch):
    rng = random.Random(7)
    names = [f"n{i:02d}" for i in range(14)]
    edges = [(a, b, k, rng.choice([0.0, 0.2, 0.35, 1.0, 1.7, None])) for a in names for b in names for k in ("cooccur", "assoc", "sibling", "reference") if a < b and rng.random() < 0.3]
    edges += [("n05", "n02", "reference", 0.5), ("gone", "n01", "assoc", 0.4)]
    log = []
    for i in range(60):
        shown = [rng.choice([*names[: rng.choice([3, 14])], None, ""]) for _ in range(rng.choice([0, 1, 2, 3, 5, 12, 20]))]
        cut = rng.randrange(len(shown) + 1)
        log.append((i * 3, i, shown[:cut] if rng.random() < 0.9 else None, shown[cut:]))
    rng.shuffle(log)
    t = Tunables(strengthen_step=0.07, rebirth_search_boost=0.2)
    got = {(r.src, r.dst, r.kind): r.weight for r in jobs.edges_after(spark.createDataFrame(edges, EDGE), spark.createDataFrame(log, LOG), t, stretch=stretch).collect()}
    want = one_by_one(edges, log, t)
    assert got.keys() == want.keys() and len(got) > 60
    assert all(got[k] is want[k] is None or got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert sum(0 < (x or 0) < 1 for x in want.values()) > 30


def test_a_hot_edge_and_no_searches(spark):
    """An edge of 30,000 searches: factors beyond what a double holds; an edge of weight 0 stays there by growth alone."""
    edges = spark.createDataFrame([("a", "b", "assoc", 1e-9), ("a", "c", "assoc", 0.0)], EDGE)
    log = spark.range(30_000).selectExpr("id", "id as ts", "array('a', 'b', 'c', 'd', 'e', 'f', 'g', 'h', 'i') as hit_ids", "cast(null as array<string>) as expand_ids")
    got = {(r.src, r.dst, r.kind): r.weight for r in jobs.edges_after(edges, log, stretch=1_000).collect()}
    assert got == {("a", "b", "assoc"): 1.0, ("a", "c", "assoc"): 0.0}
    assert sorted(map(tuple, jobs.edges_after(edges, log.limit(0)).collect())) == [("a", "b", "assoc", 1e-9), ("a", "c", "assoc", 0.0)]
    usage = spark.createDataFrame([("a", 1, None), ("z", 2, 5)], "note_id string, hit_count long, last_retrieved_at long")
    entities = spark.createDataFrame([("E", "b", 1, 1)], "entity string, note_id string, last_seen_at long, hit_count long")
    out = jobs.effects_after(spark.createDataFrame([(1, 7, ["a", "a"], ["b"]), (2, 6, None, ["a"])], LOG), usage, entities, edges)
    assert sorted(map(tuple, out["usage"].collect())) == [("a", 3, 7), ("z", 2, 5)] and out["entities"].first().hit_count == 2
    assert {(r.src, r.dst, r.kind): r.weight for r in out["edges"].collect()}["a", "b", "cooccur"] == 1.0
