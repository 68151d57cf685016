"""Embeddings and urls, against brute force and on edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnlake.llm import common, embedding_dedup, url_filter

VEC = "vec_id long, embedding array<float>, label int"


def by_force(rows, threshold=0.93):
    root, n = {r[0]: r[0] for r in rows}, {r[0]: 0 for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fine = [r for r in rows if r[1] is not None and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    for i, a in enumerate(fine):
        for b in fine[:i]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], np.float32).astype(float), np.array(b[1], np.float32).astype(float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    n[a[0]] += 1
                    n[b[0]] += 1
                    p, q = find(a[0]), find(b[0])
                    root[max(p, q)] = min(p, q)
    return {i: (n[i], find(i)) for i in n}


@pytest.mark.parametrize("block", [1024, 16])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng, rows = np.random.default_rng(1), []
    for _ in range(30):
        base = rng.standard_normal(64)
        for _ in range(rng.integers(1, 15)):
            rows.append((len(rows), (base + rng.standard_normal(64) * rng.choice([0, 0.1, 0.25, 0.3])).astype(np.float32).tolist(), int(rng.integers(3))))
    for e in (None, [], [0.0] * 64, [None, *[1.0] * 63], [float("nan"), *[1.0] * 63], [float("inf")] * 64, [1.0] * 3, [2.0] * 3, [1e20] * 64, [1e-20] * 64):
        rows += [(len(rows) + k, e, 1) for k in range(2)]
    rows += [(len(rows) + k, rows[0][1], None) for k in range(2)]
    df = spark.createDataFrame(rows, VEC)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df.withColumn("rep", F.lit(1))).collect()}
    want = by_force(rows)
    found, all_ = sum(r.n_links for r in got.values()), sum(n for n, _ in want.values())
    assert all(got[i].n_links <= want[i][0] for i in want) and found >= 0.99 * all_ and len(got) == len(rows)
    assert sum(got[i].component_id == want[i][1] for i in want) >= 0.99 * len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 64))
    y = x[:1] + rng.standard_normal((400, 64)) * 0.35
    a, b = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    errors, hits = [], 0
    for seed in range(20):
        r = embedding_dedup.rotations(64, 1, seed)
        p, q = a @ r.T, b @ r.T
        f = np.abs(p).sum(axis=1) / 8
        errors.append(((np.sign(p) / 8) * q[:1]).sum(axis=1) / f - (a * b[:1]).sum(axis=1))
        hits += embedding_dedup.candidates(p[:1], q, f[:1], 0.93)[0][(a[:1] @ b.T)[0] >= 0.93].mean() if ((a[:1] @ b.T)[0] >= 0.93).any() else 1
    assert abs(np.mean(errors)) < 0.01 and hits >= 19.9


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges for x in (a, b) if a != b}


URLS = [
    ("https://Example.ORG/es/1?x=/y", "example.org", "/es/1", "example.org/es/", "block"), ("http://a.example.org/en/12", "a.example.org", "/en/12", "example.org/en/1", "block"),
    ("http://a.example.org/en/2", "a.example.org", "/en/2", "org/", "allow"), ("http://x.com/fr/a#b", "x.com", "/fr/a", "com/fr/", "allow"), ("http://x.com/de/", "x.com", "/de/", "com/de/", "block"),
    ("http://notorg/", "notorg", "/", None, "allow"), ("org", "", "", None, "allow"), (None, "", "", None, "allow"), ("://org", "org", "", None, "allow"), ("a://b?c://d", "b", "", None, "allow"),
    ("http://ÉX.net/p?q", "Éx.net", "/p", None, "allow"), ("", "", "", None, "allow"), ("http://org/", "org", "/", "org/", "allow"), ("http:///x", "", "/x", None, "allow"),
]


def test_rules(spark):
    df = spark.createDataFrame([(i, u[0], None, "k") for i, u in enumerate(URLS)], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in url_filter.judge(df).collect()}
    for i, (_, *want) in enumerate(URLS):
        assert [got[i].host, got[i].path, got[i].rule, got[i].verdict] == want, URLS[i]
    assert url_filter.judge(df.limit(0)).count() == 0


def test_propagation(spark):
    """Against the dense iteration; hosts linked from trusted pages are allowed, those that link to blocked ones aren't."""
    page = lambda i, host, *to: (i, f"http://{host}/de/", "".join(f"<a href='//{t}/'>" for t in to))
    rows = [page(0, "good.org", "friend.net"), page(1, "friend.net", "good.org"), page(2, "spam.net", "bad.com", "bad.com"), page(3, "bad.com", "spam.net"), page(4, "alone.net")]
    got = {r.host: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {h: r.verdict for h, r in got.items()} == {"good.org": "allow", "friend.net": "allow", "spam.net": "block", "bad.com": "block", "alone.net": "allow"}
    rng = np.random.default_rng(4)
    n, w = 30, rng.integers(0, 2, (30, 30)) * rng.integers(0, 2, (30, 30)).astype(float)
    np.fill_diagonal(w, 0)
    edges = spark.createDataFrame([(f"h{i}", f"h{j}", float(w[i, j])) for i in range(n) for j in range(n) if w[i, j]], "src string, dst string, n double")
    seeds = spark.createDataFrame([("h0", 2.0, 0.0), ("h1", 1.0, 0.0), ("h2", 0.0, 5.0)], "host string, trust double, distrust double")
    got = {r.host: r for r in url_filter.propagate(edges, seeds, 6).collect()}
    for side, m, s in (("trust", w, [2 / 3, 1 / 3, 0]), ("distrust", w.T, [0, 0, 1])):
        p = m / np.maximum(m.sum(axis=1, keepdims=True), 1e-300)
        seed = np.array([*s, *[0.0] * (n - 3)])
        r = seed
        for _ in range(6):
            r = 0.85 * r @ p + 0.15 * seed
        assert np.allclose([getattr(got[f"h{i}"], side) if f"h{i}" in got else 0.0 for i in range(n)], r / r.sum())


@pytest.mark.parametrize("in_memory", [True, False])
def test_propagation_settles_on_a_long_chain(spark, monkeypatch, in_memory):
    """Against the solved linear system; hosts far from the blocked one still have distrust."""
    n = 40
    if not in_memory:
        monkeypatch.setattr(url_filter, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(url_filter, "TOLERANCE", 1e-3)
        n = 12
    edges = spark.createDataFrame([(f"h{i}", f"h{i + 1}", 1.0) for i in range(n - 1)] + [("h3", "h0", 2.0)], "src string, dst string, n double")
    seeds = spark.createDataFrame([("h1", 1.0, 0.0), (f"h{n - 1}", 0.0, 1.0)], "host string, trust double, distrust double")
    got = {r.host: r for r in url_filter.propagate(edges, seeds).collect()}
    w = np.zeros((n, n))
    w[np.arange(n - 1), np.arange(1, n)], w[3, 0] = 1, 2
    for side, m, at in (("trust", w, 1), ("distrust", w.T, n - 1)):
        p = m / np.maximum(m.sum(axis=1, keepdims=True), 1e-300)
        r = np.linalg.solve(np.eye(n) - 0.85 * p.T, 0.15 * np.eye(n)[at])
        assert np.allclose([getattr(got[f"h{i}"], side) for i in range(n)], r / r.sum(), rtol=0, atol=1e-12 if in_memory else 0.02)
    assert got["h0"].distrust > 0
