"""Resharding, vector codes and the filter audit, against brute force and on edge cases."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairnlake.llm import filter_audit, resharding, vector_codes
from cairnlake.llm.queries import op11_resharding, op12_vector_codes

ODD = [None, "", " ", "\n", "a", "A#", "word " * 40_000, "the same", "the same", "ÀÉ 'x\x00y'"]


# -- resharding


def least_moved(sizes, capacities, cost):
    """The smallest cost over all integer flows."""
    best = math.inf

    def go(i, room, paid):
        nonlocal best
        if paid >= best:
            return
        if i == len(sizes):
            best = paid
            return
        for split in itertools.product(*[range(min(sizes[i], r) + 1) for r in room]):
            if sum(split) == sizes[i]:
                go(i + 1, [r - x for r, x in zip(room, split, strict=True)], paid + sum(c * x for c, x in zip(cost[i], split, strict=True)))

    go(0, list(capacities), 0)
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=3), st.lists(st.integers(0, 4), min_size=1, max_size=3), st.lists(st.integers(0, 5), min_size=9, max_size=9), st.booleans())
def test_transfers_cost_least(sizes, more, costs, plain):
    capacities = [*more[:-1], more[-1] + max(0, sum(sizes) - sum(more))]
    cost = np.array(costs, float).reshape(3, 3)[: len(sizes), : len(capacities)]
    flow = resharding.transfers(sizes, capacities, None if plain else cost)
    assert flow.sum(axis=1).tolist() == sizes and (flow.sum(axis=0) <= capacities).all() and (flow >= 0).all()
    cost = 1 - np.eye(len(sizes), len(capacities)) if plain else cost
    assert (flow * cost).sum() == least_moved(sizes, capacities, cost.tolist())


def test_transfers_refuse_too_little_room():
    with pytest.raises(ValueError):
        resharding.transfers([3, 4], [6])
    assert resharding.transfers([], [5]).shape == (0, 1)


def spread(shards, sizes):
    out = [0] * (max(shards) + 1)
    for s, b in zip(shards, sizes, strict=True):
        out[s] += b
    return out


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_resharding_query(spark, sf):
    """The law, the places, what is said of each text, and how many bytes move."""
    d = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").toPandas().set_index("doc_id")
    got = op11_resharding(spark, f"/root/testdata/sf{sf}").toPandas().set_index("doc_id").sort_index()
    raw = d.text.sort_index().map(lambda t: (t or "").encode())
    assert got.index.tolist() == raw.index.tolist() and (got["size"] == raw.map(len) + 8).all() and (got.text_crc32 == raw.map(zlib.crc32)).all()
    assert set(got.law) == {"bytes"} and got.grown_shard.isna().all() and set(got.shard) <= set(range(24))
    assert got.groupby("shard").slot.agg(sorted).map(lambda x: x == list(range(len(x)))).all()
    held, mean, most = got.groupby("shard")["size"].sum().reindex(range(24), fill_value=0), got["size"].sum() / 24, got["size"].max()
    assert (held - mean).abs().max() <= most and (sf == "0.001" or (held - mean).abs().max() <= 0.02 * mean), (held - mean).abs().max() / mean
    old = got.groupby("old_shard")["size"].sum()
    moved, least = got[got.shard != got.old_shard]["size"].sum(), (old - mean).clip(lower=0).sum()
    assert abs(moved - least) <= 16 * most and (sf == "0.001" or abs(moved - least) <= 0.02 * least)
    # equal texts go apart only where a stretch ends
    assert (got.groupby(raw).shard.nunique() > 1).sum() <= 16 + 24


def test_resharding_of_any_rows(spark):
    """Hot groups, nulls, clashing names, repeated rows, given capacities; an empty table."""
    rng = random.Random(5)
    rows = [(i, None if i % 50 == 0 else "copy" if i % 3 == 0 else "t" * rng.randrange(1, 60), i % 7 if i % 11 else None, "x") for i in range(6000)] + [(1, "same", 2, "x")] * 40 + [(None, None, None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, at int, block string")
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 8
    args = (F.col("at"), size, F.coalesce("text", F.lit("")))
    capacities = [60_000, 0, 30_000, 10_000, 100_000]
    got = resharding.reshard(df, *args, capacities).toPandas()
    assert len(got) == len(rows) and got.columns.tolist() == ["doc_id", "text", "at", "old_shard", "shard", "block", "slot"]
    assert sorted(map(repr, zip(got.doc_id.fillna(-9).astype(int), got.text.fillna("-"), strict=True))) == sorted(repr((-9 if r[0] is None else r[0], r[1] or "-")) for r in rows)
    assert got.groupby("shard").slot.agg(sorted).map(lambda x: x == list(range(len(x)))).all()
    own = got.text.map(lambda t: len(t or "") + 8)
    held = spread(got.shard, own)
    assert all(h <= c + 7 * 68 for h, c in zip(held, capacities, strict=False)) and held[1] <= 68 * 7 and sum(held) == own.sum()
    stays = sum(min(s, c) for s, c in zip(spread(got.old_shard, own), capacities, strict=False))
    assert abs(own[got.shard == got.old_shard].sum() - stays) <= 5 * 68
    assert got.groupby(["old_shard", "block"]).size().max() < 1500 and resharding.reshard(df.limit(0), *args, 24).count() == 0
    with pytest.raises(ValueError):
        resharding.reshard(df, *args, [10, 10])


def test_rewrite_touches_affected_files_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(resharding, "FILE_BLOCKS", 20)
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    size = F.octet_length("text") + 8
    first = resharding.reshard(d, F.pmod("doc_id", F.lit(3)), size, F.col("text"), 6)
    resharding.store(first, f"{tmp_path}")
    held = resharding.stored(spark, f"{tmp_path}", 0)
    total = held.agg(F.sum(size)).first()[0]
    # one shard is to lose a tenth to a new one, all others keep what they have
    sizes = {r.shard: r.b for r in held.groupBy("shard").agg(F.sum(size).alias("b")).collect()}
    capacities = [int(sizes[0] * 0.9), *[sizes[k] for k in range(1, 6)], total]
    moved = resharding.reshard(held, F.col("shard"), size, F.col("text"), capacities)
    kept, written = resharding.rewrite(f"{tmp_path}", 0, moved)
    assert kept > 0 and written > 0
    after = resharding.stored(spark, f"{tmp_path}", 1)
    files = lambda df: {(r.shard, r.file) for r in df.select("shard", "file").distinct().collect()}
    assert len(files(held) & files(after)) == kept and {s for s, _ in files(held) - files(after)} == {0}
    assert sorted((r.doc_id, r.text) for r in after.select("doc_id", "text").collect()) == sorted((r.doc_id, r.text) for r in d.collect())
    where = {r.doc_id: r.shard for r in moved.collect()}
    assert all(where[r.doc_id] == r.shard for r in after.select("doc_id", "shard").collect())
    # readers of the old version go on
    assert resharding.stored(spark, f"{tmp_path}", 0).count() == d.count()


# -- vector codes


def codes_by_force(rows):
    """rows(vec_id, vector, label): as the contract says, with Python's integers."""
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:16]
    width = len(first[0][1])
    kept, step = [r for r in kept if len(r[1]) == width], width // 8
    part = lambda v, p: v[p * step : (p + 1) * step]
    books = [[part(r[1], p) for r in first if len(r[1]) == width] for p in range(8)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, p: min((far(part(v, p), c), e) for e, c in enumerate(books[p]))
    for _ in range(6):
        told = [[near(r[1], p)[1] for r in kept] for p in range(8)]
        books = [[[sum(x) // len(own) for x in zip(*own, strict=True)] if (own := [part(r[1], p) for r, t in zip(kept, told[p], strict=True) if t == e]) else c for e, c in enumerate(books[p])] for p in range(8)]
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out = [(i, [near(v, p) for p in range(8)], label) for i, v, label in kept]
    out = [(i, "".join(f"{e:02x}" for _, e in n), sum(d for d, _ in n), label) for i, n, label in out]
    return sorted(((i, c, d, sum(x[2] for x in out if x[3] == label), sha) for i, c, d, label in out), key=repr)


@pytest.mark.parametrize("width", [64, 8])
def test_vector_codes(spark, width):
    rng = np.random.default_rng(7)
    rows = [(int(i), (rng.standard_normal(width) * rng.choice([0.1, 1, 30])).astype(np.float32).tolist(), None if i % 5 == 0 else int(i % 3)) for i in rng.permutation(300)]
    rows += [(400 + k, rows[3][1], 1) for k in range(60)] + [(7, rows[9][1], 2)] * 2 + [(None, rows[5][1], 0)] + [(500 + k, [0.5] * width, 0) for k in range(5)]
    rows += [(-5, None, 1), (-4, [], 1), (-3, [float("nan")] + [1.0] * (width - 1), 1), (-2, [float("inf")] * width, 0), (-1, [None] * width, 0), (600, [1.0] * (width + 8), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("code", F.lit("x")).repartition(5)
    got = sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.compress(df).collect()), key=repr)
    assert got == codes_by_force(rows) and len(got) == 300 + 60 + 2 + 1 + 5


def test_vector_codes_of_few_and_odd_vectors(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert vector_codes.compress(make([])).count() == vector_codes.compress(make([(1, None, 1)])).count() == 0
    few = [(3, [0.5, -0.25] * 8, None), (1, [-1.0, 2.0] * 8, None), (2, [1e-9, -1e-9] * 8, 4)]
    got = sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.compress(make(few)).collect()), key=repr)
    assert got == codes_by_force(few)
    # five components are eight with zeros behind; huge ones saturate
    assert {r.code for r in vector_codes.compress(make([(1, [1.0] * 5, 1)])).collect()} == {"00" * 8}
    assert vector_codes.compress(make([(1, [3e38] * 64, 1), (2, [-3e38] * 64, 1)])).where("error = 0").count() == 2


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 30), st.integers(1, 16), st.integers(1, 8), st.integers(0, 2**32 - 1), st.sampled_from([2, 50, 10**6]))
def test_partial_distances_give_the_nearest(n, entries, dims, seed, most):
    rng = np.random.default_rng(seed)
    x, c = rng.integers(-most, most, (n, dims)), rng.integers(-most, most, (entries, dims))
    index, best = vector_codes.nearest(x, c)
    full = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert (best == full.min(axis=1)).all() and (index == full.argmin(axis=1)).all()


def test_vector_codes_query(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    got = sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in op12_vector_codes(spark, "/root/testdata/sf0.001").collect()), key=repr)
    assert got == codes_by_force(rows)


# -- filter audit


def audit_by_force(docs, labels):
    text = lambda t: t or ""
    good, toxic = ({i for i, q, x in labels if i is not None and (q, x)[k] == 1} for k in (0, 1))
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[text(t)] = min(first.get(text(t), i), i)
    fails = {}
    for i, t, lang in docs:
        w = re.findall("[^\x20\x09-\x0d]+", text(t))
        f = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", text(t))) > 10 * len(text(t)), "D": bool(re.search("[#$%&*|]", text(t))), "E": i is not None and i > first[text(t)]}
        fails.setdefault(lang or "", []).append((i, {k for k, v in f.items() if v}))
    out = {}
    for part, own in fails.items():
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [x for x in left if letter in x[1]]
                kept = [x for x in left if letter not in x[1]]
                out[part, "".join(order), step] = (
                    len(kept), len(gone), sum(letter in x[1] for x in own) - len(gone), sum(x[1] == {letter} for x in own), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone),
                )
                left = kept
    shapley = {}
    for (part, order, step), v in out.items():
        shapley[part, order[step - 1]] = shapley.get((part, order[step - 1]), 0) + v[1]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit(spark):
    rng = random.Random(9)
    rows = []
    for i in range(150):
        w = [rng.choice(["a", "b", "Cc", "DD", "e#", "é", f"w{rng.randrange(500)}"]) for _ in range(rng.choice([3, 60, 99, 100, 101, 150]))]
        rows.append((i, rng.choice([" ", "\n", "\t \x0b"]).join(w), rng.choice(["en", "de", None, ""])))
    rows += [(1000 + i, rows[i % 7][1], "en") for i in range(60)] + [(2000 + i, t, rng.choice(["en", None])) for i, t in enumerate(ODD)] + [rows[4]] * 3 + [(4, "other", "de"), (None, rows[5][1], "en"), (None, "x", "fr")]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 1100, 2)] + [(3, 0, 1), (3, 1, None), (None, 1, 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("part", F.lit("p")).withColumn("key", F.lit(1)).repartition(4)
    k = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("q"))
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in filter_audit.audit(d, k).collect()}
    want = audit_by_force(rows, labels)
    assert got == want and len(got) == 600 * len({r[2] or "" for r in rows})
    assert filter_audit.audit(d.limit(0), k).count() == 0
    assert filter_audit.audit(d, k.limit(0)).agg(F.sum("good_lost")).first()[0] == 0
