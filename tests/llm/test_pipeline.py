"""The pipeline stage by stage, each on what the one before kept, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cairnlake.llm import language, packing, pii
from cairnlake.llm.queries import tokenizer_path

from .test_text_operators import linked_by_force, words

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark):
    """Given documents, and rows without id or text, repeated, nearly repeated and long; columns with names that operators use."""
    rng = random.Random(11)
    d = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = d.orderBy("doc_id").collect()
    base = next(r.text for r in rows if r.lang == "en" and len(r.text.split()) > 150)
    near = base.split()
    near[40] = "changed"
    more = [(None, base, "en", "a"), (900, None, "en", "a"), (901, "", "en", None), (902, " ".join(near), "en", "a"), (902, " ".join(near), "en", "a"), (903, None, None, None), (904, "5 5 5", "en", "a"), (905, base + " " + " ".join(words(rng, 30_000)), "en", "a"), (906, base + " mail me at x.y@example.org", "en", "b")]
    d = d.unionByName(spark.createDataFrame([(*r, len(r[1] or "")) for r in more], "doc_id long, text string, lang string, source string, n_chars long"))
    return d.select("*", F.lit("s").alias("s"), F.lit(1).alias("lp"), F.lit(2).alias("spans"), F.lit(0.5).alias("rate"), F.lit("w").alias("words"), F.lit(7).alias("hot_"))


def kept_of(before, after):
    return [r for r in before if r in after]


def test_stages_against_brute_force(spark, corpus, tmp_path):
    docs, seen = corpus, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{name}")
        seen[name] = (docs, spark.read.parquet(f"{tmp_path}/{name}"))
        docs = seen[name][1]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "pii", "mixture", "packing"]
    for name in ("language", "near_duplicates", "pii", "mixture"):
        assert seen[name][1].columns == corpus.columns

    before, after = (x.collect() for x in seen["language"])
    told = language.identify(language.of_documents(corpus)).where("accepted").select("id", "text").collect()
    assert sorted((r.doc_id or -1, r.text) for r in after) == sorted((r.id or -1, r.text) for r in told) and len(after) > 150

    before, after = (x.collect() for x in seen["near_duplicates"])
    one = {}
    for r in before:
        if r.doc_id is not None:
            one.setdefault(r.doc_id, r)
    ids = sorted(one)
    _, roots = linked_by_force([one[i].text for i in ids])
    stay = [i for i, root in zip(ids, roots, strict=True) if ids[root] == i]
    assert sorted(r.doc_id for r in after if r.doc_id is not None) == stay and sum(r.doc_id is None for r in after) == sum(r.doc_id is None for r in before)

    before, after = ({r.doc_id: r for r in x.collect()} for x in seen["pii"])
    assert before.keys() == after.keys()
    for i, r in before.items():
        spans, covered = pii.base_spans(r.text), after[i].text
        assert not any(r.text[a:b] in covered for _, a, b in spans if b - a > 8) and after[i].n_chars == len(covered)
        if not spans and "[TERM]" not in covered:
            assert covered == r.text

    before, after = ([tuple(r) for r in x.collect()] for x in seen["mixture"])
    assert 0.5 * len(before) < len(after) and not [r for r in after if r not in before] and len(set(after)) == len(after)

    before, after = seen["packing"][0].collect(), seen["packing"][1].toPandas()
    ids = {r.doc_id: len(x) // 4 + 1 for r, x in zip(before, packing._tokenizer(tokenizer_path()).encode([r.text or "" for r in before]), strict=True)}
    assert after.groupby("doc_id", dropna=False).length.sum().sum() == sum(ids.values()) and after.groupby("sequence_id").length.sum().max() <= 2048
    for _, own in after.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *np.cumsum(own.length)[:-1]]


def test_pipeline_of_nothing(spark, corpus, tmp_path):
    none = corpus.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, SMALL)
        assert none.count() == 0, name
