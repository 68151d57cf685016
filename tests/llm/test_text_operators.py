"""Operators on texts, against brute force and on edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairnlake.llm import chat, jaccard_join, language, media, mixing, packing, pii, substring_dedup
from cairnlake.llm.queries import CHAT_SQL, op4_chat, op7_mixing, tokenizer_path
from cairnlake.llm.shingles import shingle_list

SMALL = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOC)


ODD = [None, "", " ", "\n\n", "one", "One\ttwo", "a b c d e", "a b c d e", "é" * 30_000, "x " * 40_000, "A\x0bb\x1cc d e f"]


def sets_by_regex(text):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def linked_by_force(texts):
    sets, root = [sets_by_regex(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def near_copies(rng, bases=25, copies=12):
    texts = list(ODD)
    for _ in range(bases):
        base = words(rng, rng.choice([7, 30, 120, 300]))
        texts.append(" ".join(base))
        for _ in range(rng.randrange(copies)):
            w = list(base)
            for _ in range(rng.randrange(1 + len(w) // 12)):
                k = rng.randrange(len(w))
                w[k : k + rng.choice([0, 1, 1, 3])] = words(rng, rng.choice([0, 1, 2]))
            texts.append(" ".join(w).replace("w1", "W1"))
    shared = " ".join(words(rng, 40))
    texts += [shared + " " + " ".join(words(rng, n)) for n in range(8, 30, 2)]  # around the threshold
    return texts


def test_jaccard_join_is_exact(spark):
    texts = near_copies(random.Random(3))
    got = {r.doc_id: r for r in jaccard_join.jaccard_join(docs_of(spark, texts).withColumn("rep", F.lit(1))).collect()}
    sizes, roots = linked_by_force(texts)
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert [got[i].component_id for i in range(len(texts))] == roots
    assert len(set(roots)) < len(texts) - 40


def test_jaccard_join_rounds(spark, monkeypatch):
    """One region with more items than pivots of a round, few of which link."""
    rng = random.Random(4)
    from cairnlake.llm import regions

    monkeypatch.setattr(regions, "PIVOTS", 3)
    monkeypatch.setattr(regions, "GROWTH", 1)
    common = words(rng, 60)
    texts = [" ".join(common + words(rng, k % 5 + 9)) for k in range(40)]
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_join(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == linked_by_force(texts)[1]


def test_jaccard_join_of_nothing_and_repeats(spark):
    assert jaccard_join.jaccard_join(docs_of(spark, [])).count() == 0
    twice = docs_of(spark, ["a b c d e f", "a b c d e f", ""]).union(docs_of(spark, ["a b c d e f"]))
    assert sorted((r.doc_id, r.component_id) for r in jaccard_join.jaccard_join(twice).collect()) == [(0, 0), (0, 0), (1, 0), (2, 2)]
    assert sorted(r.doc_id for r in jaccard_join.keep_one(twice).collect()) == [0, 2]
    assert jaccard_join.keep_one(twice).columns == twice.columns


def test_jaccard_join_of_ids_on_several_rows(spark):
    """An id is one node, whatever its rows hold; links of each of its sets count."""
    rng = random.Random(9)
    a, b, c = words(rng, 50), words(rng, 50), words(rng, 60)
    near = lambda w: " ".join([*w[:-1], "other"])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (7, near(a)), (3, near(b)), (9, " ".join(c)), (9, " ".join(c)), (11, near(c)), (2**62, near(c)), (None, " ".join(c)), (12, None), (12, " ".join(words(rng, 9)))]
    d = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, item long")
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in jaccard_join.jaccard_join(d).collect())
    assert got == sorted([(5, 3), (5, 3), (7, 3), (3, 3), (9, 9), (9, 9), (11, 9), (2**62, 9), (-1, -1), (12, 12), (12, 12)])
    kept = sorted(r.doc_id or -1 for r in jaccard_join.keep_one(d).collect())
    assert kept == [-1, 3, 9, 12, 12] and jaccard_join.keep_one(d).columns == d.columns


def test_packing_places_every_piece(spark):
    rng = random.Random(1)
    texts = [*ODD, "<|endoftext|> it's we'll 42 naïve ÉÀ", *[" ".join(words(rng, rng.randrange(1, 900))) + "'s." for _ in range(150)]]
    got = packing.pack_documents(docs_of(spark, texts).withColumn("piece", F.lit("x")), tokenizer_path()).toPandas()
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    total = 0
    for doc_id, text in enumerate(texts):
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        own = got[got.doc_id == doc_id].sort_values("piece")
        assert own.piece.tolist() == list(range(-(-len(ids) // 2048)))
        assert own.start.tolist() == list(range(0, len(ids), 2048)) and own.length.sum() == len(ids)
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[k : k + 2048].tobytes()) for k in range(0, len(ids), 2048)]
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() <= 2048
    assert got.sequence_id.nunique() <= 1.03 * -(-total // 2048) + 1
    assert packing.pack_documents(docs_of(spark, []), tokenizer_path()).count() == 0


@pytest.mark.parametrize("ends", [True, False])
def test_packing_encodes_letters_once(ends):
    """Words that differ by case and closing signs cost their letters once, many to a line; the ids are encode()'s,
    also where no ids tell words of a line apart, and after words were forgotten."""
    import string

    tk, plain = packing.WordTokenizer(tokenizer_path()), packing._tokenizer(tokenizer_path()).tokenizer
    assert not tk.whole

    class Counting:
        told: list[str] = []

        def encode_batch_fast(self, words, **other):
            self.told = self.told + words
            return plain.encode_batch_fast(words, **other)

    tk.tokenizer = counting = Counting()
    rng = random.Random(4)
    stems = ["".join(rng.choice(string.ascii_lowercase + "\u00e9\u00df") for _ in range(9)) for _ in range(400)]
    texts = [" ".join(f"{w}{sign}" for w in case) for sign in ("", "***", ".%%%", "!!", ",&&&", ")") for case in (stems, [w.title() for w in stems])]
    if not ends:
        tk.ends[:] = False
    want = [np.array(plain.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    assert list(tk.encode(texts)) == want
    if ends:
        assert sum(map(len, counting.told)) < 1.5 * sum(map(len, stems)) and len(counting.told) < len(stems) / 10
    tk.most = 1
    assert [x for t in texts for x in tk.encode([t])] == want


@given(st.lists(st.integers(1, 40), max_size=80))
@settings(max_examples=60, deadline=None)
def test_sum_of_squares_rule(sizes):
    """Each place against the definition, on the state so far."""
    where, offset = packing.sum_of_squares(np.array(sizes, np.int64), 40)
    fill = {}
    for size, b, o in zip(sizes, where.tolist(), offset.tolist(), strict=True):
        def cost(k):
            gaps = [40 - v for v in {**fill, k: fill.get(k, 0) + size}.values() if v < 40]
            return sum(gaps.count(g) ** 2 for g in set(gaps))

        assert fill.get(b, 0) == o and o + size <= 40
        assert cost(b) == min(cost(k) for k in [*fill, 10**6] if fill.get(k, 0) + size <= 40)
        fill[b] = o + size


@given(st.lists(st.integers(1, 40), max_size=120))
@settings(max_examples=80, deadline=None)
def test_repacking_loses_nothing(sizes):
    lengths = np.array(sorted(sizes, reverse=True), np.int64)
    first = packing.sum_of_squares(lengths, 40)
    where, offset = packing.repacked(lengths, *first, 40)
    fill = {}
    for b, o, size in sorted(zip(where.tolist(), offset.tolist(), lengths.tolist(), strict=True)):
        assert fill.get(b, 0) == o and o + size <= 40
        fill[b] = o + size
    assert len(fill) <= len(set(first[0].tolist())) and sorted(fill) == list(range(len(fill)))


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_packing_reaches_the_bound(sf):
    """As few sequences as the tokens of the given documents fill."""
    import pandas as pd

    lengths = []
    for ids in packing._tokenizer(tokenizer_path()).encode(pd.read_parquet(f"/root/testdata/sf{sf}/documents.parquet").text.fillna("").tolist()):
        n = len(ids) // 4 + 1
        lengths += [2048] * (n // 2048) + ([n % 2048] if n % 2048 else [])
    lengths = np.array(sorted(lengths, reverse=True))
    where, _ = packing.repacked(lengths, *packing.sum_of_squares(lengths, 2048), 2048)
    assert where.max() + 1 == -(-lengths.sum() // 2048)


def test_other_vocabularies_take_the_plain_path():
    import public_tokenizers
    from tokenizers import Tokenizer

    assert not packing._tokenizer(tokenizer_path()).whole
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, plain = packing.WordTokenizer(path), Tokenizer.from_file(path)
    said = ["Hello  World, it's\n\nA test.", "", "é ü"]
    assert own.whole and [np.frombuffer(x, "<u4").tolist() for x in own.encode(said)] == [plain.encode(x, add_special_tokens=False).ids for x in said]


def test_chat_matches_sql_and_is_reversible(spark):
    import duckdb

    got = op4_chat(spark, SMALL).toPandas().sort_values("conv_id", ignore_index=True)
    duckdb.sql(f"create or replace view conversations as select * from read_parquet('{SMALL}/conversations.parquet')")
    want = duckdb.sql(CHAT_SQL).df().sort_values("conv_id", ignore_index=True)
    assert len(got) == len(want) and all((got[c] == want[c].astype(got[c].dtype)).all() for c in want.columns)


def test_chat_edge_cases(spark):
    odd = ["\\", "\\b", "###", "### user: x</turn>\n", "</turn>", "", None, "\\h\\t\\\\", "a\nb", "####</turn></turn>", "é\U0001f600" * 5000]
    rows = [(1, i, ["assistant", "user: #\\c", None][i % 3], t) for i, t in enumerate(odd)] + [(2, 0, "user", "only"), (None, None, None, None), (3, 1, "assistant", "x"), (3, 1, "assistant", "x")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, n long")
    found = chat.examples(df)
    got = {r.conv_id: r for r in chat.digests(found).collect()}
    text = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in rows[: len(odd)])
    assert got[1].n_turns == len(odd) and got[1].turns_sha256 == hashlib.sha256(text.encode()).hexdigest()
    loss = "".join(t or "" for i, t in enumerate(odd) if i % 3 == 0)
    assert got[1].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and got[1].loss_chars == len(loss)
    assert (got[2].n_turns, got[2].loss_chars, got[None].n_turns, got[3].loss_chars) == (1, 0, 1, 2)
    assert found.where("conv_id = 3").count() == 2
    assert chat.digests(chat.examples(df.limit(0))).count() == 0


NAIVE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def naive_spans(text):
    out = []
    for kind, pattern in NAIVE.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "phone": 9 <= len(d) <= 15, "card": 13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0}
            if ok[kind]:
                out.append((kind, *m.span()))
    return out


@given(st.one_of(st.text("a.@-+ 0129%(é\n", max_size=60), st.lists(st.sampled_from(["4111111111111111", "1.2.3.4", "999.1.1.1", "a@b.c", "@", ".", "+1 (5", "55) 123-4567", " ", "-", "x"]), max_size=9).map("".join)))
@settings(max_examples=400, deadline=None)
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == naive_spans(text)


def test_pii_terms_and_edge_cases(spark):
    rng = random.Random(5)
    texts = [*ODD, "5" * 100_000 + "." * 50_000, "a" * 200_000]
    for _ in range(6):  # in different contexts, beside the same entity; nowhere else
        texts.append(" ".join(words(rng, 30)) + " zorblax boss@corp.example.com " + " ".join(words(rng, 30)))
    texts += [" ".join(words(rng, 30)) + f" common user{i}@x.example.com" for i in range(6)]
    texts += [" ".join(words(rng, 30)) for _ in range(160)]
    texts += ["secret twin twin@x.example.com"] * 9  # one context, however often it is copied
    found = pii.find(docs_of(spark, texts).withColumn("base_sha256", F.lit(0)))
    rows = {r.doc_id: r for r in found.collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        assert [(x.kind, x.start, x.end) for x in rows[i].base] == pii.base_spans(t or "")
        assert {(t or "")[x.start : x.end] for x in rows[i].spans if x.kind == "term"} <= {"zorblax"}
    assert "zorblax" not in rows[len(ODD) + 2].clean and "[TERM] [EMAIL]" in rows[len(ODD) + 2].clean
    assert rows[0].clean == "" and rows[4].clean == "one"
    clean = pii.sanitise(docs_of(spark, texts))
    assert clean.columns == docs_of(spark, []).columns and clean.where("text like '%@%.example.com%'").count() == 0
    assert clean.where("doc_id = 0").first().text is None
    assert pii.digests(pii.find(docs_of(spark, []))).count() == 0
    d = pii.digests(found).where(f"doc_id = {len(ODD) + 2}").first()
    assert d.n_email == 1 and d.spans.startswith("email:") and ",term:" in d.spans


def test_pii_context_has_all_words_of_the_window():
    far, long_ = [f"word{'abcdefghij'[i]}" for i in range(8)], "k" * 5000
    before, after = far[:4] + [long_] + far[4:7], [long_, *far[:7]]
    text = "OUT " + " ".join(before) + " a@b.com " + " ".join(after) + " out"
    a = text.index("a@b.com")
    assert pii.around(text, a, a + 7) == (before, after)
    rng = random.Random(7)
    for _ in range(200):
        text = "".join(rng.choice(["x", "Ab", " ", "\n", "q" * 90]) for _ in range(rng.randint(0, 80)))
        a = rng.randint(0, len(text))
        assert pii.around(text, a, a) == (text[:a].lower().split()[-8:], text[a:].lower().split()[:8])


def test_pii_in_several_passes(spark, monkeypatch):
    rng = random.Random(6)
    texts = [" ".join(words(rng, 30)) + f" {term} {name}@corp.example.com {term}" for term, name in (("zorblax", "boss"), ("quuxly", "deputy")) for _ in range(5)]
    texts += [None, "", "boss@corp.example.com zorblax quuxly", *(" ".join(words(rng, 30)) for _ in range(150))]
    docs = docs_of(spark, texts).withColumn("spans", F.lit(1)).withColumn("c0_", F.lit(2))
    once = pii.digests(pii.find(docs)).toPandas().sort_values("doc_id", ignore_index=True)
    kept = pii.sanitise(docs)
    assert kept.columns == docs.columns and {(r.spans, r.c0_) for r in kept.collect()} == {(1, 2)} and kept.count() == len(texts)
    assert once["spans"][0].count("term:") == 2 and once["spans"][12].count("term:") == 2
    monkeypatch.setattr(pii, "TERMS_PER_PASS", 1)
    monkeypatch.setattr(pii, "PER_SLICE", 3)
    assert pii.digests(pii.find(docs)).toPandas().sort_values("doc_id", ignore_index=True).equals(once)


def test_media_round_trip(spark):
    texts = [*ODD, "abc" * 5000, "abc" * 5000]
    out = media.media_columns(docs_of(spark, texts).withColumn("media", F.lit(1)))
    raw = {r.doc_id: r for r in out.collect()}
    got = {r.doc_id: r for r in media.digests(out).collect()}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        p = b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert got[i].media_sha256 == hashlib.sha256(raw[i].media).hexdigest() and got[i].media_bytes == len(raw[i].media)
        batch = pa.ipc.open_stream(raw[i].tensor).read_all()
        assert batch.schema.field("mel").type.shape == [16, media.MELS] and batch.num_rows >= 1
    assert got[len(texts) - 1].feature == got[len(texts) - 2].feature
    assert media.digests(media.media_columns(docs_of(spark, []))).count() == 0


def test_resampling_and_segments_against_definitions():
    rng = np.random.default_rng(0)
    for up, down in ((1, 2), (2, 3), (3, 2)):
        x, h = rng.standard_normal(200).astype(np.float32), media.lowpass(up, down)
        taps = h.shape[1]
        y = [sum(h[(k * down) % up, j] * (x[i] if 0 <= (i := (k * down) // up + taps - 1 - j - taps // 2) < len(x) else 0) for j in range(taps)) for k in range(len(x) * up // down)]
        assert np.allclose(media.resample(x, up, down), y, atol=1e-4)
    e, on, want = rng.standard_normal(500), False, []
    for v in e:
        on = True if v >= e.mean() + 0.5 * e.std() else False if v < e.mean() - 0.5 * e.std() else on
        want.append(on)
    got = np.zeros(500, bool)
    for a, b in media.segments(e):
        got[a:b] = True
    assert got.tolist() == want and media.segments(np.ones(9)) == []
    t = np.arange(16_000) / 16_000
    y = media.resample(np.sin(2 * np.pi * 500 * t), 1, 2)
    assert abs(np.abs(np.fft.rfft(y)).argmax() * 8000 / len(y) - 500) < 2


def test_language_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    e = language.of_documents(d).withColumn("truth", F.col("declared"))
    hidden = e.withColumn("declared", F.when(F.col("id") % 4 != 0, F.col("declared"))).withColumn("text", F.when(F.col("id") % 40 == 1, "").otherwise(F.col("text")))
    got = language.identify(hidden).toPandas()
    real = got[(got.n_trigrams > 60) & (got.id % 4 == 0)]
    assert (real.lang == real.truth).mean() > 0.98
    assert not got[got.n_trigrams == 0].accepted.any() and got[got.n_trigrams > 60].accepted.mean() > 0.98


def test_language_edge_cases(spark):
    d = docs_of(spark, [*ODD, "the cat sat on the mat and the dog lay there", "12345 !!!"] * 3)
    got = language.identify(language.of_documents(d.withColumn("n", F.lit(1)))).collect()
    assert len(got) == d.count() and {r.lang for r in got} == {"en"}
    assert language.keep_languages(d).columns == d.columns
    assert not {None, "", " "} & {r.text for r in language.keep_languages(d).collect()}
    none = language.identify(language.of_documents(d.withColumn("lang", F.lit(None).cast("string")))).collect()
    assert {(r.lang, r.accepted) for r in none} == {(None, False)}
    assert language.identify(language.of_documents(d.limit(0))).count() == 0


def test_language_uses_declaration_suffix_and_host(spark):
    rows = [(i, t, lang, sfx, host, "s.x") for i, (t, lang, sfx, host) in enumerate([("der und die das nicht", "de", "de", "h1")] * 30 + [("the and of that with", "en", "com", "h2")] * 30 + [("q", None, "de", None), ("q", None, None, "h1"), ("q", None, None, "h2"), ("q", "en", None, None)])]
    got = {r.id: r.lang for r in language.identify(spark.createDataFrame(rows, "id long, text string, declared string, suffix string, host string, site string")).collect()}
    assert [got[i] for i in range(60, 64)] == ["de", "de", "en", "en"]


def test_mixing_hits_targets(spark):
    rng = random.Random(2)
    p = [(rng.randrange(1, 500), [x / 10, 1 - x / 10, 0.0]) for x in (rng.randrange(11) for _ in range(400))]
    df = spark.createDataFrame(p, "n_tokens long, p array<double>")
    total = [sum(n * q[k] for n, q in p) for k in range(3)]
    want = [0.7 * total[0], 0.4 * total[1], 0.0]
    column, reached = mixing.rates(df, want)
    r = [x.r for x in df.select(column.alias("r")).collect()]
    got = [sum(n * q[k] * x for (n, q), x in zip(p, r, strict=True)) for k in range(3)]
    assert np.allclose(got, want, rtol=0.01, atol=1) and np.allclose(got, reached) and min(r) >= 0 and max(r) <= 1


def test_mixing_reaches_targets_of_rare_domains(spark):
    """At production settings: one-hot and soft posteriors, a domain with half a percent of the tokens, and no token at all."""
    rows = [(100, [1.0, 0.0, 0.0])] * 895 + [(100, [0.0, 1.0, 0.0])] * 100 + [(100, [0.0, 0.0, 1.0])] * 5
    df = spark.createDataFrame(rows, "n_tokens long, p array<double>")
    column, got = mixing.rates(df, [89_500.0, 5_000.0, 0.0])
    rate = {tuple(x.p): x.r for x in df.select("p", column.alias("r")).collect()}
    assert np.allclose(got, [89_500, 5_000, 0], rtol=0.01, atol=1) and rate[0.0, 0.0, 1.0] < 0.001 and rate[1.0, 0.0, 0.0] > 0.99
    soft = spark.createDataFrame([(100, [0.97, 0.02, 0.01])] * 895 + [(100, [0.1, 0.88, 0.02])] * 100 + [(100, [0.02, 0.03, 0.95])] * 5, "n_tokens long, p array<double>")
    for weights in ([0.95, 0.039, 0.011], [0.85, 0.135, 0.015], [0.5, 0.49, 0.01]):
        targets = mixing.feasible(soft, weights)
        column, got = mixing.rates(soft, targets)
        assert np.allclose(got, targets, rtol=0.01)
        if weights[0] > 0.6:
            assert np.allclose(targets, np.array(weights) * sum(targets), rtol=0.02)
        r = [x.r for x in soft.select(column.alias("r")).collect()]
        assert min(r) >= 0 and 0.9 < max(r) <= 1  # what there is too little of stays whole
    low = mixing.feasible(soft, [0.995, 0.005, 0.0])  # can't be met, as every document may be a little toxic; the mixture isn't emptied for it
    assert low[0] > 0.9 * 895 * 97 and 0 < low[2] < 0.02 * sum(low) and np.allclose(mixing.rates(soft, low)[1], low, rtol=0.01)
    # out of reach: as near as any rates come, by exhaustive search over rates of the three kinds of documents
    want, p = np.array([2_800.0, 800.0, 400.0]), np.array([[0.97, 0.02, 0.01], [0.1, 0.88, 0.02], [0.02, 0.03, 0.95]])
    mass = p * np.array([[89_500], [10_000], [500]])
    inverse = np.linalg.inv(p.T @ mass)
    miss = lambda got: (np.asarray(got) - want) @ inverse @ (np.asarray(got) - want)
    steps = np.linspace(0, 1, 101)
    best = min(miss(np.array([a, b, c]) @ mass) for a in steps[:12] / 10 for b in steps for c in steps)
    assert miss(mixing.rates(soft, want.tolist())[1]) <= best * 1.02 + 1e-6
    assert mixing.feasible(soft.limit(0), [0.9, 0.1, 0.0]) == mixing.rates(soft.limit(0), [0.0] * 3)[1] == [0, 0, 0]
    docs = docs_of(spark, ["plain words here"] * 20)
    _, model, _ = mixing.mixed(docs.select(F.col("doc_id").alias("key"), "text"), docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert len(model.targets) == len(model.reached) == 3


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_mixing_query_meets_its_targets(spark, sf):
    """The query as registered: each domain within 1 % of its target, by a sum over its own rows."""
    got = op7_mixing(spark, f"/root/testdata/sf{sf}").toPandas()
    tokens = np.array([(got.n_tokens * got[f"p_{d}"] * got.rate).sum() for d in mixing.DOMAINS])
    assert np.allclose(tokens, np.array(mixing.WEIGHTS) * tokens.sum(), rtol=0.01) and got.rate.between(0, 1).all()
    clean = got[got.p_clean > 0.95]
    assert len(clean) > 0.4 * len(got) and clean.rate.mean() > 0.98 and tokens.sum() > 0.7 * got.n_tokens.sum()


def test_mixing_classifier_and_edge_cases(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    fold = labels.where("doc_id % 5 <> 0")
    found, _, _ = mixing.mixed(d.select(F.col("doc_id").alias("key"), "text"), d, fold)
    held = mixing.domain(labels.where("doc_id % 5 = 0")).join(found, F.col("doc_id") == F.col("key")).toPandas()
    assert (held.p.map(np.argmax) == held.k).mean() > 0.9
    clean = held[held.k == 0]
    assert (clean.rate > 0.999).mean() > 0.95 and held[held.k == 2].rate.mean() < 0.4
    tokens = held.n_tokens * held.rate
    assert mixing.WEIGHTS[2] <= 0.04 and tokens[held.k == 2].sum() <= mixing.WEIGHTS[2] * tokens.sum()
    # posteriors mean what they say: expected tokens by domain are those of the labels
    expected, true = (np.stack(held.p) * held.n_tokens.to_numpy()[:, None]).sum(axis=0), [held.n_tokens[held.k == i].sum() for i in range(3)]
    assert np.allclose(expected, true, rtol=0.15)
    odd = docs_of(spark, ODD)
    assert mixing.mix(odd, odd, labels.limit(0)).columns == odd.columns
    assert mixing.mix(odd.limit(0), odd.limit(0), labels).count() == 0


def passages_by_force(texts, least=51):
    """(first words of windows of `least` words by document, those that an earlier document has too)."""
    seen, again = {}, {}
    for i, t in enumerate(texts):
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        keys = [tuple(w[k : k + least]) for k in range(len(w) - least + 1)]
        again[i] = {k for k, key in enumerate(keys) if key in seen}
        seen |= {key: i for key in keys if key not in seen}
    return again


def test_substring_dedup(spark):
    """Passages inside longer lines, over lines, at the ends, in one document; ids near 2^63; rows of one id."""
    rng = random.Random(6)
    passage, other, short = words(rng, 60), words(rng, 51), words(rng, 20)
    long = words(rng, 120)
    near = [*long[:60], "changed", *long[61:]]
    around = lambda p: " ".join([*words(rng, rng.randrange(1, 60)), *p, *words(rng, rng.randrange(1, 60))])
    texts = [*ODD, *[around(p) for p in [passage] * 5 + [other] * 3 + [short] * 3 + [near, long]], " ".join(other) + "\n" + " ".join(other), "\n".join(passage), " ".join(words(rng, 300)), around(passage).upper()]
    big = 2**62
    d = spark.createDataFrame([(big + i, t, 1) for i, t in enumerate(texts)] + [(None, " ".join(passage), 1), (big, "x " + " ".join(other), 1)], "doc_id long, text string, n_chars long")
    got = substring_dedup.repeated(d.withColumn("hi", F.lit(1)).withColumn("at", F.lit(1))).collect()
    o, spans = len(ODD), {}
    by_id = {big + i: t for i, t in enumerate(texts)}
    for r in got:
        t = by_id[r.doc_id] if r.doc_id != big else "x " + " ".join(other)
        spans.setdefault(r.doc_id - big, []).append(t[r.start : r.end].lower().split())
        assert r.n_words == len(spans[r.doc_id - big][-1]) >= 25
    want = {o + k: [passage] for k in range(1, 5)} | {o + 5 + k: [other] for k in range(3)} | {o + 12: [long], o + 13: [other, other], o + 14: [passage], o + 16: [passage]}
    spans[o + 13] = [w[k : k + 51] for w in spans[o + 13] for k in range(0, len(w), 51)]
    assert spans.pop(9) == [['x'] * 39_975]  # all behind the first paragraph
    assert {k: len(v) for k, v in spans.items()} == {k: len(v) for k, v in want.items()}  # no `short`, and id `big` is first with `other`: its second text keeps it
    for k, v in want.items():  # a similar paragraph at an end goes whole, with up to three words that differ
        assert all(" ".join(b) in " ".join(a) and len(a) <= len(b) + 6 for a, b in zip(spans[k], v, strict=True)), k
    left = {r.doc_id - big: r for r in substring_dedup.remove(d.where("doc_id is not null"), spark.createDataFrame(got)).collect() if r.doc_id != big}
    assert left[o].text == texts[o] and left[o + 14].text == "" and left[o + 13].text.strip() == "" and left[o + 13].n_chars == len(left[o + 13].text)
    assert not any(passages_by_force([left[o + k].text for k in range(17)]).values()) and left[1].text == ""
    assert substring_dedup.repeated(docs_of(spark, [])).count() == 0
    assert substring_dedup.repeated(docs_of(spark, texts[: len(ODD)])).count() == 1  # one word 40,000 times


def test_substring_recall_against_brute_force(spark):
    """Whole documents of the given tables, every window of 51 words."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = [r.text for r in d.orderBy("doc_id").collect()]
    ids = [r.doc_id for r in d.select("doc_id").orderBy("doc_id").collect()]
    got = {}
    for r in substring_dedup.repeated(d).collect():
        got.setdefault(r.doc_id, []).append((r.first_word, r.first_word + r.n_words))
    want = passages_by_force(texts)
    lost = [(ids[i], k) for i, again in want.items() for k in again if not any(a <= k and k + 51 <= b for a, b in got.get(ids[i], ()))]
    assert sum(map(len, want.values())) > 1000 and len(lost) <= 0.01 * sum(map(len, want.values()))  # the copy that stays may be a shorter one
    assert [x for x in lost if not any(a <= x[1] + 26 and x[1] + 25 <= b for a, b in got.get(x[0], ()))] == []
    # what is removed stands elsewhere, but for edits
    lists = {i: shingle_list(t.encode()).tolist() for i, t in zip(ids, texts, strict=True)}
    n = Counter(x for s in lists.values() for x in s)
    for doc_id, spans in got.items():
        for a, b in spans:
            inside = lists[doc_id][a : b - 4]
            assert sum(n[x] > 1 for x in inside) >= 0.75 * len(inside), (doc_id, a, b)


def test_similar_paragraphs_are_joined_exactly(spark):
    rng = random.Random(8)
    sets = []
    for _ in range(12):
        base = rng.sample(range(1000), 21)
        sets += [sorted({*rng.sample(base, 21 - k), *[2000 + rng.randrange(40) for _ in range(k)]}) for k in (0, 0, 1, 2, 2, 3, 4, 5, 6)]
    items = spark.createDataFrame([(i, i if i % 3 else 0, s, i // 2 if i % 5 else None) for i, s in enumerate(sets)], "item long, root long, s array<long>, doc long")
    got = {tuple(sorted((r.a, r.b))) for r in substring_dedup.joined(items, 75).collect()}
    root = [i if i % 3 else 0 for i in range(len(sets))]
    like = lambda x, y: 100 * len(x & y) >= 75 * len(x | y)
    want = {(i, j) for j in range(len(sets)) for i in range(j) if root[i] != root[j] and not (i % 5 and j % 5 and i // 2 == j // 2) and like({*sets[i]}, {*sets[j]})}
    assert got == want and len(want) > 20


@pytest.mark.parametrize("similarity", [0.6, 0.75, 0.9])
def test_bands_are_tuned(similarity):
    r, b = substring_dedup.tuned(similarity)
    assert 1 - (1 - similarity**r) ** b >= 0.995


def test_regions_compare_items_where_they_lie(spark):
    """Candidates of a region with many items are those that brute force finds, and no join makes a row for each pair that isn't one."""
    import random

    from cairnlake.llm import regions
    from cairnlake.llm.shingles import bitmap

    r = random.Random(5)
    sets = {i: np.array(sorted({k for k in range(60) if r.random() < 0.9} | {1000 * i + k for k in range(r.randrange(12))}), np.uint64) * np.uint64(0x9E3779B97F4A7C15) for i in range(1500)}
    before = {i: None if i % 3 == 0 else 2**62 + i % 2 for i in sets}
    live = spark.createDataFrame([(7, i, len(s), i % 4, before[i], i % 40) for i, s in sets.items()], "region long, item long, n long, pos int, prev long, root long")
    items = spark.createDataFrame([(i, len(s), bitmap(s)) for i, s in sets.items()], "item long, n long, bits binary")
    found = regions.met(live, 12, items, 75)
    bits = {i: int.from_bytes(bitmap(s), "little") for i, s in sets.items()}
    wanted = set()
    for p in sorted(sets, key=lambda i: (len(sets[i]), i))[:12]:
        for i in sets:
            n, m = len(sets[i]), len(sets[p])
            if i % 40 != p % 40 and (m, p) < (n, i) and min(n - i % 4, m - p % 4) * 175 >= 75 * (n + m) and (before[i] is None or before[i] != before[p]) and regions.may_link(n, bits[i], 8 * len(bitmap(sets[i])), m, bits[p], 8 * len(bitmap(sets[p])), 75):
                wanted.add((i, p))
    assert wanted and {tuple(x) for x in found.collect()} == wanted
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and not any("(a#" in x or "(b#" in x for x in plan.splitlines() if "Join" in x)
