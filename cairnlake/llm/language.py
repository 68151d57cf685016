"""Language identification by fusing what the text, the markup, the address and the host say."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, maybe_broadcast

#: Buckets of byte trigrams.
BUCKETS = 4096
#: Trigrams of a text that count as independent: more only sharpen what they already say.
EFFECTIVE = 100
#: A language is known if so many rows declare it.
MIN_ROWS = 5
#: Strength of the level above in a host's prior, in rows.
KAPPA = 20.0


def trigrams(text: bytes | None) -> np.ndarray:
    """Counts by bucket of the letters' byte trigrams, A-Z lower-cased, other ASCII as one space."""
    b = np.frombuffer((text or b"").translate(_FOLD), np.uint8)
    if len(b) < 3:
        return np.zeros(BUCKETS, np.int64)
    b = b.astype(np.uint32)
    h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
    h = h[(b[:-2] > 32) | (b[1:-1] > 32)]  # not those within white space
    return np.bincount((h ^ (h >> np.uint32(15))) % np.uint32(BUCKETS), minlength=BUCKETS)


_FOLD = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def declared_language(x: Column) -> Column:
    """The primary subtag in lower case, null if it isn't two or three letters."""
    tag = F.regexp_extract(F.lower(F.trim(x)), "^([a-z]{2,3})(?:[-_].*)?$", 1)
    return F.when(tag != "", tag)


def markup_language(html: Column) -> Column:
    """What <html lang=...> declares."""
    return declared_language(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z_-]+)", 1))


def train(rows: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log p(bucket | language), log prior) from all rows(text, declared) that declare a
    language: counts are summed in each task, then by a grouped aggregation. The model's size is
    bounded by the known language codes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, tag in zip(batch.text, batch.declared, strict=True):
                at = held.setdefault(tag, np.zeros(BUCKETS + 1, np.int64))
                at[:BUCKETS] += trigrams(text)
                at[BUCKETS] += 1
        for tag, c in held.items():
            at = np.flatnonzero(c)
            yield pd.DataFrame({"declared": tag, "bucket": at.astype(np.int32), "n": c[at]})

    summed = rows.where("declared is not null").select("text", "declared").mapInPandas(run, "declared string, bucket int, n long").groupBy("declared", "bucket").agg(F.sum("n").alias("n"))
    known = summed.where(f"bucket = {BUCKETS} and n >= {MIN_ROWS}").select("declared", F.col("n").alias("rows"))
    got = summed.join(F.broadcast(known), "declared").toPandas()  # languages x (BUCKETS + 1) numbers
    langs = sorted(set(got["declared"]))
    counts = np.zeros((len(langs), BUCKETS + 1))
    counts[[langs.index(x) for x in got["declared"]], got["bucket"]] = got["n"]
    p = counts[:, :BUCKETS] + 0.5
    n = counts[:, BUCKETS] + 1.0
    return langs, np.log(p / p.sum(axis=1, keepdims=True)), np.log(n / n.sum()) if langs else n


def identify(rows: DataFrame, allowed: list[str] | None = None, least: float = 0.5) -> DataFrame:
    """rows(text, declared, suffix, host, site, ...), of which all may be null, with lang, posterior,
    n_trigrams and accepted added (in place of columns of such names) and the evidence beside the text dropped.

    log posterior = text likelihood (byte trigrams) + log p(declared | lang) + log p(suffix | lang)
    + log prior(host). The reliability of declarations and suffixes, and the priors, come from
    grouped counts of what the texts alone say, over all rows; a host's prior is smoothed by its
    site's, that by the corpus's. What is null adds nothing. Accepted: the text holds letters, the
    posterior is at least `least`, and the language is one of `allowed` (null: any known one).
    Empty or letterless texts get what the other evidence says and aren't accepted; without any
    known language lang is null and nothing is accepted. Repeated rows get a row each.

    Texts never cross a shuffle: they are read once to train, once for the grouped counts and once
    to decide, beside tables of evidence that are broadcast if they are counted to be small."""
    # columns that only pass through are held as one, so that no name of theirs meets one of these
    given = [c for c in rows.columns if c not in (*EVIDENCE, *FOUND)]
    rows = rows.select(*EVIDENCE, F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary")).alias("text_"), F.struct(*[F.col(f"`{c}`") for c in given]).alias("row_"))
    langs, logp, prior = train(rows.select(F.col("text_").alias("text"), "declared"))
    if not langs:
        return rows.select("row_.*", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("posterior"), F.lit(0).cast("long").alias("n_trigrams"), F.lit(False).alias("accepted"))
    k = len(langs)
    held = rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(logp.T))

    @F.pandas_udf("n long, ll array<double>")
    def likelihoods(texts: pd.Series) -> pd.DataFrame:
        model, n, ll = held.value, np.zeros(len(texts), np.int64), np.zeros((len(texts), k))
        for i, text in enumerate(texts):
            c = trigrams(text)
            at = np.flatnonzero(c)
            if len(at):
                n[i] = c.sum()
                ll[i] = (c[at] @ model[at]) * (min(EFFECTIVE, int(n[i])) / n[i])
        return pd.DataFrame({"n": n, "ll": list(ll - ll.max(axis=1, keepdims=True))})

    likelihoods = likelihoods.asNondeterministic()  # so that no plan evaluates it twice
    best = (F.array_position("s.ll", F.array_max("s.ll")) - 1).cast("int")
    told = rows.select(*EVIDENCE, likelihoods("text_").alias("s")).where("s.n >= 10").groupBy(*EVIDENCE, best.alias("best")).agg(F.count("*").alias("n"))
    told = materialise(told, "told")
    each = lambda f: F.array(*[f(i) for i in range(k)])
    hit = lambda i: F.sum(F.when(F.col("best") == i, F.col("n")).otherwise(0).cast("double"))
    base = told.agg(each(hit).alias("c")).first()["c"]
    total = np.array([x or 0.0 for x in base]) + 1.0
    top = (total / total.sum()).tolist()
    corpus, zero = F.array(*map(F.lit, top)), F.array(*[F.lit(0.0)] * k)

    def likelihood(name: str) -> DataFrame:
        c = told.where(F.col(name).isNotNull()).groupBy(name).agg(each(hit).alias("c"))
        return c.select(name, F.array(*[F.log((F.col("c")[i] + 0.05) / float(total[i] + 1)) for i in range(k)]).alias(f"{name}_ll"))

    smooth = lambda c, up: F.zip_with(c, up, lambda x, u: x + KAPPA * u)
    norm = lambda x: F.transform(x, lambda v: v / F.aggregate(x, F.lit(0.0), lambda a, b: a + b))
    sites = told.where("site is not null").groupBy("site").agg(each(hit).alias("c"))
    sites = sites.select("site", norm(smooth(F.col("c"), corpus)).alias("site_p"))
    hosts = told.where("host is not null").groupBy("host").agg(F.min("site").alias("site"), each(hit).alias("c")).join(sites, "site", "left")
    hosts = hosts.select("host", norm(smooth(F.col("c"), F.coalesce("site_p", corpus))).alias("host_p"))
    out = rows
    for name, x in (("declared", likelihood("declared")), ("suffix", likelihood("suffix")), ("host", hosts)):
        out = out.join(maybe_broadcast(materialise(x, name)), name, "left")
    out = out.withColumn("s", likelihoods("text_"))
    lp = F.array(*[F.col("s.ll")[i] + F.coalesce("declared_ll", zero)[i] + F.coalesce("suffix_ll", zero)[i] + F.log(F.coalesce("host_p", corpus)[i]) for i in range(k)])
    out = out.withColumn("lp", lp).withColumn("most", F.array_max("lp"))
    out = out.withColumn("posterior", 1.0 / F.aggregate("lp", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("most"))))
    out = out.withColumn("lang_", F.element_at(F.array(*map(F.lit, langs)), F.array_position("lp", F.col("most")).cast("int"))).withColumn("n_trigrams", F.col("s.n"))
    accepted = (F.col("n_trigrams") > 0) & (F.col("posterior") >= least)
    if allowed is not None:
        accepted &= F.col("lang_").isin(allowed)
    out = out.withColumn("accepted", accepted)
    return out.select("row_.*", F.col("lang_").alias("lang"), "posterior", "n_trigrams", "accepted")


#: Columns of evidence beside the text, and those that identify() adds.
EVIDENCE, FOUND = ("declared", "suffix", "host", "site"), ("lang", "posterior", "n_trigrams", "accepted")


def of_documents(docs: DataFrame, *more: Column) -> DataFrame:
    """Evidence of documents(doc_id, text, lang, source): the declaration is lang, the host source. more: columns to add."""
    null = F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("id"), "text", declared_language(F.col("lang")).alias("declared"), null.alias("suffix"), F.col("source").alias("host"), null.alias("site"), *more)


def of_pages(pages: DataFrame) -> DataFrame:
    """Evidence of pages(page_id, url, html); the text is the markup without tags, scripts, styles."""
    host = F.regexp_extract(F.lower("url"), r"^[^/?#]*?://([^/?#:]+)", 1)
    host = F.when(host != "", host)
    text = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), "<[^>]*>", " ")
    site, suffix = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.regexp_extract(host, r"\.([a-z]{2,})$", 1)
    return pages.select(F.col("page_id").cast("long").alias("id"), text.alias("text"), markup_language(F.col("html")).alias("declared"), F.when(suffix != "", suffix).alias("suffix"), host.alias("host"), F.when(site != "", site).alias("site"))


def keep_languages(docs: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """documents without those that are rejected; rows and columns stay as they are."""
    rows = of_documents(docs, F.struct(*[docs[c] for c in docs.columns]).alias("row_"))
    return identify(rows.drop("id"), allowed).where("accepted").select("row_.*")
