"""The operators as queries, with production parameters on whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, embedding_dedup, filter_audit, jaccard_join, language, media, mixing, packing, pii, resharding, substring_dedup, url_filter, vector_codes
from .common import materialise, table


def tokenizer_path() -> str:
    """The vocabulary file; CAIRNLAKE_TOKENIZER names another."""
    import public_tokenizers

    return os.environ.get("CAIRNLAKE_TOKENIZER") or public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = r"\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.digests(chat.examples(rows))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify(language.of_documents(table(spark, sf_dir, "documents")))
    return found.select(F.col("id").alias("doc_id"), "lang", "posterior", "n_trigrams", "accepted")


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify(language.of_pages(table(spark, sf_dir, "pages")))
    return found.select(F.col("id").alias("page_id"), "lang", "posterior", "n_trigrams", "accepted")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found, _, _ = mixing.mixed(docs.select(F.col("doc_id").alias("key"), "text"), docs, table(spark, sf_dir, "labels"))
    return found.select(F.col("key").alias("doc_id"), "n_tokens", *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(mixing.DOMAINS)], "rate")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find(table(spark, sf_dir, "documents")))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.media_columns(table(spark, sf_dir, "documents")))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated(table(spark, sf_dir, "documents"))


#: Shards before and after op11, bytes of a row besides its text.
OLD_SHARDS, SHARDS, ROW_BYTES = 16, 24, 8


def op11_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From 16 shards in which equal texts stand together to 24 of equal bytes. Texts are read once and don't move: sizes and hashes do."""
    text = F.coalesce("text", F.lit(""))
    d = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("hash"))
    old = F.pmod(F.xxhash64("hash", F.lit("old")), F.lit(OLD_SHARDS))
    out = resharding.reshard(materialise(d, "sizes"), old, F.col("size"), F.col("hash"), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings")).drop("label")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_packing, op2_embedding_dedup, op3_url_filter, op4_chat, op5_jaccard_join, op6_language_id, op7_mixing, op8_pii, op9_media, op10_substring_dedup, op11_resharding, op12_vector_codes, op13_filter_audit, language_of_pages)
    return {f.__name__: f for f in own}


#: Chat digests: escapes cost one character per backslash, and shorten ### by one and </turn> by five.
CHAT_SQL = r"""
with rows_ as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
long_ as (
    select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i, count(*) over (partition by conv_id) as n,
        4 + length(replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\t'), ':', '\c')) + 2
        + length(replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t')) + 8 as chars
    from rows_),
sums as (select *, sum(chars) over (partition by conv_id order by i rows unbounded preceding) as upto from long_)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
    cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
    sha256(coalesce(string_agg(text, '' order by i) filter (role = 'assistant'), '')) as loss_sha256,
    cast(sum(case when role = 'assistant' or i = n then upto else 0 end) as bigint) as formatted_chars
from sums group by conv_id
"""


#: Words once a document, failures as bits, then every order of the letters.
AUDIT_SQL = r"""
with d as (
    select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, min(doc_id) over (partition by coalesce(text, '')) as first_id from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words from d),
f as (
    select doc_id, part, case when len(words) < 100 then 1 else 0 end + case when 100 * len(list_distinct(words)) < 80 * len(words) then 2 else 0 end
        + case when 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) then 4 else 0 end
        + case when regexp_matches(text, '[#$%&*|]') then 8 else 0 end + case when doc_id > first_id then 16 else 0 end as mask
    from w),
known as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
n as (
    select part, mask, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic
    from f left join known on f.doc_id = known.doc_id group by part, mask),
letter as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) t(l, bit)),
orders as (
    select a.l || b.l || c.l || d.l || e.l as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
    from letter a, letter b, letter c, letter d, letter e where a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps as (select filter_order, cast(step as integer) as step, cast(coalesce(list_sum(bits[1:step - 1]), 0) as integer) as before, bits[step] as own from orders, range(1, 6) r(step)),
s as (
    select part, filter_order, step, own, sum(case when mask & (before | own) = 0 then n else 0 end) as kept,
        sum(case when mask & own > 0 and mask & before = 0 then n else 0 end) as removed, sum(case when mask & own > 0 and mask & before > 0 then n else 0 end) as redundant,
        sum(case when mask = own then n else 0 end) as unique_fails, sum(case when mask & own > 0 and mask & before = 0 then good else 0 end) as good_lost,
        sum(case when mask & own > 0 and mask & before = 0 then toxic else 0 end) as toxic_lost
    from n, steps group by part, filter_order, step, own)
select part, filter_order, step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
    cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, own) as bigint) as shapley from s
"""


def codes_sql(parts: int = vector_codes.PARTS, entries: int = vector_codes.ENTRIES, rounds: int = vector_codes.ROUNDS) -> str:
    """Vectors as integers by part, then a table of entries (c) and one of assignments (a) for each round."""
    with_ = f"""with v as (
    select vec_id, label, list_transform(embedding, lambda x: cast(floor({vector_codes.SCALE} * cast(x as double)) as bigint)) as x from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts_ as materialized (select vec_id, p, x[p * len(x) // {parts} + 1:(p + 1) * len(x) // {parts}] as x from v, range({parts}) r(p)),
firsts as (select vec_id, row_number() over (order by vec_id) - 1 as e from v order by vec_id limit {entries}),
c0 as materialized (select p, e, x from parts_ join firsts using (vec_id))"""
    assign = """,
a{k} as materialized (select vec_id, p, arg_min(e, d * 100 + e) as e, min(d) as d from (
    select vec_id, p, e, list_sum(list_transform(list_zip(parts_.x, c{k}.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d from parts_ join c{k} using (p)) group by vec_id, p)"""
    replace = """,
m{k} as (select p, e, list(x order by i) as x from (
    select p, e, i, cast(floor(sum(y) / count(*)) as bigint) as x from (select p, e, unnest(x) as y, generate_subscripts(x, 1) as i from a{k} join parts_ using (vec_id, p)) group by p, e, i) group by p, e),
c{next} as materialized (select c{k}.p, c{k}.e, coalesce(m{k}.x, c{k}.x) as x from c{k} left join m{k} using (p, e))"""
    for k in range(rounds):
        with_ += assign.format(k=k) + replace.format(k=k, next=k + 1)
    return with_ + assign.format(k=rounds) + f""",
books as (select sha256(string_agg(array_to_string(x, ','), ',' order by p, e)) as codebooks_sha256 from c{rounds}),
coded as (select vec_id, string_agg(printf('%02x', e), '' order by p) as code, cast(sum(d) as bigint) as error from a{rounds} group by vec_id)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from coded join v using (vec_id), books"""


def oracle_sql() -> dict[str, str]:
    return {"op4_chat": CHAT_SQL, "op12_vector_codes": codes_sql(), "op13_filter_audit": AUDIT_SQL}
