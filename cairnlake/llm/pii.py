"""Personal data: fixed patterns, and terms that give away whom they stand beside."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import few_at_a_time, materialise

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W\d_]{3,}")
#: Words on either side of an entity that count as its context.
WINDOW = 8
#: A term discloses an entity if it stands beside it in so many different contexts, if so large a
#: share of its documents hold the entity, and if it tells so many bits about it.
MIN_CONTEXTS, MIN_SHARE, MIN_BITS = 3, 0.5, 4.0
#: Candidate terms looked up in one pass over the texts; more take more passes.
TERMS_PER_PASS = 200_000
#: Texts held as Python strings at a time.
PER_SLICE = 256


def emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern `[local]+@domain` finds them from the left, in linear time: a match begins
    where the run of local characters before an @ does, or where the last match ended."""
    free, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            yield begin, m.end()
        free = m.end() if m else at + 1
        at = text.find("@", free)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start; code points."""
    out = [("email", *x) for x in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, few at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, PER_SLICE):
            yield batch.slice(at, PER_SLICE)


def around(text: str, a: int, b: int) -> tuple[list[str], list[str]]:
    """The WINDOW words before a and after b, lower-cased, however long they are."""
    size, before, after = 24 * WINDOW, None, None
    while before is None or after is None:
        # of more words than the window's, the outermost one may be cut and isn't used
        words = text[max(0, a - size) : a].split() if before is None else []
        if before is None and (len(words) > WINDOW or a <= size):
            before = [x.lower() for x in words[-WINDOW:]]
        words = text[b : b + size].split() if after is None else []
        if after is None and (len(words) > WINDOW or b + size >= len(text)):
            after = [x.lower() for x in words[:WINDOW]]
        size *= 4
    return before, after


def contexts(docs: DataFrame) -> DataFrame:
    """doc_id, entity, context (hashes), term: a row for each word in the window of each entity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            out = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if not text or not (spans := base_spans(text)):
                    continue
                for kind, a, b in spans:
                    near = around(text, a, b)
                    terms = {x for side in near for word in side for x in _WORD.findall(word)}
                    entity = f"{kind}:{text[a:b].lower()}"
                    context = hashlib.blake2b(repr(near).encode(), digest_size=8).hexdigest()
                    out += [(doc_id, entity, context, x) for x in terms]
            if out:
                ids, *texts = zip(*out, strict=True)
                yield pa.record_batch([pa.array(ids, pa.int64()), *(pa.array(x, pa.string()) for x in texts)], names=["doc_id", "entity", "context", "term"])

    return docs.mapInArrow(run, "doc_id long, entity string, context string, term string")


def disclosing(docs: DataFrame, min_contexts: int = MIN_CONTEXTS, min_share: float = MIN_SHARE, min_bits: float = MIN_BITS) -> DataFrame:
    """term, bits of the terms that disclose an entity: p(entity | term) is the share of the term's
    documents in which it stands beside the entity, bits = log2(p(entity | term) / p(entity)), over
    all documents. Copies of a context count once towards min_contexts."""
    found = materialise(contexts(docs), "contexts")
    pairs = found.groupBy("term", "entity").agg(F.countDistinct("context").alias("contexts"), F.countDistinct("doc_id").alias("both")).where(F.col("contexts") >= min_contexts)
    pairs = materialise(pairs, "pairs")
    terms = materialise(pairs.select("term").distinct(), "terms")
    entities = found.join(pairs.select("entity").distinct(), "entity", "left_semi").groupBy("entity").agg(F.countDistinct("doc_id").alias("of_entity"))
    n, total = terms.count(), docs.count()
    spark, counted = docs.sparkSession, []
    passes = -(-n // TERMS_PER_PASS)
    for k in range(passes):
        some = terms.where(F.pmod(F.xxhash64("term"), F.lit(passes)) == k)
        held = spark.sparkContext.broadcast(frozenset(r.term for r in some.collect()))  # about TERMS_PER_PASS words

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            c: Counter[str] = Counter()  # of held terms only
            for batch in _slices(batches):
                for text in batch["text"].to_pylist():
                    c.update(held.value.intersection(_WORD.findall(text.lower())) if text else ())
            yield pa.record_batch([pa.array(c.keys(), pa.string()), pa.array(c.values(), pa.int64())], names=["term", "n"])

        counted.append(docs.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("of_term")))
    if not counted:
        return pairs.select("term", F.lit(0.0).alias("bits")).limit(0)
    of_terms = counted[0]
    for x in counted[1:]:
        of_terms = of_terms.unionByName(x)
    p = F.least(F.lit(1.0), F.col("both") / F.col("of_term"))
    scored = pairs.join(of_terms, "term").join(entities, "entity").select("term", p.alias("share"), F.log2(p * total / F.col("of_entity")).alias("bits"))
    return scored.where((F.col("share") >= min_share) & (F.col("bits") >= min_bits)).groupBy("term").agg(F.max("bits").alias("bits"))


def _cover(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each span becomes its kind in brackets; of overlapping ones the first, to the end of all."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


#: Spans as a column.
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _spans(spans: list[list[tuple[str, int, int]]]) -> pa.Array:
    """As SPANS."""
    flat = [x for row in spans for x in row]
    cells = [pa.array([x[i] for x in flat], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))]
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, spans)]), pa.int32()), pa.StructArray.from_arrays(cells, ["kind", "start", "end"]))


def _terms(text: str, known: frozenset[str]) -> list[tuple[str, int, int]]:
    return [("term", *m.span()) for m in _WORD.finditer(text) if m[0].lower() in known] if known else []


def find(docs: DataFrame, **limits: float) -> DataFrame:
    """docs with base and spans (arrays of kind, start, end) and clean added: the text with base
    matches generalised to their kind and disclosing terms to [TERM].

    docs(text, ...) need a doc_id for the counts; null and empty texts have no span and become
    empty; repeated rows get a row each. Columns named base, spans or clean give way. Texts never
    cross a shuffle. One pass over the texts, by one worker a task; up to about TERMS_PER_PASS disclosing
    terms are held, more take more passes with a table of what was found between them."""
    d = few_at_a_time(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    terms = materialise(disclosing(d, **limits), "disclosing")
    passes = max(1, -(-terms.count() // TERMS_PER_PASS))
    rows = docs.drop("base", "spans", "clean").withColumn("text", F.col("text").cast("string"))
    for k in range(passes):
        some = terms.where(F.pmod(F.xxhash64("term"), F.lit(passes)) == k)
        held = docs.sparkSession.sparkContext.broadcast(frozenset(r.term for r in some.collect()))  # about TERMS_PER_PASS words
        last = k == passes - 1
        kept = [c for c in rows.columns if c != "spans"]

        def run(batches: Iterator[pa.RecordBatch], held=held, last=last, kept=kept) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            known = held.value
            for batch in _slices(batches):
                texts = [x or "" for x in batch["text"].to_pylist()]
                found = [_terms(x, known) for x in texts]
                if "spans" in batch.schema.names:
                    found = [sorted([(x["kind"], x["start"], x["end"]) for x in old] + new, key=lambda x: x[1]) for old, new in zip(batch["spans"].to_pylist(), found, strict=True)]
                more = {"spans": _spans(found)}
                if last:
                    base = [base_spans(x) for x in texts]
                    free = [[x for x in new if not any(a <= x[1] and x[2] <= b for _, a, b in old)] for new, old in zip(found, base, strict=True)]
                    spans = [x + y for x, y in zip(base, free, strict=True)]
                    more = {"base": _spans(base), "spans": _spans(spans), "clean": pa.array([_cover(x, y) for x, y in zip(texts, spans, strict=True)], pa.string())}
                yield pa.record_batch([*(batch[c] for c in kept), *more.values()], names=[*kept, *more])

        fields = [*rows.select(*[F.col(f"`{c}`") for c in kept]).schema.fields, *(T.StructField(c, T.StringType() if c == "clean" else SPANS) for c in (("base", "spans", "clean") if last else ("spans",)))]
        rows = rows.mapInArrow(run, T.StructType(fields))
        if not last:
            rows = materialise(rows, "marked")
    return rows


def digests(found: DataFrame) -> DataFrame:
    """The counts and spans of find(), a row per row."""
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    counts = [(F.size("base.kind") - F.size(F.array_remove("base.kind", k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """documents with clean texts and n_chars of those; null texts, every row and column stay."""
    names = [c if c in ("doc_id", "text") else f"c{i}_" for i, c in enumerate(docs.columns)]
    out = find(docs.toDF(*names)).withColumn("clean", F.when(F.col("text").isNotNull(), F.col("clean")))
    cells = {"text": F.col("clean"), "n_chars": F.length("clean").cast("long")}
    return out.select(*[cells.get(c, F.col(n)).alias(c) for c, n in zip(docs.columns, names, strict=True)])
