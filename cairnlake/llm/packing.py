"""Best-fit packing by sums of squares: token pieces into as few fixed-size sequences as it can."""

from __future__ import annotations

import bisect
import math
import os
import re
import string
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few_at_a_time, materialise

#: Tokens of a sequence.
CAPACITY = 2048
#: Pieces packed together by one task.
PER_SHARD = 65_536
END = b"\0\0\0\0"
_CONTROL = re.compile(r"<\|(?:startoftext|endoftext)\|>")


#: Signs that close a word; an apostrophe may begin a pre-token with letters.
SIGNS = "".join(x for x in string.punctuation if x != "'")
#: Words of a line that goes to the tokenizer, and texts and characters of a slice.
LINE, TEXTS, CHARACTERS = 50, 1000, 4_000_000


def slices(texts: list[str]) -> Iterator[list[str]]:
    """Texts in order, up to TEXTS at a time and, but for a longer one alone, CHARACTERS."""
    some, size = [], 0
    for text in texts:
        if some and (len(some) == TEXTS or size + len(text) > CHARACTERS):
            yield some
            some, size = [], 0
        some.append(text)
        size += len(text)
    if some:
        yield some


def _slow(text: str) -> bool:
    """Whether text holds separators at which only Python splits, or a control string."""
    return "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text or ("<|" in text and bool(_CONTROL.search(text)))


class WordTokenizer:
    """ids of a tokenizer that lower-cases and whose pre-tokens are runs of letters, or of signs, that
    never span white space: Arrow splits texts and numbers a slice's words, each word is encoded once and kept,
    and words that differ by case or closing signs share their letters' ids. Texts where that could differ go
    to the tokenizer whole."""

    def __init__(self, path: str, most: int = 2_000_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.whole = not self._fits()
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)  # by id: whether it ends a pre-token
        self.ends[[i for word, i in self.tokenizer.get_vocab().items() if suffix and word.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        """Word k's ids are flat[begin[k]:begin[k + 1]]; kept has each word's k. Word 0 is the empty one."""
        self.kept: dict[str, int] = {"": 0}
        self.flat, self.begin, self.words, self.used = np.zeros(1 << 16, "<u4"), np.zeros(1 << 12, np.int64), 1, 0

    def _fits(self) -> bool:
        """Whether the vocabulary treats words as encode() does; else every text goes to the tokenizer whole."""
        tests = ["Hello, World. It's we'll NA\u00cfVE co-op 42nd  a\tb\nc", "...!? x,y;z: \u00c9t\u00e9s (done)", "snake_case don't 3.14 a+b", f"end.*** Done!! \u00dcber&&& x{SIGNS}"]
        alone = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        parts = lambda w: (w.rstrip(SIGNS), w[len(w.rstrip(SIGNS)) :])
        return all(alone(t) == [i for w in t.split() for i in alone(w)] and alone(t) == alone(t.lower()) and all(alone(stem) + alone(sign) == alone(stem + sign) for stem, sign in map(parts, t.split()) if stem.isalpha()) for t in tests)

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, one after another; number of ids of each)."""
        found = [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), "<u4", int(sizes.sum())), sizes

    def _runs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As _plain, of words that are one pre-token each: many go to the tokenizer as a line, in which the
        ids that end a pre-token tell words apart."""
        ids, _ = self._plain([" ".join(words[at : at + LINE]) for at in range(0, len(words), LINE)])
        upto = np.flatnonzero(self.ends[ids]) + 1
        if len(upto) != len(words) or (len(ids) and upto[-1] != len(ids)):  # a vocabulary without such ids
            return self._plain(words)
        return ids, np.diff(upto, prepend=0)

    def _keep(self, words: Iterable[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, m = self.words + len(sizes), self.used + len(ids)
        if m > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(2 * m - self.used, "<u4")])
        if n >= len(self.begin):
            self.begin = np.concatenate([self.begin[: self.words + 1], np.zeros(2 * n - self.words, np.int64)])
        self.flat[self.used : m] = ids
        self.begin[self.words + 1 : n + 1] = self.used + np.cumsum(sizes)
        self.kept.update(zip(words, range(self.words, n), strict=True))
        self.words, self.used = n, m

    def _ids(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of kept words, one after another; where each word's begin, and their end)."""
        first = self.begin[at]
        upto = np.concatenate([[0], np.cumsum(self.begin[at + 1] - first)])
        return self.flat[np.repeat(first - upto[:-1], np.diff(upto)) + np.arange(upto[-1])], upto

    def _learn(self, new: list[str]) -> None:
        derived, runs, plain = [], {}, []
        for word in new:
            stem = word.rstrip(SIGNS)
            low = stem.lower()
            if stem.isalpha() and (stem.isascii() or (max(stem) < "\u0250" and len(low) == len(stem))):
                sign = word[len(stem) :]
                runs[low] = runs[sign] = None
                if sign or low != word:
                    derived.append((word, low, sign))
            elif not stem:
                runs[word] = None
            else:
                plain.append(word)
        for words, encode in (([x for x in runs if x not in self.kept], self._runs), (plain, self._plain)):
            for at in range(0, len(words), 20_000):
                part = words[at : at + 20_000]
                self._keep(part, *encode(part))
        derived = [x for x in derived if x[0] not in self.kept]
        ids, upto = self._ids(np.fromiter((self.kept[x] for _, low, sign in derived for x in (low, sign)), np.int64, 2 * len(derived)))
        self._keep([word for word, _, _ in derived], ids, np.diff(upto[::2]))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        for some in slices(texts):
            if len(self.kept) > self.most:
                self._forget()
            whole = [self.whole or _slow(x) for x in some]
            split = pc.utf8_split_whitespace(pa.array(["" if own else x for x, own in zip(some, whole, strict=True)], pa.large_string()))
            coded = split.flatten().dictionary_encode()
            words = coded.dictionary.to_numpy(zero_copy_only=False)
            at = np.fromiter(map(self.kept.get, words, repeat(-1)), np.int64, len(words))
            new = words[at < 0].tolist()
            self._learn(new)
            at[at < 0] = np.fromiter(map(self.kept.__getitem__, new), np.int64, len(new))
            ids, upto = self._ids(at[coded.indices.to_numpy()])
            ends = upto[split.offsets.to_numpy()].tolist()
            for text, own, begin, end in zip(some, whole, ends, ends[1:], strict=False):
                yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes() if own else ids[begin:end].tobytes()


@lru_cache
def _tokenizer(path: str) -> WordTokenizer:
    """One for each worker process: a task's function finds it by this module, so it's kept between tasks."""
    return WordTokenizer(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for each piece of each document: its ids, then id 0,
    cut into pieces of capacity tokens, the last one shorter. Null text: empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, ids in zip(batch.doc_id, _tokenizer(tokenizer).encode([x or "" for x in batch.text]), strict=True):
                ids += END
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = few_at_a_time(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, in this order. Each goes where the sum over gaps of the square
    of the number of open bins with that gap becomes smallest; ties to the smallest gap."""
    count = np.zeros(capacity + 1, np.int64)  # by gap; full bins don't count
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset, used = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, size in enumerate(lengths.tolist()):
        change = 1 - count[size:capacity]  # halved, of a bin with gap size, size + 1, ...
        change[1:] += count[1 : capacity - size]
        gap = -1
        if len(change):
            score = 2 * change
            score[0] -= 1  # a bin that becomes full leaves the sum
            score[count[size:capacity] == 0] = np.iinfo(np.int64).max
            at = int(score.argmin())
            fresh = 2 * int(count[capacity - size]) + 1 if size < capacity else 0
            if score[at] <= fresh:
                gap = size + at
        if gap < 0:
            gap, found, used = capacity, used, used + 1
        else:
            found = bins[gap].pop()
            count[gap] -= 1
        where[i], offset[i] = found, capacity - gap
        if gap > size:
            bins[gap - size].append(found)
            count[gap - size] += 1
    return where, offset


def repacked(lengths: np.ndarray, where: np.ndarray, offset: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) with fewer bins, where there is a way: what the least filled ones hold is placed anew, longest
    first, where it fits best. Growing shares of the bins are tried, until no fewer would do."""
    where, offset = where.copy(), offset.copy()
    least = -(-int(lengths.sum()) // capacity)
    for share in (0.05, 0.1, 0.2, 0.4, 0.8):
        fill = np.bincount(where, lengths).astype(np.int64)
        if len(fill) <= least:
            break
        gone = np.zeros(len(fill), bool)
        gone[np.argsort(fill, kind="stable")[: math.ceil(share * len(fill))]] = True
        free = np.flatnonzero(gone).tolist()[::-1]
        gaps = sorted((capacity - f, b) for b, f in enumerate(fill.tolist()) if f < capacity and not gone[b])
        items = np.flatnonzero(gone[where])
        items = items[np.argsort(-lengths[items], kind="stable")]
        new_where, new_offset = where.copy(), offset.copy()
        for i in items.tolist():
            size = int(lengths[i])
            at = bisect.bisect_left(gaps, (size, -1))
            gap, b = gaps.pop(at) if at < len(gaps) else (capacity, free.pop() if free else -1)
            if b < 0:
                break
            new_where[i], new_offset[i] = b, capacity - gap
            if gap > size:
                bisect.insort(gaps, (gap - size, b))
        else:
            if free:  # numbers without gaps again
                where, offset = np.unique(new_where, return_inverse=True)[1], new_offset
    return where, offset


def pack(rows: DataFrame, capacity: int = CAPACITY, per_shard: int = PER_SHARD) -> DataFrame:
    """Adds sequence_id and offset to pieces. Pieces are dealt by hash into shards of about
    per_shard, and each shard is packed, longest pieces first, by one task, by sums of squares and then, for
    what the least filled sequences hold, by best fit: what a shard's last sequences leave open is its only loss. Row order, partitions and repeated rows don't matter
    but for which of two equal rows comes first."""
    rows = materialise(rows, "pieces")
    shards = max(1, -(-rows.count() // per_shard))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], ignore_index=True)
        lengths = pdf["length"].to_numpy()
        where, pdf["offset"] = repacked(lengths, *sum_of_squares(lengths, capacity), capacity)
        pdf["sequence_id"] = where * shards + pdf["shard"]
        return pdf.drop(columns="shard")

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """All documents(doc_id, text) as pieces placed in sequences. An empty table gives no row;
    null doc_ids keep their rows; extra columns are ignored."""
    return pack(pieces(docs, tokenizer, capacity), capacity)
