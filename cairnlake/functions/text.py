"""Tokenizers, lines, markdown sections and markers, as column expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Small Latin letters with marks and their bases, by canonical decomposition.
_MARKS = [(c, unicodedata.normalize("NFD", c)) for c in map(chr, range(0xC0, 0x1F00)) if c == c.lower() and unicodedata.name(c, "").startswith("LATIN")]
_MARKS = [(c, d[0]) for c, d in _MARKS if len(d) > 1 and all(map(unicodedata.combining, d[1:]))]
MARKED, BARE = "".join(c for c, _ in _MARKS), "".join(d for _, d in _MARKS)
#: Words that say nothing in a query; fixed values.
STOPWORDS = (
    "그리고", "하지만", "그런데", "그래서", "그러면", "이게", "저게", "이거",
    "저거", "뭐야", "있어", "없어", "해줘", "해봐", "하자", "이렇게", "저렇게",
    "이런", "저런", "정도", "우리", "너가", "니가", "내가", "근데",
    "the", "and", "for", "with", "this", "that", "are", "was", "were", "will",
    "have", "has", "had", "been", "from", "not", "but", "can", "get", "got",
    "you", "your", "they", "them", "their", "our", "out", "off", "about",
    "just", "into", "what", "when", "where", "which", "than", "then",
)


def fold(x: Column) -> Column:
    """Lower case without marks on Latin letters, written as one sign or as two."""
    return F.regexp_replace(F.translate(F.lower(x), MARKED, BARE), r"\p{Mn}", "")


def index_tokens(x: Column) -> Column:
    return F.regexp_extract_all(fold(x), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def query_tokens(x: Column) -> Column:
    """Keywords: ASCII or Hangul, two characters or more, lower-cased, without stop words."""
    found = F.transform(F.regexp_extract_all(x, F.lit(r"[A-Za-z0-9_가-힣]{2,}"), F.lit(0)), F.lower)
    return F.array_except(found, F.array(*map(F.lit, STOPWORDS)))


def keywords(x: Column) -> Column:
    """As query_tokens, with repeats."""
    found = F.transform(F.regexp_extract_all(x, F.lit(r"[A-Za-z0-9_가-힣]{2,}"), F.lit(0)), F.lower)
    return F.filter(found, lambda w: ~w.isin(*STOPWORDS))


def body_tokens(x: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(x, F.lit("[A-Za-z0-9가-힣]{3,}"), F.lit(0)), F.lower))


def title_words(x: Column) -> Column:
    """Words of one capital and five or more small letters, once each."""
    words = F.regexp_extract_all(x, F.lit(r"[\p{L}\p{M}\p{N}_]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: w.rlike("^[A-Z][a-z]{5,}$")))


def overlap_tokens(x: Column) -> Column:
    """Lower-cased runs of letters, marks and digits, two characters or more, once each."""
    return F.array_distinct(F.filter(F.split(F.lower(x), r"[^\p{L}\p{M}\p{N}]+"), lambda w: F.length(w) >= 2))


_BEFORE, _AFTER = r"(?<![\p{L}\p{M}\p{N}_])", r"(?![\p{L}\p{M}\p{N}_])"


def entity_hints(x: Column, most: int = 20) -> Column:
    """Ticket numbers, then runs of up to four capitalised words, in order of appearance, once each. The
    most come from the operator's own limit."""
    all_ = lambda pattern: F.regexp_extract_all(x, F.lit(f"{_BEFORE}(?:{pattern}){_AFTER}"), F.lit(0))
    return F.slice(F.array_distinct(F.concat(all_(r"[A-Z][A-Z0-9]+-[0-9]+"), all_(r"[A-Z][a-z]+(?:[ \t\n\r\f\x0B][A-Z][a-z]+){0,3}"))), 1, most)


def day_string(epoch: Column) -> Column:
    """The day of an epoch second in the session's time zone; - where there is none."""
    return F.when(epoch > 0, F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd")).otherwise("-")


def path_for(axis: Column, id_: Column) -> Column:
    """Where a note of this id is filed: by year and month if the id ends in a date."""
    day = F.regexp_extract(id_, r"([0-9]{6})(?:-[0-9]+)?$", 1)
    dated = F.concat_ws("/", axis, F.concat(F.lit("20"), F.substring(day, 1, 2)), F.substring(day, 3, 2), F.concat(id_, F.lit(".md")))
    return F.when(day != "", dated).otherwise(F.concat_ws("/", axis, F.concat(id_, F.lit(".md"))))


def fingerprint(x: Column) -> Column:
    """A short name of a text, for what was dismissed."""
    return F.substring(F.sha2(x, 256), 1, 13)


def truthy(x: Column) -> Column:
    return F.lower(F.trim(F.coalesce(x, F.lit("")))).isin("true", "1", "yes")


def whole_number(x: Column) -> Column:
    """The integer that a text is, but for spaces around it; else null."""
    return F.when(F.trim(x).rlike("^[+-]?[0-9]+$"), F.trim(x).try_cast("long"))


def word_count(x: Column) -> Column:
    return F.size(F.regexp_extract_all(x, F.lit(r"\S+"), F.lit(0)))


def lines(x: Column) -> Column:
    """Split at every kind of line end; an empty last line doesn't count."""
    parts = F.split(x, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def reference_markers(body: Column) -> Column:
    """ids in back quotes or double brackets, once each."""
    quoted = F.regexp_extract_all(body, F.lit("`([a-z][a-z0-9-]{2,})`"), F.lit(1))
    linked = F.regexp_extract_all(body, F.lit(r"\[\[([a-z0-9][a-z0-9-]*)\]\]"), F.lit(1))
    return F.array_distinct(F.concat(quoted, linked))


def content_hash(x: Column) -> Column:
    return F.substring(F.sha2(x, 256), 1, 16)


_LINE_END = re.compile("\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")


def body_lines(body: str) -> list[str]:
    """A body's lines by every kind of line end; what follows the last one counts, empty or not."""
    return _LINE_END.split(body)


SECTIONS = "array<struct<ord: int, level: int, title: string, path: string, line_start: int, line_end: int, text: string>>"
_FENCE, _HEADING = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$"), re.compile(r"^(#{1,6})\s+(.+?)\s*$")


def split_sections(body: str | None) -> list[tuple]:
    """Headings outside fences with the path of headings above, the span of lines down to the next
    heading of the same or a lower level, and the text up to the next heading of any level."""
    rows = body_lines(body or "")
    fence, heads = "", []
    for i, line in enumerate(rows):
        m = _FENCE.match(line)
        if fence:
            if m and m[1].startswith(fence) and not m[2].strip():
                fence = ""
        elif m and not (m[1][0] == "`" and "`" in m[2]):
            fence = m[1]
        elif h := _HEADING.match(line):
            heads.append((i, len(h[1]), h[2]))
    out, above = [], []
    for k, (i, level, title) in enumerate(heads):
        above = [x for x in above if x[0] < level] + [(level, title)]
        end = next((j for j, other, _ in heads[k + 1 :] if other <= level), len(rows))
        following = heads[k + 1][0] if k + 1 < len(heads) else len(rows)
        out.append((k, level, title, " > ".join(t for _, t in above), i, end, "\n".join(rows[i + 1 : following])))
    return out
