"""Templates: the headings that notes of one kind must have, in order and nothing else."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

from .text import body_lines, split_sections

_MARKER = re.compile(r"\s*(?:[0-9]+[.)]?|[①-⑳]|[-*•◦])\s+")


@dataclass
class Heading:
    level: int
    title: str
    guide: str = ""
    below: list[Heading] = field(default_factory=list)

    @property
    def label(self) -> str:
        return f"{'#' * self.level} {self.title}"


def normalised(title: str) -> str:
    """A title without the number or bullet before it, composed, in lower case."""
    whole = unicodedata.normalize("NFC", title)
    m = _MARKER.match(whole)
    return whole[m.end() if m else 0 :].strip(" \t").lower()


def headings(body: str | None) -> list[Heading]:
    """The trees of a body's headings; guide is the text between a heading and the next one."""
    body, top, open_ = body or "", [], []
    rows, found = body_lines(body), split_sections(body)
    for k, (_, level, title, _, start, _, _) in enumerate(found):
        until = found[k + 1][4] if k + 1 < len(found) else len(rows)
        node = Heading(level, title, "\n".join(rows[start + 1 : until]).strip())
        while open_ and open_[-1].level >= level:
            open_.pop()
        (open_[-1].below if open_ else top).append(node)
        open_.append(node)
    return top


def scaffold(frame: list[Heading]) -> str:
    """An empty body of a frame."""
    out = []
    for node in frame:
        out += [node.label, "", *([inner, ""] if (inner := scaffold(node.below)) else [])]
    return "\n".join(out).rstrip("\n")


def violation(frame: list[Heading], found: list[Heading], above: str = "") -> str | None:
    """What keeps found from being the frame: each heading of the frame once, in its order, level and wording the
    same, nothing else beside them; a heading without any below it in the frame is free below. Null if nothing."""
    if not frame:
        return None
    names = [normalised(x.title) for x in frame]
    if twice := next((x for i, x in enumerate(frame) if names[i] in names[:i]), None):
        return f"frame: {above}{twice.label} stands twice"
    place = {(x.level, x.title): i for i, x in enumerate(frame)}
    at = []
    for x in found:
        i = place.get((x.level, x.title))
        if i is None:
            near = next((y for y, name in zip(frame, names, strict=True) if name == normalised(x.title)), None)
            return f"foreign: {above}{x.label}" + (f", meant is {near.label}" if near else "")
        at.append(i)
    if late := next((x for x, i, j in zip(found[1:], at, at[1:]) if j < i), None):
        return f"order: {above}{late.label}"
    for i, x in enumerate(frame):
        if at.count(i) != 1:
            return f"{'missing' if i not in at else 'repeated'}: {above}{x.label}"
    inner = (violation(frame[i].below, x.below, f"{above}{x.label} > ") for x, i in zip(found, at, strict=True))
    return next((v for v in inner if v), None)
