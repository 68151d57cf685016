"""Edits of one markdown body, section by section."""

from __future__ import annotations

import re

from .text import body_lines, split_sections

_PART = re.compile(r"^(#{1,6})\s+(.+?)\s*$")
ACTIONS = ("replace", "append", "prepend", "remove", "rename", "add")


class EditError(ValueError):
    """A request that can't be applied; the body stays."""


def parse_path(path: str) -> list[tuple[int | None, str]]:
    """`A > ### B` as (level or None, title); given levels must rise."""
    parts = [(len(m[1]), m[2]) if (m := _PART.match(p.strip())) else (None, p.strip()) for p in path.split(" > ")]
    levels = [x for x, _ in parts if x]
    if any(not title for _, title in parts) or any(a >= b for a, b in zip(levels, levels[1:])):
        raise EditError(f"invalid section path: {path}")
    return parts


def chains(body: str) -> list[tuple[tuple[int, str, int], ...]]:
    """For each section (level, title, number) from its outermost heading down to itself."""
    out, above = [], []
    for number, level, title, *_ in split_sections(body):
        above = [x for x in above if x[0] < level] + [(level, title, number)]
        out.append(tuple(above))
    return out


def locate(body: str, path: str) -> int:
    """The number of the one section whose title is the path's last part and above which stand the others, in order."""
    *outer, leaf = parse_path(path)
    fits = lambda want, have: want[1] == have[1] and want[0] in (None, have[0])
    found = []
    for number, chain in enumerate(chains(body)):
        above = iter(chain[:-1])
        if fits(leaf, chain[-1]) and all(any(fits(want, have) for have in above) for want in outer):
            found.append(number)
    if len(found) != 1:
        raise EditError(f"{'ambiguous' if found else 'missing'} section: {path}")
    return found[0]


def collisions(body: str) -> set[tuple]:
    """Headings that stand twice under one parent, as (parents, level, title)."""
    seen, twice = set(), set()
    for chain in chains(body):
        parent, (level, title, _) = tuple(x[2] for x in chain[:-1]), chain[-1]
        (twice if (parent[-1:], level, title) in seen else seen).add((parent[-1:], level, title))
    return twice


def piece(body: str, path: str) -> str:
    """A section with its heading and all below it."""
    s = split_sections(body)[locate(body, path)]
    return "\n".join(body_lines(body)[s[4] : s[5]])


def apply(body: str, action: str, path: str | None, content: str | None, subtree: bool | None = False) -> str:
    """The body after one edit; an empty path is what stands above the first heading.

    replace, append and prepend change a section's own text, with subtree all below its heading;
    remove takes the section, with subtree and only so with sections below it (content, if not null, says how that must read), rename its title only, add puts content at the
    body's end. No edit may leave two equal headings under one parent that weren't there before."""
    if action not in ACTIONS:
        raise EditError(f"unknown action: {action}")
    rows, new = body_lines(body), (content or "").split("\n")
    if action == "add":
        text = body.rstrip("\n")
        out = f"{text}\n{content or ''}" if text else content or ""
    else:
        parts = split_sections(body)
        if path:
            at = locate(body, path)
            _, level, _, _, start, end, _ = parts[at]
            below = parts[at + 1][4] if at + 1 < len(parts) else len(rows)
            own = end if subtree else min(end, below)
        else:
            level, start, own = 6, -1, parts[0][4] if parts else len(rows)
            if action in ("remove", "rename"):
                raise EditError(f"{action} needs a section")
        if action == "replace":
            first = next((m for x in new if x.strip() for m in [_PART.match(x)]), None)
            if path and first and len(first[1]) <= level:
                raise EditError("replace keeps the heading; content begins with one of its level or above")
            rows[start + 1 : own] = new
        elif action == "prepend":
            rows[start + 1 : start + 1] = new
        elif action == "append":
            rows[own:own] = new
        elif action == "remove":
            if content is not None and content != "\n".join(rows[start:end]):
                raise EditError(f"section has changed: {path}")
            if not subtree and own < end:
                raise EditError(f"section has sections below it: {path}")
            del rows[start:end]
        else:
            if len(new) > 1 or not new[0].strip():
                raise EditError("a title is one line")
            rows[start] = f"{'#' * level} {new[0].strip()}"
        out = "\n".join(rows)
    if len(collisions(out)) > len(collisions(body)):
        raise EditError("two equal headings under one parent")
    return out


def read_within(body: str, words: int) -> tuple[str, int, list[str], str | None]:
    """(text, its words, paths of sections left out, where it is cut) of a body read up to so many words: whole sections from the
    top until one doesn't fit; of a lone outer section those within it. What stands above them comes first, and is cut by lines if it
    alone is too much, as is a first section that is; a cut always leaves a line."""
    rows, count = body_lines(body), lambda a, b: sum(len(x.split()) for x in rows[a:b])
    if count(0, len(rows)) <= words:
        return body, count(0, len(rows)), [], None
    found = split_sections(body)

    def outermost(a: int, b: int) -> list[tuple]:
        out: list[tuple] = []
        for s in found:
            if a <= s[4] < b and (not out or s[4] >= out[-1][5]):
                out.append(s)
        return out

    def up_to(a: int, b: int) -> int:
        end, had = a, 0
        while end < b and (end == a or had + count(end, end + 1) <= words):
            had, end = had + count(end, end + 1), end + 1
        return end

    label = lambda s: f"{'#' * s[1]} {s[2]}"
    above, units = "", outermost(0, len(rows))
    while len(units) == 1 and (inner := outermost(units[0][4] + 1, units[0][5])):
        above, units = " > ".join(filter(None, (above, label(units[0])))), inner
    paths = [" > ".join(filter(None, (above, label(s)))) for s in units]
    head = units[0][4] if units else len(rows)
    if count(0, head) > words:
        end = up_to(0, head)
        return "\n".join(rows[:end]), count(0, end), paths, above or "(preamble)"
    had, shown = count(0, head), 0
    while shown < len(units) and had + count(units[shown][4], units[shown][5]) <= words:
        had, shown = had + count(units[shown][4], units[shown][5]), shown + 1
    if shown == len(units):
        return body, had, [], None
    if not shown and not had:
        end = up_to(units[0][4], units[0][5])
        return "\n".join(rows[:end]), count(0, end), paths[1:], paths[0]
    return "\n".join(rows[: units[shown][4]]), had, paths[shown:], None
