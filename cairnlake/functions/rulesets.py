"""Rules of an axis folded into one policy. Rules are configuration: a few rows, read on the driver."""

from __future__ import annotations

import json
from dataclasses import dataclass

#: Modes from the mildest to the strictest.
MODES = ("auto", "signal_only", "off")


class MalformedRule(ValueError):
    pass


@dataclass(frozen=True)
class Policy:
    whitelist: frozenset[str] | None = None
    deny: frozenset[str] = frozenset()
    mode: str = MODES[0]
    merge_auto: bool = True
    stale_auto_mark: bool = True
    owner_required: bool = False
    required: frozenset[str] = frozenset()
    schemas: tuple[str, ...] = ()

    def allows(self, op: str) -> bool:
        """A denied op never passes; a whitelist passes its own ops, or all by `*`."""
        return not self.deny & {op, "*"} and (self.whitelist is None or bool(self.whitelist & {op, "*"}))


def _params(text: str | None) -> dict:
    try:
        found = json.loads(text or "")
    except ValueError as e:
        raise MalformedRule(f"not JSON: {text!r}") from e
    if not isinstance(found, dict):
        raise MalformedRule(f"not an object: {text!r}")
    return found


def _values(rules: list[tuple[str, dict]], kind: str, key: str, of: type, needed: bool = True) -> list:
    """Param key of each rule of a kind; anything but the expected type is malformed."""
    found = [params.get(key) for k, params in rules if k == kind]
    for x in found:
        if (x is None and needed) or (x is not None and not isinstance(x, of)) or (of is list and any(not isinstance(y, str) for y in x or [])):
            raise MalformedRule(f"{kind} needs {key}, a {of.__name__}: {x!r}")
    return [x for x in found if x is not None]


def effective(axis: str, rules: list[tuple[str, str]]) -> Policy:
    """rules: (kind, params as JSON), those of axes other than this one or `*` left out. Whitelists
    intersect (one with `*` leaves the others as they are), denials unite, the strictest mode holds, an
    automatism needs every rule's consent, an owner is needed if one rule says so. Kinds that aren't known do nothing."""
    read = [(kind, _params(x)) for kind, x in rules]
    if any(not isinstance(p.get("axis") or "", str) for _, p in read):
        raise MalformedRule("axis isn't a string")
    own = [(kind, p) for kind, p in read if (p.get("axis") or "*") in ("*", axis)]
    lists = [frozenset(x) for x in _values(own, "ops.whitelist", "ops", list)]
    narrow = [x for x in lists if "*" not in x]
    modes = _values(own, "consolidate.mode", "mode", str)
    if unknown := set(modes) - set(MODES):
        raise MalformedRule(f"unknown modes {sorted(unknown)}")
    schema = "frontmatter.schema"
    if any(k == schema and not p.keys() & {"schema_id", "required"} for k, p in own):
        raise MalformedRule(f"{schema} needs schema_id or required")
    return Policy(
        whitelist=frozenset.intersection(*narrow) if narrow else (lists[0] if lists else None), deny=frozenset().union(*_values(own, "ops.deny", "ops", list)), mode=max(modes, key=MODES.index, default=MODES[0]),
        merge_auto=all(_values(own, "merge.auto", "enabled", bool)), stale_auto_mark=all(_values(own, "stale.auto_mark", "enabled", bool)), owner_required=any(_values(own, "note.owner_required", "enabled", bool)),
        required=frozenset().union(*_values(own, schema, "required", list, False)), schemas=tuple(_values(own, schema, "schema_id", str, False)),
    )
