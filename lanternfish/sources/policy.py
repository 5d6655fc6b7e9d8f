"""Suppression policies: a small text of rules, fingerprints and path globs."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_BYTES, MAX_LINE, MAX_RULES = 65_536, 512, 256


@dataclass(frozen=True)
class Policy:
    paths: tuple[str, ...] = ()
    rules: tuple[str, ...] = ()
    fingerprints: tuple[str, ...] = ()
    digest: str = ""


def parse_policy(text: str) -> Policy:
    """Lines of rule:id, finding:hex, test:hex, path:glob or a bare glob; # comments. Anything else is an error."""
    if len(text.encode()) > MAX_BYTES:
        raise ValueError("policy too large")
    kinds: dict[str, list[str]] = {"path": [], "rule": [], "finding": []}
    for line in filter(lambda x: x and x[0] != "#", map(str.strip, text.splitlines())):
        kind, sep, rest = line.partition(":")
        kind, value = ({"test": "finding"}.get(kind, kind), rest) if sep and kind in ("path", "rule", "finding", "test") else ("path", line)
        if kind == "path":
            value = value.replace("\\", "/").lstrip("/")
        fine = {"rule": lambda v: re.fullmatch(r"[a-z][a-z0-9_]{0,79}", v), "finding": lambda v: re.fullmatch(r"[a-f0-9]{32,64}", v), "path": lambda v: ":" not in v and ".." not in v.split("/")}[kind]
        if len(line) > MAX_LINE or sum(map(len, kinds.values())) >= MAX_RULES or not fine(value):
            raise ValueError(f"policy line not understood: {kind}")
        kinds[kind].append(value)
    return Policy(tuple(kinds["path"]), tuple(kinds["rule"]), tuple(kinds["finding"]), hashlib.sha256(text.encode()).hexdigest())


def glob_pattern(glob: str) -> str:
    """A case-sensitive shell glob as an anchored regular expression; * crosses slashes."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2) if c == "[" else -1
        if c == "[" and end > 0:
            inner = glob[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]"
            i = end
        else:
            out += {"*": ".*", "?": "."}.get(c, re.escape(c))
        i += 1
    return f"(?s)^(?:.*/)?{out}$"


def suppressed(policy: Policy, path: Column, rule: Column, fingerprint: Column) -> Column:
    """Whether a policy of bounded size names the finding. It annotates; dropping is the caller's choice."""
    p = F.regexp_replace(F.regexp_replace(path, r"^https?://[^/?#]*", ""), "^/+", "")
    hit = rule.isin(*policy.rules) if policy.rules else F.lit(False)
    if policy.fingerprints:
        hit = hit | fingerprint.isin(*policy.fingerprints)
    for g in policy.paths:
        hit = hit | p.rlike(glob_pattern(g))
    return hit
